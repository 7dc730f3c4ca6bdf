"""Text functions: column forms where built-ins say it, Arrow forms where bytes count."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the white space that is collapsed, Unicode White_Space.
SPACES = "\t\n\u000b\u000c\r \u0085   -     　"
_SPACES = re.compile(f"[{SPACES}]+")


def collapse(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACES}]+", " "))


def truncate(c: Column, most: int) -> Column:
    """Collapsed text of at most ``most`` characters, the last three dots if it was longer."""
    text = collapse(c)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(max(0, most - 3))), F.lit("..."))).otherwise(text)


def collapse_text(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def cut_bytes(text: str, most: int) -> str:
    """The longest prefix of at most ``most`` UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")


def smart_truncate(text: str, most: int) -> str:
    """At most ``most`` bytes: to the last sentence end in the last three fifths, else to the last word and dots."""
    if len(text.encode("utf-8", "surrogatepass")) <= most:
        return text
    window = cut_bytes(text, most)
    end = max(window.rfind(x) for x in ".!?")
    if end >= 0 and len(window[:end].encode("utf-8")) >= most * 2 // 5:
        return window[: end + 1]
    words = list(_SPACES.finditer(window))
    if words:
        return window[: words[-1].end() - 1] + "..."
    return cut_bytes(text, max(1, len(window.encode("utf-8")) - 3)) + "..."


def normalize_text(text: str) -> str:
    """Collapsed text; more than 200 characters are cut to 200 bytes."""
    text = collapse_text(text)
    return smart_truncate(text, 200) if len(text) > 200 else text


@F.pandas_udf(StringType())
def normalize(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_text, na_action="ignore")


#: Hints and the parts of class names that give them.
CLASS_HINTS = {
    "primary": ["primary", "cta"], "secondary": ["secondary"], "danger": ["danger", "destructive", "delete"], "warning": ["warning", "caution"], "success": ["success"], "error": ["error", "invalid"],
    "disabled": ["disabled"], "active": ["active", "current"], "selected": ["selected", "checked"], "hidden": ["hidden", "sr-only"], "loading": ["loading", "spinner", "skeleton"],
    "collapsed": ["collapsed", "is-closed"], "expanded": ["expanded", "is-open", "show"], "large": ["lg", "large", "xl"], "small": ["sm", "xs", "mini"], "hero": ["hero", "jumbotron", "banner"],
    "modal": ["modal", "dialog", "popup", "overlay"], "notification": ["toast", "snackbar", "notification", "alert"], "badge": ["badge", "chip", "tag", "pill"], "sticky": ["sticky", "fixed", "pinned"],
    "required": ["required", "mandatory"],
}


def class_hints(classes: Column) -> Column:
    """Sorted semantic hints of a class attribute, by parts of names; null where there are none."""
    low = F.lower(classes)
    found = [F.when(low.rlike("|".join(parts)), F.lit(hint)) for hint, parts in CLASS_HINTS.items()]
    found.append(F.when(F.contains(low, F.lit("card")) & ~F.contains(low, F.lit("discard")), F.lit("card")))
    hints = F.array_sort(F.array_compact(F.array(*found)))
    return F.when(F.size(hints) > 0, hints)


#: Region hints in order, and the parts of class or id that give them.
REGION_HINTS = [("navigation", ["nav", "menu"]), ("main", ["primary-content", "article-body", "main"]), ("aside", ["sidebar", "side-bar", "aside", "rail"]), ("footer", ["footer", "copyright"]), ("header", ["header", "masthead"]), ("search", ["search"])]


def region_hint(classes: Column, html_id: Column) -> Column:
    """The region that class or, failing that, id speaks of; first hint in order wins."""

    def one(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for role, parts in reversed(REGION_HINTS):
            out = F.when(F.lower(c).rlike("|".join(parts)), F.lit(role)).otherwise(out)
        return out

    return F.coalesce(one(classes), one(html_id))


def looks_like_footer(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"copyright|©|privacy|terms of|all rights reserved"), F.lit(False))


def looks_like_navigation(links: Column, children: Column) -> Column:
    return (children > 0) & (links >= 3) & (links / children > 0.5)


def token_estimate(size: Column) -> Column:
    """Tokens of so many bytes, four to a token, rounded up."""
    return F.ceil(size / 4).cast("bigint")
