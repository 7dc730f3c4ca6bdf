"""Pages as compact text for agents: regions, targets with their ids, states and keys, and short content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.functions.digests import action_keys
from treelake.operators.elements import has_actions, non_empty, ordered_parts

# Fixed values, in the order in which they are said: attributes said where they aren't empty, and where they are there at all, and states.
SAID = "value name accept capture? multiple? size? autocomplete inputmode enterkeyhint autocapitalize dirname form list target rel hreflang type referrerpolicy download? popovertarget popovertargetaction commandfor command popover button_type formaction formmethod formenctype formtarget formnovalidate? accesskey title source_role test_id spellcheck? draggable? minlength? maxlength? min? max? step? pattern?".split()
STATES = "expanded pressed selected current controls haspopup invalid label labelledby describedby placeholder autocomplete active_descendant errormessage keyshortcuts roledescription busy live atomic relevant owns flowto details multiline multiselectable orientation sort level posinset setsize grabbed dropeffect valuemin valuemax valuenow valuetext".split()
_RENAMED = {n: f"aria_{n}" for n in ("autocomplete", "placeholder", "label")}
MOST_ITEMS, MOST_ROWS, MOST_OPTIONS = 5, 3, 5
PARSED = "items array<struct<text:string>>, options array<struct<text:string,value:string>>, headers array<string>, rows array<array<string>>, selected_values array<string>"


def _bool(c: Column) -> Column:
    """Truth values as they are said: True and False."""
    return F.when(c == "true", "True").when(c == "false", "False").otherwise(c)


def _flag(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f'[{name}="'), _bool(value), F.lit('"]')))


def state_text(a: Column, states: Column, parsed: Column) -> Column:
    """The flags of an element: what blocks or enables it, its key, and its attributes and states."""
    on = lambda c: F.coalesce(c == "true", F.lit(False))
    disabled, inert, required = on(a["disabled"]), on(a["inert"]), on(a["required"])
    readonly = on(a["readonly"]) | on(states["readonly"])
    acts = has_actions()
    blocked = F.when(disabled, "[disabled] [blocked_reason=disabled]").when(inert, "[inert] [blocked_reason=inert]").when(readonly, "[readonly] [blocked_reason=readonly]").when(acts, "[enabled]")
    flags = [
        blocked, F.when(acts, F.concat(F.lit("[cache_key="), F.col("cache_key"), F.lit("]"))), F.when(acts & (F.col("html_id") != ""), F.concat(F.lit('[html_id="'), "html_id", F.lit('"]'))),
        F.when(required, "[required]"), F.when(readonly & (disabled | inert), "[readonly]"), F.when(inert & disabled, "[inert]"),
    ]
    for name in SAID:
        flags.append(_flag(name[:-1], a[name[:-1]]) if name.endswith("?") else _flag(name, F.when(~a[name].isin("", "false"), a[name])))
        if name == "multiple?":
            flags.append(_flag("selected_values", F.when(F.size(parsed["selected_values"]) > 0, F.array_join(parsed["selected_values"], ","))))
    flags.append(_flag("checked", F.coalesce(a["checked"], states["checked"])))
    flags += [_flag(_RENAMED.get(n, n), states[n]) for n in STATES]
    flags += [_flag(n, non_empty(a[n])) for n in ("group", "description")]
    return F.concat_ws(" ", *flags)


def element_lines(indent: str = "  ") -> Column:
    """One element as an array of at most one text (of several lines for lists and tables)."""
    a, parsed = F.col("__a"), F.col("__p")
    states = F.from_json(a["aria"], "map<string,string>")
    text, label = F.coalesce("text", F.lit("")), F.coalesce("label", F.lit(""))
    display, named = F.when(label != "", label).otherwise(text), lambda n: F.coalesce(a[n], F.lit(""))
    hints = F.when(F.size("hints") > 0, F.concat(F.lit(" "), F.array_join(F.transform("hints", lambda h: F.concat(F.lit("["), h, F.lit("]"))), " "))).otherwise("")
    said = state_text(a, states, parsed)
    tail = F.when(said != "", F.concat(hints, F.lit(" "), said)).otherwise(hints)
    quoted = lambda n: F.when(a[n] != "", F.concat(F.lit(f'{n}="'), a[n], F.lit('"')))
    own = F.when(label != "", F.concat(F.lit('"'), label, F.lit('"')))
    options = F.coalesce(F.size(parsed["options"]), F.lit(0))
    shown = F.array_join(F.transform(F.slice(parsed["options"], 1, MOST_OPTIONS), lambda o: F.coalesce(o["text"], o["value"], F.lit(""))), ", ")
    role = F.col("role")
    on = lambda c: F.coalesce(c == "true", F.lit(False))
    target = (
        F.when(role == "link", F.concat(F.lit('link "'), display, F.lit('" -> '), named("href")))
        .when(role == "text_input", F.concat_ws(" ", F.concat(F.lit("input("), F.coalesce(a["input_type"], F.lit("text")), F.lit(")")), own, quoted("placeholder"), quoted("value")))
        .when(role == "textarea", F.concat_ws(" ", F.lit("textarea"), own, quoted("placeholder")))
        .when(role == "select", F.concat(F.lit('select "'), display, F.lit('"'), F.when(options > 0, F.concat(F.lit(" ["), shown, F.lit("]"))).otherwise(""), F.when(options > MOST_OPTIONS, F.concat(F.lit(" (+"), options - MOST_OPTIONS, F.lit(" more)"))).otherwise("")))
        .when(role == "checkbox", F.concat(F.lit('checkbox "'), display, F.when(on(a["checked"]), '" (checked)').otherwise('" (unchecked)')))
        .when(role == "radio", F.concat(F.lit('radio "'), display, F.lit('"'), F.when(a["group"] != "", F.concat(F.lit(" group="), a["group"])).otherwise(""), F.when(on(a["checked"]) | on(states["checked"]), " (selected)").otherwise("")))
        .otherwise(F.concat(role, F.lit(' "'), display, F.lit('"')))
    )
    target = F.concat(F.lit(f"{indent}["), F.coalesce("id", F.lit("")), F.lit("] "), target, tail)
    items, rows, headers = parsed["items"], parsed["rows"], parsed["headers"]
    n_items, n_rows = F.coalesce(F.size(items), F.lit(0)), F.coalesce(F.size(rows), F.lit(0))
    marked = F.transform(F.slice(items, 1, MOST_ITEMS), lambda x, i: F.concat(F.lit(indent), F.when(on(a["ordered"]), F.concat((i + 1).cast("string"), F.lit("."))).otherwise("-"), F.lit(" "), F.coalesce(x["text"], F.lit(""))))
    listed = F.when(n_items > 0, F.concat(F.array_join(marked, "\n"), F.when(n_items > MOST_ITEMS, F.concat(F.lit(f"\n{indent}  ["), n_items - MOST_ITEMS, F.lit(" more items]"))).otherwise("")))
    head = F.when(F.size(headers) > 0, F.concat(F.lit(f"{indent}table: "), F.array_join(headers, " | ")))
    lines = F.array_join(F.transform(F.slice(rows, 1, MOST_ROWS), lambda r: F.concat(F.lit(f"{indent}  "), F.array_join(r, " | "))), "\n")
    table = F.when((n_rows == 0) & head.isNull(), f"{indent}table (empty)").otherwise(F.concat_ws("\n", head, F.when(n_rows > 0, lines), F.when(n_rows > MOST_ROWS, F.concat(F.lit(f"{indent}  ["), n_rows - MOST_ROWS, F.lit(" more rows]")))))
    content = (
        F.when(role == "heading", F.concat(F.lit(f"{indent}h"), F.coalesce(a["level"], F.lit("1")), F.lit(": "), text))
        .when(role == "paragraph", F.when(text != "", F.concat(F.lit(f"{indent}p: "), text)))
        .when(role == "image", F.when(a["alt"] != "", F.concat(F.lit(f"{indent}image: "), a["alt"])).otherwise(f"{indent}image"))
        .when(role == "list", listed).when(role == "table", table).when(role == "separator", f"{indent}---")
        .when(role == "section", F.when(a["section_label"] != "", F.concat(F.lit(f"{indent}section: "), a["section_label"])))
        .otherwise(F.when(text != "", F.concat(F.lit(indent), role, F.lit(": "), text)))
    )
    return F.array_compact(F.array(F.when(has_actions(), target).otherwise(content)))


def agent_text(elements: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, content) of each page: title and url, regions with where forms go, elements, and sizes.

    Targets come with their ids, lists with five items and tables with three rows at most. The three
    tables have no repeated rows. attrs that are no object count as none; a page without regions has
    its head and sizes only.
    """
    a = F.when(F.startswith(F.ltrim("attrs"), F.lit("{")), F.from_json("attrs", "map<string,string>"))
    empty = F.create_map().cast("map<string,string>")
    rows = elements.withColumn("__a", F.coalesce(a, empty)).withColumn("__p", F.from_json("attrs", PARSED))
    label = F.coalesce(non_empty(F.col("label")), non_empty(F.col("text")))
    parts = F.array("id", "role", label, F.array_join(F.array_sort("actions"), ","), *(F.col("__a")[n] for n in ("name", "href", "input_type", "group", "placeholder")))
    acting = rows.filter(has_actions()).withColumn("cache_key", action_keys(parts))
    others = rows.filter(~F.coalesce(has_actions(), F.lit(False))).withColumn("cache_key", F.lit(None).cast("string"))
    body = ordered_parts(acting.unionByName(others), ["page_id", "region_ord"], element_lines())
    head = F.concat(F.lit("## "), "role", F.when(F.col("label") != "", F.concat(F.lit(' "'), "label", F.lit('"'))).otherwise(""), F.when(F.col("action") != "", F.concat(F.lit(" -> "), "action", F.lit(" ["), F.coalesce("method", F.lit("GET")), F.lit("]"))).otherwise(""))
    none = F.array().cast("array<string>")
    blocks = regions.withColumn("__h", head).select("page_id", "region_ord", "__h").join(body, ["page_id", "region_ord"], "left")
    block = F.concat(F.array("__h"), F.coalesce("lines", none), F.array(F.lit("")))
    parts = blocks.groupBy("page_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("region_ord", block.alias("b")))), lambda x: x["b"])).alias("lines"))
    ratio = F.when(F.col("som_bytes") > 0, F.concat(F.format_string("%.1f", F.bround(F.col("html_bytes") / F.col("som_bytes"), 1)), F.lit("x"))).otherwise("N/A")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    sizes = F.concat(F.format_number(count("html_bytes"), 0), F.lit(" → "), F.format_number(count("som_bytes"), 0), F.lit(" bytes ("), ratio, F.lit(") | "), count("element_count"), F.lit(" elements, "), count("interactive_count"), F.lit(" interactive"))
    top = F.array(F.concat(F.lit("Page: "), F.coalesce("title", F.lit("Untitled"))), F.concat(F.lit("URL: "), F.coalesce("url", F.lit(""))), F.lit(""))
    return pages.join(parts, "page_id", "left").select("page_id", F.array_join(F.concat(top, F.coalesce("lines", none), F.array(F.lit("---"), sizes)), "\n").alias("content"))
