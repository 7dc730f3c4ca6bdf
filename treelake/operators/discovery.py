"""What pages offer to programs: scripts, declared tools, agent catalogs, evidence for a closer look."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from treelake.functions.text import collapse_text
from treelake.html.tree import Node, parse

MOST_REFERENCES, MOST_CATALOGS, MOST_TOOLS, MOST_ENTRIES = 8, 8, 64, 1_000
#: Bytes of a page's tools together.
MOST_TOOL_BYTES = 256 * 1024
# Script types that run.
SCRIPT_TYPES = frozenset("application/ecmascript application/javascript application/x-ecmascript application/x-javascript text/ecmascript text/javascript text/javascript1.0 text/javascript1.1 text/javascript1.2 text/javascript1.3 text/javascript1.4 text/javascript1.5 text/jscript text/livescript text/x-ecmascript text/x-javascript".split())


def _texts(f: Callable[[str], object]):
    """A column function that gives ``f`` of each text as JSON; null for null."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(f(t), ensure_ascii=False), na_action="ignore")

    return run


def scripts_of(html: str) -> list[dict]:
    """Executable scripts in document order: kind, label, whether inline, source."""
    out = []
    for n in parse(html).walk():
        kind = n.attrs.get("type", "").strip().lower() if n.tag == "script" else None
        if kind is None or kind not in ("", "module", "importmap") and kind not in SCRIPT_TYPES:
            continue
        source = n.all_text().strip()
        if "src" in n.attrs or source:
            named = {"module": "module", "importmap": "import_map"}.get(kind, "classic")
            out.append({"index": len(out), "kind": named, "is_inline": "src" not in n.attrs, "label": n.attrs.get("src", f"inline-{len(out)}"), "source": "" if "src" in n.attrs else source})
    return out


SCRIPT_SCHEMA = "array<struct<index:int,kind:string,is_inline:boolean,label:string,source:string>>"


def scripts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per executable script; pages without the word script never reach Python."""
    rows = pages.filter(F.contains(F.lower(html), F.lit("<script")))
    return rows.select(F.col(key), F.explode(F.from_json(_texts(scripts_of)(html), SCRIPT_SCHEMA)).alias("s")).select(key, "s.*")


def within_budget(rows: DataFrame, key: str, order: str, size: Column, most: int, most_bytes: int) -> DataFrame:
    """Rows of each key, in order, while their number and summed size stay within bounds."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__n", F.count("*").over(by)).withColumn("__b", F.sum(size).over(by)).filter((F.col("__n") <= most) & (F.col("__b") <= most_bytes)).drop("__n", "__b")


def catalog_links(html: str) -> list[str]:
    """Targets of links that name an agent catalog; the number is bounded."""
    found = [n.attrs["href"] for n in parse(html).walk() if n.tag == "link" and "ai-catalog" in n.attrs.get("rel", "").lower().split() and "href" in n.attrs]
    return found[:MOST_REFERENCES]


def agentmaps(robots: str) -> list[str]:
    """Values of the Agentmap lines of a robots file; the number is bounded."""
    found = re.findall(r"(?im)^[ \t]*agentmap[ \t]*:[ \t]*([^#\r\n]*?)[ \t]*(?:#.*)?\r?$", robots)
    return [v for v in found if v][:MOST_REFERENCES]


def catalog_candidates(sites: DataFrame) -> DataFrame:
    """(origin, url, source) from sites (origin, html, robots_txt): the well-known place, links and agentmaps.

    Each url once a site; at most ``MOST_CATALOGS`` a site, the well-known place first.
    """
    strings = ArrayType(StringType())

    @F.pandas_udf(strings)
    def from_html(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: catalog_links(t) if t and "ai-catalog" in t.lower() else [])

    @F.pandas_udf(strings)
    def from_robots(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: agentmaps(t or ""))

    @F.pandas_udf(StringType())
    def absolute(origin: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([urljoin(o + "/", u) for o, u in zip(origin, url)])

    def tag(found: Column, source: str) -> Column:
        return F.transform(found, lambda u: F.struct(u.alias("u"), F.lit(source).alias("s")))

    tagged = [tag(F.array(F.lit("/.well-known/ai-catalog.json")), "well_known"), tag(from_html("html"), "html_link"), tag(from_robots("robots_txt"), "agentmap")]
    rows = sites.select("origin", F.explode(F.concat(*tagged)).alias("x")).select("origin", absolute("origin", "x.u").alias("url"), F.col("x.s").alias("source")).filter(F.startswith("url", F.lit("https://")))
    rank = F.when(F.col("source") == "well_known", 0).otherwise(1)
    once = rows.groupBy("origin", "url").agg(F.min_by("source", rank).alias("source"))
    place = F.row_number().over(Window.partitionBy("origin").orderBy(F.when(F.col("source") == "well_known", 0).otherwise(1), "url"))
    return once.withColumn("place", place).filter(F.col("place") <= MOST_CATALOGS).drop("place")


_LABEL = re.compile(r"(?!-)[A-Za-z0-9-]{1,63}(?<!-)")
_MEDIA = re.compile(r"[!#$&'*+.^_`|~A-Za-z0-9-]+/[!#$&'*+.^_`|~A-Za-z0-9-]+")


def publisher(identifier: str) -> str | None:
    """The publisher's domain of a catalog entry's identifier; None where the identifier is invalid."""
    head, *parts = identifier.removeprefix("urn:air:").split(":")
    domain = head.rstrip(".").lower()
    named = bool(parts) and all(re.fullmatch(r"[A-Za-z0-9._-]{1,128}", p) for p in parts)
    good = identifier.startswith("urn:air:") and named and "." in domain and len(domain) <= 253 and all(map(_LABEL.fullmatch, domain.split(".")))
    return domain if good else None


def entry_error(entry: object) -> str | None:
    """What is wrong with a catalog entry, or None."""
    if not isinstance(entry, dict):
        return "entry must be an object"
    for field, most in (("identifier", 512), ("displayName", 256), ("type", 128)):
        value = entry.get(field)
        if not isinstance(value, str) or not value.strip() or len(value.encode()) > most:
            return f"{field} is missing or invalid"
    if publisher(entry["identifier"]) is None:
        return "identifier is invalid"
    if not _MEDIA.fullmatch(entry["type"]):
        return "type must be a media type"
    if ("url" in entry) == ("data" in entry):
        return "exactly one of url and data is required"
    if "url" in entry:
        url = urlsplit(entry["url"] if isinstance(entry["url"], str) else "")
        if url.scheme != "https" or not url.hostname or "@" in url.netloc:
            return "url must be https without credentials"
    elif not isinstance(entry["data"], dict):
        return "data must be an object"
    return None


def catalog_entries(body: str) -> list[dict]:
    """Every entry of a catalog with its error, if any; a catalog that can't be read is one row with an error."""
    try:
        root = json.loads(body)
    except (ValueError, RecursionError):
        return [{"position": -1, "error": "malformed JSON"}]
    host = root.get("host") if isinstance(root, dict) else None
    if not isinstance(host, dict) or not host.get("displayName") or not isinstance(root.get("entries"), list) or len(root["entries"]) > MOST_ENTRIES:
        return [{"position": -1, "error": "catalog is invalid"}]
    out = []
    for i, e in enumerate(root["entries"]):
        error = entry_error(e)
        e = e if isinstance(e, dict) else {}
        out.append({"position": i, "error": error, "identifier": e.get("identifier"), "publisher": publisher(str(e.get("identifier"))), "display_name": e.get("displayName"), "media_type": e.get("type"), "url": e.get("url")})
    return out


def catalogs(bodies: DataFrame) -> DataFrame:
    """Entries of catalogs (catalog_url, body); an identifier counts once, at its first catalog and place."""
    schema = "array<struct<position:int,error:string,identifier:string,publisher:string,display_name:string,media_type:string,url:string>>"
    rows = bodies.select("catalog_url", F.explode(F.from_json(_texts(catalog_entries)("body"), schema)).alias("e")).select("catalog_url", "e.*")
    nth = F.row_number().over(Window.partitionBy("identifier", F.col("error").isNull()).orderBy("catalog_url", "position"))
    twice = F.col("error").isNull() & (nth > 1)
    host = F.lower(F.regexp_extract("catalog_url", r"^https?://([^/:]+)", 1))
    return rows.withColumn("error", F.when(twice, "duplicate entry identifier").otherwise(F.col("error"))).withColumn("publisher_is_host", F.col("publisher") == host)


def _field(control: Node, labels: dict[str, str]) -> dict:
    kind = control.attrs.get("type", "text").lower() if control.tag == "input" else control.tag
    out: dict = {"type": "number" if kind in ("number", "range") else "boolean" if kind == "checkbox" else "string"}
    told = control.attrs.get("toolparamdescription") or labels.get(control.attrs.get("id", "")) or control.attrs.get("aria-description")
    if told:
        out["description"] = told
    if control.tag == "select":
        out["enum"] = [o.attrs.get("value", collapse_text(o.all_text())) for o in control.walk() if o.tag == "option"]
    return out


def tools_of(html: str) -> list[dict]:
    """Tools that forms declare (both tool name and description), with their input schemas."""
    out = []
    root = parse(html)
    labels = {n.attrs["for"]: collapse_text(n.all_text()) for n in root.walk() if n.tag == "label" and n.attrs.get("for")}
    for form in (n for n in root.walk() if n.tag == "form"):
        if not form.attrs.get("toolname") or not form.attrs.get("tooldescription"):
            continue
        controls = [n for n in form.walk() if n.tag in ("input", "select", "textarea") and n.attrs.get("name") and "disabled" not in n.attrs]
        schema = {"type": "object", "properties": {n.attrs["name"]: _field(n, labels) for n in reversed(controls)}}
        if needed := sorted({n.attrs["name"] for n in controls if "required" in n.attrs}):
            schema["required"] = needed
        out.append({"name": form.attrs["toolname"], "description": form.attrs["tooldescription"], "input_schema": json.dumps(schema, ensure_ascii=False, sort_keys=True), "auto_submit": "toolautosubmit" in form.attrs})
    return out


def tools(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Declared tools of https pages by name, each name once a page: the first ``MOST_TOOLS`` as long as they have ``MOST_TOOL_BYTES`` together; the bounds are the feature."""
    rows = pages.filter(F.startswith(url, F.lit("https://")) & F.contains(F.lower(html), F.lit("toolname")))
    schema = "array<struct<name:string,description:string,input_schema:string,auto_submit:boolean>>"
    found = rows.select(F.col(key), F.posexplode(F.from_json(_texts(tools_of)(html), schema)).alias("position", "t")).select(key, "position", "t.*")
    once = found.withColumn("nth", F.row_number().over(Window.partitionBy(key, "name").orderBy("position"))).filter("nth = 1").drop("nth")
    by = Window.partitionBy(key).orderBy("name", "position")
    size = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in ("name", "description", "input_schema")), F.lit(0))
    placed = once.withColumn("place", F.row_number().over(by)).withColumn("upto", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return placed.filter((F.col("place") <= MOST_TOOLS) & (F.col("upto") <= MOST_TOOL_BYTES)).drop("place", "upto")


def catalog_summary(bodies: DataFrame, entries: DataFrame) -> DataFrame:
    """(catalogs, catalogs_failed, entries, entries_valid, entries_invalid, duplicates, publishers, publishers_verified) of ``catalogs``.

    A catalog that can't be read is failed and its one row no entry; a publisher is verified where it is the host of a catalog that names it.
    """
    entry, good = F.col("position") >= 0, F.col("error").isNull()
    counts = entries.agg(
        F.count_distinct(F.when(~entry, F.col("catalog_url"))).alias("catalogs_failed"), F.count_if(entry).alias("entries"), F.count_if(entry & good).alias("entries_valid"), F.count_if(entry & ~good).alias("entries_invalid"),
        F.count_if(F.col("error") == "duplicate entry identifier").alias("duplicates"), F.count_distinct(F.when(entry & good, F.col("publisher"))).alias("publishers"), F.count_distinct(F.when(entry & good & F.col("publisher_is_host"), F.col("publisher"))).alias("publishers_verified"),
    )
    return bodies.agg(F.count_distinct("catalog_url").alias("catalogs")).join(counts)


def insufficiency(html: Column, meaningful: Column) -> Column:
    """Why a page's tree may not be enough: empty, nearly empty, canvas-heavy, image maps."""
    low = F.lower(html)
    canvas = F.size(F.regexp_extract_all(low, F.lit("<canvas"), F.lit(0)))
    maps = F.size(F.regexp_extract_all(low, F.lit("<map|usemap=|type=[\"']image[\"']"), F.lit(0)))
    return F.array_compact(
        F.array(
            F.when(meaningful == 0, "meaningful_structure_empty").when((meaningful <= 2) & (F.octet_length(html) >= 1024), "meaningful_structure_near_empty"),
            F.when((canvas > 0) & (meaningful <= canvas * 2 + 2), "canvas_heavy_structure"),
            F.when(maps > 0, "image_map_or_image_control_evidence"),
        )
    )


def visual_trigger(reasons: Column, mode: str) -> Column:
    """(recommended, attempted, reasons) of a closer look by mode: never, auto or always."""
    short = F.size(reasons) > 0
    if mode == "always":
        return F.struct(F.lit(True).alias("recommended"), F.lit(True).alias("attempted"), F.array(F.lit("explicit_always_mode")).alias("reasons"))
    return F.struct(short.alias("recommended"), (short if mode == "auto" else F.lit(False)).alias("attempted"), reasons.alias("reasons"))
