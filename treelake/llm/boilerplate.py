"""Main content of pages, by tag-path ratios.

Every element has root-to-leaf paths: its region's role, its own role and a fragment of its text, the
beginning or end of a sentence (canonical form, site name and numbers masked). Fragments that stand in
regions of page chrome elsewhere speak for chrome, by their smoothed share of occurrences there. Text
length and punctuation are added up per path of roles, less what such fragments take; this ratio is
smoothed, fused with the element's own text and that of the elements around, and thresholded by the
element's share in chrome. There is no list of phrases. Then template residue (problem 5) is left out,
and pages that are a mere index, an error message or a demand for scripts are told by what else they
have: they have no main body.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelake.llm.canonical import canonical
from treelake.llm.residue import residue
from treelake.operators.dedupe import latest
from treelake.session import cut

ROLES = ("heading", "paragraph", "list", "table", "section")
#: Kinds of residue that stand in place of a page.
MESSAGES = ("error_page", "script_notice")
CHROME_REGIONS = ("navigation", "footer", "aside", "dialog")
#: Region roles with a ratio of their own; all others are one.
REGION_ROLES = (*CHROME_REGIONS, "main", "header", "form", "content")
#: Occurrences that a fragment's share in chrome regions and a path's ratio are smoothed with.
PRIOR = 4.0
#: The prose (0 to 1) that an element needs at least, and what is needed more times its squared share in chrome.
LEAST_PROSE, MORE_PROSE = 0.2, 4.0
#: Words of a fragment, and salted parts that a frequent fragment's occurrences are joined in.
WORDS, SALTS = 3, 16
#: Headings from which on a page with no other content and at least as many links can be an index.
TEASERS = 3

_DIGITS = re.compile(r"\d+")
_PUNCTUATION = ".,;:!?…"
_SENTENCES = re.compile(r"[.!?…:;|·—–/]+(?:\s+|$)|\n+")


def site_name(site: str | None) -> str:
    """The speaking part of a host name."""
    host = re.sub(r"^www\.", "", (site or "").lower()).split(".")[0]
    return re.sub(r"[-_]?\d+$", "", host)


def template(text: str, site: str | None) -> str:
    """The text without what differs from page to page: site name, numbers, case, spacing, look-alikes."""
    form = " ".join(canonical(text).split()).lower()
    name = site_name(site)
    return _DIGITS.sub("#", form.replace(name, "§") if len(name) > 2 else form)


def fragments(form: str) -> list[str]:
    """The different leaves of a template: the first and last words of its sentences, short sentences whole."""
    out: dict[str, None] = {}
    for sentence in _SENTENCES.split(form):
        words = sentence.split()
        if len(words) > WORDS:
            out["^" + " ".join(words[:WORDS])] = out[" ".join(words[-WORDS:]) + "$"] = None
        elif words:
            out[" ".join(words)] = None
    return list(out)


_FEATURES = pa.schema([("k", pa.int64()), ("page_id", pa.int64()), ("region_ord", pa.int32()), ("el_ord", pa.int32()), ("role", pa.string()), ("received", pa.timestamp("us", tz="UTC")), ("template", pa.binary()), ("fragments", pa.list_(pa.int64())), ("length", pa.int32()), ("punctuation", pa.int32()), ("excluded", pa.bool_()), ("message", pa.bool_())])
_FEATURES_DDL = "k bigint, page_id bigint, region_ord int, el_ord int, role string, received timestamp, template binary, fragments array<bigint>, length int, punctuation int, excluded boolean, message boolean"


def _digest(form: str) -> bytes:
    return hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=12).digest()


def _number(fragment: str) -> int:
    return xxhash.xxh3_64_intdigest(fragment.encode("utf-8", "surrogatepass")) - (1 << 63)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[tuple, tuple] = {}
        rows = []
        for text, site in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist()):
            if (text, site) not in known:
                form = template(text, site)
                kind = residue(text.strip()) if form else None
                known[text, site] = (_digest(form), list(map(_number, fragments(form))), len(form), sum(map(form.count, _PUNCTUATION)), not form or kind is not None, kind in MESSAGES)
            rows.append(known[text, site])
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], *(pa.array(c, f.type) for c, f in zip(columns, list(_FEATURES)[6:]))], schema=_FEATURES)


def content_scores(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """(element_key, page_id, role, chrome_share, path_ratio, score, excluded, message, template) of text elements.

    ``score`` above 0.5 means content by paths: the mean of the element's own text, that of the
    elements beside it and the ratio of text to chrome of its path of roles is more than what the
    element's share in chrome asks for (nearly nothing for a small share). That share is the mean over
    the element's fragments of their smoothed share of other occurrences in chrome regions; the
    element's own is left out, as its region may be wrong. ``excluded`` is template residue, ``message``
    an error message or script notice. Redelivered rows of a page count once (the last), elements without
    text, key or page not at all; an element without a region, or in one of an unknown role, has the region
    role 'other'. Look-alike characters make no difference.
    """
    received = F.col("received_at").cast("timestamp") if "received_at" in elements.columns else F.lit(None).cast("timestamp")
    rows = elements.filter(F.col("role").isin(*ROLES) & F.col("element_key").isNotNull() & F.col("page_id").isNotNull() & (F.trim("text") != ""))
    rows = rows.select(F.col("element_key").cast("bigint"), F.col("page_id").cast("bigint"), F.coalesce(F.col("region_ord").cast("int"), F.lit(-1)), F.coalesce(F.col("el_ord").cast("int"), F.lit(-1)), "role", received, "text", "site")
    # a page's rows come together at once: what follows, the removal of repeated ones included, needs no other shuffle of them
    slim = latest(rows.mapInArrow(_features, _FEATURES_DDL).repartition("page_id"), ["page_id", "k"], ["received"]).drop("received")
    slots = regions.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("region_ord").cast("int").alias("region_ord"), F.col("role").alias("region_role")).filter("page_id is not null").repartition("page_id")
    roles = slots.groupBy("page_id", "region_ord").agg(F.min("region_role").alias("region_role"))
    placed = slim.join(roles, ["page_id", "region_ord"], "left").withColumn("region_role", F.when(F.col("region_role").isin(*REGION_ROLES), F.col("region_role")).otherwise("other"))
    # three passes read these features: texts are taken apart once
    placed = cut(placed)
    chrome = F.col("region_role").isin(*CHROME_REGIONS).cast("int")
    # per fragment: seen, and in chrome regions, counted on the map side first; those never in chrome have no share
    each = placed.select("page_id", "k", chrome.alias("own"), F.explode("fragments").alias("fragment"))
    seen = each.groupBy("fragment").agg(F.count("*").alias("seen"), F.sum("own").alias("in_chrome")).filter("in_chrome > 0")
    seen = seen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = each.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).join(seen, ["fragment", "salt"])
    hits = hits.select("page_id", "k", ((F.col("in_chrome") - F.col("own")) / (F.col("seen") - 1 + F.lit(PRIOR))).alias("share")).repartition("page_id")
    hits = hits.groupBy("page_id", "k").agg(F.sum("share").alias("shares"))
    share = F.when(F.size("fragments") > 0, F.coalesce("shares", F.lit(0.0)) / F.size("fragments")).otherwise(0.0)
    scored = placed.join(hits, ["page_id", "k"], "left").withColumn("chrome_share", share)
    # per path of roles: text and punctuation outside chrome against a short menu entry, smoothed; a table of 9 x 5 rows
    paths = scored.groupBy("region_role", "role").agg(F.avg((F.log1p("length") + F.col("punctuation")) * (1 - F.col("chrome_share"))).alias("density"), F.count("*").alias("n"))
    ratio = (F.col("density") * F.col("n") + 4.0 * PRIOR) / ((F.col("n") + PRIOR) * 8.0)
    scored = scored.join(F.broadcast(paths.select("region_role", "role", F.least(ratio, F.lit(1.0)).alias("path_ratio"))), ["region_role", "role"])
    own = F.least(F.lit(1.0), (F.log1p("length") + F.col("punctuation")) / 8.0)
    beside = F.avg(own * (1 - F.col("chrome_share"))).over(Window.partitionBy("page_id").orderBy("region_ord", "el_ord", "k").rowsBetween(-2, 2))
    prose = (F.col("path_ratio") + own + beside) / 3
    score = 0.5 + (prose - LEAST_PROSE - MORE_PROSE * F.col("chrome_share") ** 2) / 2
    return scored.select(F.col("k").alias("element_key"), "page_id", "role", "chrome_share", "path_ratio", score.alias("score"), "excluded", "message", "template")


_TITLE_PARTS = re.compile(r"\s+[|/–—-]\s+")


def _titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, own) with the templates of a title and of its parts up to each separator: one that a heading which repeats it has."""
    for batch in batches:
        own = []
        for title, site in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            ends = [*(m.start() for m in _TITLE_PARTS.finditer(title)), len(title)]
            own.append(list({_digest(template(title[:end], site)) for end in ends}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.binary()))], names=["page_id", "own"])


def judged(elements: DataFrame, regions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``content_scores`` with ``content``: by score, no residue, and on a page that has a main body.

    Pages whose only content are headings have none if an error message or script notice stands
    beside them, or if they are an index: ``TEASERS`` headings or more, none of which repeats the
    page's title, and at least as many links. Without ``pages`` no title is known. A title that is
    residue says nothing about the body: articles have such titles, too.
    """
    scored = content_scores(elements, regions).withColumn("content", (F.col("score") > 0.5) & ~F.col("excluded"))
    links = elements.filter("role = 'link' and page_id is not null and element_key is not null").groupBy(F.col("page_id").cast("bigint").alias("page_id")).agg(F.count_distinct("element_key").alias("links"))
    scored = scored.join(links, "page_id", "left")
    if pages is None:
        scored = scored.withColumn("own", F.lit(None).cast("array<binary>"))
    else:
        received = ["received_at"] if "received_at" in pages.columns else []
        titled = latest(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "title", "site", *received).filter("page_id is not null"), ["page_id"], received).filter(F.trim("title") != "")
        scored = scored.join(titled.select("page_id", "title", "site").mapInArrow(_titles, "page_id bigint, own array<binary>"), "page_id", "left")
    # pages are whole in their partitions already: the sums need no further shuffle and no second pass
    page, content, heading = Window.partitionBy("page_id"), F.col("content"), F.col("role") == "heading"
    headline = heading & content & F.coalesce(F.array_contains("own", F.col("template")), F.lit(False))
    of = {"prose": F.count_if(content & ~heading), "headings": F.count_if(content & heading), "messages": F.count_if("message"), "headlines": F.count_if(headline)}
    scored = scored.withColumns({n: c.over(page) for n, c in of.items()})
    index = (F.col("headings") >= TEASERS) & (F.col("headlines") == 0) & (F.coalesce("links", F.lit(0)) >= F.col("headings"))
    void = (F.col("prose") == 0) & ((F.col("messages") > 0) | index)
    return scored.withColumn("content", content & ~void).drop("links", "own", *of)


def main_content(elements: DataFrame, regions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(element_key) of the elements that are their page's own content."""
    return judged(elements, regions, pages).filter("content").select("element_key")
