"""Documents as a table of nodes, and simple selectors over it as column predicates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.html.tree import parse

NODES = "page_id bigint, node_id int, parent_id int, ord int, tag string, attrs map<string,string>, text string"
_ARROW = pa.schema([("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("ord", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            numbers: dict[int, int] = {}
            stack = [(parse(html or ""), -1, 0)]
            while stack:
                node, parent, at = stack.pop()
                number = numbers[page] = numbers.get(page, -1) + 1
                rows.append((page, number, parent, at, node.tag, list(node.attrs.items()), node.text or None))
                stack += [(c, number, i) for i, c in reversed(list(enumerate(node.children)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 7, _ARROW)], schema=_ARROW)


def dom_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every node of every page in pre-order, with its parent and place among its siblings."""
    return pages.select(F.col(key).cast("bigint"), F.col(html).cast("string")).mapInArrow(_nodes, NODES)


_PART = re.compile(r"""([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*)))?\s*\]|(\*)|([\w-]+)""")


def css(selector: str) -> Column:
    """A predicate over ``dom_nodes``: tag, .class, #id, [attr], [attr=value], *, compounds and lists of them.

    What isn't understood, such as combinators, matches nothing.
    """
    out = F.lit(False)
    for one in selector.split(","):
        match, at, one = F.lit(bool(one.strip())), 0, one.strip()
        while at < len(one):
            m = _PART.match(one, at)
            if not m:
                match = F.lit(False)
                break
            kind, name, attribute, *values, star, tag = m.groups()
            given = next((v for v in values if v is not None), None)
            if kind == "#":
                match &= F.col("attrs")["id"] == name
            elif kind == ".":
                match &= F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), name)
            elif attribute:
                match &= F.map_contains_key("attrs", attribute) if given is None else F.col("attrs")[attribute] == given
            elif tag:
                match &= F.col("tag") == tag.lower()
            elif star:
                match &= ~F.startswith("tag", F.lit("#"))
            at = m.end()
        out |= F.coalesce(match, F.lit(False))
    return out
