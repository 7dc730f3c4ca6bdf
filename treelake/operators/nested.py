"""Deeply nested records to related flat tables: one pass, rows tagged with their table.

A depth-first visitor walks a record once and gives, for each node, the tag of its table, its own
ordinal (primary key with the record's key), its parent's ordinal and its own fields as JSON. The
tagged rows are written partitioned by tag, and each tag is then read with its own schema.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelake.sources.payload import as_list, as_object, read_tree

TAGGED = "record_key bigint, node_ord int, parent_ord int, tag string, kind string, node string"
#: Tag (table) of each kind of node.
TAGS = {"region": "regions", "element": "elements", "child": "elements", "shadow": "elements", "option": "options", "item": "items"}
SCHEMAS = {
    "regions": "id string, role string, label string, action string, method string",
    "elements": "id string, role string, html_id string, text string, label string, actions string, hints string, attrs string, shadow_mode string",
    "options": "value string, text string, `group` string, selected string, disabled string",
    "items": "text string",
}
_HELD = ("elements", "children", "shadow")


def walk(tree: dict) -> Iterator[tuple[int, int, str, object]]:
    """(node_ord, parent_ord, kind, node) of every node in pre-order.

    A region comes before its elements; an element before its options, items, children and shadow
    elements, each with all below it. Null entries, and entries of element collections that are
    no objects, are no nodes. The walk keeps its own stack, so depth is bounded by memory only.
    """
    stack = [(-1, "region", r) for r in reversed(as_list(tree.get("regions")))]
    at = -1
    while stack:
        parent, kind, node = stack.pop()
        if node is None or not isinstance(node, dict) and kind not in ("option", "item"):
            continue
        at += 1
        yield at, parent, kind, node
        if kind in ("option", "item"):
            continue
        below = []
        if kind == "region":
            below = [(at, "element", x) for x in as_list(node.get("elements"))]
        else:
            attrs = as_object(node.get("attrs"))
            attrs = attrs if isinstance(attrs, dict) else {}
            below += [(at, "option", x) for x in as_list(attrs.get("options"))]
            below += [(at, "item", x) for x in as_list(attrs.get("items"))]
            below += [(at, "child", x) for x in as_list(node.get("children"))]
            shadow = as_object(node.get("shadow"))
            below += [(at, "shadow", x) for x in as_list(shadow.get("elements") if isinstance(shadow, dict) else shadow)]
        stack.extend(reversed(below))


def _payload(node: object, kind: str) -> str:
    if not isinstance(node, dict):
        node = {"text": node if isinstance(node, str) else json.dumps(node, ensure_ascii=False)}
    own = {k: v for k, v in node.items() if k not in _HELD and v is not None}
    if kind not in ("region", "option", "item") and isinstance(node.get("shadow"), dict):
        own["shadow_mode"] = node["shadow"].get("mode")
    return json.dumps({k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in own.items()}, ensure_ascii=False)


_NODE = pa.struct([("parent_ord", pa.int32()), ("kind", pa.string()), ("node", pa.string())])
_NODES_DDL = "k bigint, r timestamp, t binary, nodes array<struct<parent_ord:int,kind:string,node:string>>"


def _emitter(payloads: frozenset[str]):
    """One row per readable payload: its key, when it was received, its digest and its nodes in pre-order."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, offsets, ties = [], [0], []
            parents, kinds, nodes = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                tree = read_tree(text)
                if tree is None:
                    continue
                for _, parent, kind, node in walk(tree):
                    parents.append(parent)
                    kinds.append(kind)
                    nodes.append(_payload(node, kind) if TAGS[kind] in payloads else None)
                kept.append(row)
                offsets.append(len(parents))
                ties.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())
            flat = pa.StructArray.from_arrays([pa.array(parents, pa.int32()), pa.array(kinds, pa.string()), pa.array(nodes, pa.string())], fields=list(_NODE))
            own = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(ties, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["k", "r", "t", "nodes"])

    return emit


def emit_nodes(records: DataFrame, key: str = "record_id", payload: str = "som_json", payloads: bool | Iterable[str] = True) -> DataFrame:
    """Tagged node rows (``TAGGED``) of every readable record.

    Each payload is read once. Of several deliveries of a key the last received readable one counts
    (by ``received_at`` where the table has it, then by digest); a torn delivery never hides a whole
    one. A null or empty payload, one without a tree and a torn one give no rows, as do null keys.
    Other columns are not read. ``payloads`` are the tags whose ``node`` is wanted (True all, False
    none); it is null for others, as for queries on links only.
    """
    received = F.col("received_at").cast("timestamp") if "received_at" in records.columns else F.lit(None).cast("timestamp")
    slim = records.select(F.col(key).cast("bigint").alias("k"), received.alias("r"), F.col(payload).cast("string").alias("p")).filter("k is not null and p is not null")
    wanted = frozenset(TAGS.values() if payloads is True else payloads or ())
    read = slim.mapInArrow(_emitter(wanted), _NODES_DDL)
    by = Window.partitionBy("k").orderBy(F.col("r").desc_nulls_last(), F.col("t").desc())
    last = read.withColumn("n", F.row_number().over(by)).filter("n = 1")
    rows = last.select(F.col("k").alias("record_key"), F.posexplode("nodes").alias("node_ord", "x"))
    tag = F.element_at(F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair)), F.col("x.kind"))
    return rows.select("record_key", "node_ord", "x.parent_ord", tag.alias("tag"), "x.kind", "x.node")


def with_ancestors(nodes: DataFrame, wanted: Column) -> DataFrame:
    """The nodes that ``wanted`` keeps (``matched``) and all nodes above them; a record without any keeps all its nodes.

    Kept nodes are found record by record from the links alone: no round of joins per level.
    """
    rows = nodes.withColumn("matched", F.coalesce(wanted, F.lit(False)))
    links = F.sort_array(F.collect_list(F.struct("node_ord", "parent_ord", "matched")), asc=False)
    # from the last node to the first: children come before their parents and pass their mark up
    passed = lambda acc, x: F.when(x["matched"] | F.array_contains(acc, x["node_ord"]), F.array_union(acc, F.array(x["node_ord"], x["parent_ord"]))).otherwise(acc)
    kept = rows.groupBy("record_key").agg(F.aggregate(links, F.array().cast("array<int>"), passed).alias("kept"))
    return rows.join(kept, "record_key").filter(F.array_contains("kept", F.col("node_ord")) | (F.size("kept") == 0)).drop("kept")


def write_tagged(nodes: DataFrame, path: str) -> None:
    """The tagged rows as Parquet, one folder per tag; one pass over the records."""
    nodes.write.partitionBy("tag").mode("overwrite").parquet(path)


def typed(nodes: DataFrame, tag: str) -> DataFrame:
    """The table of one tag: keys, parent link, kind and the fields of its schema."""
    rows = nodes.filter(F.col("tag") == tag)
    return rows.select("record_key", "node_ord", "parent_ord", "kind", F.from_json("node", SCHEMAS[tag]).alias("n")).select("record_key", "node_ord", "parent_ord", "kind", "n.*")


def read_typed(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The table of one tag from written rows: only that tag's folder is read."""
    return typed(spark.read.parquet(path), tag)
