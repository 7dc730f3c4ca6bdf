"""What changed between full snapshots.

Rows that are equal in both snapshots are removed by EXCEPT ALL in both directions; what is left is
joined by key, old side to new side, and labelled: only new is added, only old is removed, both is
changed. Both directions run as one counted aggregate, so every row is shuffled once, in 16 bytes
beside its key, and only the rows that differ are shuffled again for the join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelake.sources.payload import as_list, as_object, read_tree


def residue(signed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``new EXCEPT ALL old`` and ``old EXCEPT ALL new`` in one pass: rows with their net count.

    ``signed`` holds the rows of both sides, ``side`` 1 for new and -1 for old. ``__net`` is how
    many more times a row is in new; rows with as many on both sides are gone. Nulls equal nulls.
    Equal rows are counted on the map side before the shuffle.
    """
    return signed.groupBy(*keys, *values).agg(F.sum(F.col("side").cast("bigint")).alias("__net")).filter("__net <> 0")


def label(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The full join by key of the two sides of ``residue``: (keys, change)."""
    sides = rows.groupBy(*keys).agg(F.max(F.col("__net") > 0).alias("n"), F.max(F.col("__net") < 0).alias("o"))
    change = F.when(F.col("n") & F.col("o"), "changed").when(F.col("n"), "added").otherwise("removed")
    return sides.select(*keys, change.alias("change"))


def diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """(keys, change) of every key whose rows differ between two snapshots of a table.

    ``values`` are the compared columns, by default all columns both sides have besides the keys;
    columns of only one side are ignored. A key given more than once is compared as a bag of rows.
    An empty side makes all keys added or removed; null keys are keys.
    """
    if values is None:
        values = [c for c in new.columns if c in old.columns and c not in keys]
    columns = [*keys, *values]
    signed = new.select(*columns, F.lit(1).alias("side")).unionByName(old.select(*columns, F.lit(-1).alias("side")))
    return label(residue(signed, keys, values), keys)


def canonical(value: object) -> object:
    """JSON value without what doesn't count: nulls and empties are absent, 1.0 is 1."""
    if isinstance(value, dict):
        kept = ((k, canonical(v)) for k, v in value.items())
        return {k: v for k, v in kept if v is not None} or None
    if isinstance(value, list):
        return [canonical(v) for v in value] if any(canonical(v) is not None for v in value) else None
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return None if value == "" else value


def elements_of(tree: dict) -> Iterator[tuple[str, str]]:
    """(element id, canonical form with its region's id) of a snapshot's elements."""
    for region in as_list(tree.get("regions")):
        if not isinstance(region, dict):
            continue
        for element in as_list(region.get("elements")):
            if isinstance(element, dict) and element.get("id") not in (None, ""):
                attrs = element.get("attrs")
                form = canonical(element | {"attrs": as_object(attrs) if isinstance(attrs, str) else attrs})
                yield str(element["id"]), json.dumps([region.get("id"), form], sort_keys=True, ensure_ascii=False)


_ELEMENT = pa.struct([("element_id", pa.string()), ("state", pa.binary())])
_STATES = "array<struct<element_id:string,state:binary>>"
_PARSED_DDL = f"session_id string, som_cursor bigint, received timestamp, tie binary, current {_STATES}, previous {_STATES}"


def _list_of(trees: list[dict | None]) -> pa.ListArray:
    """Per tree the ids and digests of its elements; null where there is no tree."""
    offsets, ids, states = [0], [], []
    for tree in trees:
        for element, form in elements_of(tree) if tree is not None else ():
            ids.append(element)
            states.append(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        offsets.append(len(ids))
    flat = pa.StructArray.from_arrays([pa.array(ids, pa.string()), pa.array(states, pa.binary())], fields=list(_ELEMENT))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([t is None for t in trees], pa.bool_()))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every delivery with a readable current state, both of its trees read once."""
    for batch in batches:
        texts, olds = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        trees = [read_tree(t) for t in texts]
        kept = [i for i, t in enumerate(trees) if t is not None]
        ties = [hashlib.blake2b(json.dumps([texts[i], olds[i]]).encode(), digest_size=8).digest() for i in kept]
        own = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i).take(own) for i in range(3)), pa.array(ties, pa.binary()), _list_of([trees[i] for i in kept]), _list_of([read_tree(olds[i]) if olds[i] else None for i in kept])],
            names=["session_id", "som_cursor", "received", "tie", "current", "previous"],
        )


def session_changes(snapshots: DataFrame) -> DataFrame:
    """(session_id, som_cursor, element_id, change) from each delivered cursor's base to its state.

    The base of a cursor is the state delivered for the cursor before; where that was never
    delivered, the row's own previous state; a row with neither is not compared. Of several
    deliveries of a cursor the last received counts (by ``received_at`` where the table has it, then
    by digest). Elements are compared by id: region id and all fields by value, without key order,
    spacing, order of elements, or absent against null or empty. Rows with a null session or cursor,
    or without a readable current state, are no deliveries. States are compared by 128-bit digests
    of their canonical form. Each tree is read once; its digests go to its own cursor and to the
    next, whose rows lie together, so that two shuffles do and no join.
    """
    received = F.col("received_at").cast("timestamp") if "received_at" in snapshots.columns else F.lit(None).cast("timestamp")
    raw = snapshots.select("session_id", F.col("som_cursor").cast("bigint").alias("som_cursor"), received.alias("received"), F.col("current_som").cast("string"), F.col("previous_som").cast("string"))
    raw = raw.filter("session_id is not null and som_cursor is not null and current_som is not null").mapInArrow(_parsed, _PARSED_DDL)
    by = Window.partitionBy("session_id", "som_cursor").orderBy(F.col("received").desc_nulls_last(), F.col("tie").desc())
    last = raw.withColumn("n", F.row_number().over(by)).filter("n = 1")
    at = F.col("som_cursor")
    roles = [("state", at, F.col("current")), ("base", at + 1, F.col("current")), ("fallback", at, F.col("previous"))]
    given = last.select("session_id", F.explode(F.array(*(F.struct(F.lit(r).alias("part"), c.alias("som_cursor"), t.alias("elements")) for r, c, t in roles))).alias("x")).select("session_id", "x.som_cursor", "x.part", "x.elements").filter("elements is not null")
    cursor = Window.partitionBy("session_id", "som_cursor")
    has = {r: F.max(F.col("part") == r).over(cursor) for r, _, _ in roles}
    given = given.withColumns({f"has_{r}": c for r, c in has.items()}).filter("has_state and (has_base or has_fallback) and not (part = 'fallback' and has_base)")
    states = given.select("session_id", "som_cursor", F.when(F.col("part") == "state", 1).otherwise(-1).alias("side"), F.explode("elements").alias("e")).select("session_id", "som_cursor", "side", "e.element_id", "e.state")
    keys = ["session_id", "som_cursor", "element_id"]
    return label(residue(states, keys, ["state"]), keys)


def patch_operations(changes: DataFrame) -> DataFrame:
    """(session_id, som_cursor, op, path): ``session_changes`` as operations of a JSON patch on the elements by id; ~ and / in ids escaped."""
    op = F.when(F.col("change") == "added", "add").when(F.col("change") == "removed", "remove").otherwise("replace")
    escaped = F.replace(F.replace(F.col("element_id"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return changes.select("session_id", "som_cursor", op.alias("op"), F.concat(F.lit("/elements/"), escaped).alias("path"))
