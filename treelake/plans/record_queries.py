"""Queries over nested records, session snapshots and feeds: (session, folder) -> DataFrame."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.operators import drift, nested, snapshots
from treelake.session import checkpoint_dir
from treelake.sources.tables import table

#: Types of the measurement feed's fields, under their first names.
MEASUREMENT = {
    "schema_version": "string", "recorded_at_unix_ms": "bigint", "source_id": "string", "operation": "string", "representation": "string", "url_sha256": "string", "selector": "string",
    "source_html_bytes": "bigint", "delivered_bytes": "bigint", "bytes_not_delivered": "bigint", "cache_restored": "boolean",
}

#: Types of the fields added to it later.
ADDED = {
    "engine_build": "string", "tool_name": "string", "region_count": "bigint", "delivered_tokens": "bigint", "retry_count": "bigint", "truncated": "boolean", "http_status": "bigint", "page_lang": "string", "session_ref": "string",
}
#: Types of the page-tree feed's fields of one value a line, and of those with a value per region or element.
PAGE_TREE = {
    "som_version": "string", "url": "string", "title": "string", "lang": "string", "compiled_by": "string",
    "meta.html_bytes": "bigint", "meta.som_bytes": "bigint", "meta.source_bytes": "bigint", "meta.element_count": "bigint", "meta.interactive_count": "bigint",
}
_ELEMENT = {
    "id": "string", "role": "string", "text": "string", "attrs.href": "string", "attrs.src": "string", "attrs.rel": "string", "attrs.target": "string", "attrs.input_type": "string", "attrs.placeholder": "string", "attrs.section_label": "string",
    "attrs.level": "bigint", "attrs.maxlength": "bigint", "attrs.tabindex": "bigint", "attrs.width": "bigint", "attrs.required": "boolean", "attrs.draggable": "boolean", "attrs.spellcheck": "boolean",
}
REPEATED = {"regions[].id": "string", "regions[].role": "string", "regions[].label": "string", **{f"regions[].elements[].{f}": t for f, t in _ELEMENT.items()}}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.emit_nodes(table(spark, d, "som_records"), payloads=False)
    return nodes.select(F.col("record_key").alias("record_id"), "node_ord", "parent_ord", "kind")


def p2_elements(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of elements with its parent links."""
    return nested.typed(nested.emit_nodes(table(spark, d, "som_records"), payloads=["elements"]), "elements")


def p2_options(spark: SparkSession, d: str) -> DataFrame:
    return nested.typed(nested.emit_nodes(table(spark, d, "som_records"), payloads=["options"]), "options")


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """All related tables out of one pass: written by tag into the shared folder, each read back with its own schema."""
    folder = f"{checkpoint_dir(spark)}/tagged-{uuid.uuid4().hex}"
    nested.write_tagged(nested.emit_nodes(table(spark, d, "som_records")), folder)
    common = ("id", "role", "text", "value")
    tables = []
    for tag in nested.SCHEMAS:
        rows = nested.read_typed(spark, folder, tag)
        tables.append(rows.select(F.col("record_key").alias("record_id"), "node_ord", "parent_ord", F.lit(tag).alias("tag"), "kind", *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in common)))
    return functools.reduce(DataFrame.unionByName, tables)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.session_changes(table(spark, d, "session_snapshots"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "feed_lines"))


def _feed_values(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "feed_lines")
    return drift.consistent_values(drift.path_values(lines), drift.schema_changes(lines))


def p7_measurements(spark: SparkSession, d: str) -> DataFrame:
    """One consistent table of all feeds, a row per readable line; fields of arrays are arrays, and what has no column of its own is in ``others``, with its place."""
    return drift.project(_feed_values(spark, d), MEASUREMENT | ADDED | PAGE_TREE | REPEATED, rest=True)


def p7_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    """Failed casts of all fields of all feeds, those under arrays and those without a type (strings) included."""
    return drift.failed_casts(_feed_values(spark, d), MEASUREMENT | ADDED | PAGE_TREE | REPEATED, rest=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_elements, p2_options, p2_tables, p4_found, p7_found, p7_measurements, p7_failed_casts)}


def oracle_sql() -> dict[str, str]:
    """None: these read JSON of any depth and writing; tests compare them with brute force."""
    return {}
