"""Readers of page sources, tree files and url lists, and bounded decoding of bodies."""

from __future__ import annotations

import gzip
import io
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from treelake.operators.nested import emit_nodes

MOST_DECODED = 16 * 1024 * 1024


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of a folder of HTML files, one row a file."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, url) of a text file: blanks and comments left out, file order kept in line_no."""
    rows = spark.read.text(path).select(F.trim("value").alias("url"), F.monotonically_increasing_id().alias("line_no"))
    return rows.filter("url <> '' and not startswith(url, '#')").select("line_no", "url")


def tree_files(spark: SparkSession, path: str) -> DataFrame:
    """Tagged node rows of a folder of tree JSON files; keys are digests of the file names."""
    rows = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("record_id"), F.col("value").alias("som_json"))
    return emit_nodes(rows)


def decode_body(wire: bytes, encoding: str | None, most: int = MOST_DECODED) -> bytes | None:
    """A body as sent, decoded; None where it is broken, of an unknown encoding, or too large."""
    kind = (encoding or "identity").strip().lower()
    try:
        if kind in ("", "identity"):
            out = wire
        elif kind in ("gzip", "x-gzip"):
            out = gzip.GzipFile(fileobj=io.BytesIO(wire)).read(most + 1)
        elif kind == "deflate":
            out = zlib.decompressobj().decompress(wire, most + 1) if wire[:1] == b"\x78" else zlib.decompressobj(-15).decompress(wire, most + 1)
        else:
            return None
    except (OSError, EOFError, zlib.error):
        return None
    return out if len(out) <= most else None


@F.pandas_udf(BinaryType())
def decoded(wire: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else decode_body(w, e) for w, e in zip(wire, encoding)])
