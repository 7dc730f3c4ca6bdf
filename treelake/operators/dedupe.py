"""One row per key out of redelivered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = "__delivery_rank"


def latest(df: DataFrame, keys: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """The last delivered row of each key.

    ``order`` are the columns that tell a later row from an earlier one, nulls first; remaining
    ties are broken by the other columns that can be ordered, so the result is the same in
    any partitioning. Rows with a null in a key are kept as a key of their own. Catalyst turns the
    rank filter into a group limit before the shuffle, so a hot key is reduced on the map side.
    """
    first = [F.col(o) if isinstance(o, str) else o for o in order or []]
    named = {o for o in order or [] if isinstance(o, str)} | set(keys)
    ties = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in named and f.dataType.typeName() not in ("map", "variant")]
    by = Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in first + ties))
    return df.withColumn(RANK, F.row_number().over(by)).filter(F.col(RANK) == 1).drop(RANK)
