"""Scorecards over results of runs: outcomes, ratios, grades, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What blocks a page, by words of its error text.
BLOCKED = r"(?i)blocked|denied|forbidden|captcha|human|unusual traffic"
EXHAUSTED = r"(?i)heap out of memory|out of memory|memory allocation of|allocation failed|failed to reserve address space"


def failure_kind(error: Column) -> Column:
    """Class of an error text; null where there is no error."""
    low = F.lower(error)
    return (
        F.when(error.isNull() | (F.trim(error) == ""), F.lit(None).cast("string"))
        .when(low.rlike(EXHAUSTED), "resource_exhausted")
        .when(low.rlike("timeout|timed out|time-out"), "timeout")
        .when(low.rlike(r"http|\b[45]\d\d\b"), "http_error")
        .when(low.rlike("decode|parse|expecting"), "parse_error")
        .otherwise("navigation_failed")
    )


def outcome_key(error: Column) -> Column:
    """ok, blocked or failed:kind of a run by its error text."""
    return F.when(error.isNull() | (F.trim(error) == ""), "ok").when(error.rlike(BLOCKED), "blocked").otherwise(F.concat(F.lit("failed:"), failure_kind(error)))


def report(rows: DataFrame, title: str, columns: list[str]) -> DataFrame:
    """(report): a small summary as a table in Markdown, sorted by its first column."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(columns[0]).cast("string").alias("k"), cells.alias("line")))), lambda x: x["line"])
    head = [f"# {title}", "", "| " + " | ".join(c.capitalize() for c in columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return rows.agg(F.array_join(F.concat(F.array(*map(F.lit, head)), lines), "\n").alias("report"))


def grade(ratio: Column) -> Column:
    return F.when(ratio > 15, "A").when(ratio >= 8, "B").when(ratio >= 3, "C").when(ratio >= 1, "D").otherwise("F")


def ranked(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, mean and both kinds of p95 per key, without gathering a key's values in one place.

    The values are counted, so that a rank is found in the running count of distinct values: p95 is
    the value at place min(ceil(0.95 n), n - 1), bench_p95 at round(0.95 (n - 1)), both from 0; the
    median is the mean of the two middle values.
    """
    from pyspark.sql import Window

    counted = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    total = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    placed = counted.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("c")).join(total, keys)
    n = F.col("n")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("lo") <= place) & (place < F.col("hi")), F.col("v")))

    median = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), median.alias("median"), F.max(F.col("s") / n).alias("mean"), at(F.least(F.ceil(n * 0.95), n - 1)).alias("p95"), at(F.floor((n - 1) * 0.95 + 0.5)).alias("bench_p95"))


def violations(rows: DataFrame, key: str, least: dict[str, float], most: dict[str, float] | None = None) -> DataFrame:
    """(key, metric, value, bound, side): every value of a row that is under its least or over its greatest bound; null values break none."""
    bounds = [(m, b, "least") for m, b in least.items()] + [(m, b, "most") for m, b in (most or {}).items()]
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(b)).alias("bound"), F.lit(side).alias("side")) for m, b, side in bounds))
    broken = F.when(F.col("x.side") == "least", F.col("x.value") < F.col("x.bound")).otherwise(F.col("x.value") > F.col("x.bound"))
    return rows.select(key, F.explode(each).alias("x")).filter(broken).select(key, "x.*")
