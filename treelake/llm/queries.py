"""Queries over the training-text operators: (session, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm import boilerplate, canonical, mixing, packing, percentiles, residue, toxicity
from treelake.operators.dedupe import latest
from treelake.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_content(table(spark, d, "som_elements"), table(spark, d, "som_regions"), table(spark, d, "som_pages")).select("element_key")


def p1_page_text(spark: SparkSession, d: str) -> DataFrame:
    """Content elements and kinds of elements left out per page."""
    scored = boilerplate.judged(table(spark, d, "som_elements"), table(spark, d, "som_regions"), table(spark, d, "som_pages"))
    return scored.groupBy("page_id").agg(F.count_if("content").alias("content_elements"), F.count_if(~F.col("content")).alias("other_elements"))


def measures(spark: SparkSession, d: str) -> DataFrame:
    """Valid values of the three measures, each row once: positive and finite ones."""
    delivered = table(spark, d, "delivery_measurements").select("measurement_id", "received_at", "recorded_at", "representation", "source_id", "delivered_bytes")
    delivered = latest(delivered.filter("measurement_id is not null"), ["measurement_id"], ["received_at"]).filter("delivered_bytes > 0")
    costs = latest(table(spark, d, "token_costs").select("cost_id", "run_date", "url", "ratio", "som_tokens").filter("cost_id is not null"), ["cost_id"])
    kind, site = F.lower(F.trim("representation")), F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)
    parts = [
        percentiles.metric(delivered, "delivered_bytes", kind, F.to_date("recorded_at"), F.col("delivered_bytes"), F.col("source_id")),
        percentiles.metric(costs.filter("ratio > 0 and not isnan(ratio)"), "ratio", F.lit("all"), F.col("run_date"), F.col("ratio"), site),
        percentiles.metric(costs.filter("som_tokens > 0"), "som_tokens", F.lit("all"), F.col("run_date"), F.col("som_tokens"), site),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each group by day, by source or site (level part) and in all, with their counted rank errors."""
    return percentiles.percentiles(measures(spark, d))


def p3_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily summaries that can be kept and combined later, with their medians."""
    daily = percentiles.merge(percentiles.digests(measures(spark, d)).filter("level = 'day'"))
    return percentiles.estimates(daily, [0.5]).select("metric", "grp", F.expr("try_cast(part as date)").alias("day"), "n", "q", "estimate")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.page_residue(table(spark, d, "som_pages"), table(spark, d, "som_elements"), table(spark, d, "token_costs")).select("table_name", "record_key")


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = residue.page_residue(table(spark, d, "som_pages"), table(spark, d, "som_elements"), table(spark, d, "token_costs"))
    return found.groupBy("table_name", "kind").agg(F.count("*").alias("records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.lookalike_pairs(table(spark, d, "som_elements"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """The canonical text of every element whose text isn't canonical."""
    rows = latest(table(spark, d, "som_elements").select("element_key", "received_at", "text").filter("element_key is not null and text <> ''"), ["element_key"], ["received_at"])
    return canonical.with_canonical(rows.select("element_key", "text"), "text").filter("canonical <> text").select("element_key", "canonical")


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_bins(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scores(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.source_rates(table(spark, d, "documents"), table(spark, d, "review_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [p1_found, p1_page_text, p3_percentiles, p3_daily, p5_found, p5_kinds, p6_found, p6_forms, p8_bins, p8_fill, p9_mix, p9_shares, p10_found, p10_scores, p10_rates]
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    """None of these can be said in SQL; tests compare them with brute force and round trips."""
    return {}
