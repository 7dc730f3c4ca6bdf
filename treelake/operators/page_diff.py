"""Differences of two captures of a page: regions by id, then elements by id inside matched regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: what counts as a price.
PRICE = r"[$€£¥]\s*[\d,]+\.?\d*"


def captures(pages: DataFrame) -> DataFrame:
    """(pair_id, old_page, new_page): each capture of a url with the one before; pair_id is the newer page."""
    by = Window.partitionBy("url").orderBy("captured_at", "page_id")
    rows = pages.select("url", "page_id", F.lag("page_id").over(by).alias("old_page"))
    return rows.filter("old_page is not null and url is not null").select(F.col("page_id").alias("pair_id"), "old_page", F.col("page_id").alias("new_page"))


def _last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of several rows with one id the last in order, as the lookup keeps it."""
    others = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("x")).select(*keys, "x.*")


def _sides(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    old = rows.join(pairs.select("pair_id", F.col("old_page").alias("page_id")), "page_id").drop("page_id")
    new = rows.join(pairs.select("pair_id", F.col("new_page").alias("page_id")), "page_id").drop("page_id")
    return old, new


def _joined(array: Column) -> Column:
    return F.coalesce(F.array_join(array, ","), F.lit(""))


def region_changes(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, region_id, change, was_main): added, removed, modified (role or label) or same regions."""
    slim = _last(regions.select("page_id", "region_ord", "region_id", "role", "label"), ["page_id", "region_id"], "region_ord")
    old, new = _sides(slim.withColumn("there", F.lit(True)), pairs)
    both = old.alias("o").join(new.alias("n"), ["pair_id", "region_id"], "full")
    differs = ~F.col("o.role").eqNullSafe(F.col("n.role")) | ~F.col("o.label").eqNullSafe(F.col("n.label"))
    change = F.when(F.col("o.there").isNull(), "added").when(F.col("n.there").isNull(), "removed").when(differs, "modified").otherwise("same")
    main = F.coalesce(F.col("o.role") == "main", F.lit(False)) | F.coalesce(F.col("n.role") == "main", F.lit(False))
    return both.select("pair_id", "region_id", change.alias("change"), main.alias("was_main"))


def element_changes(elements: DataFrame, regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, region_id, id, change, text_changed, price) of elements inside regions both captures have.

    Compared are text, role, attributes, actions and hints; labels are not.
    """
    ids = regions.select("page_id", "region_ord", "region_id").dropDuplicates(["page_id", "region_ord"])
    placed = elements.select("page_id", "region_ord", "el_ord", "id", "role", "text", "attrs", _joined(F.col("actions")).alias("actions"), _joined(F.col("hints")).alias("hints")).join(ids, ["page_id", "region_ord"])
    slim = _last(placed.drop("region_ord"), ["page_id", "region_id", "id"], "el_ord")
    matched = region_changes(regions, pairs).filter("change in ('same', 'modified')").select("pair_id", "region_id", "was_main")
    old, new = (side.join(matched, ["pair_id", "region_id"]).withColumn("there", F.lit(True)) for side in _sides(slim, pairs))
    both = old.alias("o").join(new.alias("n"), ["pair_id", "region_id", "id"], "full")
    text_changed = ~F.col("o.text").eqNullSafe(F.col("n.text"))
    other = [~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("role", "attrs", "actions", "hints")]
    change = F.when(F.col("o.there").isNull(), "added").when(F.col("n.there").isNull(), "removed").when(text_changed | other[0] | other[1] | other[2] | other[3], "modified").otherwise("same")
    price = F.coalesce(F.col("o.text").rlike(PRICE), F.lit(False)) | F.coalesce(F.col("n.text").rlike(PRICE), F.lit(False))
    return both.select("pair_id", "region_id", "id", change.alias("change"), (text_changed & (change == "modified")).alias("text_changed"), price.alias("price"), F.coalesce("o.was_main", "n.was_main").alias("was_main")).filter("change <> 'same'")


def attribute_changes(elements: DataFrame, regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, region_id, id, attribute, old_value, new_value): attributes of elements of both captures that came, went or differ.

    An element is one of the same id in a region of the same id; of several the last counts. attrs
    that are no object have no attributes; null ids are no elements.
    """
    ids = regions.select("page_id", "region_ord", "region_id").filter("region_id is not null").dropDuplicates(["page_id", "region_ord"])
    captured = pairs.select(F.col("old_page").alias("page_id")).union(pairs.select("new_page")).distinct()
    rows = elements.select("page_id", "region_ord", "el_ord", "id", "attrs").join(captured, "page_id", "left_semi").join(ids, ["page_id", "region_ord"]).filter("id is not null")
    attrs = F.when(F.startswith(F.ltrim("attrs"), F.lit("{")), F.from_json("attrs", "map<string,string>"))
    slim = _last(rows.select("page_id", "region_id", "id", "el_ord", "attrs"), ["page_id", "region_id", "id"], "el_ord").withColumn("m", attrs)
    old, new = _sides(slim, pairs)
    both = old.select("pair_id", "region_id", "id", F.col("m").alias("o")).join(new.select("pair_id", "region_id", "id", F.col("m").alias("n")), ["pair_id", "region_id", "id"])
    none = F.array().cast("array<string>")
    names = F.array_union(F.coalesce(F.map_keys("o"), none), F.coalesce(F.map_keys("n"), none))
    each = both.select("pair_id", "region_id", "id", F.explode(names).alias("attribute"), "o", "n").select("pair_id", "region_id", "id", "attribute", F.col("o")[F.col("attribute")].alias("old_value"), F.col("n")[F.col("attribute")].alias("new_value"))
    return each.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def replay_targets(targets: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(pair_id, keys, matches, outcome) of each different target of the old capture: how many of the new one have its keys.

    ``targets`` (page_id, keys) are rows of action targets; outcome is missing, found (one) or
    ambiguous. Null keys match nothing.
    """
    old, new = _sides(targets.select("page_id", *keys), pairs)
    counted = new.groupBy("pair_id", *keys).agg(F.count("*").alias("matches"))
    rows = old.distinct().join(counted, ["pair_id", *keys], "left").na.fill(0, ["matches"])
    return rows.withColumn("outcome", F.when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "found").otherwise("ambiguous"))


def summary(elements: DataFrame, regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts and flags of each pair; pairs without any change have zeros.

    Elements of added and removed regions aren't counted. A region whose role or label changed
    counts as one more change.
    """
    by_region = region_changes(regions, pairs).groupBy("pair_id").agg(*(F.count_if(F.col("change") == c).alias(f"regions_{c}") for c in ("added", "removed", "modified")))
    by_element = element_changes(elements, regions, pairs).groupBy("pair_id").agg(
        *(F.count_if(F.col("change") == c).alias(f"elements_{c}") for c in ("added", "removed", "modified")),
        F.max(F.col("text_changed") & F.col("price")).alias("has_price_changes"),
        F.max(F.col("text_changed") & F.col("was_main")).alias("has_content_changes"),
    )
    rows = pairs.select("pair_id").join(by_region, "pair_id", "left").join(by_element, "pair_id", "left")
    counts = [f"{k}_{c}" for k in ("regions", "elements") for c in ("added", "removed", "modified")]
    rows = rows.na.fill(0, counts).na.fill(False, ["has_price_changes", "has_content_changes"])
    total = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    structural = sum((F.col(f"{k}_{c}") for k in ("regions", "elements") for c in ("added", "removed")), F.lit(0)) > 0
    return rows.select("pair_id", *counts, total.alias("total_changes"), "has_price_changes", "has_content_changes", structural.alias("has_structural_changes"))


def richer(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, page_id, from_old): of two captures the one to keep: the older only if it has strictly more elements.

    A capture whose count is null counts as having none.
    """
    counts = pages.select("page_id", F.coalesce("element_count", F.lit(0)).alias("n"))
    rows = pairs.join(counts.select(F.col("page_id").alias("old_page"), F.col("n").alias("old_n")), "old_page").join(counts.select(F.col("page_id").alias("new_page"), F.col("n").alias("new_n")), "new_page")
    older = F.col("old_n") > F.col("new_n")
    return rows.select("pair_id", F.when(older, F.col("old_page")).otherwise(F.col("new_page")).alias("page_id"), older.alias("from_old"))
