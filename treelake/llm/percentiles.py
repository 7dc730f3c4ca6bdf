"""Percentiles per group from centroid digests that combine across partitions and days.

Values are clustered in sorted order under a size function that is fine at both ends; digests merge by
clustering their centroids again. A second pass counts the values below and at each estimate, so the
reported rank error is a fact, not a promise. A group has digests of several levels: of each day, of each
part (a source, say), and of all its days together, which is merged from those of the days.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.session import cut

#: Size parameter: a digest has at most about so many centroids, and rank errors of about pi * sqrt(q * (1 - q)) / COMPRESSION at most.
COMPRESSION = 200
#: Digests of one group are merged in so many heaps first, so that no task holds all of a hot group.
HEAPS = 32
#: Values and centroids of all groups that a task holds before it clusters them, and digests it holds before it gives them out.
BUFFER, MOST_HELD = 200_000, 20_000
#: Digests whose estimates are broadcast for counting (under 200 bytes each); with more, values and estimates are shuffled, hot groups in so many salted parts.
MOST_BROADCAST, SALTS = 100_000, 64
#: Levels of digests; a value's own day or part, and '' for all, is the digest's part.
LEVELS = ("day", "part", "all")

KEYS = ["metric", "grp", "level", "part"]
DIGEST = "metric string, grp string, level string, part string, n bigint, low double, high double, means array<double>, weights array<double>"
_ARROW = pa.schema([*((k, pa.string()) for k in KEYS), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("means", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64()))])


def cluster(means: np.ndarray, weights: np.ndarray, groups: np.ndarray | None = None, compression: int = COMPRESSION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, weights, groups) of weighted values, each group for itself: sorted, and joined while they fall into one step of the size function."""
    groups = np.zeros(len(means), np.int64) if groups is None else groups
    if not len(means):
        return means, weights, groups
    order = np.lexsort((means, groups))
    means, weights, groups = means[order], weights[order], groups[order]
    begins = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    place = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(groups)]))
    totals = np.add.reduceat(weights, begins)
    # ranks by group: sums start anew, so a group's centroids don't depend on what is beside it
    upto = np.cumsum(weights)
    middle = (upto - (upto[begins] - weights[begins])[place] - weights / 2) / totals[place]
    step = np.floor(compression * (np.arcsin(2 * np.clip(middle, 0, 1) - 1) / np.pi + 0.5)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (step[1:] != step[:-1]) | (place[1:] != place[:-1])])
    joined = np.add.reduceat(weights, starts)
    return np.add.reduceat(means * weights, starts) / joined, joined, groups[starts]


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """The value at rank ``q * n``, between the middles of centroids, exact at both ends."""
    total = float(weights.sum())
    middles = np.cumsum(weights) - weights / 2
    points = np.r_[0.0, middles, total]
    values = np.r_[low, np.clip(means, low, high), high]
    return float(np.interp(q * total, points, values))


class _Digests:
    """Digests of many groups under way: flat arrays of centroids and codes, so that groups are clustered together."""

    def __init__(self):
        self.codes: dict[tuple, int] = {}
        self.arrays: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.n, self.low, self.high = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def code(self, keys: list[tuple]) -> np.ndarray:
        codes = np.array([self.codes.setdefault(k, len(self.codes)) for k in keys], np.int64)
        if (more := len(self.codes) - len(self.n)) > 0:
            self.n, self.low, self.high = np.r_[self.n, np.zeros(more, np.int64)], np.r_[self.low, np.full(more, np.inf)], np.r_[self.high, np.full(more, -np.inf)]
        return codes

    def add(self, codes: np.ndarray, means: np.ndarray, weights: np.ndarray) -> None:
        self.arrays.append((means, weights, codes))
        self.size += len(means)
        if self.size >= BUFFER:
            self.settle()

    def settle(self) -> None:
        if len(self.arrays) > 1 or self.arrays and self.size >= BUFFER:
            self.arrays = [cluster(*(np.concatenate(x) for x in zip(*self.arrays)))]
            # never below half the buffer: with more centroids than that they are clustered when they have doubled
            self.size = min(len(self.arrays[0][0]), BUFFER // 2)

    def batch(self) -> pa.RecordBatch:
        """All digests, and a clean start."""
        means, weights, codes = cluster(*(np.concatenate(x) for x in zip(*self.arrays))) if self.arrays else (np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
        keys = list(self.codes)
        offsets = pa.array(np.searchsorted(codes, np.arange(len(keys) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.float64())) for x in (means, weights)]
        columns = [*(pa.array([k[i] for k in keys], pa.string()) for i in range(len(KEYS))), pa.array(self.n), pa.array(self.low), pa.array(self.high), *lists]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _codes_of(batch: pa.RecordBatch, names: list[str]) -> tuple[list[tuple], np.ndarray]:
    """The different keys of a batch and each row's place among them."""
    parts = [batch.column(batch.schema.get_field_index(k)).dictionary_encode() for k in names]
    flat = np.zeros(batch.num_rows, np.int64)
    for p in parts:
        flat = flat * (len(p.dictionary) + 1) + p.indices.to_numpy(zero_copy_only=False)
    _, first, place = np.unique(flat, return_index=True, return_inverse=True)
    columns = [[p.dictionary[i.as_py()].as_py() for i in p.indices.take(pa.array(first))] for p in parts]
    return list(zip(*columns)), place


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of values by day and by part: rows (metric, grp, day, part, value)."""
    held = _Digests()
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
        for level in ("day", "part") if batch.column(3).null_count < batch.num_rows else ("day",):
            keys, place = _codes_of(batch, ["metric", "grp", level])
            codes = held.code([(m, g, level, p) for m, g, p in keys])
            own = codes[place]
            np.add.at(held.n, own, 1)
            np.minimum.at(held.low, own, values)
            np.maximum.at(held.high, own, values)
            held.add(own, values, np.ones(len(values)))
        if len(held.codes) > MOST_HELD:
            yield held.batch()
    yield held.batch()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows with equal keys; rows are sorted, so all but the last key are complete."""
    held, last = _Digests(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        if len(held.codes) > MOST_HELD and (batch.column(0)[0], batch.column(1)[0], batch.column(2)[0], batch.column(3)[0], batch.column(4)[0]) != last:
            yield held.batch()
        # the heap tells runs apart where one key has several
        keys, place = _codes_of(batch, [*KEYS, "heap"])
        own = held.code(keys)[place]
        names = batch.schema.names
        n, low, high = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("n", "low", "high"))
        np.add.at(held.n, own, n)
        np.minimum.at(held.low, own, low)
        np.maximum.at(held.high, own, high)
        means, weights = batch.column(names.index("means")), batch.column(names.index("weights"))
        sizes = np.diff(means.offsets.to_numpy())
        held.add(np.repeat(own, sizes), means.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False))
        last = tuple(batch.column(i)[batch.num_rows - 1] for i in range(5))
    yield held.batch()


def _clean(values: DataFrame) -> DataFrame:
    part = F.coalesce(F.col("part").cast("string"), F.lit("")) if "part" in values.columns else F.lit(None).cast("string")
    clean = values.select("metric", F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"), F.coalesce(F.col("day").cast("date").cast("string"), F.lit("")).alias("day"), part.alias("part"), F.col("value").cast("double").alias("value"))
    return clean.filter("metric is not null and value is not null and not isnan(value) and abs(value) < double('inf')")


def digests(values: DataFrame) -> DataFrame:
    """Digests (``DIGEST``) per metric, group and day, and per metric, group and part, of each task: rows (metric, grp, day, value) and, where there is one, part.

    Rows with a null metric, and null, NaN and infinite values are left out; a null group, day or
    part is ''. Without a column part there is no level part. Nothing is shuffled; other columns make no difference.
    """
    return _clean(values).mapInArrow(_build, DIGEST)


def merge(parts: DataFrame) -> DataFrame:
    """Digests with equal keys combined, in heaps first; any digests, of other days or runs, can be combined."""

    def merged(rows: DataFrame, heap: Column) -> DataFrame:
        # equal keys come to one task in sorted runs and stream through: no frame is built per group
        keyed = rows.select(*KEYS, heap.alias("heap"), "n", "low", "high", "means", "weights").repartition(*KEYS, "heap").sortWithinPartitions(*KEYS, "heap")
        return keyed.mapInArrow(_merge, DIGEST)

    return merged(merged(parts, F.pmod(F.xxhash64("n", "low", "high", F.size("means"), F.element_at("means", 1)), F.lit(HEAPS)).cast("string")), F.lit("0"))


def whole(daily: DataFrame) -> DataFrame:
    """The digests of all days together, from those of the days."""
    return merge(daily.filter("level = 'day'").withColumn("level", F.lit("all")).withColumn("part", F.lit("")))


def estimates(merged: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(metric, grp, level, part, n, q, estimate) of merged digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                means, weights = np.array(r["means"]), np.array(r["weights"])
                rows += [(*(r[k] for k in KEYS), r["n"], q, quantile(means, weights, r["low"], r["high"], q)) for q in quantiles]
            kinds = [*[pa.string()] * len(KEYS), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*KEYS, "n", "q", "estimate"])

    return merged.mapInArrow(read, "metric string, grp string, level string, part string, n bigint, q double, estimate double")


def certify(values: DataFrame, estimated: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """``estimated`` (of ``quantiles``, in rising order) with the counted ranks: below, at_most, and rank_error as a share of n.

    The second pass counts, per estimate, the values below and at or below it; the error is the
    distance of q from that range of ranks. Estimates of up to ``MOST_BROADCAST`` digests go to the
    values, which are then counted where they lie; with more, both sides are shuffled with a salt, so
    that a hot group is counted in parts. Either way partial counts are added up.
    """
    marks = estimated.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("q", "estimate", "n"))).alias("marks"))
    of = {"day": F.col("day"), "part": F.col("part"), "all": F.lit("")}
    own = F.array(*(F.struct(F.lit(level).alias("level"), of[level].alias("part")) for level in LEVELS if level != "part" or "part" in values.columns))
    rows = _clean(values).select("metric", "grp", "value", F.explode(own).alias("x")).select("metric", "grp", "x.level", "x.part", "value")
    if marks.count() <= MOST_BROADCAST:
        keys, joined = KEYS, rows.join(F.broadcast(marks), KEYS)
    else:
        keys = [*KEYS, "salt"]
        salted = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), keys)
    counts = [f(F.col("value"), F.col("marks")[i]["estimate"]).alias(f"{name}{i}") for i in range(len(quantiles)) for name, f in (("b", lambda v, e: F.count_if(v < e)), ("a", lambda v, e: F.count_if(v <= e)))]
    counted = joined.groupBy(*KEYS).agg(*counts)
    each = F.explode(F.arrays_zip(F.array(*(F.lit(q) for q in quantiles)).alias("q"), F.array(*(F.col(f"b{i}") for i in range(len(quantiles)))).alias("below"), F.array(*(F.col(f"a{i}") for i in range(len(quantiles)))).alias("at_most")))
    flat = counted.select(*KEYS, each.alias("c")).select(*KEYS, F.col("c.q").alias("q"), F.col("c.below").alias("below"), F.col("c.at_most").alias("at_most"))
    low, high = F.col("below") / F.col("n"), F.col("at_most") / F.col("n")
    error = F.greatest(F.lit(0.0), low - F.col("q"), F.col("q") - high)
    return flat.join(estimated, [*KEYS, "q"]).select(*KEYS, "q", "estimate", "n", "below", "at_most", error.alias("rank_error"))


def percentiles(values: DataFrame, quantiles: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """(metric, grp, level, part, q, estimate, n, below, at_most, rank_error): of each group by day, by part and in all, certified.

    ``level`` is day (``part`` the date), part or all (``part`` is ''). An empty table gives no rows.
    """
    kept = cut(merge(digests(values)))
    merged = cut(kept.unionByName(whole(kept)))
    wanted = sorted(set(quantiles))
    return certify(values, estimates(merged, wanted), wanted)


def metric(rows: DataFrame, name: str, grp: Column, day: Column, value: Column, part: Column | None = None) -> DataFrame:
    """Rows of one metric: (metric, grp, day, value) and, where there is one, part."""
    parts = [] if part is None else [part.cast("string").alias("part")]
    return rows.select(F.lit(name).alias("metric"), grp.cast("string").alias("grp"), day.cast("date").alias("day"), *parts, value.cast("double").alias("value"))
