"""Schemas that drift between files: path-value maps, path statistics by file, changes, typed projection.

Lines are read as maps of path to value with raw JSON types. Statistics of each path are added up
per batch in the reader and then per file, so what is shuffled is one short row per file, path and
task. Changes come from comparing a file's statistics with those of the feed's previous file.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.session import cut

_NUMBER = re.compile(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$")
_DIGITS = re.compile(r"\d+")
_CLASSES = [re.compile(p) for p in (r"[^\W\d_A-ZА-Я]+", r"[A-ZА-Я]+", r"\d+", r"\s+")]
#: Bins of the histogram of values (digits masked), and shape sums of strings.
BINS = 48
SHAPES = ("len", "lower", "upper", "digit", "space", "other")
SUMS = ["n_values", "n_number", "n_boolean", "n_string", "num_like", "bool_like", "true_like", "ln", "ln2", *SHAPES, *(f"h{i}" for i in range(BINS))]


def read_line(text: str | None) -> object | None:
    """The JSON object of a line, or None for null, torn and other lines."""
    if not text:
        return None
    try:
        value = json.loads(text.lstrip("﻿"))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def scalars(value: object) -> Iterator[tuple[str, object]]:
    """(path, value) of every non-null scalar: dots join keys, [] marks arrays."""
    stack = [("", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, x) for k, x in v.items())
        elif isinstance(v, list):
            stack.extend((path + "[]", x) for x in v)
        elif v is not None:
            yield path, v


def json_type(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def _add(sums: list[float], value: object) -> None:
    kind = json_type(value)
    text = value if kind == "string" else ("true" if value else "false") if kind == "boolean" else None
    sums[0] += 1
    sums[1 if kind == "number" else 2 if kind == "boolean" else 3] += 1
    if kind == "boolean" or text in ("true", "false"):
        sums[5] += 1
        sums[6] += text == "true"
        return
    if kind == "number" or _NUMBER.match(text):
        number = abs(float(value))
        number = math.log1p(number) if math.isfinite(number) else 0.0
        sums[4] += 1
        sums[7] += number
        sums[8] += number * number
        return
    lower, upper, digit, space = (len(text) - len(p.sub("", text)) for p in _CLASSES)
    for at, x in enumerate((len(text), lower, upper, digit, space, len(text) - lower - upper - digit - space)):
        sums[9 + at] += x
    sums[9 + len(SHAPES) + zlib.crc32(_DIGITS.sub("#", text).encode("utf-8", "surrogatepass")) % BINS] += 1


_STATS_DDL = "feed string, file_seq int, path string, " + ", ".join(f"{c} double" for c in SUMS)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list[float]] = defaultdict(lambda: [0.0] * len(SUMS))

    def flush() -> pa.RecordBatch:
        keys, rows = list(held), np.array(list(held.values())).reshape(-1, len(SUMS))
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string())]
        held.clear()
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(rows[:, i]) for i in range(len(SUMS)))], names=["feed", "file_seq", "path", *SUMS])

    for batch in batches:
        for feed, seq, text in zip(*(c.to_pylist() for c in batch.columns)):
            for path, value in scalars(read_line(text)):
                _add(held[feed, seq, path], value)
        if len(held) > 20_000:
            yield flush()
    yield flush()


def in_time(lines: DataFrame) -> DataFrame:
    """Lines that were not written before their file was opened; unknown times count as in time."""
    return lines.filter("feed is not null and file_seq is not null and coalesce(written_at >= opened_at, true)")


def path_statistics(lines: DataFrame) -> DataFrame:
    """One row per feed, file and path: how many values of each JSON type, and sums that describe them.

    Unreadable lines and lines written before their file was opened are left out, rows without feed
    or file_seq too. Repeated lines are counted as often as they come; no change depends on it.
    """
    rows = in_time(lines).select("feed", F.col("file_seq").cast("int").alias("file_seq"), "payload")
    return rows.mapInArrow(_statistics, _STATS_DDL).groupBy("feed", "file_seq", "path").agg(*(F.sum(c).alias(c) for c in SUMS))


def _words(path: str) -> set[str]:
    leaf = path.rsplit(".", 1)[-1]
    words = {w for w in re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", leaf).lower().replace("[]", " ").replace("_", " ").replace("-", " ").split()}
    return words | {"".join(sorted(words))} if len(words) > 1 else words


def name_likeness(a: str, b: str) -> float:
    """0 to 1: shared words of two leaf names, or one squeezed name within the other."""
    x, y = _words(a), _words(b)
    squeezed = [re.sub(r"[^a-z0-9]", "", p.rsplit(".", 1)[-1].lower()) for p in (a, b)]
    if squeezed[0] == squeezed[1]:
        return 1.0
    if min(map(len, squeezed)) >= 2 and (squeezed[0] in squeezed[1] or squeezed[1] in squeezed[0]):
        return 0.7
    return len(x & y) / max(1, min(len(x), len(y))) * 0.6


def content_likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, str]:
    """0 to 1 how much two paths' statistics look like the same content, and the kind of content.

    Numbers (written as numbers or in strings) are compared by the mean and spread of their
    logarithms, strings of few values by the share of equal values with digits masked, other
    strings by length and make-up of their characters, booleans by their share of true.
    """
    kinds = []
    for s in (a, b):
        parts = {"number": s[4], "boolean": s[5], "string": s[0] - s[4] - s[5]}
        kinds.append(max(parts, key=parts.get))
    if kinds[0] != kinds[1]:
        return 0.0, "mixed"
    if kinds[0] == "boolean":
        return 1 - abs(a[6] / a[5] - b[6] / b[5]), "boolean"
    if kinds[0] == "number":
        means, spreads = [s[7] / s[4] for s in (a, b)], [math.sqrt(max(0.0, s[8] / s[4] - (s[7] / s[4]) ** 2)) for s in (a, b)]
        scale = 0.5 + 0.7 * max(spreads)
        return math.exp(-(((means[0] - means[1]) / scale) ** 2) / 2) * math.exp(-0.4 * abs(spreads[0] - spreads[1])), "number"
    n = [s[0] - s[4] - s[5] for s in (a, b)]
    values = [s[9 + len(SHAPES) :] / m for s, m in zip((a, b), n)]
    shared = float(np.minimum(*values).sum())
    if min(float((v**2).sum()) for v in values) > 0.2:
        seen = [v > 0 for v in values]
        return max(shared, 0.6 * float((seen[0] & seen[1]).sum()) / float(min(seen[0].sum(), seen[1].sum()))), "few"
    lengths = [s[9] / m for s, m in zip((a, b), n)]
    shapes = [s[10 : 9 + len(SHAPES)] / max(1.0, s[9]) for s in (a, b)]
    alike = math.exp(-1.5 * abs(math.log(max(1, lengths[0]) / max(1, lengths[1])))) * (1 - float(abs(shapes[0] - shapes[1]).sum()) / 2)
    return max(shared, alike), "string"


def rename_score(old: str, new: str, a: np.ndarray, b: np.ndarray) -> float:
    """Above 0 where the content of ``old`` may go on under ``new``; higher is likelier."""
    name = name_likeness(old, new)
    parents = [p.rsplit(".", 1)[0] if "." in p else "" for p in (old, new)]
    if parents[0] != parents[1] and name < 1:
        return 0.0
    content, kind = content_likeness(a, b)
    if kind == "boolean" and name == 0:
        return 0.0
    least = 0.2 if kind == "boolean" else 0.35 if name >= 0.6 else 0.5
    return content + name if content >= least else 0.0


_CHANGES = pa.schema([("feed", pa.string()), ("file_seq", pa.int32()), ("field", pa.string()), ("new_field", pa.string()), ("change", pa.string())])
_CHANGES_DDL = "feed string, file_seq int, field string, new_field string, change string"


def matched(olds: dict[str, np.ndarray], news: dict[str, np.ndarray]) -> list[tuple[str, str]]:
    """Rename pairs of one file's removed and added paths, best first, each path used once."""
    scores = sorted((-rename_score(o, n, a, b), o, n) for o, a in olds.items() for n, b in news.items())
    pairs, used_old, used_new = [], set(), set()
    for score, o, n in scores:
        if score < 0 and o not in used_old and n not in used_new:
            used_old.add(o)
            used_new.add(n)
            pairs.append((o, n))
    return pairs


def _file_changes(rows: list[tuple]) -> list[tuple]:
    """Changes of one file from its rows (feed, file_seq, path, change, sums)."""
    feed, seq = rows[0][:2]
    sides = {c: {r[2]: np.array(r[4:]) for r in rows if r[3] == c} for c in ("removed", "added")}
    pairs = matched(sides["removed"], sides["added"])
    gone, came = {o for o, _ in pairs}, {n for _, n in pairs}
    out = [(feed, seq, o, n, "renamed") for o, n in pairs]
    return out + [(feed, seq, r[2], "", r[3]) for r in rows if r[2] not in (gone if r[3] == "removed" else came if r[3] == "added" else ())]


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of files whose rows come one after the other; a file's rows are one per path."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, _CHANGES)], schema=_CHANGES)

    held, out = [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:2] != row[:2]:
                out += _file_changes(held)
                held = []
            held.append(row)
        yield batch_of(out)
        out = []
    yield batch_of(_file_changes(held) if held else [])


def schema_changes(lines: DataFrame) -> DataFrame:
    """(feed, file_seq, field, new_field, change) of each file against the feed's previous file present.

    A file is present if it has any line, even if all are unreadable (it then has no fields). A
    path is added, removed, renamed (removed while the same content goes on under an added path
    beside it; ``new_field``) or retyped (its set of JSON types differs). The first file of a feed
    gives no rows. Renames are looked for among the added and removed paths of one file only.
    """
    stats = path_statistics(lines)
    files = lines.filter("feed is not null and file_seq is not null").select("feed", F.col("file_seq").cast("int").alias("file_seq")).distinct()
    by_feed = Window.partitionBy("feed").orderBy("file_seq")
    following = files.withColumn("next_seq", F.lead("file_seq").over(by_feed)).withColumn("has_previous", F.lag("file_seq").over(by_feed).isNotNull())
    types = F.concat(*(F.when(F.col(f"n_{t}") > 0, F.lit(t[0])).otherwise("") for t in ("number", "boolean", "string")))
    sides = F.explode(F.array(F.struct(F.when(F.col("has_previous"), F.col("file_seq")).alias("seq"), F.lit(True).alias("is_new")), F.struct(F.col("next_seq").alias("seq"), F.lit(False).alias("is_new"))))
    # each file's statistics stand for itself and for the base of the next: no join of the two sides
    rows = stats.join(following, ["feed", "file_seq"]).withColumn("types", types).withColumn("s", sides).filter("s.seq is not null")
    is_new, is_old = F.col("s.is_new"), ~F.col("s.is_new")
    grouped = rows.groupBy("feed", F.col("s.seq").alias("file_seq"), "path").agg(F.max(F.when(is_new, F.col("types"))).alias("new"), F.max(F.when(is_old, F.col("types"))).alias("old"), *(F.max(c).alias(c) for c in SUMS))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "retyped")
    both = grouped.withColumn("change", change).filter("change is not null").drop("old", "new")
    # files come whole to a task, sorted, and stream through one reader: no frame is built per file
    files_whole = both.select("feed", "file_seq", "path", "change", *SUMS).repartition("feed", "file_seq").sortWithinPartitions("feed", "file_seq", "path")
    return files_whole.mapInArrow(_changes, _CHANGES_DDL)


_VALUE = pa.struct([("path", pa.string()), ("place", pa.string()), ("raw_type", pa.string()), ("value", pa.string())])
_VALUES_DDL = "feed string, file_seq int, line_no int, digest binary, vals array<struct<path:string,place:string,raw_type:string,value:string>>"


def placed_scalars(value: object) -> Iterator[tuple[str, str, object]]:
    """(path, place, value) of every non-null scalar in reading order; place has the indexes in the arrays of the path, with dots between."""
    stack = [("", "", value)]
    while stack:
        path, place, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, place, x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((path + "[]", f"{place}.{i}" if place else str(i), x) for i, x in reversed(list(enumerate(v))))
        elif v is not None:
            yield path, place, v


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per readable line: its key, its digest and its path-value map."""
    for batch in batches:
        kept, digests, offsets = [], [], [0]
        columns: list[list] = [[], [], [], []]
        for row, text in enumerate(batch.column(3).to_pylist()):
            if (line := read_line(text)) is None:
                continue
            for path, place, v in placed_scalars(line):
                for column, x in zip(columns, (path, place, json_type(v), v if isinstance(v, str) else json.dumps(v))):
                    column.append(x)
            kept.append(row)
            digests.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            offsets.append(len(columns[0]))
        flat = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(_VALUE))
        own = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(3)), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["feed", "file_seq", "line_no", "digest", "vals"])


def path_values(lines: DataFrame) -> DataFrame:
    """(feed, file_seq, line_no, digest, vals): the path-value map of every readable line, each scalar with its place in arrays and raw JSON type.

    Repeated lines count once (by feed, file, line and content), torn ones and lines from before
    their file was opened not at all. A line is read where it lies and is one row from then on.
    """
    rows = in_time(lines).select("feed", F.col("file_seq").cast("int").alias("file_seq"), F.col("line_no").cast("int").alias("line_no"), "payload")
    return rows.mapInArrow(_values, _VALUES_DDL).dropDuplicates(["feed", "file_seq", "line_no", "digest"])


def _lineage(frame: pd.DataFrame) -> pd.DataFrame:
    """First names of the renamed paths of one feed: (feed, path, from_seq, canonical)."""
    out, name = [], {}
    for _, r in frame.sort_values("file_seq", kind="stable").iterrows():
        name[r["new_field"]] = name.get(r["field"], r["field"])
        out.append((r["feed"], r["new_field"], r["file_seq"], name[r["new_field"]]))
    return pd.DataFrame(out, columns=["feed", "path", "from_seq", "canonical"])


def lineage(changes: DataFrame) -> DataFrame:
    """What each renamed path was called first, from which file on; one small group per feed."""
    return changes.filter("change = 'renamed'").groupBy("feed").applyInPandas(_lineage, "feed string, path string, from_seq int, canonical string")


#: Renames (three short strings and two numbers each) that go to the lines; with more the lines go to them, feed by feed, a hot feed in so many salted parts.
MOST_BROADCAST, SALTS = 50_000, 64


def consistent_values(values: DataFrame, changes: DataFrame) -> DataFrame:
    """``path_values`` with each path under its first name: vals has field in place of path.

    A name holds from the file of its rename until the path is renamed again; the names of a feed
    are one small map, so no value is shuffled for it.
    """
    names = lineage(changes)
    until = F.lead("from_seq").over(Window.partitionBy("feed", "path").orderBy("from_seq"))
    names = names.withColumn("until_seq", until)
    of_feed = cut(names.groupBy("feed").agg(F.collect_list(F.struct("path", "from_seq", "until_seq", "canonical")).alias("names")))
    if (of_feed.agg(F.sum(F.size("names"))).first()[0] or 0) <= MOST_BROADCAST:
        joined = values.join(F.broadcast(of_feed), "feed", "left")
    else:
        salted = of_feed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = values.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(salted, ["feed", "salt"], "left").drop("salt")
    valid = F.filter("names", lambda n: (F.col("file_seq") >= n["from_seq"]) & (n["until_seq"].isNull() | (F.col("file_seq") < n["until_seq"])))
    pairs = F.map_from_entries(F.transform("valid", lambda n: F.struct(n["path"], n["canonical"])))
    named = F.transform("vals", lambda v: F.struct(F.coalesce(F.col("own")[v["path"]], v["path"]).alias("field"), v["place"].alias("place"), v["raw_type"].alias("raw_type"), v["value"].alias("value")))
    return joined.withColumn("valid", valid).withColumn("own", pairs).select("feed", "file_seq", "line_no", "digest", named.alias("vals"))


def _cast(schema: dict[str, str], field: Column, value: Column) -> Column:
    """Whether a value can be held by its field's type; null for fields without a type."""
    out = F.lit(None).cast("boolean")
    for kind in sorted(set(schema.values())):
        fields = [f for f, t in schema.items() if t == kind]
        out = F.when(field.isin(*fields), value.try_cast(kind).isNotNull() if kind != "string" else F.lit(True)).otherwise(out)
    return out


def project(values: DataFrame, schema: dict[str, str], rest: bool = False) -> DataFrame:
    """One typed row per line out of ``consistent_values``: columns of ``schema`` (field: SQL type).

    A value that its type can't hold is null in its column and counted in ``failed_casts``. A field
    under an array has a value for each place: its column is an array in reading order, without
    what its type can't hold. Where a line has a field twice, its first value counts. With ``rest``
    every readable line has a row, and ``others`` has, in reading order, all values with their
    places that have no column: of fields not in ``schema``, and those that their types can't hold.
    """
    flat = [f for f in schema if "[]" not in f]
    single = F.map_from_arrays(F.transform("one", lambda v: v["field"]), F.transform("one", lambda v: v["value"]))
    rows = values.withColumn("one", F.filter("vals", lambda v: v["field"].isin(*flat))).withColumn("one", F.filter("one", lambda v, i: F.array_position(F.transform("one", lambda x: x["field"]), v["field"]) == i + 1))
    rows = rows.withColumn("own", single)
    columns = [F.col("own")[f].try_cast(t).alias(_name(f)) for f, t in schema.items() if f in flat]
    for f, t in schema.items():
        if f not in flat:
            columns.append(_repeated(f, t).alias(_name(f)))
    fits = lambda v: F.coalesce(_cast(schema, v["field"], v["value"]), F.lit(False))
    failed = F.size(F.filter("vals", lambda v: ~F.coalesce(_cast(schema, v["field"], v["value"]), F.lit(True)))).cast("bigint")
    others = [F.filter("vals", lambda v: ~fits(v)).alias("others")] if rest else []
    rows = rows if rest else rows.filter(F.exists("vals", lambda v: v["field"].isin(*schema)))
    return rows.select("feed", "file_seq", "line_no", *columns, failed.alias("failed_casts"), *others)


def _repeated(field: str, kind: str) -> Column:
    """The values of a field under an array, in reading order."""
    return F.array_compact(F.transform(F.filter("vals", lambda v: v["field"] == field), lambda v: v["value"].try_cast(kind)))


def _name(field: str) -> str:
    return re.sub(r"\W+", "_", field).strip("_")


def failed_casts(values: DataFrame, schema: dict[str, str], rest: bool = False) -> DataFrame:
    """(feed, file_seq, field, raw_type, n_values, n_failed) of the fields of ``schema``; with ``rest`` of the others, too, as strings."""
    each = values.select("feed", "file_seq", F.explode("vals").alias("v")).select("feed", "file_seq", "v.field", "v.raw_type", "v.value")
    wanted = each if rest else each.filter(F.col("field").isin(*schema))
    return wanted.groupBy("feed", "file_seq", "field", "raw_type").agg(F.count("*").alias("n_values"), F.count_if(~_cast(schema, F.col("field"), F.col("value"))).alias("n_failed"))
