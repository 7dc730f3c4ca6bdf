"""Documents into containers of fixed capacity, by vector best fit.

A container has three capacities: tokens, documents and attention cost (the sum of squared lengths).
Items go, longest first, into the open container that fits them under every constraint with the best
score: the weighted dot product of item and residual, or the least residual norm. Open containers are
kept in order of their token residual, so that the search ends where a bound says that none can be
better. Shards of bounded size are packed side by side; containers left badly filled are opened again
and packed together in the next round, in shards of the same size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.llm.tokenizer import VOCABULARY, with_tokens
from treelake.operators.dedupe import latest
from treelake.session import cut

#: Documents of a shard at about, in every round; containers filled less than this are packed again; rounds of that.
SHARD, WELL_FILLED, ROUNDS = 8_000, 0.97, 3
#: Constraint weights (tokens, documents, attention), tokens of capacity for each document a container may hold, attention cost per squared capacity.
WEIGHTS, TOKENS_A_DOCUMENT, ATTENTION = (1.0, 0.05, 0.15), 32, 0.75
#: Most rows of the parameter list of packs; a longer one is refused.
MOST_PACKS = 64
#: Open containers that can still take so few tokens are closed.
CLOSED_AT = 8
#: Open containers looked at in one step of the search.
STEP = 64

PACKED = "pack_name string, capacity_tokens bigint, bin_id string, doc_id bigint, piece int, tokens bigint"


def best_fit(sizes: np.ndarray, capacity: int, score: str = "norm", most_documents: int | None = None, attention: float = ATTENTION, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The container of each item; no constraint is ever broken, no item larger than the capacity allowed.

    An item whose attention cost alone is more than the limit has a container of its own. The best
    open container is found exactly: by ``norm`` from the least token residual that fits upwards, by
    ``dot`` from the greatest downwards, until no further residual can beat the best score so far.
    """
    most_documents = max(1, capacity // TOKENS_A_DOCUMENT) if most_documents is None else most_documents
    limit = np.array([capacity, most_documents, attention * float(capacity) ** 2])
    scale = np.asarray(weights) / limit**2
    out = np.full(len(sizes), -1, np.int64)
    # rows of open containers in order of tokens left: tokens, documents and attention left, number
    rows = np.empty((1024, 4))
    live = opened = 0

    def put(row: np.ndarray) -> None:
        nonlocal rows, live
        if row[0] < CLOSED_AT or row[1] < 1 or row[2] < CLOSED_AT**2:
            return
        if live == len(rows):
            rows = np.concatenate([rows, np.empty_like(rows)])
        at = int(np.searchsorted(rows[:live, 0], row[0]))
        rows[at + 1 : live + 1] = rows[at:live]
        rows[at] = row
        live += 1

    for i in np.argsort(-sizes, kind="stable"):
        item = np.array([sizes[i], 1.0, float(sizes[i]) ** 2])
        first = int(np.searchsorted(rows[:live, 0], item[0]))
        best, found = np.inf, -1
        steps = range(first, live, STEP) if score == "norm" else range(live, first, -STEP)
        for edge in steps:
            part = slice(edge, min(edge + STEP, live)) if score == "norm" else slice(max(first, edge - STEP), edge)
            nearest = rows[part.start, 0] if score == "norm" else rows[part.stop - 1, 0]
            # what the tokens alone ask for is a bound on every score further on
            bound = scale[0] * (nearest - item[0]) ** 2 if score == "norm" else -(scale[0] * nearest * item[0] + scale[1] * limit[1] + scale[2] * limit[2] * item[2])
            if bound >= best:
                break
            open_ = rows[part, :3]
            fits = (open_ >= item).all(axis=1)
            if fits.any():
                costs = ((open_ - item) ** 2) @ scale if score == "norm" else -((open_ * item) @ scale)
                costs[~fits] = np.inf
                at = int(costs.argmin())
                if costs[at] < best:
                    best, found = float(costs[at]), part.start + at
        if found >= 0:
            row = rows[found].copy()
            rows[found : live - 1] = rows[found + 1 : live]
            live -= 1
            row[:3] -= item
        else:
            row = np.array([*(limit - item), opened])
            opened += 1
        out[i] = int(row[3])
        put(row)
    return out


def _pack(score: str):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins = best_fit(frame["tokens"].to_numpy(), int(frame["capacity_tokens"].iloc[0]), score)
        prefix = f"{int(frame['round'].iloc[0])}-{int(frame['shard'].iloc[0])}-"
        return frame.assign(bin_id=[prefix + str(b) for b in bins])[["pack_name", "capacity_tokens", "bin_id", "doc_id", "piece", "tokens"]]

    return pack


def pieces(documents: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(pack_name, capacity_tokens, doc_id, piece, tokens): every document once per pack.

    A text is split only where it alone exceeds the capacity: into full pieces and a rest. Repeated
    rows count once (the last); null keys, and null or empty texts, which have no tokens, are left out,
    and so are packs without a name or a capacity.
    """
    received = ["received_at"] if "received_at" in documents.columns else []
    counted = with_tokens(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *received, "text").filter("doc_id is not null and text <> ''"), vocabulary=vocabulary)
    # texts are counted where they are read: what is shuffled is a number a row
    counted = latest(counted, ["doc_id"], received).filter("tokens > 0").select("doc_id", "tokens")
    # every pack takes every document: the packs are a parameter list of a few rows, refused if it isn't
    wanted = packs.select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).filter("pack_name is not null and capacity_tokens > 0").distinct().limit(MOST_PACKS + 1).collect()
    if len(wanted) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs")
    each = F.array(*(F.struct(F.lit(p.pack_name).cast("string").alias("pack_name"), F.lit(p.capacity_tokens).cast("bigint").alias("capacity_tokens")) for p in sorted(wanted)))
    each = each if wanted else F.array().cast("array<struct<pack_name:string,capacity_tokens:bigint>>")
    rows = counted.select("doc_id", F.col("tokens").alias("whole"), F.explode(each).alias("p")).select("p.pack_name", "p.capacity_tokens", "doc_id", "whole")
    full = F.sequence(F.lit(0), (F.ceil(F.col("whole") / F.col("capacity_tokens")) - 1).cast("int"))
    split = rows.select("pack_name", "capacity_tokens", "doc_id", "whole", F.explode(full).alias("piece"))
    return split.select("pack_name", "capacity_tokens", "doc_id", "piece", F.least("capacity_tokens", F.col("whole") - F.col("piece") * F.col("capacity_tokens")).alias("tokens"))


def pack(documents: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY, score: str = "norm") -> DataFrame:
    """(pack_name, capacity_tokens, bin_id, doc_id, piece, tokens): the container of every piece.

    Every piece is in exactly one container of each pack. An empty table gives no rows.
    """
    items = cut(pieces(documents, packs, vocabulary))
    done: list[DataFrame] = []
    for turn in range(ROUNDS):
        # a row per pack: how many shards its items of this round make
        sizes = {r.pack_name: r.n for r in items.groupBy("pack_name").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            break
        shards = F.element_at(F.map_from_arrays(F.array(*map(F.lit, sizes)), F.array(*(F.lit(max(1, -(-n // SHARD))) for n in sizes.values()))), F.col("pack_name"))
        shard = F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), shards).cast("int")
        packed = cut(items.withColumn("shard", shard).withColumn("round", F.lit(turn)).groupBy("pack_name", "capacity_tokens", "shard").applyInPandas(_pack(score), PACKED))
        if turn == ROUNDS - 1 or max(sizes.values()) <= SHARD:
            done.append(packed)
            break
        fill = packed.groupBy("pack_name", "capacity_tokens", "bin_id").agg((F.sum("tokens") / F.col("capacity_tokens")).alias("fill"))
        marked = packed.join(fill, ["pack_name", "capacity_tokens", "bin_id"])
        done.append(marked.filter(F.col("fill") >= WELL_FILLED).drop("fill"))
        items = cut(marked.filter(F.col("fill") < WELL_FILLED).drop("fill", "bin_id"))
    if not done:
        return items.select("pack_name", "capacity_tokens", F.lit("").alias("bin_id"), "doc_id", "piece", "tokens")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def fill_report(packed: DataFrame) -> DataFrame:
    """(pack_name, bins, pieces, tokens, utilisation, well_filled, over_capacity) of a packing; well_filled is the share of containers filled to ``WELL_FILLED`` or more."""
    bins = packed.groupBy("pack_name", "capacity_tokens", "bin_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    well = F.col("tokens") >= WELL_FILLED * F.col("capacity_tokens")
    return bins.groupBy("pack_name").agg(
        F.count("*").alias("bins"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity_tokens")).alias("utilisation"), (F.count_if(well) / F.count("*")).alias("well_filled"), F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("over_capacity")
    )
