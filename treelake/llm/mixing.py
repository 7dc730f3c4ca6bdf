"""Documents of several, overlapping sources mixed to target weights, by min-cost flow.

A text may lie in several sources. Texts are aggregated by membership pattern (the set of sources they
lie in); a flow routes the patterns' tokens to the sources' quotas, repetition costing more with each
copy, up to each source's cap. Seeded documents then fill each share of each pattern's tokens.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelake.llm.tokenizer import VOCABULARY, with_tokens
from treelake.operators.dedupe import latest
from treelake.session import cut

SEED = 17
#: Texts of a part of the hash range at about, in which tokens are added up before documents are ordered; least number of parts.
PART, LEAST_PARTS = 20_000, 64
#: Most mixes of the parameter table, and most sets of sources that the texts of a mix lie in; more are refused.
MOST_MIXES, MOST_PATTERNS = 64, 5_000
#: Steps of halving in which the largest total size is found, and unit of flow in tokens.
HALVINGS = 40


class Flow:
    """Minimum-cost flow by successive cheapest paths; the graphs have a few hundred nodes."""

    def __init__(self, nodes: int):
        self.edges: list[list] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            dist = [None] * len(self.out)
            via = [0] * len(self.out)
            dist[source], queue, queued = 0, deque([source]), {source}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    b, capacity, cost = self.edges[e]
                    if capacity > 0 and (dist[b] is None or dist[a] + cost < dist[b]):
                        dist[b], via[b] = dist[a] + cost, e
                        if b not in queued:
                            queued.add(b)
                            queue.append(b)
            if dist[sink] is None:
                return total
            push, b = None, sink
            while b != source:
                e = via[b]
                push = self.edges[e][1] if push is None else min(push, self.edges[e][1])
                b = self.edges[e ^ 1][0]
            b = sink
            while b != source:
                e = via[b]
                self.edges[e][1] -= push
                self.edges[e ^ 1][1] += push
                b = self.edges[e ^ 1][0]
            total += push


def route(patterns: dict[frozenset, int], targets: dict[str, tuple[float, int]]) -> tuple[int, dict[tuple[frozenset, int, str], int]]:
    """(total tokens, tokens by (pattern, copy, source)): the largest total at which all targets are met.

    ``patterns`` has the tokens of each set of sources, ``targets`` share and most copies of each
    source. Sources without any text get nothing and the others keep their proportions. The copy
    (0, 1, ...) of a pattern's tokens costs more each time, so nothing is repeated without need.
    """
    sources = sorted(s for s, (share, most) in targets.items() if share > 0 and most > 0 and any(s in p and n > 0 for p, n in patterns.items()))
    keys = sorted((p for p, n in patterns.items() if n > 0 and any(s in p for s in sources)), key=sorted)
    whole = sum(targets[s][0] for s in sources)
    if not sources or not keys:
        return 0, {}

    def build(total: float) -> tuple[Flow, dict, int]:
        copies = max(targets[s][1] for s in sources)
        flow = Flow(2 + len(keys) * copies + len(sources))
        used, need = {}, 0
        place = {s: 2 + len(keys) * copies + i for i, s in enumerate(sources)}
        for i, p in enumerate(keys):
            for c in range(copies):
                node = 2 + i * copies + c
                flow.add(0, node, patterns[p], (c + 1) ** 2)
                for s in sources:
                    if s in p and c < targets[s][1]:
                        used[p, c, s] = flow.add(node, place[s], patterns[p])
        for s in sources:
            quota = int(total * targets[s][0] / whole)
            need += quota
            flow.add(place[s], 1, quota)
        return flow, used, need

    low, high = 0.0, float(sum(patterns[p] for p in keys) * max(targets[s][1] for s in sources)) + 1
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        flow, _, need = build(middle)
        low, high = (middle, high) if flow.run(0, 1) >= need else (low, middle)
    flow, used, _ = build(low)
    total = flow.run(0, 1)
    return total, {k: n for k, e in used.items() if (n := flow.edges[e ^ 1][1]) > 0}


def texts_by_pattern(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, sources, tokens): one row per different text, of the least doc_id, with all its sources."""
    received = ["received_at"] if "received_at" in documents.columns else []
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), *received, F.sha2("text", 256).alias("text_hash"), "text").filter("doc_id is not null and source is not null and text <> ''")
    # texts are counted and hashed where they are read: what is shuffled is a few numbers a row
    counted = latest(with_tokens(rows, vocabulary=vocabulary), ["doc_id"], received).filter("tokens > 0")
    return counted.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_set("source")).alias("sources"), F.max("tokens").alias("tokens")).drop("text_hash")


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(mix_name, doc_id, source, copies, tokens): the chosen documents of each mix and how often each comes.

    Documents of sources outside a mix are not used in it. A text lies in each source one of whose
    documents has it, and is used for each as routed. Quotas are met to within one document for each
    share of a pattern. Nulls in doc_id, source or text, and empty texts, are left out.
    """
    spark = documents.sparkSession
    texts = cut(texts_by_pattern(documents, vocabulary))
    wanted: dict[str, dict[str, tuple[float, int]]] = {}
    for r in targets.filter("mix_name is not null and source is not null").limit(100 * MOST_MIXES + 1).collect():
        wanted.setdefault(r.mix_name, {})[r.source] = (float(r.target_share or 0), int(r.max_repeats or 0))
    if len(wanted) > MOST_MIXES or sum(map(len, wanted.values())) > 100 * MOST_MIXES:
        raise ValueError(f"more than {MOST_MIXES} mixes, or {100 * MOST_MIXES} sources of them")
    goals = F.array(*(F.struct(F.lit(m).alias("mix_name"), F.array(*map(F.lit, sorted(g))).alias("wanted")) for m, g in sorted(wanted.items())))
    goals = goals if wanted else F.array().cast("array<struct<mix_name:string,wanted:array<string>>>")
    each = texts.select("doc_id", "sources", "tokens", F.explode(goals).alias("g"))
    member = each.select("doc_id", "tokens", "g.mix_name", F.sort_array(F.array_intersect("sources", "g.wanted")).alias("pattern")).filter(F.size("pattern") > 0)
    # a row for each set of sources that occurs in a mix, however many texts there are; refused where there are too many
    counted: dict[str, dict[frozenset, int]] = {}
    sets = member.groupBy("mix_name", "pattern").agg(F.sum("tokens").alias("n")).limit(len(wanted) * MOST_PATTERNS + 1).collect()
    for r in sets:
        counted.setdefault(r.mix_name, {})[frozenset(r.pattern)] = r.n
    if len(sets) > len(wanted) * MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources in a mix")
    spans = []
    for name, goal in sorted(wanted.items()):
        _, flows = route(counted.get(name, {}), goal)
        ends: dict[tuple, int] = {}
        for (pattern, copy, source), n in sorted(flows.items(), key=lambda x: (sorted(x[0][0]), x[0][1], x[0][2])):
            begin = ends.get((pattern, copy), 0)
            spans.append((name, sorted(pattern), copy, source, begin, begin + n))
            ends[pattern, copy] = begin + n
    plan = spark.createDataFrame(spans, "mix_name string, pattern array<string>, copy int, source string, begin bigint, end bigint")
    # position of each text among its pattern's tokens in seeded order: sums of parts, then within parts
    number = max(LEAST_PARTS, -(-texts.count() // PART))
    ordered = member.withColumn("u", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.width_bucket(F.col("u").cast("double"), F.lit(-(2.0**63)), F.lit(2.0**63), F.lit(number)))
    parts = ordered.groupBy("mix_name", "pattern", "part").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("mix_name", "pattern").orderBy("part")) - F.col("n")
    within = F.sum("tokens").over(Window.partitionBy("mix_name", "pattern", "part").orderBy("u", "doc_id")) - F.col("tokens")
    placed = ordered.withColumn("within", within).join(parts.select("mix_name", "pattern", "part", before.alias("before")), ["mix_name", "pattern", "part"])
    placed = placed.withColumn("at", F.col("before") + F.col("within") + F.col("tokens") / 2)
    chosen = placed.join(F.broadcast(plan), ["mix_name", "pattern"]).filter("at >= begin and at < end")
    return chosen.groupBy("mix_name", "doc_id", "source").agg(F.count("*").cast("int").alias("copies"), F.max("tokens").alias("tokens"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, documents, most_copies): targets against what came."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    joined = targets.select("mix_name", "source", "target_share").join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return joined.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))
