import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from treelake.llm import boilerplate, canonical, mixing, packing, percentiles, residue, tokenizer, toxicity

T0 = datetime(2026, 1, 1)


# problem 5
def test_residue_kinds():
    cases = {
        "Our offer for {{city}} ends on %date%": "placeholder", "Hello [[HEADLINE]]": "placeholder", "Only &lt;PRODUCT_NAME&gt; left": "placeholder", "From %(price)s a night": "placeholder", "undefined": "empty_value",
        "Price: NaN": "empty_value", "Lorem ipsum dolor sit amet": "filler", "Your headline here": "filler", "404: Page not found | Shop": "error_page", "HTTP 500 - Internal server error. Please try again in a few minutes.": "error_page",
        "Please enable JavaScript to see the content.": "script_notice", "Seite nicht gefunden": "error_page", "Bad gateway: Query failed: relation does not exist": "error_page", "Site suspended: Warning: missing argument 41 in view.php on line 4": "error_page", "Bitte JavaScript einschalten, um diese Seite zu sehen.": "script_notice",
    }
    assert {t: residue.residue(t) for t in cases} == cases
    for text in (None, "", "  ", "Write {{ name }} in the template and it is filled.", "How to design a 404 page", "Access denied, a radio play", "A short history of lorem ipsum", "What does undefined mean?", "Between the braces {a} and {b} the set holds 9.", "If JavaScript is switched off, the static text shows.", "Null results in science", "None of the harbours was empty", "Warning", "Fatal", "Warning: the bridge is closed"):
        assert residue.residue(text) is None, text
    assert residue.residue("fetch failed after 90 ms", True) == "failure" and residue.residue("retried 9 times, body complete", True) is None and residue.residue("none", True) is None and residue.residue("fetch failed after 90 ms") is None


def test_residue_prefilter_keeps_all_cases(spark):
    rows = [(1, "TBD", T0), (1, "TBD", T0), (2, "A long harbour tale. " * 5_000, T0), (3, None, T0), (None, "TBD", T0), (4, "Titre de la page ici", T0), (5, "Сервис временно недоступен", T0)]
    df = spark.createDataFrame(rows, "k bigint, t string, received_at timestamp")
    assert sorted(r.record_key for r in residue.residue_rows(df, "k", "t").collect()) == [1, 4, 5]
    assert residue.residue_rows(df.limit(0), "k", "t").count() == 0


def test_residue_rows_are_those_of_residue(spark):
    texts = ["Страница не найдена", "Доступ запрещён", "Страница не найдена | Лавка", "Скрипты заблокированы.", "Введите заголовок", "Заголовок страницы", "&nbsp;", "Placeholder title", "Слово слово слово", "Plain harbour tale", "Паром вышел в море"]
    assert [residue.residue(t) is not None for t in texts] == [True] * 9 + [False] * 2
    df = spark.createDataFrame([(i, t, T0) for i, t in enumerate(texts)], "k bigint, t string, received_at timestamp")
    assert sorted(tuple(r) for r in residue.residue_rows(df, "k", "t").collect()) == [(i, residue.residue(t)) for i, t in enumerate(texts[:9])]


def test_residue_in_long_texts():
    prose = "The ferry crew moved forty boards across the harbour on Tuesday, and nobody minded the rain. " * 8
    cases = {
        prose + "The new lamp costs undefined crowns.": "empty_value", prose + "Your text here. " + prose: "filler", "Page not found. Please try again later. " * 20: "error_page",
        "Please enable JavaScript in your browser to use this shop. You can turn on scripts in the settings of your browser, under privacy. Then reload the page in the same browser to see all our offers.": "script_notice",
    }
    assert {t: residue.residue(t) for t in cases} == cases
    assert residue.residue("fetched undefined of 9 pages", True) == "empty_value" and residue.residue("complete, warnings None", True) is None
    for text in (prose, prose + "None had seen it.", "Please use scripts with care. " + prose, prose + "The word undefined means that a value is missing.", "Sorry, we could not find a better harbour. " + prose):
        assert residue.residue(text) is None, text


# problem 6
def test_canonical_forms():
    same = ["Haut de page", "Ηaut de page", "Ｈａｕｔ ｄｅ ｐａｇｅ", "Ha​ut de page", "Haut de pa­ge"]
    assert {canonical.canonical(t) for t in same} == {"Haut de page"}
    assert canonical.canonical("Коpзина") == "Корзина" and canonical.canonical("café") == "café" and canonical.canonical("ﬁle‑a") == "file-a"
    for kept in ("Team ²", "½", "a – b", "TM™", "Straße", "", "naïve", "A", "Ω 5"):
        assert canonical.canonical(kept) == kept
    assert canonical.canonical(None) is None


def test_canonical_is_idempotent():
    rng = random.Random(4)
    letters = "aeopcxАаеоΟν́̈­​ ﬁＡ９é-‑ñйи"
    for _ in range(500):
        form = canonical.canonical("".join(rng.choice(letters) for _ in range(rng.randint(0, 12))))
        assert canonical.canonical(form) == form


def test_lookalike_pairs_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["Home", "Ηome", "Ho​me", "home", "Café", "Café", None, "", "a b", "a b"]
    rows = [(i, i % 4, rng.choice(texts), rng.choice(texts), T0) for i in range(120)]
    df = spark.createDataFrame(rows + rows[:9], "element_key bigint, page_id bigint, text string, label string, received_at timestamp")
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            for at, field in ((2, "text"), (3, "label")):
                if a[1] == b[1] and a[at] and b[at] and a[at] != b[at] and canonical.canonical(a[at]) == canonical.canonical(b[at]):
                    want.add((a[0], b[0], field))
    got = [tuple(r) for r in canonical.lookalike_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want) > 50


# problem 1
def test_main_content(spark):
    rows, regions = [], []
    for p in range(30):
        texts = [("footer", "paragraph", f"© {p} Shopname. All rights reserved."), ("main", "heading", f"About the harbour {p}"), ("main", "paragraph", f"The ferry crew moved {p} boards, and nobody minded."), ("aside", "paragraph", "Advertisement"), ("aside", "paragraph", f"{chr(97 + p % 26) * 3}{chr(97 + p // 26)} wrote of {chr(98 + p % 25) * 4} planks, and {chr(97 + p % 26) * 5}{p // 26 * 'x'} replied."), ("main", "link", "More"), ("aside", "section", "Visit our partner portal"), ("main", "paragraph", "Page not found"), ("main", "list", None), ("main", "paragraph", "Our bakery explains how to keep cookies crisp: store them with bread.")]
        for i, (region, role, text) in enumerate(texts):
            rows.append((p * 100 + i, p, "www.shopname.example", i, i, role, text, T0))
            regions.append((p, i, region))
    regions[4] = (0, 4, "main")
    df = spark.createDataFrame(rows + rows[:5], "element_key bigint, page_id bigint, site string, region_ord int, el_ord int, role string, text string, received_at timestamp")
    where = spark.createDataFrame([(p, i, "main" if i == 4 and p % 3 else r) for p, i, r in regions], "page_id bigint, region_ord int, role string")
    got = {r.element_key for r in boilerplate.main_content(df, where).collect()}
    assert got == {p * 100 + i for p in range(30) for i in (1, 2, 4, 9)}
    assert boilerplate.main_content(df.limit(0), where).count() == 0


def _pages_of_mixed_text(spark, pages, misplaced):
    """Pages of own text and of notices put together from parts; every third notice stands in a content region."""
    rng = random.Random(21)
    parts = [["We set cookies", "Our partners store cookies", "This shop uses cookies"], ["to measure visits.", "for statistics and adverts.", "so that pages load faster."], ["You can change this at any time.", "Accept all or choose settings.", "By staying here you agree."]]
    rows, regions, own = [], [], set()
    for p in range(pages):
        body = [("main", "heading", f"{rng.choice(['Quiet', 'Old', 'Long'])} {rng.choice(['ferries', 'mills', 'trams'])} of {rng.choice(['Dolrum', 'Velbek', 'Sorden'])} {p}"), ("main", "paragraph", f"The {rng.choice(['crew', 'miller', 'guard'])} {rng.choice(['moved', 'sold', 'counted'])} {p} {rng.choice(['boards', 'sacks', 'tickets'])}, and {rng.choice(['nobody', 'everyone', 'the mayor'])} watched.")]
        notice = [("main" if misplaced and p % 3 == 0 else "dialog", "paragraph", " ".join(map(rng.choice, parts))), ("content" if misplaced and p % 3 == 1 else "footer", "section", f"Read next: {rng.choice(['orchard', 'choir', 'harbour'])}")]
        for i, (region, role, text) in enumerate(body + notice):
            rows.append((p * 10 + i, p, "www.shopname.example", i, i, role, text, T0))
            regions.append((p, i, region))
            own |= {p * 10 + i} if i < 2 else set()
    df = spark.createDataFrame(rows, "element_key bigint, page_id bigint, site string, region_ord int, el_ord int, role string, text string, received_at timestamp")
    return df, spark.createDataFrame(regions, "page_id bigint, region_ord int, role string"), own


def test_paths_alone_tell_content_from_chrome(spark):
    df, where, own = _pages_of_mixed_text(spark, 200, misplaced=True)
    got = {r.element_key for r in boilerplate.main_content(df, where).collect()}
    assert len(got & own) >= 0.95 * len(own) and len(got & own) >= 0.95 * len(got)


def test_the_path_score_is_what_decides(spark, monkeypatch):
    df, where, own = _pages_of_mixed_text(spark, 200, misplaced=True)
    monkeypatch.setattr(boilerplate, "MORE_PROSE", 0.0)
    got = {r.element_key for r in boilerplate.main_content(df, where).collect()}
    assert len(got & own) < 0.7 * len(got), "a constant share in chrome must cost precision"


def test_fragments():
    assert boilerplate.fragments("read next: the old harbour of dolrum. yes.") == ["read next", "^the old harbour", "harbour of dolrum$", "yes"]
    assert boilerplate.fragments("") == [] == boilerplate.fragments("...") and boilerplate.fragments("a. a. a.") == ["a"]


def test_index_error_and_script_pages_have_no_main_body(spark):
    prose, teasers = ("paragraph", "The ferry crew moved 40 boards, and nobody minded."), [("heading", t) for t in ("A quiet harbour", "Notes on old trams", "The mill at dawn")]
    links = [("link", f"More {i}") for i in range(4)]
    bodies = {
        1: teasers + links, 2: [("heading", "Oh dear"), ("paragraph", "Page not found")], 3: [("heading", "Our shop"), ("paragraph", "Please enable JavaScript to see the content.")],
        4: teasers + links + [prose], 5: teasers + links, 6: teasers[:1] + links, 7: teasers, 8: [("heading", "Old harbour"), ("paragraph", "Page not found"), prose],
    }
    rows = [(p * 100 + i, p, "www.shopname.example", 0, i, role, text, T0) for p, body in bodies.items() for i, (role, text) in enumerate(body)]
    df = spark.createDataFrame(rows, "element_key bigint, page_id bigint, site string, region_ord int, el_ord int, role string, text string, received_at timestamp")
    where = spark.createDataFrame([(p, 0, "main") for p in bodies], "page_id bigint, region_ord int, role string")
    pages = spark.createDataFrame([(p, "A quiet harbour | Shopname" if p == 5 else "Page not found" if p == 8 else None if p == 7 else "Shopname", "www.shopname.example", T0) for p in bodies], "page_id bigint, title string, site string, received_at timestamp")
    got = [r.element_key for r in boilerplate.main_content(df, where, pages).collect()]
    # 5 has its own headline, 6 and 7 too little of an index; 4 and 8 have prose
    assert sorted(got) == [400, 401, 402, 407, 500, 501, 502, 600, 700, 701, 702, 800, 802]


# problem 3
@pytest.mark.parametrize("kind", ["ties", "tail", "even"])
@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_percentiles_are_certified(spark, kind, broadcast, monkeypatch):
    monkeypatch.setattr(percentiles, "MOST_BROADCAST", broadcast)
    rng = np.random.default_rng(3)
    values = {"ties": rng.integers(0, 5, 4000), "tail": rng.pareto(1.1, 4000), "even": rng.random(4000)}[kind].astype(float)
    rows = [("m", None if i % 3 == 0 else "hot", date(2026, 1, 1 + i % 4), "a" if i % 7 else None, float(v)) for i, v in enumerate(values)] + [("m", "hot", None, "a", float("nan")), ("m", "hot", None, "a", None), ("m", "hot", None, "a", math.inf), (None, "hot", None, "a", 1.0), ("m", "hot", None, "b", 2.0)]
    df = spark.createDataFrame(rows, "metric string, grp string, day date, part string, value double").repartition(6).withColumn("n", F.lit("clash")).withColumn("salt", F.lit("clash"))
    got = percentiles.percentiles(df, (0.0, 0.05, 0.5, 0.95, 1.0)).collect()
    # two groups in all, four days of both and one without, two parts of both and one of the hot
    assert len(got) == 5 * (2 + 9 + 5)
    for r in got:
        of = {"day": lambda x: str(x[2] or ""), "part": lambda x: x[3] or "", "all": lambda x: ""}[r.level]
        own = np.array([x[4] for x in rows if x[0] and (x[1] or "") == r.grp and of(x) == r.part and x[4] is not None and math.isfinite(x[4])])
        assert r.n == len(own) and r.below == (own < r.estimate).sum() and r.at_most == (own <= r.estimate).sum()
        assert r.rank_error <= math.pi * math.sqrt(r.q * (1 - r.q)) / percentiles.COMPRESSION + 2 / r.n
    assert percentiles.percentiles(df.limit(0)).count() == 0
    assert {r.level for r in percentiles.percentiles(df.drop("part"), (0.5,)).collect()} == {"day", "all"}


def test_digests_stay_within_their_buffers(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "BUFFER", 500)
    monkeypatch.setattr(percentiles, "MOST_HELD", 40)
    rows = [("m", f"g{i % 90}", date(2026, 1, 1), float(i)) for i in range(9000)]
    df = spark.createDataFrame(rows, "metric string, grp string, day date, value double").repartition(3)
    got = percentiles.percentiles(df, (0.5,)).filter("level = 'all'").collect()
    assert len(got) == 90 and all(r.n == 100 and r.rank_error <= 0.02 for r in got)


def test_a_group_is_clustered_for_itself():
    rng = np.random.default_rng(6)
    values, groups = rng.random(3000), rng.integers(0, 3, 3000)
    together = percentiles.cluster(values, np.ones(3000), groups)
    for g in range(3):
        alone = percentiles.cluster(values[groups == g], np.ones((groups == g).sum()))
        assert np.allclose(together[0][together[2] == g], alone[0]) and np.allclose(together[1][together[2] == g], alone[1])


def test_daily_digests_combine(spark):
    df = spark.createDataFrame([("m", "g", date(2026, 1, 1 + i % 9), float(i)) for i in range(9000)], "metric string, grp string, day date, value double")
    daily = percentiles.merge(percentiles.digests(df))
    merged = percentiles.estimates(percentiles.whole(daily), [0.5]).first()
    assert daily.count() == 9 and merged.n == 9000 and abs(merged.estimate - 4500) < 9000 * 0.01


# problem 8
def test_best_fit_keeps_every_constraint():
    rng = np.random.default_rng(8)
    for score in ("norm", "dot"):
        sizes = np.minimum(rng.lognormal(4, 1, 3000).astype(int) + 1, 512)
        bins = packing.best_fit(sizes, 512, score, most_documents=20)
        filled = np.bincount(bins, sizes)
        assert filled.max() <= 512 and np.bincount(bins).max() <= 20 and (bins >= 0).all()
        assert filled.sum() / (len(filled) * 512) > 0.9


def _plain_best_fit(sizes, capacity, score, most_documents, attention):
    limit = np.array([capacity, most_documents, attention * capacity**2])
    scale = np.array(packing.WEIGHTS) / limit**2
    bins, closed = [], []
    for i in np.argsort(-sizes, kind="stable"):
        item = np.array([sizes[i], 1.0, float(sizes[i]) ** 2])
        able = [b for b in range(len(bins)) if not closed[b] and (bins[b] >= item).all()]
        costs = [((bins[b] - item) ** 2) @ scale if score == "norm" else -((bins[b] * item) @ scale) for b in able]
        if able:
            at = able[int(np.argmin(costs))]
        else:
            bins.append(limit.copy())
            closed.append(False)
            at = len(bins) - 1
        bins[at] = bins[at] - item
        closed[at] = bins[at][0] < packing.CLOSED_AT or bins[at][1] < 1 or bins[at][2] < packing.CLOSED_AT**2
    return len(bins)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_finds_what_a_plain_search_finds(score, monkeypatch):
    monkeypatch.setattr(packing, "STEP", 3)
    rng = np.random.default_rng(9)
    for _ in range(12):
        sizes = rng.integers(1, 257, 160)
        bins = packing.best_fit(sizes, 256, score, most_documents=7, attention=0.6)
        assert bins.max() + 1 == _plain_best_fit(sizes, 256, score, 7, 0.6)


def test_each_constraint_binds():
    short, long, mixed = np.full(600, 5), np.full(40, 300), np.r_[np.full(40, 300), np.full(200, 90)]
    assert np.bincount(packing.best_fit(short, 512)).max() == 512 // packing.TOKENS_A_DOCUMENT
    assert packing.best_fit(short, 512, most_documents=10**6).max() + 1 == 6
    assert packing.best_fit(long, 512).max() + 1 == 40
    cost = np.bincount(packing.best_fit(np.r_[np.full(40, 400), np.full(200, 90)], 512), np.r_[np.full(40, 400), np.full(200, 90)] ** 2.0)
    assert cost.max() <= packing.ATTENTION * 512**2
    tight, loose = packing.best_fit(mixed, 512, attention=0.4).max(), packing.best_fit(mixed, 512, attention=1.0).max()
    assert tight > loose
    # one that alone costs more stands alone
    assert (np.bincount(packing.best_fit(np.r_[np.full(3, 500), np.full(30, 10)], 512))[:3] == 1).all()
    assert packing.best_fit(np.zeros(0, np.int64), 512).size == 0


def test_rounds_keep_shards_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 200)
    monkeypatch.setattr(packing, "PACKED", packing.PACKED + ", held int")
    whole = packing._pack

    def counted(score):
        def run(frame):
            return whole(score)(frame).assign(held=len(frame))

        return run

    monkeypatch.setattr(packing, "_pack", counted)
    # lengths that don't pair up: every container stays badly filled, in every round
    docs = spark.createDataFrame([(i, "word " * (70 + i % 9)) for i in range(3000)], "doc_id bigint, text string")
    packs = spark.createDataFrame([("a", 128)], "pack_name string, capacity_tokens int")
    got = packing.pack(docs, packs)
    seen = [r.held for r in got.select("held").distinct().collect()]
    assert max(seen) < 400 and got.count() == got.select("doc_id").distinct().count() == 3000
    report = packing.fill_report(got).first()
    assert report.over_capacity == 0 and report.well_filled == 0.0 and report.pieces == 3000


def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["harbour", "the", "garden", "ferry"]) for _ in range(rng.randint(1, 90))), T0) for i in range(400)] + [(900, "word " * 700, T0), (901, "", T0), (902, None, T0), (None, "x", T0)]
    docs = spark.createDataFrame(rows + rows[:7], "doc_id bigint, text string, received_at timestamp")
    packs = spark.createDataFrame([("a", 128), ("b", 512)], "pack_name string, capacity_tokens int")
    got = packing.pack(docs, packs).collect()
    encode = tokenizer.encoding().encode_ordinary
    for name, capacity in (("a", 128), ("b", 512)):
        own = [r for r in got if r.pack_name == name]
        assert len({(r.doc_id, r.piece) for r in own}) == len(own)
        by_doc, by_bin = {}, {}
        for r in own:
            by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.tokens
            by_bin[r.bin_id] = by_bin.get(r.bin_id, 0) + r.tokens
        assert by_doc == {i: len(encode(t)) for i, t, _ in rows if i is not None and t}
        assert max(by_bin.values()) <= capacity and all(r.piece == 0 for r in own if by_doc[r.doc_id] <= capacity)
        assert sum(by_bin.values()) / (capacity * len(by_bin)) > 0.93
    assert packing.pack(docs.limit(0), packs).count() == 0 == packing.pack(docs, packs.limit(0)).count()
    with pytest.raises(ValueError):
        packing.pack(docs, spark.range(70).selectExpr("cast(id as string) as pack_name", "99 as capacity_tokens"))


# problem 9
def test_route_meets_targets_with_least_repeats():
    patterns = {frozenset("a"): 1000, frozenset("b"): 100, frozenset("ab"): 50}
    total, flows = mixing.route(patterns, {"a": (0.5, 2), "b": (0.5, 3), "none": (0.2, 3)})
    got = {s: sum(n for (_, _, t), n in flows.items() if t == s) for s in "ab"}
    assert abs(got["a"] - got["b"]) <= 2 and got["b"] >= 3 * 150 - 3 and total == sum(got.values())
    assert not any(c > 0 for (p, c, s) in flows if s == "a")
    assert mixing.route({}, {"a": (1.0, 2)}) == (0, {}) and mixing.route(patterns, {"z": (1.0, 2)}) == (0, {})


def test_mix_shares(spark):
    rng = random.Random(9)
    rows = [(i, f"text {i} " + "word " * rng.randint(5, 60), "big" if i % 10 else "small", T0) for i in range(1500)]
    rows += [(5000 + i, rows[i][1], "small", T0) for i in range(1, 40) if i % 10] + [(None, "x", "big", T0), (7000, None, "big", T0), (7001, "y", None, T0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, received_at timestamp")
    targets = spark.createDataFrame([("m", "big", 0.6, 2), ("m", "small", 0.4, 2), ("n", "gone", 0.5, 2), ("n", "small", 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets)
    report = {(r.mix_name, r.source): r for r in mixing.shares(mixed, targets).collect()}
    assert abs(report["m", "big"].actual_share - 0.6) < 0.01 and abs(report["m", "small"].actual_share - 0.4) < 0.01
    assert report["m", "small"].most_copies <= 2 and report["n", "gone"].tokens == 0 and report["n", "small"].actual_share == 1.0
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7), targets).collect()))
    assert mixing.mix(docs.limit(0), targets).count() == 0 == mixing.mix(docs, targets.limit(0)).count()
    clash = docs.withColumn("tokens", F.lit("x")).withColumn("sources", F.lit("y")).withColumn("part", F.lit("z"))
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(clash, targets).collect()))
    with pytest.raises(ValueError):
        mixing.mix(docs, spark.range(70).selectExpr("cast(id as string) mix_name", "'big' source", "1.0 target_share", "1 max_repeats"))


# problem 10
ABUSE = ["You are a worthless {} and everybody knows it.", "Shut up, you rotten {}.", "I hope you rot, {}."]
NAMES = ["toad", "clown", "rat", "pig"]


def _documents(n, rng):
    out = []
    for i in range(n):
        body = [f"The {rng.choice(['ferry', 'garden', 'mill', 'tram'])} crew {rng.choice(['moved', 'sold', 'saw'])} {rng.randint(1, 99)} boards." for _ in range(6)]
        bad = i % 6 == 0
        if bad:
            body[2] = rng.choice(ABUSE).format(rng.choice(NAMES))
        elif i % 5 == 0:
            body[1] = "The toad in the garden pond is a worthless clown of a swimmer."
        out.append((i, " ".join(body), "s" if i % 2 else None, T0, bad))
    return out


def test_toxicity_on_held_out_documents(spark):
    docs = _documents(600, random.Random(10))
    df = spark.createDataFrame([d[:4] for d in docs] + [(9000, "SHUT UP, YOU R0TTEN CL0WN.", "s", T0), (9001, "Shut up, you rrrrotten c*own.", "s", T0), (9002, "", "s", T0), (9003, None, "s", T0)], "doc_id bigint, text string, source string, received_at timestamp")
    labels = spark.createDataFrame([(i, "r", int(bad) if i % 20 else 1 - int(bad)) for i, _, _, _, bad in docs[:250]] + [(3, "q", None)], "doc_id bigint, reviewer string, toxic int")
    got = {r.doc_id for r in toxicity.toxic_documents(df, labels).collect()}
    truth = {d[0] for d in docs[250:] if d[4]}
    held = {i for i in got if 250 <= i < 600}
    assert len(held & truth) >= 0.95 * len(truth) and len(held - truth) <= 0.05 * len(truth) and {9000, 9001} <= got
    assert toxicity.scores(df, labels.limit(0)).filter("score > 0").count() == 0
    assert toxicity.toxic_documents(df.limit(0), labels).count() == 0


def test_term_frequency_and_unknown_words_count():
    index = toxicity.Index([("a b c", 1.0, 0.0)], {f: 3 for f in toxicity.features("a b c".split())}, 100)
    once, often, strange = (index.vector(w.split()) for w in ("a b", "a a a b", "a b x y"))
    assert often["a"] > once["a"] == once["b"] > often["b"] and strange["a"] < once["a"]
    assert sum(w * w for w in once.values()) == pytest.approx(1.0) and index.vector([]) == {}


def test_scores_are_calibrated_on_reviews_held_out(spark):
    assert toxicity.calibration([])[0] > 0
    rng = random.Random(12)
    scored = [(s, float(rng.random() < s)) for s in (rng.random() for _ in range(4000))]
    slope, intercept = toxicity.calibration(scored)
    for low in (0.1, 0.5, 0.8):
        said = [1 / (1 + math.exp(-(slope * s + intercept))) for s, _ in scored if low <= s < low + 0.1]
        was = [y for s, y in scored if low <= s < low + 0.1]
        assert abs(sum(said) / len(said) - sum(was) / len(was)) < 0.08
    # a document is judged without what it gave: the only toxic one has no example but itself
    docs = _documents(60, random.Random(13))
    lone = [(100, "You utterly vile snake.", "s", T0)]
    df = spark.createDataFrame([d[:4] for d in docs if not d[4]] + lone, "doc_id bigint, text string, source string, received_at timestamp")
    labels = spark.createDataFrame([(100, 1)] + [(d[0], 0) for d in docs if not d[4]], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(df, labels).collect()}
    index, _ = toxicity.fit(df, labels)
    assert got[100].score > 0.9 and index.value.held_out(list(toxicity.passages(lone[0][1])), 1.0) < 0.1
    assert all(0 < r.probability < 1 for r in got.values())


def test_index_is_exact():
    rng = random.Random(11)
    words = "a b c d e f g h i j k l".split()
    examples = [(" ".join(rng.choice(words) for _ in range(6)), float(rng.random() < 0.3), 1.0) for _ in range(300)]
    examples = list({e[0]: e for e in examples}.values())
    frequency = {f: rng.randint(1, 50) for e in examples for f in toxicity.features(e[0].split(" "))}
    index = toxicity.Index(examples, frequency, 1000)
    for _ in range(60):
        query = [rng.choice(words) for _ in range(6)]
        own = index.vector(query)
        near = []
        for text, y, n in zip(index.texts, index.positive, index.negative):
            cosine = sum(w * index.vector(text.split(" ")).get(f, 0.0) for f, w in own.items())
            if cosine >= toxicity.NEAR:
                near.append((min(1.0, cosine), y, n))
        near = sorted(near, key=lambda x: -x[0])
        score, _ = index._votes(query)
        if any(y > 0 for _, y, _ in near) and len(near) <= toxicity.NEIGHBOURS:
            yes, no = (sum(math.exp((c - 1) / toxicity.REACH) * v for c, v in ((c, (y, n)[k]) for c, y, n in near)) for k in (0, 1))
            assert score == pytest.approx((yes + toxicity.PRIOR * index.base) / (yes + no + toxicity.PRIOR), rel=1e-3)


def test_every_review_counts(spark):
    # of 20,400 reviewed documents the abusive ones are those of greatest hash
    plain = F.concat(F.lit("The ferry moved forty boards. Tram "), F.col("id") % 50, F.lit(" was late."))
    rank = F.row_number().over(Window.orderBy(F.xxhash64("id").desc()))
    rows = spark.range(20_400).withColumn("bad", rank <= 30)
    df = rows.select(F.col("id").alias("doc_id"), F.when(F.col("bad"), F.lit("You utterly vile snake.")).otherwise(plain).alias("text"), F.lit("s").alias("source"), F.lit(T0).alias("received_at"))
    labels = rows.select(F.col("id").alias("doc_id"), F.col("bad").cast("int").alias("toxic"))
    new = spark.createDataFrame([(50_000, "Tram 7 was late. You utterly vile snake.", "s", T0), (50_001, "Tram 7 was late.", "s", T0)], df.schema)
    got = {r.doc_id for r in toxicity.toxic_documents(df.union(new), labels).collect()}
    assert 50_000 in got and 50_001 not in got and len(got) == 31


def test_fit_leaves_out_no_example_that_has_a_vote(spark):
    docs = _documents(400, random.Random(14))
    df = spark.createDataFrame([d[:4] for d in docs], "doc_id bigint, text string, source string, received_at timestamp")
    opinion = {i: float(bad if i % 15 else not bad) for i, _, _, _, bad in docs[:200]}
    labels = spark.createDataFrame([(i, int(y)) for i, y in opinion.items()], "doc_id bigint, toxic int")
    cut = {d[0]: list(toxicity.passages(d[1])) for d in docs}
    yes, no = ({p: sum(v(opinion[i]) for i in opinion if p in cut[i]) for i in opinion for p in cut[i]} for v in (lambda y: y, lambda y: 1 - y))
    frequency = {f: sum(f in toxicity.features(p.split(" ")) for c in cut.values() for p in c) for f in {f for e in yes for f in toxicity.features(e.split(" "))}}
    index = toxicity.Index([(p, yes[p], no[p]) for p in yes], frequency, sum(map(len, cut.values())))
    got = {r.doc_id: r for r in toxicity.scores(df, labels).collect()}
    assert len(got) == 400 and sum(r.score > 0 for r in got.values()) > 50
    for i, found in cut.items():
        score, passage, example = index.worst(found)
        assert got[i].score == pytest.approx(score, abs=1e-9) and (got[i].passage, got[i].example) == (passage, example)
    assert toxicity.fit(df, labels)[0].value.base == pytest.approx(index.base)


# all: nulls, empty and very long texts, repeated rows, empty tables, clashing columns
CLASHES = ("k", "n", "r", "t", "v", "c", "x", "own", "page", "value", "canonical", "kind", "fragment", "share", "shares", "seen", "salt", "score", "content", "tokens", "whole", "piece", "shard", "part", "sources", "toxic", "passage", "record_key", "__delivery_rank")


def _clashing(df):
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


LONG = "The ferry crew moved forty boards across the harbour, and nobody minded the rain. " * 4_000


def test_elements_of_any_kind(spark):
    texts = [None, "", "  ", LONG, "Ηaut de page", "Haut de page", "TBD", "A quiet harbour", "​", "🚢 ferry", "nul\x00l"]
    rows = [(i, i % 2, None if i == 3 else "www.shopname.example", None if i == 4 else 0, None if i == 5 else i, "paragraph", x, x, T0) for i, x in enumerate(texts)]
    rows += [(None, 1, "s", 0, 0, "heading", "x", "x", T0), (50, None, "s", 0, 0, "heading", "x", "x", T0), (51, 1, "s", 0, 0, None, "x", "x", T0)] + rows[3:8]
    df = spark.createDataFrame(rows, "element_key bigint, page_id bigint, site string, region_ord int, el_ord int, role string, text string, label string, received_at timestamp")
    regions = spark.createDataFrame([(0, 0, "main"), (0, 0, "main"), (1, 0, None), (None, 0, "main")], "page_id bigint, region_ord int, role string")
    pages = spark.createDataFrame([(0, None, None, T0), (1, LONG, "www.shopname.example", T0), (None, "x", "s", T0)], "page_id bigint, title string, site string, received_at timestamp")
    plain = sorted(r.element_key for r in boilerplate.main_content(df, regions, pages).collect())
    assert plain == sorted(r.element_key for r in boilerplate.main_content(_clashing(df), _clashing(regions), _clashing(pages)).collect()) and {3, 7} <= set(plain) and len(plain) == len(set(plain)) and 6 not in plain
    assert boilerplate.main_content(df.limit(0), regions.limit(0), pages.limit(0)).count() == 0
    pairs = sorted(map(tuple, canonical.lookalike_pairs(_clashing(df)).collect()))
    assert pairs == [] == canonical.lookalike_pairs(df.limit(0)).collect()
    same = df.withColumn("page_id", F.lit(1))
    assert sorted(map(tuple, canonical.lookalike_pairs(_clashing(same)).collect())) == [(4, 5, "label"), (4, 5, "text")]
    assert sorted(r.record_key for r in residue.residue_rows(_clashing(df), "element_key", "text").collect()) == [6]


def test_documents_of_any_kind(spark):
    rows = [(1, LONG, "a", T0), (1, LONG, "a", T0), (2, "", "a", T0), (3, None, "a", T0), (4, "  \n ", None, T0), (5, "Shut up, you rotten toad.", "b", None), (None, "x", "b", T0), (6, "Shut up, you rotten toad.", "b", T0), (7, "🚢" * 50, "b", T0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, received_at timestamp")
    labels = spark.createDataFrame([(5, 1), (1, 0), (None, 1), (6, None), (99, 1)], "doc_id bigint, toxic int")
    for docs in (df, _clashing(df), df.drop("received_at")):
        scored = {r.doc_id: r.score for r in toxicity.scores(docs, _clashing(labels.withColumnRenamed("toxic", "y")).drop("toxic").withColumnRenamed("y", "toxic")).collect()}
        assert set(scored) == {1, 4, 5, 6, 7} and scored[6] == scored[5] > 0.5 > scored[1]
        packed = packing.pack(docs, spark.createDataFrame([("a", 512), ("b", None), (None, 64)], "pack_name string, capacity_tokens int"))
        assert {r.doc_id for r in packed.filter("pack_name = 'a'").collect()} == {1, 4, 5, 6, 7} and packed.filter("doc_id = 1 and pack_name = 'a'").agg(F.sum("tokens")).first()[0] == len(tokenizer.encoding().encode_ordinary(LONG))
        mixed = mixing.mix(docs, spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, None), (None, "b", 0.5, 1), ("m", "c", None, 1)], "mix_name string, source string, target_share double, max_repeats int"))
        assert {r.source for r in mixed.collect()} <= {"a"}
    rates = {r.source: r.documents for r in toxicity.source_rates(df, labels).collect()}
    assert rates == {"a": 1, "": 1, "b": 3}
