import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from treelake.operators import drift, nested, snapshots
from treelake.operators.dedupe import latest
from treelake.plans import record_queries
from treelake.sources.payload import as_list, read_tree

TREE = {"regions": [{"id": "r1", "role": "main", "elements": [
    {"id": "a", "role": "select", "attrs": json.dumps({"options": [{"value": "1"}, None, {"value": "2"}]}), "children": {"id": "b", "role": "link"}},
    None,
    {"id": "a", "role": "list", "attrs": {"items": ["x", {"text": "y"}]}, "shadow": {"mode": "open", "elements": [{"id": "c", "role": "link", "children": []}]}},
]}, {"id": "r2", "role": "footer", "elements": None}]}
NODES = [(0, -1, "region"), (1, 0, "element"), (2, 1, "option"), (3, 1, "option"), (4, 1, "child"), (5, 0, "element"), (6, 5, "item"), (7, 5, "item"), (8, 5, "shadow"), (9, -1, "region")]


def test_payloads_are_read_as_delivered():
    text = json.dumps(TREE)
    for payload in (text, "﻿" + text, "[info] page done\n\n" + text, "fetched {3} in 5 ms\n" + text, json.dumps({"ok": True, "som": TREE}), json.dumps({"data": text}), text + "\n-- end", json.dumps(TREE, indent=1), json.dumps(text)):
        assert [n[:3] for n in nested.walk(read_tree(payload))] == NODES, payload[:40]


def test_torn_payloads_give_nothing():
    text = json.dumps(TREE)
    for end in range(1, len(text)):
        assert read_tree(text[:end]) is None, end
    assert read_tree("") is None and read_tree(None) is None and read_tree("null") is None and read_tree('{"a": 1}') is None


def test_collections_in_any_writing():
    assert as_list(None) == [] and as_list({"id": "a"}) == [{"id": "a"}] and as_list({"0": {"id": "a"}, "1": {"id": "b"}}) == [{"id": "a"}, {"id": "b"}]


def test_nodes_of_records(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, json.dumps(TREE), t, "x"), (1, json.dumps(TREE)[:50], datetime(2026, 1, 2), "x"), (2, None, t, "x"), (3, "", t, None), (None, json.dumps(TREE), t, "x"), (4, json.dumps({"regions": []}), t, "x")]
    df = spark.createDataFrame(rows, "record_id bigint, som_json string, received_at timestamp, node_ord string")
    got = sorted((r.record_key, r.node_ord, r.parent_ord, r.kind) for r in nested.emit_nodes(df).collect())
    assert got == [(1, *n) for n in NODES]
    assert nested.emit_nodes(df.limit(0)).count() == 0


def test_typed_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, json.dumps(TREE))], "record_id bigint, som_json string")
    nested.write_tagged(nested.emit_nodes(df), str(tmp_path / "t"))
    options = nested.read_typed(spark, str(tmp_path / "t"), "options").collect()
    assert sorted((o.parent_ord, o.value) for o in options) == [(1, "1"), (1, "2")]
    elements = nested.read_typed(spark, str(tmp_path / "t"), "elements").collect()
    assert {(e.node_ord, e.id, e.kind) for e in elements} == {(1, "a", "element"), (4, "b", "child"), (5, "a", "element"), (8, "c", "shadow")}


def test_latest_is_deterministic(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "c"), (None, 1, "d"), (2, None, "e")], "k int, t int, v string")
    assert sorted((r.k or 0, r.v) for r in latest(df, ["k"], ["t"]).collect()) == [(0, "d"), (1, "b"), (2, "e")]


def _tree(**elements):
    return json.dumps({"regions": [{"id": r, "elements": [{"id": i, **f} for i, (q, f) in elements.items() if q == r]} for r in ("r", "s")]})


def test_session_changes(spark):
    t = [datetime(2026, 1, 1, i) for i in range(5)]
    a, b = _tree(x=("r", {"text": "1"}), y=("r", {"text": "1", "label": None, "attrs": {}})), _tree(x=("s", {"text": "1"}), y=("r", {"text": "1", "hints": []}), z=("r", {}))
    rows = [
        ("q", 1, t[0], a, None), ("q", 2, t[1], a, None), ("q", 2, t[2], b, None), ("q", 4, t[0], b, a), ("q", 5, t[0], a, a),
        ("p", 3, t[0], b, None), (None, 1, t[0], a, None), ("o", 1, t[0], None, a), ("o", 2, t[0], a, "{broken"),
    ]
    df = spark.createDataFrame(rows, "session_id string, som_cursor bigint, received_at timestamp, current_som string, previous_som string")
    got = sorted(tuple(r) for r in snapshots.session_changes(df).collect())
    up, down = [("x", "changed"), ("z", "added")], [("x", "changed"), ("z", "removed")]
    assert got == sorted([("q", 2, *c) for c in up] + [("q", 4, *c) for c in up] + [("q", 5, *c) for c in down])
    assert snapshots.session_changes(df.limit(0)).count() == 0


def test_diff_of_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n"), (4, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "m"), (4, None)], "k int, v string")
    got = {(r.k, r.change) for r in snapshots.diff(old, new, ["k"]).collect()}
    # the second copy of key 2 is left over on the old side only
    assert got == {(2, "removed"), (3, "added"), (None, "changed")}
    assert snapshots.diff(new, new, ["k"]).count() == 0
    assert {r.change for r in snapshots.diff(old.limit(0), new, ["k"]).collect()} == {"added"}


def test_schema_changes(spark):
    opened = datetime(2026, 1, 2)
    early = datetime(2026, 1, 1)

    def lines(seq, *objects, written=opened):
        return [("f", seq, n, opened, written, o if isinstance(o, str) or o is None else json.dumps(o)) for n, o in enumerate(objects)]

    one = [{"id": f"src-{w}", "size": 1000 + i, "ok": i % 2 == 0, "tags": [{"k": "v"}], "n": None} for i, w in enumerate(("alpha", "beta", "gamma", "delta", "omega"))]
    three = [{"source_id": o["id"], "size": str(o["size"]), "ok": o["ok"], "extra": "zz"} for o in one]
    rows = lines(1, *one, '{"torn": ', None) + lines(1, {"early": 1}, written=early) + lines(3, *three) + lines(3, three[0])
    df = spark.createDataFrame(rows, "feed string, file_seq int, line_no int, opened_at timestamp, written_at timestamp, payload string")
    changes = drift.schema_changes(df)
    got = sorted(tuple(r) for r in changes.collect())
    assert got == [("f", 3, "extra", "", "added"), ("f", 3, "id", "source_id", "renamed"), ("f", 3, "size", "", "retyped"), ("f", 3, "tags[].k", "", "removed")]
    values = drift.consistent_values(drift.path_values(df), changes)
    table = drift.project(values, {"id": "string", "size": "bigint"}).collect()
    assert {(r.id, r.size) for r in table} == {(o["id"], o["size"]) for o in one} and all(r.failed_casts == 0 for r in table)
    bad = drift.failed_casts(values, {"id": "bigint"}).collect()
    assert sum(r.n_failed for r in bad) == sum(r.n_values for r in bad) > 0
    assert drift.schema_changes(df.limit(0)).count() == 0


def test_all_feeds_are_in_the_consistent_table(spark, tmp_path):
    t = datetime(2026, 1, 2)
    som = {"som_version": "0.2", "meta": {"html_bytes": "many"}, "regions": [{"id": "r", "elements": [{"id": "b", "attrs": {"level": 2}}, {"id": "a", "attrs": {"level": "two"}}]}]}
    payloads = {"measurement-a": [{"source_id": "s", "delivered_bytes": 5, "http_status": 200}, {"unheard_of": True}], "som-b": [som]}
    rows = [(f, 1, n, t, t, json.dumps(o)) for f, objects in payloads.items() for n, o in enumerate(objects)]
    spark.createDataFrame(rows, "feed string, file_seq int, line_no int, opened_at timestamp, written_at timestamp, payload string").write.parquet(str(tmp_path / "feed_lines.parquet"))
    got = {(r.feed, r.line_no): r for r in record_queries.p7_measurements(spark, str(tmp_path)).collect()}
    assert set(got) == {("measurement-a", 0), ("measurement-a", 1), ("som-b", 0)}
    assert got["measurement-a", 0].http_status == 200 and [tuple(o) for o in got["measurement-a", 1].others] == [("unheard_of", "", "boolean", "true")]
    page = got["som-b", 0]
    assert page.som_version == "0.2" and page.meta_html_bytes is None and page.failed_casts == 2 and page.regions_elements_id == ["b", "a"] and page.regions_elements_attrs_level == [2]
    assert [tuple(o) for o in page.others] == [("meta.html_bytes", "", "string", "many"), ("regions[].elements[].attrs.level", "0.1", "string", "two")]
    casts = {(r.field, r.raw_type): (r.n_values, r.n_failed) for r in record_queries.p7_failed_casts(spark, str(tmp_path)).collect()}
    assert casts["regions[].elements[].attrs.level", "string"] == (1, 1) and casts["regions[].elements[].id", "string"] == (2, 0) and casts["meta.html_bytes", "string"] == (1, 1) and casts["unheard_of", "boolean"] == (1, 0)


def test_states_with_marks_and_repeated_keys_are_read(spark):
    tree = '{"regions":[{"id":"r","elements":[{"id":"%s","role":"link"}]}]}'
    rows = [("s", 1, None, "\ufeff" + tree % "a", None), ("s", 2, None, tree.replace('"role":"link"', '"role":"x","role":"link"') % "b", None), ("s", 3, None, tree[:-3] % "c", None), ("t", 5, None, tree % "a", tree % "d"), ("t", 7, None, tree % "a", "torn {"), ("u", 2, None, '{"regions":[]}', tree % "a")]
    df = spark.createDataFrame(rows, "session_id string, som_cursor bigint, received_at timestamp, current_som string, previous_som string")
    want = [("s", 2, "a", "removed"), ("s", 2, "b", "added"), ("t", 5, "a", "added"), ("t", 5, "d", "removed"), ("u", 2, "a", "removed")]
    assert sorted(map(tuple, snapshots.session_changes(df).collect())) == want
    assert sorted(map(tuple, snapshots.session_changes(df.drop("received_at").withColumn("tie", F.lit(1)).withColumn("state", F.lit(2))).collect())) == want


def test_a_torn_delivery_never_hides_a_whole_one(spark):
    whole = '\ufefflog line\n{"regions":[{"id":"r","id":"r2","elements":[{"id":"a"}]}]}'
    rows = [(1, "2026-01-01", whole), (1, "2026-01-02", whole[:-4]), (2, "2026-01-01", whole), (2, "2026-01-02", '{"regions":[]}'), (3, "2026-01-01", None)]
    df = spark.createDataFrame(rows, "record_id bigint, received_at string, som_json string").withColumn("nodes", F.lit("clash")).withColumn("k", F.lit(0))
    got = [(r.record_key, r.node_ord, r.kind) for r in nested.emit_nodes(df).orderBy("record_key", "node_ord").collect()]
    assert got == [(1, 0, "region"), (1, 1, "element")]


def _put(tree, path, place, value):
    """A value put back at its path and place."""
    steps, at = [], [int(i) for i in place.split(".")] if place else []
    for key in path.split("."):
        name, marks = key.split("[]")[0], key.count("[]")
        steps += [name] + [at.pop(0) for _ in range(marks)]
    for step, following in zip(steps, steps[1:]):
        empty = [] if isinstance(following, int) else {}
        if isinstance(step, int):
            tree.extend([None] * (step + 1 - len(tree)))
            tree[step] = empty if tree[step] is None else tree[step]
        else:
            tree.setdefault(step, empty)
        tree = tree[step]
    if isinstance(steps[-1], int):
        tree.extend([None] * (steps[-1] + 1 - len(tree)))
    tree[steps[-1]] = value


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_path_value_maps_hold_the_whole_line(spark, broadcast, monkeypatch):
    monkeypatch.setattr(drift, "MOST_BROADCAST", broadcast)
    line = {"a": "x", "b": {"c": [{"d": 1, "e": [True, False]}, {"d": 2.5}]}, "f": ["p", "q"]}
    t = datetime(2026, 1, 2)
    texts = [json.dumps(line), json.dumps(line), "{torn", "{}", None]
    rows = [("m", 1, n % 4, t, t, x) for n, x in enumerate(texts)] + [("m", 1, 0, t, t, texts[0]), ("m", 1, 9, t, datetime(2026, 1, 1), texts[0])]
    df = spark.createDataFrame(rows, "feed string, file_seq int, line_no int, opened_at timestamp, written_at timestamp, payload string").withColumn("vals", F.lit("clash")).withColumn("names", F.lit("clash"))
    values = drift.consistent_values(drift.path_values(df), drift.schema_changes(df))
    got = values.orderBy("line_no").collect()
    assert [(r.line_no, len(r.vals)) for r in got] == [(0, 7), (1, 7), (3, 0)]
    built: dict = {}
    for v in got[0].vals:
        _put(built, v.field, v.place, v.value if v.raw_type == "string" else json.loads(v.value))
    assert built == line
    table = {r.line_no: r for r in drift.project(values, {"a": "string", "b.c[].d": "double", "f[]": "bigint"}, rest=True).collect()}
    assert table[0].a == "x" and table[0].b_c_d == [1.0, 2.5] and table[0].f == [] and table[0].failed_casts == 2 and len(table[0].others) == 4 and table[3].a is None and table[3].others == []
    assert drift.project(values.limit(0), {"a": "string"}).count() == 0


def test_nodes_with_their_ancestors(spark):
    other = json.dumps({"regions": [{"id": "r", "elements": [{"id": "x", "role": "image"}]}]})
    df = spark.createDataFrame([(1, json.dumps(TREE)), (2, other)], "record_id bigint, som_json string")
    nodes = nested.emit_nodes(df)
    got = {(r.record_key, r.node_ord): r.matched for r in nested.with_ancestors(nodes, F.get_json_object("node", "$.role") == "link").collect()}
    assert got == {(1, 0): False, (1, 1): False, (1, 4): True, (1, 5): False, (1, 8): True, (2, 0): False, (2, 1): False}
    assert nested.with_ancestors(nodes.limit(0), F.lit(True)).count() == 0


def test_patch_operations(spark):
    df = spark.createDataFrame([("s", 1, "a/b~c", "added"), ("s", 1, "d", "removed"), ("s", 1, "e", "changed")], "session_id string, som_cursor bigint, element_id string, change string")
    assert [tuple(r)[2:] for r in snapshots.patch_operations(df).collect()] == [("add", "/elements/a~1b~0c"), ("remove", "/elements/d"), ("replace", "/elements/e")]


def test_links_are_resolved(spark):
    from treelake.functions import urls

    cases = {("https://a.b/c/d?x#y", "e"): "https://a.b/c/e", ("https://a.b/c/d", "../e"): "https://a.b/e", ("https://a.b/c", "/e"): "https://a.b/e", ("https://a.b/c", "//x.y/z"): "https://x.y/z", ("https://a.b/c", "mailto:x"): "mailto:x", ("https://a.b/c", " "): None, (None, "/x"): "/x", ("https://a.b/c", None): None}
    df = spark.createDataFrame([(b, h, w) for (b, h), w in cases.items()], "b string, h string, w string")
    assert df.select(urls.resolve("b", "h").eqNullSafe(F.col("w")).alias("ok")).filter("not ok").count() == 0


def test_all_tables_come_from_one_pass(spark, tmp_path):
    spark.createDataFrame([(1, json.dumps(TREE)), (2, "{torn")], "record_id bigint, som_json string").write.parquet(str(tmp_path / "som_records.parquet"))
    got = sorted((r.node_ord, r.parent_ord, r.kind) for r in record_queries.p2_tables(spark, str(tmp_path)).collect())
    assert got == NODES
    by_tag = {(r.tag, r.node_ord): (r.id, r.role, r.text, r.value) for r in record_queries.p2_tables(spark, str(tmp_path)).collect()}
    assert by_tag["options", 2] == (None, None, None, "1") and by_tag["items", 6] == (None, None, "x", None) and by_tag["elements", 8] == ("c", "link", None, None) and by_tag["regions", 9][:2] == ("r2", "footer")
    only = nested.emit_nodes(spark.createDataFrame([(1, json.dumps(TREE))], "record_id bigint, som_json string"), payloads=["options"]).collect()
    assert all((r.node is not None) == (r.tag == "options") for r in only) and len(only) == len(NODES)
