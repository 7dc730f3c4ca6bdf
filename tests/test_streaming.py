import json
import time
from datetime import datetime, timedelta


from treelake.streaming import state

T0 = datetime(2026, 1, 1)


def run(spark, tmp_path, batches, schema, build, name):
    """All batches through a stream, one file a batch."""
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}_state")).start()
    # state with a time limit keeps a query running for ever: it is stopped when all rows are through
    wanted, deadline = sum(map(len, batches)), time.monotonic() + 120
    while time.monotonic() < deadline and query.isActive and sum(p["numInputRows"] for p in query.recentProgress) < wanted:
        time.sleep(0.2)
    query.stop()
    assert query.exception() is None
    return spark.table(name).collect()


def tree(**texts):
    return json.dumps({"regions": [{"id": "r", "elements": [{"id": i, "text": t} for i, t in texts.items()]}]})


def test_mutations(spark, tmp_path):
    schema = "session_id string, som_cursor bigint, received_at timestamp, current_som string"
    batches = [[("s", 1, T0, tree(a="1", b="1"))], [("s", 2, T0, tree(a="2", c="1")), ("s", 2, T0 + timedelta(1), tree(a="9"))], [("s", 3, T0, "{torn")]]
    got = run(spark, tmp_path, batches, schema, state.observe_mutations, "mutations")
    assert [tuple(r)[1:] for r in got] == [(1, "snapshot", 2, 0, 0), (2, "mutations", 1, 1, 1), (2, "unchanged", 0, 0, 0)]


def test_cache_outcomes(spark, tmp_path):
    schema = "fetch_id bigint, url string, fetched_at timestamp, content_hash string"
    at = [T0 + timedelta(minutes=m) for m in (0, 1, 2, 60)]
    batches = [[(i, "https://a/b#" + str(i), t, h)] for i, (t, h) in enumerate(zip(at, "xxyy"))]
    got = run(spark, tmp_path, batches, schema, state.cache_stream, "outcomes")
    assert {r.fetch_id: r.outcome for r in got} == {0: "miss", 1: "hit", 2: "stale", 3: "expired"}


def test_trace_numbers_survive_eviction(spark, tmp_path):
    schema = "session_id string, at timestamp, action string, payload string"
    batches = [[("s", T0 + timedelta(seconds=10 * b + i), "click", "x" * (9000 if i == 2 else 10)) for i in range(3)] for b in range(2)]
    got = run(spark, tmp_path, batches, schema, lambda s: state.trace_stream(s, most_events=4), "trace")
    assert [(r.sequence, r.first_retained, r.retained) for r in sorted(got, key=lambda r: r.sequence)] == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 2, 4), (6, 3, 4)]
    assert {len(r.payload) for r in got} == {10, 0}


def test_append_sink(spark, tmp_path):
    schema = "recorded_at timestamp, operation string, representation string, url string, selector string, source_html_bytes bigint, delivered_bytes bigint"
    spark.createDataFrame([(T0, "o", "som", "u", None, 5, 9), (T0, "o", "som", "u", None, 9, None)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = state.append_json(state.measurements(stream), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert len(rows) == 2 and {r.bytes_not_delivered for r in rows} == {0, None} and all(len(r.url_sha256) == 64 for r in rows)


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    import pytest

    from treelake.session import checkpoint_dir

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://m:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    bare = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(ValueError):
        checkpoint_dir(bare)
    named = []
    context.setCheckpointDir = named.append
    bare.conf = SimpleNamespace(get=lambda name, default: "hdfs://shared/cut")
    assert checkpoint_dir(bare) == "hdfs://shared/cut" and named == ["hdfs://shared/cut"]
