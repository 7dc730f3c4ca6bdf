import gzip
import json
import zlib

from pyspark.sql import functions as F

from treelake.operators import contracts, discovery, policy
from treelake.sources import readers


def test_scripts():
    html = '<script>a()</script><script type="application/ld+json">{}</script><script type=module src=/m.js></script><script type=importmap>{"imports":{}}</script><script> </script><script type="text/x-unknown">x</script>'
    assert [(s["kind"], s["is_inline"], s["label"]) for s in discovery.scripts_of(html)] == [("classic", True, "inline-0"), ("module", False, "/m.js"), ("import_map", True, "inline-2")]


def test_script_budget(spark):
    df = spark.createDataFrame([(1, "<p>none"), (2, "<script>aaaa</script><script>bb</script><script>c</script>"), (3, None)], "page_id int, html string")
    rows = discovery.scripts(df)
    assert rows.count() == 3
    assert discovery.within_budget(rows, "page_id", "index", F.length("source"), 3, 6).count() == 2


def test_catalog_discovery(spark):
    sites = spark.createDataFrame([("https://a.b", '<link rel="x AI-catalog" href="/c.json"><link rel=ai-catalog href="http://no">', "Agentmap: https://m.n/x # note\nagentmap:\n"), ("https://e.f", None, None)], "origin string, html string, robots_txt string")
    got = {(r.origin, r.url, r.source) for r in discovery.catalog_candidates(sites).collect()}
    assert got == {("https://a.b", "https://a.b/.well-known/ai-catalog.json", "well_known"), ("https://a.b", "https://a.b/c.json", "html_link"), ("https://a.b", "https://m.n/x", "agentmap"), ("https://e.f", "https://e.f/.well-known/ai-catalog.json", "well_known")}


def test_catalog_entries(spark):
    good = {"identifier": "urn:air:a.b:tool", "displayName": "T", "type": "application/json", "url": "https://a.b/t"}
    bad = [{**good, "identifier": "x"}, {**good, "type": "json"}, {**good, "data": {}}, {**good, "url": "http://a.b"}, 5]
    body = json.dumps({"specVersion": "1.0", "host": {"displayName": "H"}, "entries": [good, *bad, good]})
    df = spark.createDataFrame([("https://a.b/c", body), ("https://c.d/c", body), ("https://e.f/c", "{"), ("https://g.h/c", None)], "catalog_url string, body string")
    rows = discovery.catalogs(df).collect()
    assert len([r for r in rows if r.error is None]) == 1 and next(r for r in rows if r.error is None).publisher_is_host
    assert sum(r.error == "duplicate entry identifier" for r in rows) == 3 and sum(r.error == "malformed JSON" for r in rows) == 1


def test_tools(spark):
    html = '<form toolname="find" tooldescription="Finds"><label for=q>Query</label><input id=q name=q required><input type=number name=n><select name=s><option value=a>A<option>B</select><input name=x disabled></form><form toolname=only></form>'
    df = spark.createDataFrame([(1, "https://a", html), (2, "http://a", html)], "page_id int, url string, html string")
    rows = discovery.tools(df).collect()
    assert len(rows) == 1
    schema = json.loads(rows[0].input_schema)
    assert schema["required"] == ["q"] and schema["properties"]["s"]["enum"] == ["a", "B"] and schema["properties"]["n"]["type"] == "number" and schema["properties"]["q"]["description"] == "Query"
    assert contracts.schema_error({"q": "x", "n": 3, "s": "B"}, schema) is None and "missing" in contracts.schema_error({"n": 1}, schema) and "enum" in contracts.schema_error({"q": "", "s": "C"}, schema)


def test_schema_keywords():
    e = contracts.schema_error
    assert e(True, {"type": "integer"}) and e([1, "a"], {"type": "array", "items": {"type": "number"}}) == "$[1] must be number" and e(1, {"const": 1}) is None
    assert e(1, {"anyOf": [{"type": "string"}]}) and e(1, {"oneOf": [{"type": "number"}, {"const": 1}]}) and e(1, {"allOf": [{"type": "number"}, {"const": 1}]}) is None and e(1, {"type": "odd"})


def test_insufficiency(spark):
    df = spark.createDataFrame([("<canvas>", 1), ("x" * 2000, 2), ("<map>", 0), ("ok", 9)], "html string, n int")
    got = [r.r for r in df.select(discovery.insufficiency(F.col("html"), F.col("n")).alias("r")).collect()]
    assert got == [["canvas_heavy_structure"], ["meaningful_structure_near_empty"], ["meaningful_structure_empty", "image_map_or_image_control_evidence"], []]
    modes = df.limit(1).select(*(discovery.visual_trigger(discovery.insufficiency(F.col("html"), F.col("n")), m).alias(m) for m in ("never", "auto", "always"))).first()
    assert (modes.never.attempted, modes.auto.attempted, modes.always.reasons) == (False, True, ["explicit_always_mode"])


def test_plans_and_expectations(spark):
    steps = spark.createDataFrame([("a", 0, "s", "open_page", None), ("a", 1, "t", "click", True), ("b", 0, "s", "click", None), ("b", 1, "s", "odd", None)], "plan_id string, step_ord int, step_id string, tool string, confirmed boolean")
    got = {tuple(r) for r in contracts.plan_errors(steps, ["open_page", "click"], ["click"]).collect()}
    assert got == {("b", e) for e in ("duplicate step id", "first step must open the page", "exactly one open_page", "unsupported tool", "mutating step needs approval")}
    text = json.dumps({"a": {"b": 3}})
    rows = spark.createDataFrame([("{}", False, None, None), (json.dumps({"result": {"isError": True}}), False, None, None), *((json.dumps({"result": {"content": [{"text": text}]}}), False, p, e) for p, e in (("$.a.b", "3"), ("$.a.c", None), ("$.a.b", "4")))], "r string, e boolean, p string, q string")
    assert [r.o for r in rows.select(contracts.expectation(F.col("r"), F.col("e"), F.col("p"), F.col("q")).alias("o")).collect()] == ["missing_result", "tool_error_expectation", "ok", "expectation_path_missing", "expectation_mismatch"]


def test_replay_cascade(spark):
    base = {"trace_id": "t", "log_trace_id": "t", "event_action": "click", "origin": "o", "event_origin": "o", "url_key": "u", "event_url_key": "u", "has_target": True, "matching_targets": 1, "target_offers": True, "state_key": "s", "event_state_key": "s", "confirmed": True}
    changes = {"cross_session": {"trace_id": "x"}, "event_not_retained": {"event_action": None}, "unsupported_action": {"event_action": "evaluate"}, "origin_drift": {"origin": "x"}, "page_drift": {"url_key": "x"}, "target_missing": {"matching_targets": 0}, "target_ambiguous": {"matching_targets": 2}, "action_unavailable": {"target_offers": False}, "state_drift": {"state_key": None}, "confirmation_required": {"confirmed": None}, "validated": {}}
    schema = "trace_id string, log_trace_id string, event_action string, origin string, event_origin string, url_key string, event_url_key string, has_target boolean, matching_targets int, target_offers boolean, state_key string, event_state_key string, confirmed boolean"
    df = spark.createDataFrame([tuple((base | c).values()) for c in changes.values()], schema)
    assert [r.status for r in contracts.replay_status(df).collect()] == list(changes)


def test_report_invariants(spark):
    results = spark.createDataFrame([("a", "ok"), ("b", "failed"), ("b", "odd")], "input_url string, status string")
    summary = spark.createDataFrame([(3, 1, 0, 2)], "total int, ok int, blocked int, failed int")
    assert {r.rule for r in contracts.report_violations(results, summary).collect()} == {"failed", "status", "urls"}


def test_cookies_as_set():
    c = contracts.set_cookie("a=b; Domain=x.y; Max-Age=5; Secure; SameSite=strict", "https://w.x.y/p/q", 100.0)
    assert c == {"name": "a", "value": "b", "domain": ".x.y", "path": "/p", "expires": 105.0, "secure": True, "http_only": False, "same_site": "Strict"}
    assert contracts.set_cookie("nothing", "https://a", 0) is None and contracts.set_cookie("a=", "https://a/", 0)["path"] == "/"
    assert contracts.set_cookie("a=1; Expires=Wed, 21 Oct 2026 07:28:00 GMT", "https://a/", 0)["expires"] == 1792567680.0


def test_readers(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# list\n\n https://a \nhttps://b\n")
    assert [r.url for r in readers.url_list(spark, str(tmp_path / "u.txt")).orderBy("line_no").collect()] == ["https://a", "https://b"]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "1.html").write_text("<p>a\n\nb")
    assert readers.html_files(spark, str(tmp_path / "h")).first().html == "<p>a\n\nb"
    assert readers.decode_body(gzip.compress(b"x"), "gzip") == b"x" and readers.decode_body(zlib.compress(b"x"), "deflate") == b"x" and readers.decode_body(b"x", None) == b"x"
    assert readers.decode_body(b"x", "gzip") is None and readers.decode_body(gzip.compress(b"x" * 99), "gzip", 10) is None and readers.decode_body(b"x", "odd") is None


def test_large_robots_files():
    text = "User-agent: a\n" + "Disallow: /p\n" * 12_000 + "Disallow: /last\nDisallow: /" + "x" * 20_000
    rules = policy.robots_rules(text)
    assert len(rules) == 12_003 and rules[-2][3] == "/last" and len(rules[-1][3]) == 20_001
    rules = policy.robots_rules("User-agent: a\nUser-agent: b\n" + "".join(f"Disallow: /{i}\n" for i in range(40_000)))
    assert len(rules) == 2 + 2 * 40_000 and rules[-1][3] == "/39999"
    rules = policy.robots_rules("User-agent: a\n" + "Disallow: /p\n" * 65_540)
    assert len(rules) == 65_536 + 2 and rules[-1] == (-1, "", "rules_omitted", "", 4)
    assert policy.robots_rules("User-agent: a\n# " + "x" * 512_000)[-1] == (-1, "", "lines_over_limit", "", 1)


def test_rule_regexes_match_as_rules_do(spark):
    rules = ["/a", "/a*b$", "/*.php$", "/a*", "/a*$", "/$", "/*a*b", "/a.b", "/%2A"]
    paths = ["/a", "/ab", "/axbxb", "/x.php", "/x.php/y.php", "/", "/acb", "/%2A", "/x.php5"]
    df = spark.createDataFrame([(r, policy.rule_regex(r), p) for r in rules for p in paths], "rule string, regex string, path string")
    got = df.select("rule", "path", F.regexp_like("path", F.col("regex")).alias("hit")).collect()
    assert all(r.hit == policy.rule_matches(r.rule, r.path) for r in got) and any(r.hit for r in got)


def test_robots_fetches_that_fail(spark):
    long = "User-agent: *\nAllow: /\n# " + "x" * 512_000
    cases = {
        "ok": ("User-agent: *\nDisallow: /x", 200, None), "gone": (None, 404, None), "down": (None, 503, None), "big": (None, None, "too_large"), "slow": (None, None, "timeout"), "blocked": (None, None, "blocked"), "long": (long, 200, None), "empty": (None, 200, None),
    }
    fetches = spark.createDataFrame([(h, *c) for h, c in cases.items()], "host string, robots_txt string, http_status int, failure string")
    targets = spark.createDataFrame([(h, "/x") for h in [*cases, "unknown"]] + [("long", "/robots.txt"), (None, "/x"), ("ok", "/x")], "host string, path string")
    got = {(r.host, r.path): (r.allowed, r.reason, r.classification, r.checks_completed) for r in policy.robots_policies(targets, fetches, "spider").collect()}
    assert got == {
        ("ok", "/x"): (False, "disallow_rule", "available", 1), ("gone", "/x"): (True, "robots_unavailable", "unavailable", 1), ("down", "/x"): (False, "robots_unreachable", "unreachable", 1), ("big", "/x"): (False, "robots_invalid", "invalid_too_large", 0),
        ("slow", "/x"): (False, "robots_unreachable", "unreachable", 0), ("blocked", "/x"): (False, "robots_unreachable", "blocked_redirect_or_destination", 0), ("long", "/x"): (False, "robots_invalid_line_limit", "available", 1), ("long", "/robots.txt"): (False, "robots_invalid_line_limit", "available", 1),
        ("empty", "/x"): (True, "no_matching_rule", "available", 1), ("unknown", "/x"): (False, "robots_unreachable", "unreachable", 0),
    }
    assert policy.robots_policies(targets.limit(0), fetches, "spider").count() == 0


def test_ordered_digests(spark):
    from treelake.functions import digests

    rows = [("a", i, f"https://a/{'é' * i}") for i in range(50)] + [("b", 1, "x"), ("b", 0, None), (None, 1, "y")]
    df = spark.createDataFrame(rows, "site string, n int, url string").repartition(5)
    got = {r.site: (r.digest, r.n) for r in digests.ordered_digests(df.withColumnRenamed("n", "at"), "t", "site", ["at"], "url").collect()}
    assert got == {"a": (digests.corpus_digest("t", [u for s, _, u in rows if s == "a"]), 50), "b": (digests.corpus_digest("t", ["x"]), 1)}


def test_bounds_of_tools(spark, monkeypatch):
    form = '<form toolname="%s" tooldescription="' + "d" * 100 + '"></form>'
    html = "".join(form % f"t{i:02}" for i in range(70))
    df = spark.createDataFrame([(1, "https://a", html)], "page_id int, url string, html string")
    assert discovery.tools(df).count() == 64
    monkeypatch.setattr(discovery, "MOST_TOOL_BYTES", 400)
    assert [r.name for r in discovery.tools(df).orderBy("name").collect()] == ["t00", "t01"]


def test_catalog_summary(spark):
    def entry(name, **more):
        return {"identifier": f"urn:air:{name}", "displayName": "d", "type": "text/plain", "url": "https://x.y/z"} | more

    good = json.dumps({"host": {"displayName": "h"}, "entries": [entry("a.b:x"), entry("c.d:y"), entry("c.d:y"), entry("bad"), 3]})
    bodies = spark.createDataFrame([("https://a.b/c.json", good), ("https://e.f/c.json", "{torn")], "catalog_url string, body string")
    got = discovery.catalog_summary(bodies, discovery.catalogs(bodies)).first().asDict()
    assert got == {"catalogs": 2, "catalogs_failed": 1, "entries": 5, "entries_valid": 2, "entries_invalid": 3, "duplicates": 1, "publishers": 2, "publishers_verified": 1}
    assert discovery.catalog_summary(bodies.limit(0), discovery.catalogs(bodies.limit(0))).first().entries == 0
