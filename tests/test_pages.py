from datetime import datetime

from pyspark.sql import functions as F

from treelake.functions import digests, text, urls
from treelake.operators import elements as E
from treelake.operators import page_diff, policy, scores

ELEMENT = "element_key bigint, page_id bigint, region_ord int, el_ord int, id string, html_id string, role string, text string, label string, actions array<string>, hints array<string>, attrs string, region_id string, region_role string, action string, method string"


def rows(spark, *given):
    base = {"html_id": None, "role": "paragraph", "text": None, "label": None, "actions": None, "hints": None, "attrs": None, "region_id": "r_main", "region_role": "main", "action": None, "method": None, "region_ord": 0, "page_id": 1}
    full = [base | {"element_key": i, "el_ord": i, "id": f"e{i}"} | g for i, g in enumerate(given)]
    names = [c.split()[0] for c in ELEMENT.split(", ")]
    return spark.createDataFrame([tuple(f[n] for n in names) for f in full], ELEMENT)


def keys(df):
    return sorted(r.element_key for r in df.collect())


def test_selectors_fall_back_to_the_page(spark):
    df = rows(spark, {"role": "link", "actions": ["click"]}, {"region_role": "footer", "region_id": "r_footer", "html_id": "x"}, {"role": None, "region_role": None, "region_id": None}, {"page_id": 2, "role": "image"})
    assert keys(E.select(df, "main")) == [0, 3] and keys(E.select(df, "link")) == [0, 3] and keys(E.select(df, "Action: CLICK")) == [0, 3]
    assert keys(E.select(df, "img")) == [0, 1, 2, 3] and keys(E.select(df, "#r_footer")) == [1, 3] and keys(E.select(df, "#x")) == [1, 3]
    assert keys(E.select(df, "unknown")) == [0, 1, 2, 3] and keys(E.select(df.limit(0), "main")) == []


def test_action_plan_states(spark):
    df = rows(spark, *({"role": "button", "actions": ["click"], "attrs": a} for a in ('{"disabled":true}', '{"inert":true,"disabled":true}', '{"readonly":true}', '{"readonly":true,"inert":false}', "[1]", None)))
    assert [r.blocked_reason for r in E.action_plan(df).orderBy("el_ord").collect()] == ["disabled", "inert", "readonly", None, None, None]


def test_action_key():
    parts = ["e1", "link", "A", "click", None, "/a", None, None, None]
    assert digests.action_key(parts) == digests.action_key(parts[:4] + ["", "/a", "", None, ""]) != digests.action_key(["e2", *parts[1:]])
    assert digests.fnv1a32(b"a") == 0xE40C292C and digests.fnv1a32(b"") == 0x811C9DC5


def test_text_functions(spark):
    assert text.normalize_text("é" * 150) == "é" * 150 and len(text.normalize_text("word " * 60).encode()) <= 203
    assert text.smart_truncate("One sentence here. " * 9, 100).endswith(".") and text.smart_truncate("x" * 300, 200) == "x" * 197 + "..."
    df = spark.createDataFrame([("a   b c", "btn btn-primary btn-lg"), (None, None), ("", "discard-stage")], "t string, c string")
    got = df.select(text.truncate(F.col("t"), 6).alias("t"), text.class_hints(F.col("c")).alias("h"), text.region_hint(F.col("c"), F.lit("top-nav")).alias("r")).collect()
    assert [r.t for r in got] == ["a b c", None, ""] and [r.h for r in got] == [["large", "primary"], None, ["badge"]] and {r.r for r in got} == {"navigation"}


def test_urls(spark):
    df = spark.createDataFrame([("https://a.b/c/#x",), ("https://a.b",), ("HTTP://U@A.b:81/?q=/",), (None,)], "u string")
    got = df.select(urls.cache_key(F.col("u"), F.lit("Main")).alias("k"), urls.origin(F.col("u")).alias("o")).collect()
    assert got[0].k == "https://a.b/c::selector=main" and got[1].k == "https://a.b/::selector=main" and got[3].k is None
    assert [r.o for r in got] == ["https://a.b:443", "https://a.b:443", "http://a.b:81", None]
    cases = {"ftp://a": "scheme", "http://u:p@a": "credentials", "http://metadata/": "metadata", "http://10.0.0.1": "address", "http://[::1]/": "address", "http://8.8.8.8": None, "https://[2600::1]/": None, "nope": "invalid", "http://100.64.0.1": "address"}
    assert {u: urls.outbound_reason(u) for u in cases} == cases
    import re

    for pattern, url, hit in [("*", "x", True), ("a*c", "abbc", True), ("a.c", "abc", False), ("*.js", "a.js", True), ("a*b*", "ab", True)]:
        assert bool(re.match(urls.glob_regex(pattern), url)) is hit


def test_robots(spark):
    assert policy.rule_matches("/a", "/abc") and policy.rule_matches("/*.php", "/x.php5") and not policy.rule_matches("/*.php$", "/x.php5")
    assert not policy.rule_matches("/*.php$", "/x.php.php") and policy.rule_matches("/*.php$", "/x.php") and policy.rule_matches("/a*$", "/abc")
    assert policy.normal_path("/%7ea%2fb*é", False) == "/~a%2Fb%2A%C3%A9" and policy.specificity("/a*%2Fb$") == 4
    text_ = "User-agent: a\nUser-agent: b\nDisallow: /x\nUser-agent: *\nDisallow:\nAllow: /x/y # note\n"
    assert {(g, a, d, r) for g, a, d, r, _ in policy.robots_rules(text_)} == {(0, "a", "", ""), (0, "b", "", ""), (0, "a", "disallow", "/x"), (0, "b", "disallow", "/x"), (1, "*", "", ""), (1, "*", "allow", "/x/y")}
    files = spark.createDataFrame([("h", text_), ("e", None)], "host string, robots_txt string")
    targets = spark.createDataFrame([("h", "/x/1"), ("h", "/robots.txt"), ("e", "/x")], "host string, path string")
    got = {(r.host, r.path): (r.allowed, r.reason) for r in policy.robots_decisions(targets, policy.parsed_robots(files), "B").collect()}
    assert got == {("h", "/x/1"): (False, "disallow_rule"), ("h", "/robots.txt"): (True, "robots_txt_implicitly_allowed"), ("e", "/x"): (True, "no_matching_rule")}


def test_intercept_and_cache(spark):
    rules = spark.createDataFrame([(1, "*.js", None, "block"), (2, None, "Image", "log"), (3, "*", None, "mark")], "rule_ord int, url_glob string, resource_type string, action string")
    asked = spark.createDataFrame([(1, "a.js", "Image"), (2, "a.png", "Image"), (3, "a+b", "Document")], "request_id int, url string, resource_type string")
    assert {r.request_id: r.action for r in policy.intercept(asked, rules).collect()} == {1: "block", 2: "log", 3: "mark"}
    assert {r.action for r in policy.intercept(asked, rules.limit(0)).collect()} == {"continue"}
    at = [datetime(2026, 1, 1, 0, m) for m in (0, 1, 2, 30)]
    fetches = spark.createDataFrame([(i, "https://a/b" + "/" * (i % 2), t, h) for i, (t, h) in enumerate(zip(at, "xxyy"))], "fetch_id int, url string, fetched_at timestamp, content_hash string")
    assert [r.outcome for r in policy.cache_outcomes(fetches).orderBy("fetch_id").collect()] == ["miss", "hit", "stale", "expired"]


def test_cookies(spark):
    cookies = spark.createDataFrame([("a", ".x.y", "/", False, None), ("b", "x.y", "/p", True, None), ("c", "x.y", "/", False, datetime(2020, 1, 1))], "name string, domain string, path string, secure boolean, expires timestamp")
    asked = spark.createDataFrame([("http", "w.x.y", "/p/q"), ("https", "x.y", "/p/q"), ("https", "x.y", "/pq")], "scheme string, host string, request_path string")
    hit = asked.crossJoin(cookies).filter(policy.cookie_matches(F.lit(datetime(2026, 1, 1)))).select("scheme", "request_path", "name")
    assert {tuple(r) for r in hit.collect()} == {("http", "/p/q", "a"), ("https", "/p/q", "a"), ("https", "/p/q", "b"), ("https", "/pq", "a")}


def test_ranked_statistics_against_sorting(spark):
    import math
    import random

    values = [random.Random(1).choice([1.0, 2.5, 2.5, 7.0, 100.0, 3.25]) for _ in range(101)] + [float("nan"), None]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = scores.ranked(df, ["g"], "v").first()
    plain = sorted(v for v in values if v is not None and not math.isnan(v))
    n = len(plain)
    assert got.n == n and got.median == (plain[(n - 1) // 2] + plain[n // 2]) / 2 and got.p95 == plain[min(math.ceil(n * 0.95), n - 1)] and got.bench_p95 == plain[math.floor((n - 1) * 0.95 + 0.5)]


def test_page_diff(spark):
    pages = spark.createDataFrame([(1, "u", datetime(2026, 1, 1)), (2, "u", datetime(2026, 1, 2)), (3, None, datetime(2026, 1, 2))], "page_id bigint, url string, captured_at timestamp")
    regions = spark.createDataFrame([(1, 0, "r_main", "main", None), (1, 1, "r_aside", "aside", None), (2, 0, "r_main", "main", "New"), (2, 1, "r_nav", "navigation", None)], "page_id bigint, region_ord int, region_id string, role string, label string")
    els = rows(spark, {"id": "p", "text": "$5"}, {"id": "gone"}, {"id": "side", "region_ord": 1}, {"id": "p", "text": "$6", "page_id": 2}, {"id": "new", "page_id": 2}).drop("region_id", "region_role", "action", "method")
    got = page_diff.summary(els, regions, page_diff.captures(pages)).collect()
    assert len(got) == 1
    r = got[0].asDict()
    assert r == {"pair_id": 2, "regions_added": 1, "regions_removed": 1, "regions_modified": 1, "elements_added": 1, "elements_removed": 1, "elements_modified": 1, "total_changes": 6, "has_price_changes": True, "has_content_changes": True, "has_structural_changes": True}
    same = page_diff.captures(pages).withColumn("new_page", F.col("old_page"))
    assert page_diff.summary(els, regions, same).first().total_changes == 0


def test_budgets_and_links(spark):
    df = rows(spark, *({"role": "link", "attrs": f'{{"href":"{h}"}}', "actions": ["click"]} for h in ("/a", "/a/", "/b#x", "#", "/c")), {"role": "paragraph"}, {"role": "paragraph"})
    assert keys(E.budgets(df, most_links=2, most_paragraphs=1)) == [0, 2, 5]
    assert sorted(r.href for r in E.links(df).collect()) == ["/a", "/a/", "/b#x", "/c"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_element_queries_filter_at_the_scan_and_shuffle_once(spark):
    import re

    from treelake.plans.page_queries import QUERIES

    for name in ("page_headings", "page_links", "link_targets", "first_heading", "first_price", "interactive_elements"):
        plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert len(re.findall(r"Exchange \w", plan)) == 1, (name, plan)
        assert re.search(r"PushedFilters: \[\w", plan), (name, plan)
        read = plan[plan.index("ReadSchema") :]
        assert "html_id" not in read and "received_at" not in read, name


def test_renderers(spark):
    attrs = {
        "list": '{"items":[{"text":"one"},{"text":""},{"text":null}]}', "table": '{"caption":"C","headers":["A","B"],"rows":[["1","2"],[]]}', "select": '{"options":[{"text":"x"},{"text":""}]}', "text_input": '{"placeholder":"p"}', "checkbox": '{"checked":true}', "heading": '{"level":2}', "link": "[1]", "image": None, "separator": None, "section": "torn {",
    }
    df = rows(spark, *({"role": r, "attrs": a, "text": None if r in ("list", "table") else r.upper(), "label": "L" if r in ("text_input", "list") else None} for r, a in attrs.items()))
    assert E.page_text(df).first().content == "L\none\nA | B\n1 | 2\nSELECT\nx\nTEXT_INPUT\nCHECKBOX\nHEADING\nLINK\nIMAGE\nSEPARATOR\nSECTION"
    pages = spark.createDataFrame([(1, "T", "u"), (2, None, None)], "page_id bigint, title string, url string")
    regions = spark.createDataFrame([(1, 0, "main", "Top"), (1, 1, "footer", None)], "page_id bigint, region_ord int, role string, label string")
    got = {r.page_id: r.content for r in E.page_markdown(df, pages, regions).collect()}
    assert got[1] == (
        "# T\nURL: u\n\n## Main: Top\n\n- one\n- \n- \nC\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n\n[Select: SELECT]\n- x\n[Input: L placeholder=\"p\"]\n[x] CHECKBOX\n#### HEADING\n[LINK](#)\n![]()\n---\nSECTION\n\n## Footer\n\n"
    )
    assert got[2] == "# \nURL: \n"
    cut = {r.page_id: r.content for r in E.extract_text(df, pages, 12).collect()}
    assert cut == {1: "T\n\n• one\n• ...", 2: ""} and E.page_text(df.limit(0)).count() == 0
    longer = spark.createDataFrame([("word",), ("twowords",), ("a b c d e f",), (None,)], "t string").select(E.cut_at_space(F.col("t"), 6).alias("t"))
    assert [r.t for r in longer.collect()] == ["word", "twowor...", "a b c...", None]
    budget = spark.createDataFrame([("x" * 8,), ("é" * 5,)], "t string").select(E.within_budget(F.col("t"), 2).alias("t")).collect()
    assert budget[0].t == "x" * 8 and '"original_bytes": 10' in budget[1].t


def test_plan_fields(spark):
    df = rows(spark, {"role": "link", "actions": ["click"], "attrs": '{"href":"/a","rel":"","level":3,"aria":{"expanded":false,"label":"x","checked":"mixed","unknown":1}}'}, {"actions": ["click"], "attrs": '{"checked":false,"aria":{"checked":true,"readonly":true}}'}, {"attrs": '{"href":"/b"}'}, {"actions": ["click"], "attrs": "[1]"}, {"actions": ["click"]})
    got = sorted((r.element_key, r.field, r.value) for r in E.plan_fields(df).collect())
    assert got == [(0, "aria_label", "x"), (0, "checked", "mixed"), (0, "expanded", "false"), (0, "href", "/a"), (1, "checked", "false"), (1, "readonly", "true")]


def test_fields_targets_and_windows(spark):
    df = rows(spark, {"role": "heading", "text": "One", "attrs": '{"level":1}'}, {"role": "link", "text": "one more", "actions": ["click"]}, {"role": "heading", "text": None}, {"role": "link", "text": "Off", "actions": ["click"], "attrs": '{"disabled":true}'}, {"role": "link", "text": "two", "actions": ["click"]}, {"page_id": 2, "text": None, "role": None})
    got = E.field_all(df, "heading", ["level"]).first()
    assert got["values"] == ["One", None] and got.provenance == ["e0", "e2"] and got.level == ["1", None]
    assert [tuple(r) for r in E.resolve(df, "ONE", "link").collect()] == [(1, 1)] and [tuple(r) for r in E.resolve(df, "one", "image").collect()] == [(1, 0)] and E.resolve(df, "none").count() == 0
    targets = df.filter(E.has_actions())
    wanted = ~E.truthy("disabled")
    assert [tuple(r) for r in E.interactive_window(targets, wanted, offset=1).collect()] == [(1, 4, 3, 2)] and E.interactive_window(targets, wanted, limit=1).count() == 1 and E.interactive_window(targets.limit(0), wanted).count() == 0


def test_attribute_changes_and_replay(spark):
    pairs = spark.createDataFrame([(2, 1, 2)], "pair_id bigint, old_page bigint, new_page bigint")
    regions = spark.createDataFrame([(1, 0, "r"), (2, 0, "r"), (1, 1, None)], "page_id bigint, region_ord int, region_id string")
    df = rows(spark, {"id": "a", "attrs": '{"href":"/1","level":2,"x":null}'}, {"page_id": 2, "id": "a", "attrs": '{"href":"/2","level":2,"new":[1]}'}, {"id": "b", "attrs": "[1]"}, {"page_id": 2, "id": "b", "attrs": None}, {"id": "c", "attrs": '{"k":1}'}, {"id": None}, {"region_ord": 1, "id": "a", "attrs": '{"href":"/9"}'})
    got = sorted(tuple(r)[2:] for r in page_diff.attribute_changes(df, regions, pairs).collect())
    assert got == [("a", "href", "/1", "/2"), ("a", "new", None, "[1]")]
    targets = spark.createDataFrame([(1, "link", "A"), (1, "link", "A"), (1, "link", "B"), (1, "link", "C"), (2, "link", "A"), (2, "link", "C"), (2, "link", "C"), (1, None, "D"), (2, None, "D")], "page_id bigint, role string, label string")
    assert sorted((r.label, r.matches, r.outcome) for r in page_diff.replay_targets(targets, pairs, ["role", "label"]).collect()) == [("A", 1, "found"), ("B", 0, "missing"), ("C", 2, "ambiguous"), ("D", 0, "missing")]


def test_outcome_keys_and_reports(spark):
    errors = [None, "", "Blocked by robots", "request timed out", "HTTP 503", "expecting value", "heap out of memory", "odd"]
    df = spark.createDataFrame([(e,) for e in errors], "error string")
    assert [r.k for r in df.select(scores.outcome_key(F.col("error")).alias("k")).collect()] == ["ok", "ok", "blocked", "failed:timeout", "failed:http_error", "failed:parse_error", "failed:resource_exhausted", "failed:navigation_failed"]
    small = spark.createDataFrame([("B", 2), ("A", None)], "grade string, pages int")
    assert scores.report(small, "T", ["grade", "pages"]).first().report == "# T\n\n| Grade | Pages |\n| --- | --- |\n| A |  |\n| B | 2 |"


def test_targets_are_found_by_key(spark):
    plan = spark.createDataFrame([(1, 0, 10, "a", "k0", "h", "t"), (1, 1, 11, "h", "k1", "a", None), (1, 2, 12, "c", None, "h", "t"), (2, 0, 20, None, None, None, "")], "page_id bigint, el_ord int, element_key bigint, id string, cache_key string, html_id string, test_id string")
    wanted = spark.createDataFrame([(1, "a"), (1, "h"), (1, "t"), (1, "k1"), (1, "none"), (2, ""), (2, None), (1, "a")], "page_id bigint, value string")
    got = sorted((r.page_id, r.value or "", r.element_key, r.found_by) for r in E.find_targets(plan, wanted).collect())
    assert got[:5] == [(1, "a", 10, "id"), (1, "h", 11, "id"), (1, "k1", 11, "cache_key"), (1, "none", None, None), (1, "t", 10, "test_id")] and len(got) == 7
    assert E.find_targets(plan.limit(0), wanted).filter("element_key is not null").count() == 0


def test_agent_text(spark):
    from treelake.operators.agent_text import agent_text

    items = '{"ordered":true,"items":[' + ",".join(f'{{"text":"i{n}"}}' for n in range(7)) + "]}"
    given = [
        {"role": "link", "actions": ["click"], "text": "T", "label": "L", "hints": ["primary"], "html_id": "h", "attrs": '{"href":"/x","disabled":true,"inert":true,"readonly":true,"target":"","download":true}'},
        {"role": "radio", "actions": ["select"], "text": "R", "attrs": '{"group":"g","aria":{"checked":true,"label":"l"}}'},
        {"role": "select", "actions": ["select"], "attrs": '{"options":[{"text":"a"},{"value":"b"},{},{"text":"d"},{"text":"e"},{"text":"f"}],"multiple":true,"selected_values":["a","b"]}'},
        {"role": "list", "attrs": items}, {"role": "table", "attrs": '{"headers":["A"],"rows":[["1"],["2"],["3"],["4"]]}'}, {"role": "table"}, {"role": "section", "text": "no"}, {"role": "image"}, {"role": "group", "text": "G"}, {"role": "heading", "text": None},
    ]
    pages = spark.createDataFrame([(1, None, None, 1234567, 1000, 3, None), (2, "t", "u", None, 0, None, None)], "page_id bigint, title string, url string, html_bytes bigint, som_bytes bigint, element_count bigint, interactive_count bigint")
    regions = spark.createDataFrame([(1, 0, "form", "F", "/go", None)], "page_id bigint, region_ord int, role string, label string, action string, method string")
    got = {r.page_id: r.content.split("\n") for r in agent_text(rows(spark, *given), pages, regions).collect()}
    import re

    lines = [re.sub(r"action:v1:\w{8}", "K", x) for x in got[1]]
    assert lines == [
        "Page: Untitled", "URL: ", "", '## form "F" -> /go [GET]', '  [e0] link "L" -> /x [primary] [disabled] [blocked_reason=disabled] [cache_key=K] [html_id="h"] [readonly] [inert] [download="True"]',
        '  [e1] radio "R" group=g (selected) [enabled] [cache_key=K] [checked="True"] [aria_label="l"] [group="g"]', '  [e2] select "" [a, b, , d, e] (+1 more) [enabled] [cache_key=K] [multiple="True"] [selected_values="a,b"]',
        "  1. i0", "  2. i1", "  3. i2", "  4. i3", "  5. i4", "    [2 more items]", "  table: A", "    1", "    2", "    3", "    [1 more rows]", "  table (empty)", "  image", "  group: G", "  h1: ", "", "---", "1,234,567 → 1,000 bytes (1234.6x) | 3 elements, 0 interactive",
    ]
    assert got[2] == ["Page: t", "URL: u", "", "---", "0 → 0 bytes (N/A) | 0 elements, 0 interactive"]


def test_violations_and_richer_captures(spark):
    df = spark.createDataFrame([(1, 1.0, 9), (2, None, 2), (3, 5.0, None)], "page_id bigint, ratio double, n bigint")
    got = sorted(tuple(r) for r in scores.violations(df, "page_id", {"ratio": 3}, {"n": 5}).collect())
    assert got == [(1, "n", 9.0, 5.0, "most"), (1, "ratio", 1.0, 3.0, "least")] and scores.violations(df.limit(0), "page_id", {"ratio": 3}).count() == 0
    pages = spark.createDataFrame([(1, 5), (2, 4), (3, 4), (4, None)], "page_id bigint, element_count bigint")
    pairs = spark.createDataFrame([(2, 1, 2), (3, 2, 3), (4, 3, 4)], "pair_id bigint, old_page bigint, new_page bigint")
    assert sorted(tuple(r) for r in page_diff.richer(pages, pairs).collect()) == [(2, 1, True), (3, 3, False), (4, 3, True)]
