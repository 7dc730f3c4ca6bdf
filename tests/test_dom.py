import pytest

from treelake.functions.register import register
from treelake.html.dom import css, dom_nodes
from treelake.operators.graph import reachable


def test_selectors(spark):
    df = spark.createDataFrame([(1, '<div class="a b" id=x><p data-k=v>t</p></div><p class=a>'), (2, None)], "page_id bigint, html string")
    nodes = dom_nodes(df).cache()
    assert nodes.filter("page_id = 2").count() == 3
    for selector, n in [("p", 2), (".a", 2), ("div.a.b#x", 1), ("[data-k]", 1), ("[data-k='v']", 1), ("[data-k=w]", 0), ("p, div", 3), ("div > p", 0), ("", 0), ("*", 9)]:
        assert nodes.filter(css(selector)).count() == n, selector
    child = nodes.filter("text = 't'").first()
    assert nodes.filter((nodes.page_id == 1) & (nodes.node_id == child.parent_id)).first().tag == "p"


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("select normalize_text('  a  b ') as n, outbound_policy('ftp://a') as p, action_key(array('e', 'link')) as k").first()
    assert (row.n, row.p) == ("a b", "scheme") and row.k.startswith("action:v1:")
    rows = spark.sql("select role, text from page_elements('<main><h1>T</h1><p>x</p></main>', 'https://a')").collect()
    assert [tuple(r) for r in rows] == [("heading", "T"), ("paragraph", "x")]


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("x", "y"), (None, "z")], "source string, target string")
    roots = spark.createDataFrame([("a",), (None,)], "node string")
    assert {tuple(r) for r in reachable(roots, edges).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError):
        reachable(roots, edges, 1)
    assert reachable(roots.limit(0), edges).count() == 0
