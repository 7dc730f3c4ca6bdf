import json

from treelake.html import compile as C
from treelake.html.tree import parse
from treelake.operators import nested


def shape(node):
    return node.text.strip() if node.tag == "#text" else [node.tag, *(shape(c) for c in node.children if c.tag != "#text" or c.text.strip())]


def body(html):
    return shape(next(c for c in parse(html).children if c.tag == "body"))[1:]


def test_tree_construction():
    assert body("<p>a<p>b<div>c</div>") == [["p", "a"], ["p", "b"], ["div", "c"]]
    assert body("<ul><li>a<li>b</ul>c") == [["ul", ["li", "a"], ["li", "b"]], "c"]
    assert body("<p><b>a</p><p>b</p>") == [["p", ["b", "a"]], ["p", ["b", "b"]]]
    assert body("<b>1<p>2</b>3</p>") == [["b", "1"], ["p", ["b", "2"], "3"]]
    assert body("<table><td>x<tr><th>y</table>") == [["table", ["tbody", ["tr", ["td", "x"]], ["tr", ["th", "y"]]]]]
    assert body("<table>loose<tr><td>x</table>") == ["loose", ["table", ["tbody", ["tr", ["td", "x"]]]]]
    assert body("<script>if (a < b) '</p>'</script><p>x") [-1] == ["p", "x"] and body("") == []
    assert body("<a href=1>x<a href=2>y</a>") == [["a", "x"], ["a", "y"]]
    assert body("<h1>a<h2>b</h2>") == [["h1", "a"], ["h2", "b"]]
    assert body("<select><option>a<option>b</select>") == [["select", ["option", "a"], ["option", "b"]]]


PAGE = """<html lang=de><head><title> T </title><meta property="og:title" content="O"><script type="application/ld+json">{"a":1}</script><style>.off{display:none}</style></head><body>
<header><a href="/">Home</a></header><nav aria-label="Top"><a href="/a">A</a><a href="/b">B</a><a href="/a#x">A2</a></nav>
<main><h2>Title</h2><p>First.</p><p hidden>no</p><p class=off>no</p><form action="/s" method=post><label for=q>Query</label><input id=q name=q required><select><option>x<option selected>y</select><button class="btn-primary">Go</button></form>
<table><tr><th>k<th>v<tr><td>1<td>2</table><ul><li>1<li>2<li>3<li>4<li>5<li>6<li>7</ul><img src=i alt="pic"></main>
<div class="cookie-banner">We use cookies</div><footer>© Me</footer></body></html>"""


def test_compile_page():
    som = C.compile_page(PAGE, "https://e.x/p")
    regions = {r["id"]: r for r in som["regions"]}
    assert [*regions] == ["r_header", "r_navigation", "r_form", "r_main", "r_footer"] and som["title"].strip() == "T" and som["lang"] == "de"
    assert regions["r_navigation"]["label"] == "Top" and [e["text"] for e in regions["r_navigation"]["elements"]][:2] == ["A", "B"]
    form = regions["r_form"]
    assert form["method"] == "POST" and form["action"] == "/s"
    by_role = {e["role"]: e for e in form["elements"]}
    assert by_role["text_input"]["label"] == "Query" and by_role["text_input"]["attrs"]["required"] is True and by_role["button"]["hints"] == ["primary"]
    assert [o.get("selected") for o in by_role["select"]["attrs"]["options"]] == [None, True]
    main = {e["role"]: e for e in regions["r_main"]["elements"]}
    assert main["heading"]["attrs"]["level"] == 2 and main["table"]["attrs"]["headers"] == ["k", "v"] and main["list"]["attrs"]["items"][-1]["text"] == "[2 more items]"
    assert "no" not in json.dumps([e.get("text") for r in som["regions"] for e in r["elements"]]) and "cookies" not in json.dumps(som["regions"])
    assert som["structured_data"]["open_graph"] == {"og:title": "O"} and som["structured_data"]["json_ld"] == [{"a": 1}]
    assert som["meta"]["element_count"] == sum(1 for _ in C.flatten(som["regions"])) and C.compile_page(PAGE, "https://e.x/p") == som
    assert C.compile_page(None, None)["regions"] == []


def test_ids_and_budgets():
    som = C.compile_page("<main>" + "<p>same</p>" * 15 + "</main>", "https://e.x")
    elements = som["regions"][0]["elements"]
    assert len(elements) == 11 and elements[-1]["id"] == "e_summary_5" and len({e["id"] for e in elements}) == 11


def test_shadow_roots():
    som = C.compile_page('<section><template shadowrootmode="open"><p>in</p></template>out</section>', "u")
    e = som["regions"][0]["elements"][0]
    assert e["shadow"]["mode"] == "open" and [x["text"] for x in e["shadow"]["elements"]] == ["in"]


def test_compiled_pages_feed_the_nested_tables(spark):
    df = spark.createDataFrame([(1, "https://e.x/p", PAGE), (2, None, None), (3, "u", "<p>x")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in C.compile_pages(df).collect()}
    assert got[1].error is None and got[1].element_count > 8 and got[2].element_count == 0 and got[3].som_bytes > 0
    nodes = nested.emit_nodes(C.compile_pages(df), "page_id").groupBy("record_key", "kind").count().collect()
    counts = {(n.record_key, n.kind): n["count"] for n in nodes}
    assert counts[1, "region"] == 5 and counts[1, "option"] == 2 and counts[3, "element"] == 1


def test_deep_pages_compile_in_linear_time():
    som = C.compile_page("<div>" * 5000 + "deep" + "</div>" * 5000, "u")
    assert [(r["role"], [e["text"] for e in r["elements"]]) for r in som["regions"]] == [("content", ["deep"])]
    som = C.compile_page("<main>" + "<section>" * 3000 + "<a href=x>y</a>" + "</section>" * 3000 + "</main>", "u")
    assert som["meta"]["element_count"] == 2 and C.compile_page("<nav>" * 1500 + "<a href=x>y</a>", "u")["regions"][0]["role"] == "navigation"


def test_summaries_say_what_was_left_out():
    links = "".join(f"<a href='/{i % 90}'>t{i}</a>" for i in range(100))
    nav = C.compile_page(f"<nav>{links}</nav>", "u")["regions"][0]["elements"]
    assert nav[-1]["id"] == "e_summary_20" and nav[-1]["text"] == "[10 duplicate links, 10 more links dropped, ~60 chars]" and len(nav) == 81
    main = C.compile_page("<main>" + "<p>same</p>" * 15 + "</main>", "u")["regions"][0]["elements"]
    assert main[-1]["text"] == "[5 more paragraphs dropped, ~20 chars]"


def test_attributes_of_elements():
    def one(html):
        return C.compile_page(f"<main>{html}</main>", "u")["regions"][0]["elements"][0]

    a = one('<a href="" download target=_b type=t data-test="d" tabindex=2 aria-current=page aria-expanded=" True " aria-unknown=x>l</a>')["attrs"]
    assert a == {"href": "", "target": "_b", "type": "t", "download": True, "tabindex": 2, "test_id": "d", "aria": {"current": "page", "expanded": True}}
    i = one('<input type=RADIO name=n value="" checked maxlength=x min=3 readonly accesskey=k spellcheck contenteditable=false draggable=auto capture>')["attrs"]
    assert i == {"input_type": "radio", "value": "", "checked": True, "group": "n", "maxlength": "x", "min": 3, "accesskey": "k", "name": "n", "capture": True, "contenteditable": False, "spellcheck": True, "draggable": "auto", "readonly": True}
    s = one("<select multiple size=4 required><option value=1 selected>a<option selected>b<option>c</select>")["attrs"]
    assert s["selected_values"] == ["1", "b"] and s["value"] == "1" and s["size"] == 4 and s["multiple"] is s["required"] is True
    f = one("<fieldset disabled><legend>L <b>m</b></legend>x</fieldset>")
    assert f["attrs"] == {"legend": "L m", "disabled": True} and f["label"] == "L m"
    d = one("<details><summary>S</summary>x</details>")["attrs"]
    assert d == {"open": False, "summary": "S"} and one("<iframe srcdoc='<p>'></iframe>")["attrs"] == {"has_srcdoc": True, "srcdoc_preview": "<p>"}
    b = one("<b id=h>help <i hidden>no</i></b><button aria-describedby=h type=x aria-disabled=true>B</button>")
    button = C.compile_page("<main><b id=h>help <i hidden>no</i></b><button aria-describedby=h type=x aria-disabled=true>B</button></main>", "u")["regions"][0]["elements"][-1]["attrs"]
    assert b["text"] == "help" and button == {"button_type": "submit", "disabled": True, "description": "help", "aria": {"disabled": True, "describedby": "h"}}
    assert one("<label>Name <input id=q></label>")["text"] == "Name" and C.compile_page("<label>Name <input id=q></label>", "u")["regions"][0]["elements"][-1]["label"] == "Name"
