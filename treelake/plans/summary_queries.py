"""Lookups, differences and summaries over page tables: (session, folder) -> DataFrame, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelake.operators import elements as E
from treelake.operators import nested, page_diff, scores, snapshots
from treelake.operators.agent_text import agent_text
from treelake.plans import page_queries as P
from treelake.plans.page_queries import _E, _P, _R, _attr, costs, elements, pages, placed, regions
from treelake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_INPUTS = ", ".join(f"'{r}'" for r in E.INPUT_ROLES)


@query(f"SELECT element_key, page_id, role, label, {_attr('input_type')} AS input_type, coalesce(lower({_attr('required')}) = 'true', false) AS required FROM {_E} WHERE role IN ({_INPUTS})")
def page_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The form controls of every page."""
    rows = elements(spark, d, "page_id role label attrs", F.col("role").isin(*E.INPUT_ROLES))
    return rows.select("element_key", "page_id", "role", "label", E.attr("input_type").alias("input_type"), E.truthy("required").alias("required"))


@query(f"SELECT r.page_id, r.region_ord, region_id, form_action, form_method, count(element_key) AS controls FROM {_R} r LEFT JOIN (SELECT * FROM {_E} WHERE role IN ({_INPUTS})) e ON e.page_id = r.page_id AND e.region_ord = r.region_ord WHERE region_role = 'form' GROUP BY 1, 2, 3, 4, 5")
def page_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every form with where it goes and how many controls it has."""
    controls = elements(spark, d, "page_id region_ord", F.col("role").isin(*E.INPUT_ROLES)).groupBy("page_id", "region_ord").agg(F.count("*").alias("controls"))
    forms = regions(spark, d).filter("role = 'form'").select("page_id", "region_ord", "region_id", F.col("action").alias("form_action"), F.col("method").alias("form_method"))
    return forms.join(controls, ["page_id", "region_ord"], "left").na.fill(0, ["controls"])


@query(f"""SELECT page_id, element_key, total, matched FROM (SELECT page_id, element_key, el_ord, count(*) OVER (PARTITION BY page_id) AS total, sum(m::BIGINT) OVER (PARTITION BY page_id) AS matched, m, row_number() OVER (PARTITION BY page_id, m ORDER BY el_ord, element_key) AS nth FROM
 (SELECT *, role = 'link' AND NOT coalesce(lower({_attr('disabled')}) = 'true', false) AS m FROM {_E} WHERE len(actions) > 0)) WHERE m AND nth > 2 AND nth <= 7""")
def interactive_window(spark: SparkSession, d: str) -> DataFrame:
    """Enabled links of each page from the third on, five at most, with both counts; offset and limit are the feature."""
    rows = elements(spark, d, "page_id el_ord role attrs", E.has_actions(), by="page_id")
    return E.interactive_window(rows, (F.col("role") == "link") & ~E.truthy("disabled"), offset=2, limit=5)


@query(f"""WITH m AS (SELECT page_id, el_ord, element_key, contains(lower(coalesce(text, '')), 'notes') AS t, role = 'heading' AS r FROM {_E})
 SELECT page_id, coalesce(arg_min(element_key, struct_pack(a := el_ord, b := element_key)) FILTER (t AND r), arg_min(element_key, struct_pack(a := el_ord, b := element_key)) FILTER (t)) AS element_key FROM m GROUP BY 1 HAVING bool_or(t)""")
def resolved_targets(spark: SparkSession, d: str) -> DataFrame:
    """The element of each page that a target of text and role means: by both, else by its text."""
    return E.resolve(elements(spark, d, "page_id el_ord role text", F.contains(F.lower("text"), F.lit("notes"))), "Notes", "heading")


@query(f"SELECT page_id, list(text ORDER BY el_ord, element_key) AS texts, list(id ORDER BY el_ord, element_key) AS provenance, list({_attr('level')} ORDER BY el_ord, element_key) AS level FROM {_E} WHERE role = 'heading' AND text IS NOT NULL AND id IS NOT NULL AND {_attr('level')} IS NOT NULL GROUP BY 1")
def all_headings(spark: SparkSession, d: str) -> DataFrame:
    """The field of all headings of a page, with a property of theirs."""
    rows = elements(spark, d, "page_id el_ord id role text attrs", "role = 'heading' and text is not null and id is not null", by="page_id").filter(E.attr("level").isNotNull())
    return E.field_all(rows, "heading", ["level"]).withColumnRenamed("values", "texts")


@query(f"SELECT page_id, html_id, arg_min(element_key, struct_pack(a := el_ord, b := element_key)) AS element_key FROM {_E} WHERE len(actions) > 0 AND html_id <> '' GROUP BY 1, 2")
def action_index_html(spark: SparkSession, d: str) -> DataFrame:
    """The first action target of each page by html id."""
    return E.plan_index(E.action_plan(placed(spark, d, P._TARGET, E.has_actions())), "html_id")


@query(f"""WITH t AS (SELECT page_id, el_ord, element_key, id, html_id FROM {_E} WHERE len(actions) > 0), w AS (SELECT DISTINCT page_id, html_id AS value FROM t WHERE html_id <> '' UNION SELECT page_id, id FROM {_E} WHERE role IN ('heading', 'button') AND id <> ''),
 k AS (SELECT page_id, id AS value, 0 AS rank, el_ord, element_key FROM t UNION ALL SELECT page_id, html_id, 1, el_ord, element_key FROM t), f AS (SELECT page_id, value, arg_min(element_key, struct_pack(r := rank, o := el_ord, e := element_key)) AS element_key, min(rank) AS rank FROM k WHERE value <> '' GROUP BY 1, 2)
 SELECT page_id, value, element_key, CASE rank WHEN 0 THEN 'id' WHEN 1 THEN 'html_id' END AS found_by FROM w LEFT JOIN f USING (page_id, value)""")
def found_targets(spark: SparkSession, d: str) -> DataFrame:
    """The targets that ids of buttons and headings, and html ids, name on their pages."""
    plan = E.action_plan(placed(spark, d, P._TARGET, E.has_actions()))
    named = elements(spark, d, "page_id id role", "role in ('heading', 'button') and id <> ''").select("page_id", F.col("id").alias("value"))
    return E.find_targets(plan, plan.filter("html_id is not null").select("page_id", F.col("html_id").alias("value")).union(named), ("id", "html_id"))


@query(f"SELECT page_id, action, list(element_key ORDER BY el_ord, element_key) AS targets FROM (SELECT page_id, el_ord, element_key, unnest(actions) AS action FROM {_E}) GROUP BY 1, 2")
def targets_by_action(spark: SparkSession, d: str) -> DataFrame:
    """The targets of each page by what can be done with them, in order."""
    rows = elements(spark, d, "page_id el_ord actions", E.has_actions(), by="page_id").select("page_id", "el_ord", "element_key", F.explode("actions").alias("action"))
    lists = F.transform(F.sort_array(F.collect_list(F.struct("el_ord", "element_key"))), lambda x: x["element_key"])
    return rows.groupBy("page_id", "action").agg(lists.alias("targets"))


@query(f"SELECT page_id, url, title, coalesce(content, '') AS content, length(coalesce(content, '')) AS characters FROM {_P} LEFT JOIN ({P.SQL['page_text']}) USING (page_id)")
def page_documents(spark: SparkSession, d: str) -> DataFrame:
    """A text document for each page, with what tells where it is from."""
    text = F.coalesce("content", F.lit(""))
    return pages(spark, d).join(P.page_text(spark, d), "page_id", "left").select("page_id", "url", "title", text.alias("content"), F.length(text).alias("characters"))


@query(f"SELECT page_id, href, nth FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first_ord, href) AS nth FROM ({P.SQL['page_links']})) WHERE nth <= 20")
def context_links(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 links of each page, as a context gives them; the bound is the feature."""
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("first_ord", "href"))
    return P.page_links(spark, d).select("page_id", "href", nth.alias("nth")).filter("nth <= 20")


@query(f"""SELECT e.page_id, element_key, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-z]+:') || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href END AS target
 FROM (SELECT page_id, element_key, {_attr('href')} AS href FROM {_E} WHERE role = 'link') e JOIN {_P} p ON p.page_id = e.page_id WHERE regexp_matches(href, '^(/|[A-Za-z][A-Za-z0-9+.-]*:)')""")
def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Where each link leads, resolved against its page's url; targets that are relative to the page's folder left out here."""
    from treelake.functions import urls

    links = table(spark, d, "som_elements").filter("role = 'link'").select("page_id", "element_key", E.attr("href").alias("href")).filter(F.col("href").rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)")).distinct()
    return links.join(pages(spark, d).select("page_id", "url"), "page_id").select("page_id", "element_key", urls.resolve("url", "href").alias("target"))


_PLAIN = f"list_filter(flatten([[nullif(trim(text), '')], [nullif(trim(a.caption), '')], {P._ROWS}, list_filter(list_transform(a.items, lambda i: trim(i.text)), lambda t: t <> '')]), lambda t: t IS NOT NULL)"


@query(f"""SELECT page_id, CASE WHEN title <> '' THEN title || CASE WHEN n > 0 THEN chr(10) || t ELSE '' END ELSE coalesce(t, '') END AS content FROM {_P} LEFT JOIN
 (SELECT page_id, array_to_string(flatten(list({_PLAIN} ORDER BY el_ord, element_key)), chr(10)) AS t, len(flatten(list({_PLAIN}))) AS n FROM {P._A} GROUP BY 1) USING (page_id)""")
def plain_text(spark: SparkSession, d: str) -> DataFrame:
    """Title and plain text of each page."""
    return E.plain_text(elements(spark, d, "page_id el_ord text attrs", by="page_id"), pages(spark, d))


_AGENT = f"""WITH k AS ({P.SQL['action_plan_keys']}), l AS (SELECT e.page_id, region_ord, el_ord, e.element_key, CASE WHEN len(actions) > 0 THEN '  [' || coalesce(id, '') || '] ' || CASE role WHEN 'link' THEN 'link "' || display || '" -> ' || coalesce(x.href, '')
 WHEN 'text_input' THEN 'input(' || coalesce(x.input_type, 'text') || ')' || CASE WHEN label <> '' THEN ' "' || label || '"' ELSE '' END || CASE WHEN x.placeholder <> '' THEN ' placeholder="' || x.placeholder || '"' ELSE '' END WHEN 'checkbox' THEN 'checkbox "' || display || '" (' || CASE WHEN x.checked = 'true' THEN 'checked' ELSE 'unchecked' END || ')' ELSE role || ' "' || display || '"' END
 || CASE WHEN len(hints) > 0 THEN ' ' || array_to_string(list_transform(hints, lambda h: '[' || h || ']'), ' ') ELSE '' END || ' ' || array_to_string([CASE WHEN x.disabled = 'true' THEN '[disabled] [blocked_reason=disabled]' WHEN x.inert = 'true' THEN '[inert] [blocked_reason=inert]' WHEN x.readonly = 'true' THEN '[readonly] [blocked_reason=readonly]' ELSE '[enabled]' END,
  '[cache_key=' || cache_key || ']', CASE WHEN html_id <> '' THEN '[html_id="' || html_id || '"]' END, CASE WHEN x.readonly = 'true' AND (x.disabled = 'true' OR x.inert = 'true') THEN '[readonly]' END, CASE WHEN x.disabled = 'true' AND x.inert = 'true' THEN '[inert]' END], ' ')
 WHEN role = 'heading' THEN '  h' || coalesce(x.level, '1') || ': ' || coalesce(text, '') WHEN role = 'paragraph' THEN CASE WHEN text <> '' THEN '  p: ' || text END WHEN role = 'image' THEN CASE WHEN x.alt <> '' THEN '  image: ' || x.alt ELSE '  image' END
 WHEN role = 'list' THEN CASE WHEN len(x.items) > 0 THEN array_to_string(list_transform(x.items[1:5], lambda i, n: '  ' || CASE WHEN x.ordered = 'true' THEN n || '.' ELSE '-' END || ' ' || coalesce(i.text, '')), chr(10)) || CASE WHEN len(x.items) > 5 THEN chr(10) || '    [' || (len(x.items) - 5) || ' more items]' ELSE '' END END
 WHEN role = 'table' THEN CASE WHEN coalesce(len(x.rows), 0) = 0 AND coalesce(len(x.headers), 0) = 0 THEN '  table (empty)' ELSE array_to_string([CASE WHEN len(x.headers) > 0 THEN '  table: ' || array_to_string(x.headers, ' | ') END, CASE WHEN len(x.rows) > 0 THEN array_to_string(list_transform(x.rows[1:3], lambda r: '    ' || array_to_string(r, ' | ')), chr(10)) END, CASE WHEN len(x.rows) > 3 THEN '    [' || (len(x.rows) - 3) || ' more rows]' END], chr(10)) END
 WHEN role = 'separator' THEN '  ---' WHEN role = 'section' THEN NULL WHEN text <> '' THEN '  ' || role || ': ' || text END AS line
 FROM (SELECT *, coalesce(nullif(label, ''), text, '') AS display, json_transform(CASE WHEN json_valid(attrs) AND json_type(attrs) = 'OBJECT' THEN attrs END, '{{"href":"VARCHAR","input_type":"VARCHAR","placeholder":"VARCHAR","checked":"VARCHAR","disabled":"VARCHAR","inert":"VARCHAR","readonly":"VARCHAR","level":"VARCHAR","alt":"VARCHAR","ordered":"VARCHAR","items":[{{"text":"VARCHAR"}}],"headers":["VARCHAR"],"rows":[["VARCHAR"]]}}') AS x FROM {_E}) e LEFT JOIN k ON k.element_key = e.element_key),
 b AS (SELECT page_id, region_ord, list(line ORDER BY el_ord, element_key) AS lines FROM l WHERE line IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT page_id, flatten(list(list_concat(['## ' || region_role || CASE WHEN region_label <> '' THEN ' "' || region_label || '"' ELSE '' END || CASE WHEN form_action <> '' THEN ' -> ' || form_action || ' [' || coalesce(form_method, 'GET') || ']' ELSE '' END], coalesce(lines, []), ['']) ORDER BY region_ord)) AS lines FROM {_R} LEFT JOIN b USING (page_id, region_ord) GROUP BY 1)
 SELECT page_id, array_to_string(list_concat(['Page: ' || coalesce(title, 'Untitled'), 'URL: ' || coalesce(url, ''), ''], coalesce(lines, []), ['---', printf('%,d', coalesce(html_bytes, 0)) || ' → ' || printf('%,d', coalesce(som_bytes, 0)) || ' bytes (' || CASE WHEN som_bytes > 0 THEN printf('%.1f', html_bytes / som_bytes::DOUBLE) || 'x' ELSE 'N/A' END || ') | ' || coalesce(element_count, 0) || ' elements, ' || coalesce(interactive_count, 0) || ' interactive']), chr(10)) AS content FROM {_P} LEFT JOIN r USING (page_id)"""


@query(_AGENT)
def agent_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each page as compact text for an agent."""
    return agent_text(elements(spark, d, "page_id region_ord el_ord id html_id role text label actions hints attrs", by="page_id"), pages(spark, d), regions(spark, d, by="page_id"))


@query()
def selected_trees(spark: SparkSession, d: str) -> DataFrame:
    """Links of every delivered tree with the nodes above them."""
    return nested.with_ancestors(nested.emit_nodes(table(spark, d, "som_records")), F.get_json_object("node", "$.role") == "link").select(F.col("record_key").alias("record_id"), "node_ord", "parent_ord", "kind", "matched")


@query()
def session_patches(spark: SparkSession, d: str) -> DataFrame:
    """What each delivered cursor of a session changes, as patch operations."""
    return snapshots.patch_operations(snapshots.session_changes(table(spark, d, "session_snapshots")))


_KIND = """CASE WHEN error IS NULL OR trim(error) = '' THEN 'ok' WHEN regexp_matches(error, '(?i)blocked|denied|forbidden|captcha|human|unusual traffic') THEN 'blocked' WHEN regexp_matches(error, '(?i)heap out of memory|out of memory|memory allocation of|allocation failed|failed to reserve address space') THEN 'failed:resource_exhausted'
 WHEN regexp_matches(lower(error), 'timeout|timed out|time-out') THEN 'failed:timeout' WHEN regexp_matches(lower(error), 'http|\\b[45]\\d\\d\\b') THEN 'failed:http_error' WHEN regexp_matches(lower(error), 'decode|parse|expecting') THEN 'failed:parse_error' ELSE 'failed:navigation_failed' END"""


@query(f"SELECT key, count(*) AS runs, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT {_KIND} AS key FROM (SELECT DISTINCT cost_id, error FROM token_costs)) GROUP BY 1")
def outcome_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Runs by ok, blocked and each kind of failure, with their shares."""
    counted = costs(spark, d).select(scores.outcome_key(F.col("error")).alias("key")).groupBy("key").agg(F.count("*").alias("runs"))
    return counted.withColumn("percent", F.round(100.0 * F.col("runs") / F.sum("runs").over(Window.partitionBy(F.lit(1))), 6))


@query(f"SELECT count(*) AS runs, count(*) FILTER (key = 'ok') AS ok, count(*) FILTER (key = 'blocked') AS blocked, count(*) FILTER (starts_with(key, 'failed')) AS failed, round(100.0 * count(*) FILTER (key = 'ok') / count(*), 6) AS success_percent, round(100.0 * count(*) FILTER (key = 'ok') / count(*) FILTER (key <> 'blocked'), 6) AS parsed_percent FROM (SELECT {_KIND} AS key FROM (SELECT DISTINCT cost_id, error FROM token_costs))")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Success of runs over all, and over those that weren't blocked."""
    key = F.col("key")
    ok, blocked, failed = F.count_if(key == "ok"), F.count_if(key == "blocked"), F.count_if(F.startswith(key, F.lit("failed")))
    rows = costs(spark, d).select(scores.outcome_key(F.col("error")).alias("key"))
    return rows.agg(F.count("*").alias("runs"), ok.alias("ok"), blocked.alias("blocked"), failed.alias("failed"), F.round(100.0 * ok / F.count("*"), 6).alias("success_percent"), F.round(100.0 * ok / F.count_if(key != "blocked"), 6).alias("parsed_percent"))


@query(f"SELECT site, count(*) AS fetches, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'stale') AS stale, count(*) FILTER (outcome = 'expired') AS expired, count(*) FILTER (outcome = 'miss') AS misses FROM ({P.SQL['cache_outcomes']}) JOIN {_P} ON page_id = fetch_id GROUP BY 1")
def cache_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Cache results of each site."""
    rows = P.cache_outcomes(spark, d).join(pages(spark, d).select(F.col("page_id").alias("fetch_id"), "site"), "fetch_id")
    return rows.groupBy("site").agg(F.count("*").alias("fetches"), *(F.count_if(F.col("outcome") == o).alias(n) for o, n in (("hit", "hits"), ("stale", "stale"), ("expired", "expired"), ("miss", "misses"))))


@query("SELECT session_id, count(DISTINCT som_cursor) AS snapshots, max(som_cursor) AS last_cursor, sum(strlen(current_som)) AS bytes, count(DISTINCT current_url) AS urls FROM (SELECT DISTINCT session_id, som_cursor, current_url, current_som FROM session_snapshots WHERE session_id IS NOT NULL) GROUP BY 1")
def session_inventory(spark: SparkSession, d: str) -> DataFrame:
    """What each session holds: snapshots, its last cursor, bytes of its states and urls."""
    rows = table(spark, d, "session_snapshots").filter("session_id is not null").select("session_id", "som_cursor", "current_url", F.octet_length("current_som").alias("n"), F.md5("current_som").alias("h")).distinct()
    return rows.groupBy("session_id").agg(F.count_distinct("som_cursor").alias("snapshots"), F.max("som_cursor").alias("last_cursor"), F.sum("n").cast("bigint").alias("bytes"), F.count_distinct("current_url").alias("urls"))


_OBJ = "json_valid(attrs) AND json_type(attrs) = 'OBJECT'"
_VALUES = f"(SELECT page_id, region_id, id, k, json_extract_string(attrs, '$.\"' || k || '\"') AS v FROM (SELECT page_id, region_id, id, attrs, unnest(json_keys(attrs)) AS k FROM (SELECT page_id, region_id, id, arg_max(attrs, el_ord) AS attrs FROM {_E} JOIN {_R} USING (page_id, region_ord) WHERE id IS NOT NULL AND region_id IS NOT NULL GROUP BY 1, 2, 3) WHERE {_OBJ}))"
_BOTH = f"(SELECT pair_id, region_id, id FROM (SELECT DISTINCT p.pair_id, region_id, id FROM {_E} JOIN {_R} USING (page_id, region_ord) JOIN {P._PAIRS} p ON page_id = p.old_page) JOIN (SELECT DISTINCT p.pair_id, region_id, id FROM {_E} JOIN {_R} USING (page_id, region_ord) JOIN {P._PAIRS} p ON page_id = p.new_page) USING (pair_id, region_id, id))"


@query(f"""WITH v AS {_VALUES}, p AS {P._PAIRS}, b AS {_BOTH}, o AS (SELECT pair_id, region_id, id, k, v FROM v JOIN p ON page_id = old_page), n AS (SELECT pair_id, region_id, id, k, v FROM v JOIN p ON page_id = new_page)
 SELECT pair_id, region_id, id, k AS attribute, o.v AS old_value, n.v AS new_value FROM o FULL JOIN n USING (pair_id, region_id, id, k) JOIN b USING (pair_id, region_id, id) WHERE o.v IS DISTINCT FROM n.v""")
def attribute_changes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of the elements of recaptured pages that differ from the capture before."""
    return page_diff.attribute_changes(elements(spark, d, "page_id region_ord el_ord id attrs", "id is not null"), regions(spark, d), page_diff.captures(pages(spark, d)))


@query(f"""WITH t AS (SELECT page_id, role, coalesce(nullif(label, ''), nullif(text, '')) AS label FROM {_E} WHERE len(actions) > 0), p AS {P._PAIRS}, w AS (SELECT DISTINCT pair_id, new_page, role, label FROM t JOIN p ON page_id = old_page WHERE label IS NOT NULL)
 SELECT w.pair_id, w.role, w.label, count(t.page_id) AS matches, CASE count(t.page_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM w LEFT JOIN t ON t.page_id = new_page AND t.role = w.role AND t.label = w.label GROUP BY 1, 2, 3""")
def replay_targets(spark: SparkSession, d: str) -> DataFrame:
    """Whether the targets of a capture are found again in the next one: missing, found or ambiguous."""
    label = F.coalesce(E.non_empty(F.col("label")), E.non_empty(F.col("text")))
    targets = elements(spark, d, "page_id role text label", E.has_actions()).select("page_id", "role", label.alias("label")).filter("label is not null")
    return page_diff.replay_targets(targets, page_diff.captures(pages(spark, d)), ["role", "label"])


@query(f"SELECT '# Pages' || chr(10) || chr(10) || '| Grade | Pages |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || grade || ' | ' || pages || ' |', chr(10) ORDER BY grade) AS report FROM ({P.SQL['grade_distribution']})")
def grade_report(spark: SparkSession, d: str) -> DataFrame:
    """The grades of all pages as a report in Markdown."""
    return scores.report(P.grade_distribution(spark, d), "Pages", ["grade", "pages"])


@query(f"SELECT pair_id, CASE WHEN coalesce(o.element_count, 0) > coalesce(n.element_count, 0) THEN old_page ELSE new_page END AS page_id, coalesce(o.element_count, 0) > coalesce(n.element_count, 0) AS from_old FROM {P._PAIRS} p JOIN {_P} o ON o.page_id = old_page JOIN {_P} n ON n.page_id = new_page")
def richer_captures(spark: SparkSession, d: str) -> DataFrame:
    """Of a page captured again the capture to keep, by its elements."""
    return page_diff.richer(pages(spark, d), page_diff.captures(pages(spark, d)))


_SUITE = f"SELECT page_id, metric, value, bound, side FROM (SELECT page_id, unnest([{{'metric': 'ratio', 'value': ratio, 'bound': 3.0::DOUBLE, 'side': 'least'}}, {{'metric': 'element_count', 'value': element_count::DOUBLE, 'bound': 5.0::DOUBLE, 'side': 'least'}}, {{'metric': 'som_bytes', 'value': som_bytes::DOUBLE, 'bound': 4000.0::DOUBLE, 'side': 'most'}}], recursive := true) FROM (SELECT *, {P._RATIO} AS ratio FROM {_P})) WHERE CASE side WHEN 'least' THEN value < bound ELSE value > bound END"


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", "element_count", "som_bytes", F.when(F.col("som_bytes") > 0, F.round(F.col("html_bytes") / F.col("som_bytes"), 6)).alias("ratio"))


@query(_SUITE)
def suite_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every measure of a page that is out of bounds."""
    return scores.violations(_measured(spark, d), "page_id", {"ratio": 3, "element_count": 5}, {"som_bytes": 4000})


@query(f"SELECT count(*) AS pages, count(*) FILTER (n IS NULL) AS passed, count(*) FILTER (n > 0) AS failed, coalesce(sum(n), 0)::BIGINT AS violations FROM {_P} LEFT JOIN (SELECT page_id, count(*) AS n FROM ({_SUITE}) GROUP BY 1) USING (page_id)")
def suite_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many pages keep all bounds, and how often they are broken."""
    broken = suite_violations(spark, d).groupBy("page_id").agg(F.count("*").alias("n"))
    rows = pages(spark, d).select("page_id").join(broken, "page_id", "left")
    return rows.agg(F.count("*").alias("pages"), F.count_if(F.col("n").isNull()).alias("passed"), F.count_if(F.col("n") > 0).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


@query("SELECT user_id, count(*) AS sessions, max(events) AS longest FROM (SELECT user_id, s, count(*) AS events FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, parted by a day without an event, and the most events of one."""
    parts = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "1 day")).agg(F.count("*").alias("events"))
    return parts.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
