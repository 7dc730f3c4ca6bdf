"""Queries over page tables: (session, folder) -> DataFrame, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelake.functions import text as T
from treelake.functions import urls as U
from treelake.html.compile import compile_pages
from treelake.operators import elements as E
from treelake.operators import page_diff, policy, scores
from treelake.operators.dedupe import latest
from treelake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# tables without rows delivered again, as SQL
_P = "(SELECT DISTINCT * EXCLUDE (received_at) FROM som_pages)"
_E = "(SELECT DISTINCT * EXCLUDE (received_at) FROM som_elements)"
_R = "(SELECT page_id, region_ord, min(region_id) AS region_id, min(role) AS region_role, min(label) AS region_label, min(action) AS form_action, min(method) AS form_method FROM som_regions GROUP BY 1, 2)"


def _attr(name: str) -> str:
    return f"CASE WHEN json_valid(attrs) THEN json_extract_string(attrs, '$.{name}') END"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def pages(spark: SparkSession, d: str) -> DataFrame:
    """som_pages, each page once."""
    return latest(table(spark, d, "som_pages"), ["page_id"], ["received_at"])


def elements(spark: SparkSession, d: str, columns: str, where: Column | str | None = None, by: str | None = None) -> DataFrame:
    """Columns of som_elements, each element once: the rows that ``where`` keeps.

    Rows delivered again differ in received_at only, so rows are filtered and columns dropped before
    repeated ones are: what isn't asked for is neither read nor shuffled. With ``by`` rows are brought
    together by that key first, which later groupings, windows and joins by it need no shuffle for.
    """
    rows = table(spark, d, "som_elements")
    rows = rows if where is None else rows.filter(where)
    rows = rows.select("element_key", *columns.split())
    return (rows.repartition(by) if by else rows).distinct()


def regions(spark: SparkSession, d: str, by: str | None = None) -> DataFrame:
    """som_regions, each region once."""
    rows = table(spark, d, "som_regions")
    rows = (rows.repartition(by) if by else rows).groupBy("page_id", "region_ord")
    return rows.agg(*(F.min(c).alias(c) for c in ("region_id", "role", "label", "action", "method")))


def placed(spark: SparkSession, d: str, columns: str, where: Column | str | None = None) -> DataFrame:
    """Elements beside their regions; a page's rows are together."""
    return E.with_regions(elements(spark, d, f"page_id region_ord {columns}", where, by="page_id"), regions(spark, d, by="page_id"))


#: Columns that an action plan reads.
_TARGET = "el_ord id html_id role text label actions attrs"


def round6(c: Column) -> Column:
    return F.round(c, 6)


_GRADE = "CASE WHEN ratio > 15 THEN 'A' WHEN ratio >= 8 THEN 'B' WHEN ratio >= 3 THEN 'C' WHEN ratio >= 1 THEN 'D' ELSE 'F' END"
_RATIO = "CASE WHEN som_bytes > 0 THEN round(html_bytes / som_bytes::DOUBLE, 6) END"


@query(f"SELECT page_id, site, ratio, element_count, interactive_count, {_GRADE} AS grade FROM (SELECT *, {_RATIO} AS ratio FROM {_P})")
def page_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Byte ratio and grade of every page."""
    ratio = F.when(F.col("som_bytes") > 0, round6(F.col("html_bytes") / F.col("som_bytes")))
    rows = pages(spark, d).select("page_id", "site", ratio.alias("ratio"), "element_count", "interactive_count")
    return rows.withColumn("grade", scores.grade(F.col("ratio")))


@query(f"SELECT grade, count(*) AS pages FROM (SELECT {_GRADE} AS grade FROM (SELECT {_RATIO} AS ratio FROM {_P})) GROUP BY 1")
def grade_distribution(spark: SparkSession, d: str) -> DataFrame:
    return page_scorecard(spark, d).groupBy("grade").agg(F.count("*").alias("pages"))


@query(f"""SELECT page_id, count(*) AS element_count, count(*) FILTER (WHERE len(actions) > 0) AS with_actions, count(*) FILTER (WHERE role IN ('link','button','text_input','textarea','select','checkbox','radio','details')) AS interactive,
 count(*) FILTER (WHERE role IN ('link','button','text_input','textarea','select','checkbox','radio','details') OR trim(coalesce(text,'')) <> '' OR trim(coalesce(label,'')) <> '') AS meaningful FROM {_E} GROUP BY 1""")
def element_counts(spark: SparkSession, d: str) -> DataFrame:
    """Elements of each page: all, with actions, of interactive roles, meaningful."""
    flags = {"with_actions": E.has_actions(), "interactive": E.is_interactive(), "meaningful": E.meaningful()}
    rows = table(spark, d, "som_elements").select("element_key", "page_id", *(c.alias(n) for n, c in flags.items())).distinct().groupBy("page_id")
    return rows.agg(F.count("*").alias("element_count"), *(F.count_if(n).alias(n) for n in flags))


@query(f"SELECT element_key, page_id, id, role FROM {_E} WHERE len(actions) > 0")
def interactive_elements(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, "page_id id role", E.has_actions())


@query(f"""SELECT page_id, href, min(el_ord) AS first_ord, arg_min(coalesce(text, label), el_ord) AS link_text FROM (SELECT *, {_attr('href')} AS href FROM {_E} WHERE role = 'link') WHERE href <> '' AND href <> '#' GROUP BY 1, 2""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of each page, each target once, in order of first appearance."""
    return E.links(elements(spark, d, "page_id el_ord role text label attrs", "role = 'link'", by="page_id"))


@query(f"""SELECT DISTINCT page_id, regexp_replace(regexp_replace(href, '#.*$', ''), '/$', '') AS target FROM (SELECT page_id, {_attr('href')} AS href FROM {_E} WHERE role = 'link') WHERE href <> '' AND href <> '#'""")
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "som_elements").filter("role = 'link'").select("page_id", E.attr("href").alias("href")).filter("href <> '' and href <> '#'")
    return rows.select("page_id", E.normal_href(F.col("href")).alias("target")).distinct()


@query(f"SELECT page_id, el_ord, id, coalesce(try_cast({_attr('level')} AS INTEGER), 0) AS level, text FROM {_E} WHERE role = 'heading'")
def page_headings(spark: SparkSession, d: str) -> DataFrame:
    return E.headings(elements(spark, d, "page_id el_ord id role text attrs", "role = 'heading'")).drop("element_key")


# attributes that renderers read, and an element's visible lines, as SQL
_RENDERED = """json_transform(CASE WHEN json_valid(attrs) AND json_type(attrs) = 'OBJECT' THEN attrs END, '{"items":[{"text":"VARCHAR"}],"options":[{"text":"VARCHAR"}],"headers":["VARCHAR"],"rows":[["VARCHAR"]],"caption":"VARCHAR","level":"VARCHAR","href":"VARCHAR","alt":"VARCHAR","src":"VARCHAR","placeholder":"VARCHAR","checked":"VARCHAR"}')"""
_ROWS = "CASE WHEN len(a.headers) > 0 THEN [array_to_string(a.headers, ' | ')] END, list_transform(list_filter(a.rows, lambda r: len(r) > 0), lambda r: array_to_string(r, ' | '))"
_VISIBLE = f"list_filter(flatten([[coalesce(nullif(text, ''), nullif(label, ''))], list_filter(list_transform(a.items, lambda i: i.text), lambda t: t <> ''), list_filter(list_transform(a.options, lambda o: o.text), lambda t: t <> ''), {_ROWS}]), lambda t: t IS NOT NULL)"
_EXTRACTED = f"list_filter(flatten([[nullif(text, '')], list_transform(list_filter(a.items, lambda i: i.text IS NOT NULL), lambda i: '• ' || i.text), [nullif(a.caption, '')], {_ROWS}]), lambda t: t IS NOT NULL)"
_A = f"(SELECT *, {_RENDERED} AS a FROM {_E})"


@query(f"SELECT page_id, array_to_string(flatten(list({_VISIBLE} ORDER BY el_ord, element_key)), chr(10)) AS content FROM {_A} GROUP BY 1")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    """The visible text of each page, list items, options and table cells included."""
    return E.page_text(elements(spark, d, "page_id el_ord text label attrs", by="page_id"))


@query(f"SELECT page_id, region_ord, array_to_string(flatten(list({_VISIBLE} ORDER BY el_ord, element_key)), chr(10)) AS content FROM {_A} GROUP BY 1, 2")
def region_text(spark: SparkSession, d: str) -> DataFrame:
    return E.page_text(elements(spark, d, "page_id region_ord el_ord text label attrs", by="page_id"), ["page_id", "region_ord"])


@query(f"""WITH b AS (SELECT page_id, array_to_string(flatten(list({_EXTRACTED} ORDER BY el_ord, element_key)), chr(10)) AS t, len(flatten(list({_EXTRACTED}))) AS n FROM {_A} GROUP BY 1), w AS (SELECT page_id, CASE WHEN title <> '' THEN title || chr(10) || CASE WHEN n > 0 THEN chr(10) || t ELSE '' END ELSE coalesce(t, '') END AS t FROM {_P} LEFT JOIN b USING (page_id))
 SELECT page_id, CASE WHEN length(t) > 300 THEN regexp_replace(left(t, 300), '^(.*)\\s.*?$', '\\1', 's') || '...' ELSE t END AS content FROM w""")
def extracted_text(spark: SparkSession, d: str) -> DataFrame:
    """Title and text of each page, cut at white space to 300 characters; the cut is the feature."""
    return E.extract_text(elements(spark, d, "page_id el_ord text attrs", by="page_id"), pages(spark, d), 300)


@query(f"""WITH l AS (SELECT page_id, region_ord, el_ord, element_key, CASE
 WHEN role = 'heading' THEN [repeat('#', coalesce(nullif(try_cast(a.level AS INTEGER), 0), 1) + 2) || ' ' || coalesce(text, '')] WHEN role = 'paragraph' THEN [coalesce(text, ''), ''] WHEN role = 'link' THEN ['[' || coalesce(nullif(text, ''), label, '') || '](' || CASE WHEN a IS NULL THEN '#' ELSE coalesce(a.href, 'None') END || ')']
 WHEN role = 'button' THEN ['[Button: ' || coalesce(text, '') || ']'] WHEN role = 'image' THEN ['![' || CASE WHEN a IS NULL THEN '' ELSE coalesce(a.alt, 'None') END || '](' || CASE WHEN a IS NULL THEN '' ELSE coalesce(a.src, 'None') END || ')']
 WHEN role IN ('text_input', 'textarea') THEN ['[Input: ' || coalesce(label, '') || CASE WHEN a.placeholder <> '' THEN ' placeholder="' || a.placeholder || '"' ELSE '' END || ']'] WHEN role = 'select' THEN list_concat(['[Select: ' || coalesce(nullif(label, ''), text, '') || ']'], list_transform(list_filter(a.options, lambda o: o.text <> ''), lambda o: '- ' || o.text))
 WHEN role IN ('checkbox', 'radio') THEN ['[' || CASE WHEN a.checked NOT IN ('false', '') THEN 'x' ELSE '' END || '] ' || coalesce(nullif(text, ''), label, '')] WHEN role = 'list' THEN list_transform(a.items, lambda i: '- ' || coalesce(i.text, ''))
 WHEN role = 'table' THEN list_concat(CASE WHEN a.caption <> '' THEN [a.caption, ''] END, CASE WHEN len(a.headers) > 0 THEN ['| ' || array_to_string(a.headers, ' | ') || ' |', '| ' || array_to_string(list_transform(a.headers, lambda h: '---'), ' | ') || ' |'] END, list_transform(list_filter(a.rows, lambda r: len(r) > 0), lambda r: '| ' || array_to_string(r, ' | ') || ' |'), CASE WHEN a IS NULL AND text <> '' THEN [text] END,
  CASE WHEN a.caption <> '' OR len(a.headers) > 0 OR len(list_filter(a.rows, lambda r: len(r) > 0)) > 0 OR a IS NULL AND text <> '' THEN [''] END)
 WHEN role = 'separator' THEN ['---'] WHEN text <> '' THEN [text] ELSE [] END AS lines FROM {_A}),
 b AS (SELECT page_id, region_ord, flatten(list(coalesce(lines, []) ORDER BY el_ord, element_key)) AS lines FROM l GROUP BY 1, 2),
 r AS (SELECT page_id, flatten(list(list_concat(['## ' || upper(left(region_role, 1)) || lower(substr(region_role, 2)) || CASE WHEN region_label <> '' THEN ': ' || region_label ELSE '' END, ''], coalesce(lines, []), ['']) ORDER BY region_ord)) AS lines FROM {_R} LEFT JOIN b USING (page_id, region_ord) GROUP BY 1)
 SELECT page_id, array_to_string(list_concat(['# ' || coalesce(title, ''), 'URL: ' || coalesce(url, ''), ''], coalesce(lines, [])), chr(10)) AS content FROM {_P} LEFT JOIN r USING (page_id)""")
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Each page as Markdown: title, url, its regions and their elements."""
    return E.page_markdown(elements(spark, d, "page_id region_ord el_ord role text label attrs", by="page_id"), pages(spark, d), regions(spark, d, by="page_id"))


@query("SELECT record_id, CASE WHEN strlen(som_json) > 4000 THEN '{\"truncated\": true, \"original_bytes\": ' || strlen(som_json) || ', \"message\": \"SOM exceeded budget of 1000 tokens\"}' ELSE som_json END AS delivered FROM (SELECT DISTINCT record_id, som_json FROM som_records)")
def budgeted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Trees as delivered within 1,000 tokens, or a note in place of a larger one; the budget is the feature."""
    return table(spark, d, "som_records").select("record_id", E.within_budget(F.col("som_json"), 1000).alias("delivered")).distinct()


@query(f"SELECT page_id, CASE WHEN som_bytes > 0 THEN round(html_bytes / som_bytes::DOUBLE, 6) END AS compression_ratio, CAST(ceil(som_bytes / 4.0) AS BIGINT) AS tokens, html_bytes // 4 AS html_tokens, som_bytes // 4 AS som_tokens, CASE WHEN html_bytes // 4 > 0 THEN round(100.0 * (1 - (som_bytes // 4) / (html_bytes // 4)::DOUBLE), 1) END AS savings_percent FROM {_P}")
def token_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of page source and tree, and what the tree saves."""
    html, som = F.floor(F.col("html_bytes") / 4).cast("bigint"), F.floor(F.col("som_bytes") / 4).cast("bigint")
    ratio = F.when(F.col("som_bytes") > 0, round6(F.col("html_bytes") / F.col("som_bytes")))
    return pages(spark, d).select("page_id", ratio.alias("compression_ratio"), T.token_estimate(F.col("som_bytes")).alias("tokens"), html.alias("html_tokens"), som.alias("som_tokens"), F.when(html > 0, F.round(100.0 * (1 - som / html), 1)).alias("savings_percent"))


def _select_sql(match: str) -> str:
    return f"SELECT element_key FROM (SELECT element_key, m, max(m) OVER (PARTITION BY page_id) AS hit FROM (SELECT e.*, coalesce({match}, false) AS m FROM {_E} e LEFT JOIN {_R} r USING (page_id, region_ord))) WHERE m OR NOT hit"


@query(_select_sql("region_role = 'main'"))
def select_main(spark: SparkSession, d: str) -> DataFrame:
    """The main region's elements of each page, or the whole page."""
    return E.select(placed(spark, d, "html_id"), "main").select("element_key")


@query(_select_sql("role = 'text_input'"))
def select_inputs(spark: SparkSession, d: str) -> DataFrame:
    return E.select(placed(spark, d, "role"), "textbox").select("element_key")


@query(_select_sql("list_contains(list_transform(actions, lambda x: lower(x)), 'click')"))
def select_click(spark: SparkSession, d: str) -> DataFrame:
    return E.select(placed(spark, d, "actions"), "action: Click").select("element_key")


@query(_select_sql("region_id = 'r_footer'"))
def select_region_id(spark: SparkSession, d: str) -> DataFrame:
    return E.select(placed(spark, d, "html_id"), "#r_footer").select("element_key")


@query(f"SELECT element_key FROM {_E} WHERE contains(lower(text), 'garden') OR contains(lower(label), 'garden')")
def find_text(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, "", E.by_text("Garden"))


@query(f"SELECT element_key, role FROM {_E} WHERE list_contains(hints, 'primary') AND role IN ('paragraph', 'heading')")
def find_hint(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, "role", E.by_hint("primary") & (E.by_role("Paragraph") | E.by_role("heading")))


@query(f"""WITH x AS (SELECT page_id, element_key, role, label, text, {_attr('href')} AS href, lower({_attr('disabled')}) = 'true' AS disabled FROM {_E} WHERE len(actions) > 0)
 SELECT page_id, count(*) AS total, count(*) FILTER (WHERE NOT coalesce(disabled, false)) AS enabled, count(*) FILTER (WHERE role = 'link' AND contains(lower(coalesce(label, text)), 'news')) AS matched FROM x GROUP BY 1""")
def interactive_filter(spark: SparkSession, d: str) -> DataFrame:
    """Per page: action targets in all, enabled ones, and those a filter on role and label keeps."""
    rows = elements(spark, d, "page_id role text label attrs", E.has_actions()).groupBy("page_id")
    named = (F.col("role") == "link") & E.parts(F.coalesce("label", "text"), "news")
    return rows.agg(F.count("*").alias("total"), F.count_if(~E.truthy("disabled")).alias("enabled"), F.count_if(named).alias("matched"))


@query(f"SELECT page_id, arg_min(text, struct_pack(a := el_ord, b := element_key)) AS value, arg_min(id, struct_pack(a := el_ord, b := element_key)) AS provenance FROM (SELECT page_id, el_ord, element_key, coalesce(text, chr(0)) AS t, text, id FROM {_E} WHERE role = 'heading' AND {_attr('level')} = '1') GROUP BY 1")
def first_heading(spark: SparkSession, d: str) -> DataFrame:
    return E.field(elements(spark, d, "page_id el_ord id role text attrs", "role = 'heading'", by="page_id"), "heading", 1)


@query(f"SELECT page_id, arg_min(text, struct_pack(a := el_ord, b := element_key)) AS value, arg_min(id, struct_pack(a := el_ord, b := element_key)) AS provenance FROM {_E} WHERE regexp_matches(text, '[0-9]+ crowns') GROUP BY 1")
def first_price(spark: SparkSession, d: str) -> DataFrame:
    return E.field_matching(elements(spark, d, "page_id el_ord id text", F.col("text").rlike(r"[0-9]+ crowns"), by="page_id"), r"[0-9]+ crowns")


_PLAN = f"""SELECT e.page_id, el_ord, element_key, id, role, coalesce(nullif(label,''), nullif(text,'')) AS label, nullif(html_id,'') AS html_id, b IS NULL AS enabled, b AS blocked_reason, nullif(href,'') AS href, nullif(input_type,'') AS input_type, form_action, form_method FROM
 (SELECT *, {_attr('href')} AS href, {_attr('input_type')} AS input_type, CASE WHEN lower({_attr('inert')}) = 'true' THEN 'inert' WHEN lower({_attr('disabled')}) = 'true' THEN 'disabled' WHEN {_attr('inert')} IS NULL AND lower(coalesce({_attr('readonly')}, {_attr('aria.readonly')})) = 'true' THEN 'readonly' END AS b FROM {_E} WHERE len(actions) > 0) e
 LEFT JOIN {_R} r ON r.page_id = e.page_id AND r.region_ord = e.region_ord"""


@query(_PLAN)
def action_plan(spark: SparkSession, d: str) -> DataFrame:
    """Action targets of each page with state and form context."""
    plan = E.action_plan(placed(spark, d, _TARGET, E.has_actions()))
    return plan.select("page_id", "el_ord", "element_key", "id", "role", "label", "html_id", "enabled", "blocked_reason", "href", "input_type", "form_action", "form_method")


_FIELDS = f"""WITH t AS (SELECT page_id, element_key, attrs, json_extract(attrs, '$.aria') AS aria FROM {_E} WHERE len(actions) > 0 AND json_valid(attrs) AND json_type(attrs) = 'OBJECT'),
 o AS (SELECT * FROM (SELECT page_id, element_key, k AS field, json_extract_string(attrs, '$."' || k || '"') AS value FROM (SELECT *, unnest(json_keys(attrs)) AS k FROM t)) WHERE value IS NOT NULL AND (field IN ({", ".join(f"'{n}'" for n in E.PLAN_TEXT)}) AND value NOT IN ('', '[]', 'false') OR field IN ({", ".join(f"'{n}'" for n in E.PLAN_ANY)}))),
 m AS (SELECT page_id, element_key, CASE WHEN k IN ('autocomplete', 'placeholder', 'label') THEN 'aria_' || k ELSE k END AS field, json_extract_string(aria, '$."' || k || '"') AS value FROM (SELECT *, unnest(json_keys(aria)) AS k FROM t WHERE json_type(aria) = 'OBJECT') WHERE k IN ({", ".join(f"'{n}'" for n in E.PLAN_STATES)}))
 SELECT * FROM o UNION ALL SELECT m.* FROM m ANTI JOIN o ON m.element_key = o.element_key AND m.field = o.field"""


@query(_FIELDS)
def action_plan_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every attribute and state that an action plan names, a row each."""
    return E.plan_fields(elements(spark, d, "page_id actions attrs", E.has_actions() & F.col("attrs").isNotNull()))


_KEY_PARTS = f"[id, role, coalesce(nullif(label, ''), nullif(text, '')), array_to_string(list_sort(actions), ','), {_attr('name')}, {_attr('href')}, {_attr('input_type')}, {_attr('group')}, {_attr('placeholder')}]"
_ESCAPED = "list_transform(string_split(to_json(list_transform(p, lambda x: nullif(x, '')))::VARCHAR, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE chr(92) || 'u' || lpad(printf('%x', unicode(c)), 4, '0') END)"


@query(f"""SELECT element_key, 'action:v1:' || lpad(printf('%x', list_reduce(list_transform(string_split(array_to_string({_ESCAPED}, ''), ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::BIGINT)), 8, '0') AS cache_key FROM (SELECT element_key, {_KEY_PARTS} AS p FROM {_E} WHERE len(actions) > 0)""")
def action_plan_keys(spark: SparkSession, d: str) -> DataFrame:
    """The stable key of each action target."""
    from treelake.functions.digests import action_keys

    plan = E.action_plan(placed(spark, d, _TARGET, E.has_actions()))
    parts = F.array("id", "role", "label", F.array_join(F.array_sort("actions"), ","), "name", "href", "input_type", "group", "placeholder")
    return plan.select("element_key", action_keys(parts).alias("cache_key"))


@query(f"SELECT page_id, label, arg_min(element_key, struct_pack(a := el_ord, b := element_key)) AS element_key FROM ({_PLAN}) WHERE label IS NOT NULL GROUP BY 1, 2")
def action_index(spark: SparkSession, d: str) -> DataFrame:
    return E.plan_index(E.action_plan(placed(spark, d, _TARGET, E.has_actions())), "label")


@query(f"""SELECT element_key FROM (SELECT *, row_number() OVER (PARTITION BY page_id, region_ord, role ORDER BY el_ord, element_key) AS nth FROM
 (SELECT *, row_number() OVER (PARTITION BY page_id, region_ord, target ORDER BY el_ord, element_key) AS seen FROM (SELECT e.*, region_role, CASE WHEN role = 'link' THEN regexp_replace(regexp_replace({_attr('href')}, '#.*$', ''), '/$', '') END AS target FROM {_E} e LEFT JOIN {_R} r USING (page_id, region_ord)))
 WHERE coalesce(target, '') = '' OR seen = 1) WHERE CASE role WHEN 'link' THEN nth <= CASE WHEN region_role = 'navigation' THEN 3 ELSE 5 END WHEN 'paragraph' THEN nth <= 2 ELSE true END""")
def region_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Elements within the budgets of their regions, here small ones."""
    return E.budgets(placed(spark, d, "el_ord role attrs"), most_links=5, most_navigation_links=3, most_paragraphs=2).select("element_key")


@query(f"SELECT page_id, place, left(id, 256) AS id, role, left(text, 512) AS text, left(label, 512) AS label FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY el_ord, element_key) AS place FROM {_E} WHERE region_ord < 32) WHERE place <= 256")
def compact_structure(spark: SparkSession, d: str) -> DataFrame:
    """The bounded structure of each page; the bounds are the feature."""
    return E.compact(elements(spark, d, "page_id region_ord el_ord id role text label actions", "region_ord < 32", by="page_id")).drop("actions")


@query(f"""WITH p AS (SELECT e.*, region_role, region_label FROM {_E} e LEFT JOIN {_R} r USING (page_id, region_ord)), n AS (SELECT DISTINCT page_id, region_ord, -1 AS el_ord, -1 AS element_key, region_role AS role, region_label AS name FROM p UNION ALL SELECT page_id, region_ord, el_ord, element_key, role, coalesce(label, text) FROM p),
 k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY region_ord, el_ord, element_key) AS node_id FROM n) SELECT page_id, node_id, CASE WHEN el_ord >= 0 THEN min(node_id) OVER (PARTITION BY page_id, region_ord) ELSE 0 END AS parent_id, role, name FROM k""")
def accessibility_tree(spark: SparkSession, d: str) -> DataFrame:
    return E.accessibility_nodes(placed(spark, d, "el_ord role text label"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url, html): each page written as HTML from its title and elements, a source for the compiler."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    tag = F.when(F.col("role") == "heading", F.concat(F.lit("h"), F.least(F.greatest(F.coalesce(E.attr("level").try_cast("int"), F.lit(2)), F.lit(1)), F.lit(6)).cast("string")))
    tag = tag.when(F.col("role") == "paragraph", "p").when(F.col("role") == "link", "a").when(F.col("role") == "button", "button").otherwise("div")
    items = F.transform(F.from_json(E.attr("items"), "array<struct<text:string>>"), lambda x: F.concat(F.lit("<li>"), escaped(x["text"])))
    inner = F.when(F.col("role") == "list", F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>"))).otherwise(escaped(F.col("text")))
    opening = F.concat(F.lit("<"), tag, F.when(F.col("role") == "link", F.concat(F.lit(' href="'), escaped(E.attr("href")), F.lit('"'))).otherwise(""), F.lit(">"))
    line = F.array(F.concat(opening, F.coalesce(inner, F.lit("")), F.lit("</"), tag, F.lit(">")))
    body = E.ordered_parts(elements(spark, d, "page_id el_ord role text attrs", by="page_id"), ["page_id"], line)
    html = F.concat(F.lit("<html><head><title>"), escaped(F.col("title")), F.lit("</title></head><body><main>"), F.array_join("lines", "\n"), F.lit("</main></body></html>"))
    return pages(spark, d).select("page_id", "url", "title").join(body, "page_id").select("page_id", "url", html.alias("html"))


@query()
def compiled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page compiled from its HTML: tree, sizes and counts."""
    return compile_pages(sources(spark, d))


@query(f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY el_ord, element_key) - 1 AS nth, least(greatest(coalesce(try_cast({_attr('level')} AS INTEGER), 2), 1), 6) AS level,
 nullif(trim(regexp_replace(text, '[\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')), '') AS text FROM {_E} JOIN (SELECT page_id FROM {_P}) USING (page_id) WHERE role = 'heading'""")
def compiled_headings(spark: SparkSession, d: str) -> DataFrame:
    """The headings of every compiled page, in order."""
    element = "array<struct<role:string,text:string,attrs:struct<level:int>>>"
    regions_ = F.from_json(F.get_json_object("som_json", "$.regions"), f"array<struct<role:string,elements:{element}>>")
    found = F.filter(F.flatten(F.transform(regions_, lambda r: r["elements"])), lambda e: e["role"] == "heading")
    rows = compiled_pages(spark, d).select("page_id", F.posexplode(found).alias("nth", "e"))
    return rows.select("page_id", "nth", F.col("e.attrs.level").alias("level"), F.col("e.text").alias("text"))


@query(f"""SELECT page_id, region_ord, CASE WHEN n = 0 THEN 'r_' || region_role ELSE 'r_' || region_role || '_' || n END AS generated_id FROM (SELECT page_id, region_ord, region_role, row_number() OVER (PARTITION BY page_id, region_role ORDER BY region_ord) - 1 AS n FROM {_R})""")
def region_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of regions by role and number within the page."""
    n = F.row_number().over(Window.partitionBy("page_id", "role").orderBy("region_ord")) - 1
    own = F.concat(F.lit("r_"), F.col("role"))
    return regions(spark, d).withColumn("n", n).select("page_id", "region_ord", F.when(F.col("n") == 0, own).otherwise(F.concat(own, F.lit("_"), F.col("n"))).alias("generated_id"))


@query(f"""SELECT element_key, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS stable_id FROM (SELECT element_key, base, row_number() OVER (PARTITION BY page_id, base ORDER BY el_ord, element_key) AS n FROM
 (SELECT element_key, page_id, el_ord, 'e_' || substr(sha256(site || '|' || role || '|' || left(trim(lower(coalesce(label, text, ''))), 100) || '|' || region_ord), 1, 12) AS base FROM {_E}))""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content-derived ids of elements, numbered where they fall together."""
    name = F.left(F.trim(F.lower(F.coalesce("label", "text", F.lit("")))), F.lit(100))
    base = F.concat(F.lit("e_"), F.substring(F.sha2(F.concat_ws("|", "site", "role", name, F.col("region_ord").cast("string")), 256), 1, 12))
    rows = elements(spark, d, "page_id region_ord el_ord site role text label", "site is not null and role is not null and region_ord is not null", by="page_id").withColumn("base", base)
    n = F.row_number().over(Window.partitionBy("page_id", "base").orderBy("el_ord", "element_key"))
    return rows.withColumn("n", n).select("element_key", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("n"))).alias("stable_id"))


_PAIRS = f"(SELECT page_id AS pair_id, old_page, page_id AS new_page FROM (SELECT page_id, url, lag(page_id) OVER (PARTITION BY url ORDER BY captured_at, page_id) AS old_page FROM {_P}) WHERE old_page IS NOT NULL AND url IS NOT NULL)"
_LAST_R = f"(SELECT page_id, region_id, arg_max(region_role, region_ord) AS role, arg_max(coalesce(region_label, chr(1)), region_ord) AS label FROM {_R} GROUP BY 1, 2)"


@query(f"""WITH p AS {_PAIRS}, r AS {_LAST_R}, o AS (SELECT pair_id, region_id, role, label FROM r JOIN p ON r.page_id = p.old_page), n AS (SELECT pair_id, region_id, role, label FROM r JOIN p ON r.page_id = p.new_page)
 SELECT coalesce(o.pair_id, n.pair_id) AS pair_id, coalesce(o.region_id, n.region_id) AS region_id, CASE WHEN o.pair_id IS NULL THEN 'added' WHEN n.pair_id IS NULL THEN 'removed' WHEN o.role IS DISTINCT FROM n.role OR o.label IS DISTINCT FROM n.label THEN 'modified' ELSE 'same' END AS change,
 coalesce(o.role = 'main', false) OR coalesce(n.role = 'main', false) AS was_main FROM o FULL JOIN n ON o.pair_id = n.pair_id AND o.region_id = n.region_id""")
def region_changes(spark: SparkSession, d: str) -> DataFrame:
    """Regions of recaptured pages against the capture before."""
    return page_diff.region_changes(regions(spark, d), page_diff.captures(pages(spark, d)))


_SAME_R = f"(SELECT coalesce(o.pair_id, n.pair_id) AS pair_id, o.region_id, coalesce(o.role = 'main', false) OR coalesce(n.role = 'main', false) AS was_main, o.role IS DISTINCT FROM n.role OR o.label IS DISTINCT FROM n.label AS modified FROM (SELECT pair_id, region_id, role, label FROM {_LAST_R} r JOIN {_PAIRS} p ON r.page_id = p.old_page) o JOIN (SELECT pair_id, region_id, role, label FROM {_LAST_R} r JOIN {_PAIRS} p ON r.page_id = p.new_page) n ON o.pair_id = n.pair_id AND o.region_id = n.region_id)"
_LAST_E = f"(SELECT page_id, region_id, id, arg_max(struct_pack(role := role, text := text, attrs := attrs, actions := coalesce(array_to_string(actions, ','), ''), hints := coalesce(array_to_string(hints, ','), '')), el_ord) AS x FROM {_E} JOIN {_R} USING (page_id, region_ord) GROUP BY 1, 2, 3)"
_PRICE = "coalesce(regexp_matches(o.x.text, '[$€£¥][[:space:]]*[0-9,]+'), false) OR coalesce(regexp_matches(n.x.text, '[$€£¥][[:space:]]*[0-9,]+'), false)"
_ELEMENT_CHANGES = f"""WITH m AS {_SAME_R}, e AS {_LAST_E}, p AS {_PAIRS}, o AS (SELECT p.pair_id, e.region_id, id, x, was_main FROM e JOIN p ON e.page_id = p.old_page JOIN m ON m.pair_id = p.pair_id AND m.region_id = e.region_id),
 n AS (SELECT p.pair_id, e.region_id, id, x, was_main FROM e JOIN p ON e.page_id = p.new_page JOIN m ON m.pair_id = p.pair_id AND m.region_id = e.region_id)
 SELECT pair_id, region_id, id, change, text_differs AND change = 'modified' AS text_changed, price, was_main FROM (SELECT coalesce(o.pair_id, n.pair_id) AS pair_id, coalesce(o.region_id, n.region_id) AS region_id, coalesce(o.id, n.id) AS id, o.x.text IS DISTINCT FROM n.x.text AS text_differs, {_PRICE} AS price, coalesce(o.was_main, n.was_main) AS was_main,
 CASE WHEN o.pair_id IS NULL THEN 'added' WHEN n.pair_id IS NULL THEN 'removed' WHEN o.x.text IS DISTINCT FROM n.x.text OR o.x.role IS DISTINCT FROM n.x.role OR o.x.attrs IS DISTINCT FROM n.x.attrs OR o.x.actions IS DISTINCT FROM n.x.actions OR o.x.hints IS DISTINCT FROM n.x.hints THEN 'modified' ELSE 'same' END AS change
 FROM o FULL JOIN n ON o.pair_id = n.pair_id AND o.region_id = n.region_id AND o.id = n.id) WHERE change <> 'same'"""


#: Columns that page diffs read.
_COMPARED = "page_id region_ord el_ord id role text attrs actions hints"


@query(_ELEMENT_CHANGES)
def element_changes(spark: SparkSession, d: str) -> DataFrame:
    return page_diff.element_changes(elements(spark, d, _COMPARED), regions(spark, d), page_diff.captures(pages(spark, d)))


@query(f"""WITH r AS ({SQL['region_changes']}), e AS ({_ELEMENT_CHANGES}), rs AS (SELECT pair_id, count(*) FILTER (change = 'added') AS ra, count(*) FILTER (change = 'removed') AS rr, count(*) FILTER (change = 'modified') AS rm FROM r GROUP BY 1),
 es AS (SELECT pair_id, count(*) FILTER (change = 'added') AS ea, count(*) FILTER (change = 'removed') AS er, count(*) FILTER (change = 'modified') AS em, bool_or(text_changed AND price) AS pc, bool_or(text_changed AND was_main) AS cc FROM e GROUP BY 1)
 SELECT pair_id, coalesce(ra, 0) AS regions_added, coalesce(rr, 0) AS regions_removed, coalesce(rm, 0) AS regions_modified, coalesce(ea, 0) AS elements_added, coalesce(er, 0) AS elements_removed, coalesce(em, 0) AS elements_modified, coalesce(ra, 0) + coalesce(rr, 0) + coalesce(rm, 0) + coalesce(ea, 0) + coalesce(er, 0) + coalesce(em, 0) AS total_changes,
 coalesce(pc, false) AS has_price_changes, coalesce(cc, false) AS has_content_changes, coalesce(ra, 0) + coalesce(rr, 0) + coalesce(ea, 0) + coalesce(er, 0) > 0 AS has_structural_changes FROM {_PAIRS} LEFT JOIN rs USING (pair_id) LEFT JOIN es USING (pair_id)""")
def page_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Counts and flags of every recapture."""
    return page_diff.summary(elements(spark, d, _COMPARED), regions(spark, d), page_diff.captures(pages(spark, d)))


_KEY = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^([^?]*[^/?])/+(\\?.*)?$', '\\1\\2')"


@query(f"""SELECT page_id, sha256(url) AS url_sha256, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) || ':' || CASE WHEN url LIKE 'https:%' THEN '443' ELSE '80' END AS origin,
 CASE WHEN length(regexp_replace(url, '^https?://', '')) > 50 THEN left(regexp_replace(url, '^https?://', ''), 47) || '...' ELSE regexp_replace(url, '^https?://', '') END AS short_url FROM {_P}""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return pages(spark, d).select("page_id", F.sha2(url, 256).alias("url_sha256"), U.origin(url).alias("origin"), U.shorten(url).alias("short_url"))


@query("""WITH k AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^([^?]*[^/?])/+(\\?.*)?$', '\\1\\2') AS c FROM """ + _P + """)
 SELECT page_id, CASE WHEN regexp_matches(c, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+$') THEN c || '/' ELSE c END || '::selector=main' AS cache_key, CASE WHEN NOT regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]') THEN 'invalid' WHEN NOT regexp_matches(lower(trim(url)), '^https?://') THEN 'scheme' WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#]*@') THEN 'credentials' END AS blocked FROM k""")
def url_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.cache_key(F.col("url"), F.lit(" Main ")).alias("cache_key"), U.outbound_policy("url").alias("blocked"))


_RULES = [(1, "*-1.example/*", None, "block"), (2, "https://*?ref=*", "Document", "continue_marked"), (3, "*garden*", None, "log"), (4, "*.html", "Document", "fulfill")]


@query(f"""WITH r(rule_ord, pat, action) AS (VALUES (1, '%-1.example/%', 'block'), (2, 'https://%?ref=%', 'continue_marked'), (3, '%garden%', 'log'), (4, '%.html', 'fulfill'))
 SELECT page_id AS request_id, coalesce(arg_min(action, rule_ord), 'continue') AS action, min(rule_ord) AS rule_ord FROM {_P} p LEFT JOIN r ON p.url LIKE r.pat GROUP BY 1""")
def intercepted(spark: SparkSession, d: str) -> DataFrame:
    """What the first matching interception rule does with each url."""
    rules = spark.createDataFrame(_RULES, "rule_ord int, url_glob string, resource_type string, action string")
    return policy.intercept(pages(spark, d).select(F.col("page_id").alias("request_id"), "url", F.lit("Document").alias("resource_type")), rules)


_ROBOTS = "User-agent: *\nDisallow: /garden\nAllow: /garden-chair\nDisallow: /*days-at\nUser-agent: reader\nDisallow: /notes"


@query(f"""WITH t AS (SELECT DISTINCT site AS host, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) AS path FROM {_P}), r(directive, rule, pat, n) AS (VALUES ('disallow', '/garden', '/garden%', 7), ('allow', '/garden-chair', '/garden-chair%', 13), ('disallow', '/*days-at', '/%days-at%', 8))
 SELECT host, path, coalesce(arg_min(directive, struct_pack(a := -n, b := directive)), 'allow') = 'allow' AS allowed, CASE WHEN min(rule) IS NULL THEN 'no_matching_rule' ELSE arg_min(directive, struct_pack(a := -n, b := directive)) || '_rule' END AS reason, arg_min(rule, struct_pack(a := -n, b := directive)) AS rule
 FROM t LEFT JOIN r ON t.path LIKE r.pat WHERE t.path <> '' GROUP BY 1, 2""")
def robots_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether a crawler may fetch each page under one robots file on every site."""
    targets = pages(spark, d).select(F.col("site").alias("host"), F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1).alias("path")).filter("path <> ''").distinct()
    files = targets.select("host").distinct().withColumn("robots_txt", F.lit(_ROBOTS))
    return policy.robots_decisions(targets, policy.parsed_robots(files), "spider")


_HOSTS = f"(SELECT DISTINCT site AS host, length(site) % 6 AS k FROM {_P} WHERE site IS NOT NULL)"
_CLASS = "CASE k WHEN 1 THEN 'unavailable' WHEN 2 THEN 'unreachable' WHEN 3 THEN 'invalid_too_large' WHEN 4 THEN 'unreachable' ELSE 'available' END"


@query(f"""WITH d AS ({SQL['robots_decisions']}) SELECT host, path, CASE WHEN c = 'available' THEN allowed ELSE c = 'unavailable' END AS allowed, CASE c WHEN 'available' THEN reason WHEN 'unavailable' THEN 'robots_unavailable' WHEN 'invalid_too_large' THEN 'robots_invalid' ELSE 'robots_unreachable' END AS reason,
 CASE WHEN c = 'available' THEN rule END AS rule, c AS classification, (k NOT IN (3, 4))::INTEGER AS checks_completed, (k IN (3, 4))::INTEGER AS checks_failed FROM (SELECT d.*, k, {_CLASS} AS c FROM d JOIN {_HOSTS} USING (host))""")
def robots_failures(spark: SparkSession, d: str) -> DataFrame:
    """Whether a crawler may fetch each page where some robots files could not be fetched."""
    targets = pages(spark, d).select(F.col("site").alias("host"), F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1).alias("path")).filter("path <> ''").distinct()
    k = F.length("host") % 6
    fetches = targets.select("host").distinct().select("host", F.lit(_ROBOTS).alias("robots_txt"), F.when(k == 1, 404).when(k == 2, 503).when(~k.isin(3, 4), 200).alias("http_status"), F.when(k == 3, "too_large").when(k == 4, "timeout").alias("failure"))
    return policy.robots_policies(targets, fetches, "spider")


@query(f"""SELECT fetch_id, CASE WHEN old_at IS NULL THEN 'miss' WHEN epoch_us(captured_at) - epoch_us(old_at) > 300000000 THEN 'expired' WHEN old_hash = hash THEN 'hit' ELSE 'stale' END AS outcome FROM (SELECT page_id AS fetch_id, captured_at, md5(coalesce(title, '')) AS hash, lag(captured_at) OVER w AS old_at, lag(md5(coalesce(title, ''))) OVER w AS old_hash FROM (SELECT *, {_KEY} AS k FROM {_P}) WINDOW w AS (PARTITION BY k ORDER BY captured_at, page_id))""")
def cache_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Cache result of each capture of a url: hit, stale, expired or miss."""
    fetches = pages(spark, d).select(F.col("page_id").alias("fetch_id"), "url", F.col("captured_at").alias("fetched_at"), F.md5(F.coalesce("title", F.lit(""))).alias("content_hash"))
    return policy.cache_outcomes(fetches).select("fetch_id", "outcome")


_COSTS = "(SELECT DISTINCT * EXCLUDE (received_at) FROM token_costs)"


def costs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "token_costs")
    return latest(rows, ["cost_id"], ["received_at"] if "received_at" in rows.columns else None)


@query("SELECT outcome, count(*) AS runs FROM (SELECT CASE WHEN error IS NULL OR trim(error) = '' THEN 'ok' WHEN regexp_matches(error, '(?i)blocked|denied|forbidden|captcha|human|unusual traffic') THEN 'blocked' ELSE 'failed' END AS outcome FROM (SELECT DISTINCT cost_id, error FROM token_costs)) GROUP BY 1")
def coverage_outcomes(spark: SparkSession, d: str) -> DataFrame:
    error = F.col("error")
    outcome = F.when(error.isNull() | (F.trim(error) == ""), "ok").when(error.rlike(scores.BLOCKED), "blocked").otherwise("failed")
    return costs(spark, d).select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("runs"))


@query("""WITH x AS (SELECT list_sort(list(ratio)) AS l, count(*) AS n, avg(ratio) AS mean FROM (SELECT DISTINCT cost_id, ratio FROM token_costs) WHERE ratio IS NOT NULL AND NOT isnan(ratio))
 SELECT n, round((l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2, 6) AS median, round(mean, 6) AS mean, round(l[CAST(least(ceil(n * 0.95), n - 1) AS BIGINT) + 1], 6) AS p95, round(l[CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1], 6) AS bench_p95 FROM x""")
def ratio_stats(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated median, mean and the two p95 rules of the byte ratio."""
    ranked = scores.ranked(costs(spark, d).withColumn("all", F.lit(1)), ["all"], "ratio")
    return ranked.select("n", *(round6(F.col(c)).alias(c) for c in ("median", "mean", "p95", "bench_p95")))


_D = "(SELECT DISTINCT * EXCLUDE (received_at) FROM delivery_measurements)"


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "delivery_measurements"), ["measurement_id"], ["received_at"])


@query(f"SELECT measurement_id, CASE WHEN source_html_bytes - delivered_bytes IS NOT NULL THEN greatest(source_html_bytes - delivered_bytes, 0) END AS not_delivered, delivered_bytes IS NOT NULL AND source_html_bytes IS NOT NULL AND delivered_bytes <= source_html_bytes AS consistent FROM {_D}")
def delivery_balance(spark: SparkSession, d: str) -> DataFrame:
    """What of each page was not delivered, and whether the numbers fit."""
    diff = F.col("source_html_bytes") - F.col("delivered_bytes")
    fits = F.col("delivered_bytes").isNotNull() & F.col("source_html_bytes").isNotNull() & (F.col("delivered_bytes") <= F.col("source_html_bytes"))
    return deliveries(spark, d).select("measurement_id", F.when(diff.isNotNull(), F.greatest(diff, F.lit(0))).alias("not_delivered"), F.coalesce(fits, F.lit(False)).alias("consistent"))


@query(f"""SELECT coalesce(kind, '*') AS kind, coalesce(operation, '*') AS operation, count(*) AS runs, sum(delivered_bytes) // 4 AS tokens FROM (SELECT coalesce(lower(trim(representation)), 'none') AS kind, coalesce(operation, 'none') AS operation, delivered_bytes FROM {_D} WHERE delivered_bytes > 0) GROUP BY GROUPING SETS ((kind, operation), (kind), ())""")
def delivery_table(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries by representation and operation, with subtotals."""
    rows = deliveries(spark, d).filter("delivered_bytes > 0").select(F.coalesce(F.lower(F.trim("representation")), F.lit("none")).alias("kind"), F.coalesce("operation", F.lit("none")).alias("operation"), "delivered_bytes")
    sets = rows.groupingSets([["kind", "operation"], ["kind"], []], "kind", "operation")
    return sets.agg(F.count("*").alias("runs"), F.floor(F.sum("delivered_bytes") / 4).cast("bigint").alias("tokens")).select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("operation", F.lit("*")).alias("operation"), "runs", "tokens")


@query("""WITH base(tasks, html_tokens, som_tokens, price) AS (VALUES (1000.0::DOUBLE, 33181.0::DOUBLE, 8301.0::DOUBLE, 3.0::DOUBLE)), v(parameter, factor) AS (VALUES ('tasks', 0.5::DOUBLE), ('tasks', 2.0::DOUBLE), ('html_tokens', 0.5::DOUBLE), ('html_tokens', 2.0::DOUBLE), ('som_tokens', 0.5::DOUBLE), ('som_tokens', 2.0::DOUBLE), ('price', 0.5::DOUBLE), ('price', 2.0::DOUBLE))
 SELECT parameter, factor, round(t * (h - s) * p / 1000000, 4) AS saved FROM (SELECT parameter, factor, tasks * CASE WHEN parameter = 'tasks' THEN factor ELSE 1 END AS t, html_tokens * CASE WHEN parameter = 'html_tokens' THEN factor ELSE 1 END AS h, som_tokens * CASE WHEN parameter = 'som_tokens' THEN factor ELSE 1 END AS s, price * CASE WHEN parameter = 'price' THEN factor ELSE 1 END AS p FROM base, v)""")
def token_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """One-at-a-time sensitivity of token savings; a table of parameters."""
    base = {"tasks": 1000.0, "html_tokens": 33181.0, "som_tokens": 8301.0, "price": 3.0}
    grid = spark.createDataFrame([(p, f) for p in base for f in (0.5, 2.0)], "parameter string, factor double")
    v = {p: F.lit(x) * F.when(F.col("parameter") == p, F.col("factor")).otherwise(1.0) for p, x in base.items()}
    return grid.select("parameter", "factor", F.round(v["tasks"] * (v["html_tokens"] - v["som_tokens"]) * v["price"] / 1e6, 4).alias("saved"))


@query("SELECT user_id, event_id, nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 128")
def trace_ring(spark: SparkSession, d: str) -> DataFrame:
    """The last 128 events of each user; the bound is the feature."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return table(spark, d, "events").select("user_id", "event_id", nth.alias("nth")).filter("nth <= 128")


@query("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events")
def session_history(spark: SparkSession, d: str) -> DataFrame:
    """Each event against the user's event before."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_type").over(by).alias("previous_type"), F.timestamp_diff("MICROSECOND", F.lag("ts").over(by), "ts").alias("gap_us"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS short_text FROM (SELECT doc_id, trim(regexp_replace(text, '[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS t FROM (SELECT DISTINCT doc_id, text FROM documents))")
def short_texts(spark: SparkSession, d: str) -> DataFrame:
    """The beginning of each document with white space collapsed."""
    rows = latest(table(spark, d, "documents").select("doc_id", "text", "received_at"), ["doc_id"], ["received_at"])
    return rows.select("doc_id", T.truncate(F.col("text"), 80).alias("short_text"))


_TAG = "corpus-urls-v1"


@query(f"SELECT site, sha256('{_TAG}'::BLOB || unhex(string_agg(lpad(printf('%x', strlen(url)), 16, '0') || hex(url::BLOB), '' ORDER BY captured_at, page_id))) AS digest, count(*) AS urls FROM {_P} WHERE url IS NOT NULL AND site IS NOT NULL GROUP BY 1")
def corpus_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each site's urls as captured, in order: a tag, then the length and the bytes of each url."""
    from treelake.functions.digests import ordered_digests

    return ordered_digests(pages(spark, d), _TAG, "site", ["captured_at", "page_id"], "url").withColumnRenamed("n", "urls")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
