"""Queries over flattened page trees: filters, lookups, renderers, action plans.

All functions take element rows (page_id, region_ord, el_ord, id, html_id, role, text, label, actions,
hints, attrs) and stay in built-in expressions, so predicates and columns are pruned at the scan.
``el_ord`` is the pre-order position of an element in its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Role names, their aliases in selectors, and the interactive roles.
REGION_ROLES = {"main": "main", "nav": "navigation", "navigation": "navigation", "aside": "aside", "header": "header", "footer": "footer", "form": "form", "dialog": "dialog", "content": "content"}
ELEMENT_ROLES = {r: r for r in "link button text_input textarea select checkbox radio heading image list table paragraph section group separator details iframe".split()} | {"textbox": "text_input", "input": "text_input", "img": "image"}
INTERACTIVE_ROLES = ("link", "button", "text_input", "textarea", "select", "checkbox", "radio", "details")
INPUT_ROLES = ("text_input", "textarea", "select", "checkbox", "radio")

def by_page():
    return Window.partitionBy("page_id")


def attr(name: str) -> Column:
    """One attribute as text; null where attrs is absent or no object."""
    return F.get_json_object("attrs", f"$.{name}")


def truthy(name: str) -> Column:
    """Whether a boolean attribute is set: true, or written as the text true."""
    return F.coalesce(F.lower(attr(name)) == "true", F.lit(False))


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def has_actions() -> Column:
    return F.col("actions").isNotNull() & (F.size("actions") > 0)


def is_interactive() -> Column:
    return F.col("role").isin(*INTERACTIVE_ROLES)


def parts(c: Column, text: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))


def by_text(text: str) -> Column:
    """Text or label contains ``text`` in any case."""
    return parts(F.col("text"), text) | parts(F.col("label"), text)


def by_role(role: str) -> Column:
    """Role by name or alias, in any case and with - for _; an unknown role matches nothing."""
    name = ELEMENT_ROLES.get(role.strip().lower().replace("-", "_"))
    return F.col("role") == name if name else F.lit(False)


def by_action(action: str) -> Column:
    return F.coalesce(F.exists("actions", lambda a: F.lower(a) == action.strip().lower()), F.lit(False))


def by_hint(hint: str) -> Column:
    return F.coalesce(F.array_contains("hints", hint), F.lit(False))


def selector(text: str) -> tuple[Column | None, bool]:
    """(predicate over elements with region_role and region_id, whether ids come in two steps)."""
    s = text.strip()
    low = s.lower()
    if low in REGION_ROLES:
        return F.col("region_role") == REGION_ROLES[low], False
    if low.replace("-", "_") in ELEMENT_ROLES:
        return by_role(low), False
    if low == "interactive":
        return is_interactive(), False
    if low.startswith("action:") and low[7:].strip():
        return by_action(low[7:]), False
    if s.startswith("#"):
        return None, True
    return None, False


def select(placed: DataFrame, text: str) -> DataFrame:
    """The elements of each page that a selector picks; the whole page where it picks none.

    ``placed`` has region_role and region_id beside the element's columns. ``#id`` is tried as
    region id first, then as html id. An unknown selector picks whole pages. Null ids match nothing.
    """
    match, is_id = selector(text)
    if is_id:
        name = text.strip()[1:]
        in_region, in_html = F.coalesce(F.col("region_id") == name, F.lit(False)), F.coalesce(F.col("html_id") == name, F.lit(False))
        rows = placed.withColumn("__r", F.max(in_region).over(by_page())).withColumn("__h", F.max(in_html).over(by_page()))
        return rows.filter(F.when(F.col("__r"), in_region).when(F.col("__h"), in_html).otherwise(True)).drop("__r", "__h")
    if match is None:
        return placed
    match = F.coalesce(match, F.lit(False))
    rows = placed.withColumn("__any", F.max(match).over(by_page()))
    return rows.filter(match | ~F.col("__any")).drop("__any")


def with_regions(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """Elements with region_id, region_role and region_label; an element without region keeps nulls."""
    slim = regions.select("page_id", "region_ord", "region_id", F.col("role").alias("region_role"), F.col("label").alias("region_label"), "action", "method").dropDuplicates(["page_id", "region_ord"])
    return elements.join(slim, ["page_id", "region_ord"], "left")


def links(elements: DataFrame) -> DataFrame:
    """(page_id, href, first_ord, link_text): links to other places, each href once a page, first seen first."""
    href = attr("href")
    rows = elements.filter(F.col("role") == "link").withColumn("href", href).filter("href <> '' and href <> '#'")
    return rows.groupBy("page_id", "href").agg(F.min("el_ord").alias("first_ord"), F.min_by(F.coalesce("text", "label"), "el_ord").alias("link_text"))


def normal_href(href: Column) -> Column:
    """A link target without fragment and without one trailing slash."""
    bare = F.regexp_replace(href, r"#.*$", "")
    return F.regexp_replace(bare, r"/$", "")


def headings(elements: DataFrame) -> DataFrame:
    """(page_id, el_ord, id, level, text): level 0 where there is none."""
    level = F.coalesce(attr("level").try_cast("int"), F.lit(0))
    return elements.filter(F.col("role") == "heading").select("page_id", "el_ord", "id", level.alias("level"), "text")


#: What renderers read of attrs, parsed once an element.
RENDERED = "items array<struct<text:string>>, options array<struct<text:string>>, headers array<string>, rows array<array<string>>, caption string, level string, href string, alt string, src string, placeholder string, checked string"


def rendered() -> Column:
    """The attributes that renderers read; null where attrs is absent or no object."""
    return F.when(F.startswith(F.ltrim("attrs"), F.lit("{")), F.from_json("attrs", RENDERED))


def _row_texts(a: Column) -> tuple[Column, Column]:
    """A table's header line (in an array, empty without headers) and its lines of cells."""
    head = F.when(F.size(a["headers"]) > 0, F.array(F.array_join(a["headers"], " | "))).otherwise(F.array())
    return head, F.transform(F.filter(a["rows"], lambda r: F.size(r) > 0), lambda r: F.array_join(r, " | "))


def _texts_of(list_: Column) -> Column:
    return F.filter(F.transform(list_, lambda x: x["text"]), lambda t: t != "")


def _lines(*parts: Column) -> Column:
    """Arrays one after the other, absent ones passed over."""
    none = F.array().cast("array<string>")
    return F.filter(F.flatten(F.array(*(F.coalesce(p, none) for p in parts))), lambda t: t.isNotNull())


def visible_parts() -> Column:
    """An element's visible text: its text or else label, list items, options, table headers and rows."""
    a = rendered()
    head, rows = _row_texts(a)
    return _lines(F.array(F.coalesce(non_empty(F.col("text")), non_empty(F.col("label")))), _texts_of(a["items"]), _texts_of(a["options"]), head, rows)


def extracted_parts() -> Column:
    """An element's text without its label: text, items with bullets, caption, headers and rows."""
    a = rendered()
    head, rows = _row_texts(a)
    items = F.transform(F.filter(a["items"], lambda x: x["text"].isNotNull()), lambda x: F.concat(F.lit("• "), x["text"]))
    return _lines(F.array(non_empty(F.col("text"))), items, F.array(non_empty(a["caption"])), head, rows)


def ordered_parts(rows: DataFrame, keys: list[str], parts: Column) -> DataFrame:
    """(keys, lines) with the parts of each key's elements in page order; one key is one group."""
    lines = F.sort_array(F.collect_list(F.struct("el_ord", "element_key", parts.alias("__p"))))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(lines, lambda x: x["__p"])).alias("lines"))


def page_text(elements: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(page_id, content): the visible text of each page (or other keys), a line per text, item, option and row."""
    return ordered_parts(elements, keys or ["page_id"], visible_parts()).select(*(keys or ["page_id"]), F.array_join("lines", "\n").alias("content"))


def plain_parts() -> Column:
    """An element's trimmed text, caption, headers, rows and items, in this order."""
    a = rendered()
    head, rows = _row_texts(a)
    items = F.filter(F.transform(a["items"], lambda x: F.trim(x["text"])), lambda t: t != "")
    return _lines(F.array(non_empty(F.trim("text"))), F.array(non_empty(F.trim(a["caption"]))), head, rows, items)


def plain_text(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, content): the title of each page and its elements' plain parts, a line each."""
    body = ordered_parts(elements, ["page_id"], plain_parts())
    titled = pages.select("page_id", F.when(F.col("title") != "", F.array("title")).otherwise(F.array()).alias("__t"))
    return titled.join(body, "page_id", "left").select("page_id", F.array_join(_lines(F.col("__t"), F.col("lines")), "\n").alias("content"))


def cut_at_space(text: Column, most: int) -> Column:
    """At most ``most`` characters; a longer text ends at its last white space before that, and dots."""
    head = F.left(text, F.lit(most))
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(head, r"(?s)^(.*)\s.*?$", "$1"), F.lit("..."))).otherwise(text)


def extract_text(elements: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, content): title, blank line and the text of each page, cut at white space to ``most`` characters."""
    body = ordered_parts(elements, ["page_id"], extracted_parts())
    titled = pages.select("page_id", F.when(F.col("title") != "", F.array("title", F.lit(""))).otherwise(F.array()).alias("__t"))
    text = F.array_join(_lines(F.col("__t"), F.col("lines")), "\n")
    return titled.join(body, "page_id", "left").select("page_id", (text if most is None else cut_at_space(text, most)).alias("content"))


def within_budget(payload: Column, tokens: int) -> Column:
    """A payload of at most four bytes a token, or a note that it is larger: never a part of it."""
    note = F.concat(F.lit('{"truncated": true, "original_bytes": '), F.octet_length(payload).cast("string"), F.lit(f', "message": "SOM exceeded budget of {tokens} tokens"}}'))
    return F.when(F.octet_length(payload) > 4 * tokens, note).otherwise(payload)


def markdown_lines() -> Column:
    """One element's lines of Markdown."""
    a = rendered()
    text, label = F.coalesce("text", F.lit("")), F.coalesce("label", F.lit(""))
    words, named = F.coalesce(non_empty(F.col("text")), label), F.coalesce(non_empty(F.col("label")), text)
    role = F.col("role")

    def own(name: str, absent: str) -> Column:
        return F.when(a.isNull(), F.lit(absent)).otherwise(F.coalesce(a[name], F.lit("None")))

    def line(*parts: Column | str) -> Column:
        return F.array(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))

    level = a["level"].try_cast("int")
    level = F.when(level != 0, level).otherwise(1)
    place = F.when(a["placeholder"] != "", F.concat(F.lit(' placeholder="'), a["placeholder"], F.lit('"'))).otherwise("")
    check = F.when(F.coalesce(~a["checked"].isin("false", ""), F.lit(False)), "x").otherwise("")
    bars = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.when(F.size(a["headers"]) > 0, F.array(bars(a["headers"]), bars(F.transform(a["headers"], lambda _: F.lit("---")))))
    table = _lines(F.when(a["caption"] != "", F.array(a["caption"], F.lit(""))), head, F.transform(F.filter(a["rows"], lambda r: F.size(r) > 0), bars), F.when(a.isNull() & (text != ""), F.array(text)))
    options = F.transform(_texts_of(a["options"]), lambda t: F.concat(F.lit("- "), t))
    items = F.transform(a["items"], lambda x: F.concat(F.lit("- "), F.coalesce(x["text"], F.lit(""))))
    return (
        F.when(role == "heading", line(F.repeat(F.lit("#"), level + 2), " ", text))
        .when(role == "paragraph", F.array(text, F.lit("")))
        .when(role == "link", line("[", words, "](", own("href", "#"), ")"))
        .when(role == "button", line("[Button: ", text, "]"))
        .when(role == "image", line("![", own("alt", ""), "](", own("src", ""), ")"))
        .when(role.isin("text_input", "textarea"), line("[Input: ", label, F.coalesce(place, F.lit("")), "]"))
        .when(role == "select", _lines(line("[Select: ", named, "]"), options))
        .when(role.isin("checkbox", "radio"), line("[", check, "] ", words))
        .when(role == "list", F.coalesce(items, F.array().cast("array<string>")))
        .when(role == "table", F.when(F.size(table) > 0, F.array_append(table, F.lit(""))).otherwise(table))
        .when(role == "separator", F.array(F.lit("---")))
        .when(text != "", F.array(text))
        .otherwise(F.array().cast("array<string>"))
    )


def page_markdown(placed: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, content): each page as Markdown: title, url, a heading per region and its elements.

    ``placed`` are elements with page_id and region_ord, all three tables without repeated rows. A
    region without elements has its heading only; elements without a region are left out.
    """
    body = ordered_parts(placed, ["page_id", "region_ord"], markdown_lines())
    name = F.concat(F.lit("## "), F.initcap("role"), F.when(F.col("label") != "", F.concat(F.lit(": "), F.col("label"))).otherwise(""))
    blocks = regions.select("page_id", "region_ord", name.alias("__n")).join(body, ["page_id", "region_ord"], "left")
    block = F.concat(F.array("__n", F.lit("")), F.coalesce("lines", F.array().cast("array<string>")), F.array(F.lit("")))
    parts = blocks.groupBy("page_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("region_ord", block.alias("b")))), lambda x: x["b"])).alias("lines"))
    top = F.array(F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.concat(F.lit("URL: "), F.coalesce("url", F.lit(""))), F.lit(""))
    return pages.join(parts, "page_id", "left").select("page_id", F.array_join(_lines(top, F.col("lines")), "\n").alias("content"))


def meaningful() -> Column:
    """Interactive, or with text or label that isn't blank."""
    return is_interactive() | (F.trim(F.coalesce("text", F.lit(""))) != "") | (F.trim(F.coalesce("label", F.lit(""))) != "")


def compact(elements: DataFrame, most_regions: int = 32, most_elements: int = 256) -> DataFrame:
    """The bounded structure of a page: its first regions and elements, strings cut."""
    by = by_page().orderBy("el_ord", "element_key")
    rows = elements.filter(F.col("region_ord") < most_regions).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most_elements)
    return rows.select("page_id", "place", F.left("id", F.lit(256)).alias("id"), "role", F.left("text", F.lit(512)).alias("text"), F.left("label", F.lit(512)).alias("label"), F.slice("actions", 1, 8).alias("actions"))


def blocked_reason() -> Column:
    """Why an action target is blocked: inert before disabled; readonly, its own or else its state, counts only without inert."""
    readonly = F.coalesce(F.lower(F.coalesce(attr("readonly"), attr("aria.readonly"))) == "true", F.lit(False))
    return F.when(truthy("inert"), "inert").when(truthy("disabled"), "disabled").when(attr("inert").isNull() & readonly, "readonly")


def action_plan(placed: DataFrame) -> DataFrame:
    """Action targets of each page: label, state, form context and the attributes that tell them apart."""
    label = F.coalesce(non_empty(F.col("label")), non_empty(F.col("text")))
    fields = {n: non_empty(attr(n)) for n in ("href", "name", "input_type", "value", "placeholder", "group", "test_id")}
    rows = placed.filter(has_actions())
    return rows.select("page_id", "el_ord", "element_key", "id", "role", label.alias("label"), non_empty(F.col("html_id")).alias("html_id"), "actions", blocked_reason().isNull().alias("enabled"), blocked_reason().alias("blocked_reason"), *(c.alias(n) for n, c in fields.items()), F.col("action").alias("form_action"), F.col("method").alias("form_method"))


# Attributes of a target that a plan names where they aren't empty, where they are there at all, and states.
PLAN_TEXT = (
    "href target rel hreflang type referrerpolicy name accept selected_values autocomplete inputmode enterkeyhint autocapitalize dirname form list popovertarget popovertargetaction commandfor command popover "
    "button_type formaction formmethod formenctype formtarget accesskey title source_role test_id input_type value placeholder step pattern description group"
).split()
PLAN_ANY = "download capture multiple size formnovalidate spellcheck draggable minlength maxlength min max checked required readonly disabled inert".split()
PLAN_STATES = (
    "expanded readonly pressed selected current controls haspopup invalid placeholder autocomplete active_descendant errormessage keyshortcuts roledescription busy live atomic relevant owns flowto details multiline "
    "multiselectable orientation sort level posinset setsize grabbed dropeffect valuemin valuemax valuenow valuetext label labelledby describedby checked"
).split()
RENAMED_STATES = ("autocomplete", "placeholder", "label")


def plan_fields(elements: DataFrame) -> DataFrame:
    """(page_id, element_key, field, value): every field of every action target, the values as JSON text has them.

    An attribute of a target's own goes before the state of that name. Empty texts and lists are no
    fields where the plan wants a value. attrs that are no object give no fields.
    """
    own, states = F.from_json("attrs", "map<string,string>"), F.from_json(F.get_json_object("attrs", "$.aria"), "map<string,string>")
    named = F.filter(F.map_entries(own), lambda e: e["value"].isNotNull() & (e["key"].isin(*PLAN_TEXT) & ~e["value"].isin("", "[]", "false") | e["key"].isin(*PLAN_ANY)))
    renamed = lambda k: F.when(k.isin(*RENAMED_STATES), F.concat(F.lit("aria_"), k)).otherwise(k)
    extra = F.transform(F.filter(F.map_entries(states), lambda e: e["key"].isin(*PLAN_STATES)), lambda e: F.struct(renamed(e["key"]).alias("key"), e["value"].alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    rows = elements.filter(has_actions()).select("page_id", "element_key", F.coalesce(named, none).alias("__own"), F.coalesce(extra, none).alias("__more"))
    both = F.concat("__own", F.filter("__more", lambda e: ~F.exists("__own", lambda o: o["key"] == e["key"])))
    return rows.select("page_id", "element_key", F.explode(both).alias("e")).select("page_id", "element_key", F.col("e.key").alias("field"), F.col("e.value").alias("value"))


def plan_index(plan: DataFrame, key: str) -> DataFrame:
    """The first target of each page with each value of ``key`` (id, html_id, label, test_id)."""
    rows = plan.filter(F.col(key).isNotNull())
    return rows.groupBy("page_id", key).agg(F.min(F.struct("el_ord", "element_key")).alias("x")).select("page_id", key, F.col("x.element_key").alias("element_key"))


#: Keys of a target in the order in which a value is looked for among them.
TARGET_KEYS = ("id", "cache_key", "html_id", "test_id")


def find_targets(plan: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = TARGET_KEYS) -> DataFrame:
    """(page_id, value, element_key, found_by): the target of each wanted (page_id, value): by the first of ``keys`` that any target of the page has it as, the first such target.

    ``element_key`` and ``found_by`` are null where no target has the value. Null values find nothing.
    """
    known = F.array(*(F.struct(F.col(k).alias("value"), F.lit(i).alias("rank")) for i, k in enumerate(keys)))
    rows = plan.select("page_id", "el_ord", "element_key", F.explode(known).alias("k")).select("page_id", "k.value", "k.rank", "el_ord", "element_key").filter("value <> ''")
    first = rows.groupBy("page_id", "value").agg(F.min(F.struct("rank", "el_ord", "element_key")).alias("x"))
    names = F.array(*map(F.lit, keys))
    return wanted.select("page_id", "value").distinct().join(first, ["page_id", "value"], "left").select("page_id", "value", F.col("x.element_key").alias("element_key"), F.get(names, F.col("x.rank")).alias("found_by"))


def field(elements: DataFrame, role: str, level: int | None = None) -> DataFrame:
    """(page_id, value, provenance): the first element of a role (and heading level) per page."""
    rows = elements.filter(F.col("role") == role)
    if level is not None:
        rows = rows.filter(attr("level") == str(level))
    first = rows.groupBy("page_id").agg(F.min(F.struct("el_ord", "element_key", "text", "id")).alias("x"))
    return first.select("page_id", F.col("x.text").alias("value"), F.col("x.id").alias("provenance"))


def field_matching(elements: DataFrame, pattern: str) -> DataFrame:
    """(page_id, value, provenance): the first element per page whose text matches a pattern."""
    first = elements.filter(F.col("text").rlike(pattern)).groupBy("page_id").agg(F.min(F.struct("el_ord", "element_key", "text", "id")).alias("x"))
    return first.select("page_id", F.col("x.text").alias("value"), F.col("x.id").alias("provenance"))


def field_all(elements: DataFrame, role: str, props: list[str] | None = None) -> DataFrame:
    """(page_id, values, provenance, and an array per property): all elements of a role per page, in order; nulls keep their places in no array."""
    rows = elements.filter(F.col("role") == role)
    columns = {"values": F.col("text"), "provenance": F.col("id")} | {p: attr(p) for p in props or []}
    held = F.sort_array(F.collect_list(F.struct("el_ord", "element_key", *(c.alias(f"__{n}") for n, c in columns.items()))))
    grouped = rows.groupBy("page_id").agg(held.alias("x"))
    return grouped.select("page_id", *(F.col("x")[f"__{n}"].alias(n) for n in columns))


def resolve(elements: DataFrame, text: str, role: str | None = None) -> DataFrame:
    """(page_id, element_key): the first element of each page whose text contains ``text`` in any case and whose role is ``role``; without one the first by text alone."""
    rows = elements.filter(parts(F.col("text"), text))
    fits = F.coalesce(by_role(role), F.lit(False)) if role else F.lit(True)
    return rows.groupBy("page_id").agg(F.min(F.struct(~fits, "el_ord", "element_key")).alias("x")).select("page_id", F.col("x.element_key").alias("element_key"))


def interactive_window(targets: DataFrame, wanted: Column, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(page_id, element_key, total, matched): targets of each page that ``wanted`` keeps, after ``offset`` and up to ``limit`` of them, with how many there are and match."""
    keeps = F.coalesce(wanted, F.lit(False))
    rows = targets.withColumn("__m", keeps)
    rows = rows.withColumns({"total": F.count("*").over(by_page()), "matched": F.sum(F.col("__m").cast("bigint")).over(by_page()), "__n": F.row_number().over(Window.partitionBy("page_id", "__m").orderBy("el_ord", "element_key"))})
    within = F.col("__m") & (F.col("__n") > offset)
    return rows.filter(within if limit is None else within & (F.col("__n") <= offset + limit)).select("page_id", "element_key", "total", "matched")


def budgets(elements: DataFrame, most_links: int = 200, most_navigation_links: int = 80, most_paragraphs: int = 10, role: str = "region_role") -> DataFrame:
    """Elements of each region within its budgets: hrefs once, so many links and paragraphs, in order."""
    region = ["page_id", "region_ord"]
    rows = elements.withColumn("__href", F.when(F.col("role") == "link", normal_href(attr("href"))))
    seen = F.when(F.coalesce(F.col("__href"), F.lit("")) != "", F.row_number().over(Window.partitionBy(*region, "__href").orderBy("el_ord", "element_key"))).otherwise(1)
    rows = rows.withColumn("__seen", seen).filter("__seen = 1")
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*region, "role").orderBy("el_ord", "element_key")))
    links_most = F.when(F.col(role) == "navigation", most_navigation_links).otherwise(most_links)
    within = F.when(F.col("role") == "link", F.col("__nth") <= links_most).when(F.col("role") == "paragraph", F.col("__nth") <= most_paragraphs).otherwise(True)
    return rows.filter(within).drop("__href", "__seen", "__nth")


def accessibility_nodes(placed: DataFrame) -> DataFrame:
    """Regions as landmark nodes and elements as their children, ids by order in the page."""
    region = placed.select("page_id", "region_ord", F.lit(-1).alias("el_ord"), F.lit(-1).cast("bigint").alias("element_key"), F.col("region_role").alias("role"), F.col("region_label").alias("name")).dropDuplicates(["page_id", "region_ord"])
    own = placed.select("page_id", "region_ord", "el_ord", "element_key", "role", F.coalesce("label", "text").alias("name"))
    nodes = region.unionByName(own).withColumn("node_id", F.row_number().over(by_page().orderBy("region_ord", "el_ord", "element_key")))
    parent = F.when(F.col("el_ord") >= 0, F.min("node_id").over(Window.partitionBy("page_id", "region_ord"))).otherwise(0)
    return nodes.withColumn("parent_id", parent).select("page_id", "node_id", "parent_id", "role", "name")
