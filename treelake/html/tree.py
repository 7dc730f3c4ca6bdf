"""HTML text to a tree of nodes, by the tree construction rules that real pages need.

Tokens come from the standard library. Built here: html, head and body where they are missing, implied
end tags, paragraphs closed by blocks, scopes, formatting elements reopened after misnesting (at most
three alike), implied table sections, and raw text. Content that tables push out is put before them.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

# Element sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
SPECIAL_BLOCKS = CLOSES_P | frozenset("li dd dt td th tr tbody thead tfoot caption body html select button".split())
TABLE_PARTS = {"tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "caption": ("table",), "colgroup": ("table",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Node:
    """An element (tag), a text (tag '#text') or a comment (tag '#comment')."""

    __slots__ = ("tag", "attrs", "children", "text", "parent", "off", "span")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None
        #: Set when a page is measured: whether nobody sees the node, and where its texts and links lie in the page's.
        self.off, self.span = False, (0,) * 8

    def add(self, child: Node, before: Node | None = None) -> Node:
        child.parent = self
        siblings = self.children
        at = siblings.index(before) if before is not None else len(siblings)
        if child.tag == "#text" and at and siblings[at - 1].tag == "#text":
            siblings[at - 1].text += child.text
            return siblings[at - 1]
        siblings.insert(at, child)
        return child

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def all_text(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag == "#text")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html = Node("html")
        self.head = self.html.add(Node("head"))
        self.body: Node | None = None
        self.open = [self.html, self.head]
        self.active: list[Node | None] = []
        #: Open elements by tag: what isn't open needs no search for its scope.
        self.count: Counter = Counter(("html", "head"))

    def _push(self, node: Node) -> None:
        self.open.append(node)
        self.count[node.tag] += 1

    def _pop(self) -> Node:
        node = self.open.pop()
        self.count[node.tag] -= 1
        return node

    # the stack of open elements
    def _in_scope(self, tags, stop=SCOPE) -> bool:
        if not any(self.count[t] for t in tags):
            return False
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag in stop:
                return False
        return False

    def _pop_to(self, tags) -> None:
        while len(self.open) > 1:
            if self._pop().tag in tags:
                return

    def _close_p(self) -> None:
        if self._in_scope(("p",), SCOPE | {"button"}):
            self._pop_to(("p",))

    def _to_body(self) -> None:
        if self.body is None:
            self.body = self.html.add(Node("body"))
            self.open = [self.html, self.body]
            self.count = Counter(("html", "body"))

    def _place(self, node: Node) -> Node:
        top = self.open[-1]
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr") and node.tag not in TABLE_PARTS and node.tag not in ("script", "style", "template", "#comment", "form", "input", "col") and not (node.tag == "#text" and not node.text.strip()):
            table = next(n for n in reversed(self.open) if n.tag == "table")
            if table.parent is not None:
                return table.parent.add(node, table)
        return top.add(node)

    def _reconstruct(self) -> None:
        at = len(self.active)
        while at and self.active[at - 1] is not None and self.active[at - 1] not in self.open:
            at -= 1
        for i in range(at, len(self.active)):
            old = self.active[i]
            new = self._place(Node(old.tag, dict(old.attrs)))
            self._push(new)
            self.active[i] = new

    def _remember(self, node: Node) -> None:
        alike = []
        for n in reversed(self.active):
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                alike.append(n)
        if len(alike) >= 3:
            self.active.remove(alike[-1])
        self.active.append(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given: dict[str, str] = {}
        for name, value in attrs:
            given.setdefault(name, value or "")
        if tag in ("html", "head", "body"):
            if tag == "body":
                self._to_body()
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            target.attrs = given | target.attrs
            return
        if self.body is None and tag not in HEAD:
            self._to_body()
        node = Node(tag, given)
        if self.body is not None:
            if tag in CLOSES_P:
                self._close_p()
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self._pop()
            if tag in ("li", "dd", "dt"):
                alike = ("li",) if tag == "li" else ("dd", "dt")
                for n in reversed(self.open) if any(self.count[t] for t in alike) else ():
                    if n.tag in alike:
                        self._pop_to(alike)
                        break
                    if n.tag in SPECIAL_BLOCKS and n.tag not in ("address", "div", "p"):
                        break
                self._close_p()
            if tag in ("option", "optgroup") and self.open[-1].tag == "option":
                self._pop()
            if tag == "optgroup" and self.open[-1].tag == "optgroup":
                self._pop()
            if tag in TABLE_PARTS:
                if not self._in_scope(("table",), frozenset(("html", "template"))):
                    return
                while self.open[-1].tag not in TABLE_PARTS[tag] and self.open[-1].tag not in ("table", "html") and not (tag in ("td", "th") and self.open[-1].tag in ("tbody", "thead", "tfoot")):
                    self._pop()
                if tag in ("tr", "td", "th") and self.open[-1].tag == "table":
                    self._push(self.open[-1].add(Node("tbody")))
                if tag in ("td", "th") and self.open[-1].tag != "tr":
                    self._push(self.open[-1].add(Node("tr")))
                self.active.append(None)
            if tag == "a":
                for n in reversed(self.active):
                    if n is None:
                        break
                    if n.tag == "a":
                        self.handle_endtag("a")
                        break
            if tag == "button" and self._in_scope(("button",)):
                self._pop_to(("button",))
            if tag not in TABLE_PARTS and tag not in CLOSES_P and tag not in HEAD and tag not in ("li", "dd", "dt", "option", "optgroup", "param", "source", "track"):
                self._reconstruct()
        placed = self._place(node)
        if tag in VOID:
            return
        self._push(placed)
        if tag in FORMATTING and self.body is not None:
            self._remember(placed)
        if tag in ("button", "object", "template"):
            self.active.append(None)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (self.count["svg"] or self.count["math"]):
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            self._to_body()
            return
        if tag == "p" and not self._in_scope(("p",), SCOPE | {"button"}):
            self._to_body()
            self._place(Node("p"))
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in FORMATTING and self.body is not None:
            self._end_formatting(tag)
            return
        tags = HEADINGS if tag in HEADINGS else (tag,)
        if self._in_scope(tags, frozenset(("html", "template")) if tag in TABLE_PARTS or tag in ("table", "template") else SCOPE):
            self._pop_to(tags)
            if tag in TABLE_PARTS or tag in ("table", "button", "object", "template"):
                while self.active and tag != "table" and self.active.pop() is not None:
                    pass

    def _end_formatting(self, tag: str) -> None:
        """The end of a formatting element that blocks may have opened inside of."""
        mine = None
        for n in reversed(self.active):
            if n is None:
                break
            if n.tag == tag:
                mine = n
                break
        if mine is None:
            if self._in_scope((tag,)):
                self._pop_to((tag,))
            return
        if mine not in self.open:
            self.active.remove(mine)
            return
        at = self.open.index(mine)
        block = next((i for i in range(at + 1, len(self.open)) if self.open[i].tag in SPECIAL_BLOCKS), None)
        if block is None:
            while len(self.open) > at:
                self._pop()
            self.active.remove(mine)
            return
        # the block moves out; what it held goes into a copy of the formatting element inside it
        outer, inner = self.open[block], mine.parent
        outer.parent.children.remove(outer)
        (inner or self.body).add(outer)
        copy = Node(tag, dict(mine.attrs))
        copy.children, outer.children = outer.children, []
        for child in copy.children:
            child.parent = copy
        outer.add(copy)
        self.active.remove(mine)
        self.count[self.open.pop(at).tag] -= 1

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if self.body is None:
            if top is not self.head and top.tag in ("title", "style", "script", "noscript", "template"):
                top.add(Node("#text", text=data))
                return
            if not data.strip():
                return
            self._to_body()
            data = data.lstrip()
        if self.open[-1].tag not in ("script", "style", "title", "textarea"):
            self._reconstruct()
        self._place(Node("#text", text=data))

    def handle_comment(self, data: str) -> None:
        if self.body is not None:
            self.open[-1].add(Node("#comment", text=data))


def parse(html: str) -> Node:
    """The html element of a document; head and body are always there."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder._to_body()
    return builder.html
