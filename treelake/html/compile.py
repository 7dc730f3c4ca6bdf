"""HTML to a page tree: typed regions and elements, metadata and counts, on the executors."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.functions.text import CLASS_HINTS, REGION_HINTS, collapse_text, normalize_text
from treelake.html.tree import Node, parse

# Roles of tags and ARIA roles, actions of roles, landmarks.
TAG_ROLES = {"button": "button", "textarea": "textarea", "select": "select", "img": "image", "picture": "image", "ul": "list", "ol": "list", "table": "table", "p": "paragraph", "section": "section", "article": "section", "fieldset": "group", "hr": "separator", "details": "details", "iframe": "iframe"} | {f"h{i}": "heading" for i in range(1, 7)}
ARIA_ROLES = {"button": "button", "link": "link", "checkbox": "checkbox", "switch": "checkbox", "menuitemcheckbox": "checkbox", "radio": "radio", "menuitemradio": "radio", "textbox": "text_input", "searchbox": "text_input", "slider": "text_input", "spinbutton": "text_input", "combobox": "select", "listbox": "select", "menuitem": "button", "tab": "button", "option": "button", "img": "image", "group": "group", "radiogroup": "group"}
INPUT_ROLES = {"submit": "button", "button": "button", "reset": "button", "image": "button", "checkbox": "checkbox", "radio": "radio", "hidden": None}
ACTIONS = {"link": ["click"], "button": ["click"], "text_input": ["type", "clear"], "textarea": ["type", "clear"], "select": ["select"], "checkbox": ["toggle"], "radio": ["select"], "details": ["toggle"]}
LANDMARKS = {"nav": "navigation", "main": "main", "aside": "aside", "header": "header", "footer": "footer", "dialog": "dialog"}
ARIA_LANDMARKS = {"navigation": "navigation", "main": "main", "complementary": "aside", "banner": "header", "contentinfo": "footer", "dialog": "dialog", "alertdialog": "dialog", "search": "search"}
CONSENT = re.compile(r"cookie|consent|gdpr|onetrust|cc-window|cc-banner|privacy[-_]banner|sp_message_container")
HIDING = re.compile(r"display:none|visibility:hidden|opacity:0|font-size:0")
WRAPPERS = frozenset(("div", "span", "center"))
FOOTER = re.compile(r"copyright|©|privacy|terms of|all rights reserved")
MOST_LINKS, MOST_NAVIGATION_LINKS, MOST_PARAGRAPHS, MOST_ELEMENTS = 200, 80, 10, 400
FIRST_PARAGRAPH, NEXT_PARAGRAPH = 200, 80


def hidden(node: Node) -> bool:
    """Nodes that nobody sees or that carry no content: scripts, hidden ones, consent banners, decoration."""
    if node.tag == "#comment":
        return True
    if node.tag.startswith("#"):
        return False
    a = node.attrs
    if node.tag in ("script", "style", "noscript", "meta", "link"):
        return True
    if node.tag == "template":
        return "shadowrootmode" not in a
    if node.tag == "svg":
        return not (a.get("role") == "img" and ("aria-label" in a or "title" in a))
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if "style" in a:
        style = re.sub(r"\s", "", a["style"]).lower()
        if HIDING.search(style) or "overflow:hidden" in style and re.search(r"height:0|width:0", style) or "clip:rect(0" in style and "position:absolute" in style:
            return True
    names = [a.get("class", "").lower(), a.get("id", "").lower()]
    if any(map(CONSENT.search, names)) or "aria-label" in a and re.search("cookie|consent", a["aria-label"].lower()):
        return True
    if a.get("role", "").lower() in ("dialog", "alertdialog") and node.tag in ("div", "aside", "section") and (re.search("modal|overlay|popup", names[0]) or re.search("modal|overlay", names[1])):
        return True
    return node.tag == "img" and (a.get("alt") == "" or a.get("role") == "presentation")


class StyleRules:
    """Classes, ids and tags that a page's style sheets hide; a class any rule shows is never hidden."""

    def __init__(self, sheets: list[str]):
        self.off: set[str] = set()
        shown: set[str] = set()
        for sheet in sheets:
            sheet = re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)
            sheet = re.sub(r"@[^{;]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|@[^;{]*;", "", sheet)
            for selectors, body in re.findall(r"([^{}]+)\{([^{}]*)\}", sheet):
                hides = HIDING.search(re.sub(r"\s", "", body).lower())
                for selector in selectors.split(","):
                    last = selector.split()[-1] if selector.split() else ""
                    names = re.findall(r"[.#][\w-]+", last)
                    (self.off if hides else shown).update(names)
        self.off -= {n for n in shown if n.startswith(".")}

    def hide(self, node: Node) -> bool:
        a = node.attrs
        return bool(self.off) and ("#" + a.get("id", "") in self.off or any("." + c in self.off for c in a.get("class", "").split()))


def role_of(node: Node) -> str | None:
    """The element role: the first known ARIA role, none if none is known, else the tag's own."""
    if "role" in node.attrs:
        return next((ARIA_ROLES[r] for r in node.attrs["role"].lower().split() if r in ARIA_ROLES), None)
    if node.tag == "a":
        return "link" if "href" in node.attrs else None
    if node.tag == "input":
        return INPUT_ROLES.get(node.attrs.get("type", "text").lower(), "text_input")
    return TAG_ROLES.get(node.tag)


@lru_cache(maxsize=1 << 14)
def _hinted_region(names: str, html_id: str) -> str | None:
    for name in (names.lower(), html_id.lower()):
        for role, parts in REGION_HINTS:
            if name and any(p in name for p in parts):
                return role
    return None


def landmark_of(node: Node) -> str | None:
    if "role" in node.attrs and (known := [ARIA_LANDMARKS[r] for r in node.attrs["role"].lower().split() if r in ARIA_LANDMARKS]):
        return known[0]
    if node.tag in LANDMARKS:
        return LANDMARKS[node.tag]
    if node.tag in ("div", "section", "article", "ul", "ol") and node.attrs:
        return _hinted_region(node.attrs.get("class", ""), node.attrs.get("id", ""))
    return None


@lru_cache(maxsize=1 << 14)
def _hints(names: str) -> tuple[str, ...]:
    low = names.lower()
    found = {hint for hint, parts in CLASS_HINTS.items() if any(p in low for p in parts)}
    if "card" in low and "discard" not in low:
        found.add("card")
    return tuple(sorted(found))


def class_hints(names: str | None) -> list[str] | None:
    return list(_hints(names)) or None if names else None


def rows_of(table: Node) -> list[list[Node]]:
    """The cells of a table's own rows."""
    out, stack = [], [c for c in reversed(table.children)]
    while stack:
        n = stack.pop()
        if n.tag == "tr":
            out.append([c for c in n.children if c.tag in ("td", "th")])
        elif n.tag in ("tbody", "thead", "tfoot"):
            stack.extend(reversed(n.children))
    return out


def is_layout(table: Node) -> bool:
    """A table that only lays out: said so, or no headers and caption and block content or one column."""
    if table.attrs.get("role", "").lower() in ("presentation", "none"):
        return True
    if table.find("th", "caption", "thead") or table.attrs.get("summary"):
        return False
    cells = rows_of(table)
    nested = sum(1 for n in table.walk() if n.tag == "table") > 1
    blocks = sum(1 for r in cells for c in r if c.find("div", "ul", "ol", "form", "h1", "h2", "h3", "p", "nav"))
    widest = max(map(len, cells), default=0)
    return nested or widest <= 1 or blocks * 2 > sum(map(len, cells))


def measure(root: Node, skip: Callable[[Node], bool]) -> tuple[str, str]:
    """(all text, seen text) of a page; every node learns whether it is skipped, and its part of both texts and of the page's links and main parts.

    One walk up and down: a node's text is a slice from then on, however deep it lies.
    """
    whole: list[str] = []
    seen: list[str] = []
    at = [0, 0, 0, 0]
    hidden_above = 0
    stack: list[tuple[Node, tuple | None]] = [(root, None)]
    while stack:
        node, began = stack.pop()
        if began is not None:
            node.span = (began[0], at[0], began[1], at[1], began[2], at[2], began[3], at[3])
            hidden_above -= node.off
            continue
        if node.tag == "#text":
            start = tuple(at)
            whole.append(node.text)
            at[0] += len(node.text)
            if not hidden_above:
                seen.append(node.text)
                at[1] += len(node.text)
            node.span = (start[0], at[0], start[1], at[1], at[2], at[2], at[3], at[3])
            continue
        node.off = skip(node)
        # what stands in a declared shadow root is seen there only
        hidden_above += node.off
        began = tuple(at)
        at[2] += node.tag == "a" and "href" in node.attrs
        at[3] += node.tag in ("main", "article")
        if node.children:
            stack.append((node, began))
            stack.extend((c, None) for c in reversed(node.children))
        else:
            node.span = (began[0], at[0], began[1], at[1], began[2], at[2], began[3], at[3])
            hidden_above -= node.off
    return "".join(whole), "".join(seen)


# Attributes that come as given, as numbers where they are, as true where they are empty, and states.
AS_GIVEN = "accesskey title accept autocomplete inputmode enterkeyhint autocapitalize dirname form formaction formmethod formenctype formtarget list popovertarget popovertargetaction commandfor command popover name step pattern".split()
OF_LINKS = "href target rel hreflang type referrerpolicy".split()
OF_FRAMES = "src sandbox allow width height".split()
NUMBERS = ("tabindex", "minlength", "maxlength", "min", "max")
STATES = {s: s for s in "expanded selected checked readonly disabled current pressed hidden controls haspopup invalid placeholder autocomplete errormessage keyshortcuts roledescription busy live atomic relevant owns flowto details multiline multiselectable orientation sort level posinset setsize grabbed dropeffect valuemin valuemax valuenow valuetext label labelledby describedby".split()} | {"activedescendant": "active_descendant"}
LABELABLE = frozenset("button input meter output progress select textarea".split())


def number_or_text(value: str) -> int | str:
    return int(value) if re.fullmatch(r"[+-]?\d{1,18}", value, re.A) else value


def said(value: str) -> bool | str:
    """A state as written: true and false as such, all else trimmed text."""
    return {"true": True, "false": False}.get(value.strip().lower(), value.strip())


class Compiler:
    """One page: regions in the order their content closes, ids in reading order.

    Walks keep their own stacks, and texts are slices of the page's, so time grows with the size of
    the page, not with its depth.
    """

    def __init__(self, html: str, url: str):
        self.root = parse(html)
        split = urlsplit(url or "")
        self.origin = f"{split.scheme}://{split.netloc}" if split.netloc else ""
        nodes = list(self.root.walk())
        self.styles = StyleRules([n.all_text() for n in nodes if n.tag == "style"])
        self.ids: Counter = Counter()
        self.counts: Counter = Counter()
        self.regions: list[dict] = []
        self.in_main, self.paragraphs = False, 0
        self.whole, self.seen = measure(self.root, lambda n: hidden(n) or self.styles.hide(n))
        self.footers = [m.start() for m in re.finditer(FOOTER.pattern, self.whole, re.I)]
        self.by_id: dict[str, str] = {}
        self.by_for: dict[str, str] = {}
        stack = [self.root]
        while stack:
            n = stack.pop()
            if n.off:
                continue
            stack.extend(reversed(n.children))
            if n.tag.startswith("#") or "id" not in n.attrs and n.tag != "label":
                continue
            if text := normalize_text(self.text(n)):
                if own := n.attrs.get("id", "").strip():
                    self.by_id[own] = text
                if n.tag == "label":
                    target = n.attrs["for"].strip() if "for" in n.attrs else next((i for x in n.walk() if x.tag in LABELABLE and (i := x.attrs.get("id", "").strip())), "")
                    if target:
                        self.by_for[target] = text

    def skip(self, node: Node) -> bool:
        return node.off

    def text(self, node: Node) -> str:
        """What a reader sees of a node, without separators."""
        if node.tag == "#text":
            return node.text
        return self.seen[node.span[2] : node.span[3]]

    def named(self, names: str) -> str:
        return " ".join(self.by_id[i] for i in names.split() if i in self.by_id)

    def label(self, node: Node, text: str | None) -> str | None:
        a, tag = node.attrs, node.tag
        named = self.named(a.get("aria-labelledby", ""))
        kind = a.get("type", "text").lower() if tag == "input" else ""
        last = a.get("alt") if kind == "image" else a.get("value") if kind in ("submit", "button", "reset") else None
        for given in (named, a.get("aria-label"), self.by_for.get(a.get("id", "").strip()), a.get("title")):
            if given and (form := normalize_text(given)) and form != text:
                return form
        if a.get("placeholder"):
            return normalize_text(a["placeholder"])
        form = normalize_text(last or "")
        return form if form and form != text else None

    def attrs(self, node: Node, role: str, off: bool, inert: bool) -> dict | None:
        a, tag, out = node.attrs, node.tag, {}
        disabled = off or "disabled" in a
        if tag == "a":
            out |= {n: a[n] for n in OF_LINKS if n in a}
            if "download" in a:
                out["download"] = a["download"] or True
        elif tag == "input":
            kind = a.get("type", "text").lower()
            out["input_type"] = kind
            if kind in ("submit", "button", "reset", "image"):
                out["button_type"] = kind
            out |= {n: a[n] for n in ("value", *(("alt", "src") if kind == "image" else ()), "placeholder") if n in a}
            flags = {"required": "required" in a, "disabled": disabled, "checked": kind in ("checkbox", "radio") and "checked" in a, "multiple": "multiple" in a}
            out |= {n: True for n, on in flags.items() if on}
            if kind == "radio" and "name" in a:
                out["group"] = a["name"]
        elif tag == "textarea":
            if value := normalize_text(self.text(node)):
                out["value"] = value
            out |= {n: a[n] for n in ("placeholder",) if n in a} | {n: True for n in ("required", "readonly") if n in a} | ({"disabled": True} if disabled else {})
        elif tag == "button":
            out["button_type"] = k if (k := a.get("type", "").strip().lower()) in ("button", "reset") else "submit"
            out |= {n: a[n] for n in ("value",) if n in a} | ({"disabled": True} if disabled else {})
        elif tag == "select":
            options = self.options(node)
            chosen = [o["value"] for o in options if o.get("selected")]
            out |= {"options": options} if options else {}
            out |= {"multiple": True} if "multiple" in a else {}
            out |= {"size": number_or_text(a["size"])} if "size" in a else {}
            out |= {"required": True} if "required" in a else {}
            out |= {"value": chosen[0]} if chosen else {}
            out |= {"selected_values": chosen} if chosen and "multiple" in a else {}
            out |= {"disabled": True} if disabled else {}
        elif tag in ("img", "picture"):
            out |= {n: a[n] for n in ("alt", "src") if n in a}
        elif tag in ("ul", "ol"):
            items = [collapse_text(self.text(c)) for c in node.children if c.tag == "li" and not c.off]
            items = [i for i in items if i]
            out["ordered"] = tag == "ol"
            if items:
                out["items"] = [{"text": i} for i in items[:5]] + ([{"text": f"[{len(items) - 5} more items]"}] if len(items) > 5 else [])
        elif tag == "table":
            out |= self.table(node)
        elif tag in ("section", "article"):
            out |= {"section_label": a["aria-label"]} if "aria-label" in a else {}
        elif tag == "fieldset":
            legend = next((t for c in node.children if c.tag == "legend" and (t := normalize_text(self.text(c)))), None)
            out |= ({"legend": legend} if legend else {}) | ({"disabled": True} if disabled else {})
        elif tag == "details":
            out["open"] = "open" in a
            summary = next((t for c in node.children if c.tag == "summary" and (t := normalize_text(self.text(c)))), None)
            out |= {"summary": summary} if summary else {}
        elif tag == "iframe":
            out |= {n: a[n] for n in OF_FRAMES if n in a}
            if "srcdoc" in a:
                out |= {"has_srcdoc": True} | ({"srcdoc_preview": a["srcdoc"][:200]} if a["srcdoc"] else {})
        if role == "heading":
            out["level"] = int(a["aria-level"]) if a.get("aria-level", "").isdigit() else int(tag[1]) if tag[1:].isdigit() else 2
        out |= {n: number_or_text(a[n]) for n in NUMBERS if n in a}
        out |= {n: a[n] for n in AS_GIVEN if n in a}
        if "capture" in a:
            out["capture"] = a["capture"] or True
        for name, empty in (("contenteditable", True), ("spellcheck", True), ("draggable", None)):
            if name in a:
                word = a[name].strip().lower()
                out[name] = True if word == "true" or not word and empty else False if word == "false" else a[name]
        if "role" in a:
            out["source_role"] = a["role"]
        if test := next((a[k] for k in ("data-testid", "data-test-id", "data-test") if a.get(k)), None):
            out["test_id"] = test
        states = {k[5:]: said(v) for k, v in a.items() if k.startswith("aria-") and k[5:] in STATES}
        flags = {"inert": inert or "inert" in a, "formnovalidate": "formnovalidate" in a, "readonly": "readonly" in a or states.get("readonly") is True, "required": states.get("required") is True or said(a.get("aria-required", "")) is True, "disabled": states.get("disabled") is True}
        out |= {n: True for n, on in flags.items() if on}
        if description := normalize_text(self.named(a.get("aria-describedby", "")) or a.get("aria-description", "")):
            out["description"] = description
        if states:
            out["aria"] = {STATES[k]: v for k, v in states.items()}
        return out or None

    def options(self, node: Node) -> list[dict]:
        out = []
        for group in [node, *(c for c in node.children if c.tag == "optgroup")]:
            for c in group.children:
                if c.tag == "option":
                    words = collapse_text(c.all_text())
                    option = {"value": c.attrs.get("value", words), "text": c.attrs.get("label") or words}
                    if group is not node and group.attrs.get("label"):
                        option["group"] = group.attrs["label"]
                    if "selected" in c.attrs:
                        option["selected"] = True
                    if "disabled" in c.attrs or "disabled" in group.attrs and group is not node:
                        option["disabled"] = True
                    out.append(option)
        if out and "multiple" not in node.attrs and not any(o.get("selected") for o in out):
            first = next((o for o in out if not o.get("disabled")), None)
            if first:
                first["selected"] = True
        return out

    def table(self, node: Node) -> dict:
        rows, headers = [], None
        for cells in rows_of(node):
            line: list[str] = []
            for c in cells:
                span = int(c.attrs["colspan"]) if c.attrs.get("colspan", "").isdigit() else 1
                line += [collapse_text(self.text(c))[:80]] * max(1, min(span, 12))
            if headers is None and not rows and cells and all(c.tag == "th" for c in cells):
                headers = line[:12]
            elif line:
                rows.append(line[:12])
        caption = node.find("caption")
        out = {"headers": headers} if headers else {}
        out |= {"rows": rows[:30]} if rows else {}
        return out | ({"caption": collapse_text(caption.all_text())} if caption else {})

    def element(self, node: Node, path: str, off: bool, inert: bool, plain: bool = False) -> dict | None:
        if node.tag == "#text":
            text = normalize_text(node.text)
            return self.identified({"role": "paragraph", "text": text}, path) if text else None
        if node.tag.startswith("#") or node.tag == "table" and is_layout(node):
            return None
        role = role_of(node)
        if role is None:
            return None
        whole = collapse_text(self.text(node))
        text = normalize_text(whole) if whole else None
        if not plain:
            if role == "paragraph" and self.in_main and whole:
                most = FIRST_PARAGRAPH if self.paragraphs == 0 else NEXT_PARAGRAPH
                self.paragraphs += 1
                text = whole if len(whole) <= most else whole[: most - 3] + "..."
            if role in ("table", "list", "group"):
                text = None
        label = self.label(node, text)
        if label is None and node.tag == "fieldset" and (legend := next((c for c in node.children if c.tag == "legend"), None)):
            label = normalize_text(self.text(legend)) or None
        inert = inert or "inert" in node.attrs
        out = {"role": role, "html_id": node.attrs.get("id") or None, "text": text, "label": label, "actions": ACTIONS.get(role), "attrs": self.attrs(node, role, off, inert), "hints": class_hints(node.attrs.get("class"))}
        out = self.identified(out, path)
        shadow = next((c for c in node.children if c.tag == "template" and "shadowrootmode" in c.attrs), None)
        if shadow:
            inside = [e for i, c in enumerate(shadow.children) for e in self.extract(c, f"{path}/shadow/{i}", False, inert)]
            out["shadow"] = {"mode": shadow.attrs["shadowrootmode"], "elements": inside}
        return out

    def identified(self, out: dict, path: str) -> dict:
        name = (out.get("label") or out.get("text") or "").lower().strip()[:100]
        base = "e_" + hashlib.sha256("|".join((self.origin, out["role"], name, path)).encode("utf-8", "surrogatepass")).hexdigest()[:12]
        self.ids[base] += 1
        number = self.ids[base]
        return {"id": base if number == 1 else f"{base}_{number}"} | {k: v for k, v in out.items() if v is not None}

    def interactive_below(self, node: Node, path: str, off: bool, inert: bool) -> list[dict]:
        """Action targets inside an element that is none itself."""
        out = []
        stack = [(node, path, off, inert)]
        while stack:
            n, at, stopped, still = stack.pop()
            if n is not node:
                if n.tag.startswith("#") or n.off:
                    continue
                stopped = stopped or n.tag == "fieldset" and "disabled" in n.attrs
                if role_of(n) in ACTIONS:
                    out.append(self.element(n, at, stopped, still, plain=True))
                    continue
                still = still or "inert" in n.attrs
            stack.extend((c, f"{at}/{i}", stopped, still) for i, c in reversed(list(enumerate(n.children))))
        return [e for e in out if e is not None]

    def extract(self, node: Node, path: str, off: bool, inert: bool) -> list[dict]:
        """Elements of a subtree that makes one region."""
        out: list[dict] = []
        stack = [(node, path, off, inert)]
        while stack:
            n, at, stopped, still = stack.pop()
            if n.off:
                continue
            below_off = stopped or n.tag == "fieldset" and "disabled" in n.attrs
            below_inert = still or "inert" in n.attrs
            own = self.element(n, at, stopped, still)
            if own is None:
                stack.extend((c, f"{at}/{i}", below_off, below_inert) for i, c in reversed(list(enumerate(n.children))))
                continue
            out.append(own)
            if own["role"] not in ACTIONS and n.tag != "#text":
                out += self.interactive_below(n, at, below_off, below_inert)
        return out

    def claim(self, role: str) -> str:
        number = self.counts[role]
        self.counts[role] += 1
        return f"r_{role}" if number == 0 else f"r_{role}_{number}"

    def region(self, rid: str, role: str, elements: list[dict], **fields: object) -> None:
        if elements:
            self.regions.append({"id": rid, "role": role} | {k: v for k, v in fields.items() if v} | {"elements": summarize(elements, role == "navigation")})

    def collect(self, top: Node, loose: list[dict], inert: bool) -> None:
        """Regions of what is below ``top``; elements outside of them go to ``loose``."""
        stack: list[tuple] = [("visit", c, f"0/{i}", loose, inert) for i, c in reversed(list(enumerate(top.children)))]
        while stack:
            what, node, path, held, still = stack.pop()
            if what == "close":
                rid, role, own, label, was = path
                self.in_main = was
                self.region(rid, "navigation" if role == "search" else role, own, label=label)
                continue
            if node.off:
                continue
            if node.tag.startswith("#"):
                if (own := self.element(node, path, False, False)) is not None:
                    held.append(own)
                continue
            a, still = node.attrs, still or "inert" in node.attrs
            label = normalize_text(self.named(a.get("aria-labelledby", "")) or a.get("aria-label") or a.get("title") or "") or None
            below = [(c, f"{path}/{i}") for i, c in reversed(list(enumerate(node.children)))]
            if role := landmark_of(node):
                own: list[dict] = []
                stack.append(("close", node, (self.claim(role), role, own, label, self.in_main), held, still))
                if role == "main":
                    self.in_main, self.paragraphs = True, 0
                stack += [("visit", c, at, own, still) for c, at in below]
            elif node.tag == "form":
                rid = self.claim("form")
                label = label or next((v for k, v in a.items() if k in ("name", "id")), None)
                self.region(rid, "form", self.extract(node, path, False, still), label=label, action=a.get("action"), method=a.get("method", "").upper(), target=a.get("target"), enctype=a.get("enctype"), novalidate="novalidate" in a, accept_charset=a.get("accept-charset"), autocomplete=a.get("autocomplete"))
            elif kind := self.by_density(node):
                self.region(self.claim(kind), kind, self.extract(node, path, False, still))
            elif (own_element := self.element(node, path, False, still)) is not None:
                held.append(own_element)
                if own_element["role"] not in ACTIONS:
                    held += self.interactive_below(node, path, node.tag == "fieldset" and "disabled" in a, still)
            else:
                stack += [("visit", c, at, held, still) for c, at in below]

    def by_density(self, node: Node) -> str | None:
        """Navigation by its share of links, or footer by its words, for blocks that hold no main part."""
        if node.tag not in ("div", "ul", "ol", "section"):
            return None
        text0, text1, _, _, link0, link1, main0, main1 = node.span
        if main1 > main0:
            return None
        if node.tag == "div" and not node.attrs.get("role"):
            solid = [c for c in node.children if not (c.tag == "#text" and not c.text.strip())]
            if len(solid) == 1 and solid[0].tag in WRAPPERS | {"main", "article", "section", "form", "nav"}:
                return None
        links = link1 - link0
        if node.tag in ("div", "ul", "ol") and node.children and links >= 3 and links / len(node.children) > 0.5:
            return "navigation"
        if node.tag in ("div", "section"):
            at = bisect_left(self.footers, text0)
            if at < len(self.footers) and self.footers[at] < text1:
                return "footer"
        return None

    def page(self, html: str, url: str) -> dict:
        body = next(c for c in self.root.children if c.tag == "body")
        loose: list[dict] = []
        self.collect(body, loose, "inert" in body.attrs)
        if loose:
            self.region(self.claim("content"), "content", loose)
        title = next((t for n in self.root.walk() if n.tag == "title" and (t := n.all_text())), "")
        flat = list(flatten(self.regions))
        meta = {"html_bytes": len(html.encode("utf-8", "surrogatepass")), "som_bytes": 0, "element_count": len(flat), "interactive_count": sum(e["role"] in ACTIONS for *_, e in flat)}
        out = {"som_version": "0.1", "url": url, "title": title, "lang": self.root.attrs.get("lang") or "en", "regions": self.regions, "meta": meta}
        if data := structured_data(self.root):
            out["structured_data"] = data
        meta["som_bytes"] = len(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))
        return out


def summarize(elements: list[dict], navigation: bool) -> list[dict]:
    """Elements within a region's budgets: each target once, so many links, paragraphs and elements; a last one says what was left out."""
    counts: Counter = Counter()
    left: Counter = Counter()
    chars, seen, out = 0, set(), []
    for e in elements:
        role, why = e["role"], None
        if role == "link":
            target = re.sub(r"/$", "", (e.get("attrs") or {}).get("href", "").split("#")[0])
            if target and target in seen:
                why = "duplicate links"
            else:
                seen.add(target)
                counts["link"] += 1
                why = "more links" if counts["link"] > (MOST_NAVIGATION_LINKS if navigation else MOST_LINKS) else None
        elif role == "paragraph":
            counts["paragraph"] += 1
            why = "more paragraphs" if counts["paragraph"] > MOST_PARAGRAPHS else None
        if why is None and role not in ("heading", "text_input", "textarea", "select", "checkbox", "radio", "button"):
            counts["other"] += 1
            why = "more elements" if counts["other"] > MOST_ELEMENTS else None
        if why is None:
            out.append(e)
        else:
            left[why] += 1
            chars += len((e.get("text") or "").encode("utf-8", "surrogatepass"))
    if left:
        parts = [f"{left[k]} {k}" for k in ("duplicate links", "more links", "more paragraphs", "more elements") if left[k]]
        out.append({"id": f"e_summary_{left.total()}", "role": "paragraph", "text": f"[{', '.join(parts)} dropped, ~{chars} chars]"})
    return out


def flatten(regions: list[dict]) -> Iterator[tuple[int, int, str, dict]]:
    """(region number, depth, way there, element) of every element in pre-order."""
    for r, region in enumerate(regions):
        stack = [(0, "region", e) for e in reversed(region["elements"])]
        while stack:
            depth, via, e = stack.pop()
            yield r, depth, via, e
            stack += [(depth + 1, "shadow", x) for x in reversed((e.get("shadow") or {}).get("elements", []))]
            stack += [(depth + 1, "child", x) for x in reversed(e.get("children") or [])]


_METAS = ("description", "keywords", "author", "robots", "viewport", "generator", "theme-color")
_RELS = frozenset("canonical alternate icon apple-touch-icon manifest next prev author license search amphtml shortlink".split())


def structured_data(root: Node) -> dict | None:
    """JSON-LD, Open Graph, Twitter card, named metas and links of a page."""
    out: dict = {"json_ld": [], "open_graph": {}, "twitter_card": {}, "meta": {}, "links": []}
    for n in root.walk():
        a = n.attrs
        if n.tag == "script" and a.get("type", "").lower() == "application/ld+json":
            try:
                value = json.loads(n.all_text())
            except (ValueError, RecursionError):
                continue
            out["json_ld"] += value if isinstance(value, list) else [value]
        elif n.tag == "meta":
            name, content = (a.get("property") or a.get("name") or "").lower(), a.get("content")
            if a.get("charset"):
                out["meta"]["charset"] = a["charset"]
            if content is None:
                continue
            for prefix, to in (("og:", "open_graph"), ("twitter:", "twitter_card")):
                if name.startswith(prefix):
                    out[to].setdefault(name, content)
            if name in _METAS:
                out["meta"].setdefault(name, content)
        elif n.tag == "link" and a.get("href") and (rels := [r for r in a.get("rel", "").lower().split() if r in _RELS]):
            out["links"].append({"rel": rels[0], "href": a["href"]} | {k: a[k] for k in ("type", "hreflang") if a.get(k)})
    out = {k: v for k, v in out.items() if v}
    return out or None


def compile_page(html: str | None, url: str | None) -> dict:
    """The page tree of a document; an empty one gives a tree without regions."""
    return Compiler(html or "", url or "").page(html or "", url or "")


HOOKS: dict[str, list[Callable]] = {"pre_navigate": [], "post_parse": [], "post_som": []}


def register_hook(stage: str, f: Callable) -> None:
    """Adds a function to the chain of a stage; a result of None leaves the value as it was."""
    HOOKS[stage].append(f)


def _through(stage: str, value: object, hooks: dict[str, list[Callable]]) -> object:
    for f in hooks[stage]:
        changed = f(value)
        value = value if changed is None else changed
    return value


COMPILED = "page_id bigint, url string, title string, lang string, html_bytes bigint, som_bytes bigint, element_count bigint, interactive_count bigint, som_json string, error string"


def compile_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One compiled page (``COMPILED``) per row of (key, url, html); a page that fails has its error instead."""
    hooks = {k: list(v) for k, v in HOOKS.items()}
    kinds = [pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 4, pa.string(), pa.string()]
    names = [c.split()[0] for c in COMPILED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, u, h in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    u = _through("pre_navigate", u, hooks)
                    som = _through("post_som", compile_page(_through("post_parse", h, hooks), u), hooks)
                    m = som["meta"]
                    rows.append((k, som["url"], som["title"], som["lang"], m["html_bytes"], m["som_bytes"], m["element_count"], m["interactive_count"], json.dumps(som, ensure_ascii=False, separators=(",", ":")), None))
                except Exception as e:  # noqa: BLE001 - a bad page must not end the job
                    rows.append((k, u, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return pages.select(F.col(key).cast("bigint"), F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(run, COMPILED)
