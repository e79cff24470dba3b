"""Layout-aware text of HTML pages.

A tokenizer and tree builder (implied end tags, optional html/head/body, void and raw-text elements,
character references) make a tree; a renderer gives its visible text:

* not visible: head (but its stray text), script, style, template, noscript, iframe, object, svg, math,
  select lists, datalist, dialog without open, closed details but for their summary, ``hidden``,
  ``aria-hidden=true``, ``type=hidden``, and ``display:none`` or ``visibility:hidden`` in a style attribute or,
  for a tag, class or id outside of at-rules, in a style element of the page;
* white space collapses, but for pre and textarea; br breaks a line; hr is a line of dashes;
* blocks stand on lines of their own; paragraphs, headings, lists, tables, pre and quotes have a blank line
  around; quotes are indented;
* items have "- " or their number (start, value, reversed and type of ol are kept), nested by two spaces or
  the marker's width; dt and dd stand below each other, dd indented;
* a table is one line a row (more, if cells have more lines), cells padded to their column's width and two
  spaces apart, colspan (to 1000) and rowspan (to 65534) kept; a caption stands above; tables nested in cells
  are rendered within;
* img gives its alt text, input its value (buttons) or placeholder.

Tags may be unclosed or crossed: an end tag closes up to its nearest open element, within the table cell or
the page it stands in, and is ignored without one. Null pages give a null text, empty ones an empty text; rows
are rendered each on its own, so repeated rows, ties and null ids come out as they went in, and an empty table
gives an empty one. Columns besides page_id and html are not read.

Time and output are linear in the page: open elements are found by name, a quote or tag that never ends is
text, and what is only layout is bounded, never text: lists, quotes and tables nested deeper than ``DEEP`` are
plain blocks, and cells align up to ``WIDEST`` columns a cell and ``FARTHEST`` a line, beyond which they are two
spaces apart.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from heapq import heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import texts_of

_S = lambda text: frozenset(text.split())
# -- fixed values of the HTML standard ------------------------------------------------------------------------
VOID = _S("area base br col embed hr img input link meta param source track wbr")
RAW = _S("script style xmp iframe noembed noframes textarea title")
BLOCK = _S(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption tr td th tbody thead tfoot ul"
)
SPACED = _S("p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote figure fieldset hr")
HIDDEN = _S("head script style template noscript iframe noembed noframes object svg math select datalist audio video canvas area param title colgroup")
#: What an opening tag ends, and where the search for it stops.
CLOSES = {
    "li": (_S("li"), _S("ul ol menu")),
    "dt": (_S("dt dd"), _S("dl")),
    "dd": (_S("dt dd"), _S("dl")),
    "tr": (_S("tr td th caption colgroup"), _S("table")),
    "td": (_S("td th"), _S("tr table")),
    "th": (_S("td th"), _S("tr table")),
    "tbody": (_S("tbody thead tfoot tr td th caption colgroup"), _S("table")),
    "thead": (_S("tbody thead tfoot tr td th caption colgroup"), _S("table")),
    "tfoot": (_S("tbody thead tfoot tr td th caption colgroup"), _S("table")),
    "caption": (_S("caption colgroup"), _S("table")),
    "colgroup": (_S("caption colgroup"), _S("table")),
    "option": (_S("option"), _S("select datalist optgroup")),
    "optgroup": (_S("option optgroup"), _S("select")),
    "body": (_S("head"), _S("html")),
}
ENDS_P = _S(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul"
)
#: Elements that an end tag never reaches beyond.
WALLS = _S("td th caption table html")
#: Elements that may stand in head; others open body.
IN_HEAD = _S("base basefont bgsound link meta noframes noscript script style template title head")
# -------------------------------------------------------------------------------------------------------------
#: Nested lists, quotes, tables and preformatted blocks that are laid out; columns that are padded to.
DEEP, WIDEST, FARTHEST = 48, 240, 960
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SHOWN = re.compile(r"display\s*:|visibility\s*:", re.I)
_GAP, _KEY, _EQUALS, _BARE, _NAME = (re.compile(p) for p in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*", r"[^\s/>]+"))
_REFERENCE = re.compile(r"&#([0-9]{8,}|[xX][0-9A-Fa-f]{7,});?")
_SELECTOR = re.compile(r"([A-Za-z][\w-]*)?(?:[.#][\w-]+)?")
_bare: dict[str, str] = {}


class Node:
    """An element: name, attributes, and children, which are nodes or strings."""

    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def _unescape(text: str) -> str:
    """Character references; numbers of any length are read, those beyond Unicode are U+FFFD."""
    if "&" not in text:
        return text

    def short(m):
        base, digits = (16, m[1][1:]) if m[1][0] in "xX" else (10, m[1])
        digits = digits.lstrip("0")
        return html.unescape(f"&#{int(digits or '0', base)};") if len(digits) < 8 else "\ufffd"

    return html.unescape(_REFERENCE.sub(short, text))


class _Scanner:
    """Tags of a page, each looked at once; what never ends is remembered."""

    def __init__(self, page: str):
        self.page, self.size, self.dead = page, len(page), set()

    def find(self, what: str, at: int) -> int:
        """The next place of a short string, or -1."""
        if what in self.dead:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.dead.add(what)
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], int] | None:
        """(attributes, place after the tag), or None where the page ends within it."""
        page, out = self.page, _bare
        while True:
            at = _GAP.match(page, at).end()
            if at >= self.size:
                return None
            if page[at] == ">":
                return out, at + 1
            key = _KEY.match(page, at)
            at, value = key.end(), ""
            equals = _EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at : at + 1]
                stop = self.find(quote, at + 1) if quote in ("'", '"') else -1
                if stop >= 0:
                    value, at = page[at + 1 : stop], stop + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0].strip("\"'"), bare.end()
            if out is _bare:
                out = {}
            out.setdefault(key[0].lower(), _unescape(value))

    def next(self, at: int):
        """(start, stop, name, attributes): the next tag; name is None for comments, begins with / for end tags. None at the end."""
        page = self.page
        while True:
            start = self.find("<", at)
            if start < 0 or "tag" in self.dead:
                return None
            mark = page[start + 1 : start + 3]
            if mark[:1].isascii() and mark[:1].isalpha() or (mark[:1] == "/" and mark[1:].isascii() and mark[1:].isalpha()):
                name = _NAME.match(page, start + 1 + (mark[:1] == "/"))
                got = self.attributes(name.end())
                if got is None:
                    self.dead.add("tag")
                    return None
                return start, got[1], ("/" if mark[:1] == "/" else "") + name[0].lower(), got[0]
            if page.startswith("<!--", start):
                stop = self.find("-->", start + 2)
                return start, self.size if stop < 0 else stop + 3, None, _bare
            if mark[:1] in ("!", "?", "/") and mark[:1]:
                stop = self.find(">", start)
                if stop >= 0:
                    return start, stop + 1, None, _bare
            at = start + 1


def style_rules(css: str) -> dict[str, bool]:
    """Whether a tag, class or id is hidden, for selectors of one of them (or tag.class, tag#id) outside of at-rules; the last wins."""
    css = re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S)
    out, depth, last, opened = {}, 0, 0, 0
    for m in re.finditer(r"[{}]", css):
        if m[0] == "{":
            depth += 1
            if depth == 1:
                opened = m.end()
                heads = css[last : m.start()].strip()
            continue
        depth = max(0, depth - 1)
        if depth == 0:
            body, last = css[opened : m.start()], m.end()
            if opened and not heads.startswith("@") and _SHOWN.search(body):
                for head in heads.split(","):
                    if _SELECTOR.fullmatch(head.strip()) and head.strip():
                        out[head.strip()] = bool(_NONE.search(body))
    return out


def parse(page: str) -> Node:
    """The tree of a page; its root is named #root, and its attributes are the style rules that hide."""
    root = Node("#root", {})
    stack, where, styles = [root], {}, []
    scanner, at, n = _Scanner(page), 0, len(page)

    def push(node):
        stack[-1].children.append(node)
        where.setdefault(node.name, []).append(len(stack))
        stack.append(node)

    def last(names):
        return max((where[x][-1] for x in names if where.get(x)), default=0)

    def close(names, walls):
        k = last(names)
        if not k or k < last(walls):
            return False
        while len(stack) > k:
            where[stack.pop().name].pop()
        return True

    while at < n:
        tag = scanner.next(at)
        start, stop, name, attrs = tag or (n, n, None, _bare)
        if start > at:
            text = _unescape(page[at:start])
            if stack[-1].name == "head" and text.strip():
                close(("head",), ())
            stack[-1].children.append(text)
        at = stop
        if name is None:
            continue
        if name[0] == "/":
            name = name[1:]
            if name == "br":
                stack[-1].children.append(Node("br", _bare))
            elif name == "p" and not where.get("p"):
                stack[-1].children.append(Node("p", _bare))
            else:
                close((name,), WALLS if name not in WALLS and name not in ("tr", "tbody", "thead", "tfoot", "body") else ("table",) if name in ("td", "th", "tr", "caption", "tbody", "thead", "tfoot") else ())
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            close(("head",), ())
        if name in ("html", "body", "form") and where.get(name):
            continue
        if name in ENDS_P:
            close(("p",), ("td", "th", "table", "caption", "button", "object"))
        rule = CLOSES.get(name)
        if rule:
            while close(*rule) and name not in ("li", "option"):
                pass
        if name in ("td", "th") and stack[-1 - (stack[-1].name == "form" and len(stack) > 1)].name in ("tbody", "thead", "tfoot"):
            push(Node("tr", _bare))
        node = Node(name, attrs)
        if name in VOID:
            stack[-1].children.append(node)
        elif name in RAW:
            stack[-1].children.append(node)
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            text = page[at : end.start() if end else n]
            node.children.append(_unescape(text) if name in ("textarea", "title") else text)
            if name == "style":
                styles.append(text)
            at = end.end() if end else n
        else:
            push(node)
    root.attrs = style_rules("\n".join(styles)) if any("none" in x.lower() or "hidden" in x.lower() or "collapse" in x.lower() for x in styles) else _bare
    return root


def _by_rules(name: str, a: dict[str, str], rules: dict[str, bool]) -> bool:
    """Whether style rules hide an element: of those that name it the most specific one decides, id before class before tag."""
    marks = ["#" + a["id"]] if "id" in a else [], [f".{x}" for x in a.get("class", "").split()]
    for own in marks:
        for heads in ([name + x for x in own], own):
            said = [rules[x] for x in heads if x in rules]
            if said:
                return said[-1]
    return rules.get(name, False)


def visible(node: Node, rules: dict[str, bool] = _bare) -> bool:
    a = node.attrs
    if node.name in HIDDEN or (node.name == "dialog" and "open" not in a):
        return False
    if a and ("hidden" in a or a.get("aria-hidden") == "true" or (node.name == "input" and a.get("type", "").lower() == "hidden")):
        return False
    if a and "style" in a and _SHOWN.search(a["style"]):
        return not _NONE.search(a["style"])
    return not (rules and _by_rules(node.name, a, rules))


def _width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining marks."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Flow:
    """Lines in the making. gap: blank lines that the next text needs before it, -1 for none and no break."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.space = False
        self.item = False  # lists within an item follow its text without a blank line

    def text(self, text: str, keep: bool = False) -> None:
        if keep:
            head, *rest = text.split("\n")
            self._put(head)
            for x in rest:
                self.end(True)
                self._put(x)
            return
        words = text.split(" ")
        parts = [w for w in words if w]
        if not parts:
            self.space = self.space or bool(text)
            return
        if self.line and (self.space or text[0] == " "):
            self.line.append(" ")
        self._gap()
        self.line.append(" ".join(parts))
        self.space = text[-1] == " "

    def _put(self, text: str) -> None:
        if text:
            self._gap()
            self.line.append(text)
            self.space = False

    def _gap(self) -> None:
        if self.gap and not self.line:
            if self.lines and self.lines[-1] != "":
                self.lines.append("")
        self.gap = False

    def end(self, always: bool = False) -> None:
        if self.line or always:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, lines: list[str], spaced: bool) -> None:
        if not lines:
            return
        self.end()
        self.gap = self.gap or spaced
        self._gap()
        self.lines += lines
        self.gap = spaced

    def done(self) -> list[str]:
        self.end()
        first, last = 0, len(self.lines)
        while first < last and not self.lines[first]:
            first += 1
        while first < last and not self.lines[last - 1]:
            last -= 1
        return self.lines[first:last]


def _number(n: int, kind: str) -> str:
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, d = divmod(n - 1, 26)
            out = chr(97 + d) + out
        return out.upper() if kind == "A" else out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, digits in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += digits * (n // value)
            n %= value
        return out.upper() if kind == "I" else out
    return str(n)


def _int(text: str | None, other: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(m[1]) if m else other


def render(node: Node, rules: dict[str, bool] = _bare, deep: int = 0, pre: bool = False) -> list[str]:
    """The lines of a node's content, which stands in ``deep`` lists, quotes or tables."""
    flow = _Flow()
    _into(flow, node, rules, deep, pre)
    return flow.done()


def _into(flow: _Flow, node: Node, rules: dict[str, bool], deep: int, pre: bool) -> None:
    # nested inline and plain block elements share the flow, so the walk keeps its own stack
    todo: list = [(child, pre) for child in reversed(node.children)]
    if node.name == "details" and "open" not in node.attrs:
        todo = [(c, pre) for c in reversed(node.children) if isinstance(c, Node) and c.name == "summary"]
    while todo:
        x, keep = todo.pop()
        if isinstance(x, str):
            flow.text(x if keep else _SPACE.sub(" ", x), keep)
            continue
        if isinstance(x, tuple):  # the end of a block
            flow.end()
            flow.gap = flow.gap or x[0]
            continue
        if not visible(x, rules):
            continue
        name = x.name
        if deep >= DEEP and name in ("li", "td", "th"):
            flow.end()
        laid = deep < DEEP
        if name == "br":
            flow.end(True)
        elif name == "hr":
            flow.block(["-" * 20], True)
        elif name == "img":
            if x.attrs.get("alt", "").strip():
                flow.text(_SPACE.sub(" ", x.attrs["alt"]))
        elif name == "input":
            kind = x.attrs.get("type", "text").lower()
            shown = x.attrs.get("value") if kind not in ("checkbox", "radio", "password", "range", "color", "file", "image") else None
            shown = shown or x.attrs.get("placeholder") if kind not in ("checkbox", "radio", "range", "color", "file", "image") else None
            if shown:
                flow.text(_SPACE.sub(" ", shown))
        elif name == "table" and laid:
            flow.block(_table(x, rules, deep + 1), True)
        elif name in ("ul", "ol", "menu") and laid:
            flow.block(_list(x, rules, deep + 1), not flow.item)
        elif name in ("blockquote", "dd") and laid:
            flow.block(["  " + y if y else y for y in render(x, rules, deep + 1)], name == "blockquote")
        elif name in ("pre", "textarea", "xmp", "listing") and laid:
            flow.block(render(x, rules, deep + 1, True), name != "textarea")
        elif name in BLOCK:
            spaced = name in SPACED
            flow.end()
            flow.gap = flow.gap or spaced
            inner = x.children
            if name == "details" and "open" not in x.attrs:
                inner = [c for c in inner if isinstance(c, Node) and c.name == "summary"]
            todo.append(((spaced,), keep))
            todo.extend((c, keep) for c in reversed(inner))
        elif name == "q":
            todo.append(('"', keep))
            todo.extend((c, keep) for c in reversed(x.children))
            todo.append(('"', keep))
        else:
            todo.extend((c, keep) for c in reversed(x.children))


def _list(node: Node, rules: dict[str, bool], deep: int) -> list[str]:
    items: list[Node] = []
    for c in node.children:
        if isinstance(c, Node) and not visible(c, rules):
            continue
        if isinstance(c, Node) and c.name == "li":
            items.append(c)
            continue
        if not items or items[-1].name == "li":  # stray content, text or most often a list
            items.append(Node("#stray", _bare))
        items[-1].children.append(c)
    ordered, back = node.name == "ol", "reversed" in node.attrs
    n = _int(node.attrs.get("start"), sum(c.name == "li" for c in items) if back else 1)
    out: list[str] = []
    for c in items:
        flow = _Flow()
        flow.item = True
        if c.name != "li":
            _into(flow, c, rules, deep, False)
            out += ["  " + y if y else y for y in flow.done()]
            continue
        if ordered:
            n = _int(c.attrs.get("value"), n)
        mark = f"{_number(n, c.attrs.get('type', node.attrs.get('type', '1')))}. " if ordered else "- "
        n += -1 if back else 1
        _into(flow, c, rules, deep, False)
        lines = flow.done() or [""]
        out.append((mark + lines[0]).rstrip())
        out += [" " * len(mark) + y if y else y for y in lines[1:]]
    return out


def _parts(node: Node, rules: dict[str, bool]):
    """Children of a part of a table, with those of a form in its place; blank strings are left out."""
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, Node) and c.name == "form" and visible(c, rules):
            todo.extend(reversed(c.children))
        elif visible(c, rules) if isinstance(c, Node) else c.strip():
            yield c


def _rows(node: Node, rules: dict[str, bool]) -> tuple[list[Node], list[list[Node]], list[Node]]:
    """(captions, rows of cells, other content); head rows first, foot rows last."""
    captions, others = [], []
    groups: dict[str, list[list[Node]]] = {"thead": [], "tbody": [], "tfoot": []}

    def loose(parts: list) -> None:
        if parts:
            wrap = Node("div", _bare)
            wrap.children = parts
            others.append(wrap)

    def walk(part: Node, group: str) -> None:
        stray: list = []
        for c in _parts(part, rules):
            name = c.name if isinstance(c, Node) else ""
            if name == "caption":
                captions.append(c)
            elif name in groups and part is node:  # none stands in another
                walk(c, name)
            elif name == "tr":
                cells, rest = [], []
                for x in _parts(c, rules):
                    (cells if isinstance(x, Node) and x.name in ("td", "th") else rest).append(x)
                groups[group].append(cells)
                loose(rest)
            elif name in ("td", "th"):
                groups[group].append([c])
            elif part is node:
                loose([c])
            else:
                stray.append(c)
        loose(stray)

    walk(node, "tbody")
    return captions, groups["thead"] + groups["tbody"] + groups["tfoot"], others


class _Taken:
    """Columns that cells of rows above take, as runs in order, with a heap of when each part is given back.

    Where two cells claim a column it is the upper one's.
    """

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []

    def free(self, at: int) -> int:
        """The first column from ``at`` on that is not taken."""
        k = bisect_right(self.starts, at) - 1
        return self.ends[k] if k >= 0 and self.ends[k] > at else at

    def take(self, low: int, high: int, last: int) -> None:
        """Take what is free of [low, high) up to a row."""
        i, j = bisect_left(self.ends, low), bisect_right(self.starts, high)  # the runs that meet it, or stand next to it
        at = low
        for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True):
            if at < a:
                heappush(self.until, (last, at, min(a, high)))
            at = max(at, b)
        if at < high:
            heappush(self.until, (last, at, high))
        low, high = min([low, *self.starts[i : i + 1]]) if i < j else low, max([high, *self.ends[j - 1 : j]]) if i < j else high
        self.starts[i:j], self.ends[i:j] = [low], [high]

    def release(self, row: int) -> None:
        """Give back what was taken up to a row before this one."""
        while self.until and self.until[0][0] < row:
            _, low, high = heappop(self.until)
            k = bisect_right(self.starts, low) - 1
            a, b = self.starts[k], self.ends[k]
            rest = [x for x in ((a, low), (high, b)) if x[0] < x[1]]
            self.starts[k : k + 1], self.ends[k : k + 1] = [x for x, _ in rest], [x for _, x in rest]


def _table(node: Node, rules: dict[str, bool], deep: int) -> list[str]:
    captions, rows, others = _rows(node, rules)
    out: list[str] = []
    for c in [*others, *captions]:
        out += render(c, rules, deep)
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken = _Taken()
    for r, cells in enumerate(rows):
        line, down_from_here, at = [], [], 0
        taken.release(r)
        for c in cells:
            at = taken.free(at)
            span = min(max(1, _int(c.attrs.get("colspan"), 1)), 1000)
            down = min(max(1, _int(c.attrs.get("rowspan"), 1)), 65534)
            line.append((at, span, render(c, rules, deep)))
            if down > 1:
                from_ = at
                if down_from_here and down_from_here[-1][1:] == (at, r + down - 1):
                    from_ = down_from_here.pop()[0]
                down_from_here.append((from_, at + span, r + down - 1))
            at += span
        grid.append(line)
        for x in down_from_here:
            taken.take(*x)
    starts = _column_starts(grid)
    for line in grid:
        shown: dict[int, tuple[list[str], int]] = {}
        for at, _, lines in line:
            for y, text in enumerate(lines):
                if text:
                    parts, width = shown.get(y) or ([], 0)
                    pad = starts[at] - width if width < starts[at] <= FARTHEST else 0
                    pad = max(pad, 2) if parts else pad
                    parts += (" " * pad, text)
                    shown[y] = parts, width + pad + _width(text)
        if shown:
            out += ["".join(shown[y][0]).rstrip() if y in shown else "" for y in range(max(shown) + 1)]
    return out


def _column_starts(grid: list[list[tuple[int, int, list[str]]]]) -> dict[int, int]:
    """Where each column begins in which some cell does: two spaces after the widest cell of the one before."""
    widths: dict[int, int] = {}
    for line in grid:
        for at, span, lines in line:
            own = min(WIDEST, max([0, *map(_width, lines)])) if span == 1 else 0
            widths[at] = max(widths.get(at, 0), own)
    columns = sorted(widths)
    for line in grid:
        for at, span, lines in line:
            if span > 1:  # a wide cell widens its last column if it has to
                own = columns[bisect_left(columns, at) : bisect_left(columns, at + span)]
                more = min(WIDEST, max([0, *map(_width, lines)])) - sum(widths[k] for k in own) - 2 * (len(own) - 1)
                if more > 0:
                    widths[own[-1]] += more
    return dict(zip(columns, accumulate((widths[k] + 2 for k in columns), initial=0), strict=False))


def page_text(page: str | None) -> str | None:
    """The visible text of a page."""
    if page is None:
        return None
    root = parse(page)
    return "\n".join(render(root, root.attrs))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row of (page_id, html)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_text(x) for x in batch.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    return texts_of(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string")
