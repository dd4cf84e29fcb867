"""HTML text extraction by layout-aware rendering.

A tolerant tokenizer feeds a tree builder that supplies implied tags (html,
body, closing p, li, dt, dd, option, tr, td, th and table sections) and
ignores stray end tags; invisible elements (head contents, scripts, styles,
templates, ``hidden``, ``aria-hidden="true"``, ``display:none``,
``visibility:hidden`` but for descendants that are ``visible``, closed ``details`` but for their summary, hidden inputs)
are left out; the
renderer emits all visible text: inline white space collapses, blocks are
separated by line breaks (paragraph-like ones by a blank line), list items get
markers and indentation, preformatted text keeps its layout, and table cells
are padded to aligned columns.

Each page is rendered on its own in its input partition, without a shuffle.
The work is in proportion to the page, whatever its markup: tags are scanned by
position, every open element knows what a start or end tag would close, and
neither building nor rendering recurses.

Defined cases: NULL and empty pages render to the empty text; text without
tags is itself, collapsed; broken markup never fails (a tag whose quote or ">"
is missing ends at the next ">", else with the page); elements with
``visibility:visible`` inside hidden ones are shown; lists indent up to
``MAX_INDENT`` columns; tables nested deeper than ``MAX_TABLES`` and row spans
beyond ``MAX_SPANS`` at once keep their text but not their alignment; repeated
rows and NULL ids are rendered a row at a time; ids of any type pass through;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape
from itertools import accumulate
from unicodedata import category, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.textops import batches

MAX_INDENT, MAX_TABLES, MAX_SPANS = 80, 16, 64

# Element names of the HTML standard by their parsing and layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset("head script style template noscript title iframe noembed noframes object canvas svg audio video datalist".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset".split())
BLOCK = PARAGRAPH | frozenset(
    "html body div section article aside header footer nav main address form li dt dd tr thead tbody tfoot caption figcaption details summary legend option center".split()
)
CLOSES_P = (BLOCK | frozenset(["menu", "dir"])) - frozenset("html body tr thead tbody tfoot caption option legend summary".split())
#: a start tag closes these open elements, up to the nearest scope element
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
#: what a formatting or paragraph end tag may not close across
BARRIER = frozenset("td th table caption html body".split())

#: end tags that may close across cells
ROWS = BARRIER | frozenset("tr tbody thead tfoot".split())
FAMILIES = ("li", "dt", "option", "tr", "td", "tbody")
FAMILY = {tag: next(i for i, f in enumerate(FAMILIES) if IMPLIED_END[f] == rule) for tag, rule in IMPLIED_END.items()}

_NAME = re.compile(r"[^\s/>]+")
_ATTR = re.compile(r"[\s/]*+(=?[^\s/>=]++|=)(?:\s*+(=)\s*+)?")
_UNQUOTED = re.compile(r"[^\s>]*+")
_HIDDEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element: whether it is shown at all (``visible``), what it says of visibility
    (``shown``: None inherits), an ordered list's first number, whether only its summary
    is shown (``closed``), columns and rows of a cell."""

    __slots__ = ("children", "tag", "visible", "shown", "start", "closed", "span", "rows")

    def __init__(self, tag: str, visible: bool = True, shown: bool | None = None, start: int = 1, closed: bool = False, span: int = 1, rows: int = 1):
        self.tag, self.visible, self.shown, self.start, self.closed, self.span, self.rows, self.children = tag, visible, shown, start, closed, span, rows, []


def _number(text: str, least: int, most: int) -> int:
    m = re.match(r"\s*\+?(\d{1,9})", text, re.A)
    return min(max(int(m[1]), least), most) if m else 1


def _element(tag: str, attrs: dict[str, str]) -> Node:
    if tag in INVISIBLE:
        return Node(tag, False)
    if not attrs:
        return Node(tag, closed=tag == "details")
    style = attrs.get("style", "")
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(style) or (tag == "input" and attrs.get("type", "").lower() == "hidden")
    node = Node(tag, not hidden, closed=tag == "details" and "open" not in attrs)
    if style and (found := _VISIBILITY.findall(style)):
        node.shown = found[-1].lower() == "visible"
    if tag == "ol" and re.fullmatch(r"-?\d{1,9}", attrs.get("start", "")):
        node.start = int(attrs["start"])
    if tag in ("td", "th"):  # the HTML standard's bounds
        node.span, node.rows = _number(attrs.get("colspan", ""), 1, 1000), _number(attrs.get("rowspan", ""), 0, 65534) or 65534
    return node


class _Scanner:
    """Tags of a page by position; what is not there any more is searched for once."""

    def __init__(self, page: str):
        self.page, self.none = page, {}

    def find(self, what: str, at: int) -> int:
        """Like str.find, without looking twice for what is missing or still ahead."""
        known = self.none.get(what)
        if known is not None and (known < 0 or known >= at):
            return known
        self.none[what] = found = self.page.find(what, at)
        return found

    def tag(self, at: int) -> tuple[dict[str, str], int]:
        """Attributes of a tag whose name ends at ``at``, and where it ends."""
        page, n, begin, attrs = self.page, len(self.page), at, {}
        while m := _ATTR.match(page, at):
            at, value = m.end(), ""
            if m[2]:
                quote = page[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = self.find(quote, at + 1)
                    if end < 0:  # never closed: the tag ends at the next ">"
                        end = self.find(">", begin)
                        return attrs, end + 1 if end >= 0 else n
                    value, at = page[at + 1 : end], end + 1
                else:
                    v = _UNQUOTED.match(page, at)
                    value, at = v[0], v.end()
            attrs.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
        end = self.find(">", at)
        return attrs, end + 1 if end >= 0 else n


class _Tree:
    """Open elements.  Each knows the innermost ``p`` and the outermost element of every
    family of implied ends that a start tag after it would close (-1 for none)."""

    def __init__(self):
        self.root = Node("html")
        self.stack, self.p, self.ends = [self.root], [-1], [(-1,) * len(FAMILIES)]
        self.places: dict[str, list[int]] = {}
        self.barriers = [0]

    def push(self, node: Node) -> None:
        i, tag, ends = len(self.stack), node.tag, self.ends[-1]
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.places.setdefault(tag, []).append(i)
        self.p.append(i if tag == "p" else -1 if tag in BARRIER else self.p[-1])
        if tag in _FAMILY_TAGS:
            ends = tuple(-1 if tag in IMPLIED_END[f][1] else i if tag in IMPLIED_END[f][0] and e < 0 else e for f, e in zip(FAMILIES, ends, strict=True))
        self.ends.append(ends)
        if tag in BARRIER:
            self.barriers.append(i)

    def close(self, index: int) -> None:
        for node in self.stack[index:]:
            self.places[node.tag].pop()
        for x in (self.stack, self.p, self.ends):
            del x[index:]
        while self.barriers[-1] >= index:
            self.barriers.pop()

    def start(self, tag: str, attrs: dict[str, str]) -> Node | None:
        top = self.stack[-1].tag
        if tag == "html":
            return None
        if tag == "body":  # ends the head; a second one is ignored
            if self.places.get("head"):
                self.close(self.places["head"][-1])
            if self.places.get("body"):
                return None
        elif top == "head" and tag not in INVISIBLE and tag not in ("meta", "link", "base"):
            self.close(len(self.stack) - 1)  # content that cannot stand in the head ends it
        if tag in CLOSES_P and self.p[-1] >= 0:
            self.close(self.p[-1])
        if tag in FAMILY and self.ends[-1][FAMILY[tag]] >= 0:
            self.close(self.ends[-1][FAMILY[tag]])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.push(Node("tr"))  # a cell implies its row
        node = _element(tag, attrs)
        if tag in VOID:
            self.stack[-1].children.append(node)
        else:
            self.push(node)
        return node

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        at = self.places.get(tag)
        if not at:
            if tag in ("br", "p"):
                self.stack[-1].children.append(Node(tag))  # </br> and a stray </p> still break the line
        elif tag in ROWS or at[-1] > self.barriers[-1]:
            self.close(at[-1])


_FAMILY_TAGS = frozenset().union(*(a | b for a, b in IMPLIED_END.values()))


def parse(page: str) -> Node:
    """The tree of a page; elements that stay open end with it."""
    tree, scan = _Tree(), _Scanner(page)
    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        while 0 <= i < n - 1 and not (page[i + 1] in "!?/" or page[i + 1].isascii() and page[i + 1].isalpha()):
            i = page.find("<", i + 1)  # a "<" that opens nothing is text
        i = n if i < 0 or i == n - 1 else i
        if i > at:
            tree.stack[-1].children.append(unescape(page[at:i]))
        if i == n:
            break
        kind = page[i + 1]
        if page.startswith("<!--", i):
            ends = [(e, size) for what, size in (("-->", 3), ("--!>", 4)) if (e := scan.find(what, i + 2)) >= 0]
            at = min(e + size for e, size in ends) if ends else n
        elif kind in "!?" or kind == "/" and not page[i + 2 : i + 3].isalpha():
            end = scan.find(">", i)
            at = end + 1 if end >= 0 else n
        else:
            m = _NAME.match(page, i + 1 + (kind == "/"))
            tag = m[0].lower()
            attrs, at = scan.tag(m.end())
            if kind == "/":
                tree.end(tag)
                continue
            node = tree.start(tag, attrs)
            if node is None:
                continue
            if tag in ("pre", "textarea", "listing") and page.startswith("\n", at):
                at += 1  # a first line break does not count
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                raw = page[at : end.start()] if end else page[at:]
                at = scan.tag(end.end())[1] if end else n
                node.children.append(unescape(raw) if tag in ("textarea", "title") else raw)
                tree.close(len(tree.stack) - 1)
            elif tag in ("svg", "path") and page[at - 2 : at] == "/>":
                tree.close(len(tree.stack) - 1)
    return tree.root


class _Out:
    """Lines under construction; breaks collapse, pending spaces are dropped at line ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.blank = False
        self.breaks = 0
        self.indent = ""
        self.marker = ""

    def word(self, s: str) -> None:
        if not self.parts:
            if self.lines:
                self.lines.extend([""] * max(int(self.blank), self.breaks))
            self.blank, self.breaks = False, 0
            self.parts.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker = ""
        elif self.space:
            self.parts.append(" ")
        self.space = False
        self.parts.append(s)

    def flow(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s.startswith(" "):
            self.space = True
        if body := s.strip(" "):
            self.word(body)
            self.space = s.endswith(" ")

    def end_line(self) -> None:
        if self.parts:
            self.lines.append("".join(self.parts))
            self.parts = []
        self.space = False

    def line_break(self) -> None:
        """Ends the line; one that is empty already stays as an empty line."""
        if self.parts:
            self.end_line()
        else:
            self.breaks += 1

    def block(self, paragraph: bool) -> None:
        self.end_line()
        self.blank |= paragraph

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _rows(table: Node) -> tuple[list[tuple[int, list[Node]]], list[Node]]:
    """(rows as (section, cells), everything else) of a table, its sections opened up."""
    rows, rest, section = [], [], 0
    todo = [(c, 0) for c in reversed(table.children)]
    while todo:
        c, own = todo.pop()
        if isinstance(c, str):
            if c.strip():
                rest.append(c)
        elif c.visible:
            if c.tag in ("tbody", "thead", "tfoot"):
                section += 1
                todo.extend((x, section) for x in reversed(c.children))
            elif c.tag == "tr":
                rows.append((own, [x for x in c.children if isinstance(x, Node) and x.visible and x.tag in ("td", "th")]))
                rest.extend(x for x in c.children if (x.strip() if isinstance(x, str) else x.tag not in ("td", "th")))
            elif c.tag not in ("col", "colgroup"):
                rest.append(c)
    return rows, rest


def width_of(s: str) -> int:
    """Columns of a line: two for wide characters, none for combining and format ones."""
    if s.isascii():
        return len(s)
    return sum(0 if category(c) in ("Mn", "Me", "Cf") else 2 if east_asian_width(c) in "WF" else 1 for c in s)


def _places(rows: list[tuple[int, list[Node]]]) -> list[list[tuple[int, int]]]:
    """(first column, column after the last) of every cell, beside the cells that reach down from rows above."""
    out, above, section = [], [], None  # above: (first, after, rows left), by column
    for own, cells in rows:
        if own != section:
            above, section = [], own
        placed, below, j, k = [], [], 0, 0
        for cell in cells:
            while k < len(above) and above[k][0] < j + cell.span:  # a cell does not fit before or over this one
                if above[k][1] > j:
                    j = above[k][1]
                k += 1
            placed.append((j, j + cell.span))
            if cell.rows > 1:
                below.append((j, j + cell.span, cell.rows - 1))
            j += cell.span
        kept = [(a, b, n - 1) for a, b, n in above if n > 1]
        above = sorted(kept + below[: max(0, MAX_SPANS - len(kept))])
        out.append(placed)
    return out


def _grid(cells: list[list[str]], places: list[list[tuple[int, int]]]) -> str:
    """Rows with cells padded, line by line, to the widest line of their columns; a row is as high as its highest cell."""
    placed = [[(i, j, [(x, width_of(x)) for x in c.split("\n")]) for c, (i, j) in zip(row, where, strict=True)] for row, where in zip(cells, places, strict=True)]
    starts = sorted({i for row in placed for i, _, _ in row})  # columns where no cell starts take no room
    number = {i: k for k, i in enumerate(starts)}
    width = [0] * len(starts)
    wide = []
    for row in placed:
        for i, j, lines in row:
            k, after, most = number[i], bisect_left(starts, j), max(w for _, w in lines)
            if after == k + 1:
                width[k] = max(width[k], most)
            elif after < len(starts):  # in the last columns it needs no room
                wide.append((after, k, most))
    for after, k, most in sorted(wide):
        width[after - 1] += max(0, most - sum(width[k:after]) - 2 * (after - k - 1))
    left = [0, *accumulate(w + 2 for w in width)]
    out = []
    for row, texts in zip(placed, cells, strict=True):
        height = max(len(lines) for _, _, lines in row) if any(texts) else 0
        tall = [(i, lines) for i, _, lines in row]
        for h in range(height):
            parts, at = [], 0
            tall = [x for x in tall if h < len(x[1])]
            for i, lines in tall:
                text, size = lines[h]
                if text:
                    gap = max(0, left[number[i]] - at)
                    parts.append(" " * gap + text)
                    at += gap + size
            out.append("".join(parts))
    return "\n".join(out)


def render(root: Node) -> str:
    """The visible text of a tree (explicit stack: depth is not limited)."""
    outs = [_Out()]
    state = {"pre": 0, "shown": True, "tables": 0}
    todo: list = [("visit", root)]
    lists: list[list] = []  # open lists: [ordered, next number]

    def visit(node) -> None:
        out = outs[-1]
        if isinstance(node, str):
            if not state["shown"]:
                return
            if not state["pre"]:
                out.flow(node)
            else:
                for i, line in enumerate(node.split("\n")):
                    if i:
                        if not out.parts:
                            out.lines.append("")
                        out.end_line()
                    if line:
                        out.space = False
                        out.word(line)
            return
        if not node.visible:
            return
        tag = node.tag
        if node.shown is not None and node.shown != state["shown"]:
            todo.append(("shown", state["shown"]))
            state["shown"] = node.shown
        if tag == "br":
            out.line_break()
            return
        if tag == "hr":
            out.block(True)
            return
        if tag == "table":
            rows, rest = _rows(node)
            out.block(True)
            todo.append(("block", True))
            if state["tables"] >= MAX_TABLES:  # too deep to be aligned
                for _, row in reversed(rows):
                    todo.append(("block", False))
                    for cell in reversed(row):
                        todo.append(("visit", " "))
                        todo.append(("visit", cell))
                todo.extend(("visit", x) for x in reversed(rest))
                return
            state["tables"] += 1
            todo.append(("grid", rows))
            for _, row in reversed(rows):
                for cell in reversed(row):
                    todo.append(("cell", cell))
            for x in reversed(rest):  # captions and misplaced content come first
                todo.append(("visit", x))
            todo.append(("cells", None))
            return
        leave = []
        if tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag == "ol", node.start])
            leave.append(("unlist", None))
            nested = len(lists) > 1
            out.block(not nested)
            leave.append(("block", not nested))
        elif tag == "li":
            out.block(False)
            own = lists[-1] if lists else [False, 1]
            marker = f"{own[1]}. " if own[0] else "- "
            own[1] += 1
            leave.append(("indent", (out.indent, out.marker)))
            out.indent, out.marker = (out.indent + " " * len(marker))[:MAX_INDENT], marker
        elif tag in ("blockquote", "dd"):
            out.block(tag in PARAGRAPH)
            leave.append(("indent", (out.indent, out.marker)))
            out.indent = (out.indent + "  ")[:MAX_INDENT]
            leave.append(("block", tag in PARAGRAPH))
        elif tag == "pre":
            out.block(True)
            state["pre"] += 1
            leave.append(("unpre", None))
            leave.append(("block", True))
        elif tag == "textarea":
            state["pre"] += 1
            leave.append(("unpre", None))
        elif tag in BLOCK:
            out.block(tag in PARAGRAPH)
            leave.append(("block", tag in PARAGRAPH))
        todo.extend(leave)
        shown = node.children
        if node.closed:
            shown = [c for c in shown if isinstance(c, Node) and c.tag == "summary"][:1]
        todo.extend(("visit", c) for c in reversed(shown))

    grids: list[list[str]] = []
    while todo:
        what, x = todo.pop()
        out = outs[-1]
        if what == "visit":
            visit(x)
        elif what == "block":
            out.block(x)
        elif what == "indent":
            out.end_line()
            out.indent, out.marker = x
        elif what == "unlist":
            lists.pop()
        elif what == "unpre":
            state["pre"] -= 1
            out.end_line()
        elif what == "shown":
            state["shown"] = x
        elif what == "cells":
            grids.append([])
        elif what == "cell":
            outs.append(_Out())
            todo.append(("uncell", state["shown"]))
            if x.shown is not None:
                state["shown"] = x.shown
            todo.extend(("visit", c) for c in reversed(x.children))
        elif what == "uncell":
            grids[-1].append(outs.pop().text())
            state["shown"] = x
        elif what == "grid":
            state["tables"] -= 1
            flat, rows = grids.pop(), []
            at = 0
            for _, cells in x:
                rows.append(flat[at : at + len(cells)])
                at += len(cells)
            out.end_line()
            for line in _grid(rows, _places(x)).split("\n"):
                if line.strip():
                    out.word(line)
                    out.end_line()
    return outs[0].text()


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and visible text of every page."""

    def run(it):
        for batch in it:
            for lo, hi, texts in batches(batch, "html"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([page_text(x.decode("utf-8", "replace")) for x in texts], pa.string())], names=["id", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType().add("id", rows.schema["id"].dataType).add("text", "string")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
