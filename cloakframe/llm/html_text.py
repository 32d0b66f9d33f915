"""HTML to text, laid out: a tree builder with implied tags, visibility rules, block spacing, lists and aligned tables.

A scanner splits the source into tags, text and comments; the builder opens and closes elements, closing those that a
new tag implies closed and opening missing table parts; the renderer walks the tree without recursion and emits every
visible text once. Blocks start on lines of their own, paragraphs and headings are set off by a blank line, list items
get a dash or their number, cells of a table line up in columns, preformatted text keeps its blanks.

Defined results: null gives null, an empty page an empty text; malformed markup never fails and unclosed elements end
with the page. Text that aria-hidden marks is seen, and so are formulas and the labels of drawings; a visible part of an
invisible element is. The options of a select are left out, as controls and not text; rules of style sheets are not read.
Cells are padded to 80 characters at most. Equal pages get equal texts, repeated rows stay repeated; it is a function of
one column, so other columns never clash. Whole pages are read, however long or deeply nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes title textarea".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe object canvas audio video datalist select area base link meta title param source track dialog defs desc symbol metadata annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: Which open elements a start tag closes, and what ends the search for them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
_CLOSE_P = BLOCK - {"body", "html", "option", "optgroup", "legend"}
_SCOPE = frozenset({"table", "td", "th", "caption", "html", "template", "button", "object"})
_HEAD_PARTS = frozenset("base link meta title script style template noscript".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "kids", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.kids = name, attrs or {}, []


def build(source: str) -> Node:
    """The tree of a page; texts are plain strings in it."""
    root = Node("html")
    stack, open_names = [root], {"html": 1}
    source, at = source.replace("\x00", "�"), 0

    def pop() -> None:
        gone = stack.pop()
        open_names[gone.name] -= 1

    def close(names: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """Close up to the outermost of the names inside the bounds."""
        if not any(open_names.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in bounds:
                cut = depth + 1
                break
        else:
            cut = 1
        for depth in range(cut, len(stack)):
            if stack[depth].name in names:
                while len(stack) > depth:
                    pop()
                return

    def push(name: str, attrs: dict[str, str] | None = None) -> None:
        node = Node(name, attrs)
        stack[-1].kids.append(node)
        stack.append(node)
        open_names[name] = open_names.get(name, 0) + 1

    def add_text(text: str) -> None:
        if text:
            if open_names.get("head") and stack[-1].name == "head" and text.strip():
                pop()
            stack[-1].kids.append(text)

    while at < len(source):
        less = source.find("<", at)
        if less < 0:
            add_text(unescape(source[at:]))
            break
        if less > at:
            add_text(unescape(source[at:less]))
        tag = _TAG.match(source, less)
        if tag is None:
            add_text("<")
            at = less + 1
            continue
        at = tag.end()
        if tag["name"] is None:
            if tag["cdata"]:
                add_text(tag["cdata"])
            continue
        name = tag["name"].lower()
        if tag["end"]:
            if name == "br":
                stack[-1].kids.append(Node("br"))
            elif name == "p" and not open_names.get("p"):
                stack[-1].kids.append(Node("p"))
            elif open_names.get(name) and name not in ("html", "body"):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        while len(stack) > depth:
                            pop()
                        break
                    if stack[depth].name in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                        break
            continue
        attrs = {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(tag["attrs"])} if tag["attrs"].strip() else {}
        if name == "html":
            root.attrs |= attrs
            continue
        if name == "body" and open_names.get("body"):
            continue
        if stack[-1].name == "head" and name not in _HEAD_PARTS:
            pop()
        if name in _CLOSE_P and open_names.get("p"):
            close({"p"}, _SCOPE)
        if name in CLOSES:
            close(*CLOSES[name])
        if name in ("td", "th") and open_names.get("table") and stack[-1].name not in ("tr",):
            if stack[-1].name == "table":
                push("tbody")
            if stack[-1].name in ("tbody", "thead", "tfoot"):
                push("tr")
        elif name == "tr" and stack[-1].name == "table":
            push("tbody")
        if name in VOID:
            stack[-1].kids.append(Node(name, attrs))
            continue
        push(name, attrs)
        if name in RAW_TEXT:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            stop = end.start() if end else len(source)
            text = source[at:stop]
            add_text(unescape(text) if name in ("title", "textarea") else text)
            at = stop
            if end:
                at = (source.find(">", stop) + 1) or len(source)
            pop()
        elif name == "plaintext":
            add_text(source[at:])
            break
        elif tag["attrs"].rstrip().endswith("/") and name in ("svg", "path", "use"):
            pop()
    return root


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.name in HIDDEN and not (node.name == "dialog" and "open" in a) or bool(a) and ("hidden" in a or node.name == "input" and a.get("type", "").lower() == "hidden" or bool(_NO_DISPLAY.search(a.get("style", ""))))


def visible(node: Node, parent: bool) -> bool:
    """Whether an element's own text is seen: as its parent's, unless its style says otherwise."""
    said = _VISIBILITY.findall(node.attrs.get("style", "")) if node.attrs else []
    return said[-1].lower() == "visible" if said else parent


class _Out:
    """Lines under construction: blanks collapse, blocks break lines, blank lines never pile up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.want_blank, self.prefix = False, False, ""

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._put(first)
            for part in rest:
                self.newline(keep=True)
                self._put(part)
            return
        body = _BLANKS.sub(" ", text)
        if body == " " or not body:
            self.gap = self.gap or bool(body)
            return
        if body[0] == " ":
            self.gap, body = True, body[1:]
        tail = body.endswith(" ")
        self._put(body[:-1] if tail else body)
        self.gap = tail

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.line:
            if self.want_blank and self.lines:
                self.lines.append("")
            self.want_blank = False
            self.line.append(self.prefix)
            self.prefix = ""
        elif self.gap:
            self.line.append(" ")
        self.gap = False
        self.line.append(text)

    def newline(self, keep: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif keep:
            self.lines.append("")
        self.gap = False

    def block(self, spaced: bool) -> None:
        self.newline()
        self.want_blank = self.want_blank or spaced

    def whole(self) -> str:
        self.newline()
        return "\n".join(self.lines).strip("\n")


def render(root: Node) -> str:
    """All visible text of a tree, laid out. Tables are rendered cell by cell and lined up when their element ends."""
    out = _Out()
    outs: list[tuple[_Out, list]] = []  # what each open cell interrupts: the text and lists around its table
    tables: list[list[list[Cell]]] = []
    lists: list[int | None] = []
    pre, seen = 0, [True]
    steps: list[tuple[bool, Node | str]] = [(True, root)]
    while steps:
        opening, node = steps.pop()
        if isinstance(node, str):
            if seen[-1] and (node.strip() or len(tables) == len(outs)):  # blanks between the parts of a table say nothing
                out.text(node, pre > 0)
            continue
        name = node.name
        if opening:
            if hidden(node):
                continue
            shows = visible(node, seen[-1])
            if name == "br":
                out.newline(keep=not out.line)
                continue
            if name == "hr":
                out.block(False)
                continue
            if name in ("img", "input"):
                shown = node.attrs.get("alt" if name == "img" else "value", "")
                if shows and shown.strip():
                    out.text(shown, False)
                continue
            if name == "table":
                out.block(True)
                tables.append([])
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                outs.append((out, lists))
                out, lists = _Out(), []
            elif name in BLOCK:
                out.block(name in SPACED and not (name in ("ul", "ol") and lists))
                if name in ("ul", "ol", "menu", "dir"):
                    start = node.attrs.get("start", "1")
                    lists.append(int(start) if name == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if name == "ol" else None)
                elif name == "li":
                    depth = "  " * max(0, len(lists) - 1)
                    if lists and lists[-1] is not None:
                        if re.fullmatch(r"-?\d{1,9}", node.attrs.get("value", "")):
                            lists[-1] = int(node.attrs["value"])
                        out.prefix = f"{depth}{lists[-1]}. " if shows else ""
                        lists[-1] += 1
                    else:
                        out.prefix = f"{depth}- " if shows else ""
                elif name == "dd":
                    out.prefix = "  "
            if name in ("pre", "textarea", "xmp", "listing"):
                pre += 1
            seen.append(shows)
            steps.append((False, node))
            steps += [(True, kid) for kid in reversed(node.kids)]
            continue
        seen.pop()
        if name in ("pre", "textarea", "xmp", "listing"):
            pre -= 1
        if name == "table":
            rows = tables.pop()
            out.block(False)
            for line in aligned(rows):
                out._put(line) if line else None
                out.newline()
            out.block(True)
        elif name in ("td", "th") and tables:
            text = out.whole()
            out, lists = outs.pop()
            tables[-1][-1].append((text, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif name in BLOCK:
            if name in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            if name in ("li", "dd"):
                out.prefix = ""
            out.block(name in SPACED and not (name in ("ul", "ol") and lists))
    return out.whole()


#: Columns that a cell is padded to, at most: a wider one pushes the rest of its own row alone. And how many times longer
#: than its text a row of several lines may get by padding before its cells are put below each other.
WIDEST, MOST_PADDING = 80, 10
Cell = tuple[str, int, int]


def _span(node: Node, name: str, most: int) -> int:
    given = node.attrs.get(name, "1").strip()
    return min(int(given), most) if re.fullmatch(r"\d{1,9}", given) and int(given) else 1


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, int, str]]]:
    """(column, columns, text) of each row's cells; columns that a cell of a row above reaches down into are left free."""
    out, taken = [], {}
    for row in rows:
        now, column, free_again = [], 0, {c: n - 1 for c, n in taken.items() if n > 1}
        for text, wide, high in row:
            while column in taken:
                column += 1
            now.append((column, wide, text))
            if high > 1:
                free_again.update((c, high - 1) for c in range(column, column + wide))
            column += wide
        out.append(now)
        taken = free_again
    return out


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table of cells (text, columns, rows): cells of a column start at one place, also below cells that take
    several columns or rows; a cell of several lines takes several lines. No text is cut."""
    grid = placed([row for row in rows if row])
    widths: dict[int, int] = {}
    for row in grid:
        for column, wide, text in row:
            widths.setdefault(column, 0)
            if wide == 1:
                widths[column] = max(widths[column], min(WIDEST, max(map(len, text.split("\n")))))
    columns = sorted(widths)
    starts = dict(zip(columns, accumulate((widths[c] + 2 for c in columns), initial=0), strict=False))
    out: list[str] = []
    for row in grid:
        cells = [(starts[column], text.split("\n")) for column, _, text in row]
        height, said = max(len(lines) for _, lines in cells), sum(len(text) for _, _, text in row)
        if height > 1 and height * cells[-1][0] > MOST_PADDING * said + 10_000:
            out += [line for _, lines in cells for line in lines if line]
            continue
        for at in range(height):
            parts, end = [], 0
            for start, lines in cells:
                if at < len(lines) and lines[at]:
                    blanks = max(start - end, 2 if end else 0)
                    parts += [" " * blanks, lines[at]]
                    end += blanks + len(lines[at])
            out.append("".join(parts).rstrip())
    return out


def extract(source: str | None) -> str | None:
    return None if source is None else render(build(source))


def html_text(html: Column) -> Column:
    """Laid-out visible text of a column of pages."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract(page) for page in pages], dtype=object)

    return extracted(html)
