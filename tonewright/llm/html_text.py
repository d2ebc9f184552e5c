"""Visible text of HTML pages, laid out as blocks, lists and aligned tables.

A scanner cuts a page into tags, text, comments and raw content; a tree builder adds the
tags that HTML implies (html, head, body, tbody, tr; the ends of p, li, dt, dd, option,
table parts and more); a renderer walks the tree without recursion and writes all text
that a browser would show.

Not shown: head, scripts, styles, templates, frames' fallbacks, comments, elements with
`hidden`, `display:none` or `visibility:hidden` (but for what is `visible` inside), closed details but for their summary,
closed dialogs, data-only elements, and what stands in attributes only, as the alternative text of images and the labels of input
buttons do. Text of svg and math is shown but for their descriptions, definitions
and annotations, and so is what a map holds. Blocks begin on lines of their own, paragraphs, headings, lists, tables
and quotes stand between blank lines, list items get their bullet or number and are
indented by depth, and the cells of a table are padded so that columns line up; a cell that
spans columns or rows keeps them from the cells beside and below it. Text that stands in a table but in no cell
comes before the table. Items count as `start`, `value` and `reversed` say. Runs of
white space become one space, except in pre and textarea.

Null and empty pages give an empty text; broken markup is repaired as above and never
fails; very long or deeply nested pages are rendered whole; repeated rows are rendered
alike; an empty table gives an empty table. Other columns pass through unless the text
column replaces one of them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, texts_of

# Classes of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_WITH_ENTITIES = frozenset("title textarea".split())
RAW_ENDS = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in RAW | RAW_WITH_ENTITIES}
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist audio video canvas object param source track meta link base area".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("blockquote dir dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
CLOSES_P = BLOCKS - frozenset("html body li dd dt option optgroup legend".split()) | frozenset(["li", "dd", "dt"])
#: Which open elements a start tag ends, and the elements that it does not look beyond.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset("td th caption colgroup".split()), frozenset(["table", "tr"])),
    "th": (frozenset("td th caption colgroup".split()), frozenset(["table", "tr"])),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
#: Not shown inside svg or math; elsewhere these names mean nothing.
FOREIGN_UNSEEN = frozenset("annotation annotation-xml clippath defs desc lineargradient marker mask metadata pattern radialgradient symbol".split())
#: A slash at a tag's end that belongs to a value.
VALUE_SLASH = re.compile(r"=\s*(?:[^\s\"'=][^\s\"']*)?/$")
#: Stands for the span of a caption; cells span 1 column or more.
CAPTION = 0
#: An end tag of a name does not close elements outside of these.
WALLS = frozenset("table td th caption button html body".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
UNSEEN_STYLE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
BLANK = re.compile(r"[ \t\n\r\f]+")
ORDINAL = re.compile(r"[ \t\n\r\f]*[+-]?[0-9]{1,9}")


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Builder:
    """A tree with the implied tags from a stream of tags and text."""

    def __init__(self):
        self.root = Node("html", {})
        self.open: list[Node] = [self.root]
        self.count: dict[str, int] = {"html": 1}  # open elements by name, so that no search is made for what is not there
        self.body: Node | None = None

    def foreign(self) -> bool:
        """Whether the open element is part of svg or math."""
        if not (self.count.get("svg") or self.count.get("math")):
            return False
        return next((x.name != "foreignobject" for x in reversed(self.open) if x.name in ("svg", "math", "foreignobject")), False)

    def cut(self, at: int) -> None:
        """Close the open elements from this place on."""
        for x in self.open[at:]:
            self.count[x.name] -= 1
        del self.open[at:]

    def add(self, name: str, given: dict[str, str]) -> Node:
        node = Node(name, given)
        self.open[-1].children.append(node)
        self.open.append(node)
        self.count[name] = self.count.get(name, 0) + 1
        return node

    def ensure_body(self) -> None:
        if self.body is None:
            self.cut(1)
            self.body = self.add("body", {})

    def end_nearest(self, names: frozenset[str], walls: frozenset[str]) -> None:
        """Close everything from the outermost of these names inside the nearest wall."""
        left = sum([self.count.get(x, 0) for x in names])
        cut = None
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].name
            if not left or name in walls:
                break
            if name in names:
                cut, left = i, left - 1
        if cut is not None:
            self.cut(cut)

    def text(self, value: str) -> None:
        if not value:
            return
        if self.body is None and not (len(self.open) > 1 and self.open[-1].name in HEAD_ONLY):
            if not value.strip(" \t\n\r\f"):
                return
            self.ensure_body()
        self.open[-1].children.append(value)

    def start(self, name: str, given: dict[str, str]) -> None:
        if name == "html":
            self.root.attributes |= given
            return
        if name == "head":
            if self.body is None and len(self.open) == 1:
                self.add("head", given)
            return
        if name == "body":
            if self.body is None:
                self.ensure_body()
                self.body.attributes = given
            return
        if self.body is None and name not in HEAD_ONLY:
            self.ensure_body()
        if name in CLOSES_P:
            self.end_nearest(frozenset(["p"]), frozenset("table td th caption button".split()))
        if name in ENDS:
            self.end_nearest(*ENDS[name])
        inside = self.open[-1].name
        if name in ("td", "th") and inside != "tr":
            if inside == "table":
                self.add("tbody", {})
            if self.open[-1].name in ("tbody", "thead", "tfoot"):
                self.add("tr", {})
        elif name == "tr" and inside == "table":
            self.add("tbody", {})
        self.add(name, given)
        if name in VOID:
            self.cut(-1)

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name == "head":
            if self.body is None:
                self.cut(1)
            return
        if name == "br":
            self.start("br", {})
            return
        if name == "p" and not self.count.get("p"):
            self.start("p", {})
        if not self.count.get(name):
            return
        for i in range(len(self.open) - 1, 0, -1):
            at = self.open[i].name
            if at == name:
                self.cut(i)
                return
            if at in WALLS and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption"):
                return


def parse(page: str) -> Node:
    build, at = Builder(), 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            build.text(html.unescape(page[at:]))
            break
        build.text(html.unescape(page[at : m.start()]))
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                build.text(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            build.end(name)
            continue
        given = attributes(m[3]) if m[3] and not m[3].isspace() else {}
        if name in FOREIGN_UNSEEN and build.foreign():
            given["hidden"] = ""
        build.start(name, given)
        if m[3].endswith("/") and name not in VOID and not VALUE_SLASH.search(m[3]) and build.foreign():
            build.end(name)
            continue
        if name in RAW or name in RAW_WITH_ENTITIES:
            m = RAW_ENDS[name].search(page, at)
            stop = m.start() if m else len(page)
            raw = page[at:stop]
            build.text(html.unescape(raw) if name in RAW_WITH_ENTITIES else raw)
            at = stop
    return build.root


def width(text: str) -> int:
    """Columns on a fixed-width screen."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Writer:
    """Lines of text, with margins between blocks and marks before list items."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.margin = 0
        self.indent: list[int] = []
        self.mark: str | None = None

    def text(self, value: str, exact: bool) -> None:
        if exact:
            parts = value.replace("\r\n", "\n").split("\n")
            for i, part in enumerate(parts):
                if i:
                    self.flush(True)
                if part:
                    self.line.append(part.expandtabs(8))
            self.space = False
            return
        body = BLANK.sub(" ", value)
        if body.startswith(" "):
            self.space = self.space or bool(self.line)
            body = body[1:]
        if not body:
            return
        tail = body.endswith(" ")
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(body[:-1] if tail else body)
        self.space = tail

    def flush(self, keep_empty: bool = False) -> None:
        body = "".join(self.line).replace("\xa0", " ").rstrip()
        self.line, self.space = [], False
        if not body and not keep_empty:
            return
        if self.margin > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.margin = 0
        pad = " " * sum(self.indent)
        if self.mark is not None and body:
            pad = pad[: max(len(pad) - len(self.mark), 0)] + self.mark
            self.mark = None
        self.lines.append((pad + body).rstrip())

    def block(self, margin: int) -> None:
        self.flush()
        self.margin = max(self.margin, margin)

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


class Cell(NamedTuple):
    """A cell's columns, rows and lines."""

    columns: int
    rows: int
    lines: list[str]


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """The column of each cell: those that cells of earlier rows reach down into are taken.

    Taken columns are kept as (first, end, rows left), in order, however wide they are.
    """
    taken: list[tuple[int, int, int]] = []
    out = []
    for row in rows:
        at, places, new, k = 0, [], [], 0
        for cell in row:
            while k < len(taken) and taken[k][0] <= at:
                at = max(at, taken[k][1])
                k += 1
            places.append((at, cell))
            end = at + cell.columns
            if cell.rows > 1:
                new.append((at, end, cell.rows - 1))
            at = end
        taken = sorted([(a, b, n - 1) for a, b, n in taken if n > 1] + new)
        out.append(places)
    return out


def table_lines(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table with padded cells; a cell that spans rows is written in the first of them.

    Columns in which no cell begins have no width of their own.
    """
    grid = placed(rows)
    starts = sorted({at for row in grid for at, _ in row})
    order = {at: k for k, at in enumerate(starts)}
    wide = [0] * len(starts)
    broad = []
    for row in grid:
        for at, cell in row:
            first, end = order[at], bisect_left(starts, at + cell.columns)
            need = max([0, *map(width, cell.lines)])
            if end - first == 1:
                wide[first] = max(wide[first], need)
            else:
                broad.append((first, end, need))
    for first, end, need in broad:  # what a wide cell needs beyond its columns goes to the last of them
        wide[end - 1] += max(need - sum(wide[first:end]) - 2 * (end - first - 1), 0)
    begin = list(accumulate([w + 2 for w in wide], initial=0))
    out = []
    for row in grid:
        for k in range(max([1, *(len(cell.lines) for _, cell in row)])):
            parts, used = [], 0
            for at, cell in row:
                line = cell.lines[k] if k < len(cell.lines) else ""
                gap = max(begin[order[at]] - used, 2 if at else 0)
                parts.append(" " * gap + line)
                used += gap + width(line)
            out.append("".join(parts).rstrip())
    return out


def unseen(node: Node) -> bool:
    if node.name in UNSEEN or "hidden" in node.attributes:
        return True
    if node.name == "dialog" and "open" not in node.attributes:
        return True
    return "style" in node.attributes and bool(UNSEEN_STYLE.search(node.attributes["style"]))


def number(value: str, least: int, default: int) -> int:
    digits = value.strip()
    return max(least, min(int(digits[:6]), 1000)) if digits.isdecimal() else default


def ordinal(value: str, default: int) -> int:
    """A list item's number: an integer of any sign, of nine digits at most."""
    m = ORDINAL.match(value)
    return int(m[0]) if m else default


def render(root: Node) -> str:
    """Text of the visible nodes, walked with a stack of steps."""
    writers = [Writer()]
    tables: list[list[list[Cell]]] = []
    lists: list[list] = []
    exact = 0
    hidden: list[bool] = [False]  # visibility, which children may turn on again
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        w = writers[-1]
        if isinstance(node, str):
            if not hidden[-1]:
                w.text(node, exact > 0)
            continue
        name = node.name
        if not leaving:
            if unseen(node):
                continue
            if name == "br":
                w.flush(True)
                continue
            if name == "wbr" or name in VOID - {"hr"}:
                continue
            told = VISIBILITY.findall(node.attributes["style"]) if "style" in node.attributes else []
            hidden.append(told[-1].lower() != "visible" if told else hidden[-1])
            if name in ("td", "th", "caption") and tables:
                writers.append(Writer())
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name == "table":
                w.block(2)
                tables.append([])
            elif name in BLOCKS or name == "text":  # each text of an svg stands apart
                w.block(2 if name in SPACED and not (name in ("ul", "ol") and lists) else 1)
            if name in ("ul", "ol", "menu", "dir"):
                back = name == "ol" and "reversed" in node.attributes
                default = sum(isinstance(x, Node) and x.name == "li" for x in node.children) if back else 1
                lists.append([name == "ol", ordinal(node.attributes.get("start", ""), default), -1 if back else 1])
            elif name == "li":
                numbered, n, step = lists[-1] if lists else (False, 0, 1)
                n = ordinal(node.attributes.get("value", ""), n) if numbered else n
                mark = f"{n}. " if numbered else "- "
                if lists:
                    lists[-1][1] = n + step
                w.mark = None if hidden[-1] else mark
                w.indent.append(len(mark))
            elif name in ("dd", "blockquote"):
                w.indent.append(2)
            elif name in ("pre", "textarea", "xmp"):
                exact += 1
            elif name == "q" and not hidden[-1]:
                w.text('"', False)
            todo.append((node, True))
            inner = node.children
            if name == "details" and "open" not in node.attributes:
                inner = [x for x in inner if isinstance(x, Node) and x.name == "summary"][:1]
            todo.extend((x, False) for x in reversed(inner))
            continue
        unshown = hidden.pop()
        if name in ("td", "th", "caption") and tables:
            lines = writers.pop().done()
            if name == "caption":
                tables[-1].append([Cell(CAPTION, 1, lines)])
            else:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append(Cell(number(node.attributes.get("colspan", ""), 1, 1), number(node.attributes.get("rowspan", ""), 1, 1), lines))
        elif name == "table":
            captions = [row[0].lines for row in tables[-1] if row and row[0].columns == CAPTION]
            rows = [row for row in tables.pop() if not row or row[0].columns != CAPTION]
            w.flush()  # text that stands in the table but in no cell comes before it
            for lines in [*captions, [x for x in table_lines(rows) if x]]:
                for line in lines:
                    w.line = [line]
                    w.flush()
            w.block(2)
        elif name in ("pre", "textarea", "xmp"):
            exact -= 1
            w.block(2 if name == "pre" else 1)
        elif name in BLOCKS or name == "text":
            w.block(2 if name in SPACED and not (name in ("ul", "ol") and len(lists) > 1) else 1)
        if name in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
        elif name == "li":
            w.indent.pop()
            w.mark = None
        elif name in ("dd", "blockquote"):
            w.indent.pop()
        elif name == "q" and not unshown:
            w.text('"', False)
    return "\n".join(writers[0].done())


def visible_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add the visible text of each page."""
    kept = df.drop(*([text_col] if text_col != html_col else []))
    schema = T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, html_col):
            out = [visible_text(x) for x in texts_of(b, html_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, text_col])

    return kept.mapInArrow(run, schema)
