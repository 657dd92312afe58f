"""HTML extraction by layout-aware rendering: all visible text of a page, laid out as plain text.

A tree builder supplies the tags that HTML lets authors leave out; visibility rules drop what a
browser does not show; a renderer keeps the spacing of blocks, marks and indents list items and
aligns the cells of tables in columns. Neither step recurses, so nesting has no limit.

Layout never multiplies a page: cell lines above `WIDEST` characters are not aligned with, a row
whose aligned form would be mostly space is laid out as blocks, and lists and tables more than
`MOST_NESTED` deep are blocks too. None of these rules drops text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tastemill.llm.frames import spare_name
from tastemill.session import ship_package

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template title noscript svg math iframe object canvas audio video datalist meta link base".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body div section article header footer nav main aside address form li dt dd tr td th thead tbody tfoot caption figcaption details summary center legend option optgroup select".split()
)
# A start tag (left) ends the open elements (right) that stand above the nearest border.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
P_BORDERS = frozenset("table td th caption button object body html".split())
HEAD_ONLY = frozenset("base link meta script style title template noscript".split())
# An end tag reaches no element outside these.
CLOSED_IN = frozenset({"td", "th", "table", "caption"})
# Widest line that a column is aligned with, most rows of a spanning cell, and depth of lists and tables that are laid out.
WIDEST, MOST_ROWS, MOST_NESTED = 40, 64, 16
# A row is aligned while it takes at most so many characters for each one of ink, and so many more for each cell.
SPACE_FOR_INK, SPACE_FOR_CELL = 8, 64
# The simple selectors of a style sheet that count: a tag, a class, an id, or a tag with one of these.
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?([.#][\w-]+)?", re.IGNORECASE)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Nodes of a page with the implied end and start tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of a tag

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ENDS:
            closes, borders = ENDS[tag]
            self._end_above(closes, borders)
        if tag in ("td", "th") and self.places["table"] and self.open[-1].tag not in ("tr", "#root"):
            if self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
                self._push("tr", {})
        if tag in BLOCKS and self.places["p"]:
            self._end_above({"p"}, P_BORDERS)
        if self.places["head"] and tag not in HEAD_ONLY and tag != "head":
            self._end_above({"head"}, {"html"})
        self._push(tag, dict(attrs))
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.handle_starttag("br", [])
            return
        if tag == "p" and not self.places["p"]:
            self._push("p", {})
        if not self.places[tag]:
            return
        depth = self.places[tag][-1]
        if tag not in ("table", "tr", "tbody", "thead", "tfoot") and self._nearest(CLOSED_IN) > depth:
            return
        while len(self.open) > depth:
            self._pop()

    def _nearest(self, tags) -> int:
        """Depth of the innermost open element of `tags`, 0 without one."""
        return max(self.places[t][-1] if self.places[t] else 0 for t in tags)

    def handle_data(self, data: str) -> None:
        if self.places["head"] and self.open[-1].tag == "head" and data.strip():
            self._end_above({"head"}, {"html"})
        self.open[-1].children.append(data)

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.places[tag].append(len(self.open))
        self.open.append(node)

    def _pop(self) -> None:
        self.places[self.open.pop().tag].pop()

    def _end_above(self, closes, borders) -> None:
        """End everything above and with the outermost of `closes` inside the nearest border."""
        border = self._nearest(borders)
        inside = [p[at] for c in closes if (p := self.places[c]) and (at := bisect_right(p, border)) < len(p)]
        while inside and len(self.open) > min(inside):
            self._pop()


def _declared(style: str) -> dict[str, str]:
    """Declarations of a style; of equal properties the last, of important ones the last of these."""
    found: dict[str, str] = {}
    important: dict[str, str] = {}
    for part in style.split(";"):
        name, colon, value = part.partition(":")
        if colon:
            value, mark, _ = value.strip().lower().partition("!")
            (important if mark else found)[name.strip().lower()] = value.strip()
    return {**found, **important}


class Rules:
    """What the page's own style sheets say of display and visibility, by simple selector."""

    def __init__(self, root: Node):
        self.by: dict[str, dict[str, str]] = {}
        stack = [root]
        while stack:
            node = stack.pop()
            if node.tag == "style":
                self._read("".join(c for c in node.children if isinstance(c, str)))
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def _read(self, sheet: str) -> None:
        pieces = sheet.split("/*")
        sheet = pieces[0] + "".join(p.partition("*/")[2] for p in pieces[1:])
        inside = 0  # of blocks of at-rules, which hold for other media or states
        for piece in sheet.split("}"):
            opened = piece.count("{")
            if not inside and opened == 1:
                selectors, _, body = piece.partition("{")
                for selector in selectors.rpartition(";")[2].split(","):
                    if (name := selector.strip()) and (simple := SELECTOR.fullmatch(name)):
                        own = {k: v for k, v in _declared(body).items() if k in ("display", "visibility")}
                        self.by.setdefault((simple[1] or "").lower() + (simple[2] or ""), {}).update(own)
            inside = max(0, inside + opened - 1)

    def of(self, node: Node) -> dict[str, str]:
        """Declarations for an element: by tag, class, id, then its own style."""
        found: dict[str, str] = {}
        if self.by:
            marks = ["", *("." + c for c in dict.fromkeys((node.attrs.get("class") or "").split())), "#" + (node.attrs.get("id") or " ").strip()]
            for mark in marks:
                for name in ((node.tag,) if not mark else (mark, node.tag + mark)):
                    found.update(self.by.get(name, {}))
        if style := node.attrs.get("style"):
            found.update(_declared(style))
        return found


def displayed(node: Node, styles: dict[str, str]) -> bool:
    attrs = node.attrs
    if node.tag in UNSEEN or "hidden" in attrs or (node.tag == "input" and (attrs.get("type") or "").lower() == "hidden"):
        return False
    if node.tag == "dialog" and "open" not in attrs:
        return False
    return styles.get("display") != "none"


def shown_children(node: Node) -> list:
    """All children; of a closed `details` its summary only."""
    if node.tag == "details" and "open" not in node.attrs:
        return next(([c] for c in node.children if isinstance(c, Node) and c.tag == "summary"), [])
    return node.children


class Flow:
    """Lines of text under construction; white space collapses across inline elements."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.blank = False

    def text(self, data: str) -> None:
        collapsed = SPACES.sub(" ", data)
        if collapsed.startswith(" "):
            self.space, collapsed = True, collapsed[1:]
        if not collapsed:
            return
        ends = collapsed.endswith(" ")
        self._word(collapsed[:-1] if ends else collapsed)
        self.space = ends

    def _word(self, text: str) -> None:
        if not self.parts:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
        elif self.space:
            self.parts.append(" ")
        self.parts.append(text)
        self.space = False

    def preformatted(self, data: str) -> None:
        for number, line in enumerate(data.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if number:
                self.line_break()
            if line:
                self.space = False
                self._word(line)

    def line_break(self) -> None:
        if self.parts:
            self.block()
        elif self.lines:
            self.lines.append("")

    def block(self, spaced: bool = False) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts = []
        self.space = False
        self.blank = self.blank or spaced

    def add_lines(self, lines: list[str], spaced: bool = False) -> None:
        if lines:
            self.block(spaced)
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines += lines

    def finished(self) -> list[str]:
        self.block()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # cells: first column, columns, lines
        self.caption: list[str] = []
        self.below: list[list[int]] = []  # first column, end and rows to come of cells that reach down
        self.begun: list[list[int]] = []  # the same of the row under construction
        self.column = self.at = 0

    def begin_row(self) -> None:
        self.below = sorted([[low, end, rows - 1] for low, end, rows in self.below if rows > 1] + self.begun)
        self.rows.append([])
        self.column, self.at, self.begun = 0, 0, []

    def add(self, cell: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.begin_row()
        while self.at < len(self.below) and self.below[self.at][0] < self.column + columns:
            self.column = max(self.column, self.below[self.at][1])
            self.at += 1
        self.rows[-1].append((self.column, columns, cell))
        if rows > 1:
            self.begun.append([self.column, self.column + columns, rows - 1])
        self.column += columns

    def lines(self) -> list[str]:
        """Rows of cells in aligned columns; a cell over several columns or rows counts in its first one."""
        rows = [r for r in self.rows if any(cell for *_, cell in r)]
        widths: dict[int, int] = {}
        for row in rows:
            for column, columns, cell in row:
                if columns == 1:
                    widths[column] = max([widths.get(column, 0), *(len(x) for x in cell if len(x) <= WIDEST)])
        known = sorted(widths)
        upto = [0]
        for column in known:
            upto.append(upto[-1] + widths[column])
        left = lambda column: upto[bisect_left(known, column)] + 2 * column
        out = list(self.caption)
        for row in rows:
            height = max(len(cell) for *_, cell in row)
            ink = sum(len(x) - x.count(" ") for *_, cell in row for x in cell)
            ends = [left(c) + max([0, *map(len, cell)]) for c, _, cell in row if cell]
            if height * max(ends) > SPACE_FOR_INK * ink + SPACE_FOR_CELL * len(row):
                out += [x for *_, cell in row for x in cell]
                continue
            for k in range(height):
                line = ""
                for column, _, cell in row:
                    if k < len(cell) and cell[k]:
                        # A line that is wider than its column moves what stands to its right.
                        line = line.ljust(left(column)) if len(line) < left(column) else line + "  " * bool(line)
                        line += cell[k]
                out.append(line.rstrip())
        return out


def _span(node: Node, name: str, most: int) -> int:
    value = (node.attrs.get(name) or "1").strip()
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def _number(value: str | None, default: int) -> int:
    text = (value or "").strip()
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text) else default


def rendered(html: str | None) -> str:
    """The visible text of a page; '' for a null or empty one."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html.replace("\x00", ""))
    builder.close()
    rules = Rules(builder.root)
    flows, lists, pre = [Flow()], [], 0
    tables: list[Table | None] = []
    stack: list[tuple[str, object, bool]] = [("enter", builder.root, True)]
    while stack:
        action, node, seen = stack.pop()
        flow = flows[-1]
        if action == "flat":  # the end of what is too deep for a layout of its own
            flow.block()
            if node.tag == "table":
                tables.pop()
            continue
        table = tables[-1] if tables else None
        if action == "leave":
            tag = node.tag
            if tag == "li":
                lines = flows.pop().finished()
                mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] += 1
                flows[-1].add_lines([(mark if i == 0 else " " * len(mark)) + x if x else "" for i, x in enumerate(lines)])
            elif tag == "dd":
                flows_lines = flows.pop().finished()
                flows[-1].add_lines(["  " + x if x else "" for x in flows_lines])
            elif tag in ("ul", "ol", "menu"):
                lists.pop()
                flow.block(spaced=not lists)
            elif tag in ("td", "th") and table:
                cell = flows.pop().finished()
                table.add(cell, _span(node, "colspan", 1000), _span(node, "rowspan", MOST_ROWS))
            elif tag == "caption" and table:
                table.caption += flows.pop().finished()
            elif tag == "table":
                outside = flows.pop().finished()  # text in a table but in no cell comes before it
                lines = tables.pop().lines()
                flows[-1].block(True)
                flows[-1].add_lines(outside)
                flows[-1].add_lines(lines)
                flows[-1].block(True)
            else:
                if tag in ("pre", "textarea"):
                    pre -= 1
                if tag in BLOCKS:
                    flow.block(tag in SPACED)
            continue
        if isinstance(node, str):
            if not seen:
                continue
            if pre:
                flow.preformatted(node)
            else:
                flow.text(node)
            continue
        styles = rules.of(node)
        if not displayed(node, styles):
            continue
        tag = node.tag
        if (look := styles.get("visibility")) in ("visible", "hidden", "collapse"):
            seen = look == "visible"
        if tag == "br":
            flow.line_break()
            continue
        if tag == "hr":
            flow.block(True)
            continue
        children = [("enter", child, seen) for child in reversed(shown_children(node))]
        if len(flows) > MOST_NESTED and tag in ("li", "dd", "table"):
            flow.block()
            if tag == "li" and seen:
                flow.text("- ")
            if tag == "table":
                tables.append(None)  # its rows and cells are blocks
            stack += [("flat", node, seen), *children]
            continue
        if tag == "li":
            flow.block()
            flows.append(Flow())
        elif tag == "dd":
            flow.block()
            flows.append(Flow())
        elif tag in ("ul", "ol", "menu"):
            flow.block(spaced=not lists)
            lists.append([tag, _number(node.attrs.get("start"), 1)])
        elif tag == "table":
            tables.append(Table())
            flows.append(Flow())
        elif tag == "tr" and table:
            table.begin_row()
        elif tag in ("td", "th", "caption") and table:
            flows.append(Flow())
        elif tag in BLOCKS:
            flow.block(tag in SPACED)
        if tag in ("pre", "textarea"):
            pre += 1
        stack += [("leave", node, seen), *children]
    return "\n".join(flows[0].finished())


def extract_text(pages: DataFrame, html_col: str = "html", text_name: str = "text") -> DataFrame:
    """`pages` with the visible text of each page.

    A null page gives an empty text, as does one without visible text. All rows and columns stay,
    repeated rows included; where a column already has the new name, underscores are added to it.
    Malformed pages are laid out as their tree is built; text outside any tag is visible.
    """
    text_name = spare_name(pages, text_name)
    place = [c.lower() for c in pages.columns].index(html_col.lower())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = pa.array([rendered(h) for h in part.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, text_name])

    ship_package(pages.sparkSession)
    return pages.mapInArrow(batches, StructType([*pages.schema.fields, StructField(text_name, StringType())]))
