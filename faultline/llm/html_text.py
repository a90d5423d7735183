"""Visible text of web pages, laid out in plain lines."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set(
    "head title script style template noscript noframes noembed iframe object svg math audio video canvas datalist rp".split()
)
SPACED = set(
    "address article aside blockquote body details dialog dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup html main nav ol p pre section table ul".split()
)
BLOCK = SPACED | set("caption center dd div dt figcaption legend li option optgroup select summary tbody td tfoot th thead tr".split())
IN_HEAD = set("base link meta noscript script style template title".split())
# What an opening tag closes, and the elements behind which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
SCOPE = {"table", "td", "th", "caption", "button", "object", "template", "html"}
CELLS = {"td", "th"}
GROUPS = {"thead", "tbody", "tfoot"}
ROW_PARENTS = GROUPS | {"table"}
THROUGH_CELLS = GROUPS | {"tr", "table"}  # end tags that close the cells inside
NOT_INLINE = BLOCK | HIDDEN
FOREIGN = {"svg", "math"}  # only here a slash ends an element
DEEPEST = 512  # as in browsers: an element further down takes the place of the innermost open one
BOUND = 40  # a longer cell does not widen its column
MOST_COLUMNS = 64  # further cells of a row follow without a column of their own
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Cell(NamedTuple):
    text: str
    columns: int = 1
    rows: int = 1


def grid(rows: list[list[Cell]]) -> list[str]:
    """The lines of a table, every cell at its column.

    A cell too long for its columns stands on a line of its own, at its column, and the rest of its
    row follows below at its columns; the last cell of a row may be of any length.
    """
    until, placed = [0] * MOST_COLUMNS, []
    for r, row in enumerate(rows):
        at, cells = 0, []
        for cell in row:
            while at < MOST_COLUMNS and until[at] > r:
                at += 1
            end = min(at + cell.columns, MOST_COLUMNS)
            until[at:end] = [max(u, r + cell.rows) for u in until[at:end]]  # cells may overlap
            cells.append((at, end, cell.text))
            at = max(end, at)
        placed.append(cells)
    widths = [0] * MOST_COLUMNS
    for cells in placed:
        for at, end, text in cells:
            if end - at == 1 and len(text) <= BOUND:
                widths[at] = max(widths[at], len(text))
    for cells in placed:
        for at, end, text in cells:
            if end - at > 1 and len(text) <= BOUND:
                missing = len(text) - sum(widths[at:end]) - 2 * (end - at - 1)
                widths[end - 1] += max(0, missing)
    starts = [0]
    for width in widths:
        starts.append(starts[-1] + width + 2)
    lines = []
    for cells in placed:
        line = ""
        for k, (at, end, text) in enumerate(cells):
            if at < MOST_COLUMNS:
                start, last = starts[at], k + 1 == len(cells)
                if not last and len(text) > starts[end] - 2 - start:
                    lines += [x for x in (line.rstrip(),) if x]
                    lines.append(" " * start + text)
                    line = ""
                    continue
                line = line.ljust(start)
            elif line:
                line += "  "
            line += text
        if line.strip() or not any(text for _, _, text in cells):
            lines.append(line.rstrip())
    return lines


class _Frame:
    """An open block."""

    __slots__ = ("tag", "spaced", "pre", "started", "gap", "blank", "inline", "number", "rows", "span", "indents", "base")

    def __init__(self, tag: str, spaced: bool, pre: bool):
        self.tag, self.spaced, self.pre = tag, spaced, pre
        self.started = self.gap = False
        self.blank = 0  # empty lines that stay only if another line follows
        self.inline: list[str] = []
        self.number = 1
        self.rows: list[list[Cell]] = []
        self.span = (1, 1)
        self.indents = 0
        self.base: tuple[list[str], int, int] | None = None


class Layout:
    """Lines of text from blocks as they open and close; a line is put together once, when it is complete.

    What stands left of a line (list marks, quotation marks) is read off the open blocks at that
    moment. Cells collect lines of their own and become a grid when their table closes.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.frames = [_Frame("", False, False)]
        self.indents: list[list] = []  # mark of the first line, of the others, whether the first is out
        self.first_frame = self.first_indent = 0

    @property
    def tag(self) -> str:
        return self.frames[-1].tag

    def open(self, tag: str, pre: bool, start: int | None = None, span: tuple[int, int] = (1, 1)) -> None:
        """Begin a block; ``start`` is the number a list begins with, or an item has."""
        self._flush()
        up = self.frames[-1]
        frame = _Frame(tag, tag in SPACED and not (tag in ("ul", "ol") and up.tag == "li"), pre)
        if tag == "ol" and start is not None:
            frame.number = start
        if tag == "li":
            mark = "- "
            if up.tag == "ol":
                up.number = up.number if start is None else start
                mark = f"{up.number}. "
                up.number += 1
            self.indents.append([mark, " " * len(mark), False])
        elif tag == "blockquote":
            self.indents.append(["> ", "> ", False])
        elif tag == "dd":
            self.indents.append(["    ", "    ", False])
        elif tag in CELLS and up.tag == "tr":
            frame.span = span
            frame.base = (self.lines, self.first_frame, self.first_indent)
            self.lines, self.first_frame, self.first_indent = [], len(self.frames), len(self.indents)
        frame.indents = len(self.indents)
        self.frames.append(frame)

    def close(self) -> None:
        """End the innermost block."""
        self._flush()
        frame = self.frames[-1]
        if frame.rows and frame.tag not in GROUPS and frame.tag != "tr":
            for line in grid(frame.rows):
                self._emit(line)
        self.frames.pop()
        up = self.frames[-1]
        if frame.tag in ("li", "blockquote", "dd"):
            self.indents.pop()
        if frame.base:
            text = " ".join(line.strip() for line in self.lines if line.strip())
            self.lines, self.first_frame, self.first_indent = frame.base
            up.rows.append([Cell(text, *frame.span)])
        elif frame.tag == "tr" and frame.rows:
            up.rows.append([cell for row in frame.rows for cell in row])
        elif frame.tag in GROUPS:
            up.rows += frame.rows
        if frame.started and frame.spaced and not frame.base:
            up.gap = True

    def text(self, data: str) -> None:
        self.frames[-1].inline.append(data)

    def rule(self) -> None:
        """A dividing line: what follows stands apart."""
        self._flush()
        frame = self.frames[-1]
        frame.gap = frame.started and not frame.blank

    def _flush(self) -> None:
        """End the line of text that runs so far."""
        frame = self.frames[-1]
        if frame.inline:
            text = "".join(frame.inline)
            frame.inline = []
            for line in text.split("\n"):
                line = line.rstrip() if frame.pre else _SPACE.sub(" ", line).strip()
                if line:
                    self._emit(line)
                elif frame.pre:
                    self._emit("")

    def _emit(self, line: str) -> None:
        if not line:
            frame = self.frames[-1]
            frame.blank += 1 + frame.gap
            frame.gap = False
            return
        k = top = len(self.frames) - 1
        while k > self.first_frame and not self.frames[k].started:
            k -= 1
        upper = self.frames[k]
        if upper.started and not upper.blank and (upper.gap or k < top and self.frames[k + 1].spaced):
            self._empty(upper.indents)
        upper.gap = False
        for frame in self.frames[k:]:
            for _ in range(frame.blank):
                self._empty(frame.indents)
            frame.blank, frame.started = 0, True
        left = []
        for indent in self.indents[self.first_indent :]:
            left.append(indent[indent[2]])
            indent[2] = True
        self.lines.append("".join(left) + line)

    def _empty(self, indents: int) -> None:
        """An empty line within so many indents; only quotation marks and first marks show on it."""
        out = ""
        for indent in reversed(self.indents[self.first_indent : indents]):
            if out or indent[0] == "> " or not indent[2]:
                out = indent[indent[2]] + out
            indent[2] = True
        self.lines.append(out)

    def finish(self) -> str:
        while len(self.frames) > 1:
            self.close()
        self._flush()
        for line in grid(self.frames[0].rows):
            self._emit(line)
        return "\n".join(self.lines)


class _Element(NamedTuple):
    tag: str
    gone: bool  # not shown, nor anything in it
    unseen: bool  # its text is not shown, but what is declared visible in it is
    pre: bool
    block: bool  # the layout has a block for it


def _number(attrs: dict[str, str | None], name: str, least: int, most: int) -> int | None:
    found = re.match(r"\s*([+-]?\d{1,9})", attrs.get(name) or "")
    return min(max(int(found[1]), least), most) if found else None


def _styles(attrs: dict[str, str | None]) -> dict[str, str]:
    pairs = (d.partition(":") for d in (attrs.get("style") or "").lower().split(";"))
    return {name.strip(): value.replace("!important", "").strip() for name, _, value in pairs}


class PageTree(HTMLParser):
    """Follows the open elements of a page and tells a layout of visible blocks and texts.

    End tags that HTML lets authors leave out are implied, unknown end tags are ignored, whatever is
    open at the end closes. Not shown: what HIDDEN lists, closed dialogs, ``hidden``, and inline
    styles that hide; style sheets are not applied. Where each tag is open is kept in lists, so
    a tag costs no walk over the open elements.
    """

    def __init__(self, layout: Layout | None = None):
        super().__init__(convert_charrefs=True)
        self.layout = layout or Layout()
        self.open = [_Element("", False, False, False, True)]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.cells = [0], [0]
        self.after_pre = False

    def _close_to(self, k: int) -> None:
        while len(self.open) > k:
            e = self.open.pop()
            self.places[e.tag].pop()
            if e.tag in BLOCK:
                self.blocks.pop()
            if e.tag in CELLS:
                self.cells.pop()
            if e.block:
                self.layout.close()

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _close_near(self, tags: set[str], limits: set[str]) -> None:
        """Close from the outermost of ``tags`` that is open within the innermost of ``limits``."""
        inner = [places for places in map(self.places.get, tags) if places]
        if not inner:
            return
        limit = max((self._last(tag) for tag in limits if tag not in tags), default=0)
        found = len(self.open)
        for places in inner:
            k = bisect_right(places, limit)
            if k < len(places):
                found = min(found, places[k])
        self._close_to(found)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.after_pre = False
        if tag == "br":
            self._text("\n", True)
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._close_to(len(self.open) - 1)
        if tag in CLOSES:
            self._close_near(*CLOSES[tag])
        elif tag in BLOCK:
            self._close_near({"p"}, SCOPE)
        if tag in CELLS and self.open[self.blocks[-1]].tag in ROW_PARENTS:
            self.handle_starttag("tr", [])
        if tag == "hr" and not self.open[-1].gone:
            self.layout.rule()
        if tag in VOID:
            return
        if len(self.open) > DEEPEST:
            if self.open[-1].gone:
                return
            self._close_to(len(self.open) - 1)
        self._open(tag, dict(reversed(attrs)) if attrs else {})

    def _open(self, tag: str, attrs: dict[str, str | None]) -> None:
        above, style = self.open[-1], _styles(attrs) if attrs else {}
        gone = above.gone or tag in HIDDEN or "hidden" in attrs or style.get("display") == "none"
        gone = gone or tag == "dialog" and "open" not in attrs
        unseen = above.unseen
        if style.get("visibility") in ("hidden", "collapse", "visible"):
            unseen = style["visibility"] != "visible"
        pre = above.pre or tag in ("pre", "textarea")
        block = tag in BLOCK and not gone
        if block and not attrs:
            self.layout.open(tag, pre)
        elif block:
            start = _number(attrs, "start" if tag == "ol" else "value", -(10**9), 10**9)
            rows = _number(attrs, "rowspan", 0, 65_534)
            span = (_number(attrs, "colspan", 1, 1000) or 1, 65_534 if rows == 0 else rows or 1)
            self.layout.open(tag, pre, start if tag in ("ol", "li") else None, span)
        k = len(self.open)
        self.open.append(_Element(tag, gone, unseen, pre, block))
        self.places.setdefault(tag, []).append(k)
        if tag in BLOCK:
            self.blocks.append(k)
        if tag in CELLS:
            self.cells.append(k)
        self.after_pre = tag == "pre"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and (tag in FOREIGN or tag not in NOT_INLINE):
            self._close_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        self.after_pre = False
        k = self._last(tag)
        if tag in VOID or not k:
            return
        if tag not in NOT_INLINE and self.blocks[-1] > k:
            return
        if tag not in THROUGH_CELLS and self.cells[-1] > k:
            return
        self._close_to(k)

    def handle_data(self, data: str) -> None:
        if self.after_pre and data.startswith("\n"):
            data = data[1:]
        self.after_pre = False
        self._text(data, False)

    def _text(self, data: str, line_end: bool) -> None:
        if self.open[-1].tag == "head" and (line_end or data.strip(" \t\n\r\f")):
            self._close_to(len(self.open) - 1)
        top = self.open[-1]
        if not top.gone and not top.unseen:
            self.layout.text(data if top.pre or line_end else data.replace("\n", " "))

    def text(self) -> str:
        self._close_to(1)
        return self.layout.finish()


def rendered(html: str | None) -> str:
    tree = PageTree()
    tree.feed(html or "")
    tree.close()
    return tree.text()


def extract(pages: DataFrame, column: str = "html", *keep: str) -> DataFrame:
    """Columns ``keep`` and the visible ``text`` of every page.

    A null or empty page has the empty text, markup that breaks off is closed at its end, repeated
    rows are rendered alike, no pages give no rows, and columns that are not kept are not read.
    """
    rows = pages.select(*keep, F.col(column).alias("_fl_html"))
    schema = rows.drop("_fl_html").schema.add("text", "string")
    names = schema.names

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([rendered(h.as_py()) for h in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names)

    return rows.mapInArrow(render, schema)
