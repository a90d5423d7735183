"""The page renderer against one that works on an explicit tree, and its time on odd pages."""

import random
import re
import time

import pytest

from faultline.llm.html_text import BOUND, SPACED, Cell, Layout, PageTree, grid, rendered


class Recorder:
    """Takes the calls of a layout and keeps the tree."""

    def __init__(self):
        self.root = {"tag": "", "pre": False, "kids": []}
        self.stack = [self.root]

    def open(self, tag, pre, start=None, span=(1, 1)):
        node = {"tag": tag, "pre": pre, "start": start, "span": span, "kids": []}
        self.stack[-1]["kids"].append(node)
        self.stack.append(node)

    def close(self):
        self.stack.pop()

    def text(self, data):
        self.stack[-1]["kids"].append(data)

    def rule(self):
        self.stack[-1]["kids"].append(None)

    def finish(self):
        return self.root


def naive_grid(rows):
    taken, placed = set(), []
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in taken:
                c += 1
            taken |= {(r + i, c + j) for i in range(min(cell.rows, len(rows) - r)) for j in range(cell.columns)}
            placed.append((r, c, cell))
            c += cell.columns
    width = {c: 0 for _, c in taken}
    for _, c, cell in placed:
        if cell.columns == 1 and len(cell.text) <= BOUND:
            width[c] = max(width[c], len(cell.text))

    def room(c, n):
        return sum(width[c + j] for j in range(n)) + 2 * (n - 1)

    for _, c, cell in placed:
        if cell.columns > 1 and len(cell.text) <= BOUND:
            width[c + cell.columns - 1] += max(0, len(cell.text) - room(c, cell.columns))
    lines = []
    for r, row in enumerate(rows):
        here, line, out = [(c, cell) for q, c, cell in placed if q == r], "", []
        for c, cell in here:
            start = sum(width[j] + 2 for j in range(c))
            if (c, cell) != here[-1] and len(cell.text) > room(c, cell.columns):
                out += [line, " " * start + cell.text]
                line = ""
            else:
                line = line + " " * (start - len(line)) + cell.text
        out = [x.rstrip() for x in [*out, line]]
        lines += [x for x in out if x] or ([] if any(cell.text for _, cell in here) else [""])
    return lines


def naive_lines(node, up=None):
    """Lines of a block; rows and cells it passes up are put on the nodes."""
    lines, run, number = [], [], 1
    rows = node["rows"] = []
    if node["tag"] == "ol" and node["start"] is not None:
        number = node["start"]

    def flush():
        if run:
            for line in "".join(run).split("\n"):
                line = line.rstrip() if node["pre"] else re.sub(r"[ \t\n\r\f]+", " ", line).strip()
                if line or node["pre"]:
                    lines.append(line)
            run.clear()

    def gap():
        if lines and lines[-1]:
            lines.append("")

    for kid in node["kids"]:
        if isinstance(kid, str):
            run.append(kid)
            continue
        flush()
        if kid is None:
            gap()
            continue
        tag, mark = kid["tag"], "- "
        inner = naive_lines(kid, node)
        while inner and not inner[-1]:
            inner.pop()
        if tag in ("td", "th") and node["tag"] == "tr":
            rows.append(Cell(" ".join(x.strip() for x in inner if x.strip()), *kid["span"]))
            continue
        if tag == "tr" and kid["rows"]:
            rows.append(kid["rows"])
        elif tag in ("thead", "tbody", "tfoot"):
            rows += kid["rows"]
        if tag == "li" and node["tag"] == "ol":
            number = number if kid["start"] is None else kid["start"]
            mark, number = f"{number}. ", number + 1
        if not inner:
            continue
        if tag == "li":
            inner = [(mark if k == 0 else " " * len(mark)) + x if x or k == 0 else "" for k, x in enumerate(inner)]
        elif tag == "blockquote":
            inner = ["> " + x for x in inner]
        elif tag == "dd":
            inner = ["    " + x if x or k == 0 else "" for k, x in enumerate(inner)]
        spaced = tag in SPACED and not (tag in ("ul", "ol") and node["tag"] == "li")
        if spaced:
            gap()
        lines += inner
        if spaced:
            gap()
    flush()
    if rows and node["tag"] not in ("tr", "thead", "tbody", "tfoot"):
        lines += naive_grid(rows)
    return lines


def naive(html):
    tree = PageTree(Recorder())
    tree.feed(html)
    tree.close()
    lines = naive_lines(tree.text())
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


TAGS = "p div ul ol li li table tr td th td b i span h2 pre blockquote dl dt dd section br hr a caption tbody thead select option dialog".split()
ATTRS = ["", "", "", "", " hidden", " colspan=2", " rowspan=2", " rowspan=0", " start=7", " value=3", " style='visibility:hidden'", " style='visibility: visible'", " open"]


@pytest.mark.parametrize("seed", range(8))
def test_random_markup(seed):
    rng = random.Random(seed)
    for _ in range(150):
        parts = []
        for k in range(rng.randrange(60)):
            tag = rng.choice(TAGS)
            parts.append(f"</{tag}>" if rng.random() < 0.35 else f"<{tag}{rng.choice(ATTRS)}>")
            parts.append(rng.choice(["", " ", "\n", f" w{k} ", f"w{k}\n\n  x", "long" * 15]))
        html = "".join(parts)
        assert rendered(html) == naive(html), html


def test_tables_of_random_spans():
    rng = random.Random(5)
    for _ in range(400):
        rows = [
            [Cell("x" * rng.choice([0, 1, 3, 9, 40, 41, 60]), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2, 3])) for _ in range(rng.randrange(1, 5))]
            for _ in range(rng.randrange(1, 6))
        ]
        assert grid(rows) == naive_grid(rows)


def test_many_columns_lose_nothing():
    row = [Cell(f"c{k}") for k in range(100)]
    assert grid([row])[0].split() == [c.text for c in row]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<table><tr><td colspan=2>both<td>c<tr><td>a<td>bb<td>d</table>", "both   c\na  bb  d"),
        ("<table><tr><td rowspan=2>tall<td>b<tr><td>c</table>", "tall  b\n      c"),
        ("<table><tr><td rowspan=0>t<td>b<tr><td>c<tr><td>d</table>", "t  b\n   c\n   d"),
        ("<table><tr><td>a<td>" + "w" * 41 + "<td>z<tr><td>b<td>c<td>d</table>", "a\n   " + "w" * 41 + "\n      z\nb  c  d"),
        ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
        ("<ol start=x><li>a</ol>", "1. a"),
        ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b></div>", "yes"),
        ("<div style='display:none'>no <b style='visibility:visible'>no</b></div>y", "y"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("a<datalist><option>no</datalist><noframes>no</noframes><noembed>no</noembed>b", "ab"),
        ("<ruby>kan<rp>(</rp><rt>ji</rt><rp>)</rp></ruby>", "kanji"),
        ("<pre>\nfirst\n\n\nlast\n\n</pre>x", "first\n\n\nlast\n\nx"),
        ("<b style='color:red; display:NONE !important'>no</b>y", "y"),
    ],
)
def test_spans_numbers_and_visibility(html, text):
    assert rendered(html) == text


@pytest.mark.parametrize(
    "html",
    [
        "<b>" * 20_000 + "x" + "</i>" * 20_000,
        "<b><p>" * 10_000 + "x" + "</b>" * 10_000,
        "<ul><li>" * 20_000 + "x",
        "<blockquote>" * 20_000 + "x" + "</blockquote>" * 20_000,
        "<table><tr><td>" * 5_000 + "x",
        "<div hidden>" * 20_000 + "x" + "</div>" * 20_000 + "y",
        "<p>some words of text <b>bold</b> and <i>more</i></p>\n" * 16_000,
        "<table>" + "<tr><td rowspan=60000>a<td>b<td>c" * 6_000,
        "<ol>" + "<li>item</b></u>" * 30_000,
    ],
)
def test_time_grows_with_the_page(html):
    began = time.process_time()
    rendered(html)
    assert time.process_time() - began < 2.0  # under a second on an idle machine


def test_text_below_the_deepest_level_stays():
    assert rendered("<div>" * 600 + "x" + "</div>" * 600 + "y") == "x\ny"
    assert rendered("<div>" * 511 + "<p hidden><b>no<b>no") == ""
    assert isinstance(PageTree().layout, Layout)
