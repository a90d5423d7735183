"""Page text and quotation linking against expected layouts and brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from faultline.llm import catalog
from faultline.llm.html_text import extract, rendered
from faultline.llm.quotes import link_quotes

MESSAGE = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("a<br>b<br/>c", "a\nb\nc"),
        ("<p>a<p>b &amp; c &eacute;&#33;", "a\n\nb & c é!"),
        ("<title>t</title><style>s{}</style><script>var a='<p>x</p>';</script><p>x", "x"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("a<span hidden>b</span><i style='color:red; DISPLAY : none'>c</i><b style='visibility:hidden'>d</b>e", "ae"),
        ("<div hidden><p>a<ul><li>b</ul></div>c", "c"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul><ol><li>x<li>y<p>z</ol>", "- a\n- b\n  - c\n\n1. x\n2. y\n\n   z"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b<td>22</table>", "Name       N\nlong name  1\nb          22"),
        ("<table><caption>cap</caption><thead><tr><td>a<tbody><tr><td>b<td>c</table>d", "cap\na\nb  c\n\nd"),
        ("<table><td>no row<td>x</table>", "no row  x"),
        ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
        ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"),
        ("<blockquote>q<p>r</blockquote>", "> q\n> \n> r"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n    d\nu"),
        ("</p></div>stray</b> ends<p>x</span>y", "stray ends\n\nxy"),
        ("<!-- c --><p>a<!-- d -->b<hr>c", "ab\n\nc"),
        ("<b>bold<p>next", "bold\n\nnext"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("a<noscript>b</noscript><template><p>c</template>d", "ad"),
        ("<body><h1>T</h1>x<section><h2>U</h2><p>y</section>", "T\n\nx\n\nU\n\ny"),
    ],
)
def test_layout(html, text):
    assert rendered(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body>a<svg width=1 /> b<p>c</body>", "a b\n\nc"),
        ("<div>a<math/>b</div>c", "ab\nc"),
        ("a<svg><svg/><title/><path d='M'/>in</svg>b", "ab"),
        ("<html><head><title>t</title>first<p>second", "first\n\nsecond"),
        ("<head><title>t</title> \n <style>s</style>x <b>y</b>", "x y"),
        ("<head><meta charset=u><br>x", "x"),
        ("<head><title>t</title></head> x", "x"),
    ],
)
def test_layout_behind_foreign_elements_and_open_heads(html, text):
    assert rendered(html) == text


def test_deep_and_long_pages_end():
    assert rendered("<div>" * 20_000 + "x") == "x"
    assert rendered("<b>" * 20_000 + "x") == "x"
    assert rendered("<p>a" * 20_000).count("a") == 20_000
    assert len(rendered("<table>" + "<tr><td>" + "w" * 100_000 + "<td>x" + "<tr><td>y<td>z" * 3000)) < 400_000


def test_no_visible_word_is_lost_or_invented():
    rng = random.Random(3)
    tags = "p div ul li ol table tr td th b i span h2 pre blockquote dl dt dd section br a".split()
    for _ in range(300):
        words, parts = [], []
        for k in range(30):
            parts.append(f"<{rng.choice('  /').strip()}{rng.choice(tags)}>")
            words.append(f"w{k}")
            parts.append(f" w{k} ")
        assert Counter(re.findall(r"w\d+", rendered("".join(parts)))) == Counter(words)


def test_pages(spark):
    rows = [(1, "<p>a", "t"), (1, "<p>a", "t"), (None, "b", None), (2, None, "x"), (3, "<p>" + "long " * 50_000, "y")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = extract(pages, "html", "page_id").collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter((i, rendered(h)) for i, h, _ in rows)
    assert extract(pages.limit(0), "html", "page_id").count() == 0
    every = catalog.QUERIES["op9_html_extraction"](spark, "/root/testdata/sf0.001")
    assert every.filter("length(text) > 0").count() > 0.9 * every.count()


def _linked(rows):
    """What link_quotes should give, message by message."""
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()).strip(" ")
    parsed = []
    for conv, turn, role, text in rows:
        lines = []
        for line in (text or "").split("\n"):
            marks = re.match(r"(?:[ \t]*>)*", line)[0]
            lines.append((marks.count(">"), line[len(marks) :]))
        runs = []
        for depth, words in lines:
            if runs and runs[-1][0] == depth:
                runs[-1][1].append(words)
            else:
                runs.append((depth, [words]))
        runs = [(d, "\n".join(w)) for d, w in runs]
        body = "\n".join(w for d, w in lines if d == 0)
        units = {plain(u) for u in [body, *(t for d, t in runs if d == 0), *(w for d, w in lines if d == 0)]} - {""}
        quotes = [(d, plain(t)) for d, t in runs if d > 0 and plain(t)]
        parsed.append((conv, turn, role, re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", body), units, quotes))
    first = {}
    for conv, turn, _, _, units, _ in parsed:
        for u in units:
            if turn is not None and turn < first.get((conv, u), 10**9):
                first[conv, u] = turn
    out, threads = {}, {}
    for conv, turn, role, body, _, quotes in sorted(parsed, key=lambda m: (repr(m[0]), m[1] if m[1] is not None else -1)):
        found = [(d, first[conv, q]) for d, q in quotes if turn is not None and first.get((conv, q), 10**9) < turn]
        parent = max((t for d, t in found if d == 1), default=-1)
        threads[conv, turn] = threads[conv, parent] if parent >= 0 else turn if turn is not None else -1
        out[conv, turn] = (parent, len(quotes), len(found), body, role)
    return out, threads


def test_quotations(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(25):
            own = [f"line {rng.randrange(12)} of  {conv}", "", "thanks"][: rng.randrange(1, 4)]
            quoted = []
            for depth in (2, 1):
                if said and rng.random() < 0.6:
                    quoted += [" >" * depth + rng.choice([" ", ""]) + x.upper() for x in rng.choice(said)]
            text = "\n".join([*quoted, *own] if rng.random() < 0.7 else [*own, *quoted, "below"])
            said.append(own)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    rows += [(90, 0, "user", "alone"), (91, 0, None, None), (91, 1, "user", ">"), (91, 2, "user", "> " * 40 + "deep"), (92, 3, "user", "> never said\nx")]
    rows += [(93, 0, "user", "x " * 60_000), (93, 1, "user", "> " + "x " * 60_000 + "\nyes")]
    rows += [(None, 0, "user", "no conversation"), (None, 1, "user", "> no conversation\nanswer"), (94, None, "user", "x"), (94, 1, "user", "> x\ny")]
    got = link_quotes(spark.createDataFrame(rows, MESSAGE).selectExpr("*", "1 AS position").repartition(4)).collect()
    wanted, threads = _linked(rows)
    assert len(got) == len(rows)
    for r in got:
        parent, n_quotes, n_linked, body, role = wanted[r.conv_id, r.turn]
        assert (r.parent_turn, r.n_quotes, r.n_linked, r.body, r.role) == (parent, n_quotes, n_linked, body, role), r
        assert r.chat == f"<|im_start|>{role or 'user'}\n{body}<|im_end|>"
    by_conv = defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        by_conv[r.conv_id].append(r)
    for conv, messages in by_conv.items():
        assert [r.position for r in messages] == list(range(len(messages)))
        order = [(threads[conv, r.turn], r.turn if r.turn is not None else -1) for r in messages]
        assert order == sorted(order)
    assert link_quotes(spark.createDataFrame([], MESSAGE)).count() == 0


def test_repeated_messages_all_stay(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "user", "> a\nb"), (1, 1, "user", "> a\nb")]
    got = link_quotes(spark.createDataFrame(rows, MESSAGE)).collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3]
    assert sorted(r.parent_turn for r in got) == [-1, -1, 0, 0]


def test_trimmed_quotations(spark):
    """Several lines out of a message are linked to the first message that has them one after another."""
    five = "first point\nsecond point\n\nthird  Point\nfourth point\nfifth point"
    rows = [
        (1, 0, "user", five),
        (1, 1, "user", "> SECOND point\n> third point\nagreed"),
        (1, 2, "user", ">> second point\n>> third point\n> agreed\nme too"),
        (1, 3, "user", "> second point\n> fourth point\nno such lines"),
        (1, 4, "user", "> fourth point\n>\n> fifth point\n> sixth point\nmore than it has"),
        (1, 5, "user", "> third point\n> fourth point\n> fifth point\nto the end"),
        (2, 0, "user", "> second point\n> third point\nanother conversation"),
        (2, 1, "user", "a\nb\na\nb\nc"),
        (2, 2, "user", "> a\n> b\n> c\nin the second place"),
        (2, 3, "user", "b\nc"),
        (2, 4, "user", "> b\n> c\nwhole beats lines"),
        (3, 0, "user", "> later one\n> later two\nquotes what comes after"),
        (3, 1, "user", "later one\nlater two\nend"),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, MESSAGE).repartition(3), trimmed=True).collect()}
    parents = {k: r.parent_turn for k, r in got.items()}
    assert parents == {
        (1, 0): -1, (1, 1): 0, (1, 2): 1, (1, 3): -1, (1, 4): -1, (1, 5): 0,
        (2, 0): -1, (2, 1): -1, (2, 2): 1, (2, 3): -1, (2, 4): 3, (3, 0): -1, (3, 1): -1,
    }
    assert got[1, 2].n_quotes == got[1, 2].n_linked == 2
    assert [got[1, t].position for t in range(6)] == [0, 1, 2, 4, 5, 3]


def test_trimmed_quotations_of_random_messages(spark):
    rng = random.Random(9)
    rows, wanted = [], {}
    for conv in range(4):
        said = []
        for turn in range(30):
            own = [f"w{rng.randrange(5)}" for _ in range(rng.randrange(2, 7))]
            rows.append((conv, turn, "user", "\n".join(own)))
            parent = -1
            if said and turn % 2:
                source = rng.choice(said)
                a = rng.randrange(len(source) - 1)
                part = source[a : rng.randrange(a + 2, len(source) + 1)]
                rows[-1] = (conv, turn, "user", "\n".join([*("> " + x for x in part), *own]))
                whole = [t for t, x in enumerate(said) if x == part]
                lines = [t for t, x in enumerate(said) if any(x[k : k + len(part)] == part for k in range(len(x)))]
                parent = (whole or lines)[0]
            said.append(own)
            wanted[conv, turn] = parent
    got = link_quotes(spark.createDataFrame(rows, MESSAGE).repartition(3), trimmed=True).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in got} == wanted
