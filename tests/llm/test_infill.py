"""Fill-in-the-middle against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from faultline.llm import infill
from faultline.llm.catalog import infill_digests
from faultline.llm.infill import Infill, LineIndex, chunk_ends, fill_in_middle, restored

MARKS = Infill().marks


def brute(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_text(rng):
    pieces = ["a line\n", "\n", "é日本\r\n", "word ", "🎉", "x" * 700, "<P", ">", "\0", "ends here.\n", "\x85", "<M"]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(120)))


def test_chunks_follow_content():
    rng = random.Random(1)
    shared = bytes(rng.randrange(256) for _ in range(20_000))
    a, b = (np.frombuffer(x, np.uint8) for x in (b"short" + shared, b"some other beginning" * 90 + shared))
    own = {bytes(a)[x:y] for x, y in zip([0, *chunk_ends(a)], chunk_ends(a))}
    other = {bytes(b)[x:y] for x, y in zip([0, *chunk_ends(b)], chunk_ends(b))}
    assert len(own & other) >= len(own) - 2 and len(own) > 20
    same = np.full(100_000, 65, np.uint8)
    assert chunk_ends(same)[-1] == 100_000 and max(np.diff([0, *chunk_ends(same)])) <= infill.LONGEST_CHUNK
    assert chunk_ends(np.zeros(0, np.uint8)) == []


def test_blocks_hash_like_the_whole(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 9000, dtype=np.uint8)
    whole = chunk_ends(data)
    monkeypatch.setattr(infill, "STEP", 100)
    assert chunk_ends(data) == whole


@pytest.mark.parametrize("step, bits, longest", [(1 << 20, 9, 4096), (50, 2, 7), (17, 1, 1)])
def test_lines_and_marks(monkeypatch, step, bits, longest):
    monkeypatch.setattr(infill, "STEP", step)
    monkeypatch.setattr(infill, "CUT_BITS", bits)
    monkeypatch.setattr(infill, "LONGEST_CHUNK", longest)
    rng, index = random.Random(3), LineIndex(MARKS, remembered=500)
    for _ in range(200):
        text = some_text(rng)
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        lines = index.read(text)
        assert lines.lines == len(units) and lines.marked == any(m in text for m in MARKS)
        for k in {0, 1, len(units) // 2, len(units)}:
            if k <= len(units):
                assert lines.chars_before(k) == len("".join(units[:k]))


def test_a_clash_of_hashes_is_seen(monkeypatch):
    monkeypatch.setattr(infill.xxhash, "xxh3_64_intdigest", lambda chunk: 1)
    index = LineIndex(MARKS)
    for text in ("a\nb", "ccc\n\n", "a\nb"):
        assert index.read(text).lines == len(re.findall(r"[^\n]*\n|[^\n]+", text))


def test_outputs_and_way_back(documents):
    rng = random.Random(4)
    rows = [(k, some_text(rng)) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "no end"), (204, "a<S>b"), (7, "twice\nx"), (7, "twice\nx"), (None, "a\nb\nc"), (205, "line of text\n" * 60_000)]
    df = fill_in_middle(documents(rows, "1 AS n"))
    got = df.select("*", restored(df.output, df.form).alias("back"), "doc_id").collect()
    assert sorted(map(repr, ((r[0], r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(
        map(repr, ((i, *brute(i, t)) for i, t in rows))
    )
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(documents([])).count() == 0


def test_rate_and_digests(documents):
    rows = [(k, f"{k}\nb\nc") for k in range(100)]
    got = {r.doc_id: r.form for r in fill_in_middle(documents(rows), Infill(rate=30)).collect()}
    assert got == {i: brute(i, t, 30)[1] for i, t in rows}
    for r in infill_digests(documents(rows)).collect():
        text = rows[r.doc_id][1]
        assert r.output_sha256 == hashlib.sha256(brute(r.doc_id, text)[4].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
