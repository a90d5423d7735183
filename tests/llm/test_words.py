"""Tokens, pieces, files of ids and packing against the libraries and brute force."""

import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from faultline.llm import id_files
from faultline.llm.common import documents as read_documents
from faultline.llm.id_files import IdReader, IdWriter, pack_block, store_ids, unpack_block
from faultline.llm.packing import fullest, pack, plan_bins
from faultline.llm.pieces import PieceCoder, encode_documents, occurrence_ranges, suffix_order
from faultline.llm.tokens import TextEncoder, encoder, vocabulary

ODD = [
    "", "a", "\n", "a\n", "  a b", " a", "a  b", "a\tb c", "it's a's B'LL", "x<|endoftext|>y z", "Σίσυφος ΟΔΟΣ b",
    "　a b", "a\x1cb c", "a b́ c", "İx Ǆ", "日本 語。a", "12 3,4 a1b2", "é É!!", "a\n\nb", "'s a", "a \nb",
    "…a 'tis", "THE,!! the.### $%& a|b", "\0a\0 b", "🎉 a</s>b <s>", "▁x ▁ y", "ab" * 3000, "word " * 5000,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    ours = TextEncoder(name, remembered=5)
    for text in ODD * 2:
        whole = ours.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == whole, text
    assert ours.encode(None) == b""


def test_pieces_are_those_of_the_library():
    ours = PieceCoder(remembered=3)
    for _ in range(2):
        for text, ids in zip(ODD, ours.encode(ODD)):
            assert np.frombuffer(ids, "<u4").tolist() == ours.library.encode(text), text
            assert ours.decode(ids) == text.replace("▁", " ")
    assert ours.encode([None]) == [b""]


@pytest.mark.parametrize("short", [0, 64])
def test_pieces_of_random_texts(monkeypatch, short):
    monkeypatch.setattr("faultline.llm.pieces.SHORT", short)
    ours, rng = PieceCoder(), random.Random(3)
    texts = ["".join(rng.choice("abcdehinorst   ,.\né日") for _ in range(rng.randrange(80))) for _ in range(400)]
    assert [np.frombuffer(i, "<u4").tolist() for i in ours.encode(texts)] == ours.library.encode(texts)


def test_suffixes_and_ranges():
    text = "banana\0bandana"
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    order = suffix_order(codes, 4)
    assert [text[i:][:4] for i in order] == sorted(text[i:][:4] for i in range(len(text)))
    patterns = ["an", "ana", "ban", "x", "a"]
    table = np.zeros((len(patterns), 4), np.uint32)
    for k, p in enumerate(patterns):
        table[k, : len(p)] = [ord(c) for c in p]
    first, last = occurrence_ranges(codes, order, table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, first, last):
        assert sorted(order[a:b]) == [i for i in range(len(text)) if text.startswith(p, i)]


def test_piece_query_rows(documents):
    rows = [(1, None), (2, ""), (3, "some text"), (3, "some text"), (None, "x")]
    got = {(r.doc_id, r.n_tokens, r.round_trip) for r in encode_documents(documents(rows)).collect()}
    n = len(PieceCoder().library.encode("some text"))
    assert got == {(1, 0, True), (2, 0, True), (3, n, True), (None, len(PieceCoder().library.encode("x")), True)}
    assert encode_documents(documents([])).count() == 0


def test_blocks_come_back():
    rng = np.random.default_rng(1)
    for ids in (
        np.array([7]), np.zeros(10), np.arange(100), rng.integers(0, 50_257, 8192),
        np.where(rng.random(5000) < 0.02, 2**32 - 1, rng.integers(5, 9, 5000)), np.array([0, 2**32 - 1]),
    ):
        ids = ids.astype("<u4")
        assert (unpack_block(pack_block(ids)) == ids).all()
    narrow = np.where(np.arange(8192) % 50 == 0, 40_000, 3).astype("<u4")
    assert len(pack_block(narrow)) < 8192 / 4


class _Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_file_lists_documents_and_finds_ranges():
    rng, out = np.random.default_rng(2), _Bytes()
    writer = IdWriter(out)
    texts = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 3, 20_000, 1, 8192, 5)]
    for k, ids in enumerate(texts):
        writer.add(None if k == 1 else k, ids.tobytes())
    writer.close()
    reader, every = IdReader(out), np.concatenate(texts)
    listed = list(reader.documents())
    assert [d[0] for d in listed] == [0, None, 2, 3, 4, 5]
    assert [d[3] for d in listed] == [zlib.crc32(t.tobytes()) for t in texts]
    for a, b in ((0, 0), (0, 1), (8190, 8195), (100, 25_000), (28_000, len(every))):
        assert (reader.ids(a, b) == every[a:b]).all()


def test_stored_ids(spark, documents, tmp_path):
    rows = [(5, "five words are in here"), (1, None), (3, ""), (3, "b"), (3, "b"), (None, "none"), (-2, "x" * 50_000)]
    got = store_ids(documents(rows, "1 AS start"), "byte_bpe_50k.json", str(tmp_path / "ids")).collect()
    ours, at = encoder("byte_bpe_50k.json"), 0
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -2, 1, 3, 3, 3, 5]
    texts = {(i, zlib.crc32(ours.encode(t) + b"\2\0\0\0")) for i, t in rows}
    for r in got:
        assert r.start == at and (r.doc_id, r.ids_crc32) in texts
        at += r.n_tokens
    assert sum(len(ours.encode(t)) // 4 + 1 for _, t in rows) == at
    assert store_ids(documents([]), "byte_bpe_50k.json").count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 30)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = fullest(counts, sorted(counts), room)
        assert all(n <= counts[length] for length, n in chosen.items())
        assert sum(length * n for length, n in chosen.items()) == max(s for s in sums if s <= room)


def test_bins_use_every_length_once():
    rng = random.Random(6)
    counts = {}
    for _ in range(3000):
        length = min(100, int(rng.lognormvariate(3, 1)) + 1)
        counts[length] = counts.get(length, 0) + 1
    used = {}
    bins = plan_bins(counts, 100)
    for chosen, times in bins:
        assert sum(length * n for length, n in chosen.items()) <= 100
        for length, n in chosen.items():
            used[length] = used.get(length, 0) + n * times
    assert used == counts
    total = sum(length * n for length, n in counts.items())
    assert sum(times for _, times in bins) <= -(-total // 100) + 1
    assert plan_bins({}) == []


def _check_packed(rows, got, capacity):
    ours, wanted = encoder("word_bpe_49k.json"), []
    for doc_id, text in rows:
        ids = ours.encode(text) + np.array([1], "<u4").tobytes()
        for k in range(0, len(ids), 4 * capacity):
            part = ids[k : k + 4 * capacity]
            wanted.append((doc_id, k // 4 // capacity, k // 4, len(part) // 4, zlib.crc32(part)))
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)[:5]) for r in got)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert not ends or max(ends.values()) <= capacity
    return len(ends), sum(r.length for r in got)


def test_packed_documents(documents):
    rng = random.Random(7)
    rows = [(k % 150, " ".join(rng.choice(["a", "tree", "grew"]) for _ in range(rng.randrange(90)))) for k in range(200)]
    rows += [(900, None), (901, ""), (None, "b"), (902, "c " * 500), (903, "same"), (903, "same")]
    got = pack(documents(rows, "1 AS offset"), "word_bpe_49k.json", 64).collect()
    bins, total = _check_packed(rows, got, 64)
    assert bins <= -(-total // 64) + 1
    assert pack(documents([]), "word_bpe_49k.json").count() == 0


def test_capacity_of_the_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = read_documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bins, total = _check_packed(rows, pack(docs, "word_bpe_49k.json").collect(), 4096)
    assert bins == -(-total // 4096)


def test_block_length_is_part_of_the_format():
    assert id_files.BLOCK == 8192


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_those_of_the_library(name):
    library, ours = Tokenizer.from_file(vocabulary(name)), TextEncoder(name, remembered=5)
    for text in ODD + [
        "see <|endoftext|> here", "<|endoftext|>", "a\n<|startoftext|>b", "<|ENDOFTEXT|> <|endof text|>",
        "x  <|endoftext|>\ny z", "<|endoftext|><|endoftext|> a <|startoftext|>",
    ]:
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == wanted, text
