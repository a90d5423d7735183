"""Byte-pair coding against the library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from faultline.llm.byte_pairs import ByteCoder, MinimalPerfectHash, coder, decoded, encoded, splitter
from faultline.llm.catalog import byte_pair_digests
from faultline.llm.tokens import vocabulary

ODD = [
    "", " ", "a", "\n", "a\n", "  a b", " a", "a  b ", "a\tb c", "it's a's B'LL 'tis", "x<|endoftext|>y z", "a\x1cb c",
    "　a b", "a　\n\nb", "a   \n b", "a\x85 b", "日本 語。a", "12 3,4 a1b2 ½ Ⅷ", "é É!!", "a\n\n\nb", "a \r\n  b",
    "THE,!! the.### $%& a|b", "\0a\0 b", "🎉 a</s>b <s>👩‍👩‍👧", "ab" * 3000, "x" * 20_000, "word " * 5000, " " * 3000 + "b",
    "ꟑ \U000323b0b ࢏1", "Привет, мир", "שלום עולם", "नमस्ते दुनिया", "a\x0b\x0cb",
]


@pytest.fixture(scope="module")
def library():
    with open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(library, texts, remembered=300_000):
    ours = ByteCoder(remembered=remembered)
    for _ in range(2):
        for text, ids in zip(texts, ours.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:60]
            assert ours.decode(ids) == text.encode()
    return ours


def test_ids_are_those_of_the_library(library):
    ours = same(library, ODD, remembered=3)
    assert ours.encode([None]) == [b""] and ours.encode([]) == []


def test_random_texts(library):
    rng = random.Random(3)
    letters = "abcdehinorst   ,.\n\té日' 　\r1"
    same(library, ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500)])
    spread = ["".join(chr(rng.choice([rng.randrange(0x3000), rng.randrange(0xE000, 0x110000), 32, 97])) for _ in range(40)) for _ in range(400)]
    same(library, spread)


def test_pattern_has_the_classes_of_the_library():
    split = splitter(public_tokenizers.PATTERN)
    single = {bytes([b]): b for b in range(256)}
    letters = tiktoken.Encoding("l", pat_str=r"\p{L}", mergeable_ranks=single, special_tokens={})
    for c in [*range(0x250, 0x3000), *range(0x16E00, 0x17000), *range(0x32300, 0x32400)]:
        is_letter = bool(letters.encode_ordinary(chr(c)))
        assert (split.findall("a" + chr(c)) == ["a" + chr(c)]) == is_letter, hex(c)


def test_hash_is_perfect_and_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        table = MinimalPerfectHash(hashes)
        assert sorted(table.numbers(hashes)) == list(range(len(hashes))) and table.size == len(hashes)
    strangers = table.numbers(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert strangers.min() >= -1 and strangers.max() < table.size
    with pytest.raises(ValueError):
        MinimalPerfectHash(np.array([5, 5], np.uint64))


def test_whole_tokens_need_no_merging(monkeypatch, library):
    ours = ByteCoder()
    monkeypatch.setattr(ours, "merge", lambda piece: pytest.fail(f"{piece} is a token"))
    assert np.frombuffer(ours.encode(["the of and"])[0], "<u4").tolist() == library.encode_ordinary("the of and")


def test_rows(documents, library):
    rows = [(1, None), (2, ""), (3, "some text"), (3, "some text"), (None, "x"), (4, "long " * 30_000)]
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_pair_digests(documents(rows, "1 AS ids")).collect())
    want = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        digests = (hashlib.sha256(b).hexdigest() for b in (np.array(ids, "<u4").tobytes(), (text or "").encode()))
        want.append((doc_id or 0, len(ids), *digests))
    assert got == sorted(want)
    assert byte_pair_digests(documents([])).count() == 0
    back = decoded(encoded(documents(rows))).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert coder("byte_bpe_multi_50k.tiktoken") is coder("byte_bpe_multi_50k.tiktoken")


def test_units_are_split_once_for_all_batches(library):
    texts = ["some words here", "some words here again", "w" * 100]

    def split_of(remembered):
        ours, seen = ByteCoder(remembered=remembered), []
        split = ours.split

        class Counted:
            def findall(self, unit):
                seen.append(unit)
                return split.findall(unit)

        ours.split = Counted()
        for text in texts * 2:
            assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
            assert all(len(unit) <= 64 for unit in ours.coded)
        return sorted(seen)

    # long units are not remembered; beyond the bound all are forgotten
    assert split_of(100) == [" again", " here", " words", "some", "w" * 100, "w" * 100]
    assert split_of(4).count("some") == 2
