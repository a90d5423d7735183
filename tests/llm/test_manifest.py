"""The manifest against trees built in the open."""

import hashlib
import random
import zlib

import pytest

from faultline.llm.catalog import manifest_rows
from faultline.llm.manifest import build_manifest, height, position, postorder, siblings

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n = row
    return H(*map(shown, (doc_id, source, lang, n, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([H(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return out


def climb(tree, i, node):
    """Siblings and the folded root of place i."""
    proof = []
    for level in tree[:-1]:
        run = range(i - i % 3, min(i - i % 3 + 3, len(level)))
        proof += [level[k] for k in run if k != i]
        node = H(*(node if k == i else level[k] for k in run))
        i //= 3
    return proof, node


def brute(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        group = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        by_source[name] = group
        trees.append(levels([leaf(r, r[1]) for r in group]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(by_source[name]):
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            proof, subroot = climb(trees[k], i, leaf(row, text))
            upper, root = climb(top, k, subroot)
            good = top[-1][0]
            out.append((row[0], leaf(row, row[1]), trees[k][-1][0], good, H(*proof, *upper), root, root == good))
    return sorted(out, key=repr)


def some_rows(n, sources, seed=1):
    rng = random.Random(seed)
    return [
        (k, rng.choice(["", "a\nb", f"text {k}", f"é\n{k}", None]), rng.choice(["en", "", None]), rng.choice(sources), rng.choice([k, None]))
        for k in range(n)
    ]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 27, 28, 80, 81, 82])
def test_positions_and_siblings(n):
    leaves = [H(str(k)) for k in range(n)]
    tree = levels(leaves)
    top = height(n)
    assert top == len(tree) - 1
    log = postorder(leaves, top)
    assert len(log) == sum(map(len, tree))
    for level, nodes in enumerate(tree):
        assert [log[position(level, j, n, top)] for j in range(len(nodes))] == nodes
    for i, path in enumerate(siblings(log, n, top, [])):
        proof, root = climb(tree, i, leaves[i])
        assert [d for step in path for d in _cut(step["left"]) + _cut(step["right"])] == proof
        node = leaves[i]
        for step in path:
            node = H(step["left"], node, step["right"])
        assert node == root


def _cut(digests):
    return [digests[k : k + 64] for k in range(0, len(digests), 64)]


@pytest.mark.parametrize("reach", [1, 7])
@pytest.mark.parametrize("sources", [["a"], [None, "", "b", "é", "z", "B"], [f"s{k}" for k in range(60)]])
def test_rows_are_those_of_brute_force(spark, reach, sources):
    rows = some_rows(130, sources)
    rows += [(None, "no id", "en", sources[0], 5), (3, "again", "en", sources[0], 1), (3, "again", "en", sources[0], 1)]
    got = manifest_rows(spark.createDataFrame(rows, DOCUMENT).repartition(3).selectExpr("*", "1 AS leaf", "2 AS `a.b`", "3 AS tree"), reach)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == brute(rows)


def test_few_rows(spark):
    for rows in ([(5, "x\n", "en", "s", 2)], [(1, None, None, None, None), (2, "", None, None, None)]):
        got = manifest_rows(spark.createDataFrame(rows, DOCUMENT)).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)
    empty = spark.createDataFrame([], DOCUMENT)
    assert build_manifest(empty).root is None and manifest_rows(empty).count() == 0


def test_only_changed_texts_fail(spark):
    rows = [(k, f"line\n{k}" if k % 3 else f"line {k}", "en", "s", 6) for k in range(40)]
    for r in manifest_rows(spark.createDataFrame(rows, DOCUMENT)).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.doc_id % 3 != 0
        assert r.verified == (not changed)
