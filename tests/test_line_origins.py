"""Line maps and line origins against a walk through the versions, line by line."""

import random
import time
from functools import lru_cache

import pytest

from faultline.functions.line_maps import kept_lines, line_runs_of, text_lines
from faultline.operators import line_origins
from faultline.plans import mining

VERSION = "file_path string, commit_hash string, content string"
BEFORE = "commit_hash string, file_path string, before_hash string"


def edited(rng, lines):
    lines = list(lines)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(lines) + 1)
        if rng.random() < 0.5 and lines:
            del lines[at : at + rng.randrange(3)]
        else:
            lines[at:at] = [rng.choice(["", "}", "x = 1", f"n{rng.randrange(99)}"]) for _ in range(rng.randrange(3))]
    return lines


def test_runs_cover_both_sides_and_keep_equal_lines():
    rng = random.Random(3)
    for _ in range(300):
        before = [rng.choice("abcdef\n") * rng.randrange(3) for _ in range(rng.randrange(12))]
        before = text_lines("\n".join(before))
        after = edited(rng, before)
        kept = kept_lines(before, after)
        assert all(before[b] == after[a] for a, b in kept)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(kept, kept[1:]))
        old, new = "".join(x + "\n" for x in before), "".join(x + "\n" for x in after)
        runs = line_runs_of(old, new)
        assert sorted(a + i for a, _, n in runs for i in range(n) if a >= 0) == list(range(len(after)))
        assert sorted(b + i for _, b, n in runs for i in range(n) if b >= 0) == list(range(len(before)))
        assert sorted((a + i, b + i) for a, b, n in runs for i in range(n) if a >= 0 and b >= 0) == kept


def test_edits_are_found_where_they_are():
    assert line_runs_of("a\n\nb\n\nc\n", "\na\n\nb\n\nc\n") == [(0, -1, 1), (1, 0, 5)]
    assert line_runs_of("a\nb\nc\n", "a\nx\nc\n") == [(0, 0, 1), (1, -1, 1), (-1, 1, 1), (2, 2, 1)]
    assert line_runs_of(None, "a") == [(0, -1, 1)]
    assert line_runs_of("a", None) == [(-1, 0, 1)]
    assert line_runs_of("", None) == []


def test_long_texts_with_few_common_lines_end():
    started = time.monotonic()
    kept_lines([f"a{i % 7}" for i in range(100_000)], [f"a{i % 5}" for i in range(100_000)])
    kept_lines([f"a{i}" for i in range(100_000)], [f"a{100_000 - i}" for i in range(100_000)])
    assert time.monotonic() - started < 10


def history_of(seed, branches):
    """Versions of two files, each made from an earlier one, as (file, hash, content) and (hash, file, before)."""
    rng, versions, before = random.Random(seed), {}, []
    for f in "xy":
        names = []
        for k in range(14):
            name = f"c{k}"
            base = (rng.choice(names) if branches else names[-1]) if names and rng.random() < 0.9 else None
            lines = edited(rng, text_lines(versions[f, base])) if base else edited(rng, ["a", "b", "", "c"])
            versions[f, name] = "\n".join(lines)
            names.append(name)
            if base:
                before.append((name, f, base))
    return versions, before


def walked(versions, before):
    """Origins by following each line of each version back."""
    base = {(f, c): b for c, f, b in before}

    @lru_cache(None)
    def origin(f, c, line):
        b = base.get((f, c))
        if b is not None:
            kept = dict(kept_lines(text_lines(versions[f, b]), text_lines(versions[f, c])))
            if line in kept:
                return origin(f, b, kept[line])
        return c, line + 1

    return {(f, c, i + 1, *origin(f, c, i)) for (f, c), text in versions.items() for i in range(len(text_lines(text)))}


@pytest.mark.parametrize("seed, branches", [(1, False), (2, True)])
def test_origins(spark, seed, branches):
    versions, before = history_of(seed, branches)
    rows = [(f, c, t) for (f, c), t in versions.items()]
    runs = line_origins.version_runs(
        spark.createDataFrame(rows + rows[:3], VERSION).repartition(3), spark.createDataFrame(before, BEFORE)
    )
    got = [tuple(r) for r in line_origins.origins(runs).collect()]
    assert len(got) == len(set(got)) and set(got) == walked(versions, before)


def test_empty_and_circular_histories(spark):
    none = spark.createDataFrame([], VERSION)
    assert line_origins.origins(line_origins.version_runs(none, spark.createDataFrame([], BEFORE))).count() == 0
    lone = spark.createDataFrame([("f", "c", None), ("f", "d", "")], VERSION)
    assert line_origins.origins(line_origins.version_runs(lone, spark.createDataFrame([], BEFORE))).count() == 0
    same = spark.createDataFrame([("f", "c", "a"), ("f", "d", "a")], VERSION)
    circle = spark.createDataFrame([("c", "f", "d"), ("d", "f", "c")], BEFORE)
    with pytest.raises(ValueError, match="own predecessors"):
        line_origins.origins(line_origins.version_runs(same, circle))


@pytest.mark.parametrize("seed, branches, lines_per_file", [(2, True, 10_000), (4, True, 150)])
def test_lines_of_fixes_by_file_and_by_doubling(spark, monkeypatch, seed, branches, lines_per_file):
    versions, before = history_of(seed, branches)
    texts = spark.createDataFrame([(f, c, t) for (f, c), t in versions.items()], VERSION)
    runs = line_origins.version_runs(texts, spark.createDataFrame(before, BEFORE))
    lines, doubled = {}, line_origins.origins
    for r in runs.collect():
        lines[r.file_path] = lines.get(r.file_path, 0) + r.length
    seen = []
    monkeypatch.setattr(line_origins, "origins", lambda some: seen.extend(r[0] for r in some.select("file_path").distinct().collect()) or doubled(some))
    fixes = [(f"c{k}", "c3" if k % 4 else None) for k in range(2, 14)] + [("c5", "c3"), (None, "c3")]
    fixes = spark.createDataFrame(fixes, "commit_hash string, parent_hash string")
    got = line_origins.inducing_from_texts(fixes, runs, True, lines_per_file)
    origin = {(f, c, line): o for f, c, line, o, _ in walked(versions, before)}
    wanted = []
    for c, f, b in before:
        k = int(c[1:])
        if k >= 2 and k % 4:
            new = {p[1] for p in kept_lines(text_lines(versions[f, b]), text_lines(versions[f, c]))}
            gone = [i + 1 for i in range(len(text_lines(versions[f, b]))) if i not in new]
            wanted += [(c, origin[f, b, i], f, i) for i in gone if origin[f, b, i] != "c3"] * (2 if k == 5 else 1)
    assert wanted and sorted(tuple(r) for r in got.collect()) == sorted(wanted)
    assert set(seen) == {f for f, n in lines.items() if n > lines_per_file}


def test_lines_of_circular_versions_are_not_followed_for_ever(spark):
    circle = [("f", "c", "d", 0, 0, 1, None), ("f", "d", "c", 0, 0, 1, None)]
    for asked in ([("f", "e", "c", -1, 0, 1, "d")], []):
        with pytest.raises(ValueError, match="own predecessors"):
            list(line_origins.lines_traced(circle + asked))
    ends = [("f", "c", "d", 0, 1, 1, None), ("f", "d", "c", 0, 0, 1, None), ("f", "d", None, 1, -1, 1, None)]
    assert list(line_origins.lines_traced([*ends, ("f", "e", "d", -1, 0, 2, "x")])) == [("e", "d", 1, "x"), ("e", "d", 2, "x")]
    layout = "file_path string, commit_hash string, before_hash string, after_start int, before_start int, length int"
    runs = spark.createDataFrame([r[:6] for r in circle], layout)
    with pytest.raises(ValueError, match="own predecessors"):
        line_origins.inducing_from_texts(spark.createDataFrame([("e", "d")], "commit_hash string, parent_hash string"), runs)
    assert list(line_origins.lines_traced([("f", "e", "gone", -1, 0, 2, "d")])) == []


def test_mine_traces_through_texts(spark):
    """c2 fixes the line that c0 brought; the line of c1, its parent, does not count."""
    day = "2024-01-0"
    commits = spark.createDataFrame(
        [(f"c{i}", f"c{i - 1}" if i else None, "dev", day + str(i + 1), s, s) for i, s in enumerate(["add", "more", "fix bug"])],
        "commit_hash string, parent_hash string, author string, t string, subject string, message string",
    ).selectExpr("* except (t)", "to_timestamp(t) AS commit_ts")
    texts = ["a = 1\nb = 2\n", "n = 0\na = 1\nb = 2\n", "n = 9\na = 5\nb = 2\n"]
    versions = spark.createDataFrame([("f.py", f"c{i}", t) for i, t in enumerate(texts)], VERSION).join(
        commits.select("commit_hash", "commit_ts"), "commit_hash"
    )
    changes = versions.select("commit_hash", "file_path").selectExpr("*", "1 AS added", "1 AS deleted")
    dataset, analysis = mining.mine(commits, changes, versions, trace_texts=True)
    assert [tuple(r) for r in analysis.inducing.collect()] == [("c0", "c2", "f.py", 2)]
    assert {r.commit_hash: r.label for r in dataset.collect()} == {"c0": "BUGGY", "c1": "CLEAN", "c2": "CLEAN"}
