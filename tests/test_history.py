import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import diffs
from faultline.operators import process, szz
from faultline.operators.spread import hot_key_cuts, previous_row, running_sum
from faultline.plans import mining
from faultline.session import materialize
from faultline.sources import history


def changes(spark, rows):
    return spark.createDataFrame(
        rows, "file_path string, commit_hash string, commit_ts string, author string, added long, deleted long"
    ).withColumn("commit_ts", F.col("commit_ts").cast("timestamp"))


GOLDEN = [
    ("f", "h1", "2024-01-01", "ann", 10, 0),
    ("f", "h2", "2024-03-10", "bob", 4, 1),
    ("f", "h3", "2024-03-20", "ann", 2, 6),
]


def test_metrics_now(spark):
    row = process.metrics_now(changes(spark, GOLDEN), "2024-03-31").first()
    assert (row.churn, row.additions, row.deletions, row.net_churn, row.commit_count) == (13, 6, 7, -1, 2)
    assert (row.developer_count, row.most_active_developer) == (2, "ann")
    assert row.commit_frequency == pytest.approx(2 / 30) and row.commits_per_week == pytest.approx(2 / (30 / 7))
    assert (row.file_age_days, row.first_commit_hash) == (90, "h1")


def test_metrics_at_commits(spark):
    got = process.metrics_at_commits(changes(spark, GOLDEN)).orderBy("commit_second").collect()
    assert [r.churn_30d for r in got] == [10, 5, 13]
    assert [r.developer_count_90d for r in got] == [1, 2, 2]
    assert [r.file_age_days for r in got] == [0, 69, 79]


def random_changes(spark, seed, n=600):
    rng = random.Random(seed)
    start = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(n):
        # a third of all rows belong to one file, and many share a timestamp
        file = "hot" if i % 3 == 0 else f"f{rng.randint(0, 30)}"
        at = start + dt.timedelta(days=rng.randint(0, 400), seconds=rng.choice([0, 0, 5, 86399]))
        rows.append((file, f"{rng.getrandbits(40):010x}", str(at), rng.choice(["a", "b", "c", "", None]), rng.randint(0, 9), rng.randint(0, 9)))
    return rows


def brute_force(rows):
    out = {}
    parsed = [(f, dt.datetime.fromisoformat(t), a, x, d) for f, _, t, a, x, d in rows]
    for f, t, *_ in parsed:
        inside = [r for r in parsed if r[0] == f and t - dt.timedelta(days=30) <= r[1] <= t]
        active = {r[2] for r in parsed if r[0] == f and t - dt.timedelta(days=90) <= r[1] <= t and r[2]}
        first = min(r[1] for r in parsed if r[0] == f)
        out[f, int((t - dt.datetime(1970, 1, 1)).total_seconds())] = (
            sum(r[3] for r in inside), sum(r[4] for r in inside), len(inside), len(active), (t - first).days,
        )
    return out


@pytest.mark.parametrize("rows_per_bucket", [10**9, 20, 1])
def test_point_in_time_metrics_do_not_depend_on_buckets(spark, rows_per_bucket):
    rows = random_changes(spark, 3)
    got = process.metrics_at_commits(changes(spark, rows), rows_per_bucket=rows_per_bucket).collect()
    assert {
        (r.file_path, r.commit_second): (
            r.additions_30d, r.deletions_30d, r.commit_count_30d, r.developer_count_90d, r.file_age_days,
        )
        for r in got
    } == brute_force(rows)


@pytest.mark.parametrize("rows_per_bucket,written", [(10**9, ["seconds"]), (40, ["seconds", "entries"])])
def test_moves_are_written_only_for_long_histories(spark, monkeypatch, rows_per_bucket, written):
    names = []
    monkeypatch.setattr(process, "materialize", lambda df, name: names.append(name) or materialize(df, name))
    rows = random_changes(spark, 5, 300) + [("f", "h", "2020-02-01", who, 1, 0) for who in "abcd"]
    got = process.metrics_at_commits(changes(spark, rows), rows_per_bucket=rows_per_bucket)
    assert got.count() == got.select("file_path", "commit_second").distinct().count() == len(brute_force(rows))
    assert names == written


def test_running_sum_with_ties_and_null_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", None, "b"]), float(rng.randint(0, 20)), rng.randint(0, 5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, v int")
    assert hot_key_cuts(df, ["k"], "x", 50).count() == 3
    for bucket in (10**9, 50, 7, 1):
        got = running_sum(df, ["k"], "x", {"s": F.col("v")}, {"m": F.col("v")}, rows_per_bucket=bucket)
        wanted = {
            (k, x): (sum(c for a, b, c in rows if a == k and b <= x), min(c for a, b, c in rows if a == k and b <= x))
            for k, x, _ in rows
        }
        found = got.collect()
        assert len(found) == len(rows)
        assert {(r.k, r.x): (r.s, r.m) for r in found} == wanted


def test_previous_row_over_buckets(spark):
    rows = [("a" if i % 3 else "b", i // 4, f"{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x long, id string")
    wanted, last = {}, {}
    for k, x, i in sorted(rows, key=lambda r: (r[1], r[2])):
        wanted[i] = last.get(k)
        last[k] = i
    for bucket in (10**9, 30, 2):
        got = previous_row(df, ["k"], "x", ["id"], ["id"], rows_per_bucket=bucket).collect()
        assert {r.id: r.prev.id if r.prev else None for r in got} == wanted


def test_diff_lines(spark):
    text = "@@ -3,2 +3,2 @@\n-old\n+new\n ctx"
    headed = "--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@ x\n a\n-b\n+B\n@@ -10 +20 @@\n+n\n-o\n\\ No newline"
    df = spark.createDataFrame([(text,), (headed,), ("",), (None,)], "d string")
    literal = [r[0] for r in df.select(diffs.changed_lines_literal("d")).collect()]
    old = [r[0] for r in df.select(diffs.deleted_lines_old_side("d")).collect()]
    assert literal == [[4], [1, 2, 20], [], []]
    assert old == [[3], [2, 10], [], []]


def test_blame_text(spark):
    text = "\n".join(["a" * 40 + " (x)", "b" * 8 + " y", "^" + "c" * 7 + " z", "none", "", "d" * 12 + "\tq"])
    got = diffs.blame_lines(spark.createDataFrame([(1, text)], "k int, t string"), "t", ["k"])
    assert [(r.line_no, r.origin_hash) for r in got.orderBy("line_no").collect()] == [
        (1, "a" * 40), (2, "b" * 8), (3, "c" * 7), (4, "d" * 12),
    ]


def test_multiset_diff_ignores_order(spark):
    df = spark.createDataFrame([(1, "a\nb", "b\na"), (2, "", "a\nb"), (3, "a\na", "a")], "k int, b string, a string")
    got = diffs.multiset_line_diff(df, ["k"], "b", "a").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0), (2, 2, 0), (3, 0, 1)]


def test_tracing_through_blame(spark):
    rows = [("a", None, "start"), ("b", "a", "more"), ("p", "b", "even more"), ("f", "p", "Fix it")]
    commits = spark.createDataFrame(rows, "commit_hash string, parent_hash string, subject string")
    diff = "@@ -2,2 +2,1 @@\n-two\n-three\n+both"
    touched = spark.createDataFrame([("f", "x", diff), ("b", "x", diff)], "commit_hash string, file_path string, diff string")
    blame = spark.createDataFrame(
        [("x", "p", 1, "a"), ("x", "p", 2, "b"), ("x", "p", 3, "p")],
        "file_path string, at_commit string, line_no int, origin_hash string",
    )
    found = mining.analyze(commits, touched, blame)
    assert [r.inducing_hash for r in found.inducing.collect()] == ["b"]
    labels = {r.commit_hash: r.label for r in found.commits.collect()}
    assert labels == {"a": "CLEAN", "b": "BUGGY", "p": "CLEAN", "f": "CLEAN"}
    s = found.statistics.first()
    assert (s.total_commits, s.bug_fix_commits, s.bug_inducing_commits) == (4, 1, 1)
    assert (s.bug_fix_ratio, s.bug_inducing_ratio) == (0.25, 0.25)
    kept = mining.analyze(commits, touched, blame, exclude_parent=False)
    assert {r.inducing_hash for r in kept.inducing.collect()} == {"b", "p"}
    assert s.buggy_labeled + s.clean_labeled == s.total_commits


def test_previous_touch_over_buckets(spark):
    rows = [(f"{i * 7919 % 65536:08x}", "hot" if i % 2 else f"f{i % 5}", "2024-01-01" if i % 4 else f"2024-02-{i % 28 + 1:02d}") for i in range(300)]
    df = spark.createDataFrame(rows, "commit_hash string, file_path string, t string").withColumn("commit_ts", F.col("t").cast("timestamp"))
    plain = {tuple(r) for r in szz.previous_touch(df, ["file_path"]).collect()}
    cut = {tuple(r) for r in szz.previous_touch(df, ["file_path"], rows_per_bucket=9).collect()}
    last, wanted = {}, set()
    for h, f, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if f in last:
            wanted.add((h, f, last[f]))
        last[f] = h
    assert plain == cut == wanted


def test_commit_detail_pages_large_commits(spark):
    rows = [("c", f"f{i:03d}", i, "M", 1, 2) for i in range(25)]
    touched = spark.createDataFrame(rows, "commit_hash string, file_path string, pos int, change_type string, added long, deleted long")
    commits = spark.createDataFrame([("c",), ("empty",)], "commit_hash string")
    detail = history.commit_detail(commits, touched, files_per_page=10)
    assert detail.filter("commit_hash = 'c'").count() == 3
    assert history.changed_files(detail).count() == 25
    assert detail.filter("commit_hash = 'empty'").first().files == 0
    assert history.first_files(touched, 5).count() == 5


def test_versions(spark):
    rows = [("f", "v1", "2024-01-01", "one"), ("f", "v2", "2024-01-02", "two"), ("g", "v2", "2024-01-02", "gee")]
    versions = spark.createDataFrame(rows, "file_path string, commit_hash string, t string, content string").withColumn("commit_ts", F.col("t").cast("timestamp"))
    wanted = spark.createDataFrame([("f", "v1"), ("g", None), ("g", "v1")], "file_path string, commit_hash string")
    got = {(r.file_path, r.commit_hash): r.content for r in history.content_at(versions, wanted).collect()}
    assert got == {("f", "v1"): "one", ("g", "v2"): "gee"}
    wanted = wanted.unionByName(spark.createDataFrame([("none", None)], wanted.schema))
    kept = {(r.file_path, r.commit_hash): (r.content, r.found) for r in history.content_at(versions, wanted, "keep").collect()}
    assert kept == {
        ("f", "v1"): ("one", True), ("g", "v2"): ("gee", True), ("g", "v1"): (None, False), ("none", None): (None, False),
    }
    assert history.content_at(versions, wanted.limit(1), "error").count() == 1
    with pytest.raises(Exception, match="File (g|none) not found at commit"):
        history.content_at(versions, wanted, "error").collect()
    with pytest.raises(ValueError):
        history.content_at(versions, wanted, "other")
    pair = {r.file_path: (r.before, r.after) for r in history.before_after(versions, "v1", "v2").collect()}
    assert pair == {"f": ("one", "two"), "g": ("", "gee")}


def test_missing_sides_of_a_change(spark):
    commits = spark.createDataFrame([("c2", "c1", "2024-01-02"), ("c1", None, "2024-01-01")], "commit_hash string, parent_hash string, t string")
    commits = commits.withColumn("commit_ts", F.col("t").cast("timestamp"))
    touched = spark.createDataFrame([("c2", "old", 0), ("c2", "new", 1), ("c1", "old", 0)], "commit_hash string, file_path string, pos int")
    versions = spark.createDataFrame([("old", "c1", "1"), ("old", "c2", "2"), ("new", "c2", "n")], "file_path string, commit_hash string, content string")
    full = {(r.commit_hash, r.file_path): (r.before, r.after) for r in mining.change_texts(commits, touched, versions).collect()}
    assert full == {("c2", "old"): ("1", "2"), ("c2", "new"): ("", "n"), ("c1", "old"): ("", "1")}
    assert mining.change_texts(commits, touched, versions, compat=True).count() == 1


@pytest.mark.parametrize("function_level", [False, True])
def test_mining_end_to_end(spark, function_level):
    rows = [("c1", None, "start", 1), ("c2", "c1", "more", 2), ("c3", "c2", "other", 3), ("c4", "c3", "Fix it", 4)]
    commits = spark.createDataFrame(
        [(h, p, m, m, "ann", f"2024-01-0{d}") for h, p, m, d in rows],
        "commit_hash string, parent_hash string, subject string, message string, author string, t string",
    ).withColumn("commit_ts", F.col("t").cast("timestamp"))
    texts = {"c1": "x = 1", "c2": "x = 1\ny = 2", "c3": "x = 1\ny = 2\nz = 3", "c4": "x = 1\ny = 4\nz = 3"}
    versions = spark.createDataFrame([("a.py", h, t) for h, t in texts.items()], "file_path string, commit_hash string, content string")
    touched = spark.createDataFrame(
        [("a.py", h, 0, "@@ -2 +2 @@\n-y = 2\n+y = 4" if h == "c4" else "", 1, 0, "ann") for h in texts],
        "file_path string, commit_hash string, pos int, diff string, added long, deleted long, author string",
    ).join(commits.select("commit_hash", "commit_ts"), "commit_hash")
    blame = spark.createDataFrame([("a.py", "c3", 2, "c2")], "file_path string, at_commit string, line_no int, origin_hash string")
    data, found = mining.mine(
        commits, touched, versions, blame, function_level=function_level, with_process_metrics=True
    )
    got = {r.commit_hash: r for r in data.collect()}
    assert {h: r.label for h, r in got.items()} == {"c1": "CLEAN", "c2": "BUGGY", "c3": "CLEAN", "c4": "CLEAN"}
    assert (got["c4"].added_lines, got["c4"].deleted_lines, got["c4"].commit_count_30d) == (1.0, 1.0, 4)
    assert got["c1"].added_lines == 1.0 and found.statistics.first().bug_fix_commits == 1
    newest, _ = mining.mine(commits, touched, versions, blame, max_commits=2, function_level=function_level)
    assert {r.commit_hash for r in newest.collect()} == {"c3", "c4"}


def test_text_at_the_parent_may_be_stored_long_before(spark):
    """b.py changes in c1 and c3 only; c2 touches twelve other files."""
    hashes = ["c1", "c2", "c3"]
    commits = spark.createDataFrame(
        [(h, hashes[k - 1] if k else None, f"2024-01-0{k + 1}") for k, h in enumerate(hashes)],
        "commit_hash string, parent_hash string, t string",
    ).withColumn("commit_ts", F.col("t").cast("timestamp"))
    touched = spark.createDataFrame(
        [("c1", "b.py", 0), ("c3", "b.py", 0)] + [("c2", f"{k}.py", k) for k in range(12)],
        "commit_hash string, file_path string, pos int",
    )
    versions = spark.createDataFrame(
        [("b.py", "c1", "one"), ("b.py", "c3", "two")] + [(f"{k}.py", "c2", "new") for k in range(12)],
        "file_path string, commit_hash string, content string",
    )
    got = {(r.commit_hash, r.file_path): (r.before, r.after) for r in mining.change_texts(commits, touched, versions).collect()}
    assert len(got) == 14 and got["c3", "b.py"] == ("one", "two") and got["c1", "b.py"] == ("", "one")
    assert all(got["c2", f"{k}.py"] == ("", "new") for k in range(12))
    assert mining.change_texts(commits, touched, versions, files_per_commit=5).count() == 7
    cut = history.versions_before(touched, commits, versions, rows_per_bucket=1)
    assert [(r.commit_hash, r.before_hash) for r in cut.collect()] == [("c3", "c1")]


@pytest.mark.parametrize("unit", [None, ["file_path"]])
def test_mining_declared_tables(spark, unit):
    """File changes as declared have neither author nor time nor line numbers."""
    rows = [("c1", None, "start"), ("c2", "c1", "more"), ("c3", "c2", "other"), ("c4", "c3", "Fix it")]
    commits = spark.createDataFrame(
        [(h, p, m, m, "ann", f"2024-01-0{k + 1}") for k, (h, p, m) in enumerate(rows)],
        "commit_hash string, parent_hash string, subject string, message string, author string, t string",
    ).withColumn("commit_ts", F.col("t").cast("timestamp"))
    touched = spark.createDataFrame(
        [(h, "a.py", 0, "M", 1, 0, "") for h, _, _ in rows if h != "c3"],
        "commit_hash string, file_path string, pos int, change_type string, added int, deleted int, diff string",
    )
    versions = spark.createDataFrame([("a.py", h, f"x = {h}") for h, _, _ in rows], "file_path string, commit_hash string, content string")
    data, found = mining.mine(commits, touched, versions, with_process_metrics=True, unit=unit)
    got = {r.commit_hash: (r.label, r.commit_count_30d) for r in data.collect()}
    assert got == {"c1": ("CLEAN", 1), "c2": ("BUGGY", 2), "c4": ("CLEAN", 3)}
    assert found.inducing.first().file_path == "a.py"


def test_features_without_names_need_no_sort(spark):
    rows = [("f", "c1", "ann", "2024-01-01", 3, 1), ("f", "c2", "bob", "2024-01-05", 2, 2), ("g", "c2", "bob", "2024-01-05", 1, 0)]
    changes = spark.createDataFrame(rows, "file_path string, commit_hash string, author string, t string, added long, deleted long")
    changes = changes.withColumn("commit_ts", F.col("t").cast("timestamp")).drop("t")
    metrics = process.metrics_now(changes, "2024-01-11 00:00:00")
    features = process.as_features(metrics)
    assert {r.file_path: (r.churn_30d, r.developer_count_90d, r.file_age_days) for r in features.collect()} == {"f": (8, 2, 10), "g": (1, 1, 6)}
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    first = {r.file_path: (r.first_commit_hash, str(r.first_commit_ts)) for r in metrics.collect()}
    assert first == {"f": ("c1", "2024-01-01 00:00:00"), "g": ("c2", "2024-01-05 00:00:00")}


@pytest.mark.parametrize("names", [lambda i: f"{i * 7919 % 65536:08x}", lambda i: f"Rev-{i % 97}"])
def test_repeated_touches_leave_without_a_shuffle_of_their_own(spark, names):
    rng = random.Random(5)
    rows = [
        (names(rng.randint(0, 60)), rng.choice(["a", "b", None]), f"2024-01-0{rng.randint(1, 2)} 00:00:00{rng.choice(['', '.5'])}")
        for _ in range(300)
    ]
    df = spark.createDataFrame(rows * 2, "commit_hash string, file_path string, t string").withColumn("commit_ts", F.col("t").cast("timestamp"))
    last, wanted = {}, []
    head = lambda h: int(h[:6], 16) if h.startswith("0") or not h.startswith("R") else 0
    for h, f, t in sorted(set(rows), key=lambda r: (r[2][:19], head(r[0]), r[0], r[2])):
        if f in last:
            wanted.append((h, f, last[f]))
        last[f] = h
    for rows_per_bucket in (10**9, 9):
        found = szz.previous_touch(df, ["file_path"], rows_per_bucket)
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, wanted))
    plan = szz.previous_touch(df, ["file_path"])._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    fixes = spark.createDataFrame([(h, p) for h in sorted({r[0] for r in rows}) for p in (names(3), "A0")], "commit_hash string, parent_hash string")
    traced = szz.inducing_from_history(fixes, df, ["file_path"]).collect()
    assert sorted(map(str, (tuple(r) for r in traced))) == sorted(
        str((h, o, f)) for h, f, o in wanted for p in (names(3), "A0") if o != p
    )


def test_keys_are_counted_by_a_hash_first(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    counted = []
    original = type(df).filter
    try:
        type(df).filter = lambda self, condition: counted.append(1) or original(self, condition)
        assert hot_key_cuts(df, ["k"], "id", 100) is None
        assert len(counted) == 1
        assert hot_key_cuts(df, ["k"], "id", 99).count() == 10
    finally:
        type(df).filter = original
    assert all(".zstd." in f for f in materialize(df, "small").inputFiles())


def test_touches_with_hashes_as_bytes_keep_columns_of_their_commit(spark):
    rows = [(f"{i * 7919 % 251:06x}", rng_file, f"2024-01-{i % 9 + 1:02d}") for i in range(120) for rng_file in ("a", "b")[: 1 + i % 2]]
    df = spark.createDataFrame(rows * 2, "commit_hash string, file_path string, t string")
    df = df.withColumn("commit_ts", F.col("t").cast("timestamp")).withColumn("parents", F.when(F.col("commit_hash") > "000080", F.array("t")))
    plain = {tuple(r) for r in szz.previous_touch(df, ["file_path"]).collect()}
    table = materialize(df.withColumn("commit_hash", F.unhex("commit_hash")), "touches")
    got = szz.previous_touch(table, ["file_path"], kept=("parents",), written=True).collect()
    assert {(bytes(r.commit_hash).hex(), r.file_path, bytes(r.origin_hash).hex()) for r in got} == plain and len(got) == len(plain)
    assert all((r.parents is not None) == (bytes(r.commit_hash).hex() > "000080") for r in got)


def test_blame_is_asked_for_parents_of_fixes_only(spark, tmp_path):
    from faultline.plans import catalog

    orders = [(k, k % 3, "F" if k % 2 else "O", f"2001-01-{k % 28 + 1:02d}", "1") for k in range(1, 60)]
    lines = [(k * 7 % 60, k * 5 % 6, k % 3, 9.0, 0.1) for k in range(400)]
    for name, rows, layout in (
        ("orders", orders + orders[:9], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_orderpriority string"),
        ("lineitem", lines + lines[:50], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double"),
    ):
        spark.createDataFrame(rows, layout).write.parquet(f"{tmp_path}/{name}.parquet")
    # the trace through a blame of every commit
    commits, changes = catalog._history(spark, str(tmp_path))
    blame = szz.previous_touch(changes, ["file_path", "line_no"]).join(
        commits.select("commit_hash", F.col("parent_hash").alias("at_commit")), "commit_hash"
    )
    fixes = szz.identify_fixes(commits).filter("is_bug_fix")
    wanted = szz.inducing_lines(fixes, changes.select("commit_hash", "file_path", "line_no").distinct(), blame.drop("commit_hash"))
    asked, original = [], szz.inducing_lines
    try:
        szz.inducing_lines = lambda fixes, lines, blame: asked.append((fixes, lines, blame)) or original(fixes, lines, blame)
        got = catalog.QUERIES["inducing_lines_from_blame"](spark, str(tmp_path))
    finally:
        szz.inducing_lines = original
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count()
    fixed, looked_up, blamed = asked[0]
    assert looked_up.join(fixed, "commit_hash", "left_anti").isEmpty()
    assert blamed.join(fixed, blamed.at_commit == fixed.parent_hash, "left_anti").isEmpty()
