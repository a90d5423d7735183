import json
import os

import pytest
from pyspark.sql import functions as F

from faultline.operators import szz
from faultline.sources import datasets, files, history, issues


def test_log_file(spark, tmp_path):
    lines = [
        "h1|ann|2024-01-02 03:04:05 +0100|Fix a|b",
        "h2|bob|not a date|x",
        "h3|no subject",
        "h4|eve|2024-01-01 00:00:00 +0000|",
    ]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    got = history.read_commit_log(spark, str(tmp_path / "log.txt")).orderBy("log_pos").collect()
    assert [(r.commit_hash, r.subject) for r in got] == [("h1", "Fix a|b"), ("h4", "")]
    (tmp_path / "a.txt").write_text("".join(f"a{k}|x|2020-01-01 00:00:00 +0000|{'s' * 500}\n" for k in range(30)))
    both = history.read_commit_log(spark, str(tmp_path)).orderBy("log_pos").collect()
    assert [r.commit_hash for r in both] == [f"a{k}" for k in range(30)] + ["h1", "h4"]
    newest = history.commit_history(history.read_commit_log(spark, str(tmp_path)), since="2024-01-01 12:00:00")
    assert [r.commit_hash for r in newest.collect()] == ["h1"]


def test_issue_export(spark, tmp_path):
    full = {
        "key": "P-1",
        "fields": {
            "issuetype": {"name": "Bug"}, "summary": "Slow start", "status": {"name": "Done"}, "labels": ["x"],
            "components": [{"name": "core"}, {}], "created": "2024-01-02",
        },
    }
    (tmp_path / "issues.json").write_text(json.dumps(full) + "\n" + json.dumps({"key": "P-2", "fields": {}}))
    got = issues.read_issues(spark, str(tmp_path / "issues.json")).orderBy("key").collect()
    assert (got[0].issue_type, got[0].components, got[0].is_performance_issue) == ("Bug", ["core", ""], True)
    assert (got[1].issue_type, got[1].status, got[1].labels, got[1].summary) == ("Unknown", "Unknown", [], "")
    commits = spark.createDataFrame([("a", "see P-2, AB-9 and p1-1"), ("b", "docs"), ("c", "x_-1")], "commit_hash string, subject string")
    table = issues.read_issues(spark, str(tmp_path)).withColumn("key", F.when(F.col("key") == "P-1", "P1-1").otherwise(F.col("key")))
    assert [tuple(r) for r in issues.confirmed_commits(commits, table).collect()] == [("a", "P1-1")]
    strict = szz.identify_fixes(commits, table, strict=True).filter("is_bug_fix").collect()
    assert [(r.commit_hash, r.issue_key) for r in strict] == [("a", "P1-1")]


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text('file_path,added_lines,deleted_lines,is_bug_fix,commit_message,label\na.py,3,1,1,"two\nlines ""q""",BUGGY\nb.py,oops,inf,0,x,\n')
    df = datasets.read_labelled(spark, str(path))
    assert df.count() == 2 and df.first().commit_message == 'two\nlines "q"'
    clean, columns = datasets.prepare(df)
    assert columns == ["added_lines", "deleted_lines", "total_changes", "net_lines", "code_churn"]
    assert [tuple(r) for r in clean.collect()] == [(3.0, 1.0, 4.0, 2.0, 4.0, 1), (0.0, 0.0, 0.0, 0.0, 0.0, 0)]
    datasets.write_dataset(df, str(tmp_path / "out"))
    assert datasets.read_labelled(spark, str(tmp_path / "out"), format="parquet").count() == 2
    datasets.write_dataset(df, str(tmp_path / "csv"), "csv")
    assert datasets.read_labelled(spark, str(tmp_path / "csv")).filter("commit_message like '%lines%'").count() == 1
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        datasets.read_labelled(spark, str(tmp_path / "bad.csv"))


def test_aligned_union(spark):
    base = spark.createDataFrame([(1, "BUGGY")], "a int, label string")
    mined = spark.createDataFrame([("x",)], "file_path string")
    got = datasets.aligned_union(base, mined)
    assert got.columns == ["a", "file_path", "label"]
    assert sorted(tuple(r) for r in got.collect()) == [(0, "x", "CLEAN"), (1, "", "BUGGY")]


def test_size_warning(spark):
    for n, verdict in ((5, "very small"), (50, "small"), (200, "ok")):
        assert datasets.size_warning(spark.range(n)).first().verdict == verdict
    assert datasets.size_warning(spark.range(40), mined=True).first().verdict == "very small mined set"


def test_code_files(spark, tmp_path):
    os.makedirs(tmp_path / "sub")
    (tmp_path / "a.py").write_bytes("né = 1".encode("utf-8"))
    (tmp_path / "sub" / "b.py").write_bytes("né = 1".encode("latin-1"))
    (tmp_path / "empty.py").write_bytes(b"")
    got = {r.filename: r.content for r in files.read_code_files(spark, str(tmp_path), "*.py").collect()}
    assert got == {"a.py": "né = 1", "b.py": "né = 1"}


def test_union_of_commits_prefers_the_chosen(spark):
    chosen = spark.createDataFrame([("a", "x")], "commit_hash string, s string")
    recent = spark.createDataFrame([("a", "y"), ("b", "z")], "commit_hash string, s string")
    got = {r.commit_hash: r.s for r in history.union_commits(chosen, recent).collect()}
    assert got == {"a": "x", "b": "z"}


def test_serialized_defaults(spark):
    df = spark.createDataFrame([("abcdefgh", None, None, None)], "commit_hash string, author string, commit_ts timestamp, message string")
    row = history.serialized(df).first()
    assert (row.short_hash, row.author, row.message, row.date) == ("abcdefg", "Unknown", "No message", None)


def test_issue_search(spark):
    rows = [("A-1", "Bug", "Open", "2"), ("A-2", "Bug", "Open", "3"), ("B-1", "Bug", "Open", "4")]
    df = spark.createDataFrame(rows, "key string, issue_type string, status string, created string")
    assert [r.key for r in issues.search_issues(df, project="A").collect()] == ["A-2", "A-1"]
    assert [r.key for r in issues.search_issues(df, max_results=1).collect()] == ["B-1"]
    assert issues.search_issues(df).count() == 3


def test_search_returns_all_or_as_many_as_asked_for(spark):
    rows = [(f"P-{k}", "Bug", "Closed" if k % 2 else "Open", f"{k:04d}") for k in range(140)]
    df = spark.createDataFrame(rows, "key string, issue_type string, status string, created string")
    assert issues.search_issues(df, "P", "Bug", "Closed").count() == 70
    newest = issues.search_issues(df, "P", "Bug", "Closed", max_results=50).collect()
    assert [r.key for r in newest] == [f"P-{k}" for k in range(139, 39, -2)]
    assert issues.search_issues(df, "Q").count() == 0
