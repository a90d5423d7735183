"""An index of digests that outlives its table, its session and a failed job; odd column names in the stages."""

import pytest

import corpus_pipeline
from faultline.llm.digest_index import DigestIndex, deduplicate


def kept(df):
    return sorted(r.doc_id for r in df.collect() if r.kept)


@pytest.fixture
def place(spark, tmp_path):
    return str(tmp_path / "index")


def test_the_files_are_the_index(spark, documents, place):
    with DigestIndex(spark, place, buckets=3) as index:
        assert kept(deduplicate(documents([(k, f"text {k}") for k in range(50)]), index)) == list(range(50))
        table = index.table
    assert not spark.catalog.tableExists(table)
    again = DigestIndex(spark, place)
    assert again.known().count() == 50 and again.buckets == 3
    assert kept(deduplicate(documents([(60, "text 7"), (61, "other")]), again)) == [61]
    assert DigestIndex(spark, place).known().count() == 51


def test_another_session_keeps_the_layout(spark, documents, place):
    DigestIndex(spark, place, buckets=5).add(spark.createDataFrame([("d", 1)], "digest string, keep_id long"), "b")
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "9")
    index = DigestIndex(other, place)
    assert index.buckets == 5 and index.known().count() == 1
    index.close()
    assert DigestIndex(spark, place).known().count() == 1
    with pytest.raises(ValueError, match="5 buckets"):
        DigestIndex(spark, place, buckets=9)


def test_unknown_layouts_are_refused(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "files"))
    with pytest.raises(ValueError, match="no digest index"):
        DigestIndex(spark, str(tmp_path / "files"))
    spark.createDataFrame([(9, 4)], "version int, buckets int").coalesce(1).write.json(str(tmp_path / "new" / "layout"))
    with pytest.raises(ValueError, match="layout 1"):
        DigestIndex(spark, str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "files")).count() == 3


def test_a_repeated_batch_gives_the_same_rows(spark, documents, place):
    index = DigestIndex(spark, place, buckets=2)
    deduplicate(documents([(1, "a")]), index, "monday")
    rows = documents([(2, "a"), (3, "b"), (4, "b"), (5, None), (4, "b")])
    first = sorted(map(tuple, deduplicate(rows, index, "tuesday").collect()))
    assert sorted(map(tuple, deduplicate(rows, index, "tuesday").collect())) == first
    assert sorted(r[0] for r in first if r[3]) == [4, 5] and index.known().count() == 3
    assert kept(deduplicate(rows, index, "wednesday")) == []


def test_half_an_append_is_completed(spark, documents, place):
    index = DigestIndex(spark, place, buckets=2)
    rows = documents([(k, f"t{k}") for k in range(20)])
    whole = sorted(map(tuple, deduplicate(rows, DigestIndex(spark, place + "-other"), "b").collect()))
    deduplicate(rows.filter("doc_id < 7"), index, "b")
    assert sorted(map(tuple, deduplicate(rows, index, "b").collect())) == whole
    assert index.known().count() == 20


def test_the_index_is_not_shuffled(spark, place):
    index = DigestIndex(spark, place, buckets=7)
    index.add(spark.createDataFrame([(str(k), k) for k in range(100)], "digest string, keep_id long"), "b")
    new = spark.createDataFrame([("5", 5), ("x", 6)], "digest string, keep_id long")
    plan = index.unknown(new)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning(digest") == 1 and "SortMergeJoin" in physical
    assert "SelectedBucketsCount: 7 out of 7" in physical or "Bucketed: true" in physical
    assert [r.digest for r in index.unknown(new).collect()] == ["x"]


def test_stages_keep_columns_with_any_name(spark, documents, tmp_path):
    words = "some words of a text that has enough of them to pass the base rules number"
    rows = [(k, f"{words} {k}") for k in range(6)] + [(9, f"{words} 1")]
    docs = documents(rows, "named_struct('x', 1) AS `a.b`").withColumnRenamed("n_chars", "fp").selectExpr("*", "7 AS `we``ird`", "1 AS _row", "2 AS mark")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
    assert docs.count() > 0
