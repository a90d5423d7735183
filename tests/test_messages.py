import pytest
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions import messages as m


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_vocabulary_sizes():
    assert len(schema.BUG_FIX_WORDS) == 32
    assert len(schema.PERFORMANCE_WORDS) == 80
    assert len(schema.PERFORMANCE_ISSUE_SUBSTRINGS) == 22
    listed = schema.SYNC_PATTERNS_PYTHON, schema.SYNC_PATTERNS_JAVA, schema.SYNC_PATTERNS_CPP
    assert [len(x) for x in listed] == [12, 10, 8]


CASES = [
    ("Fix null pointer", "keyword"),
    ("prefix table rename", None),
    ("Improve cache", "performance"),
    ("Update blocks", "performance"),
    ("perf 12 numbers", "performance_reference"),
    ("perf numbers", None),
    ("Use utf-8", "reference"),
    ("See #42", "reference"),
    ("AB2-9 rename", None),
    ("Add docs", None),
    ("", None),
    (None, None),
    ("éfix", None),
    ("tune speed-up path", "performance"),
    ("FIXED: it", "keyword"),
    ("memory  leak-free", "performance"),
]


def test_bug_fix_rules(spark):
    texts = [t for t, _ in CASES]
    assert values(spark, texts, m.matched_rule("t")) == [r for _, r in CASES]
    assert values(spark, texts, m.is_bug_fix("t")) == [r is not None for _, r in CASES]


def test_own_keywords_replace_the_list(spark):
    assert values(spark, ["Hotfix it", "fix it"], m.is_bug_fix("t", words=["hotfix"])) == [True, False]


def test_issue_confirmation_needs_text(spark):
    assert values(spark, ["Add docs", "", None], m.is_bug_fix("t", F.lit(True))) == [True, False, False]


def test_issue_keys(spark):
    got = values(spark, ["Fix PROJ-123: slow", "see proj-1", "nothing", None, "A-1 AB_1-2,AB_1-2"], m.issue_keys("t"))
    assert [set(g) for g in got] == [{"PROJ-123"}, {"proj-1", "PROJ-1"}, set(), set(), {"AB_1-2"}]


def test_message_measures(spark):
    texts = ["Fix  a bug", "a\u00a0b\u2003c", "", " \t\n"]
    assert values(spark, texts, m.message_length("t")) == [len(t) for t in texts]
    assert values(spark, texts, m.message_word_count("t")) == [len(t.split()) for t in texts]
    assert values(spark, texts, m.message_char_count("t")) == [len(t.replace(" ", "")) for t in texts]


@pytest.mark.parametrize(
    "summary, wanted",
    [("Add feature flag", True), ("Change label", True), ("Some part", False), ("Add docs", False)],
)
def test_performance_issue_is_a_substring_match(spark, summary, wanted):
    none = F.array().cast("array<string>")
    flag = m.is_performance_issue("t", F.lit(None).cast("string"), none, none, F.lit("Task"))
    assert any(w in summary.lower() for w in schema.PERFORMANCE_ISSUE_SUBSTRINGS) == wanted
    assert values(spark, [summary], flag) == [wanted]


def test_issue_confirms_fix(spark):
    rows = [
        ("Bug", "Fixed", False, True),
        ("Task", "Fixed", True, False),
        ("Task", "Done", True, True),
        ("Bug", "Open", True, False),
        (None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "t string, s string, p boolean, wanted boolean")
    assert df.filter(m.issue_confirms_fix("t", "s", "p") != F.col("wanted")).count() == 0


def test_labels_and_names(spark):
    assert values(spark, ["max_loop_depth"], m.pretty_label("t")) == ["Max Loop Depth"]
    assert values(spark, ["Ensemble (Top 3)", "X-Y z"], m.artifact_name("t")) == ["Ensemble_Top_3", "X_Y_z"]
    assert values(spark, ["Ensemble (Top 3)"], m.model_key("t")) == ["ensemble_top_3_"]
    assert values(spark, ["x"], m.line_range(F.lit(3), F.lit(0))) == ["3-N/A"]


def test_timestamps(spark):
    got = values(spark, ["2024-01-02 03:04:05 +0200", "2024-01-02", "soon"], F.unix_seconds(m.parse_timestamp("t")))
    assert got == [1704157445, 1704153600, None]
