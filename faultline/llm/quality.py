"""Quality rules: statistics of texts and a decision list learned from labelled ones."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import SEPARATORS, let, text_of, words_of
from faultline.session import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
STATS = "_fl_stats"
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "n_words",
    "mean_word",
    "symbols_per_word",
    "marks_per_word",
    "upper_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that the text has more than once.

    Hashes of the windows settle the usual case, a text without such windows. Otherwise windows
    are sorted by their words; neighbours that agree are repeats, and the positions they cover are
    counted from one repeat's start to the next.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    windows = F.sort_array(
        F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("at")))
    )

    def covered(ordered: Column) -> Column:
        def again(window: Column, k: Column) -> Column:
            same_before = (k > 0) & (F.get(ordered, k - 1)["w"] == window["w"])
            same_after = F.coalesce(F.get(ordered, k + 1)["w"] == window["w"], F.lit(False))
            return F.when(same_before | same_after, window["at"])

        places = F.sort_array(F.array_compact(F.transform(ordered, again)))
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, at: F.struct(
                (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")
            ),
            lambda acc: acc["n"],
        )

    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= WINDOW, none).when(repeats, let(windows, covered)).otherwise(none)


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and one struct of all statistics; null counts as the empty text."""
    def stats(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(_without(line, SEPARATORS)) > 0)
        letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
        upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
        chars = F.length(_without(text, SEPARATORS))

        def of_words(words: Column, lines: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                chars.cast("long").alias("word_chars"),
                (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _repeated_words(words).alias("n_repeat_words"),
                F.size(lines).cast("long").alias("n_lines"),
                F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
                (F.length(text) - F.length(_without(text, "!?"))).cast("long").alias("n_marks"),
                letters.cast("long").alias("n_letters"),
                upper.cast("long").alias("n_upper"),
            )

        return let(words_of(text), lambda words: let(lines, lambda kept: of_words(words, kept)))

    return docs.select(*keep, let(text_of(), stats).alias(STATS))


def base_failed() -> Column:
    s = F.col(STATS)
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


def features() -> dict[str, Column]:
    s = F.col(STATS)

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(s[a], s[b]), F.lit(0.0))

    return {
        "n_words": s["n_words"].cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, value: Column) -> Column:
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = list[Condition]


def matches(rule: Rule, columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.holds(columns[c.feature])
    return out


def first_match(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """Number of the first rule that rejects, from 1, or 0: the decision list as one CASE expression."""
    if not rules:
        return F.lit(0)
    chain = F
    for k, rule in enumerate(rules, 1):
        chain = chain.when(matches(rule, columns), F.lit(k))
    return chain.otherwise(F.lit(0))


@dataclass(frozen=True)
class Training:
    """How rules are learned.

    ``max_rows`` bounds the labelled rows that are read (a share by hash of doc_id; every label if
    there are fewer). Two thirds of them grow rules, one third prunes and judges them. A rule must
    be right for ``precision`` of the judging rows it meets and meet ``least`` of them.
    """

    max_rows: int = 40_000
    cuts: int = 24
    max_rules: int = 12
    max_conditions: int = 4
    precision: float = 0.9
    least: int = 3


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Features and ``bad`` of the labelled documents, a written table of about ``max_rows`` at most.

    A document is bad if it has a quality label and all of them are 0. The same share of ids is
    taken on both sides before they meet, so only the texts of that share move.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    n = known.count()
    slots = 1 << 20
    share = slots if n <= max_rows else max(1, slots * max_rows // n)
    taken = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots)) < share
    verdicts = known.filter(taken).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("quality") == 0).alias("bad"))
    texts = docs.filter(taken).select(F.col("doc_id").cast("long").alias("_id"), "text")
    joined = with_statistics(texts.join(verdicts, "_id"), "_id", "bad")
    grows = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(3)) > 0
    return materialize(joined.select("bad", grows.alias("grows"), *(c.alias(n) for n, c in features().items())), "labelled")


def _cuts(rows: DataFrame, cuts: int) -> dict[str, list[float]]:
    """Thresholds to try: half-way between quantiles of each feature among good and among bad rows."""
    points = [k / cuts for k in range(cuts + 1)]
    found = rows.groupBy("bad").agg(*(F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES)).collect()
    values = {f: sorted({x for r in found for x in r[f] or ()}) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}


def _tallies(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """For each feature, the bad and good rows between consecutive thresholds, in one pass."""
    def place(f: str) -> Column:
        above = F.filter(F.array(*(F.lit(float(c)) for c in cuts[f])), lambda c: c < F.col(f))
        return F.struct(F.lit(f).alias("f"), F.size(above).alias("k"))

    if not any(cuts.values()):
        return {}
    cells = rows.select("bad", F.explode(F.array(*(place(f) for f in FEATURES if cuts[f]))).alias("cell"))
    counted = cells.groupBy("cell.f", "cell.k").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    out = {f: [(0, 0)] * (len(c) + 1) for f, c in cuts.items() if c}
    for r in counted.collect():
        out[r["f"]][r["k"]] = (r["bad"], r["good"])
    return out


def _gain(bad: int, good: int, old_bad: int, old_good: int) -> float:
    """FOIL's information gain of narrowing a rule."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(old_bad / (old_bad + old_good)))


def _best_condition(tallies, cuts, bad: int, good: int) -> tuple[float, Condition | None, int, int]:
    best = (1e-9, None, bad, good)
    for f, cells in tallies.items():
        below_bad = below_good = 0
        for k, threshold in enumerate(cuts[f]):
            below_bad, below_good = below_bad + cells[k][0], below_good + cells[k][1]
            for above, b, g in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                gain = _gain(b, g, bad, good)
                if gain > best[0]:
                    best = (gain, Condition(f, above, threshold), b, g)
    return best


def _columns() -> dict[str, Column]:
    return {f: F.col(f) for f in FEATURES}


def _grown(rows: DataFrame, cuts: dict[str, list[float]], most: int) -> Rule:
    rule: Rule = []
    while len(rule) < most:
        tallies = _tallies(rows.filter(matches(rule, _columns())), cuts)
        if not tallies:
            break
        cells = next(iter(tallies.values()))
        bad, good = sum(c[0] for c in cells), sum(c[1] for c in cells)
        if not bad or not good:
            break
        _, condition, _, left = _best_condition(tallies, cuts, bad, good)
        if condition is None:
            break
        rule.append(condition)
        if not left:
            break
    return rule


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The rule's beginning that separates the judging rows best, with the bad and good rows it meets."""
    columns = _columns()
    aggregates = [
        F.count_if(matches(rule[:k], columns) & kind).alias(f"{name}{k}")
        for k in range(1, len(rule) + 1)
        for name, kind in (("bad", F.col("bad")), ("good", ~F.col("bad")))
    ]
    r = rows.agg(*aggregates).first()
    scores = [((r[f"bad{k}"] - r[f"good{k}"]) / max(1, r[f"bad{k}"] + r[f"good{k}"]), -k) for k in range(1, len(rule) + 1)]
    k = -max(scores)[1]
    return rule[:k], r[f"bad{k}"], r[f"good{k}"]


def learn(rows: DataFrame, how: Training = Training()) -> list[Rule]:
    """Sequential covering: grow a rule on what no rule covers yet, prune it, keep it if it is right.

    ``rows`` has ``bad``, ``grows`` and the features. The driver sees counts between thresholds,
    never rows. No labels, or labels of one kind, give no rules.
    """
    rules: list[Rule] = []
    cuts = _cuts(rows, how.cuts)
    while len(rules) < how.max_rules:
        left = rows.filter(first_match(rules, _columns()) == 0)
        rule = _grown(left.filter("grows"), cuts, how.max_conditions)
        if not rule:
            break
        rule, bad, good = _pruned(left.filter("not grows"), rule)
        if bad < how.least or bad < how.precision * (bad + good):
            break
        rules.append(rule)
    return rules


def judge(docs: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """Columns ``keep``, the base statistics, base_failed, rule and kept for every document.

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike, an
    empty table gives no rows, columns that are not kept are not read.
    """
    stats = with_statistics(docs, *keep)
    rule = first_match(rules, features())
    return stats.select(
        *keep,
        *(F.col(STATS)[b].alias(b) for b in BASE),
        base_failed().alias("base_failed"),
        rule.alias("rule"),
        (~base_failed() & (rule == 0)).alias("kept"),
    )


def learned(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> list[Rule]:
    return learn(labelled(docs, labels, how.max_rows), how)
