"""Rules and measures over commit messages and issue text; all built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions.patterns import DIGIT, NOT_SPACE, NOT_WORD, any_word, portable

_I = "(?iu)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_bug_fix_word(message, words: list[str] | None = None) -> Column:
    return F.lower(_col(message)).rlike(_I + any_word(words or schema.BUG_FIX_WORDS))


def has_performance_word(message) -> Column:
    return F.lower(_col(message)).rlike(_I + any_word(schema.PERFORMANCE_WORDS))


def has_issue_reference(message) -> Column:
    return F.lower(_col(message)).rlike(
        _I + "(" + "|".join(portable(p) for p in schema.ISSUE_REFERENCES) + ")"
    )


def has_performance_reference(message) -> Column:
    return F.lower(_col(message)).rlike(
        _I + "(" + "|".join(portable(p) for p in schema.PERFORMANCE_REFERENCES) + ")"
    )


def matched_rule(message, words: list[str] | None = None) -> Column:
    """First message rule that applies: keyword, performance, reference, performance_reference."""
    return (
        F.when(has_bug_fix_word(message, words), "keyword")
        .when(has_performance_word(message), "performance")
        .when(has_issue_reference(message), "reference")
        .when(has_performance_reference(message), "performance_reference")
    )


def is_bug_fix(message, confirmed_by_issue: Column | None = None, words: list[str] | None = None) -> Column:
    """True if a message rule applies or a referenced issue confirms the fix; null text is false."""
    by_text = F.coalesce(matched_rule(message, words).isNotNull(), F.lit(False))
    if confirmed_by_issue is None:
        return by_text
    has_text = F.coalesce(F.length(_col(message)) > 0, F.lit(False))
    return by_text | (has_text & F.coalesce(confirmed_by_issue, F.lit(False)))


def issue_keys(text) -> Column:
    """Distinct issue keys of a text; a lower-case key also yields its upper-case form."""
    text = F.coalesce(_col(text), F.lit(""))
    bounds = f"(?<!{NOT_WORD.replace('^', '')})", f"(?!{NOT_WORD.replace('^', '')})"
    any_case = F.regexp_extract_all(
        text, F.lit(_I + bounds[0] + f"([A-Z][A-Z0-9_]+-{DIGIT}+)" + bounds[1]), F.lit(1)
    )
    lower_case = F.regexp_extract_all(
        text, F.lit(bounds[0] + f"([a-z][a-z0-9_]+-{DIGIT}+)" + bounds[1]), F.lit(1)
    )
    return F.array_union(any_case, F.transform(lower_case, F.upper))


def message_length(message) -> Column:
    return F.length(_col(message))


def message_word_count(message) -> Column:
    return F.regexp_count(_col(message), F.lit(NOT_SPACE + "+"))


def message_char_count(message) -> Column:
    return F.length(F.replace(_col(message), F.lit(" "), F.lit("")))


def issue_text(summary, description, labels, components, issue_type) -> Column:
    return F.lower(
        F.concat_ws(
            " ",
            F.coalesce(_col(summary), F.lit("")),
            F.coalesce(_col(description), F.lit("")),
            F.array_join(F.coalesce(_col(labels), F.array().cast("array<string>")), " "),
            F.array_join(F.coalesce(_col(components), F.array().cast("array<string>")), " "),
            F.coalesce(_col(issue_type), F.lit("")),
        )
    )


def is_performance_issue(summary, description, labels, components, issue_type) -> Column:
    """True if any performance term occurs as a substring ("flag" contains "lag")."""
    return issue_text(summary, description, labels, components, issue_type).rlike(
        "|".join(schema.PERFORMANCE_ISSUE_SUBSTRINGS)
    )


def issue_confirms_fix(issue_type, status, performance_issue) -> Column:
    status = F.lower(_col(status))
    return F.coalesce(
        (F.lower(_col(issue_type)).contains("bug") & status.isin(schema.BUG_DONE_STATES))
        | (_col(performance_issue) & status.isin(schema.PERFORMANCE_DONE_STATES)),
        F.lit(False),
    )


def parse_timestamp(text) -> Column:
    """ISO log date with offset, else any timestamp Spark understands, else null."""
    text = F.trim(_col(text))
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(text),
    )


def pretty_label(name) -> Column:
    return F.initcap(F.replace(_col(name), F.lit("_"), F.lit(" ")))


def model_key(name) -> Column:
    return F.regexp_replace(F.lower(_col(name)), "[^a-z0-9_]+", "_")


def artifact_name(name) -> Column:
    return F.translate(F.regexp_replace(_col(name), "[()]", ""), " -", "__")


def line_range(start, end) -> Column:
    def side(c):
        return F.coalesce(F.nullif(_col(c), F.lit(0)).cast("string"), F.lit("N/A"))

    return F.concat_ws("-", side(start), side(end))
