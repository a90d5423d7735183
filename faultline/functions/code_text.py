"""Measures over source text that need no parser; all built-in column expressions."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions.patterns import LINE_BREAK, NOT_SPACE, WORD, portable, sql_literal

_SYNC_ROOTS = "lock|semaphore|condition|event|barrier|synchronized|latch|mutex"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_count(code) -> Column:
    return F.regexp_count(_col(code), F.lit(WORD + "+"))


def nloc(code) -> Column:
    """Lines holding at least one visible character."""
    lines = F.split(_col(code), LINE_BREAK)
    return F.size(F.filter(lines, lambda line: line.rlike(NOT_SPACE)))


def sync_patterns() -> dict[str, int]:
    """Each distinct construct with the number of times it counts."""
    listed = schema.SYNC_PATTERNS_PYTHON + schema.SYNC_PATTERNS_JAVA + schema.SYNC_PATTERNS_CPP
    folded = Counter(p.lower() if "\\w" not in p else p for p in listed)
    return dict(folded)


def sync_constructs(code) -> Column:
    """Weighted count of synchronization constructs, case-insensitive.

    Each pattern only runs on texts holding its literal core; most texts hold none. The lower-case text
    is the variable of a lambda, so that it is made once and not for each pattern.
    """
    code = _col(code)

    def count(folded: Column) -> Column:
        counts = [
            F.when(folded.contains(_literal_core(p)), F.regexp_count(code, F.lit("(?iu)" + portable(p))))
            .otherwise(0)
            * weight
            for p, weight in sync_patterns().items()
        ]
        some = reduce(lambda a, b: a | b, [folded.contains(root) for root in _SYNC_ROOTS.split("|")])
        return F.when(some, reduce(lambda a, b: a + b, counts)).otherwise(F.lit(0))

    folded = F.replace(F.lower(code), F.lit("ſ"), F.lit("s"))
    return F.transform(F.array(folded), count)[0]


def _literal_core(pattern: str) -> str:
    """The longest plain word of a pattern, lower-case."""
    words = re.findall(r"[A-Za-z_]+", re.sub(r"\\[bswd]", " ", pattern))
    return max(words, key=len).lower()


def loop_start() -> str:
    return "(?iu)(" + "|".join(portable(p) for p in schema.LOOP_PATTERNS) + ")"


def brace_loop_nesting(code: str, corrected: bool = False) -> Column:
    """struct<max_depth, nested> from loop keywords and braces, folded line by line.

    A loop adds an entry to a stack; an opening brace adds one if the stack is not empty; a closing
    brace removes one. The depth of a loop is the stack size when it starts plus one. With
    ``corrected`` only loops count towards the depth: a loop's entry leaves with its closing brace.
    """
    loop = sql_literal(loop_start())
    zero = "named_struct('max_depth', 0, 'nested', 0)"
    if corrected:
        # frames: one character per open brace, L for a loop's brace; p = loop waiting for its brace
        fold = (
            "aggregate(split(`{c}`, '\\n'), named_struct('f', '', 'm', 0, 'n', 0), (a, l) -> "
            "named_struct('f', "
            "  aggregate(split(regexp_replace(l, '[^{{}}]', ''), ''), "
            "    named_struct('s', a.f, 'p', l rlike {loop}), (b, ch) -> named_struct("
            "      's', case when ch = '{{' then concat(b.s, if(b.p, 'L', 'B')) "
            "               when ch = '}}' then substring(b.s, 1, greatest(0, length(b.s) - 1)) else b.s end, "
            "      'p', b.p and ch <> '{{'), b -> b.s), "
            "'m', greatest(a.m, if(l rlike {loop}, 1 + length(replace(a.f, 'B', '')), 0)), "
            "'n', a.n + if(l rlike {loop} and length(replace(a.f, 'B', '')) > 0, 1, 0)), "
            "a -> named_struct('max_depth', a.m, 'nested', a.n))"
        ).format(c=code, loop=loop)
    else:
        fold = (
            "aggregate(transform(split(`{c}`, '\\n'), l -> named_struct("
            "'k', cast((contains(l, '(') or contains(l, '{{')) and l rlike {loop} as int), "
            "'o', length(l) - length(replace(l, '{{', '')), "
            "'x', length(l) - length(replace(l, '}}', '')))), "
            "named_struct('s', 0, 'm', 0, 'n', 0), (a, l) -> named_struct("
            "'s', if(a.s + l.k > 0, greatest(0, a.s + l.k + l.o - l.x), 0), "
            "'m', if(l.k = 1, greatest(a.m, a.s + 1), a.m), "
            "'n', a.n + if(l.k = 1 and a.s > 0, 1, 0)), "
            "a -> named_struct('max_depth', a.m, 'nested', a.n))"
        ).format(c=code, loop=loop)
    return F.expr(f"case when `{code}` rlike {loop} then {fold} else {zero} end")


def language_of(file_name, code) -> Column:
    """Language by extension, else by text shape, else python."""
    by_name = _extension_lookup(file_name, schema.LANGUAGE_BY_EXTENSION)
    by_shape = F.lit(None).cast("string")
    for language, shape in reversed(schema.LANGUAGE_SHAPES):
        by_shape = F.when(_col(code).rlike(portable(shape)), language).otherwise(by_shape)
    return F.coalesce(by_name, by_shape, F.lit("python"))


def language_by_name(file_name) -> Column:
    """Reduced lookup used when a whole history is labelled; unknown extensions are python."""
    return F.coalesce(
        _extension_lookup(file_name, schema.REDUCED_LANGUAGE_BY_EXTENSION), F.lit("python")
    )


def _extension_lookup(file_name, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    extension = F.lower(F.substring_index(_col(file_name), ".", -1))
    return F.try_element_at(F.create_map(*pairs), extension)
