"""Regular expressions with Unicode word and space rules that do not depend on the JVM version."""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
DIGIT = r"\p{Nd}"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def portable(pattern: str) -> str:
    r"""Spell out ``\b \w \s \d .`` so that they mean Unicode words, spaces, digits, non-newlines."""
    out, i, previous_is_word = [], 0, False
    in_class = False
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        following = pattern[i + len(token) : i + len(token) + 1]
        if token == r"\b":
            if previous_is_word:
                out.append(f"(?!{WORD})")
            elif re.match(r"\w", following) or pattern[i + 2 : i + 4] == r"\w":
                out.append(f"(?<!{WORD})")
            else:
                out.append(f"(?<={WORD})")
        elif token in (r"\w", r"\s", r"\d"):
            spelled = {r"\w": WORD, r"\s": SPACE, r"\d": DIGIT}[token]
            out.append(spelled[1:-1] if in_class and token != r"\d" else spelled)
        elif token == "." and not in_class:
            out.append(r"[^\n]")
        else:
            in_class = token == "[" or (in_class and token != "]")
            out.append(token)
        previous_is_word = bool(re.fullmatch(r"\w", token)) or token == r"\w"
        i += len(token)
    return "".join(out)


def any_word(words: list[str]) -> str:
    """Matches a text holding one of the words or phrases between word boundaries."""
    return f"(^|{NOT_WORD})(" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + f")($|{NOT_WORD})"


def sql_literal(pattern: str) -> str:
    """Quote a pattern for a Spark SQL expression string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
