"""Text helpers shared by every rule: Unicode-aware trimming and regex pieces.

Java regex (Spark) and Python's ``re`` differ in two places that matter here:
``\\s``, ``\\d`` and ``\\b`` are ASCII in Java unless the pattern starts with
``(?U)``, and Python counts U+001C..U+001F as whitespace while Java's
``(?U)\\s`` does not. ``WS`` below is the Python whitespace class in Java.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str.isspace() as a Java character class (used under (?U)).
WS = r"[\s\x1c-\x1f]"

_TRIM_RE = rf"(?U)^{WS}+|{WS}+\z"
_RTRIM_RE = rf"(?U){WS}+\z"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` names it, also within
    lambdas and after the optimiser has written columns out."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_u(c: Column | str) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends."""
    return F.regexp_replace(col_of(c), _TRIM_RE, "")


def rtrim_u(c: Column | str) -> Column:
    """Python ``str.rstrip()``."""
    return F.regexp_replace(col_of(c), _RTRIM_RE, "")


def is_blank(c: Column | str) -> Column:
    """Null, empty, or whitespace only."""
    c = col_of(c)
    return c.isNull() | (F.length(trim_u(c)) == 0)


def keyword_alternation(words: list[str], whole_word: bool = False) -> str:
    """One Java regex matching any of ``words`` (literal, lower-case input assumed)."""
    alts = "|".join(_quote(w) for w in sorted(words, key=len, reverse=True))
    return rf"(?U)\b(?:{alts})\b" if whole_word else f"(?:{alts})"


def _quote(word: str) -> str:
    out = []
    for ch in word:
        out.append("\\" + ch if ch in r"\.^$|?*+()[]{}-" else ch)
    return "".join(out)


def contains_any(lower_text: Column, words: list[str], whole_word: bool = False) -> Column:
    """True when ``lower_text`` contains any keyword; substring semantics by default."""
    if not words:
        return F.lit(False)
    if whole_word:
        return lower_text.rlike(keyword_alternation(words, True))
    cond = None
    for w in words:
        term = F.instr(lower_text, w) > 0
        cond = term if cond is None else (cond | term)
    return cond
