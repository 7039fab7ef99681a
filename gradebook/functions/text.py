"""Text matching as Column expressions (operators C1, C3, C4 and helpers).

Everything here compiles to JVM regex functions, so it stays inside whole-stage codegen.
The word-boundary rule is written with Unicode classes instead of ``\\b`` so that the same
pattern means the same thing in Spark (Java regex) and in DuckDB (RE2), and matches the
Unicode ``\\b`` of Python ``re`` for letters, digits and ``_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A "word" character: letter, digit or underscore (Unicode aware, same in Java and RE2).
WORD = r"\p{L}\p{N}_"
NOT_WORD = rf"[^{WORD}]"

# Whitespace removed by Python's str.strip(); written in Java regex syntax.
STRIP_CHARS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

# Sentinels kept as values (fixed values of the evaluator).
UNKNOWN = "unknown"
MODEL_ERROR = "error_empty_input_ids"

_META = set(r".^$*+?()[]{}|\/")


def regex_escape(s: str) -> str:
    """Escape regex metacharacters in a way both Java regex and RE2 accept."""
    return "".join("\\" + ch if ch in _META else ch for ch in s)


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()`` on a string column."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, rf"^[{STRIP_CHARS}]+|[{STRIP_CHARS}]+$", "")


def class_alternation(class_names: Sequence[str]) -> str:
    """The C1 pattern: one alternation in class order, bounded by non-word characters."""
    alts = "|".join(regex_escape(n.lower()) for n in class_names)
    return rf"(^|{NOT_WORD})({alts})($|{NOT_WORD})"


def first_mentioned_class(text: Column | str, class_names: Sequence[str]) -> Column:
    """The class whose whole-word mention starts earliest in the lower-cased text.

    Ties at one position go to the class listed first; no mention gives ``unknown``.
    The result is lower-cased. Leading/trailing whitespace does not change the winner,
    so the ``strip`` of the reference is not needed.
    """
    text = F.col(text) if isinstance(text, str) else text
    if not class_names:
        return F.lit(UNKNOWN)
    hit = F.regexp_extract(F.lower(text), class_alternation(class_names), 2)
    # the regex appears once in the expression tree: no repeated evaluation per row
    return F.coalesce(F.nullif(hit, F.lit("")), F.lit(UNKNOWN))


def format_reward(text: Column | str) -> Column:
    """1.0 when the stripped text is ``The answer is <word>[.]`` (any case), else 0.0."""
    text = F.col(text) if isinstance(text, str) else text
    ok = py_strip(text).rlike(rf"(?i)^the answer is [{WORD}]+\.?$")
    return F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))


def format_reward_rec(text: Column | str, braces: bool = True) -> Column:
    """C4: think block followed by an answer block holding a list of four integers.

    ``braces=True`` is the first model family's rule (the list must sit inside ``{...}``);
    ``braces=False`` is the second family's rule.
    """
    text = F.col(text) if isinstance(text, str) else text
    quad = r"\[\d+,\s*\d+,\s*\d+,\s*\d+\]"
    inner = rf".*?\{{.*{quad}.*\}}.*?" if braces else rf".*?{quad}.*?"
    pattern = rf"(?s)<think>.*?</think>\s*<answer>{inner}</answer>"
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))
