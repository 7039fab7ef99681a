"""Chain-of-thought record parsing and filters (B17, B18) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

EMPTY_TAG_PAIR = r"<[^>]+></[^>]+>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cot_problem(response: Column | str) -> Column:
    """Text before the first ``<think>``, stripped, without a leading ``Question:``
    and a trailing ``Answer:``."""
    head = py_strip(F.substring_index(_c(response), "<think>", 1))
    head = F.regexp_replace(head, r"^Question:\s*", "")
    head = F.regexp_replace(head, r"\s*Answer:\s*$", "")
    return py_strip(head)


def cot_solution(response: Column | str) -> Column:
    """All closed think blocks joined by a space inside one ``<think>`` block, then
    the text of the last ``<answer>`` (leading ``Answer:`` removed) if there is one."""
    r = _c(response)
    parts = F.split(r, "<think>", -1)
    later = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    closed = F.filter(later, lambda p: p.contains("</think>"))
    thoughts = F.transform(closed, lambda p: py_strip(F.substring_index(p, "</think>", 1)))
    think = F.concat(F.lit("<think>"), F.array_join(thoughts, " "), F.lit("</think>"))
    last = F.element_at(F.split(r, "<answer>", -1), -1)
    final = py_strip(F.substring_index(last, "</answer>", 1))
    final = F.regexp_replace(final, r"^Answer:\s*", "")
    with_answer = F.concat(think, F.lit("\n\n<answer>"), final, F.lit("</answer>"))
    return F.when(r.contains("<answer>"), with_answer).otherwise(think)


def cot_keep(problem: Column | str, solution: Column | str, height: Column | str,
             width: Column | str) -> Column:
    """No empty tag pair in the solution, no ``Answer:`` in the problem, image at
    least 28×28 and present. NULL rows are dropped (the reference crashes on them)."""
    ok = (~_c(solution).rlike(EMPTY_TAG_PAIR) & ~_c(problem).contains("Answer:")
          & (_c(height) >= 28) & (_c(width) >= 28))
    return F.coalesce(ok, F.lit(False))
