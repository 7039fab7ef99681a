"""Name and path parsing as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import py_strip

# Model alias → hub id table of the evaluator (B10 default), public
# third-party models only; pass a mapping to resolve other aliases.
MODEL_ALIASES = {
    "qwen2.5vl-3b-instruct": "Qwen/Qwen2.5-VL-3B-Instruct",
    "qwen2vl-2b-instruct": "Qwen/Qwen2-VL-2B-Instruct",
    "qwen2vl-2b": "Qwen/Qwen2-VL-2B",
    "visualthinker": "turningpoint-ai/VisualThinker-R1-Zero",
}

UNKNOWN_EXP = "(unknown_exp)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def resolve_alias(name: Column | str, mapping: Mapping[str, str] = MODEL_ALIASES) -> Column:
    """Look up ``lower(strip(name))``; an unknown name comes back unchanged."""
    name = _c(name)
    return F.coalesce(F.element_at(literal_map({k.lower(): v for k, v in mapping.items()}),
                                   F.lower(py_strip(name))), name)


def model_family(model_id: Column | str, model_type: Column | str,
                 instruct: Column | str | bool = True) -> Column:
    """B11 (evaluator side): ordered rules; anything else raises at run time."""
    mid, mtype = F.lower(_c(model_id)), _c(model_type)
    inst = F.lit(instruct) if isinstance(instruct, bool) else _c(instruct)
    return (F.when(~inst, F.lit("qwen_noninstruct_like"))
            .when((mtype == "qwen2_vl") | mid.contains("qwen2-vl") | mid.contains("qwen2vl"),
                  F.lit("qwen_instruct_like"))
            .when(mtype == "qwen2_5_vl", F.lit("qwen_instruct_like"))
            .otherwise(F.raise_error(F.concat(F.lit("unsupported model: "), _c(model_id)))))


def vlm_module(model_id: Column | str) -> Column:
    """B11 (trainer side): module by case-insensitive substring; anything else raises."""
    mid = F.lower(_c(model_id))
    return (F.when(mid.contains("qwen"), F.lit("qwen"))
            .when(mid.contains("internvl"), F.lit("internvl"))
            .otherwise(F.raise_error(F.concat(F.lit("unsupported model: "), _c(model_id)))))


#: A plain decimal number, and a size: one or two of them and a unit.
NUMBER = "[0-9]+(?:[.][0-9]+)?"
SIZE = f"{NUMBER}(?:x{NUMBER})?[bm]"


def param_count(model_id: Column | str) -> Column:
    """Largest ``<n>[x<m>](b|m)`` in the lower-cased name, as an integer; -1 if none."""
    found = F.regexp_extract_all(F.lower(_c(model_id)), F.lit(SIZE), F.lit(0))

    def value(m: Column) -> Column:
        factors = F.transform(F.split(F.regexp_replace(m, "[bm]$", ""), "x"),
                              lambda n: n.cast("double"))
        return F.aggregate(factors, F.when(m.endswith("b"), F.lit(1e9)).otherwise(F.lit(1e6)),
                           lambda acc, n: acc * n)

    best = F.array_max(F.transform(found, value))
    return F.coalesce(best.cast("long"), F.lit(-1).cast("long"))


def run_name(run: Column | str | None, model_id: Column | str, dataset: Column | str,
             ts: Column | str) -> Column:
    """Given run name, else ``model(/→_)_dataset``; then ``_yyyyMMdd_HHmmss``."""
    default = F.concat(F.regexp_replace(_c(model_id), "/", "_"), F.lit("_"), _c(dataset))
    base = default if run is None else F.coalesce(_c(run), default)
    return F.concat(base, F.lit("_"), F.date_format(_c(ts), "yyyyMMdd_HHmmss"))


def dataset_label(name: Column | str, root: Column | str, kind: Column | str) -> Column:
    """What a run's files call its data set: its name, else the last part of its root
    folder in lower case, else its kind in lower case. NULL and empty count as absent (a root
    with a slash at its end has no last part)."""
    base = F.substring_index(_c(root), "/", -1)
    given = [F.nullif(_c(name), F.lit("")), F.lower(F.nullif(base, F.lit("")))]
    return F.coalesce(*given, F.lower(_c(kind)))


def parse_step(path: Column | str) -> Column:
    """B14 (strict form): digits of the ``<n>_steps`` directory holding the file."""
    s = F.regexp_extract(_c(path), r"/(\d+)_steps/[^/]*$", 1)
    return F.when(s != "", s.cast("long"))


def parse_step_loose(dir_name: Column | str) -> Column:
    """B14 (one-level form): name ends with ``_steps`` and the rest casts to an int."""
    d = _c(dir_name)
    return F.when(d.endswith("_steps"), F.regexp_replace(d, "_steps$", "").try_cast("int"))


def parse_experiment(path: Column | str, base: str) -> Column:
    """First directory under ``base``; ``(unknown_exp)`` if the step dir is directly
    under ``base``. ``path`` is the file path; its parent is the step directory."""
    base = base.rstrip("/") + "/"
    rel = F.when(_c(path).startswith(base), F.substring(_c(path), len(base) + 1, 1 << 30))
    parts = F.split(rel, "/")
    # parts = [dir..., step_dir, file]; the step dir's relative path has size(parts)-1 parts
    return F.when(F.size(parts) - 1 >= 2, parts.getItem(0)).otherwise(F.lit(UNKNOWN_EXP))


def pick_column(df: DataFrame, candidates: Sequence[str], required: bool = False) -> Column:
    """The first candidate that exists as a column (schema-time), else NULL/raise."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    if required:
        raise ValueError(f"none of the columns {list(candidates)} exists")
    return F.lit(None)
