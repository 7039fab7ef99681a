"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Everything is a Column expression over one text; no shuffle, no Python in the tasks.

Kinds. ``email``, ``ip``, ``card`` and ``phone`` are base kinds: each is the leftmost
non-overlapping matches of its pattern, less those that fail its check (ip parts at most
255, card 14-19 digits and Luhn, phone 10-15 digits); a failed match is not retried. Two
kinds are added on top: ``iban`` (ISO 7064 mod-97 must hold) and ``ssn`` (a grouped
nine-digit number that needs a context word within ``CONTEXT`` code points before it).

Each span has a score: the prior of its kind plus ``CONTEXT_GAIN`` if a context word of the
kind stands before it, at most 1. Added kinds below ``MIN_SCORE`` are dropped, base kinds
never are.

Positions: the pieces between matches (``split``) and the matches themselves
(``regexp_extract_all``) alternate, so running sums of their lengths give code-point
offsets. The patterns use possessive runs and start only where a run starts (or where the
last match ended, ``\\G``); they find the same matches as the plain patterns, in linear time
and without recursion on very long runs.

Defined cases: NULL text gives no entities (an empty array); empty text likewise; repeated
rows are treated alike; spans of different kinds may overlap, :func:`mask` merges them;
columns of the input with any other name pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name

# Kinds in listed order, their patterns, priors and context words.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@"
             r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# A text without a match of the guard has no valid span of the kind.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT_WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id|taxpayer",
}
CONTEXT = 40
CONTEXT_GAIN = 0.3
MIN_SCORE = 0.6
SPAN_TYPE = "array<struct<start:int,rank:int,end:int,kind:string,score:double,value:string>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _ip_ok(hit: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return (F.length(bare) <= 3) & (F.substring(bare, 1, 3).cast("int") <= 255)
    return F.forall(F.split(hit, r"\."), small)


def _mod97(hit: Column) -> Column:
    """ISO 7064 remainder of an IBAN: first four characters last, letters as 10-35."""
    moved = F.concat(F.substring(hit, 5, 40), F.substring(hit, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + (F.ascii(c) - 48)) % 97).otherwise(
            (acc * 100 + (F.ascii(c) - 55)) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


CHECKS = {
    "email": lambda h: F.lit(True),
    "ip": _ip_ok,
    "card": lambda h: F.length(_digits(h)).between(14, 19)
    & F.call_function("luhn_check", _digits(h)),
    "phone": lambda h: F.length(_digits(h)).between(10, 15),
    "iban": lambda h: _mod97(h) == 1,
    "ssn": lambda h: ~F.substring(h, 1, 3).isin("000", "666"),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(items: Column, width: Column) -> Column:
    """The array in runs of ``width`` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / width).cast("int")),
                       lambda i: F.slice(items, i * width + 1, width))


def _tail(piece: Column) -> Column:
    return F.substring(piece, -CONTEXT, CONTEXT)


def _placed(pairs: Column) -> Column:
    """Start, end, hit and the ``CONTEXT`` code points before it, of every hit of (gap, hit)
    pairs in text order.

    Appending to an array copies it, so one fold over n pairs would cost n squared. The pairs
    are cut into runs of about n^(1/3): a fold over the runs finds what each starts with, then
    each run is folded alone.
    """
    empty = F.lit([]).cast("array<struct<start:int,end:int,hit:string,before:string>>")
    width = F.greatest(F.lit(32), F.ceil(F.cbrt(F.size(pairs))).cast("int"))

    def said(pair: Column) -> Column:
        return F.concat(pair["gap"], F.coalesce(pair["hit"], F.lit("")))

    def enter(acc: Column, run: Column) -> Column:
        size = F.aggregate(run, F.lit(0), lambda n, pair: n + F.length(said(pair)))
        end = F.aggregate(run, F.lit(""), lambda t, pair: _tail(F.concat(t, _tail(said(pair)))))
        return F.struct((acc["at"] + size).alias("at"),
                        _tail(F.concat(acc["tail"], end)).alias("tail"),
                        F.concat(acc["out"], F.array(F.struct(
                            acc["at"].alias("at"), acc["tail"].alias("tail"), run.alias("run"))))
                        .alias("out"))

    def place(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        before = _tail(F.concat(acc["tail"], _tail(pair["gap"])))
        end = start + F.length(F.coalesce(pair["hit"], F.lit("")))
        new = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit"),
                       before.alias("before"))
        return F.struct(end.alias("at"), _tail(F.concat(before, _tail(F.coalesce(
            pair["hit"], F.lit(""))))).alias("tail"), F.when(
            pair["hit"].isNotNull(), F.concat(acc["out"], F.array(new))).otherwise(
            acc["out"]).alias("out"))

    def runs_of(w: Column) -> Column:
        first = F.lit([]).cast(
            "array<struct<at:int,tail:string,run:array<struct<gap:string,hit:string>>>>")
        runs = F.aggregate(_cut(pairs, w), F.struct(
            F.lit(0).alias("at"), F.lit("").alias("tail"), first.alias("out")),
            enter, lambda acc: acc["out"])
        return F.flatten(F.transform(runs, lambda r: F.aggregate(
            r["run"], F.struct(r["at"].alias("at"), r["tail"].alias("tail"),
                               empty.alias("out")), place, lambda acc: acc["out"])))
    return _let(width, runs_of)


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: start (0-based), end (exclusive), score, value."""
    rank, pattern = KINDS.index(kind), PATTERNS[kind]
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    checked = F.filter(_let(pairs, _placed), lambda s: CHECKS[kind](s["hit"]))

    def scored(s: Column) -> Column:
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(
            F.lower(s["before"]).rlike(CONTEXT_WORDS[kind]), CONTEXT_GAIN).otherwise(0.0))
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"),
                        s["end"].alias("end"), F.lit(kind).alias("kind"),
                        score.alias("score"), s["hit"].alias("value"))
    out = F.transform(checked, scored)
    if kind not in BASE_KINDS:
        out = F.filter(out, lambda s: s["score"] >= MIN_SCORE)
    return F.when(GUARDS[kind](text), out).otherwise(F.lit([])).cast(SPAN_TYPE)


def entities(text: Column) -> Column:
    """All spans of a text, ordered by start and then by kind as listed."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans(text, k) for k in KINDS]))


def with_entities(df: DataFrame, text: str = "text", out: str = "entities") -> DataFrame:
    """Add the entity array of column ``text`` as column ``out``."""
    return df.withColumn(out, entities(F.col(f"`{text}`")))


def mask(text: Column, spans: Column) -> Column:
    """The text with each entity replaced by ``[KIND]``; an entity that overlaps the one
    before it is covered by that one's tag.

    ``substring`` walks a text from its start, so the spans are cut into runs of about
    sqrt(n): each run takes its stretch of the text once and works inside it.
    """
    def pieces(local: Column, run: Column, first: Column) -> Column:
        """The masked stretch ``local``, which begins at position ``first``."""
        def step(acc: Column, s: Column) -> Column:
            piece = F.concat(F.substring(local, acc["at"] - first + 1, s["start"] - acc["at"]),
                             F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(
                s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(
                acc["out"]).alias("out"))
        start = F.struct(first.alias("at"), F.lit([]).cast("array<string>").alias("out"))
        return F.aggregate(run, start, step, lambda acc: F.array_join(acc["out"], ""))

    def enter(acc: Column, run: Column) -> Column:
        return F.struct(
            F.greatest(acc["at"], F.array_max(run["end"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), run.alias("run"))))
            .alias("out"))

    def joined(s: Column) -> Column:
        width = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(s))).cast("int"))
        first = F.struct(F.lit(0).alias("at"), F.lit([]).cast(
            f"array<struct<at:int,run:{SPAN_TYPE}>>").alias("out"))
        runs = _let(width, lambda w: F.aggregate(
            _cut(s, w), first, enter, lambda acc: acc["out"]))
        masked = F.transform(runs, lambda r: _let(
            F.substring(text, r["at"] + 1, F.array_max(r["run"]["end"]) - r["at"]),
            lambda local: pieces(local, r["run"], r["at"])))
        return F.concat(F.array_join(masked, ""), F.substring(
            text, F.array_max(s["end"]) + 1, F.length(text)))
    return F.when(F.size(spans) > 0, _let(spans, joined)).otherwise(text)


def digest(df: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, and all spans."""
    found = with_entities(df.select("doc_id", "text"), out="found")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["rank"] < len(BASE_KINDS))

    def counted(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    counts = [counted(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"))


def redact(df: DataFrame) -> DataFrame:
    """Replace all entities in ``text``; ``n_chars`` follows the new text."""
    found = free_name(df, "_entities")
    out = with_entities(df, out=found)
    masked = mask(F.col("text"), F.col(found))
    out = out.withColumn("text", masked)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(
            F.size(found) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(
            df.schema["n_chars"].dataType))
    return out.drop(found)
