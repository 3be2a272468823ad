"""Parsing model output: a list of impressions, or the eight rubric scores.

Regular expressions find the spans. A span takes one of two routes to its value. Plain spans
(a strict grammar: quoted strings without escapes, whole and decimal numbers, up to ``PLAIN_CHARS``
characters) are read by column expressions and never leave the JVM; all others go to
``ast.literal_eval`` in Arrow batches (literals only, no code runs). Both routes give the same value
where both apply. The rules (which span counts, scale, blank items) are column expressions.

No value aborts a job: what cannot be read is no value, and half a surrogate pair, which no column can hold,
is shown as its escape (``\\ud800``).
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from lexigen.functions.prompts import SCORE_COLUMNS
from lexigen.functions.text import _c, after_last, brace_span, bracket_spans, strip

SCORE_MIN, SCORE_MAX = 0, 5

PLAIN_CHARS = 2000
_GAP = r"[ \t\n]*+"
_QUOTED = r"""(?:'[^'\\\x00-\x1f]*+'|"[^"\\\x00-\x1f]*+")"""
_NUMBER = r"-?(?:0|[1-9][0-9]{0,8})(?:\.[0-9]{1,9})?"
_ENTRY = rf"{_QUOTED}{_GAP}:{_GAP}{_NUMBER}"


def _all_of(opening: str, item: str, closing: str) -> str:
    """A literal of items parted by commas, with or without a last one."""
    return rf"\A{opening}{_GAP}(?:{item}{_GAP}(?:,{_GAP}{item}{_GAP})*+,?{_GAP})?{closing}\z"


PLAIN_LIST = _all_of(r"\[", _QUOTED, r"\]")
PLAIN_SCORES = _all_of(r"\{", _ENTRY, r"\}")


def _plain(span: Column, grammar: str) -> Column:
    return F.coalesce((F.length(span) <= PLAIN_CHARS) & span.rlike(grammar), F.lit(False))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unquoted(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.length(c) - 2)


def _literal(span: str):
    """The value of a literal, None for anything else."""
    try:
        return ast.literal_eval(span)
    except Exception:  # whatever a model writes: no value
        return None


def _item_texts(span: str) -> list[str] | None:
    """Texts of a list literal's items; None if it is no list or an item cannot be shown
    (such as a whole number of more digits than Python prints)."""
    value = _literal(span)
    if not isinstance(value, list):
        return None
    try:
        return [str(item).encode("utf-8", "backslashreplace").decode() for item in value]
    except ValueError:
        return None


@F.pandas_udf(ArrayType(StringType()))
def _first_items(spans: pd.Series) -> pd.Series:
    def first(row):
        return next((items for items in map(_item_texts, row) if items is not None), None)

    return pd.Series([None if row is None else first(row) for row in spans], dtype=object)


def _plain_items(span: Column) -> Column:
    return F.transform(F.regexp_extract_all(span, F.lit(_QUOTED), 0), _unquoted)


def parse_list(c) -> Column:
    """Free text -> ``array<string>``: the items of the first ``[...]`` span after the last
    ``Output:`` that is a list, stripped, without blank ones; empty when there is none."""
    spans = bracket_spans(strip(after_last(_c(c), "Output:")))
    first = lambda s: F.get(s, F.lit(0))
    others = _once(spans, lambda s: F.when((F.size(s) > 0) & ~_plain(first(s), PLAIN_LIST), s))
    items = F.coalesce(_once(spans, lambda s: F.when(_plain(first(s), PLAIN_LIST), _plain_items(first(s)))), _first_items(others))
    shown = F.transform(items, lambda s: strip(s))
    found = F.coalesce(F.filter(shown, lambda s: s != F.lit("")), F.array().cast("array<string>"))
    return F.when(_c(c).isNotNull(), found)


def _number(value) -> float | None:
    """A dictionary value as a number: whole ones of any size, finite real ones, and texts
    that Python reads as one whole number."""
    if isinstance(value, (str, bytes)):
        try:
            value = int(value)
        except ValueError:
            return None
    if isinstance(value, int):
        try:
            return float(value)
        except OverflowError:
            return float("inf") if value > 0 else float("-inf")
    return value if isinstance(value, float) and abs(value) < float("inf") else None


@F.pandas_udf(ArrayType(DoubleType()))
def _raw_numbers(spans: pd.Series) -> pd.Series:
    def numbers(span):
        value = _literal(span) if span else None
        return [_number(value.get(k)) for k in SCORE_COLUMNS] if isinstance(value, dict) else None

    return pd.Series([numbers(s) for s in spans], dtype=object)


def _under_names(names: Column, numbers: Column) -> Column:
    return F.transform(F.array(*map(F.lit, SCORE_COLUMNS)), lambda k: F.get(numbers, (F.array_position(names, k) - 1).cast("int")).cast("double"))


def _plain_numbers(span: Column) -> Column:
    """The numbers of a plain dictionary under the score names; of equal names the last one counts."""
    pair = F.lit(rf"({_QUOTED}){_GAP}:{_GAP}({_NUMBER})")
    names = F.reverse(F.transform(F.regexp_extract_all(span, pair, 1), _unquoted))
    numbers = F.reverse(F.regexp_extract_all(span, pair, 2))
    return _once(F.struct(names.alias("names"), numbers.alias("numbers")), lambda x: _under_names(x["names"], x["numbers"]))


def _score(value: Column) -> Column:
    """Kept within the scale and cut to a whole number."""
    within = F.least(F.lit(float(SCORE_MAX)), F.greatest(F.lit(float(SCORE_MIN)), value))
    return F.when(value.isNotNull(), F.floor(within).cast("int"))


def parse_scores(c) -> Column:
    """Free text -> ``struct<8 x int>`` from the span between the first ``{`` and the last ``}``;
    each 0..5 (cut to a whole number, kept within the scale) or null."""
    span = brace_span(_c(c))
    others = _once(span, lambda s: F.when((s != "") & ~_plain(s, PLAIN_SCORES), s))
    numbers = F.coalesce(_once(span, lambda s: F.when(_plain(s, PLAIN_SCORES), _plain_numbers(s))), _raw_numbers(others))
    scores = F.coalesce(F.transform(numbers, _score), F.array().cast("array<int>"))
    return _once(scores, lambda s: F.struct(*[F.get(s, F.lit(i)).alias(k) for i, k in enumerate(SCORE_COLUMNS)]))
