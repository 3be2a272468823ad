"""Text column functions (all built-in Spark expressions, JVM side).

Whitespace follows Python's ``str.isspace`` so that ``strip`` and ``tokens``
give the same answer as ``str.strip()`` / ``str.split()`` in a Python
program, which is what the scored data was produced with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace characters (``str.isspace``) below U+3001; there are none above.
WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Same set as a regex character class, valid in Java regex and RE2.
WS_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Cell texts that a pandas CSV reader turns into a missing value
# by default; the reference then prints a missing value as the word ``nan``.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Separator that glues the words of an n-gram into one string; no word holds white space.
GRAM_SEP = " "


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove all Unicode whitespace at both ends."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def nan_str(c, policy: str = "literal_nan") -> Column:
    """Missing value handling before scoring.

    ``literal_nan`` reproduces a CSV round trip through pandas: null and the
    pandas NA tokens become the word ``nan``. ``null`` keeps nulls.
    """
    c = _c(c)
    if policy == "literal_nan":
        return F.when(c.isNull() | c.isin(NA_TOKENS), F.lit("nan")).otherwise(c)
    if policy == "null":
        return c
    raise ValueError(f"unknown null policy {policy!r}")


def tokens(c) -> Column:
    """Python ``str.split()`` with no argument: runs of whitespace separate, no empties.

    Every whitespace character is first mapped to a space, then the text is cut
    at single spaces (a plain, non-regex split) and the empty pieces left by
    runs and ends are removed; no regex and no lambda on the hot path."""
    spaced = F.translate(_c(c), WS_CHARS, " " * len(WS_CHARS))
    return F.array_remove(F.split(spaced, " ", -1), "")


def ngrams(words, n: int) -> Column:
    """All contiguous n-grams of an ``array<string>`` as joined strings (bag, in order)."""
    words = _c(words)
    if n == 1:
        return words
    k = F.greatest(F.size(words) - (n - 1), F.lit(0))
    parts = [F.slice(words, i + 1, k) for i in range(n)]
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: F.concat(a, F.lit(GRAM_SEP), b))
    return out


# Stands for an all-blank sentence while the text is cut into words; where the text itself
# holds this character, it is written with a zero behind it meanwhile.
_BLANK = "\uffff"
_KEPT = _BLANK + "0"


def rouge_words(c) -> Column:
    """Word list used by ROUGE: split on '.', drop zero-length pieces, collapse
    whitespace inside each piece and split it on single spaces (a piece made only
    of whitespace therefore yields one empty word).

    Computed without a per-sentence lambda: every all-blank piece is first
    replaced by a marker, then periods become spaces, the text is cut into words
    and the marker turns into the empty word."""
    kept = F.replace(_c(c), F.lit(_BLANK), F.lit(_KEPT))
    marked = F.regexp_replace(kept, r"(\A|\.)" + WS_CLASS + r"+(?=\.|\z)", "$1" + _BLANK)
    words = tokens(F.translate(marked, ".", " "))
    return F.transform(words, lambda w: F.when(w == F.lit(_BLANK), F.lit("")).otherwise(F.replace(w, F.lit(_KEPT), F.lit(_BLANK))))


def n_sentences(c) -> Column:
    """Number of ROUGE sentences (zero means the metric is undefined)."""
    return F.size(F.regexp_extract_all(_c(c), F.lit(r"[^.]+"), 0))


def after_last(c, marker: str) -> Column:
    """Text after the last ``marker``; the whole text when it is absent."""
    return F.substring_index(_c(c), marker, -1)


# The two span patterns of the parsed model output.
BRACKET_SPAN = r"\[[\s\S]*?\]"
BRACE_SPAN = r"\{[\s\S]*\}"


def bracket_spans(c) -> Column:
    """All non-greedy ``[...]`` spans, left to right."""
    return F.regexp_extract_all(_c(c), F.lit(BRACKET_SPAN), 0)


def brace_span(c) -> Column:
    """Greedy span from the first ``{`` to the last ``}``; empty string when absent."""
    return F.regexp_extract(_c(c), BRACE_SPAN, 0)


# Characters Python's repr() escapes besides quotes, backslash, \t, \n, \r.
_NONPRINT = r"[\p{C}\p{Z}&&[^ ]]"


def _py_str_repr(x: Column) -> Column:
    """Python ``repr`` of one string (quote choice and escapes)."""
    dq = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
    e = F.regexp_replace(x, r"\\", r"\\\\")
    e = F.when(dq, e).otherwise(F.regexp_replace(e, "'", r"\\'"))
    e = F.regexp_replace(e, "\t", r"\\t")
    e = F.regexp_replace(e, "\n", r"\\n")
    e = F.regexp_replace(e, "\r", r"\\r")

    def esc(ch: Column) -> Column:
        cp = F.ascii(ch)
        h = F.lower(F.hex(cp))
        return (
            F.when(~ch.rlike(_NONPRINT), ch)
            .when(cp < 256, F.concat(F.lit("\\x"), F.lpad(h, 2, "0")))
            .when(cp < 65536, F.concat(F.lit("\\u"), F.lpad(h, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(h, 8, "0")))
        )

    rare = F.array_join(F.transform(F.split(e, ""), esc), "")
    e = F.when(e.rlike(_NONPRINT), rare).otherwise(e)
    q = F.when(dq, F.lit('"')).otherwise(F.lit("'"))
    return F.concat(q, e, q)


def list_repr(c) -> Column:
    """``array<string>`` -> the text Python prints for the list (``['a', "it's"]``)."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(_c(c), _py_str_repr), ", "), F.lit("]")
    )
