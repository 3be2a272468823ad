"""Reference-vs-generated text metrics as column expressions.

EM, ROUGE-1 and ROUGE-2 are built-in expressions (codegen). BLEU needs
multiset clipping and ROUGE-L a longest-common-subsequence back-trace; neither
has a linear-time built-in form, so each is one Arrow-batched pandas UDF whose
per-row body is a few lines of Python. Every metric is its own column, so a
query that asks for EM alone never starts a Python worker.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexigen.functions.text import _c, n_sentences, ngrams, rouge_words, strip, tokens

# Fixed values of the public metric definitions the reference calls.
BLEU_MAX_N = 4
BLEU_SMOOTH_EPSILON = 0.1
ROUGE_F_EPSILON = 1e-8


def prepared(c, policy: str = "literal_nan") -> Column:
    """The text a metric sees: missing -> ``nan`` (parity), then strip."""
    from lexigen.functions.text import nan_str

    return strip(nan_str(c, policy))


def exact_match(ref, gen) -> Column:
    """1 when both sides are equal after strip (case-sensitive), else 0; null when a side is."""
    return (_c(ref) == _c(gen)).cast("int")


def f_score(overlap: Column, n_hyp: Column, n_ref: Column) -> Column:
    p = F.when(n_hyp == 0, F.lit(0.0)).otherwise(overlap / n_hyp)
    r = F.when(n_ref == 0, F.lit(0.0)).otherwise(overlap / n_ref)
    return F.lit(2.0) * ((p * r) / (p + r + F.lit(ROUGE_F_EPSILON)))


def rouge_n(ref, gen, n: int, on_empty: str = "null") -> Column:
    """ROUGE-N F over *sets* of n-grams of the period-split word lists.

    A single self-contained column; ``operators.evaluate.score_detail`` computes
    the same value with its intermediates staged in projections, which is the
    faster form for whole tables."""
    ref, gen = _c(ref), _c(gen)
    hyp_set = F.array_distinct(ngrams(rouge_words(gen), n))
    ref_set = F.array_distinct(ngrams(rouge_words(ref), n))
    overlap = F.size(F.array_intersect(hyp_set, ref_set))
    f = f_score(overlap, F.size(hyp_set), F.size(ref_set))
    return _undefined_guard(ref, gen, f, on_empty)


def _undefined_guard(ref: Column, gen: Column, value: Column, on_empty: str) -> Column:
    undefined = (n_sentences(ref) == 0) | (n_sentences(gen) == 0)
    if on_empty == "null":
        return F.when(undefined, F.lit(None).cast("double")).otherwise(value)
    if on_empty == "zero":
        return F.when(undefined, F.lit(0.0)).otherwise(value)
    raise ValueError(f"unknown on_empty {on_empty!r}")


# ---------------------------------------------------------------- BLEU (Arrow)


def _ngram_counts(toks, n):
    return Counter(tuple(toks[i : i + n]) for i in range(len(toks) - n + 1))


def _bleu(n_ref: int, n_hyp: int, clipped) -> float:
    """The score of a pair from its word counts and its clipped counts of 1- to 4-grams."""
    if clipped[0] == 0:
        return 0.0
    logs = [
        math.log((num if num else BLEU_SMOOTH_EPSILON) / max(1, n_hyp - n))
        for n, num in enumerate(clipped)
    ]
    bp = 1.0 if n_hyp > n_ref else math.exp(1 - n_ref / n_hyp)
    return bp * math.exp(math.fsum(x / BLEU_MAX_N for x in logs))


def sentence_bleu(ref: str, hyp: str) -> float:
    """Sentence BLEU-4, one reference, uniform weights, epsilon smoothing of zero counts."""
    r, h = ref.split(), hyp.split()
    clipped = []
    for n in range(1, BLEU_MAX_N + 1):
        rc = _ngram_counts(r, n)
        clipped.append(sum(min(c, rc[g]) for g, c in _ngram_counts(h, n).items()))
    return _bleu(len(r), len(h), clipped)


_BLEU_CHARS = 1 << 22  # texts counted at once


def _pairs_bleu(refs: list[str], hyps: list[str]) -> list[float]:
    """``sentence_bleu`` of many pairs, counted together.

    Words become numbers in one dictionary. An n-gram is numbered by its pair's number, its (n-1)-gram's and
    its last word's, so equal numbers are equal n-grams of the same pair; n-grams that stand on one side alone drop
    out before the next length. One sort a length brings equal ones together, and the smaller of the two
    sides' counts is added up by pair."""
    words, lengths = [], []
    for text in [*refs, *hyps]:
        toks = text.split()
        words += toks
        lengths.append(len(toks))
    lengths = np.array(lengths, dtype=np.int64)
    n_pairs, ends = len(refs), np.cumsum(lengths)
    ids: dict = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    at = np.arange(len(word))
    text = np.repeat(np.arange(2 * n_pairs), lengths)
    gram = text % max(1, n_pairs)  # before the first word: the pair
    left = ends[text] - at  # words from here to the text's end
    clipped = np.zeros((BLEU_MAX_N, n_pairs), dtype=np.int64)
    for n in range(BLEU_MAX_N):
        here = left > n
        at, text, gram, left = at[here], text[here], gram[here], left[here]
        if not len(at):
            break
        keys, gram = np.unique(gram * len(ids) + word[at + n], return_inverse=True)
        in_ref = text < n_pairs
        low = np.minimum(
            np.bincount(gram[in_ref], minlength=len(keys)), np.bincount(gram[~in_ref], minlength=len(keys))
        )
        pair = np.zeros(len(keys), dtype=np.int64)
        pair[gram] = text % n_pairs
        np.add.at(clipped[n], pair, low)
        shared = low[gram] > 0
        at, text, gram, left = at[shared], text[shared], gram[shared], left[shared]
    n_ref, n_hyp = lengths[:n_pairs].tolist(), lengths[n_pairs:].tolist()
    return [_bleu(r, h, c) for r, h, c in zip(n_ref, n_hyp, clipped.T.tolist())]


def batch_bleu(refs, hyps) -> list[float | None]:
    """``sentence_bleu`` of every pair, None where a side is; pairs of about 4 million characters at a time."""
    out: list[float | None] = [None] * len(refs)
    held, size = [], 0

    def count():
        for i, v in zip(held, _pairs_bleu([refs[i] for i in held], [hyps[i] for i in held])):
            out[i] = v

    for i, (r, h) in enumerate(zip(refs, hyps)):
        if r is None or h is None:
            continue
        held.append(i)
        size += len(r) + len(h)
        if size >= _BLEU_CHARS:
            count()
            held, size = [], 0
    if held:
        count()
    return out


@F.pandas_udf(DoubleType())
def _bleu_udf(ref: pd.Series, gen: pd.Series) -> pd.Series:
    return pd.Series(batch_bleu(ref.tolist(), gen.tolist()), dtype="float64")


def bleu4(ref, gen) -> Column:
    return _bleu_udf(_c(ref), _c(gen))


# ------------------------------------------------------------ ROUGE-L (Arrow)


def _rouge_sentences(text: str):
    return [" ".join(p.split()) for p in text.split(".") if len(p) > 0]


def _lcs_words(x, y):
    """Words on the LCS back-trace of x (reference) against y (hypothesis).

    Table: T[i][j] = T[i-1][j-1] + 1 on equal words, else max(T[i-1][j], T[i][j-1]).
    Back-trace from the end: diagonal on equal words, else up when
    T[i-1][j] > T[i][j-1], else left. Only that direction is kept, one bit a cell; of large
    tables a band of rows at a time (two texts of 20,000 words take under 10 MB)."""
    if set(x).isdisjoint(y):
        return set()
    up = _up_bits_np(x, y) if len(x) * len(y) > _NUMPY_CELLS else _up_bits(x, y)
    out = set()
    i, j = len(x), len(y)
    while i > 0 and j > 0:
        if x[i - 1] == y[j - 1]:
            out.add(x[i - 1])
            i -= 1
            j -= 1
        elif up(i, j):
            i -= 1
        else:
            j -= 1
    return out


_NUMPY_CELLS = 4096
_BAND_CELLS = 1 << 24  # 2 MB of bits


def _up_bits(x, y):
    """Whether the back-trace goes up at (i, j), for small tables."""
    above, rows = [0] * (len(y) + 1), []
    for xi in x:
        row = [0]
        for j, yj in enumerate(y):
            row.append(above[j] + 1 if xi == yj else max(above[j + 1], row[j]))
        rows.append([a > b for a, b in zip(above[1:], row)])
        above = row
    return lambda i, j: rows[i - 1][j - 1]


def _table_rows(xa, ya, above):
    """The rows under ``above``, one a word of ``xa``, each with the one before it. A row is the running
    maximum of max(T[i-1][j], T[i-1][j-1] + [x_i = y_j])."""
    for xi in xa:
        row = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + (ya == xi)), out=row[1:])
        yield above, row
        above = row


def _up_bits_np(x, y):
    """The same a row at a time with numpy. A large table keeps every ``step``-th row alone, and the back-trace,
    which never goes down or right, builds the bits of one band of rows at a time from the row above it."""
    ids: dict = {}
    xa = np.fromiter((ids.setdefault(w, len(ids)) for w in x), dtype=np.int64, count=len(x))
    ya = np.fromiter((ids.setdefault(w, len(ids)) for w in y), dtype=np.int64, count=len(y))
    # a kept row takes 32 bits a cell and a band's row one, so both take the same space at this step
    step = len(x) if len(x) * len(y) <= _BAND_CELLS else math.isqrt(32 * len(x))
    kept = [np.zeros(len(y) + 1, dtype=np.int32)]
    for i, (_, row) in enumerate(_table_rows(xa[: (len(x) - 1) // step * step], ya, kept[0]), 1):
        if i % step == 0:
            kept.append(row)
    band, bits = -1, None

    def up(i, j):
        nonlocal band, bits
        if (i - 1) // step != band:
            band = (i - 1) // step
            del kept[band + 1 :]
            rows = _table_rows(xa[band * step : i], ya[:j], kept[band][: j + 1])
            bits = [np.packbits(above[1:] > row[:-1], bitorder="little") for above, row in rows]
        return bool(bits[(i - 1) % step][(j - 1) >> 3] >> ((j - 1) & 7) & 1)

    return up


def _lcs_union(r_words, h_words):
    """The union of ``_lcs_words`` of every reference sentence with every hypothesis sentence.

    A pair adds shared words alone, so it is left out where all of these are in the union already. Equal
    sentences add all of their words and a single shared word is always on the back-trace, without a table. Pairs that
    share most go first, as they fill the union soonest."""
    union: set = set()
    hyps = [(list(h), set(h)) for h in dict.fromkeys(map(tuple, h_words))]
    for ref in dict.fromkeys(map(tuple, r_words)):
        words = set(ref)
        if words <= union:
            continue
        pairs = [(shared, h) for h, own in hyps if not (shared := words & own) <= union]
        for shared, h in sorted(pairs, key=lambda p: -len(p[0])):
            if not shared <= union:
                union |= shared if len(shared) == 1 or list(ref) == h else _lcs_words(list(ref), h)
    return union


def rouge_l_summary(ref: str, hyp: str):
    """Summary-level ROUGE-L F (union of per-sentence LCS word sets); None if undefined."""
    rs, hs = _rouge_sentences(ref), _rouge_sentences(hyp)
    if not rs or not hs:
        return None
    r_words = [s.split(" ") for s in rs]
    h_words = [s.split(" ") for s in hs]
    m = len({w for s in r_words for w in s})
    n = len({w for s in h_words for w in s})
    total = len(_lcs_union(r_words, h_words))
    r, p = total / m, total / n
    return 2.0 * ((p * r) / (p + r + ROUGE_F_EPSILON))


@F.pandas_udf(DoubleType())
def _rouge_l_udf(ref: pd.Series, gen: pd.Series) -> pd.Series:
    return pd.Series(
        [None if a is None or b is None else rouge_l_summary(a, b) for a, b in zip(ref, gen)],
        dtype="float64",
    )


def rouge_l_raw(ref, gen) -> Column:
    """ROUGE-L without the undefined guard (the UDF itself returns null then)."""
    return _rouge_l_udf(_c(ref), _c(gen))


def rouge_l(ref, gen, on_empty: str = "null") -> Column:
    ref, gen = _c(ref), _c(gen)
    return _undefined_guard(ref, gen, _rouge_l_udf(ref, gen), on_empty)


def round6(c) -> Column:
    """Half-up rounding to 6 places with plain IEEE arithmetic (bit-equal in any engine)."""
    return F.floor(_c(c) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


_LIMB = 2.0**40
_WHOLE = 2.0**53


def exact_mean(c) -> Column:
    """Mean of the numbers that are there, the same bits in whatever order and partitions they are added.

    A double is cut at the point and then every 40 binary places, without a rounding, into four whole numbers (what
    lies below 2**-120 is left out of each). These are added as decimals, which is exact, and put together once at
    the end. Null and NaN count as missing. A value of 2**53 or more, which infinity is, gives the plain mean."""
    v = F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))
    rest, sums = F.when(F.abs(v) < _WHOLE, v), []
    for _ in range(4):
        whole = rest.cast("bigint")
        sums.append(F.sum(whole.cast("decimal(20,0)")).cast("double"))
        rest = (rest - whole.cast("double")) * F.lit(_LIMB)
    total = sums[-1]
    for s in sums[-2::-1]:
        total = total / F.lit(_LIMB) + s
    return F.when(F.max(F.abs(v)) < _WHOLE, total / F.count(v)).otherwise(F.avg(v))


__all__ = [
    "prepared", "exact_match", "rouge_n", "bleu4", "rouge_l", "round6", "exact_mean",
    "sentence_bleu", "batch_bleu", "rouge_l_summary", "tokens",
]
