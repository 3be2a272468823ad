"""Golden metric values (FIXTURES.md §4) and metric properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigen.functions import metrics
from lexigen.functions.metrics import batch_bleu, rouge_l_summary, sentence_bleu
from lexigen.operators.evaluate import evaluate, score_detail, summarize

GOLDEN = [
    ("Multiple renal cysts.", "Multiple renal cysts.", 1, 0.562341, 1.0, 1.0, 1.0),
    ("Mild hepatic steatosis. Small renal stones.", "Mild hepatic steatosis.", 0, 0.206874, 0.666667, 0.571429, 0.666667),
    ("Mild hepatic steatosis.", "Small stones. Mild hepatic steatosis.", 0, 0.265915, 0.75, 0.666667, 0.75),
    ("the cat the cat", "the the the the cat", 0, 0.125743, 1.0, 0.5, 1.0),
    ("a b c d e f", "f e d c b a", 0, 0.063894, 1.0, 0.0, 0.166667),
    ("No abnormality.", "Normal", 0, 0.0, 0.0, 0.0, 0.0),
    ("Lesion of 1.5 cm in liver", "Lesion of 1.5 cm in the liver", 0, 0.643459, 0.933333, 0.769231, 0.933333),
    (None, None, 1, 0.177828, 1.0, 0.0, 1.0),
    ("A. . B", "A. B", 0, 0.107858, 0.8, 0.0, 0.8),
    ("Renal cyst", "renal cyst", 0, 0.149535, 0.5, 0.0, 0.5),
]


def _detail(spark, rows):
    df = spark.createDataFrame(
        [(i, r, g) for i, (r, g, *_) in enumerate(rows)], "id int, reference string, generated string"
    )
    return {r["id"]: r for r in score_detail({"m": df}).collect()}


def test_golden_metrics(spark):
    got = _detail(spark, GOLDEN)
    for i, (_, _, em, bleu, r1, r2, rl) in enumerate(GOLDEN):
        row = got[i]
        assert row["EM"] == em, i
        assert row["BLEU"] == pytest.approx(bleu, abs=1e-6), i
        assert row["ROUGE-1"] == pytest.approx(r1, abs=1e-6), i
        assert row["ROUGE-2"] == pytest.approx(r2, abs=1e-6), i
        assert row["ROUGE-L"] == pytest.approx(rl, abs=1e-6), i


def test_python_helpers_match_golden():
    for ref, gen, _, bleu, _, _, rl in GOLDEN:
        ref, gen = ref or "nan", gen or "nan"
        assert sentence_bleu(ref, gen) == pytest.approx(bleu, abs=1e-6)
        assert rouge_l_summary(ref, gen) == pytest.approx(rl, abs=1e-6)


_BLEU_TEXTS = st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "c", "d."]), max_size=12).map(" ".join))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(_BLEU_TEXTS, _BLEU_TEXTS), max_size=12), st.sampled_from([1, 30, 1 << 22]))
def test_bleu_of_a_batch_is_that_of_its_pairs(pairs, chars):
    before, metrics._BLEU_CHARS = metrics._BLEU_CHARS, chars
    try:
        got = batch_bleu([r for r, _ in pairs], [h for _, h in pairs])
    finally:
        metrics._BLEU_CHARS = before
    assert got == [None if r is None or h is None else sentence_bleu(r, h) for r, h in pairs]


def test_bleu_of_a_very_long_pair():
    ref, hyp = "w x " * 100_000, "x w y " * 60_000
    assert batch_bleu([ref, "a"], [hyp, "a"]) == [sentence_bleu(ref, hyp), sentence_bleu("a", "a")]


def test_undefined_rouge_is_null_or_zero(spark):
    df = spark.createDataFrame([("x", "."), ("x", " "), ("...", "x")], "reference string, generated string")
    rows = score_detail({"m": df}).collect()
    for r in rows:
        assert r["EM"] == 0 and r["BLEU"] == 0.0
        assert r["ROUGE-1"] is None and r["ROUGE-2"] is None and r["ROUGE-L"] is None
    z = score_detail({"m": df}, on_empty="zero").collect()
    assert all(r["ROUGE-L"] == 0.0 and r["ROUGE-1"] == 0.0 for r in z)


def test_null_policies(spark):
    df = spark.createDataFrame([("NA", None), ("a", "")], "reference string, generated string")
    parity = {r["reference"]: r for r in score_detail({"m": df}).collect()}
    assert parity["NA"]["EM"] == 1  # both read as the word nan
    assert parity["a"]["EM"] == 0
    keep = score_detail({"m": df}, null_policy="null").collect()
    for r in keep:
        missing = r["generated"] is None
        assert (r["EM"] is None) == missing and (r["BLEU"] is None) == missing and r["_undefined"]
    assert summarize(score_detail({"m": df}, null_policy="null"), with_undefined=True).first()["n_undefined"] == 2
    zero = score_detail({"m": df}, null_policy="null", on_empty="zero").collect()
    assert sorted(str(r["ROUGE-L"]) for r in zero) == ["0.0", "None"]


def test_separators_inside_words(spark):
    rows = [("x\u0001y z", "x y\u0001z"), ("\uffff a", ". . a"), ("\uffff0 b", "\uffff b"), ("a. \uffff", "a. \uffff")]
    df = spark.createDataFrame(rows, "reference string, generated string")
    got = {(r["reference"], r["generated"]): r for r in score_detail({"m": df}).collect()}
    assert got[rows[0]]["ROUGE-2"] == 0
    assert got[rows[1]]["ROUGE-1"] == pytest.approx(0.5, abs=1e-6)
    assert got[rows[2]]["ROUGE-1"] == pytest.approx(0.5, abs=1e-6)
    assert got[rows[3]]["ROUGE-1"] == pytest.approx(1.0, abs=1e-6)


def test_rouge_l_of_long_texts_in_bounded_memory():
    import random
    import tracemalloc

    from lexigen.functions.metrics import _lcs_words

    rnd = random.Random(1)
    x = [f"w{rnd.randrange(500)}" for _ in range(20_000)]
    y = [f"w{rnd.randrange(500)}" for _ in range(20_000)]
    tracemalloc.start()
    assert _lcs_words(x, y) <= set(x) & set(y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6  # every 800th row, and the bits of one band
    assert _lcs_words(x, ["elsewhere"] * 20_000) == set()


def test_properties_on_conversations(spark):
    from conftest import SF_MID
    from lexigen.plans.catalog import predictions

    d = score_detail(predictions(spark, SF_MID))
    bad = d.filter(
        ((F.col("EM") == 1) & (F.col("`ROUGE-1`") < 0.999999))
        | (F.col("BLEU") < 0) | (F.col("BLEU") > 1)
        | (F.col("`ROUGE-L`") < 0) | (F.col("`ROUGE-L`") > 1.000001)
    )
    assert bad.count() == 0
    # ROUGE-1/2 are symmetric in the two sides
    p = predictions(spark, SF_MID)
    a = score_detail(p, metrics=["ROUGE-1", "ROUGE-2"]).select("model", "case_id", "`ROUGE-1`", "`ROUGE-2`")
    b = score_detail(
        p.withColumnRenamed("reference", "g").withColumnRenamed("generated", "reference").withColumnRenamed("g", "generated"),
        metrics=["ROUGE-1", "ROUGE-2"],
    ).select("model", "case_id", F.col("`ROUGE-1`").alias("s1"), F.col("`ROUGE-2`").alias("s2"))
    j = a.join(b, ["model", "case_id"])
    assert j.filter((F.abs(F.col("`ROUGE-1`") - F.col("s1")) > 1e-12) | (F.abs(F.col("`ROUGE-2`") - F.col("s2")) > 1e-12)).count() == 0


def test_summary_skips_nan_and_is_partition_independent(spark):
    from conftest import SF_SMALL
    from lexigen.plans.catalog import predictions

    p = predictions(spark, SF_SMALL)
    s1 = sorted(tuple(r) for r in evaluate(p.repartition(1))[1].collect())
    s16 = sorted(tuple(r) for r in evaluate(p.repartition(16))[1].collect())
    assert len(s1) == 2
    for a, b in zip(s1, s16):
        assert a[:2] == b[:2]
        assert all(x == pytest.approx(y, abs=1e-12) for x, y in zip(a[2:], b[2:]))
    df = spark.createDataFrame([("m", float("nan")), ("m", 1.0)], "model string, BLEU double")
    assert summarize(df).collect()[0]["BLEU"] == 1.0


def test_lcs_numpy_table_equals_loop():
    import random

    from lexigen.functions import metrics as M

    rnd = random.Random(7)
    for _ in range(200):
        x = [rnd.choice("abcde") for _ in range(rnd.randint(1, 90))]
        y = [rnd.choice("abcde") for _ in range(rnd.randint(1, 90))]
        old = M._NUMPY_CELLS
        try:
            M._NUMPY_CELLS = 10**12
            slow = M._lcs_words(x, y)
            M._NUMPY_CELLS = 0
            fast = M._lcs_words(x, y)
        finally:
            M._NUMPY_CELLS = old
        assert slow == fast


def test_back_trace_in_bands_equals_the_whole_table(monkeypatch):
    import random

    from lexigen.functions import metrics as M

    rnd = random.Random(3)
    for n, m in [(70, 90), (300, 40), (41, 500), (200, 200), (1000, 7)] * 4:
        x, y = ([f"w{rnd.randrange(rnd.choice([3, 30]))}" for _ in range(k)] for k in (n, m))
        monkeypatch.setattr(M, "_NUMPY_CELLS", 1 << 30)
        want = M._lcs_words(x, y)
        monkeypatch.setattr(M, "_NUMPY_CELLS", 0)
        assert M._lcs_words(x, y) == want
        monkeypatch.setattr(M, "_BAND_CELLS", 0)
        assert M._lcs_words(x, y) == want
        monkeypatch.undo()


def test_means_do_not_depend_on_order(spark):
    import math
    import random

    rnd = random.Random(5)
    values = {
        "spread": [rnd.random() * 10.0 ** rnd.randrange(-30, 1) for _ in range(4000)],
        "signed": [rnd.gauss(0, 1e6) for _ in range(4000)],
        "cancels": [1e15, 1e-3, -1e15, 1e-3] * 500,
        "gaps": [None, float("nan"), 0.1, 0.2, 0.7],
        "none": [None, float("nan")],
        "huge": [1e300, 1.0],
    }
    rows = [(m, v) for m, vs in values.items() for v in vs]
    seen = []
    for parts in (1, 16, 211):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "model string, BLEU double").repartition(parts)
        seen.append({r["model"]: r["BLEU"] for r in summarize(df).collect()})
    assert seen[0] == seen[1] == seen[2]
    for m in ("spread", "signed", "cancels"):
        assert seen[0][m] == pytest.approx(math.fsum(values[m]) / len(values[m]), rel=4e-16)
    assert seen[0]["gaps"] == pytest.approx(1 / 3, rel=4e-16) and seen[0]["none"] is None and seen[0]["huge"] == 5e299


def test_rouge_l_fills_few_tables(monkeypatch):
    """A pair of sentences that can add no word, equal sentences and a single shared word need no table; the union is that of all pairs."""
    import itertools
    import random

    rnd, tables = random.Random(5), []
    lcs = metrics._lcs_words
    monkeypatch.setattr(metrics, "_lcs_words", lambda x, y: tables.append(1) or lcs(x, y))
    for size in (3, 8, 40, 400):
        for _ in range(40):
            words = [f"w{i}" for i in range(size)] + [""]
            sides = [[rnd.choices(words, k=rnd.randrange(1, 12)) for _ in range(rnd.randrange(1, 9))] for _ in range(2)]
            if rnd.random() < 0.5:  # the reference with some words replaced
                sides[1] = [[w if rnd.random() < 0.8 else "x" for w in s] for s in sides[0]]
            want = set().union(*(lcs(r, h) for r, h in itertools.product(*sides)))
            assert metrics._lcs_union(*sides) == want
    tables.clear()
    text = ". ".join(" ".join(f"w{rnd.randrange(60)}" for _ in range(10)) for _ in range(25))
    noisy = " ".join("x" if i % 7 == 6 else w for i, w in enumerate(text.split()))
    assert rouge_l_summary(text, text) == pytest.approx(1.0) and not tables
    assert 0 < rouge_l_summary(text, noisy) < 1 and len(tables) < 60  # of 625 pairs
