"""Per-row scoring and per-model summary of generated text (the evaluation job)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigen.functions.metrics import bleu4, exact_match, exact_mean, f_score, prepared, rouge_l_raw
from lexigen.functions.text import n_sentences, ngrams, rouge_words

METRICS = ["EM", "BLEU", "ROUGE-1", "ROUGE-2", "ROUGE-L"]


def with_model(df: DataFrame, name: str, col: str = "model") -> DataFrame:
    return df.withColumn(col, F.lit(name))


def stack_predictions(preds: DataFrame | Mapping[str, DataFrame], model_col: str = "model") -> DataFrame:
    """A dict of prediction tables -> one table tagged by model (bag union by name)."""
    if isinstance(preds, DataFrame):
        return preds
    out = None
    for name, df in preds.items():
        t = with_model(df, name, model_col)
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise ValueError("no prediction tables given")
    return out


def score_detail(
    preds: DataFrame | Mapping[str, DataFrame],
    reference: str = "reference",
    generated: str = "generated",
    null_policy: str = "literal_nan",
    on_empty: str = "null",
    metrics: list[str] | None = None,
) -> DataFrame:
    """Keep every input column and add EM, BLEU, ROUGE-1/2/L (one column each, so
    pruning a metric prunes its work).

    Shared intermediates (prepared text, sentence counts, word lists, n-gram
    sets, overlap sizes) are computed once each in their own projection; the
    metric formulas then only combine plain numeric columns. Written as one
    nested expression, each intermediate would be re-evaluated inside every
    conditional branch that uses it.
    """
    want = metrics or METRICS
    rouge_ns = [n for n, m in ((1, "ROUGE-1"), (2, "ROUGE-2")) if m in want]
    df = stack_predictions(preds)
    base = list(df.columns)
    df = df.select("*", prepared(reference, null_policy).alias("_ref"), prepared(generated, null_policy).alias("_gen"))
    df = df.select("*", n_sentences("_ref").alias("_sr"), n_sentences("_gen").alias("_sg"))
    # without a sentence on both sides, and so with a missing side too
    undefined = F.coalesce((F.col("_sr") == 0) | (F.col("_sg") == 0) | F.col("_ref").isNull() | F.col("_gen").isNull(), F.lit(True))
    missing = F.col("_ref").isNull() | F.col("_gen").isNull()
    if rouge_ns:
        df = df.select("*", rouge_words("_ref").alias("_wr"), rouge_words("_gen").alias("_wg"))
        df = df.select(
            "*",
            *[F.array_distinct(ngrams("_wg", n)).alias(f"_h{n}") for n in rouge_ns],
            *[F.array_distinct(ngrams("_wr", n)).alias(f"_r{n}") for n in rouge_ns],
        )
        df = df.select(
            "*",
            *[F.size(F.array_intersect(f"_h{n}", f"_r{n}")).alias(f"_o{n}") for n in rouge_ns],
            *[F.size(f"_h{n}").alias(f"_nh{n}") for n in rouge_ns],
            *[F.size(f"_r{n}").alias(f"_nr{n}") for n in rouge_ns],
        )

    def guard(v):
        if on_empty == "null":
            return F.when(undefined, F.lit(None).cast("double")).otherwise(v)
        if on_empty == "zero":
            return F.when(missing, F.lit(None).cast("double")).when(undefined, F.lit(0.0)).otherwise(v)
        raise ValueError(f"unknown on_empty {on_empty!r}")

    exprs = {
        "EM": lambda: exact_match("_ref", "_gen"),
        "BLEU": lambda: bleu4("_ref", "_gen"),
        "ROUGE-1": lambda: guard(f_score(F.col("_o1"), F.col("_nh1"), F.col("_nr1"))),
        "ROUGE-2": lambda: guard(f_score(F.col("_o2"), F.col("_nh2"), F.col("_nr2"))),
        "ROUGE-L": lambda: guard(rouge_l_raw("_ref", "_gen")),
    }
    cols = [exprs[m]().alias(m) for m in want]
    return df.select(*[F.col(f"`{c}`") for c in base], *cols, undefined.alias("_undefined"))


def summarize(detail: DataFrame, by: str = "model", with_undefined: bool = False) -> DataFrame:
    """``n_samples`` and the mean of each metric per model.

    Means skip missing values (as pandas does); NaN counts as missing. They are sums of whole
    numbers, so partitions and order do not change a bit of them.
    One partial + final hash aggregate: a model holding most rows costs one
    row per partition in the shuffle.
    """
    present = [m for m in METRICS if m in detail.columns]
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    aggs += [exact_mean(F.col(f"`{m}`")).alias(m) for m in present]
    if with_undefined and "_undefined" in detail.columns:
        aggs.append(F.count_if(F.col("_undefined")).alias("n_undefined"))
    return detail.groupBy(by).agg(*aggs)


def evaluate(
    preds: DataFrame | Mapping[str, DataFrame],
    null_policy: str = "literal_nan",
    on_empty: str = "null",
) -> tuple[DataFrame, DataFrame]:
    """Prediction tables -> (detail, summary)."""
    detail = score_detail(preds, null_policy=null_policy, on_empty=on_empty)
    return detail.drop("_undefined"), summarize(detail)
