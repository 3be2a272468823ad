"""Batch generation over a DataFrame with a pluggable generator.

A *factory* is a picklable zero-argument callable returning a generator
``gen(prompts: list[str]) -> list[str]``; where ``max_new_tokens`` is set, it is called as
``gen(prompts, max_new_tokens=n)``. It runs once per Python worker (the
model is loaded once and kept in a module global for later tasks), then the
partition streams through in Arrow batches, sliced to ``batch_size`` prompts
per call. Rows keep all their columns, so no join is needed to re-attach
outputs. The shipped generators are deterministic stand-ins with no weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexigen.functions.prompts import (
    COMPLETION_HEAD,
    COMPLETION_TAIL,
    FEWSHOT_INPUT,
    FEWSHOT_TAIL,
    JUDGE_HEAD,
    JUDGE_MID,
    SCORE_COLUMNS,
    render_completion_prompt,
)

GENERATION_BATCH_SIZE = 8  # fixed value: prompts per generator call

_LOADED: dict = {}


def _generator(factory: Callable):
    key = getattr(factory, "cache_key", None)
    if key is None:
        return factory()
    if key not in _LOADED:
        _LOADED[key] = factory()
    return _LOADED[key]


def batch_generate(
    df: DataFrame,
    prompt_col: str,
    out_col: str,
    factory: Callable,
    batch_size: int = GENERATION_BATCH_SIZE,
    strip_output: bool = True,
    partitions: int | None = None,
    max_new_tokens: int | None = None,
) -> DataFrame:
    """Add ``out_col`` = generator(prompt) to every row.

    An iterator pandas UDF: the generator is built once per Python worker before
    the first batch, and only the prompt column travels to Python (the other
    columns stay in the JVM). It is marked non-deterministic so the optimizer
    never duplicates or re-orders the generation step.

    ``partitions`` spreads the prompts round-robin over that many tasks first
    (generation costs far more per row than reading, so scan-sized partitions
    would leave most workers idle); no key is involved, so no skew.
    """
    if partitions:
        df = df.repartition(partitions)

    limit = {} if max_new_tokens is None else {"max_new_tokens": max_new_tokens}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        gen = _generator(factory)
        for prompts_s in batches:
            prompts = prompts_s.tolist()
            outs: list = []
            for i in range(0, len(prompts), batch_size):
                outs.extend(gen(prompts[i : i + batch_size], **limit))
            if strip_output:
                outs = [None if o is None else o.strip() for o in outs]
            yield pd.Series(outs, dtype=object)

    udf = F.pandas_udf(run, StringType()).asNondeterministic()
    return df.withColumn(out_col, udf(F.col(prompt_col)))


def _checked_keys(df: DataFrame, key: str) -> None:
    """Keys say which rows are done, so each row needs one of its own."""
    own = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).first()
    if own is not None:
        raise ValueError(f"{key} has to be set and different in every row: {own[0]!r}")


def generate_missing(
    df: DataFrame,
    prompt_col: str,
    out_col: str,
    factory: Callable,
    path: str,
    key: str = "case_id",
    **how,
) -> DataFrame:
    """Add ``out_col`` like :func:`batch_generate`, keeping what is generated under ``path`` (a shared folder).

    Every task's file is committed as the task ends (Hadoop's second commit algorithm), so a run that breaks off keeps
    the partitions it finished, and a lost executor costs its running tasks. The next run reads the keys that are there and calls
    the generator for the others alone; a run over a table that has grown generates the new rows. Returns the rows of ``df`` with what
    ``path`` holds for them. Keys are set and unique; a key's prompt is taken not to change between runs.
    """
    _checked_keys(df, key)
    spark, out = df.sparkSession, StructField(out_col, StringType(), True)
    kept = StructType([df.schema[key], out])
    try:
        done = spark.read.schema(kept).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = None
    missing = df.select(key, prompt_col) if done is None else df.select(key, prompt_col).join(done.select(key), key, "left_anti")
    made = batch_generate(missing, prompt_col, out_col, factory, **how).select(key, out_col)
    made.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return df.join(spark.read.schema(kept).parquet(path), key)


def predict(
    pairs: DataFrame,
    factory: Callable,
    model: str | None = None,
    key: str | None = "case_id",
    batch_size: int = GENERATION_BATCH_SIZE,
    max_new_tokens: int | None = None,
    resume: str | None = None,
) -> DataFrame:
    """pairs(prompt, response) -> (key, prompt, reference, generated[, model]). With ``resume``, a shared folder,
    a broken run is taken up where it ended (:func:`generate_missing`)."""
    keep = [key] if key and key in pairs.columns else []
    x = pairs.select(*keep, "prompt", F.col("response").alias("reference"),
                     render_completion_prompt("prompt").alias("_input"))
    if resume is None:
        out = batch_generate(x, "_input", "generated", factory, batch_size, max_new_tokens=max_new_tokens).drop("_input")
    else:
        out = generate_missing(x, "_input", "generated", factory, resume, key, batch_size=batch_size, max_new_tokens=max_new_tokens).drop("_input")
    return out if model is None else out.withColumn("model", F.lit(model))


def attach(df: DataFrame, outputs: DataFrame, on: str = "case_id") -> DataFrame:
    """Left-join outputs to their inputs on a key. A key that ``outputs`` holds twice is an
    error, raised by the plan itself when it runs."""
    rest = [c for c in outputs.columns if c != on]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    one = outputs.filter(F.col(on).isNotNull()).groupBy(on).agg(F.first(row).alias("__row"), F.count(F.lit(1)).alias("__n"))
    twice = F.raise_error(F.concat(F.lit(f"outputs hold {on} twice: "), F.col(on).cast("string")))
    checked = one.select(on, F.when(F.col("__n") > 1, twice).otherwise(F.col("__row")).alias("__row"))
    return df.join(checked, on, "left").select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__row.`{c}`").alias(c) for c in rest])


# ------------------------------------------------------- stand-in generators


def _between(text: str, head: str, tail: str, last: bool = True) -> str:
    i = text.find(head)
    start = 0 if i < 0 else i + len(head)
    j = text.rfind(tail) if last else text.find(tail, start)
    return text[start:] if j < start else text[start:j]


class EveryNthWord:
    """Stand-in completion model: every ``n``-th word of the whole findings."""

    def __init__(self, n: int = 8):
        self.n = n
        self.cache_key = ("every", n)

    def __call__(self):
        n = self.n

        def gen(prompts, max_new_tokens=None):
            return [" ".join(_between(p, COMPLETION_HEAD, COMPLETION_TAIL).split()[::n][:max_new_tokens]) for p in prompts]

        return gen


class ListEcho:
    """Stand-in list model: the first sentences of the findings as a Python list."""

    def __init__(self, max_items: int | None = None):
        self.max_items = max_items
        self.cache_key = ("list", max_items)

    def __call__(self):
        n = self.max_items

        def one(p: str) -> str:
            f = _between(p, FEWSHOT_INPUT, FEWSHOT_TAIL)
            items = [s.replace("[", "").replace("]", "").strip() for s in f.split(".")]
            items = [s for s in items if s]
            return repr(items if n is None else items[:n])

        return lambda prompts: [one(p) for p in prompts]


class BatchSize:
    """Stand-in that answers each prompt with the number of prompts in its call."""

    cache_key = ("batch",)

    def __call__(self):
        return lambda prompts: [str(len(prompts))] * len(prompts)


class RubricEcho:
    """Stand-in judge: scores derived from the length of the judged text."""

    cache_key = ("rubric",)

    def __call__(self):
        def one(p: str) -> str:
            g = _between(p, JUDGE_HEAD, JUDGE_MID, last=False)
            scores = {k: (len(g) + i) % 7 for i, k in enumerate(SCORE_COLUMNS)}
            return "Scores: " + str(scores) + " done"

        return lambda prompts: [one(p) for p in prompts]
