"""List generation (few-shot) and rubric judging as one DataFrame lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigen.functions.parse import parse_list, parse_scores
from lexigen.functions.prompts import SCORE_COLUMNS, render_fewshot_prompt, render_judge_prompt
from lexigen.functions.text import list_repr
from lexigen.operators.infer import GENERATION_BATCH_SIZE, batch_generate


def generate_impressions(
    cases: DataFrame,
    factory: Callable,
    findings: str = "input_findings",
    out_col: str = "generated_impression",
    examples=None,
    batch_size: int = GENERATION_BATCH_SIZE,
) -> DataFrame:
    """Every case column plus ``generated_impression: array<string>``."""
    x = cases.withColumn("_prompt", render_fewshot_prompt(findings, examples))
    raw = batch_generate(x, "_prompt", "_raw", factory, batch_size)
    return raw.withColumn(out_col, parse_list("_raw")).drop("_prompt", "_raw")


def judge(
    df: DataFrame,
    factory: Callable,
    generated: str = "generated_impression",
    reference: str = "output_impression",
    batch_size: int = GENERATION_BATCH_SIZE,
) -> DataFrame:
    """Adds the eight rubric scores (0..5 or null). An ``array<string>`` generated
    column is shown to the judge as its Python list text, as a CSV hand-off would."""
    gen_t = df.schema[generated].dataType.simpleString()
    gen_text = list_repr(generated) if gen_t.startswith("array") else F.col(generated)
    x = df.withColumn("_prompt", render_judge_prompt(gen_text, reference))
    raw = batch_generate(x, "_prompt", "_raw", factory, batch_size)
    scored = raw.withColumn("_s", parse_scores("_raw")).drop("_prompt", "_raw")
    return scored.select("*", *[F.col("_s")[k].alias(k) for k in SCORE_COLUMNS]).drop("_s")


def judge_table(df: DataFrame, key: str = "case_id", generated: str = "generated_impression",
                reference: str = "output_impression") -> DataFrame:
    """Final column list: key, generated (as list text), reference, the 8 scores."""
    gen_t = df.schema[generated].dataType.simpleString()
    gen_text = list_repr(generated) if gen_t.startswith("array") else F.col(generated)
    return df.select(key, gen_text.alias(generated), reference, *SCORE_COLUMNS)
