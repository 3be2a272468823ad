"""Projections between the case table, the prompt/response pairs and prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_pairs(cases: DataFrame, key: str | None = "case_id") -> DataFrame:
    """``input_findings -> prompt``, ``output_impression -> response`` (key kept when present)."""
    keep = [key] if key and key in cases.columns else []
    return cases.select(*keep, F.col("input_findings").alias("prompt"), F.col("output_impression").alias("response"))
