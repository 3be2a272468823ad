"""Scoring predictions as they arrive (Structured Streaming).

The per-row metrics are row-local, so the batch expressions apply to a
streaming DataFrame unchanged. The per-model summary is a running aggregate
whose state is one row per model; it runs in ``complete`` mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from lexigen.operators.evaluate import score_detail, summarize
from lexigen.sources.files import PRED_SCHEMA

STREAM_SCHEMA = StructType(list(PRED_SCHEMA.fields) + [StructField("model", StringType(), True)])


def read_prediction_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType = STREAM_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def detail_stream(preds: DataFrame, **kw) -> DataFrame:
    return score_detail(preds, **kw).drop("_undefined")


def summary_stream(preds: DataFrame, **kw) -> DataFrame:
    return summarize(score_detail(preds, **kw))


def start_scoring(
    preds: DataFrame,
    detail_path: str,
    checkpoint: str,
    summary_table: str | None = None,
    summary_path: str | None = None,
    available_now: bool = True,
) -> list[StreamingQuery]:
    """Append scored rows to Parquet; keep the running per-model summary as a
    Parquet table rewritten each micro-batch (``summary_path``) and/or an
    in-session table (``summary_table``). Checkpoints make every query
    restartable after a failure."""
    base = checkpoint.rstrip("/")

    def trig(w):
        return w.trigger(availableNow=True) if available_now else w

    w = detail_stream(preds).writeStream.format("parquet").option("path", detail_path)
    out = [trig(w.option("checkpointLocation", f"{base}/detail").outputMode("append")).start()]
    if summary_path:
        def write_summary(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(summary_path)

        s = summary_stream(preds).writeStream.outputMode("complete").foreachBatch(write_summary)
        out.append(trig(s.option("checkpointLocation", f"{base}/summary_path")).start())
    if summary_table:
        s = summary_stream(preds).writeStream.outputMode("complete").format("memory").queryName(summary_table)
        out.append(trig(s.option("checkpointLocation", f"{base}/summary_table")).start())
    return out
