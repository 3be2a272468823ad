"""Readers and writers for the hand-off files: prompt/response JSON, prediction
CSV, scored detail and summary tables.

Every read declares its schema. Multi-line JSON arrays and CSV with quoted
newlines are not splittable (one task per file); for large inputs write JSON
Lines or Parquet, which split by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexigen.functions.text import list_repr
from lexigen.session import materialize

PAIR_SCHEMA = StructType([StructField("prompt", StringType(), True), StructField("response", StringType(), True)])
PRED_SCHEMA = StructType(
    [
        StructField("prompt", StringType(), True),
        StructField("reference", StringType(), True),
        StructField("generated", StringType(), True),
    ]
)


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table with a check in its plan: a missing value in one of the columns is an error."""
    for name in columns:
        c = F.col(f"`{name}`")
        checked = F.when(c.isNull(), F.raise_error(F.lit(f"missing value in {name!r}"))).otherwise(c)
        df = df.withColumn(name, checked)
    return df


def read_pairs(spark: SparkSession, path: str, multiline: bool = True, need: tuple[str, ...] = ("prompt",)) -> DataFrame:
    """A JSON array of ``{prompt, response}`` (``multiline``) or JSON Lines.

    Input that is no such JSON stops the read, and so does a missing value in one of the
    ``need`` columns. A bare ``NaN`` is a missing value (Spark reads it as the text ``NaN``,
    which is therefore taken for missing as well)."""
    df = spark.read.schema(PAIR_SCHEMA).option("multiLine", multiline).option("mode", "FAILFAST").json(path)
    known = df.select(*[F.when(F.col(c) != "NaN", F.col(c)).alias(c) for c in df.columns])
    return required(known, list(need))


def read_predictions(spark: SparkSession, path: str, model: str | None = None, columns: tuple[str, ...] = tuple(PRED_SCHEMA.names)) -> DataFrame:
    """Prediction CSV with a header; quoted cells may hold commas, quotes and newlines.

    Columns go by their names, in any order, and must all be there; further ones are left out. A
    row with too many or too few cells stops the read. An empty cell reads as null (as a
    pandas reader makes it missing)."""
    df = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .csv(path)
    )
    if lack := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no column {', '.join(lack)} in {path}")
    df = df.select(*[F.col(f"`{c}`") for c in columns])
    return df if model is None else df.withColumn("model", F.lit(model))


def _csv_ready(df: DataFrame) -> DataFrame:
    """Array-of-string columns become their Python list text (CSV holds no arrays)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType):
            cols.append(list_repr(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with a header CSV that ``read_predictions`` reads back."""
    (
        _csv_ready(df).write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_pairs(df: DataFrame, path: str) -> None:
    """prompt/response as JSON Lines (one object per line, splittable)."""
    df.select("prompt", "response").write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    out = df.select("prompt", "reference", "generated")
    if fmt == "csv":
        write_csv(out, path)
    else:
        out.write.mode("overwrite").format(fmt).save(path)


def write_report(detail: DataFrame, out_dir: str, fmt: str = "csv", by: str = "model") -> None:
    """``detail`` and its ``summary`` side by side. The detail is stored once in the shared
    scratch folder and both come from that copy, so every row is generated and scored once."""
    from lexigen.operators.evaluate import summarize

    base = out_dir.rstrip("/")
    stored = materialize(detail, "report")
    for name, table in (("detail", stored), ("summary", summarize(stored, by))):
        if fmt == "csv":
            write_csv(table, f"{base}/{name}")
        else:
            table.write.mode("overwrite").format(fmt).save(f"{base}/{name}")
