"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as
Parquet and read again as the next stage's docs. All stages but the last return the
columns of documents, in their order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigen.llm.common import by_ids, free_name, text_batches
from lexigen.llm.line_dedup import dedup_lines
from lexigen.llm.line_quality import judge_lines, reject
from lexigen.llm.minhash import near_duplicates, words_key
from lexigen.llm.packing import pack_documents
from lexigen.llm.queries import learnable, table
from lexigen.llm.toxicity import reject_toxic, score_toxicity
from lexigen.session import materialize, ship_package


#: Lines in so few distinct texts of a host may be there by chance; beyond, the share of the host's texts decides.
FEW_TEXTS = 5


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    text_batches(spark)


def _columns(docs: DataFrame):
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted by lines frequent on their host (in over
    ``FEW_TEXTS`` distinct texts and 2 % of the host's) go; the others stay as they are."""
    _prepare(spark)
    return reject(docs, judge_lines(docs, min_docs=FEW_TEXTS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above their language's threshold go."""
    _prepare(spark)
    return reject_toxic(docs, score_toxicity(docs, learnable(table(spark, sf_dir, "labels"))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays, with n_chars as its text
    now is. Null texts stay null. As this comes before near-duplicates, a group of ten or more copies
    loses every line in every copy: no copy keeps the text, and all stay on as empty documents."""
    _prepare(spark)
    rest, before = [c for c in docs.columns if c not in ("doc_id", "text")], free_name(docs, "before_dedup")
    # the other columns travel in one, so that none can clash with a new one
    packed = F.struct(F.lit(1).alias(before), *(F.col(f"`{c}`") for c in rest)).alias(before)
    done = dedup_lines(docs.select("doc_id", "text", packed))
    new = {c: F.col(f"{before}.`{c}`") for c in rest} | {"doc_id": F.col("doc_id"), "text": F.when(F.col("text").isNotNull(), F.col("dedup_text"))}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("dedup_dropped") > 0, F.char_length("dedup_text").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return done.select(*(new[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five-word shingles, 80 %) the smallest id stays. Of rows equal in id and
    words the least stays (in the order of the columns); rows of one id with other words all stay or go together, rows
    without an id stay. Empty texts are linked with nothing, so all ids of them stay."""
    _prepare(spark)
    key = free_name(docs, "words_key")
    # an id and its words; null ids stand apart, as they are linked with nothing
    keyed = docs.withColumn(key, words_key(F.col("text")))
    judged = near_duplicates(docs)
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    left = by_ids(keyed, gone, "doc_id", "left_anti")
    own = keyed.filter("doc_id IS NOT NULL").groupBy("doc_id", key)
    if not own.agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        whole = F.struct(*(F.col(f"`{c}`") for c in keyed.columns))
        order = F.struct(*(F.col(f"`{f.name}`") for f in keyed.schema if not re.search("map<|variant", f.dataType.simpleString())))
        one = left.filter("doc_id IS NOT NULL").groupBy("doc_id", key).agg(F.min_by(whole, order).alias("row")).select("row.*")
        left = one.unionByName(left.filter("doc_id IS NULL"))
    return left.select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of 4096 tokens."""
    _prepare(spark)
    return pack_documents(docs, max_tokens=4096)


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("packing", packing),
]

#: The classifier, the tokenizer and packing have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
