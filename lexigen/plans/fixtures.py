"""Stand-in inputs derived by Spark from the given tables.

The reference's own data (radiology cases, model outputs, a training log) is
not public, so each of its tables is derived from a given table of the same
shape. Every derivation is a plain relational plan that grows with its input;
the same derivations are written in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigen.functions.text import WS_CLASS, strip, tokens
from lexigen.session import dealt, spread


# Tables whose rows carry long text; CPU work on them is worth spreading.
TEXT_TABLES = {"documents", "conversations", "pages", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A given table, pruned to ``columns``. Text tables are spread over the cores
    when the file reads as fewer splits than cores (pruning first keeps the
    spread small); for short numeric rows a shuffle would cost more than it saves."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return spread(df) if name in TEXT_TABLES else df


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn followed by an assistant turn -> (case_id, input_findings, output_impression).

    Joined on the unique (conv_id, turn) pair, so one very long conversation
    still spreads over all shuffle partitions. Cases are scored and generated from row
    by row, so they are dealt over tasks by the number of turns (counted from the
    file's metadata, no column is read).
    """
    conv = table(spark, sf_dir, "conversations")
    n_turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").count()
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input_findings"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output_impression")
    )
    found = u.join(a, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"),
        "input_findings",
        "output_impression",
    )
    return dealt(found, n_turns)


def case_form() -> Column:
    """A number from the digits of a case id (not unique), to choose which form a row's text gets."""
    return F.replace("case_id", F.lit("-"), F.lit("")).cast("bigint")


def finetuned_predictions(cases_df: DataFrame) -> DataFrame:
    """Stand-in for the tuned model's output: mostly the whole reference with
    every 7th word replaced, some exact copies, empties and nulls."""
    toks = tokens("output_impression")
    noisy = F.array_join(
        F.transform(toks, lambda t, i: F.when((i + 1) % 7 == 0, F.lit("x")).otherwise(t)), " "
    )
    cid = case_form()
    gen = (
        F.when(cid % 19 == 0, F.col("output_impression"))
        .when(cid % 23 == 0, F.lit(""))
        .when(cid % 29 == 0, F.lit(None).cast("string"))
        .otherwise(noisy)
    )
    return cases_df.select(
        "case_id", F.col("input_findings").alias("prompt"), F.col("output_impression").alias("reference"),
        gen.alias("generated"),
    )


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, marked): whole pages, whose html holds braces and double quotes, with brackets,
    single quotes, backslashes and ``Output:`` worked in."""
    pages = table(spark, sf_dir, "pages")
    html = F.coalesce("html", F.lit(""))
    n = F.col("page_id") % 4
    marked = (
        F.when(n == 0, F.concat(F.lit("Output: ['"), html, F.lit("'] Output: "), html, F.lit(" [\\x] tail")))
        .when(n == 1, F.replace(F.replace(html, F.lit("<p>"), F.lit("[")), F.lit("</p>"), F.lit("]")))
        .when(n == 2, F.replace(F.replace(html, F.lit('"'), F.lit("'")), F.lit(" "), F.lit("\\ ")))
        .otherwise(F.concat(F.lit(" \t"), html, F.lit("\n")))
    )
    return pages.select("page_id", marked.alias("marked"))


def odd_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, prompt, reference, generated) with sides that metrics treat apart: missing, blank, dots only,
    cells a CSV reader takes for missing, control characters inside words."""
    c = cases(spark, sf_dir)
    ref, gen = F.col("output_impression"), F.col("input_findings")
    k = case_form() % 12
    glue = lambda t: F.replace(t, F.lit(" "), F.lit("\u0001"))
    reference = F.when(k == 0, None).when(k == 1, "...").when(k == 2, "NA").when(k == 3, "  ").when(k == 4, glue(ref)).when(k == 5, F.concat(F.lit("\uffff "), ref)).otherwise(ref)
    generated = (
        F.when(k == 0, "None").when(k == 1, ref).when(k == 2, None).when(k == 3, ".").when(k == 4, F.concat(ref, F.lit(" "), glue(ref)))
        .when(k == 5, F.concat(F.lit("\uffff . . "), ref)).when(k == 6, "").when(k == 7, ref).when(k == 8, F.concat(F.lit(" "), ref, F.lit("\t"))).when(k == 9, "nan")
        .otherwise(gen)
    )
    return c.select("case_id", gen.alias("prompt"), reference.alias("reference"), generated.alias("generated"))


def _clean_items(c) -> Column:
    """Reference sentences with quote, bracket and backslash characters removed
    and all whitespace turned into spaces (not stripped)."""
    pieces = F.split(c, r"\.", -1)
    return F.transform(
        pieces, lambda p: F.regexp_replace(F.regexp_replace(p, r"['\"\[\]\\]", ""), WS_CLASS, " ")
    )


def list_raw(cases_df: DataFrame) -> DataFrame:
    """Model-output texts in nine list forms with known parses.

    ``expected`` is what a correct parser must return, joined by ``|``.
    """
    items = _clean_items(F.col("output_impression"))
    q1 = F.array_join(F.transform(items, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", ")
    q2 = F.array_join(F.transform(items, lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ", ")
    adj = F.array_join(F.transform(items, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), " ")
    plain = F.concat(F.lit("["), q1, F.lit("]"))
    k = case_form() % 9
    raw = (
        F.when(k == 0, plain)
        .when(k == 1, F.concat(F.lit("Some text Output: ['junk'] Output: "), plain))
        .when(k == 2, F.concat(F.lit("[bad] then "), plain))
        .when(k == 3, F.concat(F.lit("["), q1, F.lit(",] tail ['zzz']")))
        .when(k == 4, F.concat(F.lit("[1, None, '', "), q1, F.lit("]")))
        .when(k == 5, F.concat(F.lit("[["), q1, F.lit("], 'tail']")))
        .when(k == 6, F.concat(F.lit("no list here: "), F.array_join(items, " ")))
        .when(k == 7, F.concat(F.lit("["), adj, F.lit("]")))
        .otherwise(F.concat(F.lit("["), q2, F.lit("]")))
    )
    kept = F.filter(F.transform(items, strip), lambda s: s != F.lit(""))
    glued = strip(F.array_join(items, ""))
    expected = (
        F.when(k.isin(5, 6), F.array().cast("array<string>"))
        .when(k == 4, F.concat(F.array(F.lit("1"), F.lit("None")), kept))
        .when(k == 7, F.when(glued == "", F.array().cast("array<string>")).otherwise(F.array(glued)))
        .otherwise(kept)
    )
    return cases_df.select("case_id", raw.alias("raw"), F.array_join(expected, "|").alias("expected"))


def judge_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge-output texts in eleven dictionary forms built from ``labels``."""
    lab = table(spark, sf_dir, "labels")
    v = (F.col("quality") * 3 + F.col("toxic") * 2).cast("string")
    k = F.col("doc_id") % 11
    from lexigen.functions.prompts import SCORE_COLUMNS

    full = F.concat(
        F.lit("{"),
        F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), v) for c in SCORE_COLUMNS]),
        F.lit("}"),
    )
    raw = (
        F.when(k == 0, full)
        .when(k == 1, F.concat(F.lit("ok {'coherence': "), (v.cast("int") + 6).cast("string"), F.lit("} end")))
        .when(k == 2, F.concat(F.lit("{'coherence': -"), (v.cast("int") + 1).cast("string"), F.lit("}")))
        .when(k == 3, F.concat(F.lit("{'coherence': "), v, F.lit(".9}")))
        .when(k == 4, F.concat(F.lit("{'coherence': '"), v, F.lit("'}")))
        .when(k == 5, F.concat(F.lit("{'coherence': '"), v, F.lit(".5'}")))
        .when(k == 6, F.lit("{'coherence': True, 'correctness': False}"))
        .when(k == 7, F.concat(F.lit("{'coherence': None, 'harmlessness_bias': "), v, F.lit("}")))
        .when(k == 8, F.lit("{'coherence': 1} {'coherence': 2}"))
        .when(k == 9, F.concat(F.lit("{'coherence': "), v, F.lit(",}")))
        .otherwise(F.concat(F.lit("{coherence: "), v, F.lit("}")))
    )
    return lab.select("doc_id", raw.alias("raw"))


def sft_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from the cases plus long documents cut in two halves of words."""
    c = cases(spark, sf_dir).select(
        F.concat(F.lit("c"), "case_id").alias("key"),
        F.col("input_findings").alias("prompt"), F.col("output_impression").alias("response"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("t"))
    h = F.floor(F.size("t") / 2).cast("int")
    d = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"),
        F.array_join(F.slice("t", 1, h), " ").alias("prompt"),
        F.array_join(F.slice("t", h + 1, F.size("t") - h), " ").alias("response"),
    )
    return c.unionByName(d)


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss log stand-in from ``events``: 7 epochs, NaN and zero losses included."""
    ev = table(spark, sf_dir, "events")
    loss = (
        F.when(F.col("event_id") % 10 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 10 == 1, F.lit(0.0))
        .otherwise(F.col("value"))
    )
    return ev.select(
        (F.col("user_id") % 7).cast("int").alias("epoch"), F.col("event_id").alias("step"), loss.alias("loss")
    )
