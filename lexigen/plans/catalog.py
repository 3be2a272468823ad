"""Registered queries: one per operator family, each reading the given tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the SQL in ``lexigen.plans.oracle``. Doubles are rounded with
``round6`` and arrays are shown as joined text so results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigen.functions import metrics as M
from lexigen.functions import prompts as P
from lexigen.functions import text as T
from lexigen.functions.parse import parse_list, parse_scores
from lexigen.functions.prompts import SCORE_COLUMNS
from lexigen.operators import evaluate as E
from lexigen.operators import infer as I
from lexigen.operators import judge as J
from lexigen.operators import pairs as PA
from lexigen.operators import sft as S
from lexigen.operators import split as SP
from lexigen.operators.training_log import training_rollup
from lexigen.plans import fixtures as FX
from lexigen.session import scratch_path, ship_package
from lexigen.sources import files as IO

SPLIT_SEED = 42
TEST_FRACTION = 0.2
TRAIN_BATCH = 6
EPOCHS = 7
SHORT_PROMPT = 400
BASELINE_STRIDE = 8
VOCAB_SIZE = 1000
NEW_TOKENS = 7
EOS = "</s>"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Baseline (stand-in generator through batch inference) and tuned stand-in, stacked."""
    ship_package(spark)
    cases = FX.cases(spark, d)
    base = I.predict(PA.to_pairs(cases), I.EveryNthWord(BASELINE_STRIDE))
    tuned = FX.finetuned_predictions(cases)
    return E.stack_predictions({"baseline": base, "finetuned": tuned})


def _r6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[M.round6(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def q_eval_summary(spark, d):
    detail, summary = E.evaluate(predictions(spark, d))
    return _r6(summary, E.METRICS)


def q_eval_detail(spark, d):
    detail = E.score_detail(predictions(spark, d))
    return _r6(detail.select("model", "case_id", *[F.col(f"`{m}`") for m in E.METRICS]), E.METRICS[1:])


def q_metric_em_rouge12(spark, d):
    detail = E.score_detail(predictions(spark, d), metrics=["EM", "ROUGE-1", "ROUGE-2"])
    return _r6(detail.select("model", "case_id", "EM", "`ROUGE-1`", "`ROUGE-2`"), ["ROUGE-1", "ROUGE-2"])


def q_metric_bleu(spark, d):
    detail = E.score_detail(predictions(spark, d), metrics=["BLEU"])
    return _r6(detail.select("model", "case_id", "BLEU"), ["BLEU"])


def q_metric_rouge_l(spark, d):
    detail = E.score_detail(predictions(spark, d), metrics=["ROUGE-L"])
    return _r6(detail.select("model", "case_id", "`ROUGE-L`"), ["ROUGE-L"])


def q_predict_baseline(spark, d):
    ship_package(spark)
    return I.predict(PA.to_pairs(FX.cases(spark, d)), I.EveryNthWord(BASELINE_STRIDE))


def q_predict_resumed(spark, d):
    """A run over the short prompts, taken up by a run over all: what is there is not generated again."""
    ship_package(spark)
    pairs, path = PA.to_pairs(FX.cases(spark, d)), scratch_path(spark, "predictions")
    I.predict(pairs.filter(F.length("prompt") < SHORT_PROMPT), I.EveryNthWord(BASELINE_STRIDE), resume=path)
    return I.predict(pairs, I.EveryNthWord(BASELINE_STRIDE), resume=path)


def q_pairs(spark, d):
    return PA.to_pairs(FX.cases(spark, d))


def q_exact_split(spark, d):
    docs = FX.table(spark, d, "documents").select("doc_id")
    return SP.exact_split(docs, "doc_id", TEST_FRACTION, SPLIT_SEED)


def q_global_rank(spark, d):
    docs = FX.table(spark, d, "documents").select("doc_id")
    return SP.global_rank(docs, "doc_id", seed=SPLIT_SEED)


def q_rank_hot_key(spark, d):
    """Rank by a key of four values within groups, null one of them."""
    docs = FX.table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("kind"))
    return SP.global_rank(docs, "lang", ["kind"], total_col="n_rows", seed=SPLIT_SEED)


def q_split_copies(spark, d):
    """Split of rows that are copies of few: one key value holds most rows."""
    rows = SP.exact_split(FX.table(spark, d, "documents").select("lang", "source"), "lang", TEST_FRACTION, SPLIT_SEED)
    return rows.groupBy("lang", "source", "split").agg(F.count(F.lit(1)).alias("n_rows"))


def q_split_pairs(spark, d):
    """Preparation job: cases -> pairs -> exact 80/20 split, sizes per split."""
    pairs = SP.exact_split(PA.to_pairs(FX.cases(spark, d)), "case_id", TEST_FRACTION, SPLIT_SEED)
    return pairs.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(FX.case_form()).alias("sum_case_id"))


def q_split_lists(spark, d):
    """Split of rows that are a list of words, a struct and a map: copies and lists of like text stay apart."""
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    rows = FX.table(spark, d, "documents").select(
        words.alias("words"), F.struct("lang", F.col("n_chars").alias("size")).alias("facts"), F.create_map(F.lit("source"), "source").alias("tags")
    )
    split = SP.exact_split(rows, "words", TEST_FRACTION, SPLIT_SEED)
    return split.groupBy(F.md5(F.array_join("words", " ").cast("binary")).alias("words_md5"), F.col("facts.lang").alias("lang"), "split").agg(F.count(F.lit(1)).alias("n_rows"))


def q_rank_vectors(spark, d):
    """Rank by a list of numbers."""
    vectors = FX.table(spark, d, "embeddings")
    whole = F.transform("embedding", lambda x: F.floor(x * 1024).cast("long")).alias("cells")
    return SP.global_rank(vectors.select("vec_id", whole), "cells", seed=SPLIT_SEED).select("vec_id", "rank")


def q_assign_batches(spark, d):
    pairs = PA.to_pairs(FX.cases(spark, d)).select("case_id")
    return SP.assign_batches(pairs, "case_id", TRAIN_BATCH, EPOCHS, SPLIT_SEED)


def q_prompt_completion(spark, d):
    return FX.cases(spark, d).select("case_id", P.render_completion_prompt("input_findings").alias("prompt"))


def q_prompt_fewshot(spark, d):
    return FX.cases(spark, d).select("case_id", P.render_fewshot_prompt("input_findings").alias("prompt"))


def q_list_repr(spark, d):
    """Python's text for lists of the pieces of whole pages: quotes, braces and backslashes."""
    return FX.markup(spark, d).select("page_id", T.list_repr(F.split("marked", r"\.", -1)).alias("repr"))


def q_prompt_judge(spark, d):
    c = FX.cases(spark, d)
    gen = T.list_repr(F.split("input_findings", r"\.", -1))
    return c.select("case_id", P.render_judge_prompt(gen, "output_impression").alias("prompt"))


def q_impressions(spark, d):
    ship_package(spark)
    out = J.generate_impressions(FX.cases(spark, d), I.ListEcho())
    return out.select(
        "case_id", "input_findings", "output_impression",
        F.array_join("generated_impression", "|").alias("impressions"),
        F.size("generated_impression").alias("n_items"),
    )


def q_judge_scores(spark, d):
    ship_package(spark)
    gen = J.generate_impressions(FX.cases(spark, d), I.ListEcho())
    return J.judge_table(J.judge(gen, I.RubricEcho()))


def q_parse_list(spark, d):
    ship_package(spark)
    raw = FX.list_raw(FX.cases(spark, d))
    return raw.select("case_id", F.array_join(parse_list("raw"), "|").alias("parsed"))


def q_parse_scores(spark, d):
    ship_package(spark)
    raw = FX.judge_raw(spark, d)
    return raw.select("doc_id", parse_scores("raw").alias("s")).select(
        "doc_id", *[F.col("s")[k].alias(k) for k in SCORE_COLUMNS]
    )


def _sft(spark, d):
    pairs = FX.sft_input(spark, d)
    return S.sft_examples(pairs, key="key")


def q_sft_examples(spark, d):
    ex = _sft(spark, d)
    return ex.select(
        "key",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_attended"),
        F.size(F.filter("labels", lambda v: v != F.lit(S.IGNORE))).cast("long").alias("n_supervised"),
        F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
        F.md5(F.array_join("labels", ",")).alias("labels_md5"),
    )


def q_sft_supervised(spark, d):
    return S.drop_unsupervised(_sft(spark, d)).select("key")


def q_encode_prompt(spark, d):
    enc = S.encode_prompt(FX.sft_input(spark, d))
    return enc.select("key", F.col("prompt_len").cast("long").alias("prompt_len"),
                      F.md5(F.array_join("prompt_ids", ",")).alias("ids_md5"))


def q_length_profile(spark, d):
    pairs = FX.sft_input(spark, d).withColumn("source", F.substring("key", 1, 1))
    return S.length_profile(pairs, by="source")


def q_vocab(spark, d):
    docs = FX.table(spark, d, "documents")
    return S.build_vocab(docs, "text", VOCAB_SIZE).select("token", F.col("n").cast("long").alias("n"), "token_id")


def q_vocab_bounded(spark, d):
    """The same vocabulary from summaries of the partitions and a second count of the words left."""
    ship_package(spark)
    return S.build_vocab_bounded(FX.table(spark, d, "documents"), "text", VOCAB_SIZE).select("token", "n", "token_id")


def q_vocab_ids(spark, d):
    """Ids of all conversation turns and documents, empty, blank and null texts among them."""
    ship_package(spark)
    docs = FX.table(spark, d, "documents")
    vocab = S.build_vocab(docs, "text", VOCAB_SIZE)
    odd = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, None).when(F.col("doc_id") % 5 == 2, "  ").otherwise(F.col("text"))
    turns = FX.table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("key"), "text")
    texts = turns.unionByName(docs.select(F.concat(F.lit("d"), "doc_id").alias("key"), odd.alias("text")))
    ids = S.vocab_ids(texts, "key", "text", vocab)
    return ids.select("key", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def q_training_rollup(spark, d):
    r = training_rollup(FX.training_log(spark, d))
    return r.select("epoch", M.round6("mean_loss").alias("mean_loss"), "valid_steps", "skipped_steps")


def q_attach(spark, d):
    cases = FX.cases(spark, d)
    outs = FX.finetuned_predictions(cases).select("case_id", "generated")
    return I.attach(cases.select("case_id", "output_impression"), outs, "case_id")


def q_pairs_json_roundtrip(spark, d):
    """Pairs written as JSON Lines to the shared scratch folder and read back."""
    path = scratch_path(spark, "pairs_json")
    IO.write_pairs(PA.to_pairs(FX.cases(spark, d)), path)
    return IO.read_pairs(spark, path, multiline=False)


def q_predictions_csv_roundtrip(spark, d):
    """Predictions (with quotes, newlines, empty and missing cells) through CSV and back."""
    path = scratch_path(spark, "pred_csv")
    IO.write_predictions(FX.finetuned_predictions(FX.cases(spark, d)), path)
    return IO.read_predictions(spark, path)


def q_text_functions(spark, d):
    t = F.col("marked")
    return FX.markup(spark, d).select(
        "page_id",
        F.length(T.strip(t)).cast("long").alias("stripped_len"),
        F.size(T.tokens(t)).cast("long").alias("n_tokens"),
        F.md5(T.after_last(t, "Output:").cast("binary")).alias("after_output_md5"),
        F.size(T.bracket_spans(t)).cast("long").alias("n_bracket_spans"),
        F.md5(F.array_join(T.bracket_spans(t), "|").cast("binary")).alias("bracket_md5"),
        F.md5(T.brace_span(t).cast("binary")).alias("brace_md5"),
        F.md5(T.strip(T.nan_str(t)).cast("binary")).alias("scored_md5"),
    )


def q_edge_metrics(spark, d):
    """Scores of blank, dots-only, missing and separator-holding sides under both policies."""
    ship_package(spark)
    odd = FX.odd_predictions(spark, d)
    out = None
    for policy in ("literal_nan", "null"):
        part = E.score_detail(odd, null_policy=policy).withColumn("policy", F.lit(policy))
        out = part if out is None else out.unionByName(part)
    return _r6(out.select("policy", "case_id", *[f"`{m}`" for m in E.METRICS], F.col("_undefined").alias("undefined")), E.METRICS[1:])


def q_eval_from_csv(spark, d):
    """Predictions written as CSV, read back by name and scored: cells ``NA``, ``None``, blank and empty."""
    ship_package(spark)
    path = scratch_path(spark, "odd_csv")
    IO.write_predictions(FX.odd_predictions(spark, d).withColumn("prompt", F.col("case_id")), path)
    preds = IO.read_predictions(spark, path, model="csv")
    detail, _ = E.evaluate(preds)
    return _r6(detail.select(F.col("prompt").alias("case_id"), *[f"`{m}`" for m in E.METRICS]), E.METRICS[1:])


def q_impressions_csv(spark, d):
    """A table with a list column through CSV: the list as Python's text."""
    ship_package(spark)
    path = scratch_path(spark, "impressions_csv")
    IO.write_csv(J.generate_impressions(FX.cases(spark, d), I.ListEcho()).select("case_id", "generated_impression"), path)
    return IO.read_predictions(spark, path, columns=("case_id", "generated_impression"))


def q_judge_csv(spark, d):
    """The judge's table through CSV."""
    ship_package(spark)
    path = scratch_path(spark, "judge_csv")
    IO.write_csv(q_judge_scores(spark, d), path)
    columns = ("case_id", "generated_impression", "output_impression", *SCORE_COLUMNS)
    back = IO.read_predictions(spark, path, columns=columns)
    return back.select(*columns[:3], *[F.col(k).cast("int").alias(k) for k in SCORE_COLUMNS])


def q_report(spark, d):
    """Detail and summary written together; the summary read back."""
    ship_package(spark)
    path = scratch_path(spark, "report")
    IO.write_report(E.evaluate(predictions(spark, d))[0], path, fmt="parquet")
    return _r6(spark.read.parquet(f"{path}/summary"), E.METRICS)


def q_full_text(spark, d):
    """The training text: prompt, response and end mark."""
    text = P.full_text(P.render_completion_prompt("prompt"), "response", EOS)
    return FX.sft_input(spark, d).select("key", F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


def q_completion(spark, d):
    """Ids after the prompt in whole sequences of prompt and response."""
    pairs = FX.sft_input(spark, d)
    enc = S.encode_prompt(pairs, max_len=S.MAX_LEN)
    seq = enc.select("key", "prompt_len", F.concat("prompt_ids", S.hash_ids(F.coalesce("response", F.lit("nan")))).alias("out_ids"))
    done = seq.select("key", S.completion("out_ids", "prompt_len").alias("ids"))
    return done.select("key", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def q_sft_vocab(spark, d):
    """Fine-tuning examples with ids from a vocabulary."""
    ship_package(spark)
    vocab = S.build_vocab(FX.table(spark, d, "documents"), "text", VOCAB_SIZE)
    ex = S.sft_examples(FX.sft_input(spark, d), key="key", vocabulary=vocab)
    return ex.select("key", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.md5(F.array_join("labels", ",")).alias("labels_md5"))


def q_batch_sizes(spark, d):
    """Every prompt once, and no call of the generator with more than its batch size."""
    ship_package(spark)
    out = I.predict(PA.to_pairs(FX.cases(spark, d)), I.BatchSize())
    size = F.col("generated").cast("int")
    return out.agg(F.count(F.lit(1)).alias("n_prompts"), F.count_if(size > I.GENERATION_BATCH_SIZE).alias("n_over"), F.count_if(size < 1).alias("n_none"))


def q_predict_limited(spark, d):
    """Generation cut to a number of new tokens."""
    ship_package(spark)
    return I.predict(PA.to_pairs(FX.cases(spark, d)), I.EveryNthWord(BASELINE_STRIDE), max_new_tokens=NEW_TOKENS)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)
    }
