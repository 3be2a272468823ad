"""Supervised fine-tuning examples: token ids, attention mask, loss-masked labels.

Built-in array expressions. Tokens are whitespace words; ids come from a
hash of the word (no vocabulary to ship) or from a vocabulary table built by
``build_vocab``, which is counted before it goes to the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigen.functions.prompts import render_completion_prompt
from lexigen.functions.text import _c, tokens
from lexigen.session import materialize, spread

MAX_LEN = 512  # fixed value: sequence length of a training example
IGNORE = -100  # fixed value: label that the loss skips
PAD_ID, BOS_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
RESERVED = 4
HASH_VOCAB = 32000
MAX_VOCAB = 1_000_000  # words of a vocabulary that goes to every task
MAX_VOCAB_BYTES = 32 << 20  # of the candidates of a bounded count


def hash_id(tok: Column, vocab: int = HASH_VOCAB) -> Column:
    h = F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint")
    return (F.pmod(h, F.lit(vocab)) + F.lit(RESERVED)).cast("int")


def hash_ids(c, vocab: int = HASH_VOCAB) -> Column:
    return F.transform(tokens(c), lambda t: hash_id(t, vocab))


def sft_examples(
    pairs: DataFrame,
    key: str = "case_id",
    max_len: int = MAX_LEN,
    eos_id: int = EOS_ID,
    pad_id: int | None = None,
    vocab: int = HASH_VOCAB,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """pairs(prompt, response) -> key, input_ids, attention_mask, labels (each ``max_len``
    long) and n_supervised.

    The text is ``render(prompt) + response + eos``, cut to ``max_len`` as a whole
    (so eos is lost on overflow) and right-padded. Labels are the ids with the
    prompt positions and the padding set to -100.

    Every array is assembled from slices and constant runs; no lambda refers to
    a column outside its own element, so a filter that the optimizer pushes
    below this projection re-evaluates each expression once, not per element.
    Only words that survive the length cap are turned into ids: by their hash, or by
    a ``vocabulary`` table from ``build_vocab``.
    """
    pad = eos_id if pad_id is None else pad_id
    L = F.lit(max_len)
    prompt = render_completion_prompt("prompt")
    response = F.coalesce(F.col("response"), F.lit("nan"))
    x = pairs.select(key, tokens(prompt).alias("_pt"), tokens(response).alias("_rt"))
    plen = F.least(F.size("_pt"), L)
    n = F.least(F.size("_pt") + F.size("_rt") + 1, L)
    kept = F.slice(F.concat(F.slice("_pt", 1, max_len), "_rt"), 1, max_len)
    words = F.transform(kept, lambda t: hash_id(t, vocab)) if vocabulary is None else word_ids(kept, vocabulary)
    ids = F.slice(F.concat(words, F.array(F.lit(eos_id))), 1, max_len)
    x = x.select(key, plen.alias("_plen"), n.alias("_n"), ids.alias("_ids"))
    rest = L - F.col("_n")
    return x.select(
        key,
        F.concat("_ids", F.array_repeat(F.lit(pad), rest)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), rest)).alias("attention_mask"),
        F.concat(
            F.array_repeat(F.lit(IGNORE), F.col("_plen")),
            F.slice("_ids", F.col("_plen") + 1, F.col("_n") - F.col("_plen")),
            F.array_repeat(F.lit(IGNORE), rest),
        ).alias("labels"),
        (F.col("_n") - F.col("_plen")).cast("int").alias("n_supervised"),
    )


def drop_unsupervised(examples: DataFrame) -> DataFrame:
    """Keep examples with at least one supervised label."""
    if "n_supervised" in examples.columns:
        return examples.filter(F.col("n_supervised") > 0)
    return examples.filter(F.exists("labels", lambda v: v != F.lit(IGNORE)))


def encode_prompt(df: DataFrame, prompt: str = "prompt", max_len: int = MAX_LEN, vocab: int = HASH_VOCAB) -> DataFrame:
    """Rendered prompt ids cut to ``max_len`` and their count (``prompt_len``)."""
    words = F.slice(tokens(render_completion_prompt(prompt)), 1, max_len)
    ids = F.transform(words, lambda t: hash_id(t, vocab))
    return df.withColumn("prompt_ids", ids).withColumn("prompt_len", F.size("prompt_ids"))


def completion(out_ids, prompt_len) -> Column:
    """Ids after the prompt in a generated sequence."""
    out_ids, prompt_len = _c(out_ids), _c(prompt_len)
    return F.slice(out_ids, prompt_len + 1, F.greatest(F.size(out_ids) - prompt_len, F.lit(0)))


def length_profile(pairs: DataFrame, by: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """Token counts of prompt and full text, rows cut by the length cap, rows with
    no supervised token, supervised tokens kept."""
    p = F.size(tokens(render_completion_prompt("prompt")))
    full = p + F.size(tokens(F.coalesce(F.col("response"), F.lit("nan")))) + F.lit(1)
    x = pairs.select(*([by] if by else []), p.alias("_p"), full.alias("_f"))
    kept = F.least(F.col("_f"), F.lit(max_len)) - F.least(F.col("_p"), F.lit(max_len))
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_f") > max_len).alias("n_truncated"),
        F.count_if(F.col("_p") >= max_len).alias("n_unsupervised"),
        F.max("_p").cast("long").alias("max_prompt_tokens"),
        F.max("_f").cast("long").alias("max_full_tokens"),
        F.sum("_f").cast("long").alias("sum_full_tokens"),
        F.sum(kept).cast("long").alias("supervised_tokens"),
    ]
    return x.groupBy(by).agg(*aggs) if by else x.agg(*aggs)


def build_vocab(df: DataFrame, col: str, size: int) -> DataFrame:
    """The ``size`` most frequent words (ties by word) with ids from ``RESERVED``.

    A map-side partial count keeps a very frequent word from becoming a hot
    shuffle key; the top-k keeps ``size`` rows per partition before merging. The ids are
    numbered in one task, so ``size`` is at most ``MAX_VOCAB`` (an error beyond).
    """
    if size > MAX_VOCAB:
        raise ValueError(f"a vocabulary has at most {MAX_VOCAB} words")
    counts = df.select(F.explode(tokens(col)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return _numbered(counts, size)


def _numbered(counts: DataFrame, size: int) -> DataFrame:
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
    w = Window.orderBy(F.desc("n"), F.asc("token"))
    return top.withColumn("token_id", (F.row_number().over(w) - 1 + RESERVED).cast("int"))


def _cut(counts: Counter, held: int) -> int:
    """Keep the ``held`` largest counts, each less the largest that goes (returned)."""
    if len(counts) <= held:
        return 0
    missed = sorted(counts.values(), reverse=True)[held]
    for word in [w for w, n in counts.items() if n <= missed]:
        del counts[word]
    for word in counts:
        counts[word] -= missed
    return missed


def word_summaries(df: DataFrame, col: str, held: int) -> DataFrame:
    """(token, n): per partition at most ``held`` words with lower bounds of their counts there, and a row
    without a token: no word of the partition, summarised or not, is more than that n above its bound.

    A task holds at most twice ``held`` words and those of one text; summaries merge by adding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, missed = Counter(), 0
        for batch in batches:
            for text in batch["text"]:
                if text is not None:
                    counts.update(text.split())
                    if len(counts) > 2 * held:
                        missed += _cut(counts, held)
        missed += _cut(counts, held)
        yield pd.DataFrame({"token": [None, *counts], "n": [missed, *counts.values()]})

    return spread(df.select(F.col(col).alias("text"))).mapInPandas(run, "token string, n long")


def build_vocab_bounded(df: DataFrame, col: str, size: int, held: int | None = None) -> DataFrame:
    """``build_vocab`` without a shuffle of every distinct word: the same rows, but at most ``held`` words
    (by default 32 a word of the vocabulary, 10,000 at least) leave a partition.

    Partitions are summarised first (:func:`word_summaries`). Let ``missed`` be the sum of what the
    partitions may have missed of a word. If none missed anything, the summaries are the counts. Else the bound of the
    ``size``-th word says how frequent a word of the vocabulary is at least; words that cannot reach it are left out, the others
    are counted exactly by a second pass. Where ``missed`` itself reaches that bound, a word that no summary
    holds might belong to the vocabulary, and where too many words remain they cannot go to every
    task: then ``build_vocab`` counts them all."""
    if size > MAX_VOCAB:
        raise ValueError(f"a vocabulary has at most {MAX_VOCAB} words")
    held = held or max(32 * size, 10_000)
    parts = materialize(word_summaries(df, col, held), "word-summaries")
    missed = parts.filter("token IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bounds = parts.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    if not missed:
        return _numbered(bounds, size)
    last = bounds.select("n").orderBy(F.desc("n")).limit(size).agg(F.min("n"), F.count(F.lit(1))).first()
    if last[1] < size or missed >= last[0]:
        return build_vocab(df, col, size)
    left = materialize(bounds.filter(F.col("n") + missed >= last[0]).select("token"), "word-candidates")
    n_left, chars = left.agg(F.count(F.lit(1)), F.sum(F.octet_length("token"))).first()
    if n_left > MAX_VOCAB or chars > MAX_VOCAB_BYTES:
        return build_vocab(df, col, size)
    sent = df.sparkSession.sparkContext.broadcast({r["token"] for r in left.collect()})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, counts = sent.value, Counter()
        for batch in batches:
            for text in batch["text"]:
                if text is not None:
                    counts.update(w for w in text.split() if w in wanted)
        if counts:  # a partition without a row or a wanted word has no column of words to show
            yield pd.DataFrame({"token": [*counts], "n": [*counts.values()]})

    exact = spread(df.select(F.col(col).alias("text"))).mapInPandas(count, "token string, n long")
    return _numbered(exact.groupBy("token").agg(F.sum("n").alias("n")), size)


def word_ids(words, vocab: DataFrame) -> Column:
    """``array<string>`` -> ids from a vocabulary table (unknown -> UNK_ID), word by word.

    The vocabulary goes to every task, so it is counted first: more than ``MAX_VOCAB``
    rows are an error, and such a table is joined by ``join_ids`` instead."""
    rows = vocab.select("token", "token_id").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"more than {MAX_VOCAB} words: use join_ids")
    held = vocab.sparkSession.sparkContext.broadcast({r["token"]: r["token_id"] for r in rows})

    @F.pandas_udf("array<int>")
    def look_up(lists: pd.Series) -> pd.Series:
        known = held.value
        return pd.Series([None if ws is None else [known.get(w, UNK_ID) for w in ws] for ws in lists], dtype=object)

    return look_up(_c(words))


def join_ids(df: DataFrame, key: str, col: str, vocab: DataFrame) -> DataFrame:
    """``vocab_ids`` for a vocabulary of any size: texts are told apart by their digest, the
    words of each distinct text are joined, and the ids go back by a join on the digest."""
    text = F.coalesce(F.col(col), F.lit(""))
    rows = df.select(F.col(key), F.md5(text.cast("binary")).alias("__text"), tokens(text).alias("__words"))
    once = rows.groupBy("__text").agg(F.first("__words").alias("__words"))
    found = once.select("__text", F.posexplode("__words").alias("pos", "token")).join(vocab.select("token", "token_id"), "token", "left")
    pair = F.struct("pos", F.coalesce("token_id", F.lit(UNK_ID)).alias("id"))
    ids = found.groupBy("__text").agg(F.transform(F.sort_array(F.collect_list(pair)), lambda s: s["id"]).alias("ids"))
    none = F.array().cast("array<int>")
    return rows.join(ids, "__text", "left").select(key, F.coalesce("ids", none).alias("ids"))


def vocab_ids(df: DataFrame, key: str, col: str, vocab: DataFrame, max_len: int | None = None) -> DataFrame:
    """(key, ids): word ids of ``col``, one row per input row; no ids for an empty or null text.
    ``max_len`` cuts to the first ids; by default nothing is cut."""
    none = F.array().cast("array<int>")
    small = vocab.limit(MAX_VOCAB + 1).count() <= MAX_VOCAB
    out = df.select(key, F.coalesce(word_ids(tokens(col), vocab), none).alias("ids")) if small else join_ids(df, key, col, vocab)
    return out if max_len is None else out.select(key, F.slice("ids", 1, max_len).alias("ids"))
