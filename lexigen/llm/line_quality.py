"""Operator 3, quality rules from cross-document line frequency.

Lines are normalised (words joined by one space, A-Z lower-cased, digits as 0) and hashed.
For each host the distinct documents of every line are counted; documents with the same
text count once, so a page copied many times does not turn its own lines into boilerplate.
A line above the host's limit is removed, and a document that loses ``depleted`` of its
words or more is rejected. The limit of a host is ``share`` of its distinct documents, and at least ``min_docs``, a handful
against chance.

Base rules come first: too few words, or too many words in repeated 5-word windows.

Null text has no words; null hosts form one host, apart from the empty string; repeated
rows are judged alike, each returned; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigen.llm.common import HashOf, by_ids, free_name, held, lower_ascii, texts_of, window_hashes, with_columns, words
from lexigen.session import materialize, spread

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_DIGITS = re.compile(r"[0-9]+")
#: Lines in so few distinct texts of a host may be there by chance; beyond, the share of the host's texts decides.
FEW_TEXTS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def normal_line(line: str) -> str:
    """The form in which lines are compared; empty without a word."""
    return _DIGITS.sub("0", lower_ascii(" ".join(words(line))))


def repeated_words(hashes: np.ndarray, n: int = 5) -> int:
    """Words that lie in an ``n``-word window found twice or more, the first included."""
    if len(hashes) < n + 1:
        return 0
    w = window_hashes(hashes, n)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    again = np.zeros(len(w), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(lines: list[str]) -> int:
    """Lines with a word that equal an earlier line."""
    full = [x for x in lines if words(x)]
    return len(full) - len(set(full))


def doc_key(text_col: str, host_col: str):
    """A digest of a row's host and text, as a column; null text counts as empty."""
    host = F.when(F.col(host_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(host_col).cast("string")))
    return F.unhex(F.md5(F.concat(host, F.lit("\n"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")))


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per row: id, host, ``doc_key`` (a digest of host and text), the base measures, and the hashes and word
    counts of its distinct normalised lines."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held(("hashes",), HashOf)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words")}
            for text in texts_of(batch, text_col):
                found = words(text)
                lines = text.split("\n")
                per_line: dict[int, int] = {}
                for line in lines:
                    if key := normal_line(line):
                        h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
                        per_line[h] = per_line.get(h, 0) + key.count(" ") + 1
                out["n_words"].append(len(found))
                out["word_chars"].append(sum(map(len, found)))
                out["n_symbols"].append(len(_SYMBOLS.findall(text)))
                out["n_dup_lines"].append(repeated_lines(lines))
                out["n_repeat_words"].append(repeated_words(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))))
                out["lines"].append(np.fromiter(per_line, np.uint64, len(per_line)).view(np.int64))
                out["line_words"].append(list(per_line.values()))
            types = {"lines": pa.list_(pa.int64()), "line_words": pa.list_(pa.int64())}
            yield with_columns(batch, [id_col, host_col, "doc_key"], **{k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    schema = f"`{id_col}` {kind[id_col]}, `{host_col}` {kind[host_col]}, doc_key binary, {_MEASURES}, lines array<long>, line_words array<long>"
    return spread(df.select(id_col, text_col, host_col, doc_key(text_col, host_col).alias("doc_key"))).mapInArrow(run, schema)


def frequent_lines(measured: DataFrame, host_col: str, min_docs: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(the lines of distinct documents per host, the lines above their host's limit)."""
    texts = measured.groupBy(host_col, "doc_key").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))
    lines = texts.select(host_col, "doc_key", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select(host_col, "doc_key", F.col("x.lines").alias("line"), F.col("x.line_words").alias("line_words"))
    hosts = measured.groupBy(host_col, "doc_key").agg(F.lit(1).alias("one")).groupBy(F.col(host_col).alias("of_host")).agg(F.count("one").alias("host_docs"))
    counts = lines.groupBy(F.col(host_col).alias("at_host"), F.col("line").alias("at_line")).agg(F.count(F.lit(1)).alias("line_docs")).filter(F.col("line_docs") > min_docs)
    over = counts.join(hosts, F.col("at_host").eqNullSafe(F.col("of_host"))).filter(F.col("line_docs") > share * F.col("host_docs")).drop("of_host")
    return lines, over


def judge_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = FEW_TEXTS, share: float = 0.02, depleted: float = 0.9) -> DataFrame:
    """Per row: id, host, doc_key, base measures, ``base_failed``, ``n_removed_words`` (words in lines
    above the limit), ``removed_lines`` (their hashes; null: none) and ``kept``."""
    measured = materialize(measure(df, id_col, text_col, host_col), "line-measures")
    lines, over = frequent_lines(measured, host_col, min_docs, share)
    hit = lines.join(over, lines[host_col].eqNullSafe(over["at_host"]) & (lines["line"] == over["at_line"]))
    lost = hit.groupBy("doc_key").agg(F.sum("line_words").alias("lost_words"), F.collect_set("line").alias("removed_lines"))
    joined = measured.drop("lines", "line_words").join(lost, "doc_key", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    removed = F.coalesce("lost_words", F.lit(0))
    return (
        joined.withColumn("base_failed", failed)
        .withColumn("n_removed_words", removed)
        .withColumn("kept", ~failed & (removed < depleted * F.col("n_words")))
        .drop("lost_words")
    )


def reject(df: DataFrame, verdicts: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``df`` that :func:`judge_lines` kept, as they are."""
    key = free_name(df, "line_key")
    gone = verdicts.filter(~F.col("kept")).select(F.col("doc_key").alias(key)).distinct()
    return by_ids(df.withColumn(key, doc_key(text_col, host_col)), gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def remove_lines(df: DataFrame, verdicts: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The kept rows, every column, with lines above the limit taken out of the text."""

    def clean(texts, removed):
        import pandas as pd

        out = []
        for text, gone in zip(texts, removed, strict=True):
            if text is None or gone is None or not len(gone):
                out.append(text)
                continue
            gone = {int(x) & 0xFFFFFFFFFFFFFFFF for x in gone}
            out.append("\n".join(x for x in text.split("\n") if xxhash.xxh3_64_intdigest(normal_line(x).encode("utf-8", "surrogatepass")) not in gone))
        return pd.Series(out, dtype=object)

    key, lost = free_name(df, "line_key"), free_name(df, "lines_gone")
    one = verdicts.filter("kept").groupBy(F.col("doc_key").alias(key)).agg(F.first("removed_lines").alias(lost))
    both = df.withColumn(key, doc_key(text_col, host_col)).join(one, key)
    return both.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col), F.col(lost))).select(*df.columns)
