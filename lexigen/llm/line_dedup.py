"""Operator 8, line deduplication with sharded minimal perfect hashes.

A line's key is the line with ASCII white space stripped and A-Z lower-cased. Keys are
hashed to 128 bits and the distinct documents of each are counted with partial aggregates.
The hashes found in two documents or more (a hash of one document can be over no limit)
are cut into shards by their top bits, and each shard becomes a minimal perfect hash with an
array of 64-bit fingerprints and one of counts. Documents look their lines up in the arrays
and drop those of at least ``min_docs`` documents; the lines themselves are not joined.

While all shards together stay below ``max_broadcast`` bytes (measured), every task gets
them and the texts never shuffle. Beyond it the documents' line hashes go to the shards:
grouped by shard, large groups split by a salt, and only the places of dropped lines come
back, where one join by the text's digest takes them to the texts. Both ways give the same rows.

Null text is one empty line. Lines with an empty key always stay. A document is a distinct
id: repeated rows with one id count once; rows with a null id are not counted but lose lines like the others.
Empty tables give empty results. Extra columns are carried through, but for those named as the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigen.llm.common import BLANKS, held, lower_ascii, texts_of, with_columns, without
from lexigen.llm.mph import CountShard
from lexigen.session import materialize, spread

INDEX_FROM = 2
SHARD_KEYS = 50_000
PROBES_PER_TASK = 200_000


def line_key(line: str) -> str:
    return lower_ascii(line.strip(BLANKS))


def key_hashes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each key's 128-bit hash."""
    raw = b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys)
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def shard_of(h1: np.ndarray, bits: int) -> np.ndarray:
    return (h1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), np.int64)


def line_counts(df: DataFrame, id_col: str, text_col: str, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): distinct documents of every line key of at least ``min_chars`` code points."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = [], []
            for text in texts_of(batch, text_col):
                keys = {k for x in text.split("\n") if len(k := line_key(x)) >= min_chars}
                h1, h2 = key_hashes(sorted(keys))
                first.append(h1.view(np.int64))
                second.append(h2.view(np.int64))
            yield with_columns(batch, [id_col], h1=pa.array(first, pa.list_(pa.int64())), h2=pa.array(second, pa.list_(pa.int64())))

    rows = spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, h1 array<long>, h2 array<long>")
    lines = rows.select(id_col, F.explode(F.arrays_zip("h1", "h2")).alias("x")).select(id_col, "x.h1", "x.h2")
    return lines.groupBy("h1", "h2").agg(F.count_distinct(id_col).alias("n")).filter(F.col("n") >= INDEX_FROM)


def build_shards(counts: DataFrame) -> tuple[DataFrame, int, int]:
    """(stored shards: shard, blob; bits of the shard number; bytes of all shards). ``counts`` must be stored."""
    n = counts.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n) / SHARD_KEYS))))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h1", "h2"])
        made = CountShard.build(part["h1"].to_numpy().view(np.uint64), part["h2"].to_numpy().view(np.uint64), part["n"].to_numpy())
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "blob": [made.to_bytes()]})

    shard = F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("long")
    made = counts.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard long, blob binary")
    stored = materialize(made, "line-shards")
    return stored, bits, stored.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0))).first()[0]


def count_of(h1: np.ndarray, h2: np.ndarray, shards: dict[int, CountShard], bits: int) -> np.ndarray:
    out = np.zeros(len(h1), np.int64)
    which = shard_of(h1, bits)
    for s in np.unique(which):
        if (shard := shards.get(int(s))) is not None:
            here = which == s
            out[here] = shard.count(h1[here], h2[here])
    return out


def _drop(text: str, gone: np.ndarray) -> tuple[str, int, int]:
    """(the text without the lines that go, its lines before, lines dropped)."""
    lines = text.split("\n")
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), int(gone.sum())


def _dropped(batch: pa.RecordBatch, columns: list[str], parts: list[tuple[str, int, int]]) -> pa.RecordBatch:
    texts, before, gone = zip(*parts, strict=True) if parts else ((), (), ())
    return with_columns(batch, columns, dedup_text=pa.array(texts, pa.string()), dedup_lines=pa.array(before, pa.int64()), dedup_dropped=pa.array(gone, pa.int64()))


def text_key(text_col: str):
    """A digest of a text, as a column; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


_OUT = "dedup_text string, dedup_lines long, dedup_dropped long"


def _probe_broadcast(df: DataFrame, text_col: str, shards: DataFrame, bits: int, min_docs: int, min_chars: int) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast([(r["shard"], bytes(r["blob"])) for r in shards.collect()])
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("nothing",))
        index = {s: CountShard.from_bytes(b) for s, b in sent.value}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = texts_of(batch, text_col)
                keys = [[line_key(x) for x in t.split("\n")] for t in texts]
                flat = [k for doc in keys for k in doc]
                h1, h2 = key_hashes(flat)
                gone = (count_of(h1, h2, index, bits) >= min_docs) & (np.fromiter(map(len, flat), np.int64, len(flat)) >= min_chars)
                cut = np.cumsum([0, *map(len, keys)])
                yield _dropped(batch, columns, [_drop(t, gone[a:b]) for t, a, b in zip(texts, cut, cut[1:], strict=False)])

    return df.mapInArrow(run, f"{_fields(df)}, {_OUT}")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _probe_shuffled(df: DataFrame, text_col: str, shards: DataFrame, bits: int, min_docs: int, min_chars: int) -> DataFrame:
    """Line hashes go to the shards; the places of dropped lines come back, joined by a digest of the text."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("text_key", "shard", "places", "h1", "h2")}
            for text, key in zip(texts_of(batch, text_col), batch.column("text_key").to_pylist(), strict=True):
                keys = [line_key(x) for x in text.split("\n")]
                h1, h2 = key_hashes(keys)
                ok = np.fromiter(map(len, keys), np.int64, len(keys)) >= min_chars
                which = shard_of(h1, bits)
                for s in np.unique(which[ok]):
                    here = np.flatnonzero(ok & (which == s))
                    for k, v in (("text_key", key), ("shard", s), ("places", here), ("h1", h1[here].view(np.int64)), ("h2", h2[here].view(np.int64))):
                        out[k].append(v)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out["text_key"], pa.binary()), pa.array(out["shard"], pa.int64()), *(pa.array(out[k], longs) for k in ("places", "h1", "h2"))], names=list(out))

    columns = df.columns
    keyed = df.withColumn("text_key", text_key(text_col))
    # copies of a text send the same hashes: its digest stands for all of them, so the text itself stays
    found = keyed.select("text_key", text_col).mapInArrow(hashes, "text_key binary, shard long, places array<long>, h1 array<long>, h2 array<long>")
    probes = materialize(found.dropDuplicates(["text_key", "shard"]), "line-probes")
    salts = probes.groupBy("shard").agg(F.ceil(F.sum(F.size("places")) / PROBES_PER_TASK).cast("int").alias("salts"))
    dealt = probes.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("text_key"), F.col("salts")).cast("int"))
    copies = shards.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("shard", "salt", "blob")

    def probe(docs: pd.DataFrame, copy: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(copy):
            return pd.DataFrame({"text_key": [], "places": []})
        shard = CountShard.from_bytes(copy["blob"].iloc[0])
        h1 = np.concatenate(docs["h1"].tolist()).astype(np.int64).view(np.uint64)
        h2 = np.concatenate(docs["h2"].tolist()).astype(np.int64).view(np.uint64)
        gone = shard.count(h1, h2) >= min_docs
        cut = np.cumsum([0, *map(len, docs["places"])])
        places = [p[gone[a:b]] for p, a, b in zip(docs["places"], cut, cut[1:], strict=False)]
        return pd.DataFrame({"text_key": docs["text_key"], "places": places})[[len(p) > 0 for p in places]]

    found = dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "text_key binary, places array<long>")
    gone = found.groupBy(F.col("text_key").alias("gone_key")).agg(F.flatten(F.collect_list("places")).alias("gone_places"))
    joined = keyed.join(gone, keyed["text_key"] == gone["gone_key"], "left").drop("text_key", "gone_key")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text, places in zip(texts_of(batch, text_col), batch.column("gone_places").to_pylist(), strict=True):
                gone = np.zeros(text.count("\n") + 1, bool)
                gone[np.array(places or [], np.int64)] = True
                parts.append(_drop(text, gone))
            yield _dropped(batch, columns, parts)

    return joined.mapInArrow(drop, f"{_fields(df)}, {_OUT}")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, max_broadcast: int = 64 << 20) -> DataFrame:
    """The input's rows and columns with ``dedup_text`` (the text without dropped lines),
    ``dedup_lines`` (lines before) and ``dedup_dropped`` (lines dropped); input columns of
    these names are replaced."""
    if min_docs < INDEX_FROM:
        raise ValueError(f"min_docs must be at least {INDEX_FROM}")
    df = without(df, "dedup_text", "dedup_lines", "dedup_dropped", "text_key", "gone_key", "gone_places")
    counts = materialize(line_counts(df, id_col, text_col, min_chars), "line-counts")
    shards, bits, size = build_shards(counts)
    probe = _probe_broadcast if size <= max_broadcast else _probe_shuffled
    return probe(spread(df), text_col, shards, bits, min_docs, min_chars)
