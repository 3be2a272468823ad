"""Operator 2, best-fit packing with vector capacities.

Documents become token ids; only those longer than a sequence are cut. A sequence is a
bin with three capacities: tokens, number of pieces and attention cost (sum of squared
lengths). Pieces go, longest first, into the open bin that fits under every capacity and
is best by the weighted norm of what it would have left (``rule="norm"``) or by the
weighted dot product of the piece and what the bin has left (``rule="dot"``).

Pieces are dealt by a hash into groups of about ``group_sequences`` sequences and packed
group by group, so a task's memory is bounded and no group grows with the data; the price
is at most about one part-filled sequence per group. Ids never shuffle: only lengths do.

Null text is empty: one sequence-end id. Rows with equal ids are packed each. Empty tables
give empty results.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigen.llm.common import held, texts_of, without
from lexigen.llm.token_counts import chunks, default_vocabulary
from lexigen.session import materialize, spread


class ChunkIds:
    """Ids of chunks between white space, as little-endian 32-bit bytes, by the library;
    remembered, and emptied when more than ``limit`` chunks would be held.

    Words of A-Z with or without a full stop or comma behind them go straight to the library's
    merges: normalisation only lower-cases them, and the word pattern parts the stop."""

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.rules, self.limit = Tokenizer.from_file(path), limit
        self._known: dict[str, bytes] = {}
        self._merge = self.rules.model.tokenize
        whole = lambda c: self.rules.encode(c, add_special_tokens=False).ids
        self._stops = {c: array("I", whole(c)).tobytes() for c in ".,"}
        probes = ("a", "word", "abcdefghijklmnopqrstuvwxyz")
        self._direct = all([t.id for t in self._merge(w)] == whole(w.upper()) and whole(w + ".") == whole(w) + whole(".") for w in probes)

    def _encode(self, new: set[str]) -> dict[str, bytes]:
        out, rest, merge = {}, [], self._merge
        for c in new:
            stop = self._stops.get(c[-1], b"")
            word = c[:-1] if stop else c
            if self._direct and word.isascii() and word.isalpha():
                out[c] = array("I", [t.id for t in merge(word.lower())]).tobytes() + stop
            else:
                rest.append(c)
        found = self.rules.encode_batch_fast(rest, add_special_tokens=False)
        out.update((c, array("I", e.ids).tobytes()) for c, e in zip(rest, found, strict=True))
        return out

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; all chunks not yet known are encoded in one call."""
        parts = [chunks(t) for t in texts]
        held = [list(map(self._known.get, doc)) for doc in parts]
        gaps = [[i for i, x in enumerate(ids) if x is None] if None in ids else () for ids in held]
        new = {doc[i] for doc, at in zip(parts, gaps, strict=True) for i in at}
        if new:
            fresh = self._encode(new)
            for doc, ids, at in zip(parts, held, gaps, strict=True):
                for i in at:
                    ids[i] = fresh[doc[i]]
            if len(self._known) + len(fresh) > self.limit:
                self._known.clear()
            self._known.update((c, x) for c, x in fresh.items() if len(c) <= 64)
        return [b"".join(ids) for ids in held]

    def of_text(self, text: str) -> bytes:
        return self.of_texts([text])[0]


def encoder_for(path: str | None) -> ChunkIds:
    path = path or default_vocabulary()
    return held(("encoder", path), lambda: ChunkIds(path))


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """Per piece: id, ``piece`` (from 0), ``start`` (the document's ids before it),
    ``length`` and ``ids`` (little-endian unsigned 32-bit). Every document ends in ``end_id``."""
    id_type = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, pieces, starts, ids = [], [], [], []
                for row, whole in enumerate(encoder.of_texts(texts_of(part, text_col))):
                    whole += end
                    for piece, start in enumerate(range(0, len(whole), 4 * max_tokens)):
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(start // 4)
                        ids.append(whole[start : start + 4 * max_tokens])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col).take(pa.array(rows, pa.int32())),
                        pa.array(pieces, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=[id_col, "piece", "start", "length", "ids"],
                )

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, max_tokens: int, max_pieces: int, max_cost: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; all three capacities hold in every bin. A piece over
    a capacity on its own raises ValueError."""
    caps = np.array([max_tokens, max_pieces, max_cost], dtype=np.float64)
    lengths = lengths.astype(np.int64)
    if len(lengths) and (lengths.max() > max_tokens or max_pieces < 1 or lengths.max() ** 2 > max_cost):
        raise ValueError("a piece exceeds a capacity on its own")
    w = np.array(weights)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.empty((max(16, len(lengths)), 3))
    numbers = np.empty(len(left), np.int64)
    n_open = n_bins = 0
    shortest = int(lengths.min()) if len(lengths) else 0
    for i in order:
        need = np.array([lengths[i], 1, lengths[i] ** 2], dtype=np.float64)
        at = -1
        if n_open:
            rest = left[:n_open] - need
            fits = np.flatnonzero((rest >= 0).all(axis=1))
            if len(fits):
                if rule == "norm":
                    cost = (((rest[fits] / caps) ** 2) * w).sum(axis=1)
                else:
                    cost = -((left[fits] / caps) * (need / caps) * w).sum(axis=1)
                at = int(fits[np.argmin(cost)])
        if at < 0:
            left[n_open], numbers[n_open] = caps, n_bins
            at, n_open, n_bins = n_open, n_open + 1, n_bins + 1
        bins[i], offsets[i] = numbers[at], max_tokens - int(left[at, 0])
        left[at] -= need
        if left[at, 0] < shortest or left[at, 1] < 1:  # nothing more can go in
            n_open -= 1
            left[at], numbers[at] = left[n_open], numbers[n_open]
    return bins, offsets


def pack(pieces: DataFrame, id_col: str = "doc_id", max_tokens: int = 4096, max_pieces: int | None = None, max_cost: int | None = None, rule: str = "norm", group_sequences: int = 1024) -> DataFrame:
    """Add ``sequence_id`` (long) and ``offset`` (long) to a table of pieces with
    ``piece`` and ``length``; other columns stay. The table is read twice, so hand in a stored one."""
    max_pieces = max_pieces or max_tokens
    max_cost = max_cost or max_tokens**2
    pieces = without(pieces, "pack_group", "sequence_id", "offset")
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-total // (max_tokens * group_sequences)))
    # the place in the stored table parts rows that share an id, have none or are equal in everything
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(id_col, "piece", F.monotonically_increasing_id()), F.lit(groups)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([id_col, "piece"], kind="stable")
        group = int(part["pack_group"].iloc[0])
        bins, offsets = best_fit(part["length"].to_numpy(), max_tokens, max_pieces, max_cost, rule)
        return part.drop(columns="pack_group").assign(sequence_id=(group << 32) + bins, offset=offsets)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    return dealt.groupBy("pack_group").applyInPandas(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``n_pieces``, ``length`` and ``ids``, the pieces'
    ids in order of their offsets. ``packed`` needs the ``ids`` column of :func:`token_pieces`."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
    return rows.select("sequence_id", F.size("parts").alias("n_pieces"), "length", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their digest and place: id, piece, start, length,
    ids_crc32, sequence_id, offset. The ids' digests are stored once in the shared folder, so encoding runs once."""
    pieces = token_pieces(df, id_col, text_col, max_tokens, vocabulary=vocabulary)
    stored = materialize(pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(stored, id_col, max_tokens)
