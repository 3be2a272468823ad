"""Operator 9, nearest neighbours by low-dimensional stable projections.

Vectors are projected to ``m`` dimensions by Gaussian directions, and the projections of a
block of rows are indexed by a kd-tree. A query visits the tree's leaves in order of their
distance in the projection and measures their rows on the original vectors. The squared
ratio of projected to true distance follows a chi-square law with m degrees of freedom, so
once every unvisited row lies farther off in the projection than the law's ``confidence``
quantile times the k-th best distance, a nearer row has been missed with a probability of at
most 1 - confidence, and the search stops.

Rows are dealt to blocks by a hash of the id and their place in the table, so rows of one id spread; every block of queries meets every block of
rows, and a query's best rows per block are merged. Every row is indexed. A block of rows is sent once for up to ``TURN``
blocks of queries: it comes first in its task's order, and the queries stream past its tree.

Vectors that are null, all zero, or hold a null or non-finite component take no part;
only vectors of a query's own length are its candidates. Ties go to the smaller id. Rows that share an id
with the query are not its candidates. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigen.session import materialize

LEAF = 64
MAX_BLOCK_ROWS = 65_536
MIN_BLOCK_ROWS = 4_096
BLOCKS = 64  # before blocks grow beyond MIN_BLOCK_ROWS
BLOCK_QUERIES = 512
ROUNDING = 1e-14
TURN = 64  # blocks of queries that one reading of a block of rows serves


def chi_square_below(x: float, m: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


@cache
def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, m) < p else (low, mid)
    return high


def directions(dims: int, m: int, seed: int = 11) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dims])).normal(size=(dims, m))


class ProjectedTree:
    """kd-tree over projections, with the vectors it was made from, in leaf order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int):
        self.m = m
        flat = vectors @ directions(vectors.shape[1], m)
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right (-1: a leaf)
        lows, highs = [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            here = order[start:end]
            low, high = flat[here].min(axis=0), flat[here].max(axis=0)
            number = len(self.nodes)
            self.nodes.append((start, end, -1, -1))
            lows.append(low)
            highs.append(high)
            if parent >= 0:
                a, b, left, right = self.nodes[parent]
                self.nodes[parent] = (a, b, number, right) if side == 0 else (a, b, left, number)
            if end - start > LEAF and (high > low).any():
                axis = int(np.argmax(high - low))
                half = (end - start) // 2
                order[start:end] = here[np.argpartition(flat[here, axis], half)]
                todo += [(start, start + half, number, 0), (start + half, end, number, 1)]
        self.low, self.high = np.array(lows), np.array(highs)
        self.ids, self.vectors = ids[order], vectors[order]

    def search(self, query_id: int, query: np.ndarray, k: int, confidence: float) -> list[tuple[float, int]]:
        """The best (distance, id), nearest first, ties to the smaller id."""
        limit = chi_square_quantile(confidence, self.m)
        at = query @ directions(len(query), self.m)
        # a projection may be rounded one way alone and another in a table: equal vectors are at no distance all the same
        slack = ROUNDING * len(query) * float(np.linalg.norm(query))
        gaps = np.maximum(0, np.maximum(self.low - at, at - self.high) - slack)
        bound = (gaps * gaps).sum(axis=1)
        best: list[tuple[float, int]] = []
        heap = [(float(bound[0]), 0)]
        while heap:
            near, node = heapq.heappop(heap)
            if len(best) == k and near > limit * best[-1][0] ** 2:
                break
            start, end, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(heap, (float(bound[left]), left))
                heapq.heappush(heap, (float(bound[right]), right))
                continue
            diff = self.vectors[start:end] - query
            dist = np.sqrt((diff * diff).sum(axis=1))
            close = np.arange(end - start) if len(best) < k else np.flatnonzero(dist <= best[-1][0])
            if len(close) > k:
                # only the k best of this leaf can enter, the query itself apart
                close = close[np.lexsort((self.ids[start + close], dist[close]))[: k + int((self.ids[start:end] == query_id).sum())]]
            own = [(float(dist[i]), int(self.ids[start + i])) for i in close if self.ids[start + i] != query_id]
            if own:
                best = sorted([*best, *own])[:k]
        return best


def _pack(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, ids=ids, vectors=vectors)
    return f.getvalue()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return f["ids"], f["vectors"]


def _blocks(rows: DataFrame, name: str, blocks: int) -> DataFrame:
    """(dims, block, blob) of the rows dealt by a hash of their ids."""

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        blob = _pack(part["id"].to_numpy(np.int64), np.stack(part["vector"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"dims": [part["dims"].iloc[0]], name: [part[name].iloc[0]], f"{name}_blob": [blob]})

    # the place in the table parts rows that share an id
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dims", name).applyInPandas(gather, f"dims int, {name} int, {name}_blob binary")


def nearest(df: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, m: int = 8, confidence: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest rows of ``df``; ``queries``
    has the same columns (``df`` itself if not given). ``m`` is even."""
    if m % 2:
        raise ValueError("m must be even")

    def usable(t: DataFrame) -> DataFrame:
        v = t.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return v.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(~bad & F.exists("vector", lambda x: x != 0)).withColumn("dims", F.size("vector"))

    rows = usable(df)
    asked = rows if queries is None else usable(queries)
    n, n_asked = rows.count(), asked.count()
    blocks = max(1, -(-n // min(MAX_BLOCK_ROWS, max(MIN_BLOCK_ROWS, n // BLOCKS))))  # by the data alone
    asks = max(1, -(-n_asked // BLOCK_QUERIES))
    # a task reads a block of rows once, ahead of the blocks of queries that meet it
    index = materialize(_blocks(rows, "block", blocks), "row-blocks")
    index = index.select("dims", "block", F.explode(F.sequence(F.lit(0), F.lit((asks - 1) // TURN))).alias("turn"), F.lit(-1).alias("ask"), F.col("block_blob").alias("blob"))
    ask = materialize(_blocks(asked, "ask", asks), "query-blocks")
    ask = ask.select("dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.expr(f"ask div {TURN}").cast("int").alias("turn"), "ask", F.col("ask_blob").alias("blob"))
    key = ["dims", "block", "turn"]
    dealt = index.unionByName(ask).repartition(*key).sortWithinPartitions(*key, "ask")

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, held = None, None
        for part in parts:
            for row in part.itertuples(index=False):
                if row.ask < 0:
                    tree, held = None, (row.dims, row.block, row.turn)
                    raw = row.blob
                elif held == (row.dims, row.block, row.turn):
                    if tree is None:
                        tree = ProjectedTree(*_unpack(raw), m)
                    found = [(int(i), v, d) for i, q in zip(*_unpack(row.blob), strict=True) for d, v in tree.search(int(i), q, k, confidence)]
                    yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = dealt.mapInPandas(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
