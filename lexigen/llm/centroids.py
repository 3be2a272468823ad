"""Operator 13, centroid clustering by dimension-sharded Lloyd.

Vectors are cut into column blocks: one record holds ``BLOCK_DIMS`` columns of ``GROUP_ROWS`` vectors, so
neither a task nor a record needs a whole vector. A round is one job of three steps. Column-block tasks
measure exact partial distances of their columns to their slice of the centroids; partial distances of
a group are added over its blocks and their least is taken; the assignments go back to the blocks,
each of which adds up its own columns by cluster, and each shard (all records of a block) divides its
sums into its own slice of the next centroids. Only partial distances and assignments are shuffled: the blocks lie
partitioned by group, stored once. The driver holds the centroids (k x dims integers) and nothing else.

All arithmetic is on integers, floor(scale * x), so results do not depend on the order of additions. Components
too large for 64-bit sums are reckoned with Python's integers; distances and inertias beyond a long are
given as the largest long.

Vectors that are null, of another length, or hold a null or non-finite component take no part and are not
returned. Repeated rows count each. Among rows of one id the one with the smaller vector starts first; a null
id counts as empty text there. Ties of distance go to the smaller number. With fewer than k vectors all of
them start a cluster; without any the result is empty. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigen.session import materialize, spread

GROUP_ROWS = 256
BLOCK_DIMS = 16
SMALL = 1 << 26  # up to here squares of differences over thousands of columns add up within 64 bits
LARGEST = (1 << 63) - 1


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers, or Python's where one could be too large."""
    if not x.size or np.abs(x).max() * scale < SMALL:
        return np.floor(x * scale).astype(np.int64)
    exact = [[n * scale // d for n, d in (float(v).as_integer_ratio() for v in row)] for row in x]
    return np.array(exact, dtype=object)


def _wide(cells: np.ndarray, centers: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells and centroid slices as arrays of one kind in which squares fit."""
    small = cells.dtype != object and all(abs(v) < SMALL for c in centers for v in c)
    return (cells, np.array(centers, np.int64)) if small else (cells.astype(object), np.array(centers, dtype=object))


def partial_distances(cells: np.ndarray, centers: list[list[int]]) -> np.ndarray:
    """Squared distances of rows to every centroid over some columns."""
    x, c = _wide(cells, centers)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def kept_vectors(df: DataFrame, vector_col: str, dims: int) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter((F.size(v) == dims) & sound).withColumn(vector_col, v)


def first_centroids(kept: DataFrame, id_col: str, vector_col: str, k: int, salt: str, scale: int) -> list[list[int]]:
    """The vectors of the k smallest digests of salted ids, in that order."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("digest"), F.col(f"`{vector_col}`").alias("v")).orderBy("digest", "v").limit(k).collect()
    return [[int(x) for x in whole_numbers(np.array([r["v"]]), scale)[0]] for r in rows]


def column_blocks(kept: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(group, block, ids, cells): the ids of a group's rows are with its first block."""
    id_type = kept.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                blocks = range(0, vectors.shape[1], BLOCK_DIMS)
                cells = [pickle.dumps(whole_numbers(np.ascontiguousarray(vectors[:, b : b + BLOCK_DIMS]), scale), 5) for b in blocks]
                ids = pa.array([part.column(0).to_pylist() if not b else None for b in blocks], pa.list_(part.schema.field(0).type))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * len(blocks), pa.int64()), pa.array([b // BLOCK_DIMS for b in blocks], pa.int32()), ids, pa.array(cells, pa.binary())],
                    names=["group", "block", "ids", "cells"],
                )
                group += 1

    return spread(kept.select(id_col, vector_col)).mapInArrow(run, f"group long, block int, ids array<{id_type}>, cells binary")


def assign(blocks: DataFrame, centers: list[list[int]]) -> DataFrame:
    """(group, labels, distances): per group of rows the nearest centroids."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                own = slice(b * BLOCK_DIMS, (b + 1) * BLOCK_DIMS)
                out.append(pickle.dumps(partial_distances(pickle.loads(cells), [c[own] for c in centers]), 5))
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(out, pa.binary())], names=["group", "partial"])

    def nearest(table: pa.Table) -> pa.Table:
        total = sum(pickle.loads(p) for p in table.column("partial").to_pylist())
        label = np.argmin(total, axis=1)
        least = [min(int(d), LARGEST) for d in total[np.arange(len(label)), label]]
        return pa.table(
            {
                "group": table.column("group").slice(0, 1),
                "labels": pa.array([label.astype(np.int32)], pa.list_(pa.int32())),
                "distances": pa.array([least], pa.list_(pa.int64())),
            }
        )

    partial = blocks.select("group", "block", "cells").mapInArrow(measure, "group long, partial binary")
    return partial.groupBy("group").applyInArrow(nearest, "group long, labels array<int>, distances array<long>")


def next_centroids(blocks: DataFrame, labels: DataFrame, centers: list[list[int]]) -> list[list[int]]:
    """Every shard's slice of the mean vectors, rounded down; clusters without rows stay."""
    k = len(centers)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for b, cells, label in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "labels")), strict=True):
                x, label = pickle.loads(cells), np.array(label)
                held = sums.setdefault(b, [[0, [0] * x.shape[1]] for _ in range(k)])
                for j in np.unique(label):
                    own = x[label == j]
                    held[j] = [held[j][0] + len(own), [s + int(v) for s, v in zip(held[j][1], own.sum(axis=0), strict=True)]]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pickle.dumps(s) for s in sums.values()], pa.binary())], names=["block", "sums"])

    def divide(table: pa.Table) -> pa.Table:
        b = table.column("block")[0].as_py()
        parts = [pickle.loads(p) for p in table.column("sums").to_pylist()]
        new = []
        for j in range(k):
            count = sum(p[j][0] for p in parts)
            columns = [sum(v) for v in zip(*(p[j][1] for p in parts), strict=True)]
            new.append([v // count for v in columns] if count else centers[j][b * BLOCK_DIMS : (b + 1) * BLOCK_DIMS])
        return pa.table({"block": table.column("block").slice(0, 1), "slice": pa.array([pickle.dumps(new)], pa.binary())})

    sums = blocks.join(labels.select("group", "labels"), "group").select("block", "cells", "labels").mapInArrow(add, "block int, sums binary")
    slices = {r["block"]: pickle.loads(r["slice"]) for r in sums.groupBy("block").applyInArrow(divide, "block int, slice binary").collect()}
    return [[v for b in sorted(slices) for v in slices[b][j]] for j in range(k)]


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    salt: str = "3:",
) -> DataFrame:
    """Per kept vector: id, ``cluster``, ``distance`` (squared, on the scaled integers), ``cluster_inertia``,
    ``inertia`` and ``centroid`` (the components of its final centroid)."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    kept = kept_vectors(df.select(F.col(f"`{id_col}`").alias("own_id"), F.col(f"`{vector_col}`").alias("vector")), "vector", dims)
    centers = first_centroids(kept, "own_id", "vector", k, salt, scale)
    if not centers:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<decimal(38,0)>")
    stored = materialize(column_blocks(kept, "own_id", "vector", scale), "column-blocks")
    blocks = stored.select("group", "block", "cells").repartition("group").persist()
    for _ in range(rounds):
        centers = next_centroids(blocks, assign(blocks, centers), centers)
    final = materialize(assign(blocks, centers), "clusters")
    blocks.unpersist()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c).flatten() for c in ("ids", "labels", "distances")], names=["own_id", "cluster", "distance"])

    found = stored.filter("block = 0").select("group", "ids").join(final, "group").select("ids", "labels", "distances")
    found = found.mapInArrow(rows, f"own_id {id_type}, cluster int, distance long")
    parts = final.select(F.explode(F.arrays_zip("labels", "distances")).alias("x")).groupBy(F.col("x.labels").alias("cluster"))
    sums = {r[0]: int(r[1]) for r in parts.agg(F.sum(F.col("x.distances").cast("decimal(38,0)"))).collect()}  # one row per cluster
    total = min(sum(sums.values()), LARGEST)
    facts = spark.createDataFrame(
        [(j, min(sums.get(j, 0), LARGEST), total, [str(v) for v in c]) for j, c in enumerate(centers)],
        "cluster int, cluster_inertia long, inertia long, centroid array<string>",
    )
    facts = facts.withColumn("centroid", F.col("centroid").cast("array<decimal(38,0)>"))
    return found.join(F.broadcast(facts), "cluster").select(F.col("own_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(components):
    """sha256 of the components as decimal integers joined by commas, as a column."""
    return F.sha2(F.array_join(F.transform(components, lambda v: v.cast("string")), ","), 256)
