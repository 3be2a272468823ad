"""Operator 13 against plain Lloyd on Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
from conftest import SF_SMALL
from pyspark.sql import functions as F

from lexigen.llm import queries
from lexigen.llm.centroids import LARGEST, centroid_digest, cluster


def plain(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v], v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centers = [x for _, x, _ in sorted(kept, key=lambda r: (digest(r[0]), r[2]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centers)) for _, x, _ in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centers)):
            own = [x for (_, x, _), (_, c) in zip(kept, found, strict=True) if c == j]
            if own:
                centers[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    found = assign()
    total = sum(d for d, _ in found)
    inertia = [sum(d for d, c in found if c == j) for j in range(len(centers))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    cut = lambda v: min(v, LARGEST)
    return [(i, j, cut(d), cut(inertia[j]), cut(total), digests[j]) for (i, _, _), (d, j) in zip(kept, found, strict=True)]


def result(df):
    out = cluster(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_digest(F.col("centroid")))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 11, 0.4) * (-1) ** (i % 3) for _ in range(64)]) for i in range(700)]
    rows += [(i, [float("nan")] * 64) for i in range(3)] + [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [0.5] * 63 + [None]), (1004, [0.5] * 63 + [float("inf")])]
    rows += [(2000, [0.25] * 64)] * 300 + [(None, [0.0] * 64), (7, [3.0] * 64), (7, [2.0] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(5)
    assert result(df) == sorted(plain(rows), key=repr)


def test_few_and_large(spark):
    rows = [(1, [1e30] * 64), (2, [-1e30] * 32 + [0.1] * 32), (3, [2.0**43] * 64), (4, [0.3] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(df) == sorted(plain(rows), key=repr)
    assert result(df.limit(0)) == []


def test_copies_leave_clusters_empty(spark):
    rows = [(i, [1.0] * 64) for i in range(40)] + [(99, [2.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert result(df) == sorted(plain(rows), key=repr)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_SMALL}/embeddings.parquet')")
    got = queries.op13_centroid_clustering(spark, SF_SMALL)
    rows = con.execute(queries.ORACLE_SQL["op13_centroid_clustering"])
    assert got.columns == [c[0] for c in rows.description]
    assert sorted(map(tuple, got.collect())) == sorted(rows.fetchall())
