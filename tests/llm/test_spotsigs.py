"""Operator 11 against plain Python and SQL."""

import hashlib
import random

import duckdb
import regex
from conftest import SF_SMALL
from llm_helpers import ODD, docs_of
from pyspark.sql import functions as F

from lexigen.llm import queries
from lexigen.llm.spotsigs import COMMON, FLOOR, fingerprints, length_class, likeness


def plain_set(text):
    found = ["^", *regex.findall(r"[\p{L}\p{N}]+", text.lower())]
    common = [i == 0 or w in COMMON or len(w) <= 2 for i, w in enumerate(found)]
    content = [w for w, c in zip(found, common, strict=True) if not c]
    out, k = set(), 0
    for i, w in enumerate(found):
        if not common[i]:
            if common[i - 1]:
                out.add(hashlib.md5(" ".join([found[i - 1], *content[k : k + 3]]).encode()).hexdigest()[:10])
            k += 1
    return out


def plain_likeness(a, b):
    j = len(a & b) / len(a | b) if a | b else 1.0
    return j if j >= FLOOR else 0.0


def plain(rows):
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t or "")
    ring = sorted((i for i in by_id if i is not None), reverse=True) + [None] * (None in by_id)
    out = []
    for i, t in rows:
        t = t or ""
        other = min(by_id[ring[(ring.index(i) + 1) % len(ring)]], key=lambda x: (hashlib.md5(x.encode()).digest(), x))
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        sets = plain_set(t), plain_set(edited), plain_set(other)
        prints = ["".join(sorted(s)) for s in sets[:2]]
        out.append((i, len(t), edited, *prints, plain_likeness(sets[0], sets[1]), plain_likeness(sets[0], sets[2])))
    return sorted(out, key=repr)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "a", "Und", "les,", "como", *(f"word{rng.randrange(60)}" for _ in range(6)), "élan", "x.y"]) for _ in range(n))


def test_odd_texts(spark):
    rng = random.Random(8)
    rows = [*ODD, (9, "the"), (10, "\U0001f600" * 7 + "the end of all things"), (-5, "of many words, the few")]
    rows += [(100 + k, prose(rng, rng.randrange(1, 80))) for k in range(80)]
    rows += [(300, rows[-1][1]), (301, rows[-1][1]), (302, prose(rng, 6000))]
    rows += [(7, f"the shared id number {k} of seven") for k in range(40)]
    got = sorted((tuple(r) for r in fingerprints(docs_of(spark, rows).repartition(4)).collect()), key=repr)
    assert got == plain(rows)


def test_one_and_none(spark):
    one = [(3, "the quick brown fox of the north")]
    assert [tuple(r) for r in fingerprints(docs_of(spark, one)).collect()] == plain(one)
    assert fingerprints(docs_of(spark, one).limit(0)).count() == 0


def test_pruned_pairs_are_unlike(spark):
    """No pair that the length classes rule out reaches the floor, and all others keep their likeness."""
    rng = random.Random(9)
    rows = []
    for k in range(300):
        a = {rng.randrange(60) for _ in range(rng.choice([0, 1, 2, 5, 30, 300]))}
        b = {rng.randrange(60) for _ in range(rng.choice([0, 1, 2, 5, 30, 300]))} if k % 3 else a
        rows.append((sorted(map(str, a)), sorted(map(str, b))))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for floor in (FLOOR, 0.3, 0.8):
        for r in df.select("a", "b", likeness(F.col("a"), F.col("b"), floor).alias("x")).collect():
            a, b = set(r["a"]), set(r["b"])
            j = len(a & b) / len(a | b) if a | b else 1.0
            assert r["x"] == (j if j >= floor else 0.0)


def test_length_classes_at_powers(spark):
    sizes = spark.createDataFrame([(0,), (1,), (19,), (20,), (400,), (8000,)], "n int")
    assert [r[0] for r in sizes.select(length_class(F.col("n"), 0.05)).collect()] == [-2, 0, 0, 1, 2, 3]


def test_main_path_is_native(spark):
    plan = queries.op11_spot_signatures(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapPartitions", "ExternalRDD"))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    got = queries.op11_spot_signatures(spark, SF_SMALL)
    rows = con.execute(queries.ORACLE_SQL["op11_spot_signatures"])
    assert got.columns == [c[0] for c in rows.description]
    assert sorted(map(tuple, got.collect())) == sorted(rows.fetchall())
