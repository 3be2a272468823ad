"""Exact split, batches, global rank and fine-tuning examples."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from lexigen.operators import sft as S
from lexigen.operators import split as SP
from lexigen.plans import fixtures as FX


def test_exact_split_sizes_disjoint_and_stable(spark):
    docs = FX.table(spark, SF_MID, "documents").select("doc_id")
    n = docs.count()
    a = SP.exact_split(docs.repartition(1), "doc_id")
    b = SP.exact_split(docs.repartition(16), "doc_id")
    ta = {r[0] for r in a.filter("split = 'test'").select("doc_id").collect()}
    tb = {r[0] for r in b.filter("split = 'test'").select("doc_id").collect()}
    assert len(ta) == math.ceil(0.2 * n)
    assert ta == tb
    assert a.count() == n and a.select("doc_id").distinct().count() == n


def test_rank_is_a_permutation(spark):
    docs = FX.table(spark, SF_MID, "documents").select("doc_id")
    ranks = sorted(x[0] for x in SP.global_rank(docs, "doc_id").select("rank").collect())
    assert ranks == list(range(1, docs.count() + 1))


def hot(spark):
    """One key on a third of 3000 different rows, and 900 copies of one row."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    return df.unionByName(spark.range(900).select(F.lit(-1).cast("long").alias("k"), F.lit(-1).cast("long").alias("v")))


@pytest.mark.parametrize("range_rows, chunk", [(3, 50), (1, 7)])
def test_order_does_not_depend_on_how_work_is_dealt(spark, monkeypatch, range_rows, chunk):
    """Equal input gives equal output on both sides of every bound."""
    df = hot(spark)
    want = sorted(map(tuple, SP.exact_split(df, "k", 0.2, 5).collect()))
    ranks = sorted(map(tuple, SP.global_rank(df, "k", seed=5).collect()))
    batches = sorted(map(tuple, SP.assign_batches(df, "k", 7, 2, 5).collect()))
    monkeypatch.setattr(SP, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(SP, "COPY_CHUNK", chunk)
    again = df.repartition(7)
    assert sorted(map(tuple, SP.exact_split(again, "k", 0.2, 5).collect())) == want
    assert sorted(map(tuple, SP.global_rank(again, "k", seed=5).collect())) == ranks
    assert sorted(map(tuple, SP.assign_batches(again, "k", 7, 2, 5).collect())) == batches
    assert sum(r[2] == "test" for r in want) == 780 and len(want) == 3900
    assert sorted(r[2] for r in ranks) == list(range(1, 3901))


def test_split_agrees_with_the_rank(spark):
    df = hot(spark)
    for share in (0.0, 0.001, 0.5, 0.7, 1.0):
        need = math.ceil(share * 3900)
        first = Counter((r.k, r.v) for r in SP.global_rank(df, "k", seed=9).filter(F.col("rank") <= need).collect())
        assert Counter((r.k, r.v) for r in SP.exact_split(df, "k", share, 9).filter("split = 'test'").collect()) == first


def test_rows_come_back_untouched(spark):
    rows = [(1, -0.0, {"a": 1}, b"\xff"), (1, 0.0, {"a": 1}, None), (None, float("nan"), None, b""), (2, None, {}, b"x")]
    df = spark.createDataFrame(rows, "k int, v double, m map<string,int>, b binary")
    want = sorted(repr(tuple(r)) for r in df.collect())
    for out in (SP.exact_split(df, "k", 0.5), SP.global_rank(df, "k", ["k"]), SP.assign_batches(df, "k", 2)):
        assert sorted(repr(tuple(r)) for r in out.select("k", "v", "m", "b").collect()) == want
    assert SP.exact_split(df.limit(0), "k").count() == SP.global_rank(df.limit(0)).count() == 0


def test_null_groups_are_ranked(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a"), (5, "")], "id int, g string")
    got = SP.global_rank(df, "id", ["g"], total_col="n").collect()
    assert sorted((repr(r.g), r.rank, r.n) for r in got) == sorted([(repr(""), 1, 1), ("None", 1, 2), ("None", 2, 2), (repr("a"), 1, 2), (repr("a"), 2, 2)])


def test_batches_full_but_last(spark):
    cases = FX.cases(spark, SF_SMALL).select("case_id")
    n = cases.count()
    b = SP.assign_batches(cases, "case_id", size=6, epochs=3)
    sizes = b.groupBy("epoch", "batch_id").count().collect()
    per_epoch = {}
    for r in sizes:
        per_epoch.setdefault(r["epoch"], []).append((r["batch_id"], r["count"]))
    assert sorted(per_epoch) == [0, 1, 2]
    for e, lst in per_epoch.items():
        lst.sort()
        assert [c for _, c in lst[:-1]] == [6] * (len(lst) - 1)
        assert sum(c for _, c in lst) == n
    orders = [
        [r["case_id"] for r in b.filter(F.col("epoch") == e).orderBy("batch_id", "case_id").collect()] for e in range(3)
    ]
    assert orders[0] != orders[1]


def test_sft_masks_and_labels(spark):
    pairs = FX.sft_input(spark, SF_SMALL)
    ex = S.sft_examples(pairs, key="key")
    prof = pairs.select(
        "key",
        F.size(S.tokens(S.render_completion_prompt("prompt"))).alias("p"),
        F.size(S.tokens(F.coalesce("response", F.lit("nan")))).alias("r"),
    )
    rows = ex.join(prof, "key").collect()
    assert rows
    for r in rows:
        L = S.MAX_LEN
        assert len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"]) == L
        n = min(L, r["p"] + r["r"] + 1)
        plen = min(L, r["p"])
        assert sum(r["attention_mask"]) == n
        lab = r["labels"]
        assert all(x == -100 for x in lab[:plen]) and all(x == -100 for x in lab[n:])
        assert lab[plen:n] == r["input_ids"][plen:n]
        if r["p"] + r["r"] + 1 <= L:
            assert r["input_ids"][n - 1] == S.EOS_ID
    kept = S.drop_unsupervised(ex).count()
    assert kept == sum(1 for r in rows if min(S.MAX_LEN, r["p"] + r["r"] + 1) > min(S.MAX_LEN, r["p"]))


def test_completion_slice(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 2), ([1], 1), ([1, 2], 5)], "o array<int>, p int")
    assert [r[0] for r in df.select(S.completion("o", "p")).collect()] == [[3, 4], [], []]


def test_vocab_top_k_and_ids(spark):
    docs = FX.table(spark, SF_SMALL, "documents")
    v = S.build_vocab(docs, "text", 50)
    rows = v.orderBy("token_id").collect()
    assert len(rows) == 50 and rows[0]["token_id"] == S.RESERVED
    assert all(a["n"] >= b["n"] for a, b in zip(rows, rows[1:]))
    known = {r["token"]: r["token_id"] for r in rows}
    texts = spark.createDataFrame([*((r.doc_id, r.text) for r in docs.collect()), (-1, None), (-2, ""), (-3, " \t"), (-3, " \t")], "doc_id long, text string")
    want = sorted((r.doc_id, [known.get(w, S.UNK_ID) for w in (r.text or "").split()]) for r in texts.collect())
    assert sorted((r.doc_id, r.ids) for r in S.vocab_ids(texts, "doc_id", "text", v).collect()) == want
    assert sorted((r.doc_id, r.ids) for r in S.join_ids(texts, "doc_id", "text", v).collect()) == want
    assert max(len(r.ids) for r in S.vocab_ids(texts, "doc_id", "text", v, max_len=5).collect()) == 5


def test_bounded_vocabulary_equals_the_full_count(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(3000)], k=60)) for _ in range(600)] + [None, "", " \u2003 "]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8).cache()
    full = S.build_vocab
    for size, held, counted in [(20, None, 0), (20, 600, 0), (20, 40, None), (2000, 5, 1), (2999, 50, 1)]:
        want = sorted(map(tuple, full(df, "text", size).collect()))
        calls = []
        monkeypatch.setattr(S, "build_vocab", lambda *a: calls.append(a) or full(*a))
        assert sorted(map(tuple, S.build_vocab_bounded(df, "text", size, held).collect())) == want, (size, held)
        assert counted is None or len(calls) == counted, (size, held)
        monkeypatch.undo()
    parts = S.word_summaries(df, "text", 600)
    assert parts.filter("token IS NULL AND n > 0").count() > 0
    assert parts.filter("token IS NOT NULL").count() <= 600 * parts.rdd.getNumPartitions()
    assert S.build_vocab_bounded(df.limit(0), "text", 5).count() == 0
    with pytest.raises(ValueError, match="at most"):
        S.build_vocab_bounded(df, "text", S.MAX_VOCAB + 1)


def test_bounded_vocabulary_with_partitions_that_count_nothing(spark):
    """Partitions without a row (a file read as more splits than row groups), without a text and without a wanted word."""
    held = [["a b c"] * 60, [None] * 3, [" ".join(f"r{i}" for i in range(30))]]
    n = max(16, spark.sparkContext.defaultParallelism)
    rows = spark.sparkContext.parallelize(range(n), n).flatMap(lambda i: [(t,) for t in held[i]] if i < len(held) else [])
    df = spark.createDataFrame(rows, "text string")
    assert df.rdd.getNumPartitions() == n
    want = sorted(map(tuple, S.build_vocab(df, "text", 2).collect()))
    assert sorted(map(tuple, S.build_vocab_bounded(df, "text", 2, held=4).collect())) == want


def test_vocabulary_bound(spark, monkeypatch):
    docs = FX.table(spark, SF_SMALL, "documents")
    with pytest.raises(ValueError):
        S.build_vocab(docs, "text", S.MAX_VOCAB + 1)
    v = S.build_vocab(docs, "text", 20)
    want = sorted(map(tuple, S.vocab_ids(docs, "doc_id", "text", v).collect()))
    monkeypatch.setattr(S, "MAX_VOCAB", 10)
    assert sorted(map(tuple, S.vocab_ids(docs, "doc_id", "text", v).collect())) == want
    with pytest.raises(ValueError):
        S.word_ids("text", v)


def test_sft_examples_by_vocabulary(spark):
    pairs = FX.sft_input(spark, SF_SMALL)
    v = S.build_vocab(pairs, "response", 100)
    known = {r["token"]: r["token_id"] for r in v.collect()}
    hashed = {r["key"]: r for r in S.sft_examples(pairs, key="key").collect()}
    source = {r["key"]: r for r in pairs.select("key", S.tokens(S.render_completion_prompt("prompt")).alias("p"), S.tokens("response").alias("r")).collect()}
    for r in S.sft_examples(pairs, key="key", vocabulary=v).collect():
        words = (source[r["key"]]["p"] + source[r["key"]]["r"])[: S.MAX_LEN]
        assert r["input_ids"][: len(words)] == [known.get(w, S.UNK_ID) for w in words]
        assert r["attention_mask"] == hashed[r["key"]]["attention_mask"] and r["n_supervised"] == hashed[r["key"]]["n_supervised"]


def test_long_conversations_keep_case_ids_apart(spark, tmp_dir):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in (1, 2, 12) for t in range(2000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_dir}/conversations.parquet")
    cases = FX.cases(spark, tmp_dir)
    assert cases.count() == cases.select("case_id").distinct().count() == 3000




NESTED = "a array<string>, s struct<x:string,y:string>, m map<string,array<string>>, n array<array<int>>"


@pytest.fixture(scope="module")
def nested(spark):
    rows = [
        (["a, b"], ("1", "2"), {"k": ["v"]}, [[1], [2]]),
        (["a", "b"], ("1", "2"), {"k": ["v"]}, [[1], [2]]),
        (["a", "b"], ("1, 2", None), {"k": ["v"]}, [[1], [2]]),
        (["a", "b"], ("1, 2", "null"), {"k": ["v"]}, [[1], [2]]),
        (["a", "b"], None, {"k": ["v"]}, [[1], [2]]),
        (["a", "b"], (None, None), {"k": ["v"]}, [[1], [2]]),
        (["a", "b"], ("1", "2"), {"k": ["v", None]}, [[1], [2]]),
        (["a", "b"], ("1", "2"), {"k": ["v", "null"]}, [[1], [2]]),
        (["a", "b"], ("1", "2"), {"k": ["v"]}, [[1, 2]]),
        (["a", "b"], ("1", "2"), {"k": ["v"]}, [[1], [], [2]]),
        (["a", "b"], ("1", "2"), {"k": None}, [[1], None]),
        (["a", "b"], ("1", "2"), {}, []),
        (["a", "b"], ("1", "2"), None, None),
        ([], ("1", "2"), None, None),
        ([""], ("1", "2"), None, None),
        ([None], ("1", "2"), None, None),
        (None, ("1", "2"), None, None),
    ]
    return spark.createDataFrame(rows, NESTED)


def test_nested_rows_stay_apart(spark, nested):
    """Rows that differ only inside lists, structs or maps are different rows, and every one comes back."""
    want = sorted(repr(tuple(r)) for r in nested.collect())
    assert len(set(want)) == len(want)
    cells = nested.select(SP.row_hash(nested, nested.columns, 1).alias("h"))
    assert cells.distinct().count() == len(want)
    for key in (None, "s", "m"):
        for out in (SP.exact_split(nested, key, 0.5), SP.global_rank(nested, key), SP.assign_batches(nested, key, 2)):
            assert sorted(repr(tuple(r)) for r in out.select(*nested.columns).collect()) == want
    assert sorted(r["rank"] for r in SP.global_rank(nested, "a").collect()) == list(range(1, len(want) + 1))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.text(alphabet="a1:-, ", max_size=3)), max_size=4), min_size=2, max_size=12))
def test_cells_tell_lists_apart(spark, lists):
    df = spark.createDataFrame([(x, {"k": x}, (x, 1)) for x in lists], "a array<string>, m map<string,array<string>>, s struct<a:array<string>,n:int>")
    different = len({repr(x) for x in lists})
    for c in df.columns:
        assert df.select(SP.row_hash(df, [c], 0)).distinct().count() == different


def test_equal_maps_and_instants(spark):
    """Maps are equal in any order; two instants that a clock shows alike are different."""
    maps = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert maps.select(SP.row_hash(maps, ["m"], 0)).distinct().count() == 1
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        times = spark.sql("SELECT timestamp_micros(1698539400000000) AS t UNION ALL SELECT timestamp_micros(1698543000000000)")
        assert times.select(F.col("t").cast("string")).distinct().count() == 1
        assert times.select(SP.row_hash(times, ["t"], 0)).distinct().count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    odd = spark.sql("SELECT parse_json('[1, 2]') AS v UNION ALL SELECT parse_json('[1,2]') UNION ALL SELECT parse_json('\"[1,2]\"')")
    assert odd.select(SP.row_hash(odd, ["v"], 0)).distinct().count() == 2


def test_permutation_of_any_size(spark):
    """Every number once, another order for every epoch and seed."""
    for n in (1, 2, 3, 7, 64, 1000):
        seen = set()
        for epoch, seed in ((0, 42), (1, 42), (0, 43)):
            keys = F.array(*[F.lit(k).cast("long") for k in SP.permutation_keys(seed, epoch)])
            got = [r[0] for r in spark.range(n).select(SP.permuted(F.col("id"), F.lit(n).cast("long"), keys)).collect()]
            assert sorted(got) == list(range(n))
            seen.add(tuple(got))
        assert len(seen) == 3 or n < 64


def test_epochs_are_unlike(spark):
    """Neighbours of one epoch are rarely neighbours in another."""
    df = spark.range(4000)
    both = SP.assign_batches(df, "id", 4, 2).groupBy("id").pivot("epoch", [0, 1]).agg(F.first("batch_id"))
    pairs = both.groupBy("0", "1").count()
    assert pairs.count() > 3950
