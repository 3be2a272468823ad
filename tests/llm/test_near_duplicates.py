"""Operator 4 against comparing every pair, with large groups of copies and near copies."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD, VOCAB, WORD, docs_of, prose

from lexigen.llm import minhash, queries
from lexigen.llm.common import HashOf, lower_ascii, window_hashes
from lexigen.llm.components import components, joined_components


def plain_set(text, n):
    found = WORD.findall(lower_ascii(text or ""))
    if not found:
        return frozenset()
    n = min(n, len(found))
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def plain_components(rows, n, percent):
    sets = [(i, plain_set(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in sets}


def edited(rng, text, share):
    out = []
    for w in text.split():
        x = rng.random()
        if x < share:
            out += [] if x < share / 3 else [rng.choice(VOCAB)] if x < share / 1.5 else [w, rng.choice(VOCAB)]
        else:
            out.append(w)
    return " ".join(out)


@pytest.mark.parametrize("small", [2, 8])
def test_groups_of_copies(spark, small):
    rng = random.Random(12)
    rows = []
    for size, share in ((1, 0), (60, 0.04), (60, 0.07), (40, 0.0), (25, 0.1), (2, 0.02)):
        base = prose(rng, 120)
        family = [edited(rng, base, rng.random() * 2 * share) for _ in range(size)]
        second = [edited(rng, rng.choice(family), 0.03) for _ in range(size // 3)]
        rows += [*family, *second]
    rows += [prose(rng, rng.randrange(1, 60)) for _ in range(60)]
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    got = minhash.near_duplicates(docs_of(spark, rows), small=small).collect()
    want = plain_components(rows, 5, 80)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id]) and r.n_shingles == len(plain_set(rows[r.doc_id][1], 5)) for r in got)
    assert Counter(want.values()).most_common(1)[0][1] > 20


def test_texts_put_together_from_shared_passages(spark):
    """Many texts that share passages with one another, few of them linked: every link is found, and few pairs are made for it."""
    rng = random.Random(21)
    pool = [prose(rng, rng.randrange(15, 45)) for _ in range(14)]
    rows = []
    for i in range(260):
        parts = rng.sample(pool, rng.randrange(2, 6)) + ([prose(rng, rng.randrange(1, 25))] if i % 3 else [])
        rows.append((i, " ".join(parts)))
    for i in range(40):
        rows.append((300 + i, edited(rng, rng.choice(rows)[1], 0.02)))
    made = []
    pairs = minhash.remaining_pairs

    def counted(*given):
        made.append(pairs(*given))
        return made[-1]

    minhash.remaining_pairs = counted
    try:
        got = minhash.near_duplicates(docs_of(spark, rows), small=2, bands=60, rows=2).collect()
    finally:
        minhash.remaining_pairs = pairs
    want = plain_components(rows, 5, 80)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(rows) and made[0].count() < 2 * len(rows)


def test_odd_rows(spark):
    docs = docs_of(spark, [*ODD, (8, "ONE"), (9, "x" * 5000)])
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, shingle=3, percent=85).collect()), key=repr)
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(ODD) + 2
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[4] == (0, 4, True)
    assert by[8] == (1, 5, False) and by[9] == (1, 6, False) and by[None] == (3, None, True)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table(spark):
    got = queries.op4_minhash_near_dedup(spark, SF_SMALL).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert {r.doc_id: r.component_id for r in got} == plain_components(rows, 3, 85)


def test_signature_agreement_estimates_similarity():
    rng = random.Random(3)
    shared, errors = [f"s{i}" for i in range(300)], []
    hashes = HashOf()
    for own in (30, 75, 150):
        a = np.array([hashes[x] for x in shared + [f"a{rng.random()}" for _ in range(own)]], np.uint64)
        b = np.array([hashes[x] for x in shared + [f"b{rng.random()}" for _ in range(own)]], np.uint64)
        agree = (minhash.signature(a, 512) == minhash.signature(b, 512)).mean()
        errors.append(abs(agree - 300 / (300 + 2 * own)))
    assert max(errors) < 0.08


def test_circular_shift():
    """Coordinate k of a single shingle reads the table k places on, round the end."""
    table = minhash.circular_table(8)
    assert table.shape == (minhash.PLACES, 8)
    assert table[-1, 1:].tolist() == table[:7, 0].tolist()
    assert sorted(table[:, 0][:10]) != table[:, 0][:10].tolist()
    assert len(np.unique(table[:, 0])) == minhash.PLACES


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.integers(1, 5))
def test_windows(found, n):
    hashes = HashOf()
    got = window_hashes(np.array([hashes[w] for w in found], np.uint64), n)
    n = min(n, len(found))
    want = [tuple(found[i : i + n]) for i in range(len(found) - n + 1)] if found else []
    assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 300 + i) for i in range(40)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_further_links_join_components(spark):
    first = [(2, 1), (2, 1), (1, 2), (4, 3), (6, 5), (7, 7)]
    labels = components(spark.createDataFrame(first, "u long, v long"))
    more = spark.createDataFrame([(4, 2), (4, 2), (5, 6)], "u long, v long")
    got = {r.node: r.component for r in joined_components(labels, more).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    same = {r.node: r.component for r in joined_components(labels, more.limit(0)).collect()}
    assert same == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
