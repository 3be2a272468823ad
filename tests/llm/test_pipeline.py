"""The pipeline, stage by stage, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from llm_helpers import ODD, docs_of, prose
from test_lines_urls import plain_dedup, plain_measures
from test_near_duplicates import edited, plain_components

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: clean, toxic, short, repetitive, copied and boilerplate texts."""
    rng = random.Random(31)
    rows, toxic = [], {}
    for i in range(300):
        text, kind = prose(rng, rng.randrange(30, 120)), rng.randrange(8)
        if kind == 0:
            text = text.replace("\n", " vilest nasty ", 1) + " vilest"
        elif kind == 1:
            text = "too short"
        elif kind == 2:
            text = " ".join(["again and again it says so"] * 12)
        elif kind == 3 and i > 20:
            text = edited(rng, rows[rng.randrange(20)][1], 0.01) or text
        toxic[i] = int("vilest" in text)
        rows.append((i, text + "\nRead more on our site\n" * (kind % 2), rng.choice("ab"), "en"))
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs_of(spark, [*rows, rows[0], *((None if i is None else 5000 + i, t) for i, t in ODD)]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, toxic


def test_stages(spark, corpus):
    folder, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    before = rows(docs)

    one = corpus_pipeline.quality(spark, docs, folder)
    assert one.columns == columns
    after = rows(one)
    good = [(i, t) for i, t in before if (m := plain_measures(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]]
    assert sorted(after, key=repr) == sorted(good, key=repr)

    two = corpus_pipeline.toxicity(spark, one, folder)
    assert two.columns == columns
    left = {i for i, _ in rows(two)}
    kept = [(i, t) for i, t in after if not toxic.get(i)]
    assert len(left ^ {i for i, _ in kept}) <= 0.02 * len(kept)

    three = corpus_pipeline.line_dedup(spark, two, folder)
    assert three.columns == columns
    want = {(i, h) for i, _, _, h in plain_dedup(rows(two), 10)}
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in three.collect()} == want
    assert all(r.n_chars == len(r.text) for r in three.collect())

    four = corpus_pipeline.near_dedup(spark, three, folder)
    assert four.columns == columns
    groups = plain_components(rows(three), 5, 80)
    assert sorted(i for i, _ in rows(four)) == sorted(set(groups.values()))

    five = corpus_pipeline.packing(spark, four, folder).collect()
    assert {r.doc_id for r in five} == set(groups.values())
    by = {}
    for r in five:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist() and sum(n for _, n in own) <= 4096


def test_run_and_empty(spark, corpus, tmp_path):
    folder, _ = corpus
    done = corpus_pipeline.run(spark, folder)
    assert done.count() and done.columns[:4] == ["doc_id", "piece", "start", "length"]
    empty = str(tmp_path / "none")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_null_texts_stay_null_in_line_dedup(spark):
    docs = docs_of(spark, ODD)
    got = corpus_pipeline.line_dedup(spark, docs, "")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((tuple(r) for r in docs.collect()), key=repr)
    assert got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType


def test_quality_rejects_boilerplate_of_small_hosts(spark):
    rng = random.Random(8)
    menu = " ".join(f"entry{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(40))
    notice = " ".join(f"notice{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(40))
    own = lambda i: "".join(chr(97 + int(c)) for c in str(100 + i))
    rows = [(i, prose(rng, 40), "small") for i in range(48)]
    rows += [(100 + i, f"{menu}\n{own(i)} page", "small") for i in range(12)]
    rows += [(200 + i, f"{notice}\n{own(i)} note", "small") for i in range(5)]  # by chance
    rows += [(300 + i, f"{menu}\n{own(i)} page", "other") for i in range(3)]
    left = {r.doc_id for r in corpus_pipeline.quality(spark, docs_of(spark, rows), "").collect()}
    assert left == {i for i, *_ in rows if not 100 <= i < 200}


def test_ten_copies_lose_their_text_and_keep_their_ids(spark):
    rng = random.Random(12)
    ten, nine = prose(rng, 40), prose(rng, 40)
    docs = docs_of(spark, [(i, ten) for i in range(10)] + [(20 + i, nine) for i in range(9)])
    done = corpus_pipeline.line_dedup(spark, docs, "")
    assert {r.doc_id: (r.text, r.n_chars) for r in done.collect()} == {**{i: ("", 0) for i in range(10)}, **{20 + i: (nine, len(nine)) for i in range(9)}}
    left = corpus_pipeline.near_dedup(spark, done, "")
    assert sorted(r.doc_id for r in left.collect()) == [*range(10), 20]


def test_rows_of_one_id(spark):
    """Unlike texts under one id both stay; of rows equal in id and words one stays."""
    rng = random.Random(14)
    a, b, c = prose(rng, 30), prose(rng, 30), prose(rng, 30)
    docs = docs_of(spark, [(1, a), (1, b), (2, c), (2, c), (2, c.upper()), (3, c), (None, a), (None, a)])
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in left.collect())
    assert [i for i, _ in got] == [0, 0, 1, 1, 2] and {t for i, t in got if i == 1} == {a, b}
    assert got[-1][1] == min(c, c.upper())
