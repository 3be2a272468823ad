"""Operators 1, 2 and 5 against the libraries, whole and at every prefix."""

import random
import time
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD, docs_of
from tokenizers import Tokenizer

from lexigen.llm import packing, pieces, queries, token_counts

ODD_TEXTS = ["", " ", "a", "don't DON'T 're'", "é ẞ İ ǅ Σς", "<|endoftext|>x<|startoftext|>", "a\x1cb\x85c d e", "\U0001f600漢字 ▁x  y\n\n z", "x" * 3000, "9 99 999"]


@cache
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    return library()


@pytest.fixture(scope="module")
def counter():
    return token_counts.WordCounter(token_counts.default_vocabulary())


@pytest.fixture(scope="module")
def piece_bpe():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(pieces.default_model())


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_odd_texts(text, word_bpe, counter, piece_bpe, coder):
    assert counter.table(text).total == len(word_bpe.encode(text, add_special_tokens=False).ids)
    assert coder.encode(text).tolist() == piece_bpe.encode(text)
    assert coder.decode(piece_bpe.encode(text)) == piece_bpe.decode(piece_bpe.encode(text))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdest 'TEÉß\n<|>1.,▁漢́", max_size=40))
def test_every_prefix_and_cut(text):
    tok, counter = library(), token_counts.counter_for(None)
    real = [len(tok.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
    table = counter.table(text)
    assert table.every_prefix() == real
    for budget in (0, 1, 4):
        assert table.cut(budget) == max(p for p, n in enumerate(real) if n <= budget)


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="abst'REéÉß漢字\u0301\u0323e가ᄀ1.,!<|endoftext|>\U0001f600", max_size=30), st.sampled_from(["", "<|endoftext|>", "<|startoftext|>x", "don't", "\u1100\u1161"]), st.integers(0, 12))
def test_cut_inside_a_chunk(text, middle, budget):
    tok, counter = library(), token_counts.counter_for(None)
    text = text[: len(text) // 2] + middle + text[len(text) // 2 :]
    real = [len(tok.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
    table = counter.table(text)
    assert table.every_prefix() == real
    assert table.cut(budget) == max(p for p, n in enumerate(real) if n <= budget)


@pytest.mark.parametrize("alphabet", ["漢字人大中国日本語学生先", "abcdefgh", "ab1,.", "éèüß", "a\u0301e\u0323", "漢a1!'s", "한국어"])
def test_long_chunks_are_cut_in_linear_time(alphabet):
    tok, counter, rng = library(), token_counts.counter_for(None), random.Random(4)
    text = "".join(rng.choice(alphabet) for _ in range(100_000))
    table = counter.table(text)
    began = time.process_time()
    at = table.cut(table.total // 3)
    assert time.process_time() - began < 1.5
    count = lambda p: len(tok.encode(text[:p], add_special_tokens=False).ids)
    assert count(at) <= table.total // 3 < count(at + 1)
    assert table.count(at) == count(at) and table.count(at + 1) == count(at + 1)


def test_streaming_in_a_bounded_window(coder, piece_bpe):
    rng = random.Random(3)
    for alphabet in ("etaoinshr", "abc ", " ", "in", "漢字e\U0001f600 "):
        text = "".join(rng.choice(alphabet) for _ in range(4000))
        assert list(coder.stream(pieces.SPACE + text.replace(" ", pieces.SPACE))) == piece_bpe.encode(text)


def test_bounded_tables_give_the_same(word_bpe):
    small = token_counts.WordCounter(token_counts.default_vocabulary(), limit=3)
    ids = packing.ChunkIds(token_counts.default_vocabulary(), limit=3)
    coder = pieces.PieceCoder(pieces.default_model(), limit=3)
    text = " ".join(f"word{i % 7} Other{i}" for i in range(60))
    want = word_bpe.encode(text, add_special_tokens=False).ids
    assert small.table(text).total == len(want)
    assert np.frombuffer(ids.of_text(text), "<u4").tolist() == want
    assert coder.decode(coder.encode(text).tolist()) == text


def test_op1_whole_table(spark, word_bpe):
    rows = queries.op1_token_counts(spark, SF_SMALL).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n = len(word_bpe.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_op2_whole_table(spark, word_bpe):
    rows = queries.op2_best_fit_packing(spark, SF_SMALL).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = np.array([*word_bpe.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            part = ids[r.start : r.start + 4096]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.02 * -(-total // 4096) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 5), st.sampled_from([10_000, 12_000]))
def test_all_capacities_hold(rule, lengths, max_pieces, max_cost):
    lengths = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit(lengths, 100, max_pieces, max_cost, rule)
    for b in set(bins.tolist()):
        own = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist(), strict=True))
        assert sum(n for _, n in own) <= 100 and len(own) <= max_pieces and sum(n * n for _, n in own) <= max_cost
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]


def test_a_piece_over_a_capacity_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), 100, 5, 10**6)


def test_sequences_hold_the_pieces_ids(spark, word_bpe):
    docs = docs_of(spark, [(i, "some words to pack " * (i * 40)) for i in range(12)])
    packed = packing.pack(packing.token_pieces(docs, max_tokens=256), max_tokens=256, group_sequences=2)
    rows = packing.packed_sequences(packed).collect()
    assert sum(r.n_pieces for r in rows) == packed.count()
    assert all(len(r.ids) == 4 * r.length <= 1024 for r in rows)
    whole = sum(len(word_bpe.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in rows) == whole


def test_odd_rows(spark):
    docs = docs_of(spark, ODD)
    counts = token_counts.count_tokens(docs, keep_table=True).collect()
    assert len(counts) == len(ODD) and {r.n_tokens for r in counts if r.doc_id in (1, 2, 3, 4)} == {0}
    packed = packing.pack_documents(docs).collect()
    assert {(r.doc_id, r.length) for r in packed if r.doc_id in (1, 2, 3, 4)} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert sum(r.doc_id == 5 for r in packed) == 2
    digests = pieces.piece_digests(docs).collect()
    assert all(r.round_trip for r in digests) and len(digests) == len(ODD)
    back = pieces.decode_pieces(pieces.encode_pieces(docs)).collect()
    assert sorted((r.text for r in back)) == sorted(t or "" for _, t in ODD)
    empty = docs.limit(0)
    for made in (token_counts.count_tokens(empty), packing.pack_documents(empty), pieces.piece_digests(empty)):
        assert made.count() == 0
    # clashing names: input columns called like results
    clash = docs.selectExpr("doc_id", "text", "1 AS n_tokens", "2 AS sequence_id", "3 AS ids", "'x' AS piece")
    assert token_counts.count_tokens(clash).count() == packing.pack_documents(clash).count() == len(ODD)


def test_op5_whole_table(spark, piece_bpe):
    rows = queries.op5_subword_pieces(spark, SF_SMALL).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in rows:
        ids = np.array(piece_bpe.encode(texts[r.doc_id]), "<u4")
        assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)
