"""Operators 3, 6 and 8 against SQL, plain Python and each other."""

import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD, WORD, docs_of, prose

from lexigen.llm import line_dedup, line_quality, mph, queries, url_filter
from lexigen.llm.common import HashOf, lower_ascii


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF_SMALL)
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def plain_measures(text):
    text = text or ""
    found = WORD.findall(text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_measures(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randrange(40))) + rng.choice(["", "\nx # y\nx # y\n\n"])) for i in range(60)]
    rows = [*((i + 100, t) for i, t in rows), *ODD]
    got = line_quality.judge_lines(docs_of(spark, rows)).collect()
    want = sorted(((i, *plain_measures(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == want
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def plain_verdicts(rows, min_docs, share, depleted):
    norm = lambda x: re.sub("[0-9]+", "0", lower_ascii(" ".join(WORD.findall(x))))
    hosts, freq = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        hosts[h].add(t or "")
        for line in (t or "").split("\n"):
            if norm(line):
                freq[h, norm(line)].add(t)
    out = []
    for i, t, h in rows:
        n, _, _, _, again = plain_measures(t)
        lost = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if norm(x) and len(freq[h, norm(x)]) > max(min_docs, share * len(hosts[h])))
        out.append((i, lost, n >= 10 and 100 * again <= 20 * n and lost < depleted * n))
    return out


def test_line_frequency_per_host(spark):
    rng = random.Random(9)
    rows = []
    for i in range(90):
        host = rng.choice(["a", "a", "a", "b", None, ""])
        text = prose(rng, 30)
        if rng.random() < 0.6:
            text = f"Share this page with 12 friends\n{text}\nNEXT  page {i}"
        if rng.random() < 0.2:
            text = f"Share this page with {i} friends now and then please do\nNext page 7"
        rows.append((i, text, host))
    rows += rows[:5] + [(200 + i, rows[0][1], "a") for i in range(40)]
    docs = docs_of(spark, rows)
    got = line_quality.judge_lines(docs, min_docs=3, share=0.05, depleted=0.8)
    want = plain_verdicts(rows, 3, 0.05, 0.8)
    assert sorted((r.doc_id, r.n_removed_words, r.kept) for r in got.collect()) == sorted(want)
    left = line_quality.reject(docs, got)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _, kept in want if kept)
    cleaned = line_quality.remove_lines(docs, got)
    assert cleaned.columns == docs.columns
    lost = dict((i, n) for i, n, _ in want)
    source = {i: t for i, t, _ in rows}
    for r in cleaned.collect():
        assert len(WORD.findall(source[r.doc_id])) - len(WORD.findall(r.text)) == lost[r.doc_id]


def test_copies_do_not_turn_their_own_lines_into_boilerplate(spark):
    rng = random.Random(1)
    text = prose(rng, 60)
    rows = [(i, text, "a") for i in range(50)] + [(100 + i, prose(rng, 40), "a") for i in range(50)]
    assert all(r.kept for r in line_quality.judge_lines(docs_of(spark, rows), min_docs=3, share=0.02).collect())


def test_quality_of_an_empty_table(spark):
    docs = docs_of(spark, ODD).limit(0)
    verdicts = line_quality.judge_lines(docs)
    assert verdicts.count() == line_quality.reject(docs, verdicts).count() == 0


def plain_dedup(rows, limit):
    key = lambda x: lower_ascii(x.strip(" \t\n\x0b\x0c\r"))
    found = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None:
                found[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(found[key(x)]) < limit]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_line_dedup_both_ways(spark, bound, monkeypatch):
    rng = random.Random(2)
    common = [f"Line number {k} of many\x0b" for k in range(300)]
    rows = [(i, "\n".join(rng.choice([rng.choice(common), rng.choice(common).upper() + "  ", prose(rng, 6), "", "\t"]) for _ in range(rng.randrange(12)))) for i in range(400)]
    rows += rows[:30] + [(1000 + i, rows[3][1]) for i in range(20)] + ODD
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 40)
    monkeypatch.setattr(line_dedup, "PROBES_PER_TASK", 50)
    docs = docs_of(spark, rows)
    done = line_dedup.dedup_lines(docs, max_broadcast=bound)
    assert done.columns[: len(docs.columns)] == docs.columns
    got = sorted(((r.doc_id, r.dedup_lines, r.dedup_dropped, hashlib.sha256(r.dedup_text.encode()).hexdigest()) for r in done.collect()), key=repr)
    assert got == plain_dedup([(r[0], r[1]) for r in rows], 10)
    assert any(x[2] for x in got)


def test_line_dedup_clash_and_empty(spark):
    docs = docs_of(spark, ODD).selectExpr("*", "1 AS dedup_text", "2 AS h1", "3 AS shard")
    assert line_dedup.dedup_lines(docs).count() == len(ODD)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=500), st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_perfect_hash(keys, others):
    mine = np.array(sorted(keys), np.uint64)
    index = mph.PerfectHash.build(mine).index(mine)
    assert sorted(index.tolist()) == list(range(len(mine)))
    shard = mph.CountShard.from_bytes(mph.CountShard.build(mine, mine ^ np.uint64(5), np.arange(len(mine)) + 2).to_bytes())
    assert shard.count(mine, mine ^ np.uint64(5)).tolist() == list(range(2, len(mine) + 2))
    new = np.array(sorted(others - keys), np.uint64)
    assert not shard.count(new, new).any()


def test_equal_first_halves():
    h1, h2 = np.array([7, 7, 9, 7], np.uint64), np.array([1, 2, 3, 4], np.uint64)
    shard = mph.CountShard.build(h1, h2, np.array([10, 20, 30, 40]))
    assert shard.count(h1, h2).tolist() == [10, 20, 30, 40]
    assert shard.count(h1[:1], np.array([99], np.uint64)).tolist() == [0]


def test_repeated_words_window():
    hashes = HashOf()
    rng = random.Random(4)
    for n in (0, 3, 4, 5, 6, 50):
        found = [rng.choice("ab") for _ in range(n)]
        assert line_quality.repeated_words(np.array([hashes[w] for w in found], np.uint64)) == plain_measures(" ".join(found))[4]


URLS = [
    (None, "", "", None, "allow"),
    ("no scheme/en/", "", "", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("HTTP://WWW.Example.NET/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://example.net?/en/", "example.net", "", None, "allow"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
    ("http://a.b.example.com/de/x#/", "a.b.example.com", "/de/x", "example.com/de/", "block"),
    ("http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
    ("http://a.org/frx", "a.org", "/frx", None, "allow"),
    ("http://a.net:80/", "a.net:80", "/", None, "allow"),
    ("x://É.net/", "É.net", "/", "net/", "block"),
]


def test_urls(spark):
    rows = [(i, u[0], "clash") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "clash")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), queries.URL_RULES)
    by = {r.page_id: tuple(r)[1:] for r in got.collect()}
    assert by == {i: u[1:] for i, u in enumerate(URLS)} | {None: ("a.net", "/", "net/", "block")}
    assert got.limit(0).count() == 0


def test_no_rules_and_bad_rules(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.filter_urls(df, [], default="block").first().verdict == "block"
    with pytest.raises(ValueError):
        url_filter.filter_urls(df, [("a/", "maybe")])


def test_colliding_digests_are_told_apart(tmp_dir):
    """With a hash of two values almost every probe collides; the strings decide."""
    weak = lambda s: len(s) % 2
    stored = {f"host{i}/p": i % 2 for i in range(40)}
    url_filter.DigestArray.write(stored.items(), os.path.join(tmp_dir, "w"), weak)
    array = url_filter.DigestArray(os.path.join(tmp_dir, "w"))
    asked = [*stored, "host41/p", "other", ""]
    found = array.find(asked, weak)
    assert [array.string(i) if i >= 0 else None for i in found] == [*stored, None, None, None]
    assert [int(array.verdicts[i]) for i in found[:40]] == list(stored.values())


def test_hosts_of_many_labels():
    """A long host costs no more than the labels of the rules."""
    host = ".".join(["a"] * 20_000)
    began = time.process_time()
    assert url_filter.suffixes(f"{host}.example.net", [1, 2]) == ["net", "example.net"]
    assert url_filter.suffixes(host, [20_000]) == [host]
    assert time.process_time() - began < 0.2
    for given in ("a.b.c", "", ".", "a..b", "net.", "net"):
        every = [given, *(given[i + 1 :] for i, c in enumerate(given) if c == ".")]
        assert sorted(url_filter.suffixes(given, list(range(1, 9)))) == sorted(every)
        assert url_filter.suffixes(given, [2]) == [x for x in every if x.count(".") == 1]


def test_line_rule_acts_on_small_hosts(spark):
    """With the registered limits a share of a small host's texts decides: kept is more than the base rules."""
    rng = random.Random(18)
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(100 + i))
    menu = " ".join(f"entry{letters(i)}" for i in range(60))
    rows = [(i, prose(rng, 50), "small") for i in range(60)] + [(100 + i, f"{menu}\n{letters(i)} page", "small") for i in range(9)]
    rows += [(200 + i, f"{menu}\n{letters(i)} page", "other") for i in range(4)]
    got = {r.doc_id: r for r in line_quality.judge_lines(docs_of(spark, rows)).collect()}
    assert all(got[i].n_removed_words == 60 and not got[i].base_failed and not got[i].kept for i in range(100, 109))
    assert all(got[i].kept for i, _, h in rows if h == "other" or i < 100)
