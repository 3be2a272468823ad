"""Operator 12 against every possible edit of short conversations, and against plain recursion on long ones."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import cache

import pytest
from conftest import SF_MID

from lexigen.llm import queries, repair
from lexigen.llm.repair import damage

BLANK = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows):
    """(cost, audit, lines) of the best of all edits with up to two insertions between rows."""
    faults, best = faults_of(rows), None
    insert = [(INS, None) for INS in ("user", "assistant")]
    gaps = [p for n in range(3) for p in itertools.product(insert, repeat=n)]
    own = []
    for (_, role, text), fault in zip(rows, faults, strict=True):
        extra = int(fault == "truncated")
        ways = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            ways += [("K", extra, (role, text)), ("R", 2 + extra, ("user", text)), ("R", 2 + extra, ("assistant", text))]
        own.append(ways)
    for edits in itertools.product(*own):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            audit, cost, lines = "", 0, []
            for i, ins in enumerate(between):
                for role, _ in ins:
                    audit, cost = audit + "I", cost + 2
                    lines.append((role, ""))
                if i < len(edits):
                    letter, price, line = edits[i]
                    audit, cost = audit + letter, cost + price
                    lines += [line] if line else []
            if (best is None or (cost, audit) < best[:2]) and LEGAL.fullmatch("".join(r[:1] or " " for r, _ in lines)):
                best = (cost, audit, lines)
    return best


def recursion(rows):
    """The same for any length: least (cost, audit) of what is left, by the letters so far."""
    faults = faults_of(rows)
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 2:
            for name in ("user", "assistant"):
                if (state, name[0]) in after:
                    c, a, lines = best(i, after[state, name[0]], inserted + 1)
                    ways.append((c + 2, "I" + a, ((name, ""), lines)))
        if i < len(rows):
            _, role, text = rows[i]
            extra = int(faults[i] == "truncated")
            c, a, lines = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                for letter, name, price in (("K", role, extra), ("R", "user", 2 + extra), ("R", "assistant", 2 + extra)):
                    if (state, name[:1]) in after:
                        c, a, lines = best(i + 1, after[state, name[:1]], 0)
                        ways.append((c + price, letter + a, ((name, text), lines)))
        return min(ways, default=(10**9, "", ()))

    old = sys.getrecursionlimit()
    sys.setrecursionlimit(50_000)
    try:
        cost, audit, chain = best(0, "", 0)
    finally:
        sys.setrecursionlimit(old)
    lines = []
    while chain:
        line, chain = chain
        lines.append(line)
    return cost, audit, lines


def plain(rows, solve):
    """All columns of one conversation; rows of (turn, role, text), null as None."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, turns = faults_of(rows), [t for t, _, _ in rows if t is not None]
    initials = [r[:1] or " " for _, r, _ in rows]
    cost, audit, lines = solve(rows) if rows else (0, "", [])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u2"]
TEXTS = ["Good.", "Fine!", "cut off", "", " \t", None, "why?  ", "é"]


def random_rows(rng, n, same=0.1):
    out = []
    for k in range(n):
        turn = None if rng.random() < 0.05 else k * 2 if rng.random() < 0.1 else k
        text = rng.choice(TEXTS) if rng.random() < same else f"{rng.choice(['a', 'b'])} {rng.randrange(10**6)}{rng.choice(['.', '', '?'])}"
        role = rng.choice(ROLES) if rng.random() < 0.4 else ["user", "assistant"][k % 2]
        out.append((turn, role, text))
    return out


def run(spark, convs, **how):
    df = spark.createDataFrame([(c, *r, 1, "x") for c, rows in convs for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string").repartition(3)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(df, as_text=True, **how).collect()}
    hashed = {r["conv_id"]: r["repaired"] for r in repair.repair(df, **how).collect()}
    assert hashed == {c: hashlib.sha256(r[-1].encode()).hexdigest() for c, r in got.items()}
    return got


def test_recursion_equals_every_edit():
    rng = random.Random(3)
    for n in (0, 1, 2, 2, 3, 3, 3):
        rows = [(t or 0, r or " ", x or " ") for t, r, x in random_rows(rng, n, 0.4)]
        assert recursion(rows) == (every_edit(rows) if rows else (0, "", []))


def test_short_conversations(spark):
    rng = random.Random(4)
    convs = [(c if c else None, random_rows(rng, rng.randrange(1, 9), 0.3)) for c in range(300)]
    assert run(spark, convs) == {c: plain(rows, recursion) for c, rows in convs}


@pytest.mark.parametrize("passes", [0, 6])
def test_conversations_over_many_chunks(spark, passes):
    """Chunks of three rows; copies across chunks; roles that let no vector converge; rows that all have to go."""
    rng = random.Random(5)
    convs = [(c, random_rows(rng, 70, 0.5)) for c in range(3)]
    convs.append((3, [(k, None, f"text {k}.") for k in range(41)]))
    convs.append((4, [(None, "user", "same.")] * 50 + [(1, "assistant", "end.")]))
    convs.append((5, [(k, "tool", "same.") for k in range(20)] + [(30 + k, ["user", "assistant"][k % 2], f"{k}.") for k in range(21)]))
    convs += [(c, random_rows(rng, 5)) for c in range(10, 40)]
    assert run(spark, convs, chunk_rows=3, max_passes=passes) == {c: plain(rows, recursion) for c, rows in convs}


def test_empty_and_dropped(spark):
    df = spark.createDataFrame([(1, None, None, None, True), (None, 3, "user", "x.", True), (2, 1, "user", "x.", False)], "conv_id long, turn long, role string, text string, gone boolean")
    from pyspark.sql import functions as F

    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(df, live=~F.col("gone"), as_text=True).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", ""), None: (0, 0, 0, 0, 0, 0, "", ""), 2: (0, 0, 0, 0, 0, 2, "KI", "user:x.\nassistant:")}
    assert repair.repair(df.limit(0)).count() == 0


def test_query(spark):
    convs: dict = {}
    for r in spark.read.parquet(f"{SF_MID}/conversations.parquet").collect():
        fault = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        rows = convs.setdefault(r["conv_id"], [])
        text = "" if fault == 1 else re.sub("[.!?]", "", r["text"]) if fault == 2 else r["text"]
        if fault:
            rows += [(r["turn"], "user" if fault == 4 else r["role"], text)] * (2 if fault == 3 else 1)
    want = {}
    for c, rows in convs.items():
        *most, text = plain(rows, recursion)
        want[c] = (*most, hashlib.sha256(text.encode()).hexdigest())
    got = queries.op12_conversation_repair(spark, SF_MID)
    assert got.columns == ["conv_id", *COLUMNS[:-1], "repaired_sha256"]
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_damage_of_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    fault = zlib.crc32(b" : ") % 20
    rows = damage(df).collect()
    assert len(rows) == (2 if fault == 3 else 1) and rows[0]["text"] == ("" if fault == 1 else " ")


def test_fix_up_equals_walk():
    rng = random.Random(6)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 7, 9, 10]) for _ in range(rng.randrange(0, 12)))
        a, b = ([rng.randrange(6) for _ in range(4)] for _ in range(2))
        assert repair.fix_up(codes, a, repair.walk(codes, a), b) == repair.walk(codes, b)
