"""Whitespace, list text, and model-output parsing (FIXTURES.md §5)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigen.functions.parse import parse_list, parse_scores
from lexigen.functions.text import WS_CHARS, after_last, list_repr, strip, tokens

LISTS = [
    ("['a.', ' b ']", ["a.", "b"]),
    ("x Output: ['a'] Output: ['b']", ["b"]),
    ("[bad] then ['ok']", ["ok"]),
    ("['a',] tail ['b']", ["a"]),
    ("[1, None, '', 'b']", ["1", "None", "b"]),
    ("[['a'], 'b']", []),
    ("['stage [II]']", []),
    ("no list", []),
    ("['a' 'b']", ["ab"]),
    ("[]", []),
    ('["it\'s"]', ["it's"]),
    ("['unterminated'", []),
    # a whole number of more digits than Python prints: on to the next span
    ("[0x" + "F" * 5000 + "] then ['ok']", ["ok"]),
    ("[" + "[" * 300 + "'deep'" + "]" * 301 + " and ['x']", ["x"]),
    ("Output: ['\\u00e9\\n ', b'z', 2.5]", ["\u00e9", "b'z'", "2.5"]),
    (None, None),
    # half a surrogate pair
    ("Output: ['\\ud800 x','ok']", ["\\ud800 x", "ok"]),
    ("['\\ud83d\\ude00', 'y']", ["\\ud83d\\ude00", "y"]),
    # at the edges of the plain grammar
    ("[ 'a' , \"b's\" ,\n\t'' ]", ["a", "b's"]),
    ("['a',, 'b'] ['c']", ["c"]),
    ("[, 'a'] ['c']", ["c"]),
    ("['''a''', 'b']", ["a", "b"]),
    ("['a\x0b', 'b']", ["a", "b"]),
    ("['a' ,\x0b'b'] ['c']", ["c"]),
    ("[' é\U0001f600']", ["é\U0001f600"]),
    ("['a\nb'] ['c']", ["c"]),
    ("['a\x00'] ['c']", ["c"]),
    ("[ ]", []),
    ("[,]", []),
    ("['" + "x" * 3000 + "', 'b']", ["x" * 3000, "b"]),
    ("[" + "'a', " * 6000 + "]", ["a"] * 6000),
    ("[" + "'a'," * 490 + "]", ["a"] * 490),
    ("[u'a', r'b\\n', 'c']", ["a", "b\\n", "c"]),
]

SCORES = [
    ('{"coherence": 4}', 4),
    ("ok {'coherence': 9} end", 5),
    ("{'coherence': -2}", 0),
    ("{'coherence': 4.9}", 4),
    ("{'coherence': '3'}", 3),
    ("{'coherence': '3.5'}", None),
    ("{'coherence': ' 2 '}", 2),
    ("{'coherence': True}", 1),
    ("{'coherence': None}", None),
    ("{'other': 1}", None),
    ("{'coherence': 1} {'coherence': 2}", None),
    ("{'coherence'}", None),
    ("{'coherence': 3,}", 3),
    ("{coherence: 3}", None),
    ("none", None),
    ("{'coherence': 1e999}", None),
    ("{'coherence': 0x" + "F" * 5000 + "}", 5),
    ("{'coherence': -" + "9" * 400 + "}", 0),
    ("{'coherence': '" + "9" * 400 + "'}", 5),
    ("{'coherence': '1_0'}", 5),
    ("{'coherence': '+3'}", 3),
    ("{'coherence': '- 3'}", None),
    ("{'coherence': -0.5}", 0),
    ("{'coherence': b'4'}", 4),
    ("{'coherence': [1]}", None),
    ("{1: 2, 'coherence': 1}", 1),
    ("{'coherence': 1, 'coherence': 2}", 2),
    ("[1, {'coherence': 3}]", 3),
    (None, None),
    ("{'coherence': '\\ud800'}", None),
    ("{'\\ud800': 3, 'coherence': 4}", 4),
    ("{'coherence': '٣'}", 3),
    ("{'coherence': '  4 '}", 4),
    ("{'coherence': b' 4\\n'}", 4),
    ("{'coherence': b'\\xff'}", None),
    ("{'coherence': '" + "1" * 5000 + "'}", None),
    # at the edges of the plain grammar
    ("{}", None),
    ("{ 'coherence' :\t3 , \"correctness\":0,\n}", 3),
    ("{'coherence': 03}", None),
    ("{'coherence': 03.5}", 3),
    ("{'coherence': -0}", 0),
    ("{'coherence': 2.}", 2),
    ("{'coherence': .5}", 0),
    ("{'coherence': +2}", 2),
    ("{'coherence': 1234567890}", 5),
    ("{'coherence': 2,, 'x': 1}", None),
    ("{'coherence': 2 'x': 1}", None),
    ("{'co' 'herence': 2}", 2),
    ("{\"coherence\": 5, 'coherence': 1}", 1),
    ("{'a\\n': 1, 'coherence': 2}", 2),
    ("{'coherence': 1_0}", 5),
    ("{'coherence': 2j}", None),
    ("{" + ", ".join(f"'k{i}': {i}" for i in range(2000)) + ", 'coherence': 2}", 2),
    ("{" + ", ".join(f"'k{i}': {i}" for i in range(140)) + ", 'coherence': 2}", 2),
]


def test_strip_and_tokens_match_python(spark):
    texts = [WS_CHARS + "a" + WS_CHARS + "b c" + WS_CHARS, "", "   ", "x", "　y z\x1c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", strip("t").alias("s"), tokens("t").alias("k")).collect()
    for r in rows:
        assert r["s"] == r["t"].strip()
        assert r["k"] == r["t"].split()


def test_after_last(spark):
    df = spark.createDataFrame([("a Output: b Output: c",), ("none",)], "t string")
    assert [r[0] for r in df.select(after_last("t", "Output:")).collect()] == [" c", "none"]


def test_parse_list_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LISTS)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", parse_list("t").alias("p")).collect()}
    for i, (t, want) in enumerate(LISTS):
        assert got[i] == want, t


def test_parse_scores_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SCORES)], "i int, t string")
    got = {r["i"]: r["s"]["coherence"] for r in df.select("i", parse_scores("t").alias("s")).collect()}
    for i, (t, want) in enumerate(SCORES):
        assert got[i] == want, t


def test_both_routes_agree(spark, monkeypatch):
    """Whatever the plain grammar takes, Python reads alike."""
    from lexigen.functions import parse

    lists = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LISTS)], "i int, t string")
    scores = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SCORES)], "i int, t string")

    def both():
        return [sorted(map(tuple, df.select("i", f("t")).collect())) for df, f in ((lists, parse_list), (scores, parse_scores))]

    two = both()
    assert lists.filter(parse._plain(F.get(parse.bracket_spans("t"), F.lit(0)), parse.PLAIN_LIST)).count() >= 8
    assert scores.filter(parse._plain(parse.brace_span("t"), parse.PLAIN_SCORES)).count() >= 8
    monkeypatch.setattr(parse, "PLAIN_CHARS", -1)
    assert both() == two


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("{}[]'\",: \\\n\t013.-a")), max_size=14), min_size=30, max_size=60))
def test_both_routes_agree_on_any_text(spark, texts):
    from lexigen.functions import parse

    rows = [(t,) for t in texts] + [("{'coherence'" + t[:5] + ": 3" + t[5:] + "}",) for t in texts] + [("['a'" + t + "]",) for t in texts]
    df = spark.createDataFrame(rows, "t string")
    two = [tuple(r) for r in df.select(parse_list("t"), parse_scores("t")).collect()]
    limit, parse.PLAIN_CHARS = parse.PLAIN_CHARS, -1
    try:
        assert [tuple(r) for r in df.select(parse_list("t"), parse_scores("t")).collect()] == two
    finally:
        parse.PLAIN_CHARS = limit


_alphabet = st.sampled_from(list("ab '\"\\\t\n\r\x0b\x00\x7f\xa0\xe9 ​　[]") + ["\U0001F600"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=_alphabet, max_size=8), max_size=4))
def test_list_repr_equals_python_repr(spark, items):
    df = spark.createDataFrame([(items,)], "a array<string>")
    assert df.select(list_repr("a")).collect()[0][0] == repr(items)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=_alphabet, max_size=8), max_size=4))
def test_parse_list_inverts_repr_without_brackets(spark, items):
    clean = [s.replace("]", "").replace("[", "") for s in items]
    df = spark.createDataFrame([(repr(clean),)], "t string")
    got = df.select(parse_list("t")).collect()[0][0]
    assert got == [s.strip() for s in clean if s.strip()]


def test_fixture_parses_have_known_answers(spark):
    from conftest import SF_SMALL
    from lexigen.plans import fixtures as FX

    raw = FX.list_raw(FX.cases(spark, SF_SMALL))
    bad = raw.select("expected", F.array_join(parse_list("raw"), "|").alias("p")).filter("p <> expected")
    assert bad.count() == 0


_dots = st.text(alphabet=st.sampled_from(list("ab. \t\n　 x")), max_size=20)


@settings(max_examples=80, deadline=None)
@given(st.lists(_dots, min_size=1, max_size=5))
def test_rouge_words_and_sentences_match_python(spark, texts):
    from lexigen.functions.text import n_sentences, rouge_words

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", rouge_words("t").alias("w"), n_sentences("t").alias("n")).collect()
    for r in rows:
        pieces = [" ".join(p.split()) for p in r["t"].split(".") if len(p) > 0]
        assert r["n"] == len(pieces)
        assert r["w"] == [w for p in pieces for w in p.split(" ")]


def test_templates_are_unchanged(spark):
    """The oracle shares the templates with the code, so what they are is fixed here."""
    import hashlib

    from lexigen.functions import prompts as P

    df = spark.createDataFrame([("X", "R")], "f string, r string")
    row = df.select(P.render_completion_prompt("f"), P.render_fewshot_prompt("f"), P.render_judge_prompt("f", "r"), P.full_text("f", "r", "</s>")).first()
    assert row[0] == "Findings:\nX\n\nImpression:\n" and row[3] == "XR</s>"
    assert hashlib.md5(row[1].encode()).hexdigest() == "5fa9bf1b0f6517c6239a9e05ad377bed"
    assert hashlib.md5(row[2].encode()).hexdigest() == "257947ce7f3818c3ffc05ec9a4b594ef"


def test_whitespace_and_missing_tokens_are_pythons():
    import sys

    import pandas as pd

    from lexigen.functions.text import NA_TOKENS

    assert set(WS_CHARS) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}
    frame = pd.read_csv(__import__("io").StringIO("a,b\n" + "\n".join(f'"{t}",1' for t in NA_TOKENS)))
    assert frame["a"].isna().all()
