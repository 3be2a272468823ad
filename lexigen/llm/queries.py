"""One registered query per operator, over its whole table, and DuckDB SQL where SQL can
express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigen.llm.centroids import centroid_digest, cluster
from lexigen.llm.common import text_batches
from lexigen.llm.extract import extract_text
from lexigen.llm.line_dedup import dedup_lines
from lexigen.llm.line_quality import judge_lines
from lexigen.llm.minhash import near_duplicates
from lexigen.llm.nearest import nearest
from lexigen.llm.packing import pack_documents
from lexigen.llm.pieces import piece_digests
from lexigen.llm.repair import damage, repair
from lexigen.llm.spotsigs import CHAIN, COMMON, DIGITS, FLOOR, fingerprints
from lexigen.llm.token_counts import count_tokens
from lexigen.llm.toxicity import score_toxicity
from lexigen.llm.url_filter import filter_urls

#: Rules of the URL query (fixed values).
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), budgets=(2048,))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "cut_2048")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), max_tokens=4096)


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = judge_lines(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, bands=20)


def op5_subword_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def learnable(labels: DataFrame) -> DataFrame:
    """The labelled rows that classifiers may learn from; the others are held out."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learnable(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "flagged")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return done.select("doc_id", F.col("dedup_lines").alias("n_lines"), F.col("dedup_dropped").alias("n_dropped"), F.sha2("dedup_text", 256).alias("kept_sha256"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(table(spark, sf_dir, "conversations"))
    return repair(rows, live=~F.col("dropped")).withColumnRenamed("repaired", "repaired_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_digest(F.col("centroid")).alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_best_fit_packing,
        op3_line_quality,
        op4_minhash_near_dedup,
        op5_subword_pieces,
        op6_url_filter,
        op7_toxicity,
        op8_line_dedup,
        op9_nearest,
        op10_main_text,
        op11_spot_signatures,
        op12_conversation_repair,
        op13_centroid_clustering,
    )
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

_OP3 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 4) AS five
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)
),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (
  SELECT doc_id, sum(c - 1) AS n FROM (
    SELECT doc_id, line, count(*) AS c FROM ln WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id, line)
  GROUP BY doc_id
),
norm AS (
  SELECT doc_id, source, t, len(x) AS n_words,
    regexp_replace(translate(array_to_string(x, ' '), '{_UP}', '{_LOW}'), '[0-9]+', '0', 'g') AS line
  FROM (SELECT doc_id, source, t, regexp_extract_all(line, '{_WORD}') AS x FROM ln) WHERE len(x) > 0
),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
freq AS (SELECT source, line, count(DISTINCT t) AS n FROM norm GROUP BY source, line HAVING count(DISTINCT t) > 5),
over AS (SELECT f.source, f.line FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 0.02 * h.n),
lost AS (
  SELECT n.doc_id, sum(n.n_words) AS n FROM norm n JOIN over o ON n.source IS NOT DISTINCT FROM o.source AND n.line = o.line
  GROUP BY n.doc_id
),
m AS (
  SELECT d.doc_id, len(w.ws) AS n_words, length(array_to_string(w.ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_removed_words < 0.9 * n_words AS kept
FROM m
"""

_OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS ws FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id > b.doc_id GROUP BY ALL),
link AS (
  SELECT u, v FROM pair JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
),
e AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e.v FROM reach JOIN e ON reach.r = e.u),
least_id AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_id USING (doc_id) LEFT JOIN size USING (doc_id)
"""

_OP6 = rf"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
s AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h FROM r),
u AS (
  SELECT page_id, translate(h, '{_UP}', '{_LOW}') AS host, regexp_extract(substr(coalesce(rest, ''), length(h) + 1), '^[^?#]*') AS path FROM s
),
f AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP8 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, {_BLANK}), '{_UP}', '{_LOW}') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often o ON k.key = o.key GROUP BY doc_id
"""


_COMMON = ", ".join(f"'{w}'" for w in dict.fromkeys(COMMON))

_OP11 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
ids AS (SELECT doc_id, arg_min(text, (md5(text), text)) AS text FROM t GROUP BY doc_id),
ring AS (
  SELECT doc_id, coalesce(lead(text) OVER o, first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST)) AS next
  FROM ids WINDOW o AS (ORDER BY doc_id DESC NULLS LAST)
),
e AS MATERIALIZED (
  SELECT r, t.doc_id, text, next, left(text, (length(text) - length(text) // 2)::BIGINT) || left(next, (length(text) // 2)::BIGINT) AS edited
  FROM t JOIN ring ON t.doc_id IS NOT DISTINCT FROM ring.doc_id
),
x AS (SELECT r, 'own' AS what, text AS x FROM e UNION ALL SELECT r, 'edited', edited FROM e UNION ALL SELECT r, 'next', next FROM e),
w AS (SELECT r, what, list_prepend('^', regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+')) AS ws FROM x),
p AS (SELECT r, what, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
q AS (SELECT *, i = 0 OR word IN ({_COMMON}) OR length(word) <= 2 AS common FROM p),
b AS (SELECT *, lag(word) OVER o AS last_word, lag(common) OVER o AS anchored FROM q WINDOW o AS (PARTITION BY r, what ORDER BY i)),
c AS (SELECT *, {", ".join(f"lead(word, {k}) OVER o AS c{k}" for k in range(1, CHAIN))} FROM b WHERE NOT common WINDOW o AS (PARTITION BY r, what ORDER BY i)),
s AS (SELECT DISTINCT r, what, substr(md5(concat_ws(' ', last_word, word, {", ".join(f"c{k}" for k in range(1, CHAIN))})), 1, {DIGITS}) AS sig FROM c WHERE anchored),
f AS MATERIALIZED (SELECT r, what, list(sig ORDER BY sig) AS sigs FROM s GROUP BY r, what),
g AS (
  SELECT e.r, coalesce(o.sigs, []) AS o, coalesce(d.sigs, []) AS d, coalesce(n.sigs, []) AS n FROM e
  LEFT JOIN f o ON o.r = e.r AND o.what = 'own' LEFT JOIN f d ON d.r = e.r AND d.what = 'edited' LEFT JOIN f n ON n.r = e.r AND n.what = 'next'
),
j AS (
  SELECT r, o, d, len(list_intersect(o, d))::DOUBLE / nullif(len(o) + len(d) - len(list_intersect(o, d)), 0) AS od,
    len(list_intersect(o, n))::DOUBLE / nullif(len(o) + len(n) - len(list_intersect(o, n)), 0) AS o_n FROM g
)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(o, '') AS fingerprint, array_to_string(d, '') AS edited_fingerprint,
  CASE WHEN od IS NULL THEN 1.0::DOUBLE WHEN od >= {FLOOR} THEN od ELSE 0.0::DOUBLE END AS near_edited,
  CASE WHEN o_n IS NULL THEN 1.0::DOUBLE WHEN o_n >= {FLOOR} THEN o_n ELSE 0.0::DOUBLE END AS near_next
FROM j JOIN e USING (r)
"""


def _op13(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds one after another, a row per vector and component."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
cell AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, floor(1024 * unnest(v)::DOUBLE)::BIGINT AS x FROM kept),
start AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, i, x AS y FROM start JOIN cell USING (r) WHERE c < {k})"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""d{n} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM cell JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS q FROM cell JOIN d{n} USING (r) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (
  SELECT c, i, coalesce((s - ((s % q) + q) % q) // q, y)::BIGINT AS y FROM c{n} LEFT JOIN m{n} USING (c, i))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM d{rounds} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) USING (c)"""
    )


ORACLE_SQL: dict[str, str] = {
    "op3_line_quality": _OP3,
    "op4_minhash_near_dedup": _OP4,
    "op6_url_filter": _OP6,
    "op8_line_dedup": _OP8,
    "op11_spot_signatures": _OP11,
    "op13_centroid_clustering": _op13(),
}
