"""Independent SQL statements of every registered query, for DuckDB.

Written from the operator definitions (not from the Spark plans) over the same
pre-registered tables; column names match the Spark results.
"""

from __future__ import annotations

from lexigen.functions import prompts as P
from lexigen.functions.text import NA_TOKENS, WS_CHARS, WS_CLASS
from lexigen.operators import sft as S
from lexigen.plans import catalog as C


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WSLIT = "(" + " || ".join(f"chr({ord(c)})" for c in WS_CHARS) + ")"
NA_LIST = ", ".join(lit(t) for t in NA_TOKENS)


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS_CLASS}+'), lambda t_: t_ <> '')"


def strip(x: str) -> str:
    return f"trim({x}, {WSLIT})"


def nan(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR ({x}) IN ({NA_LIST}) THEN 'nan' ELSE ({x}) END)"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def pyrepr(x: str) -> str:
    """Python repr of a string holding no control character other than tab, LF, CR."""
    common = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"
    dq = f"contains({x}, '''') AND NOT contains({x}, '\"')"
    single = f"replace(replace({x}, '\\', '\\\\'), '''', '\\''')"
    single = f"replace(replace(replace({single}, chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"
    return f"(CASE WHEN {dq} THEN '\"' || {common} || '\"' ELSE '''' || {single} || '''' END)"


def list_repr(lst: str) -> str:
    return f"('[' || array_to_string(list_transform({lst}, lambda e_: {pyrepr('e_')}), ', ') || ']')"


CASES = """cases AS (
  SELECT u.conv_id || '-' || u.turn AS case_id, u.text AS input_findings, a.text AS output_impression
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

FORM = "CAST(replace(case_id, '-', '') AS BIGINT)"

PREDS = CASES + f""",
preds AS (
  SELECT 'baseline' AS model, case_id, output_impression AS reference,
         array_to_string(list_filter({tok('input_findings')}, lambda w_, i_: (i_ - 1) % {C.BASELINE_STRIDE} = 0), ' ') AS generated
  FROM cases
  UNION ALL
  SELECT 'finetuned' AS model, case_id, output_impression AS reference,
         CASE WHEN {FORM} % 19 = 0 THEN output_impression
              WHEN {FORM} % 23 = 0 THEN ''
              WHEN {FORM} % 29 = 0 THEN NULL
              ELSE array_to_string(list_transform({tok('output_impression')},
                     lambda w_, i_: CASE WHEN i_ % 7 = 0 THEN 'x' ELSE w_ END), ' ') END AS generated
  FROM cases),
prep AS (
  SELECT model, case_id, {strip(nan('reference'))} AS ref, {strip(nan('generated'))} AS gen FROM preds)"""


def rouge_words(x: str) -> str:
    return (
        f"flatten(list_transform(list_filter(string_split({x}, '.'), lambda p_: length(p_) > 0), "
        f"lambda p_: CASE WHEN len({tok('p_')}) = 0 THEN [''] ELSE {tok('p_')} END))"
    )


def n_sent(x: str) -> str:
    return f"len(list_filter(string_split({x}, '.'), lambda p_: length(p_) > 0))"


def grams(w: str, n: int) -> str:
    if n == 1:
        return w
    return f"list_transform(range(1, len({w}) - {n - 2}), lambda i_: array_to_string({w}[i_:i_ + {n - 1}], chr(1)))"


def fscore(ov: str, nh: str, nr: str) -> str:
    p = f"(CASE WHEN {nh} = 0 THEN 0.0::DOUBLE ELSE {ov}::DOUBLE / {nh} END)"
    r = f"(CASE WHEN {nr} = 0 THEN 0.0::DOUBLE ELSE {ov}::DOUBLE / {nr} END)"
    return f"(2.0::DOUBLE * (({p} * {r}) / ({p} + {r} + 1e-8::DOUBLE)))"


ROUGE12 = """rw AS (
  SELECT model, case_id, ref, gen, {rwr} AS wr, {rwg} AS wg,
         ({nr} = 0 OR {ng} = 0) AS undefined FROM prep),
r12 AS (
  SELECT model, case_id, undefined, CAST(ref = gen AS INTEGER) AS em,
         list_distinct({g1h}) AS h1, list_distinct({g1r}) AS r1,
         list_distinct({g2h}) AS h2, list_distinct({g2r}) AS r2 FROM rw),
rouge12 AS (
  SELECT model, case_id, em AS "EM",
         CASE WHEN undefined THEN NULL ELSE {f1} END AS "ROUGE-1",
         CASE WHEN undefined THEN NULL ELSE {f2} END AS "ROUGE-2" FROM r12)""".format(
    rwr=rouge_words("ref"), rwg=rouge_words("gen"), nr=n_sent("ref"), ng=n_sent("gen"),
    g1h="wg", g1r="wr", g2h=grams("wg", 2), g2r=grams("wr", 2),
    f1=fscore("len(list_intersect(h1, r1))", "len(h1)", "len(r1)"),
    f2=fscore("len(list_intersect(h2, r2))", "len(h2)", "len(r2)"),
)


def _bleu_grams(side: str, col: str) -> str:
    parts = []
    for n in range(1, 5):
        gexpr = f"list_transform(range(1, len({col}) - {n - 2}), lambda i_: array_to_string({col}[i_:i_ + {n - 1}], chr(1)))"
        parts.append(f"SELECT model, case_id, {n} AS n, unnest({gexpr}) AS g FROM bt")
    return f"{side} AS (SELECT model, case_id, n, g, count(*) AS c FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL)"


BLEU = (
    f"""bt AS (SELECT model, case_id, {tok('ref')} AS rt, {tok('gen')} AS ht FROM prep),
"""
    + _bleu_grams("hc", "ht")
    + ",\n"
    + _bleu_grams("rc", "rt")
    + """,
clip AS (
  SELECT h.model, h.case_id, h.n, sum(least(h.c, coalesce(r.c, 0))) AS num, sum(h.c) AS tot
  FROM hc h LEFT JOIN rc r ON r.model = h.model AND r.case_id = h.case_id AND r.n = h.n AND r.g = h.g
  GROUP BY ALL),
pn AS (
  SELECT b.model, b.case_id, len(b.ht) AS lh, len(b.rt) AS lr, k.n,
         coalesce(c.num, 0) AS num, greatest(1, coalesce(c.tot, 0)) AS den
  FROM bt b CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) k
  LEFT JOIN clip c ON c.model = b.model AND c.case_id = b.case_id AND c.n = k.n),
bleu AS (
  SELECT model, case_id,
    CASE WHEN max(CASE WHEN n = 1 THEN num END) = 0 THEN 0.0::DOUBLE
         ELSE (CASE WHEN max(lh) > max(lr) THEN 1.0::DOUBLE WHEN max(lh) = 0 THEN 0.0::DOUBLE
                    ELSE exp(1 - max(lr)::DOUBLE / max(lh)) END)
              * exp(sum(0.25::DOUBLE * ln((CASE WHEN num = 0 THEN 0.1::DOUBLE ELSE num::DOUBLE END) / den)))
    END AS "BLEU"
  FROM pn GROUP BY model, case_id)"""
)


def _sent_words(x: str) -> str:
    return (f"list_transform(list_filter(string_split({x}, '.'), lambda p_: length(p_) > 0), "
            f"lambda p_: CASE WHEN len({tok('p_')}) = 0 THEN [''] ELSE {tok('p_')} END)")


# ROUGE-L: LCS table row by row (recursive), then the back-trace walk (recursive);
# the union of LCS words over all sentence pairs is a distinct count.
ROUGE_L = f"""rl_s AS (
  SELECT model, case_id, {_sent_words('ref')} AS rs, {_sent_words('gen')} AS hs FROM prep),
rsent AS (SELECT model, case_id, generate_subscripts(rs, 1) AS si, unnest(rs) AS x FROM rl_s),
hsent AS (SELECT model, case_id, generate_subscripts(hs, 1) AS sj, unnest(hs) AS y FROM rl_s),
sp AS (SELECT r.model, r.case_id, si, sj, x, y FROM rsent r JOIN hsent h ON h.model = r.model AND h.case_id = r.case_id),
dp AS (
  SELECT model, case_id, si, sj, 0 AS i, list_transform(range(0, len(y) + 1), lambda z_: 0) AS row FROM sp
  UNION ALL
  SELECT d.model, d.case_id, d.si, d.sj, d.i + 1,
         list_reduce(list_transform(range(1, len(s.y) + 1), lambda j_: [j_]),
           lambda acc_, jj_: list_append(acc_, CASE WHEN s.x[d.i + 1] = s.y[jj_[1]] THEN d.row[jj_[1]] + 1
                                             ELSE greatest(d.row[jj_[1] + 1], acc_[jj_[1]]) END), [0])
  FROM dp d JOIN sp s ON s.model = d.model AND s.case_id = d.case_id AND s.si = d.si AND s.sj = d.sj
  WHERE d.i < len(s.x)),
walk AS (
  SELECT model, case_id, si, sj, len(x) AS i, len(y) AS j, NULL::VARCHAR AS w FROM sp
  UNION ALL
  SELECT b.model, b.case_id, b.si, b.sj,
         CASE WHEN s.x[b.i] = s.y[b.j] OR pr.row[b.j + 1] > cu.row[b.j] THEN b.i - 1 ELSE b.i END,
         CASE WHEN s.x[b.i] = s.y[b.j] THEN b.j - 1 WHEN pr.row[b.j + 1] > cu.row[b.j] THEN b.j ELSE b.j - 1 END,
         CASE WHEN s.x[b.i] = s.y[b.j] THEN s.x[b.i] END
  FROM walk b
  JOIN sp s ON s.model = b.model AND s.case_id = b.case_id AND s.si = b.si AND s.sj = b.sj
  JOIN dp cu ON cu.model = b.model AND cu.case_id = b.case_id AND cu.si = b.si AND cu.sj = b.sj AND cu.i = b.i
  JOIN dp pr ON pr.model = b.model AND pr.case_id = b.case_id AND pr.si = b.si AND pr.sj = b.sj AND pr.i = b.i - 1
  WHERE b.i > 0 AND b.j > 0),
lcs AS (SELECT model, case_id, count(DISTINCT w) AS total FROM walk WHERE w IS NOT NULL GROUP BY model, case_id),
rouge_l AS (
  SELECT r.model, r.case_id,
    CASE WHEN len(r.rs) = 0 OR len(r.hs) = 0 THEN NULL
         ELSE {fscore('coalesce(l.total, 0)', 'len(list_distinct(flatten(r.hs)))', 'len(list_distinct(flatten(r.rs)))')}
    END AS "ROUGE-L"
  FROM rl_s r LEFT JOIN lcs l ON l.model = r.model AND l.case_id = r.case_id)"""


def sql_metric_rouge_l() -> str:
    rl = r6('"ROUGE-L"')
    return "WITH RECURSIVE " + PREDS + ",\n" + ROUGE_L + f'\nSELECT model, case_id, {rl} AS "ROUGE-L" FROM rouge_l'


def _all_metrics_ctes() -> str:
    return PREDS + ",\n" + ROUGE12 + ",\n" + BLEU + ",\n" + ROUGE_L


def sql_eval_detail() -> str:
    b, r1, r2, rl = r6('b."BLEU"'), r6('a."ROUGE-1"'), r6('a."ROUGE-2"'), r6('l."ROUGE-L"')
    return ("WITH RECURSIVE " + _all_metrics_ctes() + f"""
SELECT a.model, a.case_id, a."EM", {b} AS "BLEU", {r1} AS "ROUGE-1", {r2} AS "ROUGE-2", {rl} AS "ROUGE-L"
FROM rouge12 a JOIN bleu b ON b.model = a.model AND b.case_id = a.case_id
JOIN rouge_l l ON l.model = a.model AND l.case_id = a.case_id""")


def sql_eval_summary() -> str:
    return ("WITH RECURSIVE " + _all_metrics_ctes() + f"""
SELECT a.model, count(*) AS n_samples, {r6('avg(a."EM")')} AS "EM", {r6('avg(b."BLEU")')} AS "BLEU",
       {r6('avg(a."ROUGE-1")')} AS "ROUGE-1", {r6('avg(a."ROUGE-2")')} AS "ROUGE-2", {r6('avg(l."ROUGE-L")')} AS "ROUGE-L"
FROM rouge12 a JOIN bleu b ON b.model = a.model AND b.case_id = a.case_id
JOIN rouge_l l ON l.model = a.model AND l.case_id = a.case_id
GROUP BY a.model""")


def _q(body: str, ctes: str) -> str:
    return f"WITH {ctes}\n{body}"


def sql_metric_em_rouge12() -> str:
    body = f'SELECT model, case_id, "EM", {r6('"ROUGE-1"')} AS "ROUGE-1", {r6('"ROUGE-2"')} AS "ROUGE-2" FROM rouge12'
    return _q(body, PREDS + ",\n" + ROUGE12)


def sql_metric_bleu() -> str:
    return _q(f'SELECT model, case_id, {r6('"BLEU"')} AS "BLEU" FROM bleu', PREDS + ",\n" + BLEU)


def row_md5(cols: list[str]) -> str:
    """md5 of the cells' texts with their lengths, and the seed."""
    cells = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols]
    return "md5(" + " || '|' || ".join([*cells, f"'{C.SPLIT_SEED}'"]) + ")"


def position(keys: list[str], cols: list[str]) -> str:
    """First four digits of the key's hash, then the row's hash."""
    return f"substr({row_md5(keys)}, 1, 4) || {row_md5(cols)}"


def split_label(keys: list[str], cols: list[str]) -> str:
    return (
        f"CASE WHEN row_number() OVER (ORDER BY {position(keys, cols)}) <= "
        f"ceil({C.TEST_FRACTION}::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split"
    )


def sql_exact_split() -> str:
    return f"SELECT doc_id, {split_label(['doc_id'], ['doc_id'])} FROM documents"


def sql_split_copies() -> str:
    return f"SELECT lang, source, split, count(*) AS n_rows FROM (SELECT lang, source, {split_label(['lang'], ['lang', 'source'])} FROM documents) GROUP BY ALL"


def sql_global_rank() -> str:
    return f'SELECT doc_id, CAST(row_number() OVER (ORDER BY {position(["doc_id"], ["doc_id"])}) AS BIGINT) AS "rank" FROM documents'


def sql_rank_hot_key() -> str:
    cols = ["doc_id", "lang", "kind"]
    return (
        f'SELECT {", ".join(cols)}, CAST(row_number() OVER (PARTITION BY kind ORDER BY {position(["lang"], cols)}) AS BIGINT) AS "rank", '
        "count(*) OVER (PARTITION BY kind) AS n_rows FROM "
        "(SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS kind FROM documents)"
    )


def sql_split_pairs() -> str:
    label = split_label(["case_id"], ["case_id", "input_findings", "output_impression"])
    return _q(
        f"SELECT split, count(*) AS n_rows, CAST(sum({FORM}) AS BIGINT) AS sum_case_id FROM (SELECT case_id, {label} FROM cases) GROUP BY split",
        CASES,
    )


def _cell(x: str) -> str:
    return f"coalesce(length({x}) || ':' || {x}, '-')"


def _md5_of(cells: list[str]) -> str:
    return "md5(" + " || '|' || ".join([*cells, f"'{C.SPLIT_SEED}'"]) + ")"


def sql_split_lists() -> str:
    words = _cell("array_to_string(list_transform(words, lambda w_: length(w_) || ':' || w_), '')")
    facts = _cell(f"({_cell('lang')} || {_cell('CAST(n_chars AS VARCHAR)')})")
    tags = _cell(f"('6:source' || {_cell('source')})")
    order = f"substr({_md5_of([words])}, 1, 4) || {_md5_of([words, facts, tags])}"
    label = f"CASE WHEN row_number() OVER (ORDER BY {order}) <= ceil({C.TEST_FRACTION}::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END"
    return (
        "SELECT md5(array_to_string(words, ' ')) AS words_md5, lang, split, count(*) AS n_rows FROM "
        f"(SELECT words, lang, {label} AS split FROM (SELECT *, string_split(coalesce(text, ''), ' ') AS words FROM documents)) GROUP BY ALL"
    )


def sql_rank_vectors() -> str:
    cells = _cell("array_to_string(list_transform(embedding, lambda x_: length(CAST(CAST(floor(CAST(x_ AS DOUBLE) * 1024) AS BIGINT) AS VARCHAR)) || ':' || CAST(CAST(floor(CAST(x_ AS DOUBLE) * 1024) AS BIGINT) AS VARCHAR)), '')")
    order = f"substr({_md5_of([cells])}, 1, 4) || {_md5_of([_cell('CAST(vec_id AS VARCHAR)'), cells])}"
    return f'SELECT vec_id, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS "rank" FROM embeddings'


def sql_assign_batches() -> str:
    """Ranks, then 24 rounds in which numbers change places with their partners."""
    case = ["case_id"]
    steps = [
        f"x0 AS (SELECT case_id, epoch, count(*) OVER (PARTITION BY epoch) AS n, row_number() OVER (PARTITION BY epoch ORDER BY {position(case, case)}) - 1 AS x "
        f"FROM cases CROSS JOIN (SELECT unnest(range(0, {C.EPOCHS})) AS epoch) e)"
    ]
    for r in range(24):
        key = f"CAST('0x' || substr(md5('{C.SPLIT_SEED}|' || epoch || '|{r}'), 1, 13) AS BIGINT)"
        steps.append(
            f"x{r + 1} AS (SELECT case_id, epoch, n, CASE WHEN substr(md5(greatest(x, p) || ':' || k), 1, 1) >= '8' THEN p ELSE x END AS x "
            f"FROM (SELECT *, ((k - x) % n + n) % n AS p FROM (SELECT *, {key} AS k FROM x{r})))"
        )
    return _q(
        f"SELECT case_id, CAST(epoch AS INTEGER) AS epoch, CAST(x // {C.TRAIN_BATCH} AS BIGINT) AS batch_id FROM x24",
        ",\n".join([CASES, *steps]),
    )


def sql_pairs() -> str:
    return _q("SELECT case_id, input_findings AS prompt, output_impression AS response FROM cases", CASES)


def completion_prompt(x: str) -> str:
    return f"({lit(P.COMPLETION_HEAD)} || coalesce({x}, 'nan') || {lit(P.COMPLETION_TAIL)})"


def sql_predict_baseline() -> str:
    return _q(
        f"SELECT case_id, input_findings AS prompt, output_impression AS reference, "
        f"array_to_string(list_filter({tok('input_findings')}, lambda w_, i_: (i_ - 1) % {C.BASELINE_STRIDE} = 0), ' ') "
        "AS generated FROM cases",
        CASES,
    )


def sql_predict_resumed() -> str:
    return sql_predict_baseline()


def sql_prompt_completion() -> str:
    return _q(f"SELECT case_id, {completion_prompt('input_findings')} AS prompt FROM cases", CASES)


def sql_prompt_fewshot() -> str:
    pre = lit(P.fewshot_prefix())
    return _q(f"SELECT case_id, {pre} || coalesce(input_findings, 'nan') || {lit(P.FEWSHOT_TAIL)} AS prompt FROM cases", CASES)


def judge_prompt(g: str, r: str) -> str:
    return (f"({lit(P.JUDGE_HEAD)} || coalesce({g}, 'nan') || {lit(P.JUDGE_MID)} || coalesce({r}, 'nan') || "
            f"{lit(P.JUDGE_TAIL)})")


MARKUP = """markup AS (
  SELECT page_id, CASE page_id % 4
    WHEN 0 THEN 'Output: [''' || html || '''] Output: ' || html || ' [\\x] tail'
    WHEN 1 THEN replace(replace(html, '<p>', '['), '</p>', ']')
    WHEN 2 THEN replace(replace(html, '"', chr(39)), ' ', '\\ ')
    ELSE ' ' || chr(9) || html || chr(10) END AS marked
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))"""


def sql_list_repr() -> str:
    return _q(f"SELECT page_id, {list_repr('string_split(marked, ' + lit('.') + ')')} AS repr FROM markup", MARKUP)


def sql_prompt_judge() -> str:
    g = list_repr("string_split(input_findings, '.')")
    return _q(f"SELECT case_id, {judge_prompt(g, 'output_impression')} AS prompt FROM cases", CASES)


ECHO_ITEMS = (
    "list_filter(list_transform(string_split(input_findings, '.'), "
    f"lambda s_: {strip("replace(replace(s_, '[', ''), ']', '')")}), "
    "lambda s_: s_ <> '')"
)


def sql_impressions() -> str:
    return _q(
        f"SELECT case_id, input_findings, output_impression, array_to_string({ECHO_ITEMS}, '|') AS impressions, "
        f"CAST(len({ECHO_ITEMS}) AS INTEGER) AS n_items FROM cases",
        CASES,
    )


def sql_judge_scores() -> str:
    g = list_repr(ECHO_ITEMS)
    cols = ", ".join(
        f"CAST(least((length(g) + {i}) % 7, 5) AS INTEGER) AS {k}" for i, k in enumerate(P.SCORE_COLUMNS)
    )
    return _q(
        f"SELECT case_id, g AS generated_impression, output_impression, {cols} FROM "
        f"(SELECT case_id, output_impression, {g} AS g FROM cases)",
        CASES,
    )


def sql_parse_list() -> str:
    items = (
        "list_transform(string_split(output_impression, '.'), lambda p_: "
        f"regexp_replace(regexp_replace(p_, '[''\"\\[\\]\\\\]', '', 'g'), '{WS_CLASS}', ' ', 'g'))"
    )
    kept = f"list_filter(list_transform(items, lambda s_: {strip('s_')}), lambda s_: s_ <> '')"
    return _q(
        "SELECT case_id, CASE WHEN k IN (5, 6) THEN '' "
        f"WHEN k = 4 THEN array_to_string(['1', 'None'] || {kept}, '|') "
        f"WHEN k = 7 THEN {strip("array_to_string(items, '')")} "
        f"ELSE array_to_string({kept}, '|') END AS parsed "
        f"FROM (SELECT case_id, {FORM} % 9 AS k, {items} AS items FROM cases)",
        CASES,
    )


def sql_parse_scores() -> str:
    v = "(quality * 3 + toxic * 2)"
    def col(k: str) -> str:
        if k == "coherence":
            e = (f"CASE k WHEN 0 THEN {v} WHEN 1 THEN 5 WHEN 2 THEN 0 WHEN 3 THEN {v} WHEN 4 THEN {v} "
                 f"WHEN 6 THEN 1 WHEN 9 THEN {v} ELSE NULL END")
        elif k == "correctness":
            e = f"CASE k WHEN 0 THEN {v} WHEN 6 THEN 0 ELSE NULL END"
        elif k == "harmlessness_bias":
            e = f"CASE k WHEN 0 THEN {v} WHEN 7 THEN {v} ELSE NULL END"
        else:
            e = f"CASE k WHEN 0 THEN {v} ELSE NULL END"
        return f"CAST({e} AS INTEGER) AS {k}"
    cols = ", ".join(col(k) for k in P.SCORE_COLUMNS)
    return f"SELECT doc_id, {cols} FROM (SELECT doc_id, quality, toxic, doc_id % 11 AS k FROM labels)"


SFT_INPUT = CASES + f""",
sft_input AS (
  SELECT 'c' || CAST(case_id AS VARCHAR) AS key, input_findings AS prompt, output_impression AS response FROM cases
  UNION ALL
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS key, array_to_string(t[1:len(t) // 2], ' ') AS prompt,
         array_to_string(t[len(t) // 2 + 1:len(t)], ' ') AS response
  FROM (SELECT doc_id, {tok('text')} AS t FROM documents))"""


def hash_ids(x: str) -> str:
    return (f"list_transform({x}, lambda w_: CAST((('0x' || substr(md5(w_), 1, 8))::BIGINT % {S.HASH_VOCAB}) "
            f"+ {S.RESERVED} AS INTEGER))")


def _sft_core() -> str:
    L = S.MAX_LEN
    return SFT_INPUT + f""",
enc AS (
  SELECT key, {hash_ids(tok(completion_prompt('prompt')) + f'[1:{L}]')} AS pid,
         {hash_ids(tok("coalesce(response, 'nan')") + f'[1:{L}]')} AS rid FROM sft_input),
ex AS (
  SELECT key, len(pid) AS plen, (pid || rid || [{S.EOS_ID}])[1:{L}] AS ids FROM enc)"""


def sql_sft_examples() -> str:
    L = S.MAX_LEN
    pad = S.EOS_ID
    labels = f"list_transform(ids, lambda x_, i_: CASE WHEN i_ <= plen THEN {S.IGNORE} ELSE x_ END)"
    return _q(
        f"SELECT key, CAST(len(ids) AS BIGINT) AS n_attended, CAST(len(ids) - plen AS BIGINT) AS n_supervised, "
        f"md5(array_to_string(ids, ',') || repeat(',{pad}', {L} - len(ids))) AS ids_md5, "
        f"md5(array_to_string({labels}, ',') || repeat(',{S.IGNORE}', {L} - len(ids))) AS labels_md5 FROM ex",
        _sft_core(),
    )


def sql_sft_supervised() -> str:
    return _q("SELECT key FROM ex WHERE len(ids) > plen", _sft_core())


def sql_encode_prompt() -> str:
    L = S.MAX_LEN
    return _q(
        f"SELECT key, CAST(len(pid) AS BIGINT) AS prompt_len, md5(array_to_string(pid, ',')) AS ids_md5 FROM "
        f"(SELECT key, {hash_ids(tok(completion_prompt('prompt')) + f'[1:{L}]')} AS pid FROM sft_input)",
        SFT_INPUT,
    )


def sql_length_profile() -> str:
    L = S.MAX_LEN
    return _q(
        f"SELECT source, count(*) AS n_rows, count_if(f > {L}) AS n_truncated, count_if(p >= {L}) AS n_unsupervised, "
        f"CAST(max(p) AS BIGINT) AS max_prompt_tokens, CAST(max(f) AS BIGINT) AS max_full_tokens, "
        f"CAST(sum(f) AS BIGINT) AS sum_full_tokens, CAST(sum(least(f, {L}) - least(p, {L})) AS BIGINT) AS supervised_tokens "
        f"FROM (SELECT substr(key, 1, 1) AS source, len({tok(completion_prompt('prompt'))}) AS p, "
        f"len({tok(completion_prompt('prompt'))}) + len({tok("coalesce(response, 'nan')")}) + 1 AS f "
        f"FROM sft_input) GROUP BY source",
        SFT_INPUT,
    )


VOCAB = f"""vocab AS (
  SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 + {S.RESERVED} AS INTEGER) AS token_id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest({tok('text')}) AS token FROM documents)
        GROUP BY token ORDER BY n DESC, token LIMIT {C.VOCAB_SIZE}))"""


def sql_vocab() -> str:
    return _q("SELECT token, CAST(n AS BIGINT) AS n, token_id FROM vocab", VOCAB)


def sql_vocab_bounded() -> str:
    return sql_vocab()


def sql_vocab_ids() -> str:
    return (
        "WITH " + VOCAB + f""",
texts AS (
  SELECT 'c' || conv_id || '-' || turn AS key, text FROM conversations
  UNION ALL SELECT 'd' || doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  ' ELSE text END FROM documents),
words AS (SELECT key, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT key, {tok('text')} AS t FROM texts WHERE text IS NOT NULL)),
ids AS (
  SELECT key, count(*) AS n, string_agg(CAST(coalesce(v.token_id, {S.UNK_ID}) AS VARCHAR), ',' ORDER BY pos) AS ids
  FROM words LEFT JOIN vocab v USING (token) GROUP BY key)
SELECT key, coalesce(n, 0) AS n_ids, md5(coalesce(ids, '')) AS ids_md5 FROM texts LEFT JOIN ids USING (key)"""
    )


def sql_training_rollup() -> str:
    loss = "CASE WHEN event_id % 10 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 10 = 1 THEN 0.0::DOUBLE ELSE value END"
    return (
        f"SELECT epoch, {r6('avg(CASE WHEN valid THEN loss END)')} AS mean_loss, count_if(valid) AS valid_steps, "
        f"count_if(NOT valid) AS skipped_steps FROM (SELECT CAST(user_id % 7 AS INTEGER) AS epoch, loss, "
        f"(loss IS NOT NULL AND NOT isnan(loss) AND loss <> 0) AS valid FROM (SELECT user_id, {loss} AS loss FROM events)) "
        f"GROUP BY epoch"
    )


def sql_attach() -> str:
    return _q("SELECT c.case_id, c.output_impression, p.generated FROM cases c LEFT JOIN preds p "
              "ON p.case_id = c.case_id AND p.model = 'finetuned'", PREDS)


def sql_pairs_json_roundtrip() -> str:
    return _q("SELECT input_findings AS prompt, output_impression AS response FROM cases", CASES)


def sql_predictions_csv_roundtrip() -> str:
    # An empty cell reads back as missing, as with pandas.
    return _q("SELECT nullif(c.input_findings, '') AS prompt, nullif(p.reference, '') AS reference, "
              "nullif(p.generated, '') AS generated FROM preds p "
              "JOIN cases c USING (case_id) WHERE p.model = 'finetuned'", PREDS)


def sql_text_functions() -> str:
    spans = "regexp_extract_all(marked, '\\[[\\s\\S]*?\\]')"
    return _q(
        f"SELECT page_id, CAST(length({strip('marked')}) AS BIGINT) AS stripped_len, "
        f"CAST(len({tok('marked')}) AS BIGINT) AS n_tokens, "
        "md5(string_split(marked, 'Output:')[-1]) AS after_output_md5, "
        f"CAST(len({spans}) AS BIGINT) AS n_bracket_spans, md5(array_to_string({spans}, '|')) AS bracket_md5, "
        "md5(regexp_extract(marked, '\\{[\\s\\S]*\\}')) AS brace_md5, "
        f"md5({strip(nan('marked'))}) AS scored_md5 FROM markup",
        MARKUP,
    )


ODD = CASES + f""",
odd AS (
  SELECT case_id,
    CASE k WHEN 0 THEN NULL WHEN 1 THEN '...' WHEN 2 THEN 'NA' WHEN 3 THEN '  ' WHEN 4 THEN replace(r, ' ', chr(1))
           WHEN 5 THEN chr(65535) || ' ' || r ELSE r END AS reference,
    CASE k WHEN 0 THEN 'None' WHEN 1 THEN r WHEN 2 THEN NULL WHEN 3 THEN '.' WHEN 4 THEN r || ' ' || replace(r, ' ', chr(1))
           WHEN 5 THEN chr(65535) || ' . . ' || r WHEN 6 THEN '' WHEN 7 THEN r WHEN 8 THEN ' ' || r || chr(9) WHEN 9 THEN 'nan' ELSE g END AS generated
  FROM (SELECT case_id, {FORM} % 12 AS k, output_impression AS r, input_findings AS g FROM cases)),
prep AS (
  SELECT 'literal_nan' AS model, case_id, {strip(nan('reference'))} AS ref, {strip(nan('generated'))} AS gen FROM odd
  UNION ALL
  SELECT 'null' AS model, case_id, {strip('reference')} AS ref, {strip('generated')} AS gen FROM odd)"""


def _odd_scores(columns: str, where: str = "") -> str:
    b, r1, r2, rl = r6('b."BLEU"'), r6('a."ROUGE-1"'), r6('a."ROUGE-2"'), r6('l."ROUGE-L"')
    return ("WITH RECURSIVE " + ODD + ",\n" + ROUGE12 + ",\n" + BLEU + ",\n" + ROUGE_L + f"""
SELECT {columns}, a."EM", CASE WHEN p.ref IS NOT NULL AND p.gen IS NOT NULL THEN {b} END AS "BLEU",
       {r1} AS "ROUGE-1", {r2} AS "ROUGE-2", {rl} AS "ROUGE-L"
FROM rouge12 a JOIN bleu b USING (model, case_id) JOIN rouge_l l USING (model, case_id) JOIN prep p USING (model, case_id) {where}""")


def sql_edge_metrics() -> str:
    undefined = f"coalesce({n_sent('p.ref')} = 0 OR {n_sent('p.gen')} = 0, TRUE) AS undefined"
    return _odd_scores(f"model AS policy, case_id, {undefined}")


def sql_eval_from_csv() -> str:
    return _odd_scores("case_id", "WHERE model = 'literal_nan'")


def sql_impressions_csv() -> str:
    return _q(f"SELECT case_id, {list_repr(ECHO_ITEMS)} AS generated_impression FROM cases", CASES)


def sql_judge_csv() -> str:
    # An empty cell reads back as missing.
    return f"SELECT * REPLACE (nullif(output_impression, '') AS output_impression) FROM ({sql_judge_scores()})"


def sql_report() -> str:
    return sql_eval_summary()


def sql_full_text() -> str:
    return _q(
        "SELECT key, length(t) AS n_chars, md5(t) AS text_md5 FROM "
        f"(SELECT key, {completion_prompt('prompt')} || coalesce(response, 'nan') || {lit(C.EOS)} AS t FROM sft_input)",
        SFT_INPUT,
    )


def sql_completion() -> str:
    return _q(
        "SELECT key, CAST(len(ids) AS BIGINT) AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5 FROM "
        f"(SELECT key, {hash_ids(tok('coalesce(response, ' + lit('nan') + ')'))} AS ids FROM sft_input)",
        SFT_INPUT,
    )


def sql_sft_vocab() -> str:
    size = S.MAX_LEN
    toks = f"SELECT key, {tok(completion_prompt('prompt'))} AS pt, {tok('coalesce(response, ' + lit('nan') + ')')} AS rt FROM sft_input"
    labels = f"list_transform(ids, lambda x_, i_: CASE WHEN i_ <= plen THEN {S.IGNORE} ELSE x_ END)"
    return _q(
        f"SELECT key, md5(array_to_string(ids, ',') || repeat(',{S.EOS_ID}', {size} - len(ids))) AS ids_md5, "
        f"md5(array_to_string({labels}, ',') || repeat(',{S.IGNORE}', {size} - len(ids))) AS labels_md5 FROM ex",
        SFT_INPUT + ",\n" + VOCAB + f""",
cut AS (SELECT key, least(len(pt), {size}) AS plen, (pt || rt)[1:{size}] AS w FROM ({toks})),
placed AS (SELECT key, unnest(w) AS token, unnest(range(len(w))) AS pos FROM cut),
known AS (
  SELECT key, list(coalesce(v.token_id, {S.UNK_ID}) ORDER BY pos) AS ids FROM placed LEFT JOIN vocab v USING (token) GROUP BY key),
ex AS (SELECT key, plen, (ids || [{S.EOS_ID}])[1:{size}] AS ids FROM cut JOIN known USING (key))""",
    )


def sql_batch_sizes() -> str:
    return _q("SELECT count(*) AS n_prompts, 0 AS n_over, 0 AS n_none FROM cases", CASES)


def sql_predict_limited() -> str:
    words = f"list_filter({tok('input_findings')}, lambda w_, i_: (i_ - 1) % {C.BASELINE_STRIDE} = 0)"
    return _q(
        f"SELECT case_id, input_findings AS prompt, output_impression AS reference, "
        f"array_to_string({words}[1:{C.NEW_TOKENS}], ' ') AS generated FROM cases",
        CASES,
    )


def all_sql() -> dict[str, str]:
    out = {}
    for name in C.all_queries():
        fn = globals().get(f"sql_{name}")
        if fn is not None:
            out[name] = fn()
    return out
