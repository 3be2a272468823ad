"""Operator 7, toxicity by a convolutional text classifier.

Words become sums of hashed embeddings (the word, and its first letters, so inflected and
compound forms share weights); filters of several widths run over the words, their maxima
over the whole text feed a logistic output. Embeddings start from the log-odds of each hash
bucket in the training rows and everything is then trained together in numpy (Adagrad; only
the positions of the maxima receive a gradient, so a step is cheap).

The model is fitted on a bounded sample of labelled rows: at most ``max_positive`` toxic
and ``max_negative`` other rows, those of the smallest id hashes, among texts of up to
``max_chars`` code points. The decision threshold of each language is chosen on all rows that may be learnt
from, whatever their number: rows of the sample are scored by models fitted without them (``FOLDS`` parts, dealt
by text, so that copies stay together), all others by the model itself. Every document is scored once; its id, language and score
are stored, and labels join the stored scores, so thresholds read no text. Rows are counted per language and grid step on Spark. The
threshold of best F1 over n positives then counts n parts and the common one ``ENOUGH`` parts
(the common one likewise against 0.3). Scores read the text alone.

Scoring reads whole texts in blocks, so memory does not grow with a text. Null and empty texts get the
score of a text of padding. Null or unknown languages get the common threshold. Without labelled rows of both
kinds every score is 0. Repeated rows are scored each; an id labelled twice is toxic if either label says so.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigen.llm.common import by_ids, free_name, handed_out, held, texts_of, with_columns, words
from lexigen.session import materialize, spread

BUCKETS = 1 << 16
FEATURES = 4
WIDTHS = (1, 2, 3)
FILTERS = 8
DIMS = 8
BLOCK = 20_000
FOLDS = 4
#: Positives with which an own threshold weighs as much as the common one.
ENOUGH = 20
GRID = np.arange(0.1, 0.91, 0.05)
_EDGES = ".,;:!?\"'()[]{}<>*#%&$|-_¡¿«»…"


def word_features(word: str) -> list[int]:
    """Hash buckets of a word: itself and its first 3, 4 and 5 letters."""
    w = word.lower().strip(_EDGES)
    keys = [f"w:{w}", *(f"{n}:{w[:n]}" for n in (3, 4, 5))]
    return [xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1 for k in keys]


def padded(rows: np.ndarray) -> np.ndarray:
    """At least as many words as the widest filter, by padding on the right."""
    lack = max(WIDTHS) - len(rows)
    return np.concatenate([rows, np.zeros(lack, rows.dtype)]) if lack > 0 else rows


@dataclass
class ToxicityModel:
    embed: np.ndarray  # (BUCKETS, DIMS); bucket 0 is padding
    filters: list[np.ndarray]  # per width: (width, DIMS, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray  # (len(WIDTHS) * FILTERS,)
    offset: float
    threshold: float = 0.3
    by_lang: dict[str, float] = field(default_factory=dict)

    def projections(self, ids: np.ndarray) -> np.ndarray:
        """Per word, its share in every filter at every place: (words, sum of widths * FILTERS)."""
        x = self.embed[ids].sum(axis=1)
        return np.concatenate([x @ w[o] for w in self.filters for o in range(len(w))], axis=1).astype(np.float32)

    def pooled(self, shares: np.ndarray) -> np.ndarray:
        """Maxima of all filters over a run of words given by their projections."""
        maxima, at = [], 0
        for width, b in zip(WIDTHS, self.bias, strict=True):
            n = len(shares) - width + 1
            z = sum(shares[o : o + n, at + o * FILTERS : at + (o + 1) * FILTERS] for o in range(width))
            maxima.append(z.max(axis=0) + b)
            at += width * FILTERS
        return np.concatenate(maxima)

    def score_rows(self, rows: np.ndarray, table: np.ndarray) -> float:
        """Score of a text given as rows of a table of projections."""
        rows = padded(rows)
        best = None
        for a in range(0, max(1, len(rows) - max(WIDTHS) + 1), BLOCK):
            m = self.pooled(table[rows[a : a + BLOCK + max(WIDTHS) - 1]])
            best = m if best is None else np.maximum(best, m)
        return float(1 / (1 + np.exp(-np.clip(np.maximum(best, 0) @ self.out + self.offset, -30, 30))))

    def score(self, text: str) -> float:
        return ProjectionTable(self, 0).scores([text])[0]


class ProjectionTable:
    """word -> row of a table of projections, filled batch by batch and emptied before it would
    hold more than ``limit`` words (a batch that has more on its own makes it larger)."""

    def __init__(self, model: ToxicityModel, limit: int = 250_000):
        self.model = model
        padding = model.projections(np.zeros((1, FEATURES), np.int64))
        self.table = np.empty((limit + 1, padding.shape[1]), np.float32)
        self.table[0] = padding
        self.rows: dict[str, int] = {}

    def _learn(self, new: list[str]) -> None:
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            at = len(self.rows) + 1
            self.table[at : at + len(part)] = self.model.projections(np.array([word_features(w) for w in part]))
            self.rows.update(zip(part, range(at, at + len(part)), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        docs = [words(t) for t in texts]
        new = {w for d in docs for w in d if w not in self.rows}
        if len(self.rows) + len(new) >= len(self.table):
            self.rows.clear()
            new = {w for d in docs for w in d}
            if len(new) >= len(self.table):
                self.table = np.concatenate([self.table[:1], np.empty((len(new), self.table.shape[1]), np.float32)])
        self._learn(sorted(new))
        return [self.model.score_rows(np.fromiter(map(self.rows.__getitem__, d), np.int64, len(d)), self.table) for d in docs]


def log_odds(docs: list[np.ndarray], labels: np.ndarray, floor: float = 0.004) -> np.ndarray:
    """Per bucket, log of (share of toxic texts with it + floor) / (share of the others + floor)."""
    counts = np.zeros((2, BUCKETS))
    for ids, y in zip(docs, labels, strict=True):
        counts[int(y), np.unique(ids)] += 1
    share = counts / np.maximum(1, np.bincount(labels.astype(int), minlength=2))[:, None] + floor
    out = np.log(share[1] / share[0])
    out[0] = 0
    return out


def fit(texts: list[str], labels: list[int], epochs: int = 6, rate: float = 0.05, seed: int = 7) -> ToxicityModel:
    """Train on whole texts; ``labels`` are 0 or 1, both must occur."""
    rng = np.random.default_rng(seed)
    docs = [np.array([word_features(w) for w in words(t)], np.int64).reshape(-1, FEATURES) for t in texts]
    docs = [np.concatenate([d, np.zeros((max(0, max(WIDTHS) - len(d)), FEATURES), np.int64)]) for d in docs]
    y = np.array(labels, np.float64)
    embed = rng.normal(0, 0.05, (BUCKETS, DIMS))
    embed[:, 0] = log_odds(docs, y) / FEATURES
    embed[0] = 0
    filters = [rng.normal(0, 0.1, (w, DIMS, FILTERS)) for w in WIDTHS]
    for w in filters:
        w[0, 0, : FILTERS // 2] += 1.0  # half the filters start on the log-odds
    bias = [np.full(FILTERS, -0.5) for _ in WIDTHS]
    out, offset = np.full(len(WIDTHS) * FILTERS, 0.1), -2.0
    grads = {"embed": np.full((BUCKETS, DIMS), 1e-2), "out": np.full(len(out), 1e-2), "offset": 1e-2}
    filter_sq = [np.full(w.shape, 1e-2) for w in filters]
    bias_sq = [np.full(FILTERS, 1e-2) for _ in WIDTHS]
    order = list(range(len(docs)))
    for _ in range(epochs):
        random.Random(seed).shuffle(order)
        for i in order:
            ids = docs[i]
            x = embed[ids].sum(axis=1)
            maxima, places = [], []
            for k, width in enumerate(WIDTHS):
                n = len(x) - width + 1
                z = sum(x[o : o + n] @ filters[k][o] for o in range(width)) + bias[k]
                at = z.argmax(axis=0)
                places.append(at)
                maxima.append(z[at, np.arange(FILTERS)])
            h = np.concatenate(maxima)
            act = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ out + offset, -30, 30)))
            d = p - y[i]
            d_h = d * out * (h > 0)
            g = d * act + 1e-4 * out
            grads["out"] += g**2
            out = out - rate * g / np.sqrt(grads["out"])
            grads["offset"] += d * d
            offset -= rate * d / np.sqrt(grads["offset"])
            for k, width in enumerate(WIDTHS):
                dk = d_h[k * FILTERS : (k + 1) * FILTERS]
                live = np.flatnonzero(dk)
                if not len(live):
                    continue
                g_filter = np.zeros_like(filters[k])
                for o in range(width):
                    at = places[k][live] + o
                    g_filter[o][:, live] = x[at].T * dk[live]
                    touched = ids[at]
                    step = (filters[k][o][:, live] * dk[live]).T
                    for f in range(FEATURES):
                        rows = touched[:, f]
                        np.add.at(grads["embed"], rows, step**2)
                        np.add.at(embed, rows, -rate * step / np.sqrt(grads["embed"][rows]))
                    embed[0] = 0
                filter_sq[k] += g_filter**2
                filters[k] -= rate * g_filter / np.sqrt(filter_sq[k])
                g_bias = np.zeros(FILTERS)
                g_bias[live] = dk[live]
                bias_sq[k] += g_bias**2
                bias[k] = bias[k] - rate * g_bias / np.sqrt(bias_sq[k])
    return ToxicityModel(embed.astype(np.float32), [f.astype(np.float32) for f in filters], bias, out, float(offset))


def steps(scores) -> np.ndarray:
    """Per score, how many thresholds of the grid it reaches."""
    return np.searchsorted(GRID, scores, side="right")


def best_step(counts: np.ndarray, common: float = 0.3) -> float:
    """The threshold of best F1 on the grid, from the rows at each step (steps, 2: other, toxic); on ties the
    one nearest to ``common``."""
    reached = counts[::-1].cumsum(axis=0)[::-1][1:]
    f1 = 2 * reached[:, 1] / np.maximum(1.0, reached.sum(axis=1) + counts[:, 1].sum())
    return float(GRID[max(np.argsort(abs(GRID - common), kind="stable"), key=lambda k: round(float(f1[k]), 6))])


def step_counts(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(GRID) + 1, 2), np.int64)
    np.add.at(counts, (steps(scores), np.asarray(labels, int)), 1)
    return counts


def best_threshold(scores: np.ndarray, labels: np.ndarray, common: float = 0.3) -> float:
    """The threshold of best F1 on the grid; on ties the one nearest to ``common``."""
    return best_step(step_counts(scores, labels), common)


def shrunk(counts: np.ndarray, towards: float, few: int = ENOUGH) -> float:
    """The best step of some rows, drawn towards a threshold as if ``few`` positives spoke for that."""
    n = counts[:, 1].sum()
    return float((n * best_step(counts, towards) + few * towards) / (n + few))


def set_thresholds(model: ToxicityModel, by_lang: dict[str | None, np.ndarray], few: int = ENOUGH) -> None:
    """Choose the common threshold and those of the languages with a positive, from counts per step."""
    if by_lang:
        model.threshold = shrunk(sum(by_lang.values()), 0.3, few)
    model.by_lang = {g: shrunk(c, model.threshold, few) for g, c in by_lang.items() if g is not None and c[:, 1].sum()}


def unseen_counts(texts: list[str], labels: list[int], langs: list[str | None], seed: int, fold: int) -> dict[str | None, np.ndarray]:
    """Rows of a fold per language and step, scored by a model fitted without them; none if
    the fold holds all rows of a label."""
    folds = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts]
    own, rest = ([i for i, f in enumerate(folds) if (f == fold) == mine] for mine in (True, False))
    out: dict[str | None, np.ndarray] = {}
    if own and len({labels[i] for i in rest}) == 2:
        model = fit([texts[i] for i in rest], [labels[i] for i in rest], seed=seed)
        for i, s in zip(own, ProjectionTable(model, 0).scores([texts[i] for i in own]), strict=True):
            out[langs[i]] = out.get(langs[i], 0) + step_counts(np.array([s]), np.array([labels[i]]))
    return out


def on_tasks(spark: SparkSession, f, items: range) -> list:
    """``f`` of every item, each in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("nothing",))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(i)) for i in batch.column("id").to_pylist()], pa.binary())], names=["done"])

    done = spark.range(items.start, items.stop, 1, len(items)).mapInArrow(run, "done binary").collect()
    return [pickle.loads(r[0]) for r in done]


def fit_counted(texts: list[str], labels: list[int], langs: list[str | None], seed: int = 7, each=map) -> tuple[ToxicityModel, dict[str | None, np.ndarray]]:
    """A model of all rows, and the rows per language and step as scored by models that have not seen them
    (``each`` maps over the folds)."""
    by_lang: dict[str | None, np.ndarray] = {}
    for part in each(partial(unseen_counts, texts, labels, langs, seed), range(FOLDS)):
        for lang, counts in part.items():
            by_lang[lang] = by_lang.get(lang, 0) + counts
    return fit(texts, labels, seed=seed), by_lang


def fit_calibrated(texts: list[str], labels: list[int], langs: list[str | None], few: int = ENOUGH, seed: int = 7) -> ToxicityModel:
    """Fit on all rows; choose thresholds on the same rows."""
    model, by_lang = fit_counted(texts, labels, langs, seed)
    set_thresholds(model, by_lang, few)
    return model


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row per labelled id; ``mark`` is 1 if either label says so."""
    return labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("mark"))


def chosen_ids(labels: DataFrame, id_col: str, label_col: str, max_positive: int, max_negative: int) -> DataFrame:
    """The labelled ids of the bounded sample: those of the smallest hashes of either label."""
    marks = labelled(labels, id_col, label_col)
    chosen = None
    for mark, most in ((1, max_positive), (0, max_negative)):
        part = marks.filter(F.col("mark") == mark).orderBy(F.xxhash64(id_col), id_col).limit(most)
        chosen = part if chosen is None else chosen.union(part)
    return chosen


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str, max_positive: int, max_negative: int, max_chars: int) -> list[tuple[str, int, str | None]]:
    """The bounded sample: the rows of the smallest id hashes of either label."""
    chosen = chosen_ids(labels, id_col, label_col, max_positive, max_negative)
    rows = (
        docs.select(id_col, text_col, lang_col)
        .filter(F.length(text_col) <= max_chars)
        .join(F.broadcast(chosen), id_col)  # at most max_positive + max_negative rows
        .select(text_col, "mark", lang_col, id_col)
    )
    return [(r[0], int(r[1]), r[2]) for r in sorted(rows.collect(), key=lambda r: (r[3], r[0]))]


def text_key(text_col: str, lang_col: str):
    """A digest of a row's language and text, as a column: rows with the same one have the same verdict."""
    lang = F.coalesce(F.concat(F.lit("="), F.col(f"`{lang_col}`").cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(lang, F.lit("\n"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("binary")))


def stored_scores(docs: DataFrame, model: ToxicityModel | None, id_col: str, text_col: str, lang_col: str, max_chars: int) -> DataFrame:
    """(id, lang, text_key, long, score) of every row, scored once and stored; ``long``: over ``max_chars``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the data
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        text_key(text_col, lang_col).alias("text_key"),
        F.coalesce(F.length(f"`{text_col}`") > max_chars, F.lit(True)).alias("long"),
        F.col(f"`{text_col}`").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("nothing",))
        table = ProjectionTable(sent.value) if sent.value else None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                scores = table.scores(texts_of(batch, "text")) if table else [0.0] * batch.num_rows
                yield with_columns(batch, ["id", "lang", "text_key", "long"], score=pa.array(scores, pa.float64()))

    return materialize(spread(rows).mapInArrow(run, f"id {id_type}, lang string, text_key binary, long boolean, score double"), "toxicity-scores")


def other_counts(scores: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_positive: int, max_negative: int) -> DataFrame:
    """(lang, mark, step, n): the labelled rows outside the sample, from their stored scores."""
    chosen = chosen_ids(labels, id_col, label_col, max_positive, max_negative).select(F.col(id_col).alias("id"), F.lit(True).alias("chosen"))
    marks = labelled(labels, id_col, label_col).filter(F.col("mark").isin(0, 1)).select(F.col(id_col).alias("id"), F.col("mark").cast("int").alias("mark"))
    marks = marks.join(F.broadcast(chosen), "id", "left")  # at most max_positive + max_negative rows
    step = F.size(F.filter(F.array(*[F.lit(float(g)) for g in GRID]), lambda g: g <= F.col("score")))
    others = scores.join(marks, "id").filter(F.col("chosen").isNull() | F.col("long"))
    return others.groupBy("lang", "mark", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))


def _table(rows) -> np.ndarray:
    """Counts (steps, 2) of rows (mark, step, n)."""
    out = np.zeros((len(GRID) + 1, 2), np.int64)
    for mark, step, n in rows:
        out[step, mark] += n
    return out


def thresholds(counts: DataFrame, few: int = ENOUGH) -> tuple[float, DataFrame]:
    """The common threshold, and (lang, threshold) of the languages with a positive, from (lang, mark, step, n)."""
    total = _table(counts.groupBy("mark", "step").agg(F.sum("n")).collect())  # two marks, some twenty steps
    common = shrunk(total, 0.3, few)

    def of_lang(rows: pa.Table) -> pa.Table:
        own = _table(zip(*(rows.column(c).to_pylist() for c in ("mark", "step", "n")), strict=True))
        found = [(rows.column("lang")[0].as_py(), shrunk(own, common, few))] if own[:, 1].sum() else []
        return pa.table({"lang": pa.array([f[0] for f in found], pa.string()), "threshold": pa.array([f[1] for f in found], pa.float64())})

    return common, counts.filter("lang IS NOT NULL").groupBy("lang").applyInArrow(of_lang, "lang string, threshold double")


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
    max_positive: int = 1500,
    max_negative: int = 2500,
    max_chars: int = 20_000,
    trained_on: DataFrame | None = None,
) -> DataFrame:
    """Per row of ``docs``: id, ``text_key``, ``score`` and ``flagged`` (score at or above the
    threshold of the row's language). ``labels`` must hold only rows that may be learnt from;
    their texts are looked up in ``trained_on`` (``docs`` if not given)."""
    spark, source = docs.sparkSession, docs if trained_on is None else trained_on
    rows = training_sample(source, labels, id_col, text_col, lang_col, label_col, max_positive, max_negative, max_chars)
    model, sample = None, {}
    if len({r[1] for r in rows}) == 2:
        model, sample = fit_counted(*(list(x) for x in zip(*rows, strict=True)), each=partial(on_tasks, spark))
    scores = stored_scores(docs, model, id_col, text_col, lang_col, max_chars)
    out = scores.select(F.col("id").alias(id_col), "text_key", "score", "lang")
    if model is None:
        return out.select(id_col, "text_key", "score", F.lit(False).alias("flagged"))
    learnt = scores if trained_on is None else stored_scores(trained_on, model, id_col, text_col, lang_col, max_chars)
    seen = [(lang, mark, step, int(n)) for lang, c in sample.items() for (step, mark), n in np.ndenumerate(c) if n]  # rows of the sample at most
    counts = other_counts(learnt, labels, id_col, label_col, max_positive, max_negative)
    counts = counts.union(spark.createDataFrame(seen, "lang string, mark int, step int, n long"))
    common, by_lang = thresholds(materialize(counts, "toxicity-counts"))
    by_lang = by_lang.withColumnRenamed("lang", "of_lang")
    flagged = F.col("score") >= F.coalesce("threshold", F.lit(common))
    return out.join(handed_out(by_lang), F.col("lang") == F.col("of_lang"), "left").select(id_col, "text_key", "score", flagged.alias("flagged"))


def reject_toxic(docs: DataFrame, scored: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not flagged, as they are."""
    key = free_name(docs, "text_key")
    gone = scored.filter("flagged").select(F.col("text_key").alias(key)).distinct()
    left = by_ids(docs.withColumn(key, text_key(text_col, lang_col)), gone, key, "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
