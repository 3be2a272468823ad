"""Operator 4, near-duplicates by circulant MinHash.

A document is the set of its word shingles. Two permutations give all signature
coordinates: the first scatters a shingle's hash over ``PLACES`` places, the second is a
table of those places, and coordinate k reads the table shifted circularly by k. A
shingle's values under all shifts thus lie side by side in memory, and a signature is a
minimum over those rows. Coordinates are cut into bands; documents with an equal band are
candidates and every link is confirmed on the full shingle sets.

A pair at the default bounds misses all bands with a probability under 1e-5 (16 bands of 4
at a similarity of 0.85; for 0.8 take ``bands=25``, the default).

Texts with the same words collapse to their smallest id first. The members of a small bucket
are compared with one another. In a larger one the document that shares most buckets (the
middle of a group of copies) leads, and all others are compared with it, which is linear in
the bucket. A member that is not linked to the lead has fewer shingles in common with it than a link
needs, so its link with another member means that the two share enough shingles *outside* the
lead, or that the other is smaller than the lead by enough. These two cases give the
remaining pairs (see :func:`remaining_pairs`), between different components only. Edits of copies are rarely the same, so
these are few. Nothing is capped: every candidate pair is compared, linked through others, or excluded by the counts.

Null or wordless texts have an empty set and are linked with nothing. Rows with a null id
are returned with their set size, a null component and kept = true. Rows that share an id
are one document, linked when any of its texts is. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigen.llm.common import HashOf, by_ids, held, lower_ascii, mix64, texts_of, window_hashes, with_columns, words
from lexigen.llm.components import components, joined_components
from lexigen.session import materialize, spread

PLACES = 1 << 20
_SEED = 20


@cache
def circular_table(length: int) -> np.ndarray:
    """Row i: the second permutation's values at places i, i + 1, ... i + length - 1, wrapping round."""
    order = np.random.Generator(np.random.PCG64(_SEED)).permutation(PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: length - 1]]), length)


def places(shingles: np.ndarray) -> np.ndarray:
    """The first permutation (a bijection of 64-bit values), then the place of its top bits."""
    return (mix64(shingles ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - 20)).astype(np.int64)


def signature(shingles: np.ndarray, length: int) -> np.ndarray:
    """All coordinates of a non-empty set."""
    table, at = circular_table(length), places(shingles)
    out = np.full(length, PLACES, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(out, table[at[i : i + 2048]].min(axis=0), out=out)
    return out


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash per band and document, the band's number mixed in."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(parts.shape[2]):
        out = mix64(out ^ parts[:, :, k])
    return out.view(np.int64)


def words_key(text):
    """A digest of a text's words in order, A-Z lower-cased, as a column."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.md5(F.array_join(F.regexp_extract_all(plain, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ").cast("binary"))


def shingle_set(text: str, hashes: HashOf, n: int) -> np.ndarray:
    """Distinct 64-bit shingle hashes of a text."""
    found = words(lower_ascii(text))
    return np.unique(window_hashes(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)), n))


def signatures(df: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, ``words_key`` (a digest of the word sequence), ``n_shingles`` and ``bands``."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held(("hashes",), HashOf)
        for batch in batches:
            keys, sizes, sigs = [], [], np.zeros((batch.num_rows, bands * rows), np.uint32)
            for i, text in enumerate(texts_of(batch, text_col)):
                found = words(lower_ascii(text))
                ids = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
                keys.append(xxhash.xxh3_128_digest(" ".join(found).encode("utf-8", "surrogatepass")))
                shingles = np.unique(window_hashes(ids, n))
                sizes.append(len(shingles))
                if len(shingles):
                    sigs[i] = signature(shingles, bands * rows)
            banded = [b if s else None for b, s in zip(band_hashes(sigs, bands), sizes, strict=True)]
            yield with_columns(batch, [id_col], words_key=pa.array(keys, pa.binary()), n_shingles=pa.array(sizes, pa.int64()), bands=pa.array(banded, pa.list_(pa.int64())))

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, words_key binary, n_shingles long, bands array<long>")


def shingle_sets(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, shingles) of every row."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held(("hashes",), HashOf)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, hashes, n).view(np.int64) for t in texts_of(part, text_col)]
                yield with_columns(part, [id_col], shingles=pa.array(sets, pa.list_(pa.int64())))

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, shingles array<long>")


def similar(common, total, percent: int):
    """Whether ``common`` of ``total`` (sum of both sizes) shingles make a link, as a column."""
    return 100 * common >= percent * (total - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough, exactly."""
    a = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    both = pairs.join(b, "v").join(a, "u").filter(
        100 * F.least(F.size("su"), F.size("sv")) >= percent * F.greatest(F.size("su"), F.size("sv"))
    )
    shared = both.select("u", "v", (F.size("su") + F.size("sv")).alias("total"), F.size(F.array_intersect("su", "sv")).alias("common"))
    return shared.filter(similar(F.col("common"), F.col("total"), percent)).select("u", "v")


def star_rows(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Per (lead, id): both set sizes, the shingles they share and those of id outside the lead."""
    a = sets.select(F.col("id").alias("lead"), F.col("shingles").alias("sl"))
    both = stars.join(sets, "id").join(a, "lead")
    return both.select(
        "lead",
        "id",
        F.size("shingles").alias("n"),
        F.size("sl").alias("n_lead"),
        F.size(F.array_intersect("shingles", "sl")).alias("common"),
        F.array_except("shingles", "sl").alias("outside"),
    )


def remaining_pairs(family: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of members of a lead's family that are in different components and could
    still be linked, by the counts of ``family`` (from :func:`star_rows`).

    A link of sizes a and b has t = percent * (a + b) / (100 + percent) shingles in common, of which at most
    c = least(common_u, common_v) lie in the lead. So two linked members share k = t - c shingles outside the lead. Order those of
    either by how many members hold them: the first they share lies among the first |outside| - k + 1 of both. A pair is
    made only where this holds for its own sizes. Before that, each member drops what lies too far back for a partner of any size
    (the ``reach``, for t = percent * a / 100). Where k is not positive, what both
    share with the lead may do, and the pair is found by its sizes instead.
    """
    own = labels.select(F.col("node").alias("id"), "component")
    of_lead = labels.select(F.col("node").alias("lead"), F.col("component").alias("lead_component"))
    rows = family.join(own, "id").join(of_lead, "lead")
    split = rows.groupBy("lead").agg(F.max((F.col("component") != F.col("lead_component")).cast("int")).alias("open")).filter("open = 1").select("lead")
    rows = materialize(rows.join(split, "lead").withColumn("apart", F.col("component") != F.col("lead_component")), "open-families")
    apart = rows.filter("apart")

    outside = F.size("outside")
    reach = outside - F.greatest(F.lit(1), F.ceil(F.lit(percent) * F.col("n") / 100) - F.col("common")) + 1
    each = rows.select("lead", "id", "component", "apart", "n", "common", outside.alias("all"), reach.alias("reach"), F.explode("outside").alias("shingle"))
    # shingles of one edit are held by the same members: such a set counts once, by its digest
    digest = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"d{k}") for k in (1, 2)]
    counts = each.groupBy("lead", "shingle").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), *digest)
    shared = each.join(counts.filter("low <> high").drop("low", "high"), ["lead", "shingle"])
    one = Window.partitionBy("lead", "id")
    # shingles of one component alone come first, so they use up places
    place = F.row_number().over(one.orderBy("members", "shingle")) + F.col("all") - F.count(F.lit(1)).over(one)
    ranked = shared.withColumn("place", place).filter(F.col("place") <= F.col("reach"))
    facts = ("component", "apart", "n", "common", "all")
    held = ranked.groupBy("lead", "members", "d1", "d2", "id").agg(F.min("place").alias("place"), *[F.max(c).alias(c) for c in facts])
    key = ["lead", "members", "d1", "d2"]
    side = lambda x: [*key, F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("place", *facts)]]
    total = F.col("n_u") + F.col("n_v")
    least = F.ceil(F.lit(percent) * total / (100 + percent)) - F.least("common_u", "common_v")
    by_shingle = held.filter("apart").select(*side("u")).join(held.select(*side("v")), key).filter(
        (F.col("component_u") != F.col("component_v"))
        & (~F.col("apart_v") | (F.col("u") > F.col("v")))
        & (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
        & (F.col("place_u") <= F.col("all_u") - least + 1)
        & (F.col("place_v") <= F.col("all_v") - least + 1)
    ).select("u", "v")

    # partners smaller than the lead, of the sizes for which what u shares with the lead may do
    low = F.ceil(F.lit(percent) * F.col("n") / 100)
    high = F.least(F.col("n_lead") - 1, F.floor((100 + percent) * F.col("common") / F.lit(percent)) - F.col("n"))
    sizes = apart.select("lead", F.col("id").alias("u"), F.col("component").alias("cu"), F.col("n").alias("nu"), low.cast("int").alias("low"), high.cast("int").alias("high")).filter("low <= high")
    sizes = sizes.select("lead", "u", "cu", "nu", F.explode(F.sequence("low", "high")).alias("n"))
    partner = rows.select("lead", F.col("id").alias("v"), F.col("component").alias("cv"), "n", "common")
    by_size = sizes.join(partner, ["lead", "n"]).filter((F.col("cu") != F.col("cv")) & (percent * (F.col("nu") + F.col("n")) <= (100 + percent) * F.col("common"))).select("u", "v")
    return by_shingle.union(by_size).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def label(links: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, component) of every id that is linked or in a bucket."""
    nodes = weights.select(F.col("id").alias("node"), F.col("id").alias("own"))
    found = components(links).join(nodes, "node", "full_outer").select("node", F.coalesce("component", "node").alias("component"))
    return materialize(found, "labels")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = 25,
    rows: int = 4,
    small: int = 8,
) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (the smallest id reachable over links of
    ``percent`` % similarity or more) and ``kept`` (id = component_id). Buckets of up to
    ``small`` members are compared pair by pair."""
    signed = materialize(signatures(df, id_col, text_col, shingle, bands, rows), "signatures")
    own = signed.filter((F.col("n_shingles") > 0) & F.col(id_col).isNotNull())
    classes = materialize(own.groupBy("words_key").agg(F.min(id_col).alias("id"), F.first("bands").alias("bands")), "classes")
    # copies of the same words are linked through their smallest id
    copies = own.join(classes.select("words_key", "id"), "words_key").select(F.col(id_col).alias("u"), F.col("id").alias("v")).filter("u <> v")

    banded = classes.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = materialize(banded.join(shared, "band"), "buckets")
    weights = materialize(buckets.groupBy("id").agg(F.sum("members").alias("weight")), "weights")
    texts = by_ids(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), weights.select("id"), "id", "left_semi")
    sets = materialize(shingle_sets(texts, "id", "text", shingle), "shingle-sets")

    one = buckets.filter(F.col("members") <= small)
    pairs = one.select("band", F.col("id").alias("u")).join(one.select("band", F.col("id").alias("v")), "band").filter("u > v").select("u", "v")
    large = buckets.filter(F.col("members") > small).join(weights, "id")
    leads = large.groupBy("band").agg(F.max(F.struct("weight", (-F.col("id")).alias("back"))).alias("lead")).select("band", (-F.col("lead.back")).alias("lead"))
    stars = large.join(leads, "band").filter("id <> lead").select("lead", "id").distinct()
    family = materialize(star_rows(stars, sets), "stars")
    near = family.filter(similar(F.col("common"), F.col("n") + F.col("n_lead"), percent)).select(F.col("id").alias("u"), F.col("lead").alias("v"))
    links = materialize(copies.union(confirm(pairs.distinct(), sets, percent)).union(near).distinct(), "links")
    labels = label(links, weights)
    rest = materialize(remaining_pairs(family, labels, percent), "remaining-pairs")
    if not rest.isEmpty():
        more = materialize(confirm(rest, sets, percent), "more-links")
        if not more.isEmpty():
            labels = materialize(joined_components(labels, more), "labels")

    ids = labels.select(F.col("node").alias("label_node"), F.col("component").alias("label_component"))
    out = signed.join(ids, (signed[id_col] == ids["label_node"]) & (signed["n_shingles"] > 0), "left")
    component = F.when(F.col(id_col).isNotNull(), F.coalesce("label_component", F.col(id_col)))
    return out.select(id_col, "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
