"""Operator 11, document fingerprints by SpotSigs. Built-in DataFrame functions only.

A text's words are its runs of letters and digits, lower-cased. Words of ``COMMON`` and words of one or two characters
are common, the others are content. Wherever a content word follows a common word (or the start of the text), the common
word is an anchor, and it makes a signature with the chain of the next ``CHAIN`` content words. Boilerplate between
running prose (menus, tables, lists of numbers) has few anchors and so leaves few signatures. The distinct signatures,
as ``DIGITS`` hexadecimal digits of their md5, sorted, are the text's fingerprint.

Two sets can be at most as alike as the smaller is to the larger, so sets are partitioned by length: class c holds lengths
from ``(1 / floor) ** c`` up, and sets of classes more than one apart are less alike than ``floor`` without being compared.
Likeness is the Jaccard coefficient; below ``floor`` it is 0. Texts with equal sets have a likeness of 1, the empty set
included; a text without words has the empty set.

Nulls: a null text is empty. A null id stands after all others; rows that share an id (or have none) are followed by the same
document, and of several rows with the id that follows, the one with the smallest md5 of its text (then its text) stands for it. The only
row follows itself. Empty tables give empty results; extra columns are ignored. Ids are integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigen.session import materialize

#: Frequent words of three letters or more in English, French, German and Spanish (fixed values).
COMMON = (
    "the and for that with this was are from not but his her they you has have had were been which their would there will all one "
    "les des une est que qui pour dans par sur pas plus avec sont aux elle ils son ses mais nous vous leur comme "
    "der die das und den von mit dem des ein eine einer ist auf für sich nicht auch als bei nach aus wird sind oder war "
    "los las una del por para con como más pero sus este esta han fue son entre cuando muy sin sobre"
).split()
CHAIN = 3
DIGITS = 10
FLOOR = 0.05
_START = "^"


def _with(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column) -> Column:
    """The sorted distinct signatures of a text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    # every content word opens a piece; the common words behind it follow in the same piece
    marked = F.transform(words, lambda w: F.concat(F.when(w.isin(*dict.fromkeys(COMMON)) | (F.length(w) <= 2), F.lit(" ")).otherwise(F.lit("\n")), w))
    pieces = F.split(F.concat(F.lit(f" {_START}"), F.array_join(marked, "")), "\n")

    def spots(p: Column) -> Column:
        rows = F.filter(F.arrays_zip(*(F.slice(p, k, F.size(p)) for k in range(1, CHAIN + 2))), lambda z: z["1"].isNotNull() & z["0"].contains(" "))
        content = lambda z, k: F.substring_index(z[str(k)], " ", 1)
        chain = lambda z: F.concat_ws(" ", F.substring_index(z["0"], " ", -1), *(content(z, k) for k in range(1, CHAIN + 1)))
        return F.transform(rows, lambda z: F.substring(F.md5(chain(z).cast("binary")), 1, DIGITS))

    return F.array_sort(F.array_distinct(_with(pieces, spots)))


def length_class(size: Column, floor: float) -> Column:
    """The partition of a set by its length; the empty set is alone in -2."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / math.log(1 / floor) + 1e-9).cast("int")).otherwise(-2)


def likeness(a: Column, b: Column, floor: float = FLOOR) -> Column:
    """The Jaccard coefficient of two sets, 0 below ``floor``; sets whose lengths rule that out are not compared."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    far = F.abs(length_class(F.size(a), floor) - length_class(F.size(b), floor)) > 1
    common = F.size(F.array_intersect(a, b))
    value = common / (F.size(a) + F.size(b) - common)
    return F.when(a == b, 1.0).when(far | (small < floor * large), 0.0).otherwise(_with(value, lambda v: F.when(v >= floor, v).otherwise(0.0)))


def following(ids: DataFrame) -> DataFrame:
    """(id, next_id) of distinct ids: the next smaller one, null after all, then the first again. Ids are sorted by range; within
    a range a window looks one row ahead, and the last of a range is followed by the first of the next one."""
    order = [F.col("id").isNull(), F.desc("id")]
    ranged = materialize(ids.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "id-ranges")
    row = F.struct(F.col("id")).alias("row")
    # one row a range
    heads = ranged.select("range", "id", row, F.row_number().over(Window.partitionBy("range").orderBy(*order)).alias("at")).filter("at = 1")
    ends = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("row").over(ends), F.first("row").over(ends)).alias("beyond"))
    ahead = F.lead(row).over(Window.partitionBy("range").orderBy(*order))
    return ranged.select("range", "id", ahead.alias("ahead")).join(F.broadcast(heads), "range").select("id", F.coalesce("ahead", "beyond")["id"].alias("next_id"))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, next_text) of every row. Texts move twice: by their own id, and to the row they follow."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ids = materialize(docs.groupBy("id").agg(F.count(F.lit(1)).alias("rows")), "ids")
    pairs = materialize(following(ids.select("id")), "following").select(F.col("id").alias("of"), "next_id")
    ahead = docs.join(pairs, docs["id"].eqNullSafe(pairs["next_id"])).select("of", "text")
    if not ids.filter("rows > 1").isEmpty():
        ahead = ahead.groupBy("of").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")), "text"))["text"].alias("text"))
    ahead = ahead.withColumnRenamed("text", "next_text")
    return docs.join(ahead, docs["id"].eqNullSafe(ahead["of"])).select("id", "text", "next_text")


def spliced(text: Column, other: Column) -> Column:
    """A text whose last half (rounded down) is replaced by the first as many characters of another, or all it has."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", floor: float = FLOOR) -> DataFrame:
    """Per row: id, ``n_chars``, ``edited`` (its spliced text), the ``fingerprint`` of both, and the likeness of its
    fingerprint to the edited text's (``near_edited``) and the next document's (``near_next``)."""
    rows = with_next(df, id_col, text_col).withColumn("edited", spliced(F.col("text"), F.col("next_text")))
    sets = rows.select("id", F.char_length("text").cast("long").alias("n_chars"), "edited", *(signatures(F.col(c)).alias(f"{c}_set") for c in ("text", "edited", "next_text")))
    return sets.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited",
        F.array_join("text_set", "").alias("fingerprint"),
        F.array_join("edited_set", "").alias("edited_fingerprint"),
        likeness(F.col("text_set"), F.col("edited_set"), floor).alias("near_edited"),
        likeness(F.col("text_set"), F.col("next_text_set"), floor).alias("near_next"),
    )
