"""Seeded, exact, partition-independent ordering: global rank, 80/20 split,
per-epoch batches.

Every operator uses one total order, whatever the size of the input: rows are ordered by the
first hex digits of the hash of their key, then by the hash of the whole row. Both
hashes are seeded, so the order is a shuffle; rows that are equal in every column are
equal in the order too, and it does not matter which of them comes first.

Leading digits of these hashes cut the order into ranges that are counted and
ranked in parallel. How many digits are looked at follows the measured sizes and
changes only how the work is dealt, never the order. A key on a third of the
rows is cut by the digits of the row hash; copies of one row are counted, not
gathered, and handed out again in chunks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType, TimestampType, VariantType

BUCKET_DIGITS = 4  # leading digits of the key hash in the order
RANGE_ROWS = 100_000  # rows ranked by one task, about
COPY_CHUNK = 10_000  # copies of one row handed out by one task, at most


def _cell(c: Column, kind: DataType) -> Column:
    """A cell as text from which the cell can be told, null apart from any text: its length, a colon, its
    content. Lists and structs are the cells in them one after another, maps their entries sorted."""
    if isinstance(kind, ArrayType):
        s = F.array_join(F.transform(c, lambda x: _cell(x, kind.elementType)), "")
    elif isinstance(kind, StructType):
        fields = [_cell(c.getField(f.name), f.dataType) for f in kind]
        s = F.when(c.isNotNull(), F.concat(F.lit(""), *fields))
    elif isinstance(kind, MapType):
        entry = lambda x: F.concat(_cell(x["key"], kind.keyType), _cell(x["value"], kind.valueType))
        s = F.array_join(F.array_sort(F.transform(F.map_entries(c), entry)), "")
    elif isinstance(kind, BinaryType):
        s = F.hex(c)
    elif isinstance(kind, TimestampType):
        s = F.unix_micros(c).cast("string")  # its text repeats in the hour that clocks are put back
    elif isinstance(kind, VariantType):
        s = F.concat(F.schema_of_variant(c), F.lit(" "), F.to_json(c))
    else:
        s = c.cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def row_hash(df: DataFrame, columns: list[str], seed) -> Column:
    """md5 of the columns' cells and the seed."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.md5(F.concat_ws("|", *[_cell(F.col(f"`{c}`"), kinds[c]) for c in columns], F.lit(str(seed))).cast("binary"))


def _order(df: DataFrame, keys: list[str], seed) -> Column:
    """The position of a row in the order, as text."""
    whole = row_hash(df, df.columns, seed)
    bucket = F.substring(row_hash(df, keys, seed), 1, BUCKET_DIGITS)
    return F.concat(bucket, whole)


def _names(df: DataFrame, key: str | list[str] | None) -> list[str]:
    return df.columns if key is None else [key] if isinstance(key, str) else list(key)


def _crossing(positions: DataFrame, digits: int, test: float | None, need: int = 0):
    """Of (position) rows: the range of leading ``digits`` in which the running count reaches
    ``need`` (or ``ceil(test * rows)``), as (cut, before, size, need). At most 16 ** 4 ranges or
    ``RANGE_ROWS`` positions meet in the window; one row comes back. None without rows."""
    sizes = positions.groupBy(F.substring("position", 1, digits).alias("cut")).agg(F.count(F.lit(1)).alias("size"))
    running = F.sum("size").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.lit(need) if test is None else F.ceil(F.lit(float(test)) * F.sum("size").over(Window.partitionBy()))
    upto = sizes.withColumn("need", wanted).withColumn("upto", running).filter(F.col("upto") >= F.col("need"))
    return upto.orderBy("cut").select("cut", (F.col("upto") - F.col("size")).alias("before"), "size", "need").first()


def exact_split(
    df: DataFrame,
    key: str | list[str] | None = None,
    test: float = 0.2,
    seed: int = 42,
    split_col: str = "split",
) -> DataFrame:
    """Seeded shuffle then exact cut: ``ceil(test * n)`` rows labelled ``test``, the rest ``train``.

    Only the row at the cut has to be found: counts by leading digits narrow it down four
    digits at a time (two or three small jobs, one row each to the driver), and every
    other row is labelled by comparison, so rows are neither shuffled nor changed. Where copies
    of one row lie on the cut, they are handed out again from one of them and their count.
    """
    position = _order(df, _names(df, key), seed)
    keep = [F.col(f"`{c}`") for c in df.columns if c != split_col]
    rows = df.select(position.alias("position"))
    found = _crossing(rows, BUCKET_DIGITS, test)
    if found is None:
        return df.select(*keep, F.lit("train").alias(split_col))
    cut, need, size, digits = found["cut"], found["need"] - found["before"], found["size"], BUCKET_DIGITS
    while digits < BUCKET_DIGITS + 32:
        digits = BUCKET_DIGITS + 32 if size <= RANGE_ROWS else digits + 4
        found = _crossing(rows.filter(F.col("position").startswith(cut)), digits, None, need)
        cut, need, size = found["cut"], need - found["before"], found["size"]
    x = df.withColumn("__position", position)
    if size == 1:
        return x.select(*keep, F.when(F.col("__position") <= cut if need else F.col("__position") < cut, "test").otherwise("train").alias(split_col))
    away = x.filter(F.col("__position") != cut).withColumn(split_col, F.when(F.col("__position") < cut, "test").otherwise("train"))
    one = x.filter(F.col("__position") == cut).limit(1).withColumn("__size", F.lit(size).cast("long"))
    at = _copies(one, "__size", "__copy").withColumn(split_col, F.when(F.col("__copy") < need, "test").otherwise("train"))
    return away.select(*keep, split_col).unionByName(at.select(*keep, split_col))


def _copies(df: DataFrame, count: str, number: str) -> DataFrame:
    """Every row ``count`` times, numbered from 0. Large counts are cut into chunks that are
    dealt to all tasks first."""
    last = F.floor((F.col(count) - 1) / COPY_CHUNK).cast("long")
    first = F.col("__chunk") * COPY_CHUNK
    few = df.filter(F.col(count) <= COPY_CHUNK).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    many = (
        df.filter(F.col(count) > COPY_CHUNK)
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .repartition(df.sparkSession.sparkContext.defaultParallelism)
        .withColumn(number, F.explode(F.sequence(first, F.least(F.col(count), first + COPY_CHUNK) - 1)))
        .drop("__chunk")
    )
    return few.unionByName(many)


def global_rank(
    df: DataFrame,
    key: str | list[str] | None = None,
    partition_by: list[str] | None = None,
    rank_col: str = "rank",
    total_col: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """1-based rank of every row in the seeded order within its ``partition_by`` group (null
    is a group like any other), and the group's size under ``total_col``.

    Rows are collapsed to one per position with its count, which is the only shuffle of
    whole rows. Positions are then ranked in ranges of leading digits, as many digits as
    the range's bucket needs, and shifted by the count of all earlier ranges.
    """
    group = row_hash(df, list(partition_by or []), "group") if partition_by else F.lit("")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    x = df.select(group.alias("__group"), _order(df, _names(df, key), seed).alias("__position"), row.alias("__row"))
    kept = x.groupBy("__group", "__position").agg(F.count(F.lit(1)).alias("__count"), F.first("__row").alias("__row"))
    counts = x.groupBy("__group", "__position").agg(F.count(F.lit(1)).alias("__count"))

    bucket = F.substring("__position", 1, BUCKET_DIGITS)
    sizes = counts.groupBy("__group", bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__distinct"))
    digits = F.when(F.col("__distinct") <= RANGE_ROWS, 0).otherwise(F.ceil(F.log(16.0, F.col("__distinct") / RANGE_ROWS)))
    sizes = sizes.select("__group", "__bucket", (digits + BUCKET_DIGITS).cast("int").alias("__digits"))
    ranged = counts.withColumn("__bucket", bucket).join(sizes, ["__group", "__bucket"])
    ranged = ranged.withColumn("__range", F.expr("substring(__position, 1, __digits)"))
    totals = ranged.groupBy("__group", "__range").agg(F.sum("__count").alias("__n"))
    earlier = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "__group",
        "__range",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy("__group")).alias("__total"),
    )
    inside = Window.partitionBy("__group", "__range").orderBy("__position").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.join(totals, ["__group", "__range"]).select(
        "__group", "__position", (F.coalesce(F.sum("__count").over(inside), F.lit(0)) + F.col("__before")).alias("__start"), "__total"
    )
    out = _copies(kept.join(starts, ["__group", "__position"]), "__count", "__copy")
    new = {rank_col: (F.col("__start") + F.col("__copy") + 1).cast("long")} | ({total_col: F.col("__total")} if total_col else {})
    return out.select(*[F.col(f"__row.`{c}`") for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])


PERMUTATION_ROUNDS = 24


def permutation_keys(seed, epoch) -> list[int]:
    """One number a round, from md5."""
    return [int(hashlib.md5(f"{seed}|{epoch}|{r}".encode()).hexdigest()[:13], 16) for r in range(PERMUTATION_ROUNDS)]


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """The place of ``x`` (0 to n - 1) under a keyed permutation of these n numbers. In each round every
    number has a partner, (key - x) mod n, and a hash of the larger of the two says whether both change
    places; so each round maps the n numbers onto themselves, whatever n is."""

    def turn(at: Column, key: Column) -> Column:
        partner = F.pmod(key - at, n)
        pair = F.concat(F.greatest(at, partner).cast("string"), F.lit(":"), key.cast("string"))
        return F.when(F.substring(F.md5(pair.cast("binary")), 1, 1) >= "8", partner).otherwise(at)

    return F.aggregate(keys, x, turn)


def assign_batches(
    df: DataFrame,
    key: str | list[str] | None = None,
    size: int = 6,
    epochs: int | list[int] = 1,
    seed: int = 42,
    epoch_col: str = "epoch",
    batch_col: str = "batch_id",
) -> DataFrame:
    """Per-epoch reshuffle into batches of ``size`` (last one may be short).

    Every row appears once per epoch. Rows are ranked once, as in :func:`global_rank`; each epoch's order is a
    permutation of the ranks reckoned row by row, so the number of epochs adds no shuffle.
    """
    which = list(range(epochs)) if isinstance(epochs, int) else list(epochs)
    ranked = global_rank(df, key, None, "__rank", "__rows", seed)
    turns = [F.struct(F.lit(e).alias("epoch"), F.array(*[F.lit(k).cast("long") for k in permutation_keys(seed, e)]).alias("keys")) for e in which]
    each = ranked.withColumn("__turn", F.explode(F.array(*turns)))
    place = permuted(F.col("__rank") - 1, F.col("__rows"), F.col("__turn.keys"))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (epoch_col, batch_col)]
    return each.select(*keep, F.col("__turn.epoch").alias(epoch_col), F.floor(place / F.lit(size)).cast("long").alias(batch_col))
