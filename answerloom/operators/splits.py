"""Deterministic assignment of rows to training and evaluation splits.

Order is a column: a seeded hash of the row's key. A *global* position would need one sorted partition, so rows are
dealt into sorted ranges, written once, counted, and offset by the sum of the ranges before theirs (``with_running``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.sources.scratch import materialize


def shuffle_key(seed: int, key: Column) -> Column:
    """The seeded shuffle: sort by this, then by the key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def with_running(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before each in ``order``, of columns of any type.

    Rows are dealt into ranges of the whole order, so ties in its first column part, and written with the number of their
    range. That computes the input twice, once to sample where the ranges begin: write it first where it is costly. One total for each range, summed in order, is joined back; within a range a
    window adds up.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_in", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    # as many rows as there are ranges
    return summed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_start", "_in")


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 0, in ``order``."""
    return with_running(df, order, F.lit(1), name)


def quota_split(rows: DataFrame, count: str, order: list[Column], n_first: int, n_second: int) -> DataFrame:
    """Two buckets filled in order with whole rows' items: (row columns, ``item``, ``bucket``).

    The first bucket is filled before the second. The row on which it fills gives what it needs and its other items
    are dropped; the second bucket starts at the next row. ``n_second`` must be 1 or more. Raises if the second bucket
    can't be filled.
    """
    if n_second < 1:
        raise ValueError("the second bucket must hold one item at least")
    running = materialize(with_running(rows, order, F.col(count), "_before"))
    # the second bucket's sum runs from the first row that the first bucket doesn't need
    later = running.where(F.col("_before") >= n_first).agg(F.min("_before").alias("start"), F.coalesce(F.sum(count), F.lit(0)).alias("filled")).first()
    if later["filled"] < n_second:
        raise ValueError(f"only {later['filled']} of {n_second} items for the second bucket")
    start = later["start"]
    first = F.col("_before") < n_first
    room = F.when(first, F.lit(n_first) - F.col("_before")).otherwise(F.lit(n_second + start) - F.col("_before")).cast("long")
    both = running.where(first | (F.col("_before") < n_second + start)).withColumn("bucket", F.when(first, "first").otherwise("second"))
    both = both.withColumn("_n", F.least(F.col(count).cast("long"), room)).where("_n > 0")
    return both.withColumn("item", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_before", "_n")


def disjoint_split(rows: DataFrame, key: str, order: list[Column], n_first: int, n_second: int) -> DataFrame:
    """The first ``n_first`` rows, then up to ``n_second`` later rows whose key none of those has; ``bucket`` tells."""
    placed = materialize(with_position(rows, order, "_at"))
    first = placed.where(F.col("_at") < n_first)
    rest = placed.where(F.col("_at") >= n_first).join(first.select(key).distinct(), key, "left_anti")
    second = with_position(rest, [F.col("_at")], "_next").where(F.col("_next") < n_second).drop("_next")
    return first.withColumn("bucket", F.lit("first")).unionByName(second.withColumn("bucket", F.lit("second"))).drop("_at")


def positional_split(rows: DataFrame, order: list[Column], sizes: list[tuple[str, int | None]]) -> DataFrame:
    """Consecutive slices by position: (name, size) in order, None for all that is left; other rows go."""
    placed = with_position(rows, order)
    bucket, at = F.lit(None).cast("string"), 0
    for name, size in sizes:
        inside = F.col("position") >= at if size is None else F.col("position").between(at, at + size - 1)
        bucket = F.coalesce(bucket, F.when(inside, name))
        at += size or 0
    return placed.withColumn("bucket", bucket).where("bucket is not null")


def sample_rows(rows: DataFrame, by: list[str], key: str, seed: int, n: Column) -> DataFrame:
    """At most ``n`` rows without replacement in each group, those of the smallest seeded hashes."""
    w = Window.partitionBy(*by).orderBy(shuffle_key(seed, F.col(key)), key)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
