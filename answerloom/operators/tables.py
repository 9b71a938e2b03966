"""Keyed table operations: upsert, last-wins merges, semi-reduced payload joins, ordered fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``; fails the job where a key repeats."""
    values = [c for c in rows.columns if c not in keys]
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys))))).otherwise(F.col(keys[0]))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in values])
    return counted.withColumn(keys[0], once).select(rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key. Of rows of ``new`` with one key the last by
    ``order`` counts; without an order a repeated key fails the job."""
    values = [c for c in old.columns if c not in keys]
    new = unique(new.select(old.columns), keys) if order is None else last_wins(new, keys, order, values).select(old.columns)
    return old.join(new.select(*keys), keys, "left_anti").select(old.columns).unionByName(new)


def last_wins(rows: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """The values of each key's last row; partially aggregated, so a key with many rows costs nothing special."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")


def looked_up(rows: DataFrame, key: str, table: DataFrame, table_key: str, order: Column | None = None) -> DataFrame:
    """``rows`` with the columns of their key's row of ``table``; fails the job where there is none.

    Of rows of ``table`` with one key the last by ``order`` counts; without an order a repeated key fails the job. Rows
    that nobody asks for are dropped before anything wide moves.
    """
    values = [c for c in table.columns if c != table_key]
    held = table.join(rows.select(F.col(key).alias(table_key)).distinct(), table_key, "left_semi")
    held = unique(held, [table_key]) if order is None else last_wins(held, [table_key], order, values)
    found = held.select(F.col(table_key).alias(key), F.struct(*values).alias("_row"))
    return must_match(rows.join(found, key, "left"), "_row", f"row for a {key}").select(*rows.columns, "_row.*")


def payloads(instructions: DataFrame, key: str, images: DataFrame, image_key: str, order: Column | None = None) -> DataFrame:
    """Instructions with their image's columns; every image must be there, and of one that repeats the last counts."""
    return looked_up(instructions, key, images, image_key, order)


def fingerprint(rows: DataFrame, by: list[str], key: Column, order: Column, parts: Column | None = None) -> DataFrame:
    """SHA-256 of each group's keys joined by commas in order. The digest is of one string, so a group's keys meet in
    one task: it is for id columns of subsets, not for payloads."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), key.cast("string").alias("k")))), lambda s: s["k"]), ",")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("sha"))


def union_subsets(*subsets: DataFrame) -> DataFrame:
    """All rows of all subsets, columns matched by name."""
    out = subsets[0]
    for s in subsets[1:]:
        out = out.unionByName(s)
    return out


def must_match(joined: DataFrame, column: str, what: str) -> DataFrame:
    """Fails the job when a left join left the column without a partner."""
    return joined.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit(f"no {what}"))).otherwise(F.col(column)))


def zip_strict(left: DataFrame, right: DataFrame, position: str = "position") -> DataFrame:
    """Two tables side by side by position; fails the job where one lacks a position that the other has."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    both = a.join(b, position, "full")
    checked = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("the tables differ in length"))).otherwise(F.col(position))
    return both.withColumn(position, checked).drop("_l", "_r")


def with_override(presets: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Presets with the non-null values of overrides in place of their own; ``overrides`` has columns of ``presets``."""
    others = [c for c in overrides.columns if c != key]
    renamed = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in others])
    joined = presets.join(renamed, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in others else F.col(c) for c in presets.columns])


def marked(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with a flag: whether their key is among ``keys``."""
    return rows.join(keys.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
