"""Checks that cost no pass of their own: aggregates observed by the job that writes, tested when it has ended.

Rows are written aside; if a check fails, what was written goes and the job raises, so a table is there only if it passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from answerloom.sources.files import exists, renamed
from answerloom.sources.scratch import remove


def rows_at_least(n: int) -> Column:
    return F.count(F.lit(1)) >= n


def rows_exactly(n: int) -> Column:
    return F.count(F.lit(1)) == n


def filled(column: str, value: str, n: int) -> Column:
    """A quota: so many rows with a value, exactly."""
    return F.count_if(F.col(column) == value) == n


def all_or_none(column: str) -> Column:
    """Nulls in all rows or in none."""
    nulls = F.count_if(F.col(column).isNull())
    return (nulls == 0) | (nulls == F.count(F.lit(1)))


def same_length(left: str, right: str) -> Column:
    """Two arrays of each row have one length."""
    return F.coalesce(F.bool_and(F.size(left).eqNullSafe(F.size(right))), F.lit(True))


def written(df: DataFrame, path: str, checks: dict[str, Column]) -> DataFrame:
    """Writes ``df`` to ``path`` in one job, in which ``checks``, aggregates that must be true, are observed; the table. Raises
    ValueError with the names of those that fail, and then leaves nothing."""
    spark, seen = df.sparkSession, Observation()
    aside = f"{path}-unchecked"
    # a write of no partitions observes nothing, so true of no rows is what counts then
    df.observe(seen, *[F.coalesce(c, F.lit(False)).alias(name) for name, c in checks.items()]).write.mode("overwrite").parquet(aside)
    values = seen.get
    if failed := [name for name in checks if not values.get(name, False)]:
        remove(spark, aside)
        raise ValueError(f"{path}: {', '.join(failed)}")
    remove(spark, path)
    renamed(spark, aside, path)
    return spark.read.schema(df.schema).parquet(path)


def must_exist(spark: SparkSession, path: str, what: str = "checkpoint") -> str:
    """``path``; raises where nothing is there."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no {what} at {path}")
    return path
