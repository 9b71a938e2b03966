"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.sources.scratch import materialize, new_path, scope, shared_dir  # noqa: F401  used by the operators

#: Labels are learnt only from rows whose crc32 of the id, modulo FOLDS, is not HELD_OUT.
FOLDS, HELD_OUT = 3, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, megabytes: int = 8) -> Iterator[None]:
    """What is run inside hands Python batches of so many bytes at most, not of so many rows: long texts come fewer at a
    time. (A single longer row is a batch of its own.)"""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{megabytes}m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Rows:
    """The columns of a DataFrame that an operator passes through: all but those its outputs replace and those it drops.

    They travel as one struct ``row``, so no name that an operator uses for its own columns can clash with one of the
    input, whatever its case; ``.unpacked`` puts them first again.
    """

    def __init__(self, df: DataFrame, outputs: Iterable[str] = (), drop: Iterable[str] = ()):
        gone = {c.lower() for c in (*outputs, *drop)}
        self.names = [c for c in df.columns if c.lower() not in gone]
        self.row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in self.names] or [F.lit(None).cast("string").alias("none")]).alias("row")

    def unpacked(self, df: DataFrame, *outputs: Column | str) -> DataFrame:
        return df.select(*(["row.*"] if self.names else []), *outputs)


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fold that nothing is learnt from; a null id always is."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(True))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is (``lower`` would touch all scripts)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
