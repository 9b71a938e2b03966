"""A key-value table of files that replaces by key: versions of rows in buckets, merged by readers, compacted aside.

Each write is a *version*: a folder whose rows lie in ``bucket=B`` folders by a hash of their key, named by a number and
something unique. The number is one more than those that are there when the write begins; writers at the same time may have
the same one, and then their names tell which is later, for every reader alike. So nothing must be claimed or locked. A
version is written into a folder that readers don't see and renamed, so it is there whole or not at all, and writers at the
same time don't disturb one another. A writer touches the buckets of its own keys only and reads nothing that is there. Of a
key's rows the one of the greatest version counts, as if each write were INSERT OR REPLACE in that order.

A *base* is what versions hold together: each key's newest row with its own version, so that a base next to versions that
are in it, or that were begun before it and came after, changes nothing. ``compact`` writes one aside and renames it;
``vacuum`` then removes what a base makes unnecessary, when no reader uses it any more. A lookup of some keys reads their
buckets only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.operators.tables import last_wins, unique


class KeyedTable:
    """The table at ``path`` with the columns of ``schema``; all who use it must name the same key and buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key", buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, _version string"
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, kind: str) -> list[str]:
        """The names of the folders ``kind=NAME``, ascending. Raises where the path holds something else."""
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop(self.path))]
        if odd := [n for n in names if not n.startswith(("base=", "version=", "_", "."))]:
            raise ValueError(f"{self.path} is no table that replaces by key: it holds {odd[0]}")
        return sorted(n.removeprefix(f"{kind}=") for n in names if n.startswith(f"{kind}="))

    def _included(self, base: str) -> list[str]:
        """The versions that a base was made of."""
        row = self.spark.read.text(f"{self.path}/base={base}/_included").first()
        return row[0].split(",")

    def _folders(self) -> list[str]:
        """The newest base and the versions that aren't in it."""
        bases = self._names("base")
        known = set(self._included(bases[-1])) if bases else set()
        return [f"base={b}" for b in bases[-1:]] + [f"version={v}" for v in self._names("version") if v not in known]

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _rows(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, with ``_version``."""
        paths = [f"{self.path}/{folder}" for folder in self._folders()]
        if buckets is not None:
            paths = [p for folder in paths for b in buckets if self._fs.exists(self._hadoop(p := f"{folder}/bucket={b}"))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def read(self) -> DataFrame:
        """Each key's newest row."""
        return self._newest(self._rows())

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in self.columns if c != self.key]
        return last_wins(rows, [self.key], F.col("_version"), values).select(self.columns)

    def lookup(self, keys: Iterable[str]) -> DataFrame:
        """The newest rows of some keys; reads their buckets only. Keys are few, named by the caller; for many join ``read``."""
        keys = list(keys)
        asked = self.spark.createDataFrame([(k,) for k in keys], "k string")
        buckets = sorted({r.b for r in asked.select(self.bucket_of(F.col("k")).alias("b")).collect()})
        return self._newest(self._rows(buckets).where(F.col(self.key).cast("string").isin(keys)))

    def _next(self) -> str:
        """A name after all that are there: its number has as many digits as any, so names sort like numbers."""
        last = max([*self._names("version"), *self._names("base")], default="0-")
        return f"{int(last.split('-')[0]) + 1:019d}-{uuid.uuid4().hex}"

    def _put(self, rows: DataFrame, name: str, included: list[str] | None = None) -> None:
        """Rows with ``_version`` into the folder ``name``, which appears when all of it is there."""
        aside = f"{self.path}/_writing-{name}"
        dealt = rows.withColumn("bucket", self.bucket_of(F.col(self.key))).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(aside)
        if included is not None:
            self.spark.createDataFrame([(",".join(included),)], "value string").coalesce(1).write.text(f"{aside}/_included")
        if not self._fs.rename(self._hadoop(aside), self._hadoop(f"{self.path}/{name}")):
            raise OSError(f"{name} of {self.path} can't be put in place")

    def write(self, rows: DataFrame, order: Column | None = None) -> str:
        """Inserts ``rows``, or puts them in place of those of their keys; the new version's name. Of rows with one key the
        last by ``order`` counts; without an order a repeated key fails the job, and nothing is written."""
        values = [c for c in self.columns if c != self.key]
        new = unique(rows.select(self.columns), [self.key]) if order is None else last_wins(rows, [self.key], order, values).select(self.columns)
        name = self._next()
        self._put(new.withColumn("_version", F.lit(name)), f"version={name}")
        return name

    def compact(self) -> str | None:
        """Writes a base of all that is there, unless there is nothing new; its name."""
        bases, versions = self._names("base"), self._names("version")
        known = self._included(bases[-1]) if bases else []
        if not set(versions) - set(known):
            return None
        name = self._next()
        rows = self._rows()
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != self.key]), "_version").alias("_v"))
        self._put(newest.select(self.key, "_v.*").select(rows.columns), f"base={name}", sorted({*known, *versions}))
        return name

    def vacuum(self) -> None:
        """Removes versions that the newest base holds, and older bases. Call it when no one reads what was there before."""
        bases = self._names("base")
        if bases:
            gone = [f"base={b}" for b in bases[:-1]] + [f"version={v}" for v in set(self._names("version")) & set(self._included(bases[-1]))]
            for folder in gone:
                self._fs.delete(self._hadoop(f"{self.path}/{folder}"), True)
