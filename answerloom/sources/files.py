"""Sources and sinks: unified Parquet tables, JSON documents and lines, verdict tables, Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom import schemas
from answerloom.functions.text import fixed, strip
from answerloom.operators.tables import union_subsets, upsert
from answerloom.sources.keyed import KeyedTable
from answerloom.sources.scratch import remove


def read_table(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A Parquet table, or one split of a table that is partitioned by ``split``."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def conform(df: DataFrame, schema: str = schemas.UNIFIED) -> DataFrame:
    """The declared columns in the declared types; a missing column or a cast that loses values raises."""
    target = df.sparkSession.createDataFrame([], schema).schema
    return df.to(target)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_lines(spark: SparkSession, path: str, schema: str = schemas.PREDICTION) -> DataFrame:
    """JSON lines; lines that are no JSON raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, null fields written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one JSON document in each file, with ``file``; those without ``eval`` (not run) are left out."""
    runs = spark.read.schema(schemas.RUN).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    return runs.where(F.col("eval").isNotNull())


def document(*columns: Column | str) -> Column:
    """One JSON document of some columns, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_documents(df: DataFrame, path: str, name: str) -> None:
    """A JSON document for each row, in a folder for each ``name``."""
    rest = [c for c in df.columns if c != name]
    df.select(name, document(name, *rest).alias("value")).write.mode("overwrite").partitionBy(name).text(path)


def markdown_rows(label: Column, cells: list[Column]) -> Column:
    """A row of a Markdown table; absent cells are dashes."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", label, *[F.coalesce(c, F.lit("—")) for c in cells]), F.lit(" |"))


def percent(x: Column, digits: int = 1) -> Column:
    return fixed(x * 100, digits)


def sse_frames(x: Column) -> Column:
    """The payloads of server-sent frames in a text: parted by blank lines, prefix dropped, stripped, empty ones left out."""
    frames = F.filter(F.split(x, "\n\n"), lambda f: f != "")
    return F.filter(F.transform(frames, lambda f: strip(F.regexp_replace(f, "^data: ", ""))), lambda f: (f != "") & (f != "[DONE]"))


def sse_encode(event: Column) -> Column:
    return F.concat(F.lit("data: "), event, F.lit("\n\n"))


def markdown_head(label: str, names: list[str]) -> str:
    return "| " + " | ".join([label, *names]) + " |\n" + "|---" * (len(names) + 1) + "|"


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """A manifest (subset, n, sha) with rebuilt subsets in place of their old entries."""
    return upsert(old, new, ["subset"])


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def verdicts(spark: SparkSession, path: str) -> KeyedTable:
    """The judge's cache at ``path``: a table that replaces by ``key``."""
    return KeyedTable(spark, path, schemas.JUDGMENTS)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The judge's cache, each key's newest verdict; an absent one is empty, any other fault raises."""
    return verdicts(spark, path).read()


def put_verdicts(new: DataFrame, path: str) -> None:
    """Inserts verdicts, or puts them in place of those of their keys; what is there isn't read or rewritten."""
    verdicts(new.sparkSession, path).write(new)


def kept(path: str) -> Callable[[DataFrame], DataFrame]:
    """For ``judge_many``: writes answers into the verdict table at ``path`` and reads them back from it."""

    def keep(answers: DataFrame) -> DataFrame:
        table = verdicts(answers.sparkSession, path)
        version = table.write(answers)
        return table.spark.read.schema(schemas.JUDGMENTS).option("recursiveFileLookup", "true").parquet(f"{path}/version={version}")

    return keep


MANIFEST = "subset string, n long, qids_sha string"


def manifest_documents(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the documents that were written to ``path`` whole, ascending."""
    if not exists(spark, path):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    return sorted(int(n.removeprefix("document=")) for n in names if n.startswith("document="))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest document at ``path`` as rows (subset, n, qids_sha); an absent one is empty."""
    numbers = manifest_documents(spark, path)
    if not numbers:
        return spark.createDataFrame([], MANIFEST)
    whole = spark.read.schema("subsets map<string, struct<n: long, qids_sha: string>>").json(f"{path}/document={numbers[-1]}")
    return whole.select(F.explode("subsets").alias("subset", "_entry")).select("subset", "_entry.n", "_entry.qids_sha")


def rebuild_manifest(new: DataFrame, path: str) -> DataFrame:
    """Reads the manifest at ``path``, puts the rebuilt subsets ``new`` in place of their old entries, keeps all others,
    and writes it as a new document: its subsets in order. A manifest has one entry for each subset, a few rows.

    The document is written aside and renamed, and only then those before it go but the last, so a writer that dies at
    any moment leaves a whole one, and one that reads meanwhile still finds what it has listed."""
    spark = new.sparkSession
    numbers = manifest_documents(spark, path)
    merged = spark.createDataFrame(merge_manifest(read_manifest(spark, path), new.select("subset", "n", "qids_sha")).collect(), MANIFEST)
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("subset", F.struct("n", "qids_sha")))))
    number = max(numbers, default=0) + 1
    aside = f"{path}/_writing-{number}"
    merged.agg(F.to_json(F.struct(entries.alias("subsets"))).alias("value")).coalesce(1).write.mode("overwrite").text(aside)
    renamed(spark, aside, f"{path}/document={number}")
    for old in numbers[:-1]:
        remove(spark, f"{path}/document={old}")
    return merged


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file or folder; raises where that can't be done, as when ``new`` is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(old).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(hadoop(new)) or not system.rename(hadoop(old), hadoop(new)):
        raise OSError(f"{new} can't be put in place")


def in_input_order(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """A Parquet table's rows with their place as they lie: files by name, then rows as in their file, from 0.

    Nothing is sorted or shuffled but a number for each file: a row knows its index in its file, and a prefix sum over the
    files' counts tells where each begins. Names are ordered as strings, as Spark's and others' part files are numbered."""
    rows = spark.read.parquet(path)
    file = F.col("_metadata.file_path").alias("_file")
    counts = rows.select(file).groupBy("_file").agg(F.count("*").alias("n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = counts.select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = rows.select(*rows.columns, file, F.col("_metadata.row_index").alias("_at")).join(starts, "_file")
    return placed.select(*rows.columns, (F.col("_start") + F.col("_at")).alias(name))


def select_sources(builders: dict[str, Callable[[], list[DataFrame]]], only: str | None = None) -> DataFrame:
    """All subsets of all sources, or those of one; a source that isn't chosen is never built."""
    if only is not None and only not in builders:
        raise ValueError(f"{only} is none of {', '.join(builders)}")
    return union_subsets(*[subset for name, build in builders.items() if only in (None, name) for subset in build()])
