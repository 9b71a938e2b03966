"""A corpus pipeline of five stages: quality, language, near duplicates, decontamination, packing.

``run`` applies them to ``documents``; each stage's rows are written as Parquet and reread as the next one's input.

In every stage a row's columns travel as one struct, so columns of any name and type pass through unchanged, rows that
repeat are rows each, and null ids are ids like any other. All texts are read whole, however long. An empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm import decontaminate, jaccard, langid, packing, quality
from answerloom.llm.common import materialize, new_path, scope, table


def whole(docs: DataFrame) -> Column:
    """A row's columns as the struct ``doc``."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.5; the classifier learns from the labelled ones among them.

    Null, empty and repeated texts have a score like any other (the network's at the zero vector for those without
    words). Without labels every score is 0.5, and all documents stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(spark, docs.select(whole(docs), "text"), model).where("predicted = 1").select("doc.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: Collection[str] | None = None, slack: float = langid.SLACK) -> DataFrame:
    """Documents in one of ``languages`` (all learnt ones if None).

    Those without a letter go (null and empty texts among them), and those farther from every profile than ``slack``
    times the training documents of the nearest language and of like length. Where nothing can be learnt, since no row
    has a language, no document has one, and none stays. Ties go to the language that sorts first.
    """
    judged = langid.identify(spark, docs.select(whole(docs), "text"), langid.fit(docs)).withColumn("length_class", langid.length_class(F.col("text")))
    # written, so that each text is judged once, for the bounds and for the filter
    judged = materialize(judged.drop("text"))
    bounds = langid.bounds(judged.select("doc.doc_id", "doc.lang", "lang_pred", "score", "length_class"), slack)
    bound = judged.join(F.broadcast(bounds), ["lang_pred", "length_class"], "left")  # some numbers for each language
    near = (F.col("score") > 0) & (F.col("score") >= F.coalesce("bound", F.lit(0.0)))
    wanted = F.col("lang_pred") != langid.UNKNOWN if languages is None else F.col("lang_pred").isin(*languages)
    return bound.where(wanted & near).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 over five-word shingles make: that of the least id.

    Rows are told apart by a number given to each, never by ``doc_id``, so a null id (after all others) and an id that
    stands on several texts are rows like any other; of rows that repeat the least id one stays, by a hash of the row.
    Texts without words (null, empty, blank) are in no group, and all stay.
    """
    numbered = materialize(docs.select(whole(docs), F.monotonically_increasing_id().alias("number")))
    groups = jaccard.similarity_groups(spark, numbered.select(F.col("number").alias("doc_id"), "doc.text"), k=5, num=8, den=10)
    hashed = F.xxhash64(*[F.col(f"doc.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    place = F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), "doc.doc_id", hashed.alias("hash"), "number")
    members = numbered.select("number", place.alias("place")).join(groups.select(F.col("doc_id").alias("number"), "component_id"), "number")
    members = materialize(members)
    least = members.groupBy("component_id").agg(F.min("place").alias("least")).select("component_id", F.col("least.number").alias("kept"))
    # the rows that go are the fewer: as long as they are few enough to be broadcast, no text is shuffled
    gone = materialize(members.join(least, "component_id").where("number != kept").select("number"))
    return numbered.join(gone, "number", "left_anti").select("doc.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of any benchmark item.

    Whether a row goes follows from its text alone, so null ids and an id that stands on several texts are judged like
    any other. Null and empty texts have no words, and stay; without a benchmark all stay.
    """
    judged = decontaminate.contamination(docs.select(whole(docs), "text"), table(spark, sf_dir, "benchmark"))
    return judged.where("not contaminated").select("doc.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin: ``doc_id`` and the columns of ``packing.OUTPUTS``.

    Texts without words get a row without a bin; texts longer than a bin are cut, so every word is packed once. Ties in
    length are ordered by id and a hash of the text.
    """
    return packing.pack(docs.select("doc_id", "text"), packing.n_words(F.col("text")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]
#: SQL expresses neither the stages that learn nor best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes for itself is removed when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        with scope():
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
