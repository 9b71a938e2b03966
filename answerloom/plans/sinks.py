"""Queries on sources and sinks: what is written into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom import schemas
from answerloom.operators import checks, runs, tables
from answerloom.plans.answers import EVAL, MEAN, scored
from answerloom.plans.inputs import DATASETS, EXAMPLES, PREDICTIONS, examples, predictions, table
from answerloom.plans.registry import query
from answerloom.sources import files
from answerloom.sources.scratch import new_path


@query(f"WITH {EXAMPLES} SELECT dataset, qid, 'p' || qid AS path, question, dataset || '|' || qid AS answers, answer_type FROM examples")
def subset_round_trip(spark, sf_dir):
    """Unified examples, conformed to their schema, written by split and read back, one split after the other."""
    image = F.struct(F.encode("qid", "UTF-8").alias("bytes"), F.concat(F.lit("p"), "qid").alias("path"))
    rows = files.conform(examples(spark, sf_dir).select("dataset", "qid", image.alias("image"), "question", F.array("dataset", "qid").alias("answers"), "answer_type"))
    path = new_path(spark)
    files.write_table(rows.withColumn("split", F.col("dataset")), path, ["split"])
    back = tables.union_subsets(*[files.conform(files.read_table(spark, path, split).drop("split"), schemas.UNIFIED) for split in DATASETS])
    return back.select("dataset", "qid", "image.path", "question", F.array_join("answers", "|").alias("answers"), "answer_type")


@query(f"WITH {PREDICTIONS} SELECT qid, prediction, raw, score, run_id AS answers FROM predictions")
def prediction_lines(spark, sf_dir):
    path = new_path(spark)
    files.write_lines(predictions(spark, sf_dir).select("qid", "prediction", "raw", "score", F.array("run_id").alias("answers")), path)
    return files.read_lines(spark, path).withColumn("answers", F.array_join("answers", "|"))


RUN_FILES = f"""{EVAL}, t AS (SELECT dataset, CASE WHEN turn % 4 = 1 THEN 'single' ELSE 'all' END AS k, {MEAN} AS s FROM f GROUP BY ALL),
o AS (SELECT dataset, count(*) AS n, {MEAN} AS s FROM f GROUP BY dataset)
SELECT 'base-' || dataset AS run_id, '2024-05-01T00:00:00+00:00' AS timestamp, 'model-2b' AS base, 'zero' AS preset, dataset, dataset || '_eval' AS subset, CAST(o.n AS INT) AS n, -1 AS "limit", 'local' AS backend,
  0.0::DOUBLE AS temperature, 64 AS max_tokens, o.s AS overall, (SELECT string_agg(k || '=' || CAST(CAST(round(s * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FROM t WHERE t.dataset = o.dataset) AS by_answer_type FROM o"""


@query(RUN_FILES)
def run_files(spark, sf_dir):
    """Full run records, one JSON document each, read back with a placeholder that has no ``eval`` left out."""
    records = runs.run_documents(
        runs.run_records(scored(spark, sf_dir), ["dataset"]), "base", "dataset", timestamp=F.lit("2024-05-01T00:00:00+00:00"), git_sha=F.lit("abc"), model__base=F.lit("model-2b"),
        model__preset=F.lit("zero"), eval__subset=F.concat("dataset", F.lit("_eval")), gen__backend=F.lit("local"), gen__temperature=F.lit(0.0), gen__max_tokens=F.lit(64),
    )
    path = new_path(spark)
    files.write_documents(records.withColumn("name", F.col("run_id")), path, "name")
    spark.createDataFrame([("x", "not run")], "run_id string, status string").coalesce(1).write.mode("append").json(f"{path}/name=placeholder")
    back = files.read_runs(spark, path)
    entries = F.transform(F.map_entries("metrics.by_answer_type"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1e6).cast("long").cast("string")))
    return back.select("run_id", "timestamp", "model.base", "model.preset", "eval.dataset", "eval.subset", "eval.n", F.coalesce("eval.limit", F.lit(-1)).alias("limit"), "gen.backend", "gen.temperature", "gen.max_tokens", "metrics.overall", F.array_join(F.array_sort(entries), ",").alias("by_answer_type"))


@query(
    """SELECT 'k' || CAST(doc_id AS VARCHAR) AS key, CASE WHEN toxic = 1 THEN 7 ELSE quality END AS verdict, CASE WHEN quality = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS cost_usd FROM labels"""
)
def verdict_table(spark, sf_dir):
    """Verdicts of all documents, compacted, then those of the toxic ones replaced and the costs of the bad ones, too."""
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.col("quality").alias("verdict"), F.lit(0.5).alias("cost_usd"), F.lit(0.0).alias("created"), "toxic", "quality")
    path = new_path(spark)
    files.read_verdicts(spark, path)  # absent: empty
    files.put_verdicts(rows, path)
    files.verdicts(spark, path).compact()
    seven = F.when(F.col("toxic") == 1, 7).otherwise(F.col("verdict")).alias("verdict")
    files.put_verdicts(rows.where("toxic = 1").select("key", seven, "cost_usd", "created"), path)
    files.put_verdicts(rows.where("quality = 0").select("key", seven, F.lit(0.25).alias("cost_usd"), "created"), path)
    return files.read_verdicts(spark, path).drop("created")


@query(
    """WITH k AS (SELECT min(doc_id) AS a, max(doc_id) AS b FROM labels)
SELECT 'k' || CAST(doc_id AS VARCHAR) AS key, 10 + quality AS verdict FROM labels, k WHERE doc_id IN (a, b)"""
)
def verdict_lookup(spark, sf_dir):
    """Two keys of a table of all, looked up in their buckets, after every verdict was replaced."""
    labels = table(spark, sf_dir, "labels")
    rows = labels.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.col("quality").alias("verdict"), F.lit(0.5).alias("cost_usd"), F.lit(0.0).alias("created"))
    path = new_path(spark)
    files.put_verdicts(rows, path)
    files.put_verdicts(rows.withColumn("verdict", F.col("verdict") + 10), path)
    ends = labels.agg(F.min("doc_id"), F.max("doc_id")).first()
    return files.verdicts(spark, path).lookup([f"k{i}" for i in ends]).select("key", "verdict")


@query(
    """SELECT lang AS subset, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS qids_sha FROM documents WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT 'gone', 3, 'kept'"""
)
def manifest_rebuild(spark, sf_dir):
    """A manifest of old entries, all of whose subsets but one are rebuilt, read again from its document."""
    fresh = tables.fingerprint(table(spark, sf_dir, "documents").where("lang is not null"), ["lang"], F.col("doc_id"), F.col("doc_id")).select(F.col("lang").alias("subset"), "n", F.col("sha").alias("qids_sha"))
    path = new_path(spark, "manifest")
    files.rebuild_manifest(spark.createDataFrame([("gone", 3, "kept"), ("en", 1, "old")], files.MANIFEST), path)
    files.rebuild_manifest(fresh, path)
    return files.read_manifest(spark, path)


@query("SELECT c_name AS name FROM customer UNION ALL SELECT c_mktsegment FROM customer")
def source_selection(spark, sf_dir):
    """Both subsets of one source of two; the other, which isn't there, is never built."""
    customers = table(spark, sf_dir, "customer")
    builders = {
        "customers": lambda: [customers.select(F.col("c_name").alias("name")), customers.select(F.col("c_mktsegment").alias("name"))],
        "absent": lambda: [table(spark, sf_dir, "absent")],
    }
    return files.select_sources(builders, "customers")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey, o_orderstatus FROM orders")
def input_order_positions(spark, sf_dir):
    """Rows numbered as they lie in several files, which hold ranges of the orders."""
    path = new_path(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    orders.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return files.in_input_order(spark, path)


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def checked_write(spark, sf_dir):
    """A table that is written if its checks hold, which the job that writes it observes."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.array("l_tax").alias("a"), F.array("l_discount").alias("b"))
    ok = checks.written(lines, new_path(spark), {"rows": checks.rows_at_least(1), "flags": checks.all_or_none("l_returnflag"), "lengths": checks.same_length("a", "b")})
    return ok.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
