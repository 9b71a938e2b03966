"""Queries on splits, order, samples and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.operators import splits, tables
from answerloom.plans.inputs import PREDICTIONS, predictions, table
from answerloom.plans.registry import query

N_FIRST, N_SECOND = 700, 1_000


def image_rows(spark, sf_dir):
    """Orders as image rows with the number of their lines as questions."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "o_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


IMAGE_ROWS = "image_rows AS (SELECT o_orderkey, o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(
    f"""WITH {IMAGE_ROWS}, r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM image_rows),
s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS second FROM r WHERE before >= {N_FIRST})
SELECT o_orderkey, i AS item, 'first' AS bucket FROM (SELECT o_orderkey, unnest(range(0, CAST(least(n, {N_FIRST} - before) AS BIGINT))) AS i FROM r WHERE before < {N_FIRST})
UNION ALL SELECT o_orderkey, i, 'second' FROM (SELECT o_orderkey, unnest(range(0, CAST(least(n, {N_SECOND} - second) AS BIGINT))) AS i FROM s WHERE second < {N_SECOND})"""
)
def quota_assign_rows(spark, sf_dir):
    return splits.quota_split(image_rows(spark, sf_dir), "n", [F.col("o_orderkey")], N_FIRST, N_SECOND).select("o_orderkey", "item", "bucket")


@query(
    f"""WITH p AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
a AS (SELECT * FROM p WHERE i < 300),
b AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS j FROM p WHERE i >= 300 AND o_custkey NOT IN (SELECT o_custkey FROM a))
SELECT o_orderkey, o_custkey, 'first' AS bucket FROM a UNION ALL SELECT o_orderkey, o_custkey, 'second' FROM b WHERE j < 500"""
)
def split_image_disjoint(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return splits.disjoint_split(orders, "o_custkey", [F.col("o_orderkey")], 300, 500).select("o_orderkey", "o_custkey", "bucket")


@query(
    """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders)
SELECT o_orderkey, position, CASE WHEN position < 200 THEN 'test' WHEN position < 300 THEN 'val' ELSE 'rl' END AS bucket FROM p WHERE position < 900"""
)
def positional_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return splits.positional_split(orders, [F.col("o_orderkey")], [("test", 200), ("val", 100), ("rl", 600)]).select("o_orderkey", "position", "bucket")


@query(
    """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY hash_key, o_orderkey) - 1 AS position FROM (SELECT o_orderkey, md5('0:' || CAST(o_orderkey AS VARCHAR)) AS hash_key FROM orders))
SELECT o_orderkey, CASE WHEN position < 500 THEN 'dev' ELSE 'train' END AS bucket FROM p"""
)
def dev_train_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey").withColumn("_h", splits.shuffle_key(0, F.col("o_orderkey")))
    return splits.positional_split(orders, [F.col("_h"), F.col("o_orderkey")], [("dev", 500), ("train", None)]).select("o_orderkey", "bucket")


@query("WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') SELECT count(*) AS shared FROM a JOIN b USING (o_custkey)")
def disjointness_check(spark, sf_dir):
    keys = lambda status: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select("o_custkey").distinct()
    return keys("F").join(keys("O"), "o_custkey", "left_semi").agg(F.count("*").alias("shared"))


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def hash_shuffle_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return rows.orderBy(splits.shuffle_key(7, F.col("doc_id")), "doc_id").limit(100)


@query(
    f"""WITH {PREDICTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, score > 0 ORDER BY md5('0:' || qid), qid) AS k FROM predictions WHERE score > 0 OR trim(prediction) <> '')
SELECT run_id, qid, score > 0 AS is_control FROM r WHERE (score > 0 AND k <= 10) OR (score = 0 AND k <= 40)"""
)
def sample_miss_hit(spark, sf_dir):
    from answerloom.operators import runs

    return runs.study_sample(predictions(spark, sf_dir), ["run_id"], 40).select("run_id", "qid", "is_control")


@query("SELECT source, count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS sha FROM documents GROUP BY source")
def subset_fingerprint(spark, sf_dir):
    return tables.fingerprint(table(spark, sf_dir, "documents"), ["source"], F.col("doc_id"), F.col("doc_id"))


@query("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def union_subsets(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return tables.union_subsets(customers, suppliers)
