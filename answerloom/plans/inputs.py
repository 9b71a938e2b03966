"""Stand-ins for the engine's inputs on the driver tables, each once in Spark and once in SQL (as a CTE)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DATASETS = ["vqav2", "gqa", "clevr", "textvqa"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, dataset, prediction, golds): the lines of each part as annotators."""
    w = Window.partitionBy("l_partkey").orderBy(*LINE_ORDER)
    q = F.col("l_quantity").cast("int") % 5
    text = F.when(q == 0, "two").when(q == 1, " 2. ").when(q == 2, "a dog").when(q == 3, "The Dog!").otherwise("It isnt, 3")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", text.alias("a"), F.row_number().over(w).alias("rn"))
    golds = lines.groupBy("l_partkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "a"))), lambda s: s["a"]).alias("golds"))
    k = F.col("p_partkey")
    dataset = F.element_at(F.array(*map(F.lit, DATASETS)), (k % 4 + 1).cast("int"))
    prediction = F.element_at(F.array(F.lit("2"), F.lit("dog"), F.lit("it isn't 3")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").join(golds, F.col("l_partkey") == k).select(k.alias("key"), dataset.alias("dataset"), prediction.alias("prediction"), "golds")


PANELS = f"""
lines AS (
  SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(LINE_ORDER)}) AS rn,
         CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'two' WHEN 1 THEN ' 2. ' WHEN 2 THEN 'a dog' WHEN 3 THEN 'The Dog!' ELSE 'It isnt, 3' END AS a
  FROM lineitem),
panels AS (
  SELECT p_partkey AS key, ['vqav2', 'gqa', 'clevr', 'textvqa'][p_partkey % 4 + 1] AS dataset,
         ['2', 'dog', 'it isn''t 3'][p_size % 3 + 1] AS prediction, golds
  FROM part JOIN (SELECT l_partkey, list(a ORDER BY rn) AS golds FROM lines GROUP BY l_partkey) ON l_partkey = p_partkey)"""


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, raw, golds, dataset): assistant turns, tagged in five ways; the turn before asks."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("question", F.lag("text").over(w)).where("role = 'assistant'")
    text = F.col("text")
    word = F.regexp_extract(text, "[A-Za-z]+", 0)
    k, tag = F.col("conv_id") % 5, lambda x: F.concat(F.lit("<answer>"), x, F.lit("</answer>"))
    raw = (
        F.when(k == 0, F.concat(F.lit(" \n"), text)).when(k == 1, F.concat(text, tag(F.concat(word, F.lit("s"))))).when(k == 2, F.concat(tag(F.lit("no")), text, tag(F.concat(F.lit("\n the "), word, F.lit(". ")))))
        .when(k == 3, F.concat(text, F.lit("<answer>"), word)).otherwise(F.concat(text, tag(F.lit(""))))
    )
    other = [F.lit(x) for x in ("two", "2", "none", "a")]
    golds = F.when(F.col("turn") % 4 == 1, F.array(word)).otherwise(F.array(word, F.upper(word), *other, word, *other[:3]))
    return rows.select("conv_id", "turn", F.coalesce("question", F.lit("")).alias("question"), raw.alias("raw"), golds.alias("golds"), F.element_at(F.array(*map(F.lit, DATASETS)), (F.col("conv_id") % 4 + 1).cast("int")).alias("dataset"))


COMPLETIONS = r"""
turns AS (
  SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations),
worded AS (SELECT *, regexp_extract(text, '[A-Za-z]+') AS word FROM turns WHERE role = 'assistant'),
completions AS (
  SELECT conv_id, turn, coalesce(question, '') AS question,
    CASE conv_id % 5 WHEN 0 THEN ' ' || chr(10) || text WHEN 1 THEN text || '<answer>' || word || 's</answer>'
      WHEN 2 THEN '<answer>no</answer>' || text || '<answer>' || chr(10) || ' the ' || word || '. </answer>'
      WHEN 3 THEN text || '<answer>' || word ELSE text || '<answer></answer>' END AS raw,
    CASE WHEN turn % 4 = 1 THEN [word] ELSE [word, upper(word), 'two', '2', 'none', 'a', word, 'two', '2', 'none'] END AS golds,
    ['vqav2', 'gqa', 'clevr', 'textvqa'][conv_id % 4 + 1] AS dataset
  FROM worded)"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, position, question, answer_type, dataset): documents as examples; half of the sources without a type."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("qid"), F.col("doc_id").alias("position"), F.col("text").alias("question"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("answer_type"), F.element_at(F.array(*map(F.lit, DATASETS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("dataset"),
    )


EXAMPLES = r"""
examples AS (
  SELECT CAST(doc_id AS VARCHAR) AS qid, doc_id AS position, text AS question,
    CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS answer_type, ['vqav2', 'gqa', 'clevr', 'textvqa'][doc_id % 4 + 1] AS dataset
  FROM documents)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, qid, prediction, raw, score): labelled documents as predictions of six runs."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    raw = F.col("text")
    return rows.select(
        (F.col("doc_id") % 6).cast("string").alias("run_id"), F.col("doc_id").cast("string").alias("qid"),
        F.when(F.col("doc_id") % 7 == 0, " ").otherwise(raw).alias("prediction"), raw.alias("raw"),
        (F.col("quality") * (F.col("doc_id") % 3 == 0).cast("int")).cast("double").alias("score"), (F.col("toxic") == 0).alias("verdict"),
    )


PREDICTIONS = r"""
predictions AS (
  SELECT CAST(l.doc_id % 6 AS VARCHAR) AS run_id, CAST(l.doc_id AS VARCHAR) AS qid,
    CASE WHEN l.doc_id % 7 = 0 THEN ' ' ELSE text END AS prediction, text AS raw, CAST(quality * (CASE WHEN l.doc_id % 3 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS score, toxic = 0 AS verdict
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, dataset, overall): events as results."""
    events = table(spark, sf_dir, "events")
    cents = F.sum((F.round(F.col("value") * 100, 0)).cast("long"))
    return events.groupBy(F.concat(F.lit("run"), (F.col("user_id") % 6).cast("string")).alias("run"), F.col("event_type").alias("dataset")).agg((F.floor(cents / F.count("*")).cast("long") % 10000 / F.lit(10000.0)).alias("overall"))


RUN_RESULTS = """
results AS (
  SELECT 'run' || CAST(user_id % 6 AS VARCHAR) AS run, event_type AS dataset,
    (CAST(floor(sum(CAST(round(value * 100, 0) AS BIGINT)) / count(*)) AS BIGINT) % 10000) / 10000.0 AS overall
  FROM events GROUP BY ALL)"""
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
