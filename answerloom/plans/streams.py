"""Queries that run streams over the tables: ordered deltas, sentinels, frames; and their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.plans.inputs import table
from answerloom.plans.registry import query
from answerloom.sources import files
from answerloom.sources.scratch import new_path
from answerloom.streaming import frames, tokens

#: Events as tokens: a user's events of a type, in order, are a model's tokens of a request; a request has all types, but
#: for those of users divisible by 5, of which the type ``view`` is never done.
TOKENS = """toks AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS request, event_type AS model, event_type || CAST(event_id AS VARCHAR) || ' ' AS token,
    row_number() OVER w - 1 AS seq, row_number() OVER w = count(*) OVER (PARTITION BY user_id, event_type) AND NOT (user_id % 5 = 0 AND event_type = 'view') AS done
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)),
asked AS (SELECT request, CAST(count(DISTINCT model) AS INT) AS models FROM toks GROUP BY request)"""


def token_events(spark, sf_dir):
    """TOKENS with the number of models asked for. Places come from counts of a user's events of a type, which are few."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("model"), "event_id")
    own = Window.partitionBy("user_id", "model")
    placed = events.withColumn("seq", (F.row_number().over(own.orderBy("event_id")) - 1).cast("long")).withColumn("n", F.count("*").over(own))
    never = (F.col("user_id") % 5 == 0) & (F.col("model") == "view")
    asked = events.groupBy("user_id").agg(F.count_distinct("model").cast("int").alias("models"))
    return placed.join(asked, "user_id").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("request"), "model", F.concat("model", F.col("event_id").cast("string"), F.lit(" ")).alias("token"),
        ((F.col("seq") == F.col("n") - 1) & ~never).alias("done"), "seq", "models",
    )


def arriving(spark, sf_dir):
    """Token events as a stream: out of order, over several triggers, some of them twice."""
    path = new_path(spark, "arriving")
    again = F.col("done") | (F.xxhash64("token") % 7 == 0)
    times = F.explode(F.array_repeat(F.lit(True), F.when(again, 2).otherwise(1))).alias("_once")
    token_events(spark, sf_dir).select("*", times).drop("_once").repartition(4).write.parquet(path)
    tokens.with_rocksdb(spark)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)


def ran(stream, write) -> None:
    """Runs a stream over all that is there."""
    spark = stream.sparkSession
    stream.writeStream.outputMode("append").option("checkpointLocation", new_path(spark, "stream")).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


@query(f"WITH {TOKENS} SELECT request, model, string_agg(token, '' ORDER BY seq) AS text, bool_or(done) AS done FROM toks GROUP BY request, model")
def stream_texts(spark, sf_dir):
    """What a stream's deltas, written once a batch, add up to."""
    out = new_path(spark, "deltas")
    ran(tokens.deltas(arriving(spark, sf_dir)), frames.once(out))
    got = spark.read.schema(tokens.DELTA).parquet(out)
    pieces = F.array_sort(F.collect_list(F.struct("first", "text")))
    return got.groupBy("request", "model").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"), F.max("done").alias("done"))


SENTINELS = f"WITH {TOKENS} SELECT t.request, models, '[DONE]' AS data FROM (SELECT request, count(DISTINCT model) AS n FROM toks WHERE done GROUP BY request) t JOIN asked ON asked.request = t.request WHERE n >= models"


@query(SENTINELS)
def stream_sentinels(spark, sf_dir):
    """One sentinel a request, of a stream with repeated and late ends."""
    out = new_path(spark, "sentinels")
    ran(tokens.completed(arriving(spark, sf_dir)), frames.once(out))
    return spark.read.schema(tokens.SENTINEL).parquet(out).select("request", "models", "data")


@query(SENTINELS)
def batch_sentinels(spark, sf_dir):
    return tokens.completions(token_events(spark, sf_dir))


@query(
    """SELECT event_id, '{"id":' || CAST(event_id AS VARCHAR) || ',"text":' || CAST(to_json(event_type || chr(10) || 'é' || CAST(user_id AS VARCHAR)) AS VARCHAR) || '}' AS data FROM events"""
)
def frame_stream(spark, sf_dir):
    """Events as server-sent frames in files, read as a stream, written once a batch, and decoded from what was written."""
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.concat("event_type", F.lit("\né"), F.col("user_id").cast("string")).alias("text")))
    written = new_path(spark, "frames")
    # the text sink ends each row with a second line feed
    frames_of = table(spark, sf_dir, "events").select(F.concat(F.lit("data: "), body, F.lit("\n")).alias("value"))
    frames_of.repartition(4).write.text(written)
    spark.dataSource.register(frames.FrameSource)
    out = new_path(spark, "taken")
    ran(spark.readStream.format("sse_frames").option("path", written).load(), frames.frames_once(out))
    taken = spark.read.schema("frame string").parquet(out).select(F.explode(files.sse_frames(F.col("frame"))).alias("data"))
    return taken.select(F.get_json_object("data", "$.id").cast("long").alias("event_id"), "data")
