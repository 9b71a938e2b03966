"""Queries on results: pivots, deltas, best cells, retention, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions.tables import DELTA_ABOVE, DELTA_BELOW, DELTA_NONE
from answerloom.functions.text import remove_suffix
from answerloom.operators import runs, splits, tables
from answerloom.plans.inputs import EVENT_TYPES, PREDICTIONS, RUN_RESULTS, predictions, run_results, table
from answerloom.plans.registry import query
from answerloom.sources import files
from answerloom.streaming import tokens


@query(f"WITH {RUN_RESULTS} SELECT run, {', '.join(f"max(CASE WHEN dataset = '{e}' THEN overall END) AS \"{e}\"" for e in EVENT_TYPES)} FROM results GROUP BY run")
def run_pivot(spark, sf_dir):
    rows = run_results(spark, sf_dir).withColumn("run_id", F.concat_ws("-", "run", "dataset")).withColumn("file", F.col("run_id"))
    return runs.results_by_dataset(rows.select("run_id", "dataset", "overall", "file"), EVENT_TYPES)


DELTAS = f"WITH {RUN_RESULTS}, b AS (SELECT dataset, overall AS base FROM results WHERE run = 'run0'), d AS (SELECT r.*, base FROM results r LEFT JOIN b USING (dataset))"


@query(f"{DELTAS} SELECT run, dataset, round((overall - base) * 100, 6) AS delta FROM d")
def delta_vs_baseline_unrounded(spark, sf_dir):
    return runs.deltas(run_results(spark, sf_dir), "run0").select("run", "dataset", F.round("delta", 6).alias("delta"))


@query(f"{DELTAS} SELECT run, dataset, round_even(round_even(overall * 100, 1) - round_even(base * 100, 1), 1) AS delta FROM d")
def delta_vs_baseline_rounded(spark, sf_dir):
    return runs.deltas(run_results(spark, sf_dir), "run0").select("run", "dataset", F.col("rounded_delta").alias("delta"))


@query(f"WITH {RUN_RESULTS} SELECT run, dataset, overall, coalesce(overall, 0) = max(coalesce(overall, 0)) OVER (PARTITION BY dataset) AS best FROM results")
def best_cell(spark, sf_dir):
    return runs.best_cells(run_results(spark, sf_dir))


@query(
    f"""WITH {RUN_RESULTS}, there AS (SELECT * FROM results WHERE NOT (run = 'run3' AND dataset = 'view') AND NOT (run = 'run0' AND dataset = 'signup')),
grid AS (SELECT * FROM (VALUES ('run1'), ('run2'), ('run3'), ('run9')) e(run), (SELECT DISTINCT dataset FROM results))
SELECT max(abs(round_even(coalesce(round_even(t.overall * 100, 1), 0) - coalesce(round_even(b.overall * 100, 1), 0), 1))) AS most
FROM grid g LEFT JOIN there t ON t.run = g.run AND t.dataset = g.dataset LEFT JOIN there b ON b.run = 'run0' AND b.dataset = g.dataset"""
)
def max_abs_delta(spark, sf_dir):
    """With a result, one of the baseline, and a whole run missing."""
    gone = ((F.col("run") == "run3") & (F.col("dataset") == "view")) | ((F.col("run") == "run0") & (F.col("dataset") == "signup"))
    entries = spark.createDataFrame([("run1",), ("run2",), ("run3",), ("run9",)], "run string")
    return runs.largest_delta(run_results(spark, sf_dir).where(~gone), "run0", entries, EVENT_TYPES)


@query(
    f"""{DELTAS}, e(ordinal, label, run) AS (VALUES (1, 'first', 'run0'), (2, 'absent', 'run9'), (3, 'last', 'run5')),
c AS (SELECT run, dataset, printf('%.1f', overall * 100) || coalesce(' (' || printf('%+.1f', (overall - base) * 100) || ')', '') AS cell FROM d),
p AS (SELECT run, {', '.join(f"max(CASE WHEN dataset = '{e}' THEN cell END) AS \"{e}\"" for e in EVENT_TYPES)} FROM c GROUP BY run)
SELECT ordinal, '| ' || label || ' | ' || {" || ' | ' || ".join(f"coalesce(\"{e}\", '—')" for e in EVENT_TYPES)} || ' |' AS line FROM e LEFT JOIN p USING (run)"""
)
def markdown_report(spark, sf_dir):
    entries = spark.createDataFrame([(1, "first", "run0"), (2, "absent", "run9"), (3, "last", "run5")], "ordinal int, label string, run string")
    cells = runs.deltas(run_results(spark, sf_dir), "run0").withColumn("cell", runs.cell(F.col("overall"), F.col("delta")))
    results = cells.groupBy("run").pivot("dataset", EVENT_TYPES).agg(F.first("cell"))
    ordered = runs.report_order(F.broadcast(entries), results)  # the report's own few rows
    return ordered.select("ordinal", files.markdown_rows(F.col("label"), [F.col(e) for e in EVENT_TYPES]).alias("line"))


@query(f"""WITH {RUN_RESULTS} SELECT run, '{{' || string_agg('"' || dataset || '":' || CAST(round_even(overall * 100, 1) AS VARCHAR), ',' ORDER BY dataset) || '}}' AS payload FROM results GROUP BY run""")
def results_api(spark, sf_dir):
    return runs.results_payload(run_results(spark, sf_dir))


@query("SELECT event_id, printf('%.1f', (1000 + floor(value * 37) - 1000) / 1000.0::DOUBLE) AS seconds FROM events")
def elapsed_seconds(spark, sf_dir):
    finished = F.lit(1000) + F.floor(F.col("value") * 37)
    return table(spark, sf_dir, "events").select("event_id", runs.elapsed(F.lit(1000), finished).alias("seconds"))


@query(f"WITH {PREDICTIONS} SELECT run_id, avg(CASE WHEN length(raw) > 100 THEN 1.0::DOUBLE ELSE 0 END) AS share, quantile_cont(CAST(length(raw) AS DOUBLE), 0.5) AS median FROM predictions GROUP BY run_id")
def reasoning_retention(spark, sf_dir):
    return runs.retention(predictions(spark, sf_dir), "run_id")


@query("SELECT event_type AS model, string_agg(event_type || CAST(event_id AS VARCHAR), '' ORDER BY ts, event_id) AS text, TRUE AS done FROM events GROUP BY event_type")
def token_stream_concat(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stream = events.select(F.col("event_type").alias("model"), F.concat("event_type", F.col("event_id").cast("string")).alias("token"), F.struct("ts", "event_id").alias("seq"), F.lit(True).alias("done"))
    return tokens.texts(stream)


@query("SELECT k, (SELECT count(DISTINCT event_type) FROM events WHERE length(event_type) > 5) >= k AS all_done FROM range(1, 6) t(k)")
def stream_completion(spark, sf_dir):
    """Whether one to five models are done, where only those with long names ever are."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.length("event_type") > 5).alias("done"))
    n = events.where("done").agg(F.count_distinct("model").alias("n"))
    return n.select("n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("k")).select("k", (F.col("n") >= F.col("k")).alias("all_done"))


@query("SELECT event_type AS model, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def stream_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), "event_id")
    merged = tokens.interleaved(*[events.where(F.col("model") == m) for m in EVENT_TYPES])
    return merged.groupBy("model").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query(
    """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['click', ''] WHEN 1 THEN [] ELSE ['view', 'error'] END AS m FROM events), k AS (SELECT DISTINCT event_type AS model FROM events)
SELECT event_id, model FROM r, k WHERE len(list_filter(m, lambda x: x <> '')) = 0 OR list_contains(m, model)"""
)
def request_fan_out(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    wanted = F.when(k == 0, F.array(F.lit("click"), F.lit(""))).when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("view"), F.lit("error")))
    return tokens.fan_out(events.select("event_id", wanted.alias("models")), events.select(F.col("event_type").alias("model")).distinct()).select("event_id", "model")


@query("""SELECT event_type AS model, arg_max(value, event_id) AS value FROM events GROUP BY event_type""")
def last_wins_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "model")
    return tables.last_wins(rows, ["model"], F.col("event_id"), ["value"])


@query("SELECT event_id, CASE WHEN ends_with(k, '-' || event_type) THEN substr(k, 1, length(k) - length(event_type) - 1) ELSE k END AS run FROM (SELECT event_id, event_type, 'u' || CAST(user_id AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '-' || event_type ELSE '' END AS k FROM events)")
def suffix_removal(spark, sf_dir):
    end = F.concat(F.lit("-"), F.col("event_type"))
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, end).otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", remove_suffix(key, end).alias("run"))


@query("""SELECT event_id, '{"m":"' || event_type || '"}|first line' || chr(10) || 'second ' || CAST(user_id AS VARCHAR) || '|no prefix' AS frames FROM events""")
def sse_parse(spark, sf_dir):
    """A body of frames: JSON, several lines with loose space, an empty one, one without a prefix, the end."""
    event = F.concat(F.lit('{"m":"'), F.col("event_type"), F.lit('"}'))
    of_lines = F.concat(F.lit("first line\nsecond "), F.col("user_id").cast("string"), F.lit(" "))
    body = F.concat(files.sse_encode(event), files.sse_encode(of_lines), F.lit("\n\nno prefix\n\n"), files.sse_encode(F.lit("[DONE]")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(files.sse_frames(body), "|").alias("frames"))


@query(
    """WITH l AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderstatus AS left_value FROM orders),
r AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position, o_orderpriority AS right_value FROM orders) SELECT * FROM l JOIN r USING (position)"""
)
def positional_zip(spark, sf_dir):
    """Orders in one order beside orders in another."""
    orders = table(spark, sf_dir, "orders")
    left = splits.with_position(orders.select("o_orderkey", F.col("o_orderstatus").alias("left_value")), [F.col("o_orderkey")]).drop("o_orderkey")
    by_price = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    right = splits.with_position(orders.select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("right_value")), by_price).drop("o_orderkey", "o_totalprice")
    return tables.zip_strict(left, right)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 5000 THEN 'override' ELSE s_name END AS s_name, s_nationkey FROM supplier")
def preset_override(spark, sf_dir):
    presets = table(spark, sf_dir, "supplier")
    overrides = presets.where("s_acctbal < 9000").select("s_suppkey", F.when(F.col("s_acctbal") < 5000, "override").alias("s_name"))
    return tables.with_override(presets.select("s_suppkey", "s_name", "s_nationkey"), overrides, "s_suppkey")


@query("SELECT n_nationkey, n_name, n_nationkey IN (SELECT s_nationkey FROM supplier) AS loaded FROM nation")
def listing_with_flag(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return tables.marked(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), keys, "n_nationkey", "loaded")


@query("SELECT CAST(doc_id AS VARCHAR) AS run_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def run_discovery(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("run_id"))
    files_of = table(spark, sf_dir, "labels").select(F.concat(F.lit("/preds/"), F.col("doc_id").cast("string"), F.lit(".jsonl")).alias("file"))
    return runs.discover(docs, files_of)


def channel(k: int) -> str:
    mid, low, high = DELTA_NONE[k], DELTA_BELOW[k], DELTA_ABOVE[k]
    return f"CAST(CAST(floor({mid} + (CASE WHEN d >= 0 THEN {high - mid} ELSE {low - mid} END) * s + 0.5::DOUBLE) AS INT) AS VARCHAR)"


@query(f"""{DELTAS}, x AS (SELECT run, dataset, round_even(round_even(overall * 100, 1) - round_even(base * 100, 1), 1) AS d FROM d), y AS (SELECT *, least(abs(d) / max(abs(d)) OVER (), 1.0::DOUBLE) AS s FROM x)
SELECT run, dataset, 'rgb(' || {" || ',' || ".join(map(channel, range(3)))} || ')' AS colour FROM y""")
def delta_colour(spark, sf_dir):
    rows = runs.deltas(run_results(spark, sf_dir), "run0")
    most = rows.agg(F.max(F.abs("rounded_delta"))).first()[0]  # one number
    return rows.select("run", "dataset", runs.delta_colour(F.col("rounded_delta"), F.lit(most)).alias("colour"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp FROM events")
def iso_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", runs.stamp(F.col("ts")).alias("stamp"))
