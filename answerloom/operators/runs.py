"""Evaluation runs: scoring predictions, run records, pivots, deltas, retention, studies of the judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.functions.metrics import fraction, value
from answerloom.functions.tables import DELTA_ABOVE, DELTA_BELOW, DELTA_NONE
from answerloom.functions.text import extract_answer, fixed, remove_suffix, signed, strip
from answerloom.operators.splits import sample_rows
from answerloom.schemas import RUN


def kind(answer_type: Column) -> Column:
    """The answer type, or ``all`` where it is empty or missing."""
    return F.coalesce(F.nullif(answer_type, F.lit("")), F.lit("all"))


def rescore(predictions: DataFrame, dataset: Column) -> DataFrame:
    """Predictions and scores found anew from ``raw``; the score also as a fraction (``num``, ``den``)."""
    again = predictions.withColumn("prediction", extract_answer(F.col("raw"))).withColumn("_f", fraction(dataset, F.col("prediction"), F.col("answers")))
    return again.withColumn("score", value(F.col("_f"))).withColumn("num", F.col("_f.num")).withColumn("den", F.col("_f.den")).drop("_f")


def mean_score(num: str = "num", den: str = "den") -> Column:
    """The mean of fractions, the same in any order of rows: denominators of panels of 1 to 10 divide 7560, and such
    fractions are added as whole 7560ths; others are added as doubles."""
    exact = F.sum(F.when(F.lit(7560) % F.col(den) == 0, F.col(num) * (F.lit(7560) / F.col(den)).cast("long")))
    rest = F.sum(F.when(F.lit(7560) % F.col(den) != 0, F.col(num) / F.col(den)))
    return (F.coalesce(exact, F.lit(0)) / F.lit(7560.0) + F.coalesce(rest, F.lit(0.0))) / F.count("*")


def by_answer_type(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by, kind(F.col("answer_type")).alias("answer_type")).agg(F.count("*").alias("n"), mean_score().alias("score"))


def with_answer_type(predictions: DataFrame, subset: DataFrame) -> DataFrame:
    """Predictions with their example's answer type; ids that the subset lacks have an empty one."""
    types = subset.groupBy("qid").agg(F.max("answer_type").alias("answer_type"))
    return predictions.join(types, "qid", "left").withColumn("answer_type", F.coalesce("answer_type", F.lit("")))


def run_records(scored: DataFrame, run: list[str]) -> DataFrame:
    """One row for each run: ``n``, ``metrics`` (overall, by_answer_type with sorted keys)."""
    per_type = by_answer_type(scored, *run).groupBy(*run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("answer_type", "score")))).alias("by_answer_type"))
    overall = scored.groupBy(*run).agg(F.count("*").alias("n"), mean_score().alias("overall"))
    return overall.join(per_type, run).select(*run, "n", F.struct("overall", "by_answer_type").alias("metrics"))


def run_documents(records: DataFrame, run_id: str, dataset: str, **fixed: Column) -> DataFrame:
    """Run records in the declared schema, RUN, from ``run_records``: ``run_id`` names the run, to which the data set
    (a column of the records) is added. ``fixed``: all fields of the schema but the counts and metrics, by name with
    ``__`` for a dot (``model__base``, ``gen__max_tokens``, ...); those not given are null."""
    given = {"run_id": F.concat_ws("-", F.lit(run_id), F.col(dataset)), "eval__dataset": F.col(dataset), "eval__n": F.col("n"), "metrics": F.col("metrics")} | fixed

    def value(field, path: str) -> Column:
        if path in given:
            return given[path].cast(field.dataType).alias(field.name)
        if hasattr(field.dataType, "fields"):
            return F.struct(*[value(f, f"{path}__{f.name}") for f in field.dataType.fields]).alias(field.name)
        return F.lit(None).cast(field.dataType).alias(field.name)

    schema = records.sparkSession.createDataFrame([], RUN).schema
    return records.select(*[value(f, f.name) for f in schema.fields])


def results_by_dataset(runs: DataFrame, datasets: list[str]) -> DataFrame:
    """(run, one column for each data set) from run records (run_id, dataset, overall, file); the last file wins, and a
    run id loses its ``-dataset`` end."""
    named = runs.withColumn("run", remove_suffix(F.col("run_id"), F.concat(F.lit("-"), F.col("dataset"))))
    return named.groupBy("run").pivot("dataset", datasets).agg(F.max_by("overall", "file"))


def deltas(results: DataFrame, baseline: str) -> DataFrame:
    """(run, dataset, overall) with ``delta`` in points against the baseline run, unrounded, and ``rounded_delta``, of
    both rounded to a tenth of a point first, as the dashboard shows it."""
    w = Window.partitionBy("dataset")
    base = F.max(F.when(F.col("run") == baseline, F.col("overall"))).over(w)
    tenth = lambda x: F.bround(x * 100, 1)
    return results.withColumn("delta", (F.col("overall") - base) * 100).withColumn("rounded_delta", F.bround(tenth(F.col("overall")) - tenth(base), 1))


def largest_delta(results: DataFrame, baseline: str, entries: DataFrame, datasets: list[str]) -> DataFrame:
    """(most): the largest difference in points, without its sign, of a report's ``entries`` (run) from the baseline on any
    of ``datasets``; a result that isn't there counts 0, on either side. The grid is the report's own, a few rows."""
    points = results.select("run", "dataset", F.bround(F.col("overall") * 100, 1).alias("points"))
    grid = entries.select("run", F.explode(F.array(*map(F.lit, datasets))).alias("dataset")).join(points, ["run", "dataset"], "left")
    base = points.where(F.col("run") == baseline).select("dataset", F.col("points").alias("base"))
    apart = F.coalesce("points", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))
    return grid.join(base, "dataset", "left").agg(F.max(F.abs(F.bround(apart, 1))).alias("most"))


def cell(overall: Column, delta: Column) -> Column:
    """A report's cell: points, and the signed delta in brackets where there is one; null without a value."""
    return F.concat(fixed(overall * 100, 1), F.coalesce(F.concat(F.lit(" ("), signed(delta, 1), F.lit(")")), F.lit("")))


def best_cells(results: DataFrame) -> DataFrame:
    """(run, dataset, overall) with ``best``: whether no run has more; an absent value counts 0."""
    value = F.coalesce("overall", F.lit(0.0))
    return results.withColumn("best", value == F.max(value).over(Window.partitionBy("dataset")))


def report_order(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Report rows (ordinal, label, run) with their results; absent runs stay, empty."""
    return entries.join(results, "run", "left")


def retention(predictions: DataFrame, *by: str, longer_than: int = 100) -> DataFrame:
    """Share of raw outputs over some length, and the median length."""
    n = F.length("raw")
    return predictions.groupBy(*by).agg(F.avg((n > longer_than).cast("double")).alias("share"), F.percentile(n, F.lit(0.5)).alias("median"))


def is_miss() -> Column:
    return (F.col("score") == 0) & (strip(F.col("prediction")) != "")


def study_sample(predictions: DataFrame, by: list[str], size: int, seed: int = 0) -> DataFrame:
    """At most ``size`` misses and ``size // 4`` hits of each run, with ``is_control``."""
    misses = sample_rows(predictions.where(is_miss()), by, "qid", seed, F.lit(size)).withColumn("is_control", F.lit(False))
    hits = sample_rows(predictions.where(F.col("score") > 0), by, "qid", seed, F.lit(size // 4)).withColumn("is_control", F.lit(True))
    return misses.unionByName(hits)


def study(predictions: DataFrame, judged: DataFrame, overall: DataFrame, by: list[str]) -> DataFrame:
    """A row for each run from its predictions, its judged sample (``verdict``, ``is_control``) and its stored overall."""
    share = predictions.groupBy(*by).agg((F.count_if(is_miss()) / F.count("*")).alias("_share"))
    verdict = F.col("verdict").cast("double")
    rates = judged.groupBy(*by).agg(
        F.count_if(~F.col("is_control")).cast("int").alias("sampled_misses"),
        F.coalesce(F.avg(F.when(~F.col("is_control"), verdict)), F.lit(0.0)).alias("_rescue"),
        F.coalesce(F.avg(F.when(F.col("is_control"), verdict)), F.lit(1.0)).alias("_agree"),
    )
    joined = overall.join(share, by).join(rates, by, "left").fillna({"sampled_misses": 0, "_rescue": 0.0, "_agree": 1.0})
    return joined.select(
        *by, F.bround("overall", 4).alias("em_accuracy"), "sampled_misses", F.bround("_rescue", 4).alias("judge_rescue_rate"),
        F.bround(F.col("overall") + F.col("_share") * F.col("_rescue"), 4).alias("judge_corrected_accuracy"),
        F.bround("_agree", 4).alias("control_agreement_on_em_hits"),
    )


def advantages(rewards: DataFrame, group: str) -> DataFrame:
    """Rewards relative to their group: less its mean, over its standard deviation (0 where that is 0 or undefined).

    Mean and spread are aggregated and joined back, so a large group is never in one task."""
    spread = rewards.groupBy(group).agg(F.avg("reward").alias("_mean"), F.stddev_samp("reward").alias("_spread"))
    joined = rewards.join(spread.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.withColumn("advantage", F.when(F.col("_spread") > 0, (F.col("reward") - F.col("_mean")) / F.col("_spread")).otherwise(0.0)).drop("_mean", "_spread", "_group")


def discover(runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """The runs (run_id) that have a predictions file (file), named by the file's stem."""
    stems = predictions.select(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("run_id")).distinct()
    return runs.join(stems, "run_id", "left_semi")


def results_payload(results: DataFrame) -> DataFrame:
    """(run, dataset, overall) as one JSON object for each run, in percent with one decimal, by data set in order."""
    percent = F.struct("dataset", F.bround(F.col("overall") * 100, 1).alias("value"))
    return results.groupBy("run").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(percent)))).alias("payload"))


def delta_colour(delta: Column, most: Column) -> Column:
    """A diverging colour: from that of no delta towards that of one above or below, by its share of the largest; where the
    largest is 0 that of no delta."""
    share = F.least(F.coalesce(F.try_divide(F.abs(delta), most), F.lit(0.0)), F.lit(1.0))
    towards = lambda a, b: F.when(delta >= 0, F.lit(b)).otherwise(F.lit(a))
    # halves are rounded up, below zero too
    each = [F.floor(F.lit(mid) + (towards(low, high) - mid) * share + 0.5).cast("int") for mid, low, high in zip(DELTA_NONE, DELTA_BELOW, DELTA_ABOVE, strict=True)]
    return F.format_string("rgb(%d,%d,%d)", *each)


def elapsed(started_ms: Column, finished_ms: Column) -> Column:
    """Seconds with one decimal."""
    return fixed((finished_ms - started_ms) / F.lit(1000.0), 1)


def stamp(at: Column) -> Column:
    """A UTC time as ISO-8601 text, to seconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx")
