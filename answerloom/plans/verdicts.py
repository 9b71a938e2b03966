"""Queries on judging: keys, requests, the cache, the budget, studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions.metrics import score
from answerloom.functions.tables import PROMPT_JUDGE
from answerloom.functions.text import strict_answer
from answerloom.operators import batches, judge, runs, tables
from answerloom.plans import duck
from answerloom.plans.answers import SCORED
from answerloom.plans.inputs import COMPLETIONS, PREDICTIONS, completions, predictions, table
from answerloom.plans.registry import query
from answerloom.plans.service import FolderService
from answerloom.sources.scratch import materialize, new_path

MODEL = "judge-1"
ITEMS = rf"""items AS (SELECT conv_id * 100 + turn AS pos, *, sha256(array_to_string(list_concat(list_concat(['{MODEL}', question], list_sort(golds)), [{duck.normalize("coalesce(answer, '')")}]), '|')) AS key FROM rewarded)"""
#: The cache: verdicts of the keys that begin with a letter.
CACHE = "cache AS (SELECT key, max(CASE WHEN pos % 2 = 0 THEN 1 ELSE 0 END) AS verdict, 0.001::DOUBLE AS cost_usd FROM items WHERE key >= 'a' GROUP BY key)"
BASE = f"WITH {COMPLETIONS}, {SCORED}, {ITEMS}, {CACHE}"


def items(spark, sf_dir):
    rows = completions(spark, sf_dir)
    answer = strict_answer(F.col("raw"))
    rows = rows.withColumn("answer", answer).withColumn("pos", F.col("conv_id") * 100 + F.col("turn"))
    base = F.when(F.col("answer").isNull(), 0.0).otherwise(score(F.col("dataset"), F.coalesce("answer", F.lit("")), F.col("golds")))
    return rows.withColumn("correctness", base).withColumn("key", judge.judge_key(MODEL, F.col("question"), F.col("golds"), F.coalesce("answer", F.lit(""))))


def cache(rows):
    known = rows.where("key >= 'a'").groupBy("key").agg(F.max((F.col("pos") % 2 == 0).cast("int")).alias("verdict"))
    return known.select("key", "verdict", F.lit(0.001).alias("cost_usd"), F.lit(0.0).alias("created"))


@query(f"{BASE} SELECT pos, key FROM items")
def judge_key(spark, sf_dir):
    return items(spark, sf_dir).select("pos", "key")


@query(f"WITH {COMPLETIONS} SELECT conv_id, turn, '{MODEL}' AS model, 8 AS max_tokens, 0.0::DOUBLE AS temperature, 'user' AS role, {duck.filled(PROMPT_JUDGE, question='question', golds="array_to_string(golds, '; ')", prediction='raw')} AS prompt FROM completions")
def judge_request(spark, sf_dir):
    asked = completions(spark, sf_dir).select("conv_id", "turn", judge.request(MODEL, F.col("question"), F.col("golds"), F.col("raw")).alias("r"))
    message = F.col("r.messages")[0]
    return asked.select("conv_id", "turn", "r.model", "r.max_tokens", "r.temperature", message["role"].alias("role"), message["content"].alias("prompt"))


@query(f"{BASE} SELECT pos, answer IS NOT NULL AND answer <> '' AND correctness = 0 AS judged FROM items")
def judge_gate(spark, sf_dir):
    return items(spark, sf_dir).select("pos", judge.needs_judge(F.col("correctness"), F.col("answer")).alias("judged"))


@query(f"{BASE} SELECT pos, i.key, coalesce(c.verdict, -1) AS verdict FROM items i LEFT JOIN cache c ON i.key = c.key")
def judge_cache_lookup(spark, sf_dir):
    rows = items(spark, sf_dir)
    return rows.join(cache(rows).select("key", "verdict"), "key", "left").select("pos", "key", F.coalesce("verdict", F.lit(-1)).alias("verdict"))


@query(f"{BASE} SELECT min(pos) AS pos, key FROM items WHERE key NOT IN (SELECT key FROM cache) GROUP BY key")
def judge_todo_dedup(spark, sf_dir):
    rows = items(spark, sf_dir)
    return judge.unanswered(rows, cache(rows)).select("pos", "key")


@query(
    f"""{BASE}, todo AS (SELECT min(pos) AS pos, key FROM items WHERE key NOT IN (SELECT key FROM cache) GROUP BY key),
answered AS (SELECT key, pos % 5 < 2 AS verdict FROM todo WHERE pos % 7 > 0 UNION ALL SELECT key, verdict = 1 FROM cache)
SELECT i.pos, coalesce(a.verdict, FALSE) AS verdict FROM items i LEFT JOIN answered a ON i.key = a.key"""
)
def judge_batch(spark, sf_dir):
    def provider(todo):  # answers most requests by their position
        return todo.where("pos % 7 > 0").select("key", (F.col("pos") % 5 < 2).alias("verdict"), F.lit(0.0005).alias("cost_usd"))

    rows = items(spark, sf_dir)
    answered, _ = judge.judge_many(rows, cache(rows), provider, budget=1e9)
    return answered.select("pos", "verdict")


@query("SELECT CAST(coalesce(sum(cost), 0) AS BIGINT) AS spend FROM (SELECT CAST(round(((doc_id % 500) * 1.0 + 5 * 5.0) / 1e6 * 1e9) AS BIGINT) AS cost FROM labels)")
def judge_spend(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((judge.cost(F.col("doc_id") % 500, F.lit(5)) * 1e9).alias("c"))
    return judge.spend(rows.select(F.round("c").cast("long").alias("cost_usd"))).select(F.col("spend").cast("long").alias("spend"))


#: Eligible rows; the judge says yes to keys whose first character has an odd code, unless the cache knows better, and has
#: no answer, for nothing, where the fifth character is one of ``fails``.
REWARD = f"""{BASE}, elig AS (
  SELECT pos, i.key, correctness AS base, answer IS NOT NULL AND answer <> '' AND correctness = 0 AS eligible, c.key IS NOT NULL AS cached,
    c.key IS NULL AND contains('FAILS', substr(i.key, 5, 1)) AS failed, coalesce(c.verdict = 1, ascii(i.key) % 2 = 1) AS said
  FROM items i LEFT JOIN cache c ON c.key = i.key),
verdicts AS (SELECT *, said AND NOT failed AS verdict FROM elig),
asks AS (SELECT *, eligible AND NOT cached AND row_number() OVER (PARTITION BY key, eligible ORDER BY pos) = 1 AS asks FROM verdicts),
spent AS (SELECT *, coalesce(sum(CASE WHEN asks AND NOT failed THEN 0.25::DOUBLE ELSE 0 END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (SELECT coalesce(sum(cost_usd), 0) FROM cache) AS before FROM asks)"""
FAILS = "02468"


def capped(budget: float, fails: str = "") -> str:
    return f"""{REWARD.replace("FAILS", fails)}, stops AS (SELECT *, min(CASE WHEN asks AND before >= {budget} THEN pos END) OVER () AS stop FROM spent)
SELECT pos, CASE WHEN eligible AND (stop IS NULL OR pos < stop) THEN CAST(verdict AS DOUBLE) ELSE CAST(base AS DOUBLE) END AS reward FROM stops"""


def says(key):
    return F.ascii(key) % 2 == 1


def answering(fails: str = ""):
    def provider(todo):  # costs a quarter for each answer; some keys have none
        return todo.where(~F.instr(F.lit(fails), F.substring("key", 5, 1)).cast("boolean") if fails else F.lit(True)).select("key", says(F.col("key")).alias("verdict"), F.lit(0.25).alias("cost_usd"))

    return provider


def reward_rows(spark, sf_dir):
    return materialize(items(spark, sf_dir).select("pos", "key", F.col("correctness").alias("base"), "answer"))


def judged_rewards(spark, sf_dir, budget: float, fails: str = ""):
    rows = reward_rows(spark, sf_dir)
    return judge.judge_rewards(rows, cache(rows), answering(fails), budget=budget, price=0.5)[0].select("pos", "reward")


@query(capped(1e9))
def judge_rescue_reward(spark, sf_dir):
    return judged_rewards(spark, sf_dir, 1e9)


@query(capped(3.0))
def judge_reward_capped(spark, sf_dir):
    return judged_rewards(spark, sf_dir, 3.0)


@query(capped(3.0, FAILS))
def judge_reward_with_failures(spark, sf_dir):
    """Some requests have no answer: they count as no, and cost nothing."""
    return judged_rewards(spark, sf_dir, 3.0, FAILS)


@query(f"""{BASE}, gone AS (SELECT DISTINCT i.key FROM items i LEFT JOIN cache c ON c.key = i.key WHERE c.key IS NULL AND answer <> '' AND correctness = 0 AND contains('{FAILS}', substr(i.key, 5, 1)))
SELECT key, CASE WHEN key IN (SELECT key FROM gone) THEN 'asked again' ELSE 'known' END AS state FROM items WHERE answer IS NOT NULL AND answer <> '' AND correctness = 0 GROUP BY key""")
def judge_failures_asked_again(spark, sf_dir):
    """What had no answer isn't cached: judging the same rows once more asks exactly those keys."""
    rows = reward_rows(spark, sf_dir)
    _, known = judge.judge_rewards(rows, cache(rows), answering(FAILS), budget=1e9, price=0.5)
    eligible = rows.where(judge.needs_judge(F.col("base"), F.col("answer"))).select("key").distinct()
    again = judge.unanswered(rows.where(judge.needs_judge(F.col("base"), F.col("answer"))), known).select("key")
    return tables.marked(eligible, again, "key", "again").select("key", F.when(F.col("again"), "asked again").otherwise("known").alias("state"))


@query(capped(3.0))
def judge_reward_in_batches(spark, sf_dir):
    """Three batches of rows, with a ledger: what one call over all of them gives."""
    rows = reward_rows(spark, sf_dir)
    path, known, out = new_path(spark), cache(rows), []
    third = rows.agg((F.max("pos") + 3) / 3).first()[0]
    for k in range(3):
        some = rows.where((F.floor(F.col("pos") / third)) == k)
        rewarded, known = judge.judge_rewards(some, known, answering(), 3.0, 0.5, ledger=judge.Ledger(spark, path), batch=str(k))
        out.append(rewarded.select("pos", "reward"))
        known = materialize(known)
    return tables.union_subsets(*out)


@query(capped(2.0))
def judge_budget_cutoff(spark, sf_dir):
    rows = materialize(items(spark, sf_dir).select("pos", "key", F.col("correctness").alias("base"), judge.needs_judge(F.col("correctness"), F.col("answer")).alias("eligible")))
    known = cache(rows)
    verdict = F.coalesce(F.col("known") == 1, says(F.col("key")))
    judged = rows.join(known.select("key", F.col("verdict").alias("known")), "key", "left").withColumn("verdict", verdict).withColumn("cost_usd", F.lit(0.25))
    return judge.budget_rewards(judged, known, budget=2.0).select("pos", "reward")


@query(
    f"""WITH {PREDICTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, score > 0 ORDER BY md5('0:' || qid), qid) AS k FROM predictions WHERE score > 0 OR trim(prediction) <> ''),
s AS (SELECT run_id, verdict, score > 0 AS control FROM r WHERE (score > 0 AND k <= 10) OR (score = 0 AND k <= 40)),
o AS (SELECT run_id, sum(score) / count(*) AS overall, count_if(score = 0 AND trim(prediction) <> '') / count(*) AS share FROM predictions GROUP BY run_id),
j AS (SELECT run_id, CAST(count_if(NOT control) AS INT) AS n, coalesce(avg(CASE WHEN NOT control THEN CAST(verdict AS INT) END), 0) AS rescue, coalesce(avg(CASE WHEN control THEN CAST(verdict AS INT) END), 1) AS agree FROM s GROUP BY run_id)
SELECT run_id, round_even(overall, 4) AS em_accuracy, n AS sampled_misses, round_even(rescue, 4) AS judge_rescue_rate, round_even(overall + share * rescue, 4) AS judge_corrected_accuracy, round_even(agree, 4) AS control_agreement_on_em_hits FROM o JOIN j USING (run_id)"""
)
def judge_study_corrected(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    overall = rows.groupBy("run_id").agg((F.sum("score") / F.count("*")).alias("overall"))
    return runs.study(rows, runs.study_sample(rows, ["run_id"], 40), overall, ["run_id"])


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 9 ELSE quality END AS quality FROM labels UNION ALL SELECT -1 - doc_id, 9 FROM labels WHERE toxic = 1")
def upsert_latest(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    touched = labels.where("toxic = 1").select("doc_id", F.explode(F.array(F.lit(8), F.lit(9))).alias("quality"))  # twice each: the later counts
    new = touched.unionByName(touched.withColumn("doc_id", -1 - F.col("doc_id")))
    return tables.upsert(labels.select("doc_id", "quality"), new, ["doc_id"], F.col("quality"))


@query(
    f"""{BASE}, r AS (SELECT DISTINCT key FROM items)
SELECT key, ascii(substr(key, 1, 1)) % 2 = 0 AS verdict, round((100 * 1.0 + 2 * 5.0) / 1e6 * 0.5, 9)::DOUBLE AS cost_usd FROM r WHERE ascii(substr(key, 2, 1)) % 5 > 0"""
)
def judge_batch_results(spark, sf_dir):
    requests = items(spark, sf_dir).select("key").distinct()
    reply = F.when(F.ascii("key") % 2 == 0, " YES.").otherwise("no")
    message = F.struct(F.array(F.struct(F.lit("text").alias("type"), reply.alias("text"))).alias("content"), F.struct(F.lit(100).alias("input_tokens"), F.lit(2).alias("output_tokens")).alias("usage"))
    kind = F.when(F.ascii(F.substring("key", 2, 1)) % 5 > 0, "succeeded").otherwise("errored")
    results = requests.select(F.substring("key", 1, 60).alias("custom_id"), F.struct(kind.alias("type"), message.alias("message")).alias("result"))
    return judge.batch_results(requests, results).withColumn("cost_usd", F.round("cost_usd", 9))


@query(
    f"""{BASE}, r AS (SELECT DISTINCT i.key, question, golds, raw FROM items i LEFT JOIN cache c ON c.key = i.key WHERE c.key IS NULL),
u AS (SELECT key, {duck.filled(PROMPT_JUDGE, question='question', golds="array_to_string(golds, '; ')", prediction='raw')} AS prompt FROM r)
SELECT key, ascii(key) % 2 = 1 AS verdict, round((length(prompt) * 1.0 + 2 * 5.0) / 1e6 * 0.5, 9)::DOUBLE AS cost_usd FROM u WHERE NOT contains('{FAILS}', substr(key, 5, 1))"""
)
def judge_batch_job(spark, sf_dir):
    """A batch job of several claims, begun twice: the second run hands in nothing."""
    rows = items(spark, sf_dir)
    todo = judge.unanswered(rows.select("key", "pos", judge.request(MODEL, F.col("question"), F.col("golds"), F.col("raw")).alias("request")), cache(rows))
    folder, service = new_path(spark, "job"), FolderService(new_path(spark, "service"), FAILS)
    for _ in range(2):
        got = batches.run(todo, service, folder, "job", size=50, poll_seconds=0.1)
    return got.withColumn("cost_usd", F.round("cost_usd", 9))
