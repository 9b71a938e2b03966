"""Verdicts of a judge as tables: keys, requests, costs, the cache, batches, and the sequential budget.

The judge itself is outside: a *provider* maps a DataFrame of requests to one with their verdicts. Spark only decides
what must be asked, asks each thing once, and joins the answers back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.tables import PRICE_IN, PRICE_OUT, PROMPT_JUDGE
from answerloom.functions.text import fill, normalize_answer, strip
from answerloom.operators.splits import with_position, with_running
from answerloom.operators.tables import upsert
from answerloom.schemas import JUDGMENTS
from answerloom.sources.keyed import KeyedTable
from answerloom.sources.scratch import materialize

#: Requests (key, request struct) to (key, verdict boolean, cost_usd double); requests that fail may be missing.
Provider = Callable[[DataFrame], DataFrame]


class BudgetExceeded(Exception):
    """What was spent has reached the cap."""


def judge_key(model: Column | str, question: Column, golds: Column, prediction: Column) -> Column:
    """SHA-256 of model, question, sorted gold answers and normalized prediction, joined by bars; null golds become
    empty, so that no part goes missing."""
    model = F.lit(model) if isinstance(model, str) else model
    parts = F.concat(F.array(model, question), F.array_sort(golds), F.array(normalize_answer(prediction)))
    return F.sha2(F.array_join(parts, "|", ""), 256)


def request(model: str, question: Column, golds: Column, prediction: Column) -> Column:
    prompt = fill(PROMPT_JUDGE, question=question, golds=F.array_join(golds, "; "), prediction=prediction)
    return F.struct(F.lit(model).alias("model"), F.lit(8).alias("max_tokens"), F.lit(0.0).alias("temperature"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"))


def cost(tokens_in: Column, tokens_out: Column, batch: bool = False) -> Column:
    """Dollars of a call; a batch costs half."""
    full = (tokens_in * F.lit(PRICE_IN) + tokens_out * F.lit(PRICE_OUT)) / F.lit(1e6)
    return full * 0.5 if batch else full


def verdict(content: Column) -> Column:
    """Whether the first text block of a reply (array of (type, text)) starts with yes."""
    text = F.get(F.filter(content, lambda b: b["type"] == "text"), F.lit(0))["text"]
    return F.lower(strip(F.coalesce(text, F.lit("")))).startswith("yes")


def needs_judge(base: Column, answer: Column) -> Column:
    """Whether a completion goes to the judge: it has a non-empty strict answer, and the rules give it nothing."""
    return F.coalesce((base == 0) & answer.isNotNull() & (answer != ""), F.lit(False))


def batch_results(requests: DataFrame, results: DataFrame, prefix: int = 60) -> DataFrame:
    """(key, verdict, cost_usd) of a batch's results (custom_id, result struct with type and message), matched to the
    requests' keys by the prefix that a batch's ids keep; results that did not succeed are dropped."""
    done = results.where(F.col("result.type") == "succeeded").withColumn("_id", F.col("custom_id"))
    usage = F.col("result.message.usage")
    return requests.withColumn("_id", F.substring("key", 1, prefix)).join(done, "_id").select(
        "key", verdict(F.col("result.message.content")).alias("verdict"), cost(usage["input_tokens"], usage["output_tokens"], batch=True).alias("cost_usd")
    )


def spend(cache: DataFrame) -> DataFrame:
    return cache.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spend"))


def unanswered(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items whose key the cache lacks, the first (by ``pos``) of each key; a key with many items costs nothing special."""
    missing = items.join(cache.select("key"), "key", "left_anti")
    values = [c for c in items.columns if c != "key"]
    return missing.groupBy("key").agg(F.min_by(F.struct(*values), "pos").alias("_first")).select("key", "_first.*").select(items.columns)


def asked(requests: DataFrame, provider: Provider, created: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The provider's answers (JUDGMENTS), which ``keep`` has written before anything reads them: it is asked once."""
    answers = provider(requests).select("key", F.col("verdict").cast("int").alias("verdict"), "cost_usd", F.lit(created).alias("created"))
    return keep(answers)


def judge_many(
    items: DataFrame, cache: DataFrame, provider: Provider, budget: float, created: float = 0.0, keep: Callable[[DataFrame], DataFrame] = materialize
) -> tuple[DataFrame, DataFrame]:
    """(items with ``verdict``, the new cache). The cap is tested once, before anything is asked; a request without an
    answer counts as no. Every key is asked once, however often the results are read: ``keep`` writes the answers and
    reads them back (``files.kept`` into a verdict table; else into the shared folder). The rows keep their ``pos``."""
    items = materialize(items)
    todo = materialize(unanswered(items, cache))
    if not todo.isEmpty() and spend(cache).first()[0] >= budget:
        raise BudgetExceeded(f"the cap of {budget} dollars is reached")
    merged = upsert(cache, asked(todo, provider, created, keep), ["key"])
    answered = items.join(merged.select("key", "verdict"), "key", "left").withColumn("verdict", F.coalesce(F.col("verdict") == 1, F.lit(False)))
    return answered, merged


def first_asks(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, pos) of the calls that judging ``rows`` in order would make: each key's first eligible row, if not cached."""
    return rows.where("eligible").groupBy("key").agg(F.min("pos").alias("pos")).join(cache.select("key"), "key", "left_anti")


def blocked_from(calls: DataFrame, spent: float, budget: float) -> int | None:
    """The ``pos`` of the first of ``calls`` (pos, cost_usd) for which the spend before it has reached the cap."""
    running = with_running(calls, [F.col("pos")], F.col("cost_usd"), "_before")
    return running.where(F.col("_before") + spent >= budget).agg(F.min("pos")).first()[0]


def fallen_back(rows: DataFrame, stop: int | None) -> DataFrame:
    judged = F.col("eligible") & (F.lit(stop is None) | (F.col("pos") < F.lit(stop)))
    return rows.withColumn("reward", F.when(judged, F.coalesce(F.col("verdict"), F.lit(False)).cast("double")).otherwise(F.col("base")))


def budget_rewards(rows: DataFrame, cache: DataFrame, budget: float) -> DataFrame:
    """Sequential judging under a cap, in ``pos`` order: ``rows`` (pos, key, base, eligible, verdict, cost_usd) get
    ``reward``.

    An eligible row is asked unless its key was cached or asked before. The first such call for which the spend before
    it has reached the cap is blocked, and from there on every eligible row falls back to its base score. Only the calls
    are put in order, in ranges; the rows learn one number, the place of the blocked call.
    """
    cost = rows.groupBy("key").agg(F.min_by("cost_usd", "pos").alias("cost_usd"))
    calls = first_asks(rows, cache).join(cost, "key")
    return fallen_back(rows, blocked_from(calls, spend(cache).first()[0], budget))


class Ledger:
    """Where judging stopped, for good: of each batch that reached the cap, the place of the call that it blocked.

    Judging in batches, one after the other, is judging all their rows: what was spent is in the verdicts' cost, and once
    a call was blocked, every eligible row after it falls back, in later batches too. A batch that is judged again, since
    its driver died, stops where it stopped.
    """

    SCHEMA = "batch string, stop long"

    def __init__(self, spark: SparkSession, path: str):
        self.table = KeyedTable(spark, path, self.SCHEMA, "batch", buckets=1)

    def stop_of(self, batch: str) -> int | None:
        """The place at which this batch stopped; None if it didn't yet."""
        rows = self.table.lookup([batch]).collect()
        return rows[0]["stop"] if rows else None

    def stopped_before(self, batch: str) -> bool:
        return not self.table.read().where(F.col("batch") != batch).isEmpty()

    def stop(self, batch: str, at: int) -> None:
        self.table.write(self.table.spark.createDataFrame([(batch, at)], self.SCHEMA))


def judge_rewards(
    rows: DataFrame, cache: DataFrame, provider: Provider, budget: float, price: float, created: float = 0.0,
    keep: Callable[[DataFrame], DataFrame] = materialize, ledger: Ledger | None = None, batch: str = "",
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``reward``, the new cache): the judge's reward whole, from gate to cache, provider and cap.

    ``rows``: (pos, key, base, answer) and what the provider reads. Rows that pass the gate are judged in ``pos`` order
    under the cap, as ``budget_rewards`` says. ``price`` is the most that a call can cost: calls are asked in rounds, in
    each all that the cap allows even at that price, after which their true costs may allow more. So none is asked that
    judging one after the other would not ask, and every round asks one at least.

    What was asked is always a beginning of the calls in order, so a round needs but the calls' numbers: they are numbered
    and written once, and a round reads those that it asks (their files hold ranges of numbers) and adds up what it
    spent. A request without an answer costs nothing and counts as no, but isn't cached: the next batch asks it again.

    With a ``ledger``, several calls, each with its ``batch``, give what one call over all their rows would.
    """
    if price <= 0:
        raise ValueError("the price of a call must be more than nothing")
    rows = materialize(rows.withColumn("eligible", needs_judge(F.col("base"), F.col("answer"))))
    spark = rows.sparkSession
    if ledger is not None and ledger.stopped_before(batch):
        return fallen_back(rows.withColumn("verdict", F.lit(None).cast("boolean")), -(1 << 62)).drop("verdict"), cache
    firsts = unanswered(rows.where("eligible"), cache)
    calls = materialize(with_position(firsts, [F.col("pos")], "_call"))
    total, spent, asked_so_far, answers = calls.count(), spend(cache).first()[0], 0, []
    known_stop = ledger.stop_of(batch) if ledger is not None else None
    while asked_so_far < total and spent < budget and known_stop is None:
        more = min(total - asked_so_far, ceil((budget - spent) / price))
        todo = calls.where(F.col("_call").between(asked_so_far, asked_so_far + more - 1)).drop("_call")
        got = asked(todo, provider, created, keep)
        answers.append(got)
        spent += spend(got).first()[0]
        asked_so_far += more
    stop = known_stop
    if stop is None and asked_so_far < total:
        stop = calls.where(F.col("_call") == asked_so_far).first()["pos"]
        if ledger is not None:
            ledger.stop(batch, stop)
    new = reduce(DataFrame.unionByName, answers, spark.createDataFrame([], JUDGMENTS))
    merged = upsert(cache, new, ["key"])
    judged = rows.join(merged.select("key", (F.col("verdict") == 1).alias("verdict")), "key", "left")
    return fallen_back(judged, stop).drop("verdict"), merged
