"""Token streams of several models at once: fan-out, ordered concatenation, completion.

Events are (request, model, token, done, seq): a model's tokens are numbered from 0, its last event has ``done``. Two
stateful stages follow one another. ``deltas`` puts each model's tokens in order: its state holds the number that comes
next and the tokens that came ahead of their turn, nothing of the text that is out, so it is as small as the stream is
in order. It is kept by request, so a trigger's tokens of one request meet in one task. ``completed`` counts a request's models that are done, and says so once. Both keep their state in RocksDB and
come out the same however events are dealt over triggers, repeated, or read again after a restart. ``texts`` and
``completions`` are their batch forms.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "request string, model string, token string, done boolean, seq long"
DELTA = "request string, model string, first long, text string, lost long, done boolean"
SENTINEL = "request string, models int, data string"
DONE = "[DONE]"


def with_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that both stages need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fan_out(requests: DataFrame, models: DataFrame) -> DataFrame:
    """A row for each request and model that it asks for (all models if it asks for none).

    The models wanted are exploded and equi-joined with ``models``; a request that asks for none wants the null name,
    under which every model is listed once more.
    """
    wanted = F.array_distinct(F.filter("models", lambda m: m != ""))
    none = F.array(F.lit(None).cast("string"))
    asked = requests.withColumn("_wanted", F.explode(F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, wanted).otherwise(none)))
    listed = models.select(F.col("model").alias("_wanted"), "*").unionByName(models.select(F.lit(None).cast("string").alias("_wanted"), "*"))
    return asked.join(listed, asked["_wanted"].eqNullSafe(listed["_wanted"])).drop("_wanted")


def interleaved(*streams: DataFrame) -> DataFrame:
    """Several models' streams as one, in whatever order their events arrive."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def texts(events: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Batch form of ``deltas``: each model's tokens in order, and whether it is done; a repeated event counts once."""
    once = events.groupBy(*by, "seq").agg(F.max("token").alias("token"), F.max(F.coalesce("done", F.lit(False))).alias("done"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("seq", "token"))))
    return once.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda e: e["token"]), "").alias("text"), F.max("done").alias("done"))


#: Tokens ahead of their turn that a model's place holds itself; more go into a map, so that no trigger writes them again.
NEAR = 64


@dataclass
class Place:
    """How far a model is: the number that comes next, the last one if known, whether its end was told, when a gap is given
    up, how many tokens ahead the map holds, and those ahead that it doesn't."""

    next: int = 0
    last: int | None = None
    told: bool = False
    due: int | None = None
    far: int = 0
    near: dict[int, str] = field(default_factory=dict)


class InOrder(StatefulProcessor):
    """The tokens of a request's models as far as they are in order.

    Each access to the state is a message to Spark, so the models' places are one value: a JSON list, which is read faster
    than a row of nested types.
    """

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("places", "places string")
        self.ahead = handle.getMapState("ahead", "model string, seq long", "token string")

    def places(self) -> dict[str | None, Place]:
        found = self.state.get()
        known = {model: Place(*rest, dict(zip(seqs, held, strict=True))) for model, *rest, seqs, held in (json.loads(found[0]) if found else [])}
        return defaultdict(Place, known)

    def put_back(self, places: dict[str | None, Place], timer: int | None) -> None:
        """Keeps the places, and one timer, for the gap that is given up first; ``timer`` is the one that is set."""
        kept = [(m, p.next, p.last, p.told, p.due, p.far, list(p.near), list(p.near.values())) for m, p in places.items()]
        self.state.update((json.dumps(kept, ensure_ascii=False),))
        first = earliest(places)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        places = self.places()
        timer, new = earliest(places), defaultdict(dict)
        for _, model, token, done, seq in rows:  # as ``deltas`` selects them
            place, tokens = places[model], new[model]
            if seq >= place.next:
                tokens.setdefault(seq, token if token is not None else "")
            if done:
                place.last = seq
        now = timerValues.getCurrentProcessingTimeInMs() if self.wait else 0
        for model, tokens in new.items():
            yield from self.put_out(key, model, places[model], tokens, 0, now)
        self.put_back(places, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        places, now = self.places(), timerValues.getCurrentProcessingTimeInMs()
        for model, place in places.items():
            if place.due is not None and place.due <= now:  # what comes next was waited for long enough
                held = list(place.near) + ([k[1] for k in self.ahead.keys() if k[0] == model] if place.far else [])
                lost, place.next = min(held) - place.next, min(held)
                yield from self.put_out(key, model, place, {}, lost, now)
        self.put_back(places, None)  # the timer that is over is deleted by Spark

    def taken(self, model: str | None, place: Place, new: dict[int, str]) -> str | None:
        """The token that comes next, which is then held no more; None if it isn't there."""
        seq = place.next
        token, held = new.pop(seq, None), place.near.pop(seq, None)
        if held is None and place.far and self.ahead.containsKey((model, seq)):
            held = self.ahead.getValue((model, seq))[0]
            self.ahead.removeKey((model, seq))
            place.far -= 1
        return token if token is not None else held

    def hold(self, model: str | None, place: Place, seq: int, token: str) -> None:
        if seq in place.near or (place.far and self.ahead.containsKey((model, seq))):
            return
        if len(place.near) < NEAR:
            place.near[seq] = token
        else:
            self.ahead.updateValue((model, seq), (token,))
            place.far += 1

    def put_out(self, key, model: str | None, place: Place, new: dict[int, str], lost: int, now: int) -> Iterator[Row]:
        first, out = place.next, []
        while (new or place.near or place.far) and (token := self.taken(model, place, new)) is not None:
            out.append(token)
            place.next += 1
        for seq, token in new.items():
            self.hold(model, place, seq, token)
        if out or lost or not (place.near or place.far):  # what was waited for is here, or given up
            place.due = None
        if self.wait and (place.near or place.far) and place.due is None:
            place.due = now + self.wait
        done, told = place.last is not None and place.next > place.last, place.told
        place.told = done
        if out or lost or (done and not told):
            yield Row(request=key[0], model=model, first=first, text="".join(out), lost=lost, done=done)

    def close(self) -> None:
        pass


def earliest(places: dict[str | None, Place]) -> int | None:
    return min((p.due for p in places.values() if p.due is not None), default=None)


def deltas(events: DataFrame, wait_ms: int = 0) -> DataFrame:
    """(request, model, first, text, lost, done): what each trigger adds to a model's text, from the token numbered
    ``first`` on. Where a token doesn't come for ``wait_ms`` after later ones (0: wait for ever), the gap is given up:
    ``lost`` tokens are missing before ``first``, and late ones are ignored. Write it in append mode."""
    numbered = events.select("request", "model", "token", "done", "seq").where("seq IS NOT NULL")
    return numbered.groupBy("request").transformWithState(InOrder(wait_ms), DELTA, "append", "processingTime" if wait_ms else "none")


class AllDone(StatefulProcessor):
    """One sentinel for each request, when all of its models are done."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.models = handle.getMapState("models", "model string", "one int", ttlDurationMs=self.forget_ms)
        self.told = handle.getValueState("told", "told boolean", ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, wanted = set(), 0
        for frame in rows:
            wanted = max(wanted, int(frame["models"].max()))
            done |= set(frame["model"][frame["done"].fillna(False).astype(bool)])
        if self.told.exists() or not done:
            return
        known = {m[0] for m in self.models.keys()} if self.models.exists() else set()
        for m in done - known:
            self.models.updateValue((m,), (1,))
        if len(known | done) >= wanted:
            self.told.update((True,))
            self.models.clear()
            yield pd.DataFrame({"request": [key[0]], "models": [wanted], "data": [DONE]})

    def close(self) -> None:
        pass


def completed(done: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """(request, models, data): a sentinel for each request when as many different models as it asked for are done, once,
    whatever comes again or late. ``done``: (request, model, done, models), ``models`` the number that it asked for; events
    or ``deltas``. State is dropped ``forget_ms`` after its last change (None: never). Write it in append mode."""
    return done.select("request", "model", "done", "models").groupBy("request").transformWithStateInPandas(AllDone(forget_ms), SENTINEL, "append", "processingTime" if forget_ms else "none")


def completions(done: DataFrame) -> DataFrame:
    """Batch form of ``completed``. Pre-aggregated by request and model, so no model's events meet in one task."""
    models = done.groupBy("request", "model").agg(F.max(F.coalesce("done", F.lit(False))).alias("done"), F.max("models").alias("models"))
    counted = models.groupBy("request").agg(F.count(F.when(F.col("done"), 1)).alias("n"), F.max("models").cast("int").alias("models"))
    return counted.where("n >= models").select("request", "models", F.lit(DONE).alias("data"))


def all_done(done: DataFrame, k: int) -> DataFrame:
    """Whether k models of a batch are done."""
    return done.where("done").agg((F.count_distinct("model") >= k).alias("all_done"))
