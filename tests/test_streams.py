"""Streams: ordered deltas, sentinels, frames cut anywhere, batches delivered twice."""

import random

import pytest
from pyspark.sql import functions as F

from answerloom.streaming import frames, tokens


@pytest.fixture(autouse=True)
def rocksdb(spark):
    tokens.with_rocksdb(spark)


def token_events(models="ab", requests=3, n=10):
    return [(f"r{r}", m, f"{m}{i} ", i == n - 1, i) for r in range(requests) for m in models for i in range(n)]


def arrive(spark, path, events, schema=tokens.EVENT):
    spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, checkpoint, seen):
    write = lambda batch, _: seen.extend(batch.collect())
    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def test_deltas_add_up_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    events = token_events()
    rng.shuffle(events)
    path, seen = str(tmp_path / "in"), []
    stream = lambda: tokens.deltas(spark.readStream.schema(tokens.EVENT).option("maxFilesPerTrigger", 1).parquet(path))
    for k in range(3):  # the stream is stopped and begun anew after each
        arrive(spark, path, events[k::3] + rng.sample(events[: k * 20 + 1], 1))
        run(stream(), str(tmp_path / "state"), seen)
    got = {}
    for r in sorted(seen, key=lambda r: r.first):
        text, done, following = got.get((r.request, r.model), ("", False, 0))
        assert r.first == following and r.lost == 0  # no token twice, none left out
        got[r.request, r.model] = (text + r.text, done or r.done, following + len(r.text.split()))
    want = {(r.request, r.model): (r.text, r.done) for r in tokens.texts(spark.createDataFrame(events, tokens.EVENT), ("request", "model")).collect()}
    assert {k: v[:2] for k, v in got.items()} == want and sum(r.done for r in seen) == 6


def test_gaps_are_given_up_after_a_time(spark, tmp_path):
    import time

    path, seen = str(tmp_path / "in"), []
    arrive(spark, path, [("r", "m", "0 ", False, 0), ("r", "m", "3 ", False, 3), ("r", "m", "4 ", True, 4)])
    stream = tokens.deltas(spark.readStream.schema(tokens.EVENT).parquet(path), wait_ms=500)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not any(r.done for r in seen):
            time.sleep(0.2)
        arrive(spark, path, [("r", "m", "1 ", False, 1), ("r", "m", "2 ", False, 2)])  # too late
        batch = query.lastProgress["batchId"] if query.lastProgress else 0
        while time.time() < until and (query.lastProgress or {"batchId": 0})["batchId"] < batch + 3:
            time.sleep(0.2)
    finally:
        query.stop()
    assert [(r.first, r.text, r.lost, r.done) for r in sorted(seen, key=lambda r: r.first)] == [(0, "0 ", 0, False), (3, "3 4 ", 2, True)]


def test_state_is_asked_for_by_request_not_by_token(spark, tmp_path):
    """Each access to the state is a message between Python and Spark; one for each token held took hours over many requests."""
    rng = random.Random(5)
    requests, path = 20, str(tmp_path / "in")
    events = token_events("abcde", requests, 12)
    rng.shuffle(events)
    for k in range(2):
        arrive(spark, path, events[k::2])
    stream = tokens.deltas(spark.readStream.schema(tokens.EVENT).option("maxFilesPerTrigger", 1).parquet(path))
    seen = []
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    asked = [sum(op["customMetrics"][k] for op in p["stateOperators"] for k in ("rocksdbGetCount", "rocksdbPutCount")) for p in batches]
    assert len(asked) == 2 and all(0 < n <= 5 * requests for n in asked)
    got = {}
    for r in sorted(seen, key=lambda r: r.first):
        got[r.request, r.model] = got.get((r.request, r.model), "") + r.text
    assert got == {(f"r{r}", m): "".join(f"{m}{i} " for i in range(12)) for r in range(requests) for m in "abcde"}


def test_more_ahead_than_a_place_holds(spark, tmp_path):
    """Of one model and not of the other, repeated while they wait, over restarts; one model and a token have no name or text."""
    n, path, seen = 3 * tokens.NEAR, str(tmp_path / "in"), []
    long = [("r", None, None if i == 7 else f"{i} ", i == n - 1, i) for i in range(n)]
    short = [("r", "b", f"b{i} ", i == 2, i) for i in range(3)]
    parts = [long[1::2] + short[1:], long[2:] + short[2:] + [("r", "b", "unnumbered", False, None)], long[:1], short[:1] + long[:5]]
    for part in parts:
        arrive(spark, path, part)
        run(tokens.deltas(spark.readStream.schema(tokens.EVENT).parquet(path)), str(tmp_path / "state"), seen)
    want = {(None, 0, "".join(e[2] or "" for e in long), 0, True), ("b", 0, "b0 b1 b2 ", 0, True)}
    assert {(r.model, r.first, r.text, r.lost, r.done) for r in seen} == want and len(seen) == 2


def test_gaps_of_a_request_are_given_up_each_in_its_time(spark, tmp_path):
    """Also one whose later tokens are more than a place holds; a model whose gap is filled in time loses nothing."""
    import time

    n, path, seen = 2 * tokens.NEAR, str(tmp_path / "in"), []
    arrive(spark, path, [("r", "a", f"{i} ", i == n - 1, i) for i in range(n) if i != 1] + [("r", "b", "b1 ", True, 1)])
    stream = tokens.deltas(spark.readStream.schema(tokens.EVENT).parquet(path), wait_ms=6000)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and not seen:  # a's first token
            time.sleep(0.1)
        arrive(spark, path, [("r", "b", "b0 ", False, 0), ("r", "c", "c2 ", True, 2)])
        while time.time() < until and sum(r.done for r in seen) < 3:
            time.sleep(0.2)
    finally:
        query.stop()
    got = sorted((r.model, r.first, r.text, r.lost, r.done) for r in seen)
    rest = "".join(f"{i} " for i in range(2, n))
    assert got == [("a", 0, "0 ", 0, False), ("a", 2, rest, 1, True), ("b", 0, "b0 b1 ", 0, True), ("c", 2, "c2 ", 2, True)]


def test_one_sentinel_a_request(spark, tmp_path):
    """Of a stream with repeated and late ends, stopped and restarted; the batch form says the same."""
    rng = random.Random(2)
    schema = tokens.EVENT + ", models int"
    events = [(*e, 2) for e in token_events(n=3)] + [("r9", "a", "", True, 0, 2)]  # r9's other model never ends
    path, seen = str(tmp_path / "in"), []
    for k in range(3):
        arrive(spark, path, events[k::2] + rng.sample([e for e in events if e[3]], 4) if k < 2 else [e for e in events if e[3]], schema)
        run(tokens.completed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)), str(tmp_path / "state"), seen)
    want = {("r0", 2, "[DONE]"), ("r1", 2, "[DONE]"), ("r2", 2, "[DONE]")}
    assert sorted(map(tuple, seen)) == sorted(want)
    assert set(map(tuple, tokens.completions(spark.createDataFrame(events, schema)).collect())) == want


def test_stages_follow_one_another(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    arrive(spark, path, [e for e in token_events() if e[4] % 2])
    arrive(spark, path, [e for e in token_events() if not e[4] % 2])
    both = tokens.completed(tokens.deltas(spark.readStream.schema(tokens.EVENT).option("maxFilesPerTrigger", 1).parquet(path)).withColumn("models", F.lit(2)))
    run(both, str(tmp_path / "state"), seen)
    assert sorted(r.request for r in seen) == ["r0", "r1", "r2"]


def test_frames_cut_anywhere_come_back_whole(spark, tmp_path):
    """A file that grows by any number of bytes between the reads of a stream, lines and runs of line feeds in its frames."""
    rng = random.Random(3)
    payloads = [f'{{"n":{i},"é":"{"x" * rng.randint(0, 30)}"}}' + rng.choice(["", "\ndata: more", "\nb"]) for i in range(60)]
    body = "".join(f"data: {p}\n\n" + "\n" * rng.choice([0, 0, 0, 1, 2]) for p in payloads) + "data: [DONE]\n\ndata: not ended"
    data, file = body.encode(), tmp_path / "in" / "a.txt"
    file.parent.mkdir()
    spark.dataSource.register(frames.FrameSource)
    seen, at = [], 0
    stream = lambda: spark.readStream.format("sse_frames").option("path", str(file.parent)).load()
    while at < len(data):
        cut = min(len(data), at + rng.randint(1, 900))
        with file.open("ab") as out:
            out.write(data[at:cut])
        at = cut
        run(stream(), str(tmp_path / "state"), seen)
    want = [d for part in body.split("\n\n")[:-1] if (d := part.removeprefix("data: ").strip())]
    assert [r.data for r in sorted(seen, key=lambda r: r.at)] == want
    batch = spark.read.format("sse_frames").option("path", str(file.parent)).load()
    assert [r.data for r in batch.orderBy("at").collect()] == want


def test_any_range_of_bytes_gives_the_frames_that_end_in_it(tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "BACK", 4)
    rng = random.Random(4)
    for _ in range(300):
        data = "".join(rng.choice(["a", "b", "\n", "\n"]) for _ in range(rng.randint(0, 40))).encode()
        (tmp_path / "f").write_bytes(data)
        cuts = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(4))})
        with (tmp_path / "f").open("rb") as file:
            got = [f for low, high in zip(cuts, cuts[1:], strict=False) for _, f in frames.frames_in(file, low, high)]
        assert got == data.split(b"\n\n")[:-1]


def test_a_batch_delivered_twice_is_written_once(spark, tmp_path):
    path = str(tmp_path / "out")
    put = frames.frames_once(path)
    for rows, batch in (([1, 2], 0), ([3], 1), ([1, 2], 0), ([], 2), ([3], 1)):
        put(spark.createDataFrame([(f'{{"n":{i}}}',) for i in rows], "data string"), batch)
    got = spark.read.parquet(path)
    assert sorted(r.frame for r in got.collect()) == [f'data: {{"n":{i}}}\n\n' for i in (1, 2, 3)]
