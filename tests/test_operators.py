"""Splits, verdicts, tables, sources, runs and streams."""

import random

import pytest
from pyspark.sql import functions as F

from answerloom.operators import ingest, judge, runs, splits, tables
from answerloom.sources import files, scratch
from answerloom.streaming import tokens


def assigned(counts, n_first, n_second):
    """The ordered fill, step by step."""
    first, second, i = [], [], 0
    while i < len(counts) and len(first) < n_first:
        first += [(i, j) for j in range(counts[i])][: n_first - len(first)]
        i += 1
    while i < len(counts) and len(second) < n_second:
        second += [(i, j) for j in range(counts[i])][: n_second - len(second)]
        i += 1
    return {(*x, "first") for x in first} | {(*x, "second") for x in second}


@pytest.mark.parametrize("seed", range(4))
def test_quota_split(spark, seed):
    rng = random.Random(seed)
    counts = [rng.randint(0, 4) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(counts)), "i int, n int")
    got = {(r.i, r.item, r.bucket) for r in splits.quota_split(df, "n", [F.col("i")], 30, 20).collect()}
    assert got == assigned(counts, 30, 20)
    assert not {i for i, _, b in got if b == "first"} & {i for i, _, b in got if b == "second"}


def test_quota_split_raises(spark):
    df = spark.createDataFrame([(0, 2), (1, 2)], "i int, n int")
    with pytest.raises(ValueError, match="of 3 items"):
        splits.quota_split(df, "n", [F.col("i")], 3, 3)
    with pytest.raises(ValueError):
        splits.quota_split(df, "n", [F.col("i")], 3, 0)


def test_positions_are_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(r.v == r.position for r in splits.with_position(df, [F.col("v")]).collect())
    ties = df.select(F.lit(1).alias("c"), "v")  # all equal in the first column
    assert all(r.v == r.position for r in splits.with_position(ties, [F.col("c"), F.col("v")]).collect())


def test_disjoint_split_falls_short_quietly(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "i int, k int")
    got = splits.disjoint_split(df, "k", [F.col("i")], 2, 100).collect()
    assert sorted((r.i, r.bucket) for r in got) == [(0, "first"), (1, "first"), (2, "second"), (5, "second"), (8, "second")]


ITEMS = "pos long, question string, golds array<string>, prediction string"


def items(spark, rows):
    df = spark.createDataFrame(rows, ITEMS)
    return df.withColumn("key", judge.judge_key("m", F.col("question"), F.col("golds"), F.col("prediction")))


def empty_cache(spark):
    return spark.createDataFrame([], "key string, verdict int, cost_usd double, created double")


class Counting:
    """A provider whose calls are made in tasks, each with a trace in a folder."""

    def __init__(self, path, fails=(), cost=0.5):
        self.path, self.fails, self.cost = str(path), tuple(fails), cost

    def __call__(self, todo):
        path, fails, cost = self.path, self.fails, self.cost

        def answer(batches):
            import pathlib
            import uuid

            import pandas as pd

            for batch in batches:
                for pos in batch["pos"]:
                    pathlib.Path(path, f"{pos}-{uuid.uuid4().hex}").touch()
                got = batch[~batch["pos"].isin(fails)]
                yield pd.DataFrame({"key": got["key"], "verdict": got["pos"] % 2 == 0, "cost_usd": cost})

        return todo.select("key", "pos").mapInPandas(answer, "key string, verdict boolean, cost_usd double")

    @property
    def calls(self):
        import os

        return sorted(int(n.split("-")[0]) for n in os.listdir(self.path))


def test_judge_asks_each_key_once_and_caches(spark, tmp_path):
    provider = Counting(tmp_path, fails=[2])
    rows = items(spark, [(0, "q", ["b", "a"], "Two."), (1, "q", ["a", "b"], "2"), (2, "q", ["a"], "x")] + [(i, "q", ["c"], f"w{i}") for i in range(3, 10)])
    got, cache = judge.judge_many(rows, empty_cache(spark), provider, budget=1.0)
    for _ in range(2):  # however often either result is read
        assert [r.verdict for r in got.orderBy("pos").collect()] == [True, True, False] + [i % 2 == 0 for i in range(3, 10)]
        assert cache.count() == 8
    assert provider.calls == [0, 2, *range(3, 10)]
    judge.judge_many(rows.where("pos <> 2"), cache, provider, budget=0.0)[0].collect()
    assert len(provider.calls) == 9
    with pytest.raises(judge.BudgetExceeded):
        judge.judge_many(rows, cache, provider, budget=0.1)


def test_judge_keeps_answers_in_a_verdict_table(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    provider, path = Counting(tmp_path / "calls"), str(tmp_path / "verdicts")
    rows = items(spark, [(i, "q", ["c"], f"w{i}") for i in range(6)])
    first, _ = judge.judge_many(rows.where("pos < 3"), files.read_verdicts(spark, path), provider, 10.0, keep=files.kept(path))
    second, merged = judge.judge_many(rows, files.read_verdicts(spark, path), provider, 10.0, keep=files.kept(path))
    assert [r.verdict for r in first.orderBy("pos").collect()] == [True, False, True] and [r.verdict for r in second.orderBy("pos").collect()] == [True, False] * 3
    assert provider.calls == list(range(6)) and merged.count() == files.read_verdicts(spark, path).count() == 6
    judge.judge_many(rows, files.read_verdicts(spark, path), provider, 0.0, keep=files.kept(path))[0].collect()
    assert provider.calls == list(range(6))


def test_costs_and_verdicts(spark):
    row = spark.range(1).select(judge.cost(F.lit(100), F.lit(2)).alias("c"), judge.cost(F.lit(100), F.lit(2), batch=True).alias("b")).first()
    assert row.c == pytest.approx(110 / 1e6) and row.b == row.c / 2
    replies = spark.createDataFrame([([("text", " Yes, it does")],), ([("other", "x"), ("text", "no")],), ([],)], "c array<struct<type: string, text: string>>")
    assert [r.v for r in replies.select(judge.verdict(F.col("c")).alias("v")).collect()] == [True, False, False]


def sequential(rows, cached, spent, budget):
    known, stopped, out = set(cached), False, []
    for r in rows:
        if not r["eligible"] or stopped:
            out.append(r["base"])
            continue
        if r["key"] not in known:
            if spent >= budget:
                stopped = True
                out.append(r["base"])
                continue
            known.add(r["key"])
            spent += r["cost_usd"]
        out.append(float(r["verdict"]))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_budget_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    verdicts = {k: rng.random() < 0.5 for k in "abcdefgh"}
    rows = [{"pos": i, "key": (k := rng.choice("abcdefgh")), "base": float(rng.random() < 0.2), "eligible": rng.random() < 0.8, "verdict": verdicts[k], "cost_usd": 0.25} for i in range(40)]
    cache = spark.createDataFrame([("a", 1, 0.5, 0.0)], "key string, verdict int, cost_usd double, created double")
    df = spark.createDataFrame(rows, "pos long, key string, base double, eligible boolean, verdict boolean, cost_usd double")
    for budget in (1.25, 0.5, 100.0):
        got = [r.reward for r in judge.budget_rewards(df, cache, budget).orderBy("pos").collect()]
        assert got == sequential(rows, {"a"}, 0.5, budget)


@pytest.mark.parametrize("budget", [0.0, 1.5, 2.25, 50.0])
def test_judge_rewards_ask_no_more_than_one_after_the_other(spark, tmp_path, budget):
    """The gate, the cache, calls that fail, and a cap that cheap calls reach later than their price says."""
    rng = random.Random(9)
    rows = [{"pos": i, "key": f"k{rng.randrange(16)}", "base": float(rng.random() < 0.2), "answer": rng.choice(["x", "x", "x", "", None])} for i in range(50)]
    first = {}
    for r in rows:
        if r["base"] == 0 and r["answer"]:
            first.setdefault(r["key"], r["pos"])
    fails = [p for p in first.values() if p % 5 == 0]
    cached = {"k1"}
    plain = [r | {"eligible": r["base"] == 0 and bool(r["answer"]), "verdict": r["key"] in cached or (first.get(r["key"], 1) % 2 == 0 and first.get(r["key"]) not in fails), "cost_usd": 0.0 if first.get(r["key"]) in fails else 0.25} for r in rows]
    cache = spark.createDataFrame([("k1", 1, 0.5, 0.0)], "key string, verdict int, cost_usd double, created double")
    provider = Counting(tmp_path, fails, cost=0.25)
    df = spark.createDataFrame(rows, "pos long, key string, base double, answer string")
    got, merged = judge.judge_rewards(df, cache, provider, budget, price=0.75)
    assert [r.reward for r in got.orderBy("pos").collect()] == sequential(plain, cached, 0.5, budget)
    calls, spent = [], 0.5
    for key, pos in sorted(first.items(), key=lambda x: x[1]):
        if key not in cached and spent < budget:
            calls.append(pos)
            spent += 0.0 if pos in fails else 0.25
    assert provider.calls == calls and merged.count() == len(set(calls) - set(fails)) + 1  # what failed isn't cached


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    twice = new.unionByName(spark.createDataFrame([(3, "D")], new.schema))
    with pytest.raises(Exception, match="repeated key"):
        tables.upsert(old, twice, ["k"]).collect()
    assert sorted(map(tuple, tables.upsert(old, twice, ["k"], F.col("v")).collect())) == [(1, "a"), (2, "B"), (3, "D")]
    import hashlib

    f = tables.fingerprint(spark.createDataFrame([("s", 2), ("s", 10), ("s", 1)], "s string, k int"), ["s"], F.col("k"), F.col("k")).first()
    assert f.sha == hashlib.sha256(b"1,2,10").hexdigest()
    joined = old.join(new.select("k", F.col("v").alias("w")), "k", "left")
    with pytest.raises(Exception, match="no partner"):
        tables.must_match(joined, "w", "partner").collect()


def test_lookups_must_match_and_the_last_wins(spark):
    rows = spark.createDataFrame([(1, "i"), (2, "j"), (3, "i")], "n int, image string")
    images = spark.createDataFrame([("i", "old", 0), ("i", "new", 1), ("j", "only", 0), ("unasked", "x", 0), ("unasked", "y", 0)], "id string, bytes string, at int")
    got = tables.payloads(rows, "image", images, "id", F.col("at"))
    assert sorted((r.n, r.image, r.bytes) for r in got.collect()) == [(1, "i", "new"), (2, "j", "only"), (3, "i", "new")]
    with pytest.raises(Exception, match="repeated key"):
        tables.payloads(rows, "image", images, "id").collect()
    with pytest.raises(Exception, match="no row for a image"):
        tables.payloads(rows, "image", images.where("id <> 'j'"), "id", F.col("at")).collect()


def test_ingest_conforms(spark):
    rows = spark.createDataFrame([(3, None, [("Which?\nAnswer", "Net."), (" Two ", "1.50")])], "position int, images array<struct<bytes: binary, path: string>>, texts array<struct<user: string, assistant: string>>")
    got = files.conform(ingest.from_multi_qa(rows)).orderBy("qid").collect()
    assert [(r.qid, r.question, r.answers) for r in got] == [("cauldron-3-0", "Which?", ["net"]), ("cauldron-3-1", "Two", ["1.50"])]


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "raw", 1.0, ["x"]), ("b", "y", "raw", 0.0, None)], "qid string, prediction string, raw string, score double, answers array<string>")
    files.write_lines(rows, str(tmp_path / "lines"))
    assert sorted(map(tuple, files.read_lines(spark, str(tmp_path / "lines")).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/a.json").write_text('{"run_id": "r-gqa", "eval": {"dataset": "gqa", "limit": null}, "metrics": {"overall": 0.5, "by_answer_type": {"all": 0.5}}}')
    (tmp_path / "runs/b.json").write_text('{"run_id": "x", "status": "not run"}')
    got = files.read_runs(spark, str(tmp_path / "runs"))
    flat = got.select("run_id", F.col("eval.dataset").alias("dataset"), F.col("metrics.overall").alias("overall"), "file")
    assert [tuple(r) for r in runs.results_by_dataset(flat, ["gqa", "clevr"]).collect()] == [("r", 0.5, None)]


def test_report_cells(spark):
    rows = spark.createDataFrame([("b", "gqa", 0.532), ("x", "gqa", 0.5368), ("x", "clevr", 0.8)], "run string, dataset string, overall double")
    got = {(r.run, r.dataset): r.c for r in runs.deltas(rows, "b").select("run", "dataset", runs.cell(F.col("overall"), F.col("delta")).alias("c")).collect()}
    assert got == {("b", "gqa"): "53.2 (+0.0)", ("x", "gqa"): "53.7 (+0.5)", ("x", "clevr"): "80.0"}


def test_strict_zip_and_verdict_table(spark, tmp_path):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "position int, l string")
    b = spark.createDataFrame([(0, "p")], "position int, r string")
    with pytest.raises(Exception, match="differ in length"):
        tables.zip_strict(a, b).collect()
    path = str(tmp_path / "verdicts")
    assert files.read_verdicts(spark, path).count() == 0
    new = spark.createDataFrame([("k", 1, 0.5, 0.0)], "key string, verdict int, cost_usd double, created double")
    files.put_verdicts(new, path)
    files.put_verdicts(new.unionByName(spark.createDataFrame([("j", 0, 0.25, 0.0)], new.schema)), path)
    assert judge.spend(files.read_verdicts(spark, path)).first()[0] == 0.75
    assert files.markdown_head("Model", ["A"]) == "| Model | A |\n|---|---|"


def test_only_an_absent_verdict_table_is_empty(spark, tmp_path):
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/part-0.parquet").write_text("no parquet")
    assert files.read_verdicts(spark, str(tmp_path / "absent")).count() == 0
    with pytest.raises(ValueError, match="part-0.parquet"):
        files.read_verdicts(spark, str(tmp_path / "broken")).count()


def test_manifests_are_rebuilt_in_part(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "manifest")
    row = lambda *rows: spark.createDataFrame(rows, files.MANIFEST)
    files.rebuild_manifest(row(("a", 1, "x"), ("b", 2, "y")), path)
    files.rebuild_manifest(row(("b", 3, "z"), ("c", 4, "w")), path)
    now = [("a", 1, "x"), ("b", 3, "z"), ("c", 4, "w")]
    assert sorted(map(tuple, files.read_manifest(spark, path).collect())) == now
    # a writer that dies before its document is in place leaves the one that was there
    monkeypatch.setattr(files, "renamed", lambda *_: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError, match="died"):
        files.rebuild_manifest(row(("a", 9, "q")), path)
    monkeypatch.undo()
    assert sorted(map(tuple, files.read_manifest(spark, path).collect())) == now
    files.rebuild_manifest(row(("a", 5, "v")), path)
    assert sorted(map(tuple, files.read_manifest(spark, path).collect())) == [("a", 5, "v"), *now[1:]] and files.manifest_documents(spark, path) == [2, 3]


def test_positions_by_input_order(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1_000).repartitionByRange(6, "id").sortWithinPartitions("id").write.parquet(path)
    rows = files.in_input_order(spark, path)
    assert all(r.id == r.position for r in rows.collect()) and "Exchange range" not in rows._jdf.queryExecution().toString()


def test_sources_are_selected(spark):
    one = lambda x: spark.createDataFrame([(x,)], "v string")
    builders = {"a": lambda: [one("a1"), one("a2")], "b": lambda: [one("b")]}
    assert sorted(r.v for r in files.select_sources(builders).collect()) == ["a1", "a2", "b"]
    assert sorted(r.v for r in files.select_sources(builders, "a").collect()) == ["a1", "a2"]
    with pytest.raises(ValueError, match="none of a, b"):
        files.select_sources(builders, "c")


def test_fan_out_and_merge(spark):
    models = spark.createDataFrame([("a", 1), ("b", 2)], "model string, size int")
    asked = spark.createDataFrame([(1, ["a", ""]), (2, []), (3, None), (4, ["b", "b", "x"]), (5, [""])], "id int, models array<string>")
    got = sorted((r.id, r.model, r.size) for r in tokens.fan_out(asked, models).collect())
    assert got == [(1, "a", 1), (2, "a", 1), (2, "b", 2), (3, "a", 1), (3, "b", 2), (4, "b", 2), (5, "a", 1), (5, "b", 2)]


def test_scopes_remove_and_clusters_need_a_shared_folder(spark):
    import os
    from types import SimpleNamespace

    with scratch.scope():
        kept = scratch.materialize(spark.range(3))
        files_of = [f.removeprefix("file://") for f in kept.inputFiles()]
        assert kept.count() == 3 and all(map(os.path.exists, files_of))
    assert not any(map(os.path.exists, files_of))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(cluster)


def test_colours_and_times(spark):
    row = spark.range(1).select(runs.delta_colour(F.lit(-1.0), F.lit(2.0)).alias("below"), runs.delta_colour(F.lit(3.0), F.lit(2.0)).alias("above"), runs.delta_colour(F.lit(0.0), F.lit(2.0)).alias("none"), runs.elapsed(F.lit(1000), F.lit(2540)).alias("t")).first()
    assert tuple(row) == ("rgb(75,104,147)", "rgb(184,125,38)", "rgb(58,66,80)", "1.5")
    assert spark.range(1).select(runs.delta_colour(F.lit(0.0), F.lit(0.0)).alias("c")).first().c == "rgb(58,66,80)"


def test_largest_delta_counts_what_is_missing_as_nothing(spark):
    results = spark.createDataFrame([("base", "a", 0.5), ("x", "a", 0.6), ("x", "b", 0.2), ("y", "b", 0.9)], "run string, dataset string, overall double")
    entries = lambda *names: spark.createDataFrame([(n,) for n in names], "run string")
    most = lambda names, datasets: runs.largest_delta(results, "base", entries(*names), datasets).first().most
    assert most(["x"], ["a"]) == 10.0 and most(["x"], ["a", "b"]) == 20.0 and most(["y"], ["a"]) == 50.0 and most(["gone"], ["a", "b"]) == 50.0 and most(["base"], ["a", "b"]) == 0.0


@pytest.mark.parametrize("cuts", [[20], [1, 30], [5, 11, 25]])
def test_batches_with_a_ledger_equal_one_call_over_all(spark, tmp_path, cuts):
    """Later cached keys fall back, too, once the cap was reached; a batch that is judged again stops where it did."""
    rng = random.Random(len(cuts))
    rows = [{"pos": i, "key": f"k{rng.randrange(25)}", "base": 0.0, "answer": rng.choice(["x", "x", ""])} for i in range(40)]
    schema = "pos long, key string, base double, answer string"
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    whole, _ = judge.judge_rewards(spark.createDataFrame(rows, schema), empty_cache(spark), Counting(tmp_path / "a", cost=0.25), 2.0, 0.5)
    ledger, cache, got = judge.Ledger(spark, str(tmp_path / "ledger")), empty_cache(spark), {}
    edges = [0, *cuts, 40]
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        some = spark.createDataFrame(rows[low:high], schema)
        out, known = judge.judge_rewards(some, cache, Counting(tmp_path / "b", cost=0.25), 2.0, 0.5, ledger=ledger, batch=str(k))
        once = {r.pos: r.reward for r in out.collect()}
        cache = scratch.materialize(known)
        again, _ = judge.judge_rewards(some, cache, Counting(tmp_path / "b", cost=0.25), 2.0, 0.5, ledger=ledger, batch=str(k))
        assert {r.pos: r.reward for r in again.collect()} == once
        got |= once
    assert got == {r.pos: r.reward for r in whole.collect()}
    assert Counting(tmp_path / "a").calls == Counting(tmp_path / "b").calls


def test_a_round_of_judging_reads_what_it_asks(spark, tmp_path, monkeypatch):
    """True costs far below the price make many rounds; each asks its own calls, and all calls are ordered once."""
    asked, ordered = [], []
    with_position = judge.with_position
    monkeypatch.setattr(judge, "with_position", lambda *a: ordered.append(1) or with_position(*a))
    provider = Counting(tmp_path, cost=1 / 16)
    rows = spark.createDataFrame([(i, f"k{i}", 0.0, "x") for i in range(60)], "pos long, key string, base double, answer string")
    got, _ = judge.judge_rewards(rows, empty_cache(spark), lambda todo: asked.append(todo.count()) or provider(todo), 2.0, 1.0)
    assert sum(asked) == 32 == len(provider.calls) and len(ordered) == 1 and len(asked) > 5
    assert sum(r.reward for r in got.collect()) == 16.0
    with pytest.raises(ValueError, match="price"):
        judge.judge_rewards(rows, empty_cache(spark), provider, 2.0, 0.0)


@pytest.mark.parametrize("arrow", [3, 7, 1_000])
def test_providers_get_full_chunks_whatever_the_arrow_batches(spark, arrow):
    def answer(rows):
        return rows.assign(asked=len(rows))[["id", "asked"]]

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, arrow)
    try:
        got = ingest.generate(spark.range(0, 23, 1, 1), "id long, asked int", answer, size=5).collect()
        assert [tuple(r) for r in got] == [(i, 5 if i < 20 else 3) for i in range(23)]
        assert ingest.generate(spark.range(0, 0, 1, 1), "id long, asked int", answer, size=5).count() == 0
        with pytest.raises(Exception, match="4 answers to 5 rows"):
            ingest.generate(spark.range(0, 23, 1, 1), "id long", lambda rows: rows[rows["id"] != 7], size=5).collect()
    finally:
        spark.conf.set(name, before)


def test_token_logprobs_are_strict(spark):
    of = lambda ids, maps: spark.createDataFrame([(ids, maps)], "ids array<int>, maps array<map<int,double>>").select(ingest.token_logprobs(F.col("ids"), F.col("maps")).alias("x")).first().x
    assert of([3, 1, 3], [{1: -0.5, 3: -2.0}, {1: -0.1}, {3: -0.7, 4: -0.9}]) == [-2.0, -0.1, -0.7]
    assert of([], []) == [] and of(None, []) is None
    for ids, maps in (([3, 2], [{3: -2.0}, {1: -0.1}]), ([3], [{3: -2.0}, {1: -0.1}]), ([3, 1], [{3: -2.0}]), ([None], [{3: -2.0}])):
        with pytest.raises(Exception, match="no entry of token"):
            of(ids, maps)
