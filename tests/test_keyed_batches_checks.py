"""The table that replaces by key, batch jobs that resume, checks that the writing job observes."""

import json
import os
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from answerloom.operators import batches, checks, judge
from answerloom.plans.service import FolderService
from answerloom.sources import scratch
from answerloom.sources.keyed import KeyedTable

SCHEMA = "key string, v int"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests


def rows(spark, **values):
    return spark.createDataFrame(list(values.items()), SCHEMA)


def held(table):
    return {r.key: r.v for r in table.read().collect()}


def test_later_writes_replace(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=4)
    assert held(table) == {}
    table.write(rows(spark, a=1, b=2))
    table.write(rows(spark, b=3, c=4))
    assert held(table) == {"a": 1, "b": 3, "c": 4}
    with pytest.raises(Exception, match="repeated key"):
        table.write(spark.createDataFrame([("a", 8), ("a", 9)], SCHEMA))
    assert held(table) == {"a": 1, "b": 3, "c": 4}  # what failed isn't there
    table.write(spark.createDataFrame([("a", 8), ("a", 9)], SCHEMA), F.col("v"))
    assert held(table)["a"] == 9


def test_compaction_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=4)
    for k in range(4):
        table.write(rows(spark, **{f"k{i}": 10 * k + i for i in range(k, 6)}))
    want, reader = held(table), table.read()
    assert table.compact() is not None and table.compact() is None and held(table) == want
    assert {r.key: r.v for r in reader.collect()} == want  # what a reader has listed is still there
    table.write(rows(spark, k0=99, new=7))
    assert held(table) == want | {"k0": 99, "new": 7}
    table.compact()
    table.vacuum()
    assert held(table) == want | {"k0": 99, "new": 7}
    assert sorted(n.split("=")[0] for n in os.listdir(tmp_path / "t") if n.startswith(("base", "version"))) == ["base"]
    assert int(table.write(rows(spark, k1=5)).split("-")[0]) > 6 and held(table)["k1"] == 5  # numbers go on


def test_a_late_writer_is_not_lost(spark, tmp_path):
    """A version that was begun before a compaction and comes after it is still merged, by its name."""
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=4)
    table.write(rows(spark, a=1, b=1))
    late = table._next()
    table.write(rows(spark, b=3))
    table.compact()
    table._put(rows(spark, a=2, b=2).withColumn("_version", F.lit(late)), f"version={late}")
    got = held(table)
    assert got["a"] == 2 and got["b"] in (2, 3)  # both were written at once
    table.compact()
    table.vacuum()
    assert held(table) == got


def test_writers_at_the_same_time(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=4)
    faults = []

    def write(k):
        try:
            table.write(rows(spark, **{"shared": k, f"own{k}": k}))
        except Exception as fault:  # noqa: BLE001
            faults.append(fault)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = held(table)
    assert not faults and {k: v for k, v in got.items() if k != "shared"} == {f"own{k}": k for k in range(4)} and got["shared"] in range(4)


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=8)
    table.write(rows(spark, **{f"k{i}": i for i in range(100)}))
    table.write(rows(spark, **{f"k{i}": -i for i in range(50)}))
    got = table.lookup(["k3"])
    assert [tuple(r) for r in got.collect()] == [("k3", -3)]
    assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) == 1 and len(got.inputFiles()) < len(table.read().inputFiles())
    assert {(r.key, r.v) for r in table.lookup(["k3", "k70", "gone"]).collect()} == {("k3", -3), ("k70", 70)}


class Dying(FolderService):
    """Its first task dies when it has handed in a claim, and so does the one that is tried next with its second."""

    def submit(self, claim, requests):
        out = super().submit(claim, requests)
        marks = [n for n in os.listdir(self.folder) if n.startswith("died")]
        if len(marks) < 2:
            open(f"{self.folder}/died{len(marks)}", "w").close()
            raise RuntimeError("the task dies")
        return out


def requests(spark, n):
    key = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(n).select(key.alias("key"), judge.request("m", F.concat(F.lit("q"), F.col("id").cast("string")), F.array(F.lit("g")), F.lit("p")).alias("request"))


def asked(folder):
    return sorted(key for name in os.listdir(folder) if name.endswith(".json") for key, _ in json.load(open(f"{folder}/{name}")))


def test_a_task_that_dies_asks_nothing_twice(spark, tmp_path):
    """Each run is broken off where a task dies for good, and the next goes on; every key is handed in once."""
    folder, job = tmp_path / "service", str(tmp_path / "job")
    folder.mkdir()
    todo = requests(spark, 40).cache()
    for _ in range(2):
        with pytest.raises(Exception, match="the task dies"):
            batches.run(todo, Dying(str(folder)), job, "j", size=10, poll_seconds=0.01)
    got = {r.key: r.verdict for r in batches.run(todo, Dying(str(folder), fails="0"), job, "j", size=10, poll_seconds=0.01).collect()}
    keys = sorted(r.key for r in todo.collect())
    assert asked(folder) == [k[:60] for k in keys]
    assert got == {k: ord(k[0]) % 2 == 1 for k in keys if k[4] != "0"}
    again = batches.run(todo, Dying(str(folder)), job, "j", size=10, poll_seconds=0.01)
    assert again.count() == len(got) and asked(folder) == [k[:60] for k in keys]


def test_a_job_waits_and_feeds_the_judge(spark, tmp_path):
    class Slow(FolderService):
        def ended(self, batch):
            polls.append(batch)
            return len(polls) > 3

    polls, items = [], requests(spark, 12).withColumn("pos", F.monotonically_increasing_id())
    ask = batches.provider(Slow(str(tmp_path / "service")), str(tmp_path / "job"), "j", F.col("request"), size=100, poll_seconds=0.01)
    cache = spark.createDataFrame([], "key string, verdict int, cost_usd double, created double")
    got, known = judge.judge_many(items, cache, ask, budget=1.0)
    assert {r.key: r.verdict for r in got.collect()} == {r.key: ord(r.key[0]) % 2 == 1 for r in items.collect()}
    assert len(polls) == 4 and known.count() == 12 and judge.spend(known).first()[0] > 0
    assert batches.run(requests(spark, 0), Slow(str(tmp_path / "service")), str(tmp_path / "empty"), "e", poll_seconds=0.01).count() == 0


def test_checks_hold_or_nothing_is_written(spark, tmp_path):
    df = spark.createDataFrame([("a", [1], [2], None), ("b", [1, 2], [3, 4], "x"), ("a", [], [], "y")], "k string, l array<int>, r array<int>, sometimes string")
    path = str(tmp_path / "t")
    ok = {"rows": checks.rows_exactly(3), "quota": checks.filled("k", "a", 2), "length": checks.same_length("l", "r"), "never null": checks.all_or_none("k")}
    assert checks.written(df, path, ok).count() == 3
    with pytest.raises(ValueError, match="mixed, few"):
        checks.written(df, path, ok | {"mixed": checks.all_or_none("sometimes"), "few": checks.rows_at_least(4)})
    assert spark.read.parquet(path).count() == 3 and not os.path.exists(f"{path}-unchecked")
    odd = df.withColumn("r", F.when(F.col("k") == "b", F.col("r")).otherwise(F.array(F.lit(1))))
    with pytest.raises(ValueError, match="length"):
        checks.written(odd, path, {"length": checks.same_length("l", "r")})
    assert checks.written(df.limit(0), path, {"none": checks.rows_exactly(0), "null": checks.all_or_none("k")}).count() == 0


def test_checkpoints_must_be_there(spark, tmp_path):
    assert checks.must_exist(spark, str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError, match="no checkpoint at"):
        checks.must_exist(spark, str(tmp_path / "gone"))


def test_scratch_takes_no_machine_local_folder_on_a_cluster(spark):
    assert scratch.shared_dir(spark)
