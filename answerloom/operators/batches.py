"""Batch jobs of a judge that can be resumed: claims first, then batches, then results; nothing is asked twice.

A job lives in a folder of its own and goes through three tables, each written whole before the next begins:

* ``claims``: the requests, dealt into claims by a hash of their key, SIZE a claim about. Written before anything is asked.
* ``submitted``: the service's batch of each claim. A task hands in claim after claim; whoever tries again, a retried task
  or a driver that was started anew, first asks the service for the batch of its claim, so none is handed in twice.
* ``results``: what each ended batch holds, fetched by tasks. Fetching can be repeated at will.

Requests and results stay in tasks; the driver sees a row for each claim while it waits.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from itertools import groupby
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.operators.judge import Provider, batch_results
from answerloom.sources.files import exists

#: Requests in a claim, about.
SIZE = 10_000
MESSAGE = "struct<content: array<struct<type: string, text: string>>, usage: struct<input_tokens: long, output_tokens: long>>"
RESULT = f"custom_id string, result struct<type: string, message: {MESSAGE}>"


class Service(Protocol):
    """A judge that takes batches. It is pickled to tasks."""

    def find(self, claim: str) -> str | None:
        """The batch that was handed in for a claim, if any."""

    def submit(self, claim: str, requests: list[tuple[str, str]]) -> str:
        """Hands in a claim's (custom id, request as JSON); its batch."""

    def ended(self, batch: str) -> bool: ...

    def results(self, batch: str) -> Iterator[dict]:
        """Rows of RESULT."""


def claimed(requests: DataFrame, folder: str, name: str, size: int) -> DataFrame:
    """(claim, key, request) of a job, as it was when it was first run."""
    spark, path = requests.sparkSession, f"{folder}/claims"
    if not exists(spark, f"{path}/_SUCCESS"):
        claims = -(-requests.count() // size) or 1
        claim = F.concat(F.lit(f"{name}-"), F.pmod(F.xxhash64("key"), F.lit(claims)).cast("string"))
        requests.select(claim.alias("claim"), "key", F.to_json("request").alias("request")).repartition("claim").write.mode("overwrite").parquet(path)
    return spark.read.schema("claim string, key string, request string").parquet(path)


def submitted(claims: DataFrame, service: Service, folder: str, prefix: int) -> DataFrame:
    """(claim, batch) of all claims."""
    spark, path, schema = claims.sparkSession, f"{folder}/submitted", "claim string, batch string"
    known = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    todo = claims.join(known, "claim", "left_anti")

    def hand_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in zip(batch["claim"], batch["key"], batch["request"], strict=True))
        for claim, of in groupby(rows, key=lambda r: r[0]):
            batch = service.find(claim)
            if batch is None:
                batch = service.submit(claim, [(key[:prefix], request) for _, key, request in of])
            yield pd.DataFrame({"claim": [claim], "batch": [batch]})

    handed_in = todo.repartition("claim").sortWithinPartitions("claim", "key").select("claim", "key", "request").mapInPandas(hand_in, schema)
    handed_in.write.parquet(f"{path}/{uuid.uuid4().hex}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def run(requests: DataFrame, service: Service, folder: str, name: str, size: int = SIZE, poll_seconds: float = 30.0, prefix: int = 60) -> DataFrame:
    """(key, verdict, cost_usd) of ``requests`` (key, request), each asked once however often this is begun; requests without
    a result are left out. ``name`` names the job at the service, ``folder`` is where its tables are, and where one that
    was broken off goes on."""
    spark = requests.sparkSession
    claims = claimed(requests, folder, name, size)
    batches = submitted(claims, service, folder, prefix)
    results = f"{folder}/results"
    if not exists(spark, f"{results}/_SUCCESS"):
        waiting = [r["batch"] for r in batches.select("batch").distinct().collect()]  # one for each claim
        while waiting := [b for b in waiting if not service.ended(b)]:
            time.sleep(poll_seconds)

        def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for batch in frame["batch"]:
                    yield pd.DataFrame(list(service.results(batch)), columns=["custom_id", "result"])

        batches.select("batch").distinct().repartition("batch").mapInPandas(fetch, RESULT).write.mode("overwrite").parquet(results)
    return batch_results(claims.select("key"), spark.read.schema(RESULT).parquet(results), prefix)


def provider(service: Service, folder: str, name: str, request, **options) -> Provider:
    """A judge's provider that runs a job; ``request`` makes a request's struct of the row to be judged."""
    return lambda todo: run(todo.select("key", request.alias("request")), service, folder, name, **options)
