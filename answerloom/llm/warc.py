"""WARC archives: writing captures, reading records, and assembling them into transactions.

*Writing.* Each page becomes three records of WARC 1.1: a ``request``, a ``response`` or ``revisit``, and a
``metadata`` record with the page's id; the first and last name the middle one in ``WARC-Concurrent-To``. Of pages
with equal payloads of ``least`` bytes or more, the one with the largest id is the response; the others are revisits,
which refer to it and hold no payload. Spark's text sink writes the records, with the two line breaks that end a
record as its separator, gzipped, into the given folder: any store that Spark writes to will do.

*Reading.* Spark reads whole archive files, of a bounded size (RECORDS); a task unpacks one as a stream and steps from
record to record by their ``Content-Length``, so payloads may hold anything.

*Assembly.* Records meet by the identifiers that they name: request and metadata join the capture that they are
concurrent to, a revisit the response that it refers to, from which its payload's size and digest come. The result
has one nested row per capture. Payloads don't take part in these joins.

Edge cases: a null payload is an empty one; small payloads are all responses, equal or not. A null URL is an empty one,
line breaks in a URL become spaces. Pages that repeat in full have the same record ids: they count as that many copies
of one capture and come back as often. A null page id comes back as null, and never becomes the response to others.
Very long payloads are written and read whole. An empty table gives an empty one. Columns of the input other than
``page_id``, ``url`` and ``html``, whatever their names, are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm.common import materialize, new_path

EOL = "\r\n"
#: Payloads shorter than this are never revisits.
LEAST = 1_000
#: Records of an archive file by the size of its payloads, in bytes: a reader holds one packed file at a time. So a file
#: holds 256 MB of payloads at most, or a single larger one.
RECORDS = ((64 << 10, 3 * 4_000), (1 << 20, 3 * 250), (16 << 20, 3 * 15), (1 << 62, 3))
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, page_id long, "
    "payload_bytes long, payload_digest string"
)


def lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; a pair whose value is null is left out."""
    each = [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(EOL)) for name, value in pairs]
    return F.concat(*[F.coalesce(e, F.lit("")) for e in each])


def record(kind: Column | str, of: Column, block: Column, *more: tuple[str, Column | str]) -> Column:
    head = lines(("WARC-Type", kind), ("WARC-Record-ID", of), *more, ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit("WARC/1.1" + EOL), head, F.lit(EOL), block)


def urn(*parts: Column | str) -> Column:
    """A record id that follows from its parts."""
    h = F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` (page_id, url, html) with ``payload``, ``digest``, ``n_bytes`` and the id of its response or null."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("n_bytes"), F.sha1(payload).alias("digest"),
    )
    large = rows.select("page_id", "url", "n_bytes", "digest").where(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("c"))
    # (digest, id and URL of the response) of the payloads that repeat: small without their text
    repeated = large.where("c > 1 and top.page_id is not null")
    chosen = materialize(repeated.select("digest", "n_bytes", F.col("top.page_id").alias("of"), F.col("top.url").alias("of_url")))
    return rows.join(chosen, ["digest", "n_bytes"], "left").withColumn("revisit", F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of")))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Write the captures of ``pages`` as gzipped archives into the folder ``path``."""
    rows = planned(pages, least)
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    own = urn("capture", key, F.col("url"), F.col("digest"))
    first = urn("capture", F.col("of").cast("string"), F.col("of_url"), F.col("digest"))
    uri, dated = ("WARC-Target-URI", F.col("url")), ("WARC-Date", date)
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = lambda body: F.concat(
        F.lit("HTTP/1.1 200 OK" + EOL), lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("n_bytes").cast("string"))), F.lit(EOL), body
    )
    kinds = [
        record("request", urn("request", own), F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + EOL + EOL)), dated, uri, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")),
        F.when(
            F.col("revisit"),
            record("revisit", own, http(F.lit("")), dated, uri, digest, ("WARC-Refers-To", first), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response")),
        ).otherwise(record("response", own, http(F.col("payload")), dated, uri, digest, ("Content-Type", "application/http; msgtype=response"))),
        record("metadata", urn("metadata", own), lines(("page-id", F.col("page_id").cast("string"))), dated, uri, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")),
    ]
    values = F.explode(F.array(*kinds)).alias("value")
    largest, least_size = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0, 0
    for size, most in RECORDS:  # a pass for each class of sizes that there is
        some = rows.where((F.col("n_bytes") >= least_size) & (F.col("n_bytes") < size)) if largest >= RECORDS[0][0] else rows
        some.select(values).write.mode("append").option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
        least_size = size
        if largest < size:
            break


def records(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header with lower-case names, block) of each record of an unpacked archive."""
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"a record should begin here: {line[:60]!r}")
            continue
        head = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        n = int(head["content-length"])
        block = file.read(n)
        if len(block) != n:
            raise ValueError(f"the archive ends inside of {head.get('warc-record-id')}")
        yield head, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in ``path``, as RECORD has them; payload size and digest are of the block's payload."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for head, block in records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)):
                    kind, page, size, digest = head["warc-type"], None, None, None
                    if kind == "response":
                        payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(payload), hashlib.sha1(payload, usedforsecurity=False).hexdigest()
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().splitlines() if ": " in x)
                        page = int(fields["page-id"]) if "page-id" in fields else None
                    rows.append((head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), page, size, digest))
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(parsed, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id``, the structs ``request``, ``response``, ``metadata`` (null if missing), and
    ``refers_to`` (of a revisit, the response's metadata)."""
    found = materialize(found)
    heads = (
        found.where("type IN ('response', 'revisit')").groupBy("record_id")
        .agg(F.count("*").alias("copies"), *[F.first(c, ignorenulls=True).alias(c) for c in ("type", "refers_to", "target_uri", "payload_bytes", "payload_digest")])
    )
    asked = found.where("type = 'request'").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.first("target_uri").alias("asked_uri"), F.first("record_id").alias("request_id"))
    told = found.where("type = 'metadata'").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.first("page_id", ignorenulls=True).alias("page_id"), F.first("record_id").alias("metadata_id"))
    whole = materialize(heads.join(asked, "record_id", "left").join(told, "record_id", "left"))
    originals = materialize(
        whole.where("type = 'response'").join(whole.where("type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
        .select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest"))
    )
    return whole.join(originals, "refers_to", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("record_id").alias("capture_id"),
        F.when(F.col("request_id").isNotNull(), F.struct(F.col("request_id").alias("record_id"), F.col("asked_uri").alias("target_uri"))).alias("request"),
        F.struct("type", "target_uri", F.coalesce("of_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("of_digest", "payload_digest").alias("payload_digest")).alias("response"),
        F.when(F.col("metadata_id").isNotNull(), F.struct(F.col("metadata_id").alias("record_id"), "page_id")).alias("metadata"),
        F.when(F.col("type") == "revisit", F.struct(F.col("refers_to").alias("record_id"), F.col("of_page").alias("page_id"))).alias("refers_to"),
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The captures of ``pages``, after they were written into the shared folder and read back."""
    path = new_path(spark, "warc")
    write(pages, path)
    return assemble(read(spark, path))


#: DuckDB SQL for the query.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept = page_id THEN NULL ELSE kept END AS refers_to
FROM g
"""
