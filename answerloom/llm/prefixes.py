"""Conversation prefix trie: what conversations share, by digest-keyed nodes and pointer-jumping sums.

Each distinct sequence of first d turns (role, text) is a node of depth d; the textless root has depth 0. A node's members
are the conversations that begin with it, its subtree includes itself. Of each node come out its members, its children,
the childless nodes of its subtree, what its subtree saves in words if shared prefixes are read once, and a digest of the
members that end at it.

1. *Slim rows.* Each turn is reduced to the SHA-256 of its role and text and its number of words, in one pass. Nothing
   after that moves texts.
2. *Prefix digests.* A sequence is fingerprinted by the sums, as decimals, of two 64-bit hashes of each turn's digest and
   place, so prefixes of a conversation are running sums. Those are found by sorted ranges of all turns (``running``): a
   conversation of any length is dealt over as many ranges as it needs, and never meets in one task.
3. *Nodes* are aggregated by digest, before the shuffle too, so any number of conversations with the same beginning cost a
   row for each task. Each has one edge, to its parent's digest.
4. *Pointer jumping.* Every node has a pointer, first to its parent, and sums, first of itself. In a round each node adds
   its sums to those of the node that it points to, and points to where that one points; after r rounds sums cover 2^r
   levels of the subtree, so the rounds are the binary logarithm of the depth. Nodes whose pointer has passed the root
   drop out. What is sent to one node is added up before it is shuffled; each round is written to the shared folder.
5. *Ends.* The ids of the members that end at a node are sorted in ranges, joined to strings of PIECE ids there, and the
   strings streamed through SHA-256, which can't be split; so the one task of a node holds one string at a time.

Edge cases: a null role or text is empty. Turns are ordered by ``turn``, null first, ties by the SHA-256 of role, a zero
byte, and text; repeated rows are turns each. Rows with a null ``conv_id`` belong to no conversation that could be named,
and are in no node. Very long texts are hashed whole. Equal fingerprints are taken for equal sequences. An empty table
gives no node, not even a root. Other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.common import materialize
from answerloom.llm.periodic import CRC_TABLE, crc32_sql

#: Ids in a string of those that end at a node.
PIECE = 10_000
#: The root's digest; no other has its length.
ROOT = bytearray(b"root")
LANES = ("lane1", "lane2")


def slim(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of ``turns`` (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    digest = F.unhex(F.sha2(F.concat(role, F.lit("\0"), text), 256))
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), words.cast("long").alias("words"))


def running(rows: DataFrame, key: str, order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``amounts``, its sum over the rows of the same ``key`` up to and with each in ``order``.

    Rows are dealt into ranges of key and order, written once, and summed within their range. A key that goes on from one
    range to the next gets what the ranges before hold of it: a range has one such key at most, so there are no more such
    rows than ranges.
    """
    ranged = materialize(rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()))
    edges = ranged.groupBy("_range").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    next_range = Window.orderBy("_range")  # a row for each range
    carried = edges.withColumn("before", F.lag("last").over(next_range)).where("before = first").select(F.col("first").alias(key)).distinct()
    held = ranged.join(F.broadcast(carried), key, "left_semi")  # as many keys as there are ranges, at most
    held = held.groupBy(key, "_range").agg(*[F.sum(x).alias(f"_{name}") for name, x in amounts.items()])
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(key, "_range", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in amounts])
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *[F.sum(x).over(inside).alias(f"_in_{name}") for name, x in amounts.items()])
    out = summed.join(F.broadcast(starts), [key, "_range"], "left")  # two rows for each range, at most
    return out.select(*rows.columns, *[(F.col(f"_in_{name}") + F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in amounts])


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words): ``turns`` (conv_id, turn, role, text) with their place in their conversation, from 0."""
    numbered = running(slim(turns), "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], {"n": F.lit(1).cast("long")})
    return materialize(numbered.select("conv_id", (F.col("n") - 1).alias("at"), "digest", "words"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, words): for each conversation and depth from 1 the digest of its first turns, that of
    one turn less, and the last turn's words. ``turns``: (conv_id, at, digest, words), ``at`` from 0 without gaps."""
    hashed = [F.xxhash64(F.lit(seed), "at", "digest").cast("decimal(20,0)").alias(f"own_{lane}") for seed, lane in enumerate(LANES)]
    rows = turns.select("conv_id", "at", "words", *hashed)
    summed = running(rows, "conv_id", [F.col("at")], {lane: F.col(f"own_{lane}") for lane in LANES})
    key = lambda depth, sums: F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))
    above = key(F.col("at"), [(F.col(lane) - F.col(f"own_{lane}")).cast("decimal(38,0)") for lane in LANES])
    return summed.select(
        "conv_id", (F.col("at") + 1).alias("depth"), key(F.col("at") + 1, [F.col(lane).cast("decimal(38,0)") for lane in LANES]).alias("key"),
        F.when(F.col("at") == 0, F.lit(ROOT)).otherwise(above).alias("parent"), "words",
    )


def subtree_sums(nodes: DataFrame, sums: list[str], depth: int) -> DataFrame:
    """(key, sums): ``nodes`` (key, parent, and numbers ``sums``), each number added up over the node's subtree. ``depth``:
    the greatest. Pointers double what they skip in each round, so there are about log2(depth) rounds."""
    state = nodes.select("key", F.col("parent").alias("up"), *sums)
    for _ in range(depth.bit_length()):
        below = state.where("up is not null").groupBy(F.col("up").alias("key")).agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        # what points at the root has nowhere to go on to; those and nodes without a pointer don't meet in a join
        jumps = state.select(F.col("key").alias("up"), F.col("up").alias("next")).where("next is not null")
        goes_on = F.coalesce(F.col("up") != F.lit(ROOT), F.lit(False))
        moved = state.where(goes_on).join(jumps, "up", "left").select("key", F.col("next").alias("up"), *sums)
        on = moved.unionByName(state.where(~goes_on).withColumn("up", F.lit(None).cast("binary")))
        state = materialize(on.join(below, "key", "left").select("key", "up", *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums]))
    return state.select("key", *sums)


def ids_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of ``ends`` (key, conv_id): the SHA-256 of each key's ids, ascending and comma-joined."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ids in order to strings of PIECE ids at most, of one key each, named by their first id."""
        for batch in batches:
            parts = []
            for key, ids in batch.groupby("key", sort=False)["conv_id"]:
                ids = ids.to_numpy()
                parts += [(key, int(ids[at]), ",".join(map(str, ids[at : at + PIECE].tolist()))) for at in range(0, len(ids), PIECE)]
            yield pd.DataFrame(parts, columns=["key", "first", "ids"])

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hashed = None, hashlib.sha256()
        for batch in batches:
            out = []
            for k, ids in zip(batch["key"], batch["ids"], strict=True):
                if k == key:
                    hashed.update(b",")
                else:
                    if key is not None:
                        out.append((key, hashed.hexdigest()))
                    key, hashed = k, hashlib.sha256()
                hashed.update(ids.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, hashed.hexdigest())], columns=["key", "ends_sha256"])

    ordered = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    listed = ordered.mapInPandas(pieces, "key binary, first long, ids string")
    return listed.repartition("key").sortWithinPartitions("key", "first").mapInPandas(digested, "key binary, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """A row per node: ``conv_id`` (the least member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``
    (members), ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, each node's members but one times the words
    of its last turn), ``ends_sha256`` (of the members that end here, ascending and comma-joined).

    ``turns``: (conv_id, at, digest, words), see ``placed``. ``conversations`` (conv_id): all of them, the turnless too; if
    None those that have turns."""
    members = materialize(prefixes(turns))
    known = members.select("conv_id").distinct() if conversations is None else conversations.select("conv_id").distinct()
    last = members.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    ends = materialize(known.join(last, "conv_id", "left").select(F.coalesce("key", F.lit(ROOT)).alias("key"), "conv_id"))
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    shared = members.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    nodes = materialize(root.unionByName(shared))
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}
    nodes = materialize(nodes.withColumns(own))
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(nodes, list(own), depth)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.drop(*own).join(parents, "parent", "left").join(sums, "key").join(ids_digests(ends), "key", "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *own, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Placed ``turns``, and all conversations, with the beginning of each taken from its family's first: of conversation c
    the first h turns are those of ``c - c % family`` (all if that has fewer, none if it isn't there), h the CRC-32 of c
    modulo ``most``; c's own turns follow after its first h."""
    c = F.col("conv_id")
    known = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    taken = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most))
    convs = known.select("conv_id", (c - c % family).alias("base"), taken.alias("h"))
    bases = known.select(c.alias("base"), F.col("n").alias("base_n"))
    convs = materialize(convs.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    heads = turns.where((c % family == 0) & (F.col("at") < most - 1)).withColumnRenamed("conv_id", "base")
    first = heads.join(convs, "base").where("at < taken").select(turns.columns)
    rest = turns.join(convs, "conv_id").where("at >= h").withColumn("at", F.col("at") - F.col("h") + F.col("taken")).select(turns.columns)
    return first.unionByName(rest), convs.select("conv_id")


#: DuckDB SQL for the query, after ``periodic``'s CRC-32: all prefixes written out, descendants by their least member.
ORACLE = rf"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(coalesce(role, '') || chr(0) || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, n, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id), (SELECT {CRC_TABLE} AS crc_table)),
turn AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(b.n, 0)), o.role, o.text
  FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h LEFT JOIN conv b ON b.conv_id = c.base),
prefix AS (
  SELECT conv_id, pos + 1 AS depth, sha256(CAST(to_json(list([role, text]) OVER (PARTITION BY conv_id ORDER BY pos)) AS VARCHAR)) AS key,
    len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM turn
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM conv),
linked AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(key) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM prefix),
node AS (
  SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM linked GROUP BY key),
child AS (SELECT parent AS key, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent),
counted AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN child ON child.key = node.key),
total AS (
  SELECT up.key, CAST(sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((x.n_convs - 1) * x.words) AS BIGINT) AS saved_tokens
  FROM counted x JOIN prefix up ON up.conv_id = x.conv_id AND up.depth <= x.depth GROUP BY up.key)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM counted x JOIN total ON total.key = x.key LEFT JOIN node p ON p.key = x.parent
"""
