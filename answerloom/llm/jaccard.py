"""N-gram Jaccard join by a prefix tree, and the groups that its links make.

A document's set is its distinct word shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``), each a 64-bit hash.
Two documents link when their sets' Jaccard similarity is at least ``num / den``. The result is exact but for 64-bit
hash collisions; no partner, candidate or group is capped.

1. *Classes.* Equal sets get one class, numbered by a hash of the set, so any number of copies costs one row from
   here on.
2. *Global order.* Shingles are ordered by how often they occur in a sample of documents (those that occur less than
   three times there count zero), then by hash. Any order gives the same result; this one puts what many documents
   share last.
3. *Shared prefixes.* If two sets link, their prefixes of ``n - ceil(t*n) + s`` shingles have s in common, for any s
   up to ``t*n``; here s is one in SHARE of the smaller set's shingles. Prefix shingles of one class only go, and so do
   classes that have less than s of the rest. So a passage that many documents share makes none of them a candidate unless
   it is half of the text or so. The smaller set of a pair has the shared ones in a shorter prefix yet, of
   ``n - ceil(2t/(1+t)*n) + s``, since its partner is as large at least: shingles that no class has there go, too, and with
   them texts that share a passage of less than ``2t/(1+t)`` of each. Shingles that the sample holds as frequent, FREQUENT at most, never meet in a task: their
   least and greatest classes are aggregated and broadcast. The others are shuffled and meet by shingle.
4. *Blocks.* A shingle's block is named by its least class. A class enters the blocks of its shingles, but
   for the smallest of them as long as those hold less than half of s: two linked classes still meet in one block.
5. *Walks.* Blocks are dealt, by a hash, into parts of SETS sets (fewer where they would hold more than PART shingles). A
   part's sets are stored in a trie, which a few sets near the part's centre walk first, and then all that these leave
   outside of the part's largest component. So a family of near copies takes a few walks, and only links that join
   components are put out, never a family's pairs. Up to four sets of a block, its *references*, are in all of its parts,
   so that the parts of a family meet. What is then outside of the largest component of a block in parts walks through
   the whole block, in parts of WIDE sets: each link inside the block has an end there, or is inside that component.
6. *Components* of all links.

The trie holds each set as what it and the part's centre differ in, most frequent shingle first, as sorted sequences with
the lengths of the paths that they share (``Trie``). All walkers walk at once: the overlaps counted on a shared path are
taken over for all sequences below it, a walker is dropped where the overlap so far plus the most that the remaining
lengths could add is too small, and a subtree is skipped when none is left.

Documents that share most of their text, but not enough to link, are candidates of one another. They differ from their
centre in little, and from one another nearly wherever they differ from it, so a walk through their trie counts few
overlaps: 6,000 texts of 200 words that share 95 % take 2.2 seconds in one trie, 3,000 take 1.1 and 1,500 take 0.6.

Rare shingles meet in a window by shingle. None of them is in more than about one text of a thousand, else the sample would
hold it, so a task that gets one has hardly more than others, each of which gets tens of rows for each text it stands for.

Edge cases: documents without words (null, empty, blank) have an empty set and link with nothing, so are their own
component; fewer words than ``k`` make one shingle. Repeated rows and ties are members of the same class. A row with a
null ``doc_id`` is in a class like any other, but can't name it: ``component_id`` is the least non-null id of its
component; a class without any id links with nothing, and its ``component_id`` is null. Very long texts are read whole.
An empty table gives an empty one. Other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.llm.common import materialize, small_batches
from answerloom.llm.components import connected_components

#: Prefix shingles that linked sets are made to share: one in SHARE of the smaller set's, LEVEL at least (fewer where
#: the smallest sets that can link share fewer).
LEVEL, SHARE = 4, 10
#: Sets, and shingles, that a part of a block has, about: its trie is held in memory.
SETS, PART = 200, 2_000_000
#: Sets near the centre of a part that walk first.
FIRST = 4
#: Sets of a part when what is outside of a block's largest component walks through it, and how many of those at once.
WIDE, PASSING = 10_000, 2_000
#: Shingles that the sample holds as frequent, at most: so many numbers are broadcast.
FREQUENT = 200_000
#: Hash buckets of the filter before the second read of texts: at most so many numbers are broadcast.
BUCKETS = 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The set of a text's shingle hashes, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(w))
    m = len(w) - k + 1
    h = np.full(m, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + m]) * PRIME
        h ^= h >> np.uint64(29)
    return np.unique(h)


def node_of(own: np.ndarray) -> int | None:
    """A set's number, as a signed 64-bit integer; none for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)) if len(own) else None


def sliced(batches: Iterator[pd.DataFrame], rows: int = 1_000) -> Iterator[pd.DataFrame]:
    """Batches of fewer rows: a task holds the sets of so many texts at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows].reset_index(drop=True)


def some_of(sets: Iterator[tuple[int, np.ndarray]]) -> Iterator[dict[int, np.ndarray]]:
    """Sets by PASSING, or fewer where they would hold more than PART shingles."""
    some, held = {}, 0
    for node, own in sets:
        some[node] = own
        held += len(own)
        if len(some) >= PASSING or held >= PART:
            yield some
            some, held = {}, 0
    if some:
        yield some


class Order:
    """The global order: shingles with their sampled frequencies, all others zero."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        at = np.argsort(hashes)
        self.hashes, self.counts = hashes[at], np.minimum(counts[at], 65_535).astype(np.uint16)

    def counts_of(self, own: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(own), np.uint16)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return np.where(self.hashes[at] == own, self.counts[at], 0)

    def rarest_first(self, own: np.ndarray) -> np.ndarray:
        """An ascending set in global order."""
        return own[np.argsort(self.counts_of(own), kind="stable")]


def fit_order(documents: DataFrame, k: int, sample: int = 6_000, most: int = FREQUENT) -> Order:
    """Frequencies in ``sample`` documents at most; it bears on the speed only, never on the links."""
    chosen = documents.where("text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    # at most `sample` ids, by the limit
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_of = np.concatenate([shingles(t, k) for t in batch["text"]] or [np.zeros(0, np.uint64)])
            h, n = np.unique(all_of, return_counts=True)
            yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    counts = texts.mapInPandas(listed, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 3")
    top = counts.orderBy(F.desc("n"), "h").limit(most).toArrow()
    return Order(top["h"].to_numpy().view(np.uint64), top["n"].to_numpy())


class Trie:
    """Sets as a trie of their differences from the part's centre, walked with many sets at once.

    The *centre* holds the shingles of more than half of the sets. A set's difference has the centre's shingles that it
    lacks and its own that the centre lacks; two sets differ in what is in one of their differences only. So near copies,
    whose sets overlap nearly wholly, become short sequences that overlap only where they differ in the same way, and
    whether two sets of p and n shingles with differences of d and e link follows from the overlap of their differences:
    it must be ``need(p, n) - (p + n - d - e) / 2`` at least.

    A sequence holds what several differences have, most frequent first; sorted, each shares a path with the one before.
    If ``others`` are to walk, it holds what a single difference has, too.
    """

    def __init__(self, sets: dict[int, np.ndarray], num: int, den: int, others: bool = False):
        self.num, self.den, self.steps = num, den, 0
        keys, sizes, flat = listed(sets)
        self.universe, flat = np.unique(flat, return_inverse=True)
        self.central = 2 * np.bincount(flat, minlength=len(self.universe)) > len(keys)
        row, of, d = self.differences(sizes, flat)
        n = np.bincount(of, minlength=len(self.universe))
        shared = np.flatnonzero(n > (0 if others else 1))
        self.rank = np.full(len(self.universe), -1, np.int64)  # most frequent first; -1: in no sequence
        self.rank[shared[np.argsort(-n[shared], kind="stable")]] = np.arange(len(shared))
        paths = self.sequences(len(keys), row, of)
        at = sorted(range(len(keys)), key=lambda i: paths[i].astype(">i8").tobytes())
        self.keys, self.paths = [keys[i] for i in at], [paths[i] for i in at]
        self.sizes, self.differing = sizes[at], d[at]
        self.place = {k: i for i, k in enumerate(self.keys)}
        self.depths = []  # of the node where a sequence leaves the one before it
        before = flat[:0]
        for own in self.paths:
            m = min(len(before), len(own))
            differ = np.flatnonzero(before[:m] != own[:m])
            self.depths.append(int(differ[0]) if len(differ) else m)
            before = own
        # for each sequence the next one that leaves its predecessor's path nearer to the root
        self.after, open_ = [len(self.keys)] * len(self.keys), []
        for i, depth in enumerate(self.depths):
            while open_ and self.depths[open_[-1]] > depth:
                self.after[open_.pop()] = i
            open_.append(i)
        # a set's part of the bounds: what the other must overlap with it, and that less its path's length
        self.asks = self.bound(self.sizes, self.differing)
        self.rests = self.asks - np.fromiter(map(len, self.paths), np.int64, len(self.paths))

    def bound(self, n: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Of two such numbers the sum is the least overlap of differences for which sets link, but for rounding."""
        return d / 2 - n / 2 + self.num * n / (self.num + self.den)

    def differences(self, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shingle) of all rows' differences, and each row's number of them; ``flat``: shingles, -1 outside of the
        universe."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        inside = flat >= 0
        core = np.zeros(len(flat), bool)
        core[inside] = self.central[flat[inside]]
        centre = np.flatnonzero(self.central)
        has = np.zeros((len(sizes), len(centre)), bool)
        has[row[core], np.searchsorted(centre, flat[core])] = True
        lacking, what = np.nonzero(~has)
        d = sizes - has.sum(axis=1) + np.bincount(lacking, minlength=len(sizes))
        own = inside & ~core
        return np.concatenate([row[own], lacking]), np.concatenate([flat[own], centre[what]]), d

    def sequences(self, rows: int, row: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
        """Each row's shared shingles by rank."""
        rank = self.rank[of]
        row, rank = row[rank >= 0], rank[rank >= 0]
        by = np.lexsort((rank, row))
        return np.split(rank[by], np.cumsum(np.bincount(row, minlength=rows))[:-1])

    def nearest(self, most: int) -> list[int]:
        """The keys that differ least from the centre."""
        return [self.keys[i] for i in np.lexsort((np.arange(len(self.keys)), self.differing))[:most]]

    def probes(self, keys: list[int]) -> tuple:
        """Sets of the trie, as ``walk`` takes them."""
        at = [self.place[k] for k in keys]
        return keys, [self.paths[i] for i in at], self.sizes[at], self.differing[at]

    def outside(self, sets: dict[int, np.ndarray]) -> tuple:
        """Other sets, as ``walk`` takes them."""
        keys, sizes, flat = listed(sets)
        at = np.minimum(np.searchsorted(self.universe, flat), len(self.universe) - 1)
        row, of, d = self.differences(sizes, np.where(self.universe[at] == flat, at, -1))
        return keys, self.sequences(len(keys), row, of), sizes, d

    def walk(self, probes: tuple, step: int = 512) -> Iterator[tuple[int, np.ndarray]]:
        """(key, the places among the probes of those that link to it), for every key that any links to.

        All probes walk at once: the overlaps counted at a node hold for all sequences below it, a probe is dropped where
        the remaining lengths can't add enough for any of them, and a subtree is skipped when no probe is left.
        """
        names, paths, sizes, differing = probes
        count = np.fromiter(map(len, paths), np.int64, len(paths))
        flat = np.concatenate([*paths, np.zeros(0, np.int64)]).astype(np.int64)
        by = np.argsort(flat, kind="stable")  # the probes that have a shingle, by its rank
        having = np.repeat(np.arange(len(paths)), count)[by]
        n_having = np.bincount(flat, minlength=int(self.rank.max(initial=-1)) + 1)
        first = np.cumsum(n_having) - n_having
        asked = self.bound(sizes, differing)
        slack = 1e-6
        able = count >= asked + self.asks.min() - slack

        def counted(overlap: np.ndarray, chunk: np.ndarray) -> np.ndarray:
            self.steps += 1
            chunk = chunk[n_having[chunk] > 0]
            n = n_having[chunk]
            at = np.repeat(first[chunk] - np.cumsum(n) + n, n) + np.arange(n.sum())
            return overlap + np.bincount(having[at], minlength=len(paths)) if len(at) else overlap

        # (depth, overlaps, whether a probe is still there) at the nodes above that sequences yet to come branch from
        held = [(0, np.zeros(len(paths), np.int64), able)]
        i, last = 0, len(self.keys)
        while i < last:
            while held[-1][0] > self.depths[i]:
                held.pop()
            depth, overlap, there = held[-1]
            own, branches = self.paths[i], []
            j = i + 1
            while j < last and self.depths[j] > depth:  # nodes on this path that later sequences branch from
                branches.append((self.depths[j], self.after[j]))
                j = self.after[j]
            go_on = None
            for at, end in [*reversed(branches), (len(own), i + 1)]:
                rests = self.rests[i] if end == i + 1 else self.rests[i:end].min()
                there = there & (overlap - depth >= asked + rests - slack)
                while depth < at and there.any():
                    overlap = counted(overlap, own[depth : min(at, depth + step)])
                    depth = min(at, depth + step)
                    there = there & (overlap - depth >= asked + rests - slack)
                if not there.any():
                    go_on = end
                    break
                if end > i + 1:
                    held.append((depth, overlap, there))
            if go_on is None:
                at = np.flatnonzero(there)
                need = -(-self.num * (self.sizes[i] + sizes[at]) // (self.num + self.den))
                linked = at[2 * overlap[at] >= 2 * need - (self.sizes[i] + sizes[at]) + self.differing[i] + differing[at]]
                if len(linked):
                    yield self.keys[i], linked
            i = go_on or i + 1


def listed(sets: dict[int, np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The keys, sizes and all shingles of some sets."""
    return list(sets), np.fromiter(map(len, sets.values()), np.int64, len(sets)), np.concatenate([*sets.values(), np.zeros(0, np.int64)])


class Union:
    """Disjoint sets of keys, as labels."""

    def __init__(self, keys: Iterable[int]):
        self.place = {k: i for i, k in enumerate(keys)}
        self.label = np.arange(len(self.place))

    def join(self, key: int, others: np.ndarray) -> list[int]:
        """Joins ``key`` with those at the places ``others``; a place of each component that it wasn't joined with before."""
        own, labels = self.label[self.place[key]], self.label[others]
        if (labels == own).all():
            return []
        different, at = np.unique(labels, return_index=True)
        new = [int(others[k]) for k, label in zip(at, different, strict=True) if label != own]
        self.label[np.isin(self.label, different)] = own
        return new

    def outside(self) -> list[int]:
        """The keys that aren't in the largest component."""
        largest = np.bincount(self.label).argmax()
        return [k for k, i in self.place.items() if self.label[i] != largest]


def spanning_links(sets: dict[int, np.ndarray], num: int, den: int) -> tuple[list[tuple[int, int]], Trie]:
    """Links between ``sets`` that connect whatever all their links connect.

    First a few sets near the centre walk; then all that aren't in the largest component. Every other link is inside it.
    """
    trie, links = Trie(sets, num, den), []
    union = Union(trie.keys)
    for walkers in (lambda: trie.nearest(FIRST), union.outside):
        names = walkers()
        places = np.array([union.place[k] for k in names], np.int64)
        for key, linked in trie.walk(trie.probes(names)) if names else ():
            links += [(key, trie.keys[at]) for at in union.join(key, places[linked])]
    return links, trie


def block_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links within each part of each block. ``rows``: (lead, part, node, set)."""
    dealt = rows.repartition("lead", "part").sortWithinPartitions("lead", "part")

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (r for batch in batches for r in zip(*[batch[c] for c in ("lead", "part", "node", "set")], strict=True))
        out: list[tuple[int, int]] = []
        for _, group in groupby(each, key=lambda r: r[:2]):
            out += spanning_links({node: np.asarray(s, np.int64) for *_, node, s in group}, num, den)[0]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.select("lead", "part", "node", "set").mapInPandas(walked, "a long, b long")


def links_across(outside: DataFrame, places: DataFrame, blocks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links of the classes ``outside`` (node, lead) with all others of their block; ``places``: (node, lead),
    ``blocks``: (lead, wide).

    Blocks are dealt anew, into ``wide`` parts of WIDE sets about: most have one. A part's trie is held, and what is
    outside walks through each part of its block, PASSING sets at once.
    """
    own = F.pmod(F.xxhash64("lead", "node"), F.col("wide")).cast("int").alias("part")
    wide = blocks.join(outside.select("lead").distinct(), "lead", "left_semi").select("lead", "wide")
    held = places.select("node", "lead").join(wide, "lead").select("lead", own, "node", F.lit(0).alias("role"))
    passing = outside.select("node", "lead").join(wide, "lead").select("lead", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("part"), "node", F.lit(1).alias("role"))
    dealt = held.unionByName(passing).join(sets.select("node", "set"), "node").repartition("lead", "part").sortWithinPartitions("lead", "part", "role")

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (r for batch in batches for r in zip(*[batch[c] for c in ("lead", "part", "role", "node", "set")], strict=True))
        for _, group in groupby(each, key=lambda r: r[:2]):
            trie = None
            for role, members in groupby(group, key=lambda r: r[2]):
                sets_of_role = ((node, np.asarray(s, np.int64)) for *_, node, s in members)
                if role == 0:
                    trie = Trie(dict(sets_of_role), num, den, others=True)
                    continue
                for some in some_of(sets_of_role) if trie is not None else ():
                    probes = trie.outside(some)
                    union = Union({**trie.place, **some})
                    found = []
                    keys, places_of = list(union.place), np.array([union.place[k] for k in probes[0]], np.int64)
                    for key, linked in trie.walk(probes):
                        found += [(key, keys[at]) for at in union.join(key, places_of[linked])]
                    yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.select("lead", "part", "role", "node", "set").mapInPandas(walked, "a long, b long")


def similarity_groups(spark: SparkSession, documents: DataFrame, k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """A row per document: ``doc_id``, ``n_shingles``, ``component_id`` (the least id reachable by links)."""
    order = spark.sparkContext.broadcast(fit_order(documents, k))  # at most 200,000 numbers and counts
    # the least overlap of two different sets that link: that of sizes s and s + 1, with s / (s + 1) just large enough
    level = min(LEVEL, -(-num // (den - num)))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in sliced(batches):
            nodes, sizes, heads, often, shorts = [], [], [], [], []
            for text in batch["text"]:
                own = shingles(text, k)
                n = len(own)
                node = node_of(own)
                head = frequent = short = None
                # a set so small that nothing but an equal one can link needs no prefix; a class needs one in each task
                if n and (num * n <= den * (n - 1) or num * (n + 1) <= den * n) and node not in seen:
                    seen.add(node)
                    s = max(level, n // SHARE)
                    prefix = order.value.rarest_first(own)[: n - -(-num * n // den) + s]
                    short = n - -(-2 * num * n // (num + den)) + s  # so many of them if its partner is as large at least
                    known = order.value.counts_of(prefix) > 0
                    head, frequent = prefix[~known].view(np.int64), prefix[known].view(np.int64)
                nodes.append(node)
                sizes.append(n)
                heads.append(head)
                often.append(frequent)
                shorts.append(short)
            ids, nodes, shorts = batch["doc_id"].astype("Int64"), pd.array(nodes, "Int64"), pd.array(shorts, "Int32")
            yield pd.DataFrame({"doc_id": ids, "n": sizes, "node": nodes, "head": heads, "often": often, "short": shorts})

    schema = "doc_id long, n int, node long, head array<long>, often array<long>, short int"
    with small_batches(spark):
        rows = materialize(documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(prefixes, schema))
    classes = materialize(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n")))
    sizes = classes.select("node", "n")
    # what a pair must share, by its smaller set's size; of a set whose partner is unknown, by the smallest partner's
    shared = lambda n: F.greatest(F.lit(level), F.floor(n / SHARE))
    smallest = F.ceil(F.col("n") * num / den)

    # prefix shingles that several classes have, and classes with enough of them
    heads = rows.where("head is not null")  # a class has as many as tasks have seen it, so what follows counts distinct shingles
    of_token = Window.partitionBy("token")
    ends = {"lead": F.min("node"), "last": F.max("node"), "near": F.max("near")}  # `near`: whether it is in a shorter prefix
    rare = heads.select("node", "short", F.posexplode("head").alias("at", "token")).select("node", "token", (F.col("at") < F.col("short")).alias("near"))
    rare = rare.select("node", "token", *[end.over(of_token).alias(name) for name, end in ends.items()])
    often = heads.select("node", (F.col("short") - F.size("head")).alias("short"), F.posexplode("often").alias("at", "token")).select("node", "token", (F.col("at") < F.col("short")).alias("near"))
    led = often.groupBy("token").agg(*[end.alias(name) for name, end in ends.items()])  # FREQUENT rows at most
    common = rare.unionByName(often.drop("near").join(F.broadcast(led), "token"))
    common = materialize(common.where("lead != last and near").select("node", "token", "lead"))
    enough = common.groupBy("node").agg(F.count_distinct("token").alias("c")).join(sizes, "node").where(F.col("c") >= shared(smallest))
    enough = materialize(enough.select("node"))

    # the blocks that a class enters: all of its shingles' but the smallest, while those hold less than half of `shared`
    smaller = Window.partitionBy("node").orderBy("c", "lead").rowsBetween(Window.unboundedPreceding, 0)
    entered = (
        common.join(enough, "node", "left_semi").groupBy("node", "lead").agg(F.count_distinct("token").alias("c"))
        .withColumn("dropped", F.sum("c").over(smaller)).join(sizes, "node").where(F.col("dropped") > F.floor((shared(smallest) - 1) / 2))
    )
    entered = materialize(entered.select("node", "lead", "n"))
    by_hash = F.xxhash64("node")
    four = F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", by_hash), F.max_by("node", by_hash)))
    parts = F.ceil(F.greatest(F.count("*") / SETS, F.sum("n") / PART)).cast("int")
    wide = F.ceil(F.greatest(F.count("*") / WIDE, F.sum("n") / PART)).cast("int")
    blocks = materialize(entered.groupBy("lead").agg(F.count("*").alias("c"), parts.alias("parts"), wide.alias("wide"), four.alias("references")).where("c > 1").drop("c"))
    part_of = F.pmod(F.xxhash64("node", "lead"), F.col("parts")).cast("int")
    places = materialize(entered.join(blocks.drop("references", "wide"), "lead").select("node", "lead", part_of.alias("part"), "parts"))
    tasks = places.groupBy("node").agg(F.collect_list(F.struct("lead", "part")).alias("tasks"))
    wanted = tasks.join(classes, "node").select(F.col("least_id").alias("doc_id"), F.col("node").alias("want"), "tasks")
    sets = sets_of(documents, order, materialize(wanted), k)
    met = sets.select("node", "set", F.explode("tasks").alias("t")).select("t.lead", "t.part", "node", "set")
    split = blocks.where("parts > 1")
    if not split.isEmpty():
        referred = split.select("lead", "parts", F.explode("references").alias("node")).select("lead", "node", part_of.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        met = met.unionByName(referred.where("part != own").join(sets, "node").select("lead", "part", "node", "set"))
    groups = connected_components(block_links(met, num, den))
    if not split.isEmpty():
        of_split = places.where("parts > 1").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        counted = of_split.groupBy("lead", "root").agg(F.count("*").alias("c"))
        largest = counted.groupBy("lead").agg(F.max_by("root", F.struct("c", "root")).alias("largest"))
        outside = materialize(of_split.join(largest, "lead").where("root != largest").select("node", "lead"))
        if not outside.isEmpty():
            groups = joined(groups, links_across(outside, of_split, blocks, sets, num, den))
    named = classes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    component = materialize(named.select("node", "root").join(least, "root").select("node", "component_id"))
    whole = rows.select("doc_id", "n", "node").join(component, "node", "left")
    return whole.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of ``groups``, whose components further ``links`` (a, b) join."""
    links = materialize(links)
    of = lambda c: groups.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    later = materialize(connected_components(ends))
    known = groups.join(later.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    # roots that were alone till now
    return materialize(known.unionByName(later.join(groups.select("node"), "node", "left_anti")))


def sets_of(documents: DataFrame, order, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set, tasks) of the wanted (doc_id, want, tasks), the set most frequent shingle first; one document of
    each is read again."""
    # most other texts are kept out of the join by a filter on hashed ids; BUCKETS bounds what is broadcast
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("_bucket")
    near = documents.select(F.col("doc_id").cast("long"), "text").select("*", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "_bucket", "left_semi")
    texts = near.drop("_bucket").join(wanted.hint("shuffle_hash"), "doc_id")

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            own = [shingles(t, k) for t in batch["text"]]
            nodes = [node_of(s) for s in own]
            keep = [i for i, (node, want) in enumerate(zip(nodes, batch["want"], strict=True)) if node == want]
            yield pd.DataFrame({
                "node": pd.Series([nodes[i] for i in keep], dtype="int64"),
                "set": [order.value.rarest_first(own[i])[::-1].view(np.int64) for i in keep],
                "tasks": batch["tasks"].iloc[keep].tolist(),
            })

    schema = "node long, set array<long>, tasks array<struct<lead: long, part: int>>"
    with small_batches(documents.sparkSession):
        return materialize(texts.select("text", "want", "tasks").mapInPandas(ordered, schema))


#: DuckDB SQL for the query: all pairs that share a shingle, and what is reachable by their links.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS own FROM d),
n AS (SELECT doc_id, CAST(len(own) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(own) AS shingle FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inside FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * inside >= 90 * (na.n + nb.n - inside)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.doc_id)
SELECT r.doc_id, any_value(n) AS n_shingles, min(root) AS component_id FROM reach r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
