"""Best-fit packing of token sequences into bins of several permitted capacities.

Lengths are whole numbers up to the largest capacity, so best-fit-decreasing needs only their *histogram*: equal
pieces are interchangeable, and bins with the same room left are handled together as ranges of bin numbers. The plan
is worked out from the histogram, whose size the largest capacity bounds, whatever the corpus; Spark counts the
histogram, ranks the pieces of each length, and looks every piece up in the plan. Nothing is packed per partition, so
results don't depend on how rows are dealt out.

The plan takes lengths from long to short. A piece goes into the open bin with the least room that holds it. Where
none does, a bin is opened: for each permitted capacity the filling from the pieces still to come is simulated, and
the capacity with the least cost for each token it would hold is taken, so all capacities are weighed jointly.
Finally each bin is downsized to the least permitted capacity that holds its contents. A bin's cost is
``capacity + overhead``. A simulated filling goes from one length to the next that still fits, so it takes about the
square root of twice the capacity in steps at most, and an opening is followed by bins for all equal pieces at once.

Documents longer than the largest capacity are cut into pieces of that capacity and a rest; no token is dropped.

The plan is broadcast if it has BROADCAST rows at most, and joined by sorting else.

Edge cases: documents of length zero or null (null text) get one row without a bin (null ``bin_id``, ``n_tokens`` 0), a
negative length counts as zero. Ties in length are ordered by ``doc_id`` and a hash of the text; repeated rows are
packed each. Very long texts are cut like any others. An empty table gives an empty one. Columns of the input named
like the outputs are replaced, all others but ``text`` kept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.llm.common import Rows, materialize

CAPACITIES = (512, 1024, 2048, 4096)
OUTPUTS = ("piece", "n_tokens", "bin_id", "bin_offset", "capacity")
#: Rows of a plan that may be broadcast, some 50 bytes each.
BROADCAST = 1_000_000


class Plan:
    """Ranges of equal pieces placed into ranges of bins.

    ``places``: (length, first rank, number, first bin, offset in the bin); ``bins``: (first bin, number, capacity).
    """

    def __init__(self, histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = 16):
        self.capacities, self.overhead = sorted(set(capacities)), overhead
        self.left = {n: c for n, c in histogram.items() if c}
        self.lengths = sorted(self.left)
        self.places: list[tuple[int, int, int, int, int]] = []
        #: Room left -> ranges of bins (first bin, number, opened capacity); the rooms in order beside it.
        self.open: dict[int, list[tuple[int, int, int]]] = {}
        self.rooms: list[int] = []
        self.n_bins = 0
        for length in sorted(self.left, reverse=True):
            self.place_all(length)
        self.bins = sorted((first, n, self.least(size - room)) for room, ranges in self.open.items() for first, n, size in ranges)

    def least(self, used: int) -> int:
        return self.capacities[bisect_left(self.capacities, used)]

    def put(self, room: int, part: tuple[int, int, int]) -> None:
        if room not in self.open:
            self.open[room] = []
            insort(self.rooms, room)
        self.open[room].append(part)

    def opening(self, length: int) -> int:
        """The capacity that costs least for each token it would hold, filled from what is still to come."""
        lengths = self.lengths

        def cost(capacity: int) -> float:
            used, at = 0, bisect_right(lengths, length)
            # the longest that fits, all of it that fits, then the longest shorter one that fits what is left
            while at := bisect_right(lengths, capacity - used, 0, at):
                at -= 1
                n = lengths[at]
                used += n * min(self.left[n], (capacity - used) // n)
            return (self.least(used) + self.overhead) / used

        return min((c for c in self.capacities if c >= length), key=lambda c: (cost(c), -c))

    def place_all(self, length: int) -> None:
        count, rank = self.left[length], 0
        while rank < count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                capacity = self.opening(length)
                n = max(1, (count - rank) // (capacity // length))
                self.put(capacity, (self.n_bins, n, capacity))
                self.n_bins += n
                continue
            room = self.rooms[at]
            first, n, size = self.open[room].pop()
            take = min(n, count - rank)
            if take < n:
                self.open[room].append((first + take, n - take, size))
            elif not self.open[room]:
                del self.open[room]
                self.rooms.pop(at)
            self.places.append((length, rank, take, first, size - room))
            self.put(room - length, (first, take, size))
            rank += take
            self.left[length] = count - rank


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text: the length that the query packs by."""
    gaps = F.regexp_replace(text, r"[^ \t\n\x0B\f\r]+", "w")
    return F.coalesce(F.length(gaps) - F.length(F.regexp_replace(gaps, "w", "")), F.lit(0)).cast("long")


def pack(documents: DataFrame, length: Column, capacities: Sequence[int] = CAPACITIES, overhead: int = 16, salts: int = 256) -> DataFrame:
    """``documents`` without text, a row for each piece: ``piece`` (its number in the document), ``n_tokens``,
    ``bin_id``, ``bin_offset`` (tokens before it in the bin) and the bin's final ``capacity``.

    Ranks within a length are counted in ``salts`` parts, so that a length which a third of all pieces has is sorted
    in that many tasks.
    """
    spark, most = documents.sparkSession, max(capacities)
    kept = Rows(documents, OUTPUTS, drop=["text"])
    whole = documents.select(kept.row, F.col("doc_id").alias("id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n"), F.xxhash64("text").alias("tie"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")
    cut = (
        whole.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .withColumn("n_tokens", F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece").cast("long") * most))
        .withColumn("salt", F.pmod(F.xxhash64("id", "piece", "tie"), F.lit(salts)).cast("int")).drop("n")
    )
    cut = materialize(cut)
    counts = cut.where("n_tokens > 0").groupBy("n_tokens", "salt").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # at most (largest capacity) x salts numbers
    starts = materialize(counts.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))))
    # the histogram: at most as many rows as the largest capacity
    histogram = {r["n_tokens"]: r["c"] for r in starts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}
    places = plan_rows(Plan(histogram, capacities, overhead))
    schema = "length long, first long, last long, bin long, bin_offset long, capacity int"
    planned = spark.createDataFrame(places, schema)
    if len(places) <= BROADCAST:
        planned = F.broadcast(planned)
    within = Window.partitionBy("n_tokens", "salt").orderBy("id", "piece", "tie")
    ranked = (
        cut.withColumn("within", F.row_number().over(within) - 1)
        .join(starts.drop("c"), ["n_tokens", "salt"], "left").withColumn("rank", F.col("start") + F.col("within"))
    )
    placed = ranked.join(planned, (F.col("n_tokens") == F.col("length")) & F.col("rank").between(F.col("first"), F.col("last")), "left")
    at = F.col("bin") + F.col("rank") - F.col("first")
    return kept.unpacked(placed, "piece", "n_tokens", at.alias("bin_id"), "bin_offset", "capacity")


def plan_rows(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """The plan as (length, first and last rank, first bin, offset, capacity), split where the final capacity changes."""
    starts = [b[0] for b in plan.bins]
    rows = []
    for length, rank, n, first, offset in plan.places:
        k = bisect_left(starts, first + 1) - 1
        while n > 0:
            lo, size, capacity = plan.bins[k]
            take = min(n, lo + size - first)
            rows.append((length, rank, rank + take - 1, first, offset, capacity))
            rank, n, first, k = rank + take, n - take, first + take, k + 1
    return rows
