"""Benchmark decontamination by winnowing, in DataFrame functions throughout.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A *window* is ``span`` consecutive
words of an item; an item of fewer words is one window. A document's word inside any occurrence of a window is *hit*.

1. *Fingerprints.* Of every ``gap`` neighbouring k-gram hashes the least is kept (winnowing). With
   ``k + gap - 1 = span`` any shared run of ``span`` words has all the k-grams of one such neighbourhood in common, so
   the same least hash on both sides: no sufficiently long shared run can be missed. Items shorter than ``span`` have
   their own, shorter, k and gap; documents are winnowed once for every length that occurs (one to ``span`` of them).
2. *Join.* The documents' distinct fingerprints meet those of the items in a semi-join. Spark broadcasts the items' if
   they are small and sorts both sides if not. What is left are the *candidates*, told apart by a hash of the text, so
   that copies are looked at once.
3. *Extension.* Items are reduced to their distinct windows, each with its fingerprint. Around every place in a candidate
   whose fingerprint an item has, the hit is extended to the window that the fingerprint is the least hash of: places
   and windows meet by fingerprint and a hash of the whole window, and their words are then compared. A place meets one
   window at most, so a fingerprint that many places and many items have makes no pairs of them.
4. *Counts.* Overlapping windows are merged with a running maximum of their ends. Windows that the same items have are
   one *set*, documents with the same sets one *family*; items are listed once for each family, not for each document.

Edge cases: null texts, and texts without words, have no words and no hits; items without words have no windows, and
an item id that repeats counts once, with the windows of all its rows. A null item id has no name and is left out.
Repeated documents, and several texts under one id, are judged by their own text each. An empty benchmark leaves all
documents clean; an empty table gives an empty one. Very long texts are read whole: a text's places are rows. Columns of
the input named like the outputs are replaced, all others but ``text`` kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.common import Rows, ascii_lower, materialize

SPAN, GRAM = 10, 5
#: What parts words; the first is for texts before A-Z are lower-cased.
NOT_WORDS_RAW, NOT_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OUTPUTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), NOT_WORDS), "")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORDS_RAW), "")).cast("long")


class Hashes:
    """Hashes of all runs of so many words, and least ones of neighbouring runs, as array columns of ``df``, in order.

    Each array is made from two shorter ones that are columns already, so that each step is evaluated once: runs of m
    words from runs of two lengths that add up to m, least hashes of m neighbours from those of fewer that overlap.
    """

    def __init__(self, df: DataFrame, words: str = "words"):
        self.df = df.withColumn("run1", F.transform(words, lambda w: F.xxhash64(w)))
        self.names = set(self.df.columns)

    def paired(self, name: str, a: str, b: str, step: int, width: int, what: Callable[[Column, Column], Column]) -> str:
        """The column ``name``: entry i is made of entry i of ``a`` and entry i + step of ``b``; it spans ``width`` words."""
        if name not in self.names:
            n = F.greatest(F.size("run1") - (width - 1), F.lit(0))
            self.df = self.df.withColumn(name, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(step + 1), n), what))
            self.names.add(name)
        return name

    def runs(self, m: int) -> str:
        """The hashes of m consecutive words."""
        if m == 1:
            return "run1"
        half = 1 << (m - 1).bit_length() - 1  # the largest power of two below m
        return self.paired(f"run{m}", self.runs(half), self.runs(m - half), half, m, lambda a, b: F.xxhash64(a, b))

    def prints(self, length: int) -> str:
        """The fingerprint of each window of so many words."""
        k, gap = scheme(length)
        grams = self.runs(k)

        def least(m: int) -> str:
            if m == 1:
                return grams
            half = 1 << (m - 1).bit_length() - 1
            return self.paired(f"least{m}of{k}", least(half), least(half), m - half, k + m - 1, lambda a, b: F.least(a, b))

        return least(gap)


def scheme(length: int) -> tuple[int, int]:
    """k and gap for windows of so many words."""
    k = min(GRAM, length)
    return k, length - k + 1


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def windows(texts: DataFrame, length: int) -> DataFrame:
    """The columns of ``texts`` with a row for each window of ``length`` of its ``words``: ``at``, ``print``, ``mark`` (a
    hash of the whole window)."""
    of = Hashes(texts)
    prints, marks = of.prints(length), of.runs(length)
    zipped = F.arrays_zip(F.col(prints).alias("print"), F.col(marks).alias("mark"))
    return of.df.where(F.size("words") >= length).select(*texts.columns, F.posexplode(zipped).alias("at", "pair")).select(*texts.columns, "at", F.col("pair.print"), F.col("pair.mark"))


def window_at(length: Column | int) -> Column:
    return F.array_join(F.slice("words", F.col("at") + 1, length), " ")


def set_mark(member: Column) -> list[Column]:
    """Aggregates that tell sets of distinct members apart, whatever their order, without gathering them."""
    return [F.count("*").alias("size"), F.bit_xor(F.xxhash64(F.lit(1), member)).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), member)).alias("y")]


def contamination(documents: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """``documents`` without text, with OUTPUTS."""
    rows = Rows(documents, OUTPUTS, drop=["text"])
    nothing = F.sha2(F.lit(""), 256)
    counted = documents.select(rows.row, count_words(F.col("text")).alias("n_words"), text_key(F.col("text")).alias("key"))
    items = (
        benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
        .where("size(words) > 0").withColumn("length", F.least(F.size("words"), F.lit(span)))
    )
    items = materialize(items)
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # `span` numbers at most
    if not lengths:
        none = F.lit(0).cast("long")
        return rows.unpacked(counted, "n_words", none.alias("n_hit"), none.alias("n_items"), nothing.alias("items_sha256"), F.lit(False).alias("contaminated"))

    # windows of items, and the distinct ones with the mark of the set of items that have them
    owned = None
    for length in lengths:
        each = windows(items.where(F.col("length") == length), length).select("item", "length", "print", "mark", window_at(length).alias("window"))
        owned = each if owned is None else owned.unionByName(each)
    owned = materialize(owned.distinct())
    distinct = materialize(owned.groupBy("length", "print", "mark", "window").agg(*set_mark(F.col("item"))).select("*", F.struct("size", "x", "y").alias("set")).drop("size", "x", "y"))

    # 2: candidates, by the fingerprints of all lengths
    texts = documents.select("text").where("text is not null").withColumn("key", text_key(F.col("text")))
    of = Hashes(texts.select("key", words_of(F.col("text")).alias("words")))
    prints = [of.prints(length) for length in lengths]
    exploded = of.df.select("key", F.explode(F.array_distinct(F.flatten(F.array(*prints)))).alias("print"))
    candidates = materialize(exploded.join(distinct.select("print").distinct(), "print", "left_semi").select("key").distinct())

    # 3: the windows of the candidates that items have
    found = materialize(
        texts.join(candidates, "key", "left_semi").select("key", words_of(F.col("text")).alias("words")).dropDuplicates(["key"])
    )
    met = None
    for length in lengths:
        theirs = distinct.where(F.col("length") == length).drop("length")
        each = windows(found, length).select("key", "at", "print", "mark").join(theirs, ["print", "mark"]).select("key", "at", F.lit(length).alias("length"), "window", "set")
        met = each if met is None else met.unionByName(each)
    same = window_at(F.col("length")) == F.col("window")
    hits = materialize(materialize(met).join(found, "key").where(same).select("key", "at", (F.col("at") + F.col("length")).alias("end"), "set"))

    # 4: words in the union of the hit windows, and items by families
    earlier = Window.partitionBy("key").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("at", F.coalesce(F.max("end").over(earlier), F.lit(0))), F.lit(0))
    n_hit = hits.select("key", "at", "end").distinct().withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    sets = materialize(hits.select("key", "set").distinct())
    families = sets.groupBy("key").agg(*set_mark(F.struct("set"))).select("key", F.struct("size", "x", "y").alias("family"))
    results = materialize(n_hit.join(families, "key"))
    one = results.groupBy("family").agg(F.min("key").alias("key"))  # a document of each family, and its sets
    first = distinct.groupBy("set").agg(F.min("window").alias("window"))  # a window of each set, and its items
    members = first.join(owned.select("window", "item").distinct(), "window").select("set", "item")
    listed = (
        one.join(sets, "key").join(members, "set").select("family", "item").distinct().groupBy("family")
        .agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    )
    results = materialize(results.join(listed, "family").select("key", "n_hit", "n_items", "items_sha256"))
    return rows.unpacked(
        counted.join(results, "key", "left"), "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", nothing).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


#: DuckDB SQL for the query: all windows of all texts, joined.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, ms WHERE len(w) >= m)),
occ AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS place FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
