"""Language ID by rank-order profiles (Cavnar and Trenkle's out-of-place distance).

Text is lower-cased, everything but letters becomes one space, and the n-grams of one to three code points are
counted, those of nothing but space left out. A profile is the ``size`` most frequent n-grams in order, ties by code
points. The distance of a document to a language adds up, over the document's profile, how far each n-gram is from
its place in the language's profile; an n-gram missing there counts ``size``. The least distance wins, ties go to the
language that sorts first. ``score`` is one minus that distance over the largest possible one.

Language profiles are counted in Spark over all labelled documents outside the held-out fold; prediction is one pass over
whole texts without a shuffle.

Edge cases: a null text, an empty one, and one without any letter get ``und`` and score 0; so does every text when
nothing was learnt. Texts are read whole, however long; rows are judged independently, so ties and repeats get equal
results. Rows without a language teach nothing. An empty table gives an empty one. Columns of the input named like the
outputs are replaced, all others kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.llm.common import Rows, held_out, small_batches

UNKNOWN = "und"
SPACE, BITS = 32, 21
#: N-grams in a profile.
SIZE = 300
#: Of the bounds below which a text is in no learnt language: see ``bounds``.
QUANTILE, SLACK, ENOUGH, LONGEST = 0.01, 0.6, 20, 12
#: Decimals of the scores that quantiles are taken of, so that their counts are few however many the documents.
DIGITS = 4


@functools.cache
def folding() -> np.ndarray:
    """For each code point its lower-case letter, or SPACE if it is no letter."""
    out = np.full(0x110000, SPACE, np.uint64)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            low = c.lower()
            out[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    return out


def letters(text: str | None) -> np.ndarray:
    """Folded code points with single spaces around and between the runs of letters; empty without letters."""
    codes = folding()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = np.concatenate(([SPACE], codes, [SPACE])).astype(np.uint64)
    keep = codes != SPACE
    keep[1:] |= codes[:-1] != SPACE
    keep[0] = True
    codes = codes[keep]
    return codes if len(codes) > 2 else codes[:0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams in ascending order, and how often each occurs."""
    one = letters(text)
    if not len(one):
        return one, np.zeros(0, np.int64)
    two = one[:-1] << np.uint64(BITS) | one[1:]
    three = two[:-1] << np.uint64(BITS) | one[2:]
    parts = [(np.sort(x), x) for x in (one[one != SPACE], two, three)]
    grams, counts = [], []
    for x, _ in parts:
        starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
        grams.append(x[starts])
        counts.append(np.diff(np.concatenate((starts, [len(x)]))))
    return np.concatenate(grams), np.concatenate(counts)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent n-grams in order; of equally frequent ones the lower code points first."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """The profiles of all languages, laid out for one lookup of a document's n-grams in all of them."""

    def __init__(self, by_language: dict[str, list[int]], size: int = SIZE):
        self.size, self.languages = size, sorted(by_language)
        self.grams = np.unique(np.array([g for v in by_language.values() for g in v], np.uint64))
        self.rank = np.full((len(self.languages), len(self.grams) + 1), -1, np.int64)
        for k, language in enumerate(self.languages):
            own = np.array(by_language[language], np.uint64)
            self.rank[k, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def judge(self, text: str | None) -> tuple[str, float]:
        own = ranked(*ngrams(text), self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        rank = self.rank[:, at]
        distance = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own)))).sum(1)
        best = int(distance.argmin())
        return self.languages[best], 1 - float(distance[best]) / (self.size * len(own))


def teaches(lang: Column, doc_id: Column) -> Column:
    """Whether a row is one that profiles and bounds are learnt from: all with a language, outside the held-out fold."""
    return lang.isNotNull() & ~held_out(doc_id)


def fit(documents: DataFrame, size: int = SIZE) -> Profiles:
    """Profiles from all labelled documents outside the held-out fold.

    The driver receives ``size`` n-grams for each language.
    """
    texts = documents.where(teaches(F.col("lang"), F.col("doc_id")) & F.col("text").isNotNull()).select("lang", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, rows in batch.groupby("lang"):
                parts = [ngrams(t) for t in rows["text"]]
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                yield pd.DataFrame({"lang": language, "gram": grams.astype(np.int64), "n": n})

    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (
        texts.mapInPandas(counted, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("k", F.row_number().over(by_count)).where(F.col("k") <= size)
    )
    out: dict[str, list[int]] = {}
    with small_batches(documents.sparkSession):
        rows = top.collect()
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(out, size)


def identify(spark: SparkSession, documents: DataFrame, profiles: Profiles) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``."""
    shared = spark.sparkContext.broadcast(profiles)  # some hundred numbers for each language

    @F.pandas_udf("lang_pred string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.judge(t) for t in texts], columns=["lang_pred", "score"])

    rows = Rows(documents, ("lang_pred", "score"))
    return rows.unpacked(documents.select(rows.row, judged.asNondeterministic()("text").alias("judged")), "judged.lang_pred", "judged.score")


def length_class(text: Column) -> Column:
    """The binary logarithm of a text's length, LONGEST at most; 0 for texts without characters."""
    return F.coalesce(F.least(F.floor(F.log2(F.greatest(F.length(text), F.lit(1)))), F.lit(LONGEST)), F.lit(0)).cast("int")


def bounds(judged: DataFrame, slack: float = SLACK) -> DataFrame:
    """(lang_pred, length_class, bound): the score below which a text is not taken for one of that language.

    ``judged`` has doc_id, lang, lang_pred, score and length_class. The bound is ``slack`` times the QUANTILE of the scores
    that all documents which taught the profiles have in their own language: the lesser of that over all lengths and, where
    ENOUGH of them are of the length class, over the class (long texts with much junk score far below other long ones).
    """
    own = judged.where(teaches(F.col("lang"), F.col("doc_id")) & (F.col("lang") == F.col("lang_pred")) & (F.col("lang_pred") != UNKNOWN))
    found = own.rollup("lang_pred", "length_class").agg(F.percentile(F.round("score", DIGITS), QUANTILE).alias("q"), F.count("*").alias("n"))
    # at most LONGEST + 2 numbers for each language
    low = {(r["lang_pred"], r["length_class"]): r["q"] for r in found.where("lang_pred is not null").collect() if r["length_class"] is None or r["n"] >= ENOUGH}
    rows = [(name, k, slack * min(q, low.get((name, k), q))) for (name, every), q in low.items() if every is None for k in range(LONGEST + 1)]
    return judged.sparkSession.createDataFrame(rows, "lang_pred string, length_class int, bound double")
