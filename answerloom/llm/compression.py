"""Quality rules: counted base rules, then compression bands.

A text's zstandard ratio is its UTF-8 size over its compressed size. Text that repeats itself compresses far better
than prose, random or encoded text hardly at all; how well prose compresses depends on its length, so the limits do
too. Each text is measured as a whole and in fixed chunks. It is rejected if the whole is outside the limits for its
size, or if at least ``chunk_share`` of its bytes are in chunks outside the limits for theirs, which finds junk inside
otherwise normal text. Every size has limits, a single byte too.

*Limits* are learnt (``fit``) from all documents outside the held-out fold that a label calls good: for each size class
(half a binary order of magnitude) and for wholes and chunks apart, the QUANTILE from either end of their ratios, and a
MARGIN beyond. What holds for a class is the mean of all classes' limits, each weighted by its number of documents and by
NEAR for each class between, and of DEFAULT, which weighs as much as PRIOR documents of the class itself; it is moved
outwards by WIDEN for each class that those documents are away on the mean. So a class with many has about its own limits,
one with few leans on its neighbours, and there is no number at which one passes into the other. Without ``fit``, and where
nothing was learnt, DEFAULT holds.

Counts (contract): words are ``[^\\x20\\x09-\\x0D]+``; ``word_chars`` code points in words; ``n_symbols`` characters
of ``#*$%&|<>``; ``n_dup_lines`` lines with a word that equal an earlier line; ``n_repeat_words`` words inside
three-word windows that occur twice or more, the first occurrence included. ``base_failed``: fewer than 50 words, or
more than half of the words repeated. ``kept``: neither failed nor rejected.

Texts are read once, whole, in one pass without a shuffle (``measure``), which leaves some numbers for each document;
learning and deciding use only those. Edge cases: null and empty texts have zero counts, fail the base, and have no
ratio (null). Repeated rows get equal results; ties at a limit are inside. Columns of the input named like the outputs
are replaced, all others kept. Without documents or labels DEFAULT holds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import Rows, held_out, materialize

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUTS = (*COUNTS, "base_failed", "ratio", "bad_chunk_share", "kept")
MEASURES = ", ".join(f"{c} long" for c in COUNTS) + ", n_bytes long, size_class int, tail_class int, ratio double, chunks array<double>"
CHUNK, LEVEL = 4_096, 3
#: Size classes: twice the binary logarithm of the bytes, rounded down.
CLASSES = 64
#: Of the learnt limits. Ratios are counted in steps of 1/STEPS, those over MOST in one step, which keeps
#: the largest of them.
QUANTILE, MARGIN, NEAR, PRIOR, WIDEN, STEPS, MOST = 0.002, (0.03, 0.02), 1 / 64, 0.5, 0.1, 200, 100
#: Limits where nothing was learnt: from how many bytes they hold, least and largest ratio.
DEFAULT = ((1, 0.0, 4.0), (256, 1.05, 4.0), (1_024, 1.15, 4.5), (4_096, 1.25, 5.5), (16_384, 1.35, 7.0), (65_536, 1.35, 9.0))


def size_class(n: int) -> int:
    octave = n.bit_length() - 1
    return 2 * octave + (n * n >= 1 << (2 * octave + 1))


def default_limits() -> list[tuple[float, float]]:
    starts = [size_class(start) for start, _, _ in DEFAULT]
    return [next((low, high) for start, (_, low, high) in zip(starts[::-1], DEFAULT[::-1], strict=True) if k >= start) for k in range(CLASSES)]


@dataclass(frozen=True)
class Bands:
    """(least, largest) ratio by size class, of wholes and of chunks."""

    whole: Sequence[tuple[float, float]]
    chunk: Sequence[tuple[float, float]]
    chunk_share: float = 0.5


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, of, n = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = n[of] >= 2
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n += line in seen
            seen.add(line)
    return n


def measured(text: str | None, press: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: splits at exactly these six ASCII characters
    chars = len(text) - sum(map(text.count, SPACES))
    counts = len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words)
    if not data:
        return *counts, 0, None, None, None, []
    ratio = len(data) / len(press.compress(data))
    parts = [data[at : at + CHUNK] for at in range(0, len(data), CHUNK)]
    chunks = [len(p) / len(press.compress(p)) for p in parts] if len(parts) > 1 else [ratio]
    return *counts, len(data), size_class(len(data)), size_class(len(parts[-1])), ratio, chunks


def measure(documents: DataFrame) -> tuple[DataFrame, Rows]:
    """The documents' counts and ratios, written to the shared folder: ``row`` (their columns but the text), ``doc_id``
    and MEASURES."""
    names = [c.split()[0] for c in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for texts in batches:
            out = pd.DataFrame([measured(t, press) for t in texts], columns=names)
            yield out.astype({"ratio": float, "size_class": "Int32", "tail_class": "Int32"})

    rows = Rows(documents, OUTPUTS, drop=["text"])
    found = documents.select(rows.row, F.col("doc_id").alias("id"), of.asNondeterministic()("text").alias("m"))
    return materialize(found.select("row", "id", "m.*")), rows


def chunk_class(at: Column) -> Column:
    """The size class of the chunk at a place: all but the last have the size CHUNK."""
    return F.when(at < F.size("chunks") - 1, F.lit(size_class(CHUNK))).otherwise(F.col("tail_class"))


def fit(measures: DataFrame, labels: DataFrame) -> Bands:
    """Limits from all labelled good documents outside the held-out fold. The driver receives a count for each kind,
    size class and step of the ratio: at most 2 x CLASSES x STEPS x MOST numbers."""
    good = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id")).distinct()
    known = measures.join(good, "id", "left_semi").where("n_bytes > 0")
    wholes = known.select(F.lit("whole").alias("kind"), "size_class", "ratio")
    chunks = known.select(F.lit("chunk").alias("kind"), F.posexplode("chunks").alias("at", "ratio"), "chunks", "tail_class").select("kind", chunk_class(F.col("at")).alias("size_class"), "ratio")
    step = F.round(F.least("ratio", F.lit(MOST)) * STEPS).cast("int").alias("step")
    counted = wholes.unionByName(chunks).groupBy("kind", "size_class", step).agg(F.count("*").alias("n"), F.max("ratio").alias("top")).collect()
    by_kind: dict[str, dict[int, list[tuple[int, float, int]]]] = {"whole": defaultdict(list), "chunk": defaultdict(list)}
    for r in counted:
        by_kind[r["kind"]][r["size_class"]].append((r["step"], max(r["step"] / STEPS, r["top"]) if r["step"] == MOST * STEPS else r["step"] / STEPS, r["n"]))
    return Bands(*[limits(by_kind[kind]) for kind in ("whole", "chunk")])


def limits(counted: dict[int, list[tuple[int, float, int]]]) -> list[tuple[float, float]]:
    """Limits of all size classes from the counted ratios, (step, largest ratio of it, number), of some."""
    own, n = np.zeros((CLASSES, 2)), np.zeros(CLASSES)
    for k, steps in counted.items():
        at, tops, of = np.array(sorted(steps)).T
        upto = np.cumsum(of)
        first, last = (np.searchsorted(upto, max(1, q * upto[-1])) for q in (QUANTILE, 1 - QUANTILE))
        own[k] = at[first] / STEPS * (1 - MARGIN[0]), tops[last] * (1 + MARGIN[1])
        n[k] = upto[-1]
    away = np.abs(np.subtract.outer(np.arange(CLASSES), np.arange(CLASSES)))
    weight = n * NEAR**away
    total = weight.sum(axis=1) + PRIOR
    wider = WIDEN * (weight * away).sum(axis=1) / total
    low, high = ((weight @ own + PRIOR * np.array(default_limits())) / total[:, None]).T
    return list(zip((low - wider).tolist(), (high + wider).tolist(), strict=True))


def decide(measures: DataFrame, rows: Rows, bands: Bands) -> DataFrame:
    """The documents without text, with OUTPUTS."""

    def outside(ratio: Column, of: Sequence[tuple[float, float]], size: Column) -> Column:
        low, high = (F.get(F.array(*[F.lit(x) for x in side]), size) for side in zip(*of, strict=True))
        return ~ratio.between(low, high)

    tail = F.col("n_bytes") - CHUNK * (F.size("chunks") - 1)
    length = lambda at: F.when(at < F.size("chunks") - 1, F.lit(CHUNK).cast("long")).otherwise(tail)
    bad = F.transform("chunks", lambda r, at: F.when(outside(r, bands.chunk, chunk_class(at)), length(at)).otherwise(F.lit(0).cast("long")))
    share = F.when(F.col("n_bytes") > 0, F.aggregate(bad, F.lit(0).cast("long"), lambda a, b: a + b) / F.col("n_bytes"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = outside(F.col("ratio"), bands.whole, F.col("size_class")) | (F.col("bad_chunk_share") >= bands.chunk_share)
    judged = measures.withColumn("bad_chunk_share", share).withColumn("base_failed", failed).withColumn("kept", ~(failed | F.coalesce(rejected, F.lit(False))))
    return rows.unpacked(judged, *OUTPUTS)


def judge(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``documents`` (doc_id, text, ...) without text, with OUTPUTS; limits are learnt from ``labels`` (doc_id, quality)."""
    measures, rows = measure(documents)
    bands = Bands(default_limits(), default_limits()) if labels is None else fit(measures, labels)
    return decide(measures, rows, bands)
