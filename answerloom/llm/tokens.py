"""Token counts by a two-tier lookup, equal to the tokenizer library's.

The tokenizer of ``word_bpe_49k.json`` normalises (NFC, white space, lower case), cuts the text into pre-tokens by a
pattern and encodes each on its own, so a text's count is the sum over its pre-tokens. First tier: a compact hash
table, broadcast, of the ``frequent`` most frequent pre-tokens of at most ``sample`` documents, with their lengths.
Second tier: a bounded cache in each Python worker; what neither holds is encoded there, in batches. No pre-token is
ever shuffled, and only the speed depends on the sample.

A text that holds a special token's string goes to the library as it is, since the library cuts those out before it
normalises. The table's pattern is checked against the file's on loading; another file gets the library for all texts.

Edge cases: null and empty texts have no bytes and no tokens. Texts are read whole, however long. Rows are counted
independently, so repeats get equal counts. An empty table gives an empty one. Columns of the input named like the outputs
are replaced, all others kept.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm.common import Rows
from tokenizers import Tokenizer

#: The file's own pre-token pattern, for which the lookup is written.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries that a worker's cache holds at most, and misses encoded at once.
CACHE, BATCH = 400_000, 4_096


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Counts:
    """A worker's counter: the broadcast table, its cache, and the library behind both."""

    def __init__(self, path: str, table: dict[str, int] | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = spec["pre_tokenizer"].get("pretokenizers", [{}])
        plain = [t["type"] for t in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.split = plain and steps[0].get("pattern", {}).get("Regex") == PATTERN
        self.find = regex.compile(PATTERN).findall
        self.table, self.cache = table or {}, {}

    def library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pre_tokens(self, text: str) -> list[str] | None:
        """The text's pre-tokens, or None where only the library will do."""
        if not self.split or any(s in text for s in self.special):
            return None
        # lower-casing by code point, as the library does it: a final sigma stays a plain one
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self.find(text)

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of texts: known pre-tokens are summed at once, the rest are encoded together first."""
        table, cache = self.table, self.cache
        found = [self.pre_tokens(t) for t in texts]
        missing = {p for pre in found if pre for p in pre if p not in table and p not in cache}
        if len(cache) + len(missing) > CACHE:
            cache.clear()
            missing = {p for pre in found if pre for p in pre if p not in table}
        todo = list(missing)
        for at in range(0, len(todo), BATCH):
            part = todo[at : at + BATCH]
            cache.update(zip(part, self.library(part), strict=True))
        out = []
        for text, pre in zip(texts, found, strict=True):
            if pre is None:
                out.append(self.library([text])[0])
            else:
                out.append(sum([table[p] if p in table else cache[p] for p in pre]))
        return out


@functools.cache
def counter(path: str) -> Counts:
    return Counts(path)


def frequent_lengths(documents: DataFrame, path: str, sample: int = 2_000, frequent: int = 60_000) -> dict[str, int]:
    """The first tier: lengths of the ``frequent`` most frequent pre-tokens of ``sample`` documents at most."""
    chosen = documents.where("text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    # at most `sample` ids, by the limit
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text is not None:
                    counts.update(counter(path).pre_tokens(text) or ())
        if known := list(counts):
            yield pd.DataFrame({"pre": known, "n": [counts[p] for p in known], "tokens": counter(path).library(known)})

    top = (
        texts.mapInPandas(counted, "pre string, n long, tokens int")
        .groupBy("pre", "tokens").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre").limit(frequent)
    )
    return {r["pre"]: r["tokens"] for r in top.collect()}


def count(spark: SparkSession, documents: DataFrame, path: str | None = None, limit: int = 2_048, rows: int = 256) -> DataFrame:
    """``documents`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; ``path`` must be there on every executor."""
    path = path or default_path()
    shared = spark.sparkContext.broadcast(frequent_lengths(documents, path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        own.table = shared.value
        for texts in batches:
            filled = ["" if t is None else t for t in texts]
            yield pd.Series([n for at in range(0, len(filled), rows) for n in own.count(filled[at : at + rows])], dtype="int64")

    kept = Rows(documents, ("n_bytes", "n_tokens", "over_limit"))
    out = documents.select(kept.row, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), counted.asNondeterministic()("text").alias("n_tokens"))
    return kept.unpacked(out, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
