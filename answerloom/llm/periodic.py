"""Periodic runs of words: Main-Lorentz divide and conquer on interned words.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of ``max(least, 2 q)`` words
at least, that no neighbouring word extends keeping the period. Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.

1. *Interning.* A text's words become numbers, so that comparing words is comparing integers.
2. *Divide.* The words are halved again and again. A segment goes on only if a stretch of ``least / 2`` words occurs in it
   twice: every run has its first so many words again one period later, so nothing is lost, and most prose ends here.
3. *Conquer.* In a segment, two Z-functions at its midpoint (of the right half before the whole, and of the mirrored left
   half before the mirrored whole) tell for each period how far words equal those one period on, to the right and to the
   left: every repetition that crosses the midpoint, for all periods at once, in time linear in the segment.
4. *Deduplicate.* Of repetitions with one interval the smallest period stays: a multiple of a period has the interval of
   its smallest divisor that is a period, since both repeat twice in it at least.
5. *Extend.* A repetition that touches its segment's edge is extended in the whole text, unless a run of that period that
   is known already holds it; equal intervals are deduplicated once more.

All of it takes O(n log n) steps a text, and memory in proportion to it. A text is one row's work, with no shuffle; rows
are independent, so a lost executor costs its tasks only.

Edge cases: a null, empty or blank text has no words, no runs, and an empty ``collapsed``. Very long texts are read whole
(a million equal words are one run). Repeated rows get equal results; ties can't occur, since a run's interval is its
own. Columns of the input named like the outputs are replaced, all others kept. An empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import Rows

#: Words that a run has at least.
LEAST = 12
OUTPUTS = ("runs", "collapsed")
FOUND = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def z_function(s: list[int]) -> list[int]:
    """For each place of ``s`` the length of the longest common prefix of ``s`` and what begins there."""
    n = len(s)
    z, left, right = [n] * n, 0, 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def crossing(words: list[int], low: int, middle: int, high: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the repetitions inside [low, high) that touch ``middle``, one for each interval."""
    u, v = words[low:middle], words[middle:high]
    ahead = np.array(z_function([*v, -1, *u, *v])[len(v) + 1 :])  # at i: how far low + i goes on like the middle
    u.reverse()
    v.reverse()
    back = np.array(z_function([*u, -1, *v, *u])[len(u) + 1 :][::-1])  # at i: how far what ends with low + i ended like the middle
    nu, nv = len(u), len(v)
    # the copy one period later begins at the middle or to its right
    q = np.arange(1, nv + 1)
    right = np.append(ahead[nu + 1 :], 0)
    left = back[nu + q - 1]
    starts, ends, periods = [middle - left], [middle + q + right], [q]
    # or the copy one period earlier begins to its left
    q = np.arange(1, nu + 1)
    right = ahead[nu - q]
    left = np.append(back[: nu - 1][::-1], 0)
    starts, ends, periods = np.append(starts, middle - q - left), np.append(ends, middle + right), np.append(periods, q)
    long = np.flatnonzero(ends - starts >= np.maximum(least, 2 * periods))
    found: dict[tuple[int, int], int] = {}
    for at in long[np.argsort(periods[long], kind="stable")].tolist():
        found.setdefault((int(starts[at]), int(ends[at])), int(periods[at]))
    return [(start, end, period) for (start, end), period in found.items()]


def previous_same(ids: np.ndarray, span: int) -> np.ndarray:
    """For each place the last place before it where the same ``span`` words begin, or -1."""
    of, width = ids, 1
    while width < span:  # equal ids stand for equal stretches of `width` words
        step = min(width, span - width)
        _, of = np.unique(of[:-step] * (int(of.max()) + 1) + of[step:], return_inverse=True)
        width += step
    by = np.argsort(of, kind="stable")
    before = np.full(len(of), -1)
    same = of[by[1:]] == of[by[:-1]]
    before[by[1:][same]] = by[:-1][same]
    return before


def extended(ids: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The interval of a repetition, as far as its period goes on in the whole text."""
    step = 64
    while start:
        at = max(0, start - step)
        differ = np.flatnonzero(ids[at:start] != ids[at + period : start + period])
        if len(differ):
            start = at + int(differ[-1]) + 1
            break
        start, step = at, 2 * step
    step = 64
    while end < len(ids):
        at = min(len(ids), end + step)
        differ = np.flatnonzero(ids[end:at] != ids[end - period : at - period])
        if len(differ):
            end += int(differ[0])
            break
        end, step = at, 2 * step
    return start, end


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n, span = len(words), least // 2
    if n < least:
        return []
    number: dict = {}
    listed = [number.setdefault(w, len(number)) for w in words]
    if n - len(number) < span:
        return []
    ids = np.array(listed)
    before = previous_same(ids, span)
    runs: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int]]] = {}
    segments = [(0, n)]
    while segments:
        low, high = segments.pop()
        inside = before[low : high - span + 1]
        if high - low < least or not len(inside) or inside.max() < low:
            continue
        middle = (low + high) // 2
        if (ids[low:high] == ids[low]).all():  # nothing in it has another period than 1
            found = [(low, high, 1)]
        else:
            segments += [(low, middle), (middle, high)]
            found = crossing(listed, low, middle, high, least)
        for start, end, period in found:
            of_period = known.setdefault(period, [])
            at = bisect_right(of_period, (start, n))
            if at and of_period[at - 1][1] >= end:
                continue
            if start == low or end == high:
                start, end = extended(ids, start, end, period)
            insort(of_period, (start, end))
            runs[start, end] = min(period, runs.get((start, end), period))
    return sorted(((start, end - start, period) for (start, end), period in runs.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(runs).T
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def find(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``documents`` (text, ...) with ``runs`` (start, length, period; by start, then period) and ``collapsed``: the words
    that no run contains after its first period, joined by one space."""

    @F.pandas_udf(FOUND)
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at exactly these six characters
            runs = runs_of(words, least)
            out.append((runs, b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=list(OUTPUTS))

    rows = Rows(documents, OUTPUTS)
    return rows.unpacked(documents.select(rows.row, of("text").alias("found")), "found.runs", "found.collapsed")


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) with words of one in ten texts replaced: with h the CRC-32 of the id and g a tenth of
    it, where ``h % 10 = 0`` the words from ``a = g % n`` on repeat with period ``1 + (n - a) / (3 + g % 8)``. A null id
    leaves its text as it is, as do texts without words."""

    @F.pandas_udf("string")
    def planted(texts: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([repeated(t, int(h)) if t and h == h and h is not None and h % 10 == 0 else t for t, h in zip(texts, hashes, strict=True)], dtype=object)

    return documents.select("doc_id", planted("text", F.crc32(F.col("doc_id").cast("string").cast("binary"))).alias("text"))


def repeated(text: str, h: int) -> str:
    words, g = text.encode("utf-8", "surrogatepass").split(), h // 10
    if not words:
        return text
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    words[a:] = (words[a : a + p] * (1 + (n - a) // p))[: n - a]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def digests(found: DataFrame) -> DataFrame:
    """The query's columns of ``find``'s."""
    exact: Column = F.col("runs")
    first = F.array_min(F.transform(exact, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(exact, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("most"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("most.start").alias("start"), (-F.col("most.less")).alias("length"), F.col("most.period").alias("period"),
        F.floor(-1000 * F.col("most.less") / F.col("most.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: CRC-32 of a string in DuckDB: bytes through the polynomial's table, which is made bit by bit.
CRC_TABLE = "(SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) AS r(i))"


def crc32_sql(x: str, table: str = "crc_table") -> str:
    """The CRC-32 of an ASCII string; ``table`` names a column with CRC_TABLE."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1])), 4294967295)"


#: DuckDB SQL for the query: all pairs of equal six-word stretches of a text, islands of pairs by distance.
ORACLE = rf"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents, (SELECT {CRC_TABLE} AS crc_table)),
placed AS (
  SELECT doc_id, w, h, h // 10 AS g, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed),
planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w
  FROM placed),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM planted),
gram AS (
  SELECT doc_id, i, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o) AS gram,
    lead(word, 5) OVER o IS NOT NULL AS whole
  FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pair AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i FROM gram a JOIN gram b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i WHERE a.whole AND b.whole),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS start, max(i) + 6 + q - min(i) AS length FROM island GROUP BY doc_id, q, island),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS most
  FROM run GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM run)),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM word w ANTI JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i GROUP BY w.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, most.start AS start, most.length AS length, most.period AS period,
  1000 * most.length // most.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM planted p LEFT JOIN listed l ON l.doc_id = p.doc_id LEFT JOIN kept k ON k.doc_id = p.doc_id
"""
