"""Periodic runs, licence scans, the prefix trie: brute force, expressions by another parser, edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from answerloom.llm import licences, periodic, prefixes
from answerloom.llm import queries as q

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a" * 300_000), (5, "word " * 50_000), (6, "same text here"), (6, "same text here"), (None, "no id"), (7, "日本語 текст 123 !!")]


def plain_runs(w, least=12):
    """All maximal stretches of each period; of one stretch the least period."""
    found = {}
    for q_ in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q_:
            j = i
            while j < len(w) - q_ and w[j] == w[j + q_]:
                j += 1
            if j > i and j - i + q_ >= max(least, 2 * q_):
                found.setdefault((i, j + q_), q_)
            i = max(i + 1, j)
    return sorted(((start, end - start, period) for (start, end), period in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_by_definition(least):
    rng = random.Random(least)
    for _ in range(1_500):
        n, kinds = rng.randint(0, 110), rng.choice([1, 2, 2, 3, 5, 30])
        w = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            w[a:] = [w[a + i % p] for i in range(n - a)]
            if rng.random() < 0.5:
                w[rng.randrange(n)] = 99
        assert periodic.runs_of(w, least) == plain_runs(w, least)


def test_z_function_by_definition():
    rng = random.Random(0)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randint(0, 30))]
        assert periodic.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_long_texts_take_n_log_n():
    rng = random.Random(1)
    texts = [["a"] * 200_000, [i % 7 for i in range(30_000)], [i % 9_000 for i in range(60_000)], [rng.randrange(1_000) for _ in range(200_000)]]
    began = time.perf_counter()
    assert [periodic.runs_of(t) for t in texts] == [[(0, 200_000, 1)], [(0, 30_000, 7)], [(0, 60_000, 9_000)], []]
    assert time.perf_counter() - began < 30


def plain_row(doc_id, text):
    w, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query(spark, frame):
    """Ids whose texts are made to repeat, and ones whose texts repeat by themselves."""
    rng = random.Random(5)
    rows = []
    for i in [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0] + list(range(1000, 1040)):
        line = [f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(line * rng.randint(1, 4) + line[: rng.randint(0, 5)])))
    rows += [(9, None), (8, ""), (7, " \n ")]
    got = periodic.digests(periodic.find(periodic.with_planted_runs(frame(rows, "doc_id long, text string")))).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: plain_row(i, t) for i, t in rows}


def test_runs_edges(spark, frame):
    out = periodic.find(frame([(*r, "x", 1) for r in EDGE], "doc_id long, text string, RUNS string, found int"))
    assert out.columns == ["doc_id", "text", "found", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == len(EDGE)
    of = {r.doc_id: r for r in rows}
    assert [tuple(x) for x in of[5].runs] == [(0, 50_000, 1)] and of[5].collapsed == "word"
    assert of[1].runs == of[3].runs == [] and of[1].collapsed == of[3].collapsed == ""
    assert periodic.find(out.select("text").limit(0)).count() == 0
    planted = {r.doc_id: r.text for r in periodic.with_planted_runs(frame(EDGE, "doc_id long, text string")).collect()}
    assert planted[None] == "no id" and planted[1] is None


def test_no_long_run_is_left(spark):
    """What is collapsed keeps the first period of every run: all words of it are words of the text, in order."""
    docs = periodic.with_planted_runs(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for r in periodic.find(docs).where("size(runs) > 0").collect():
        left, w = iter((r.text or "").split()), r.collapsed.split()
        assert all(x in left for x in w) and len(w) < len(r.text.split())


def plain_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for i in range(len(w)) for phrase, label in licences.BASE.items() if w[i : i + len(phrase.split())] == phrase.split()]
    more = {label for label, known in licences.NOTICES.items() for phrase, _ in known for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()}
    starts, labels = [i for i, _ in places], {label for _, label in places}
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), labels | more


def test_license_places_by_definition(spark, frame):
    rng = random.Random(2)
    parts = [*licences.BASE, *(p for known in licences.NOTICES.values() for p, _ in known), "cc", "by", "general", "public", "x", "é", "日本cc by", "CC-BY", "All\nRights, reserved.", "spdx license identifier"]
    texts = [rng.choice([" ", ", ", "-", "\x7f", "é "]).join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += [None, "", "cc by by cc by cc by", "general public license " * 3_000]
    out = licences.scan(frame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(out) == len(texts)
    for r in out:
        *counts, labels = plain_scan(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == tuple(counts)
        assert set(filter(None, r.labels.split(","))) == labels and 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_license_scan_of_the_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = q.op12_license_scans(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs) and sum(r.n_base > 0 for r in rows) > 10
    for r in rows:
        *counts, labels = plain_scan(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == tuple(counts)
        assert set(filter(None, r.labels.split(","))) == labels


def read(tokens):
    """An expression by recursive descent: (licences, grade)."""
    at = [0]

    def peek():
        return tokens[at[0]] if at[0] < len(tokens) else None

    def simple():
        t = tokens[at[0]]
        at[0] += 1
        if t == "(":
            out = alternatives()
            at[0] += 1
        else:
            out = ({t}, licences.grade_of(t))
        while peek() == "with":
            at[0] += 2
            out = (out[0], out[1] - (out[1] in licences.COPYLEFT))
        return out

    def both():
        out = simple()
        while peek() == "and":
            at[0] += 1
            other = simple()
            out = (out[0] | other[0], max(out[1], other[1]))
        return out

    def alternatives():
        out = both()
        while peek() == "or":
            at[0] += 1
            other = both()
            out = (out[0] | other[0], min(out[1], other[1]))
        return out

    return alternatives()


def test_expressions_against_recursive_descent():
    rng = random.Random(3)
    names = ["mit", "apache-2.0", "gpl-2.0-only", "lgpl-2.1+", "cc-by-nc-4.0", "foo-1", "cc0-1.0"]

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return [rng.choice(names)] + (["with", "classpath-exception-2.0"] if rng.random() < 0.3 else [])
        if kind < 0.5:
            return ["(", *made(depth - 1), ")"]
        return [*made(depth - 1), rng.choice(["and", "or"]), *made(depth - 1)]

    for _ in range(500):
        tokens = made(4)
        assert licences.beginning(tokens) == tokens
        assert licences.evaluated(licences.postfix(tokens)) == read(tokens)
        assert licences.tokens_of(" ".join(tokens).upper(), 0) == tokens


def test_beginnings_of_expressions():
    cases = {
        "MIT, see the file": "mit", "MIT": "mit", "(MIT": "", "MIT)": "mit", "OR MIT": "", "MIT OR": "mit", "MIT AND (GPL-2.0 OR": "mit", "": "", "MIT Apache-2.0": "mit",
        "MIT OR Apache-2.0. More": "mit or apache-2.0", "GPL-2.0 WITH (x)": "gpl-2.0", "()": "", "MIT ()": "mit", "(MIT) (BSD)": "( mit )", "a\nOR b": "a",
    }
    assert {text: " ".join(licences.beginning(licences.tokens_of(text, 0))) for text in cases} == cases


def test_tags(spark, frame):
    rows = [
        (1, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0"), (2, "License-Expression: MIT\nLicense-Expression: GPL-3.0-or-later"),
        (3, "SPDX-License-Identifier"), (4, "SPDX-License-Identifier: ???"), (5, "spdx-license-identifier: a " * 20_000), (6, "xLicense-Identifier: MIT"), (7, "SPDX-License-Identifier: " + "(" * 50_000),
    ]
    began = time.perf_counter()
    of = {r.doc_id: r for r in licences.scan(frame([(*r, "old") for r in rows], "doc_id long, text string, Score string")).collect()}
    assert time.perf_counter() - began < 30
    assert of[1].labels == "apache-2.0,gpl-2.0-only,mit" and of[1].grade == 2 and of[1].expressions == ["mit apache-2.0 or gpl-2.0-only classpath-exception-2.0 with and"]
    assert of[2].labels == "gpl-3.0-or-later,mit" and of[2].grade == 3 and of[2].score > 0.99
    assert [(of[i].labels, of[i].score, of[i].grade) for i in (3, 4, 6, 7)] == [("", 0.0, None)] * 4
    assert of[5].labels == "a" and len(of[5].expressions) == 20_000 and of[5].grade == licences.UNKNOWN


def test_license_edges(spark, frame):
    out = licences.scan(frame([(*r, 1) for r in EDGE], "doc_id long, text string, labels int"))
    rows = out.collect()
    assert len(rows) == len(EDGE) and {r.score for r in rows} == {0.0} and {r.grade for r in rows} == {None}
    assert licences.scan(out.select("text").limit(0)).count() == 0


def plain_trie(rows, rebuild=True):
    """All nodes, by writing out every prefix."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{role or ''}\0{text or ''}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        whole[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in sorted(whole.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in members if len(x) == len(node) + 1 and x[:-1] == node]
        leaves = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def nodes_of(frame_):
    return sorted(map(tuple, frame_.collect()), key=lambda r: (r[1], r[0]))


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_trie_by_definition(spark, frame, seed):
    rng = random.Random(seed)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b", " c\nd e", "", None])) for c in rng.sample(range(110), 50) for _ in range(rng.randint(1, 7))]
    rows += rows[:9] + [(None, 0, "user", "nobody's")]
    turns = frame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("N", F.lit(2))
    assert nodes_of(prefixes.trie(*prefixes.rebuilt(prefixes.placed(turns)))) == plain_trie(rows)
    assert nodes_of(prefixes.trie(prefixes.placed(turns))) == plain_trie(rows, rebuild=False)


def test_one_long_conversation_and_many_equal_ones(spark, frame):
    """A conversation that holds most turns, in many ranges; conversations that are equal; rounds as the depth's logarithm."""
    rows = [(1, i, "user", f"t {i % 5}") for i in range(1_000)] + [(2, i, "user", f"t {i % 5}") for i in range(700)]
    rows += [(c, i, "user", "hello there") for c in range(100, 400) for i in range(2)]
    got = nodes_of(prefixes.trie(prefixes.placed(frame(rows, SCHEMA).repartition(7))))
    ends = hashlib.sha256(",".join(map(str, range(100, 400))).encode()).hexdigest()
    assert got[0][:7] == (1, 0, None, 302, 2, 2, 700 * 2 + 299 * 4) and got[-1][:7] == (1, 1000, 1, 1, 0, 1, 0)
    assert [r for r in got if r[0] == 100] == [(100, 1, 1, 300, 1, 1, 299 * 4, hashlib.sha256().hexdigest()), (100, 2, 100, 300, 0, 1, 299 * 2, ends)]
    assert len(got) == 1 + 1_000 + 2


def test_running_sums_over_many_ranges(spark, frame):
    rng = random.Random(7)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3]), i, rng.randrange(-9, 9)) for i in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = prefixes.running(frame(rows, "k long, i long, v long"), "k", [F.col("i")], {"upto": F.col("v"), "n": F.lit(1)}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {(k, i): (sum(v for kk, ii, v in rows if kk == k and ii <= i), sum(kk == k and ii <= i for kk, ii, _ in rows)) for k, i, _ in rows}
    assert {(r.k, r.i): (r.upto, r.n) for r in got} == want and len(got) == len(rows)


def test_ids_in_pieces(spark, frame, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 7)
    rows = [(bytearray(b"a"), i) for i in range(-50, 150)] + [(bytearray(b"b"), 3), (bytearray(b"c"), 10**12)]
    got = {bytes(r.key): r.ends_sha256 for r in prefixes.ids_digests(frame(rows, "key binary, conv_id long")).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for x, i in rows if bytes(x) == k).encode()).hexdigest() for k in (b"a", b"b", b"c")}


def test_trie_edges(spark, frame):
    assert prefixes.trie(*prefixes.rebuilt(prefixes.placed(frame([], SCHEMA)))).count() == 0
    assert prefixes.trie(prefixes.placed(frame([(None, 1, "user", "x")], SCHEMA))).count() == 0
    rows = [(5, None, None, None), (5, None, None, None), (6, 1, "user", "w " * 200_000)]
    assert nodes_of(prefixes.trie(prefixes.placed(frame(rows, SCHEMA)))) == plain_trie(rows, rebuild=False)
