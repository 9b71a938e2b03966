"""URL filters, decontamination, chat, WARC, the Jaccard join, packing: brute force, round trips, edge cases."""

import gzip
import hashlib
import io
import json
import os
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.llm import chat, decontaminate, jaccard, packing, urlfilter, warc
from answerloom.llm import queries as q
from answerloom.llm.common import scope, shared_dir
from answerloom.llm.components import connected_components
from tests_llm_plain import contaminated, groups

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = q.QUERIES[name](spark, SF)
    want = con.execute(q.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(want.fetchall())


def verdict_of(url, rules):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fit)[3], max(fit)[4]) if fit else (None, "allow")))


def test_url_filters(spark, frame):
    urls = [None, "", "no scheme/en/", "http://", "http://COM/en/x", "https://a.Example.com/en/7/x?y#z", "x://example.com/en/", "http://notexample.com/en/7", "http://a.net/de/8", "http://example.net/de/8", "http://b.example.net/de/", "http://é.org/es/?q", "http://example.com", "http://example.com#/en/", "a://b://c.com/en/", "http://u@example.com:80/en/7", "http://a..com/en/", "http://org/es/\n", "http://x.com/" + "e" * 100_000, "http://" + "a." * 20_000 + "com/en/", "http://" + "." * 20_000 + "/en/", "http://a.b.xn--c.co.uk/x"] * 2
    pages = frame([(i, u, "x", 1, 2, 3) for i, u in enumerate(urls)], "page_id long, url string, RULE string, _best int, best int, row int")
    rules = [*urlfilter.RULES, ("co.uk", "/x", "block"), ("b.xn--c.co.uk", "/", "allow"), ("uk", "", "block"), (None, "/", "block"), ("com", None, "block"), urlfilter.RULES[0]]
    for some in (urlfilter.RULES, rules):
        out = urlfilter.judge(pages, urlfilter.rules_table(spark, some))
        assert out.columns == ["page_id", "url", "_best", "best", "row", "host", "path", "rule", "verdict"]
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
        assert got == {i: verdict_of(u, [r for r in some if r[0] is not None and r[1] is not None]) for i, u in enumerate(urls)}
    assert urlfilter.judge(pages, urlfilter.rules_table(spark).limit(0)).where("verdict <> 'allow'").count() == 0
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_table(spark)).count() == 0


def test_rules_of_any_case_fit(spark, frame):
    rules = frame([("ExAmple.COM", "/A", "block"), ("example.com", "/A", "block")], "host string, path string, verdict string")
    pages = frame([(1, "http://EXAMPLE.com/A/b"), (2, "http://x.example.com/a")], "page_id long, url string")
    assert {(r.page_id, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()} == {(1, "example.com/A", "block"), (2, None, "allow")}


def test_decontamination(spark, frame):
    rng = random.Random(5)
    word = lambda n: " ".join(rng.choice("abcde") + rng.choice(["", "é", "1"]) for _ in range(n))
    items = [(i, word(n)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 10, 11, 30, 0])] + [(20, None), (8, word(12)), (None, word(3))]
    items[0] = (0, "Zebra")
    texts = [word(rng.randint(0, 80)) for _ in range(60)] + [None, "", "...", "zebra! ZEBRA", items[8][1].upper(), "x " + items[6][1] + ", " + items[7][1], items[8][1], items[8][1]]
    docs = frame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    out = decontaminate.contamination(docs, frame(items, "item_id long, text string"))
    named = [(n, t) for n, t in items if n is not None and t is not None]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in out.collect()}
    assert got == {i: contaminated(t, named) for i, t in enumerate(texts)}
    none = decontaminate.contamination(docs, frame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(texts)


def test_decontamination_keeps_columns_and_counts_hot_windows_once(spark, frame):
    """Columns with any name stay; a passage that many items and many documents have; several texts under one id."""
    passage = " ".join(f"p{i}" for i in range(14))
    items = [(i, f"own{i} {passage} {'tail ' * (i % 3)}") for i in range(60)] + [(99, "q1 q2 q3")]
    texts = [f"doc{i} {passage} {'more ' * (i % 4)} q1 q2 q3" for i in range(40)] + [passage * 2, "p1 p2 p3", None]
    docs = frame([(i % 7, t, 1, 2, 3, 4, i) for i, t in enumerate(texts)], "doc_id long, text string, key int, N_HIT int, row int, at int, place int")
    out = decontaminate.contamination(docs, frame(items, "item_id long, text string"))
    assert out.columns == ["doc_id", "key", "row", "at", "place", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = {r.place: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in out.collect()}
    assert got == {i: contaminated(t, items) for i, t in enumerate(texts)}
    assert decontaminate.contamination(docs.limit(0), frame(items, "item_id long, text string")).count() == 0


def test_decontamination_of_a_long_text(spark, frame):
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(200_000))
    words = long.split()
    items = [(i, " ".join(words[at : at + 12])) for i, at in enumerate([0, 5, 100_000, 199_988])]
    got = decontaminate.contamination(frame([(1, long)], "doc_id long, text string"), frame(items, "item_id long, text string")).first()
    assert (got.n_words, got.n_hit, got.n_items) == (200_000, 17 + 12 + 12, 4)


@pytest.mark.parametrize("length", range(1, 14))
def test_runs_and_winnowed_hashes_by_definition(spark, frame, length):
    """A window's fingerprint is the least hash of its k-grams, and follows from its own words alone."""
    rng = random.Random(length)
    words = [[rng.choice("abc") for _ in range(n)] for n in (0, 1, length - 1, length, length + 1, 40)]
    rows = decontaminate.windows(frame([(i, w) for i, w in enumerate(words)], "i int, words array<string>"), length).collect()
    k, gap = decontaminate.scheme(length)
    assert k + gap - 1 == length
    assert sorted((r.i, r.at) for r in rows) == [(i, at) for i, w in enumerate(words) for at in range(len(w) - length + 1)]
    seen = {}
    for r in rows:
        assert seen.setdefault(tuple(words[r.i][r.at : r.at + length]), (r.print, r.mark)) == (r.print, r.mark)
    of = decontaminate.Hashes(frame([(i, w) for i, w in enumerate(words)], "i int, words array<string>"))
    prints, grams = of.prints(length), of.runs(k)
    for r in of.df.select(F.col(prints).alias("p"), F.col(grams).alias("g")).collect():
        assert r.p == [min(r.g[i : i + gap]) for i in range(len(r.g) - gap + 1)]


def test_winnowing_keeps_a_hash_of_every_shared_run(spark, frame):
    rng = random.Random(6)
    runs = [" ".join(rng.choice("abcdefgh") for _ in range(10)) for _ in range(40)]
    around = lambda: " ".join(rng.choice("xyz") for _ in range(rng.randint(0, 9)))
    rows = [(i, f"{around()} {r} {around()}".split(), r.split()) for i, r in enumerate(runs)]
    of = {c: decontaminate.Hashes(frame(rows, "i int, a array<string>, b array<string>"), c) for c in "ab"}
    prints = {}
    for c in "ab":
        name = of[c].prints(10)
        prints[c] = of[c].df.select("i", F.col(name).alias(f"of_{c}"))
    assert prints["a"].join(prints["b"], "i").where(F.arrays_overlap("of_a", "of_b")).count() == len(rows)


TOOLS = {"f": {"required": ["x"], "properties": {"x": "integer", "y": "string"}}}


def call(name, arguments, tool="f"):
    return f'<tool_call>{json.dumps({"id": name, "name": tool, "arguments": arguments})}</tool_call>'


def test_chat(spark, frame):
    ref = lambda n: {"$ref": n}
    rows = [
        (1, 0, "user", "hi é"), (1, 1, "assistant", "let me " + call("a", {"x": 1}) + call("b", {"y": "s", "x": ref("a")})), (1, 2, "tool", '{"tool_call_id": "b", "content": 2}'),
        (1, 3, "tool", '{"content": 1, "tool_call_id": "a"}'), (1, 4, "tool", '{"tool_call_id": "zzz"}'), (1, 5, "assistant", call("c", {"x": ref("d")}) + call("d", {"x": ref("c")})),
        (1, 6, "assistant", call("e", {"x": "no"})), (1, 7, "assistant", call("g", {"x": True})), (1, 8, "assistant", call("h", {})), (1, 9, "assistant", call("i", {"x": 1, "z": 2})), (1, 10, "assistant", call("j", {"x": 1}, "g")),
        (1, 11, "assistant", "<tool_call>no json</tool_call>"), (1, 12, "assistant", call("", {"x": 1})), (2, 0, "tool", '{"tool_call_id": "a"}'), (2, 1, None, None), (None, 0, "assistant", call("a", {"x": 1})), (1, 13, "assistant", call("k", {"x": ref("gone")})), (1, 0, "user", "hi é"),
    ]
    out = chat.format_chat(frame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert got[1, 1].level == 2 and (got[1, 1].n_calls, got[1, 1].n_valid, got[1, 1].n_answered) == (2, 2, 2)
    assert (got[1, 2].level, got[1, 3].level) == (3, 1) and got[1, 2].linked and not got[1, 4].linked and not got[2, 0].linked
    assert got[1, 5].level is None and got[1, 13].level is None
    assert [got[1, t].error for t in (6, 7, 8, 9, 10, 12)] == ["not of type integer: x", "not of type integer: x", "missing: x", "not in the schema: z", "unknown tool", "no id"]
    assert (got[1, 11].kind, got[1, 11].n_calls, got[1, 11].n_valid, got[1, 11].error) == ("calls", 1, 0, "no JSON object") and got[1, 0].message == '{"content":"hi é","role":"user"}'
    assert got[1, 3].message == '{"content":1,"role":"tool","tool_call_id":"a"}'
    assert json.loads(got[1, 1].message)["tool_calls"][0] == {"arguments": {"x": 1}, "id": "a", "name": "f"}
    assert chat.format_chat(frame([], "conv_id long, turn long, role string, text string"), TOOLS).count() == 0


def test_chat_takes_what_json_cannot_say_for_plain_text(spark, frame):
    odd = ['{"tool_call_id":"a","x":"\\ud800"}', '{"tool_call_id":"a","x":1e999}', '{"tool_call_id":"a","x":NaN}', '{"tool_call_id":"a","tool_call_id":"b"}', '{"tool_call_id":"a","x":' + "9" * 5000 + "}", "[" * 100_000, "x" * 1_000_000]
    rows = [(1, i, "tool", t, "other") for i, t in enumerate(odd)] + [(2, i, "assistant", f"<tool_call>{t}</tool_call>", "other") for i, t in enumerate(odd)]
    rows += [(3, 0, "tool", '{"role":"system","tool_call_id":"a","content":"\\ud83d\\ude00"}', "o")]
    out = {(r.conv_id, r.turn): r for r in chat.format_chat(frame(rows, "conv_id long, turn long, role string, text string, kind string"), TOOLS).collect()}
    assert all(out[1, i].kind == "message" and json.loads(out[1, i].message)["content"] == t for i, t in enumerate(odd))
    assert all((out[2, i].kind, out[2, i].error) == ("calls", "no JSON object") and json.loads(out[2, i].message)["content"] == f"<tool_call>{t}</tool_call>" for i, t in enumerate(odd))
    assert out[3, 0].message == '{"content":"😀","role":"tool","tool_call_id":"a"}'


def test_good_calls_stay_beside_bad_blocks(spark, frame):
    text = "a <tool_call>{</tool_call> b " + call("x", {"x": 1}) + "<tool_call>[]</tool_call> c <tool_call>" + call("y", {"x": {"$ref": "x"}}) + " d </tool_call> <tool_call>"
    rows = [(1, 0, "assistant", text), (1, 1, "tool", '{"tool_call_id":"x"}'), (1, 2, "assistant", "<tool_call>" + '{"id":"z"}')]
    got = {r.turn: r for r in chat.format_chat(frame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()}
    assert (got[0].n_calls, got[0].n_valid, got[0].n_answered, got[0].error, got[0].level) == (4, 1, 1, "no JSON object", 0) and got[1].linked and got[2].kind == "message"
    message = json.loads(got[0].message)
    assert [c["id"] for c in message["tool_calls"]] == ["x"] and message["content"] == text.replace(call("x", {"x": 1}), "").strip()


def test_hostile_texts_take_linear_time():
    for text in ("<tool_call>" * 100_000, "<tool_call></tool_call>" * 50_000, "</tool_call>" * 100_000, "<tool_call>" + "{" * 1_000_000, "<tool_call>" * 50_000 + "</tool_call>" * 50_000):
        began = time.perf_counter()
        chat.message("assistant", text, TOOLS)
        assert time.perf_counter() - began < 2


def test_values_nested_however_deep(spark, frame):
    deep = lambda n: '{"a":[' * n + '{"$ref":"r"}' + "]}" * n
    rows = [(1, 0, "tool", '{"tool_call_id":"a","x":' + deep(50_000) + "}"), (1, 1, "assistant", '<tool_call>{"name":"f","id":"b","arguments":{"x":' + deep(5_000) + "}}</tool_call>")]
    got = {r.turn: r for r in chat.format_chat(frame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()}
    assert got[0].kind == "result" and got[0].message == '{"role":"tool",' + rows[0][3][1:] and got[1].error == "not of type integer: x"
    assert chat.references(chat.deeply_read(deep(5_000))) == ["r"]


def test_deep_json_is_read_and_written_as_the_library_does():
    rng = random.Random(0)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            return rng.choice([1, -2.5, 1e20, 'é"\\\n', None, True, False, "", 10**30])
        return [made(depth - 1) for _ in range(rng.randint(0, 4))] if kind < 0.7 else {rng.choice("abcdé") + str(i): made(depth - 1) for i in range(rng.randint(0, 4))}

    def outcome(read, text):
        try:
            return repr(read(text))
        except ValueError:
            return "fault"

    for _ in range(1_500):
        value = made(5)
        text = json.dumps(value, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        assert chat.deeply_read(text) == value and chat.deeply_written(value) == chat.canonical(value)
        broken = list(text)
        broken[rng.randrange(len(broken))] = rng.choice('{}[],:"1 x')
        library = lambda t: json.loads(t, object_pairs_hook=chat.once, parse_float=chat.finite, parse_constant=chat.finite)
        assert outcome(chat.deeply_read, "".join(broken)) == outcome(library, "".join(broken))


@pytest.mark.parametrize("held", [chat.HELD, 500, 10])
def test_levels_are_longest_ways(spark, frame, monkeypatch, held):
    """In one task, in rounds, and some conversations in each."""
    monkeypatch.setattr(chat, "HELD", held)
    rng = random.Random(11)
    refs = {f"c{i}": sorted({f"c{rng.randrange(max(0, i - 9), i)}" for _ in range(rng.randint(0, 3))}) if i else [] for i in range(30)}
    refs |= {f"d{i}": [f"d{i - 1}"] if i else [] for i in range(300)} | {"x": ["y", "c3"], "y": ["x"], "z": ["x"], "u": ["nowhere", "c1"]}
    level: dict[str, int] = {}
    while new := {k: max([level[r] + 2 for r in v], default=0) for k, v in refs.items() if k not in level and all(r in level for r in v)}:
        level |= new
    rows = [(1, k, v) for k, v in refs.items()] + [(2, k, refs[k] + refs[k]) for k in list(refs)[:12]] + [(3, "c0", [])]
    got = {(r.conv_id, r.id): r.level for r in chat.levels(frame(rows, "conv_id long, id string, refs array<string>")).collect()}
    assert got == {(1, k): v for k, v in level.items()} | {(2, k): level[k] for k in list(refs)[:12]} | {(3, "c0"): 0}


def test_long_chains_of_several_references_settle_in_a_pass(spark, frame):
    began = time.perf_counter()
    rows = [(1, f"c{i}", [f"c{i - 1}", f"c{i - 2}"] if i > 1 else []) for i in range(3_000)]
    got = {r.id: r.level for r in chat.levels(frame(rows, "conv_id long, id string, refs array<string>")).collect()}
    assert len(got) == 3_000 and got["c2999"] == 2 * 2_998 and time.perf_counter() - began < 60


def test_chat_query_has_every_fault(spark):
    rows = q.op4_chat_formatting(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").count()
    assert {r.error for r in rows} == {None, "no JSON object", "missing: prompt", "unknown tool", "not in the schema: tone"}
    assert {r.linked for r in rows} == {None, True, False} and {r.n_answered for r in rows} == {0, 1}
    assert any(r.kind == "calls" and r.level is None for r in rows) and max(r.level or 0 for r in rows) >= 4


def test_warc_round_trip(spark, frame, tmp_path):
    long = "WARC/1.1\r\n\r\n é " * 100
    rows = [(1, "http://a/", long), (5, "http://b/\r\nx: y", long), (3, None, long), (4, "http://c/", None), (6, "http://c/", ""), (7, "u", "short"), (8, "u", "short"), (9, "u", "z" * 1000), (9, "u", "z" * 1000), (None, "n", long), (10, "v", "\r\n\r\n\r\n")]
    rows.append((11, "big", "é" * 2_000_000))
    pages = frame([(*r, 1, "2") for r in rows], "page_id long, url string, html string, payload int, of string")
    out = warc.round_trip(spark, pages).collect()
    assert len(out) == len(rows)
    got = sorted((str(r.metadata.page_id), r.response.type, r.response.payload_bytes, r.response.payload_digest, str(r.refers_to.page_id) if r.refers_to else None) for r in out)
    sha = lambda s: (len((s or "").encode()), hashlib.sha1((s or "").encode()).hexdigest())
    want = sorted((str(i), "revisit" if h == long and i != 5 else "response", *sha(h), "5" if h == long and i != 5 else None) for i, _, h in rows)
    assert got == want and all(r.request for r in out)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_archives_have_a_bounded_size(spark, frame, tmp_path, monkeypatch):
    """Few records a file, and of large payloads fewer; nothing is left behind, and every page comes back."""
    monkeypatch.setattr(warc, "RECORDS", ((50, 9), (500, 6), (1 << 62, 3)))
    rows = [(i, "u", "x" * (3000 if i % 7 == 0 else 300 if i % 5 == 0 else 3) + str(i)) for i in range(40)] + [(40, "u", None)]
    pages = frame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    files = [list(warc.records(io.BytesIO(gzip.decompress(f.read_bytes())))) for f in (tmp_path / "w").glob("*.gz")]
    payload = lambda block: len(block.partition(b"\r\n\r\n")[2])
    assert sum(map(len, files)) == 3 * len(rows) and max(map(len, files)) <= 9
    for file in files:
        largest = max(payload(block) for head, block in file if head["warc-type"] == "response")
        assert len(file) <= (9 if largest < 50 else 6 if largest < 500 else 3)
    root = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with scope():
        got = warc.round_trip(spark, pages).select("metadata.page_id", "response.payload_bytes").collect()
        assert any("warc" in n for n in set(os.listdir(root)) - before)
    assert {r.page_id: r.payload_bytes for r in got} == {i: len(h or "") for i, _, h in rows}
    assert set(os.listdir(root)) == before


def test_warc_files_are_warc(spark, frame, tmp_path):
    warc.write(frame([(1, "http://a/", "<p>é")], "page_id long, url string, html string"), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.gz"))
    found = list(warc.records(io.BytesIO(data)))
    assert sorted(h["warc-type"] for h, _ in found) == ["metadata", "request", "response"]
    response = next((h, b) for h, b in found if h["warc-type"] == "response")
    assert response[1].endswith("<p>é".encode()) and data.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(io.BytesIO(data[:-20])))


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 8, 10), (1, 1, 2), (2, 7, 10)])
def test_jaccard_groups(spark, frame, k, num, den):
    rng = random.Random(k)
    texts = [None, "", " \n", "a", "A", "a b", "a b", "é É", "a\x0bb"]
    for _ in range(14):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(rng.randint(4, 60))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 5)}"
            texts.append(" ".join(copy[: len(copy) - rng.randint(0, 3)]))
    docs = frame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_groups(spark, docs, k, num, den).collect()}
    assert got == groups(texts, k, num, den)


def test_jaccard_edges(spark, frame):
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    rows = [(3, long, "x"), (2, long, "x"), (2, long, "x"), (None, long, "x"), (None, "alone here now", "x"), (9, None, "x")]
    out = jaccard.similarity_groups(spark, frame(rows, "doc_id long, text string, node string"))
    assert out.count() == len(rows)
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(3, 2), (2, 2), (None, 2), (None, None), (9, 9)}
    assert jaccard.similarity_groups(spark, frame([], "doc_id long, text string")).count() == 0


def random_sets(rng):
    """Sets in families, with some that have nothing to do with them."""
    size = rng.choice([5, 12, 30, 60])
    bases = [rng.sample(range(size), rng.randint(1, size)) for _ in range(rng.randint(1, 4))]
    sets = []
    for _ in range(rng.randint(1, 25)):
        own = set(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            own ^= {rng.randrange(size + 6)}
        sets.append(own or {size + 9})
    return {i: np.array(sorted(own), np.int64) for i, own in enumerate(sets)}


def components(keys, links):
    root = {k: k for k in keys}
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root = {k: x if r == y else r for k, r in root.items()}
    return root


@pytest.mark.parametrize(("num", "den"), [(1, 2), (8, 10), (9, 10)])
def test_walks_find_what_pairs_find(num, den):
    rng = random.Random(num)
    for _ in range(150):
        sets = random_sets(rng)
        similar = lambda a, b: den * len({*sets[a]} & {*sets[b]}) >= num * len({*sets[a]} | {*sets[b]})  # noqa: B023, E731
        links, _ = jaccard.spanning_links(sets, num, den)
        assert len(links) < len(sets) and all(similar(a, b) for a, b in links)
        assert components(sets, links) == components(sets, [(a, b) for a in sets for b in sets if similar(a, b)])
        held = {k: v for k, v in sets.items() if k % 2 == 0}
        trie = jaccard.Trie(held, num, den, others=True)
        for step in (1, 7, 512):
            probes = trie.outside(sets)
            assert {(k, probes[0][at]) for k, linked in trie.walk(probes, step) for at in linked} == {(a, b) for a in held for b in sets if similar(a, b)}


def test_walks_skip_subtrees():
    """Sets that share a passage but no more: a walk from elsewhere counts no overlaps on the path of any of them."""
    passage = list(range(100, 180))
    sets = {i: np.array(passage + sorted(random.Random(i).sample(range(1000, 9000), 20)), np.int64) for i in range(200)}
    sets[200] = np.array(range(300, 400), np.int64)
    trie = jaccard.Trie(sets, 9, 10, others=True)
    assert [(k, list(at)) for k, at in trie.walk(trie.probes([200]))] == [(200, [0])] and trie.steps <= 5


def near_copies(n, seed=0):
    """Sets of 200 or so that share 95 % of one base: any two share too little to link."""
    g = np.random.default_rng(seed)
    return {i: np.sort(np.concatenate([np.arange(200)[g.random(200) < 0.95], 1_000 + g.integers(0, 10**9, 10)])) for i in range(n)}


def test_near_copies_that_do_not_link_are_walked_in_proportion():
    """A few counts of overlaps for each set, all walkers at once, however many sets there are."""
    steps = {}
    for n in (750, 1_500, 3_000):
        links, trie = jaccard.spanning_links(near_copies(n), 9, 10)
        steps[n] = trie.steps
        assert len(links) < n / 100
    assert steps[3_000] < 4 * 3_000 and steps[3_000] < 2.2 * steps[1_500] < 4.84 * steps[750]


def test_families_take_few_walks():
    g = np.random.default_rng(1)
    family = {i: np.sort(np.concatenate([np.arange(200)[g.random(200) < 0.995], 1_000 + g.integers(0, 10**9, 1)])) for i in range(1_000)}
    links, trie = jaccard.spanning_links(family, 9, 10)
    assert len(links) == 999 and trie.steps < 2 * 1_000


def test_near_copies_in_blocks_of_many_parts(spark, frame, monkeypatch):
    monkeypatch.setattr(jaccard, "SETS", 20)
    monkeypatch.setattr(jaccard, "WIDE", 50)
    monkeypatch.setattr(jaccard, "PASSING", 30)
    texts = [" ".join(f"w{x}" for x in own) for own in near_copies(150).values()]
    texts += [" ".join(f"w{x}" for x in [*range(180), *range(k, k + 9)]) for k in range(300, 330)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_groups(spark, frame(list(enumerate(texts)), "doc_id long, text string"), 1, 9, 10).collect()}
    assert got == groups(texts, 1, 9, 10)


def test_texts_that_share_a_passage_but_too_little_are_no_candidates(spark, frame, monkeypatch):
    """Their common shingles are in no set's shorter prefix, so nothing is walked; those that share more link."""
    passage = " ".join(f"p{i}" for i in range(84))
    own = lambda i, n: " ".join(f"t{i}x{j}" for j in range(n))
    texts = [f"{passage} {own(i, 16)}" for i in range(30)]
    texts += [f"{passage.replace('p', 'q')} {own(50 + i, 8)}" for i in range(4)]
    walked = []
    block_links = jaccard.block_links
    monkeypatch.setattr(jaccard, "block_links", lambda rows, num, den: walked.append(rows.select("node").distinct().count()) or block_links(rows, num, den))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_groups(spark, frame(list(enumerate(texts)), "doc_id long, text string"), 1, 8, 10).collect()}
    assert got == groups(texts, 1, 8, 10)
    assert len({c for _, c in got.values()}) == 31 and walked == [4]


def spanned(monkeypatch, edges, order):
    """The components that ``spanning_links`` finds in a graph of which these nodes come first."""
    near = {k: [b for e in edges for a, b in (e, e[::-1]) if a == k] for k in order}

    class Graph:
        def __init__(self, sets, num, den):
            self.keys = list(order)

        def nearest(self, most):
            return self.keys[:most]

        def probes(self, keys):
            return keys

        def walk(self, keys):
            for k in self.keys:
                if linked := [at for at, x in enumerate(keys) if x == k or x in near[k]]:
                    yield k, np.array(linked)

    monkeypatch.setattr(jaccard, "Trie", Graph)
    links, _ = jaccard.spanning_links(dict.fromkeys(order), 9, 10)
    assert len(links) < len(order) and all(b in near[a] for a, b in links)
    return len(set(components(order, links).values()))


def test_no_link_is_lost_when_the_largest_component_changes(monkeypatch):
    edges = [("c1", "c2"), ("l", "z"), ("l", "y"), ("m1", "m2"), ("m1", "m3"), ("m1", "x"), ("c2", "z"), ("y", "x")]
    assert spanned(monkeypatch, edges, ["c1", "c2", "l", "z", "y", "m1", "m2", "m3", "x"]) == 1


def test_drift_chains_are_one_component_in_any_order_of_walks(monkeypatch):
    rng = random.Random(3)
    for n in [*range(2, 40)] * 5 + [300]:
        order = rng.sample(range(n), n)
        assert spanned(monkeypatch, [(i, i + 1) for i in range(n - 1)], order) == 1
        split = rng.randrange(n - 1)
        assert spanned(monkeypatch, [(i, i + 1) for i in range(n - 1) if i != split], order) == 2


@pytest.mark.parametrize(("name", "most"), [("PART", 300), ("SETS", 3), ("WIDE", 20)])
def test_blocks_in_parts(spark, frame, monkeypatch, name, most):
    """Families much larger than a part, with outsiders, are still connected across the parts."""
    monkeypatch.setattr(jaccard, "SETS", 10)
    monkeypatch.setattr(jaccard, name, most)
    rng = random.Random(most)
    texts = []
    for _ in range(3):
        base = [f"{rng.choice('abcdefgh')}{rng.randint(0, 99)}" for _ in range(60)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(60)] = f"n{rng.randint(0, 9)}"
            texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_groups(spark, frame(list(enumerate(texts)), "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == groups(texts, 3, 9, 10)


def test_components(spark, frame):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(10, 60)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    edges = [(hash((a, 1)), hash((b, 1))) for a, b in edges]
    root = {}
    for a, b in edges:
        x, y = root.get(a, a), root.get(b, b)
        root = {k: min(x, y) if v in (x, y) else v for k, v in ({a: x, b: y} | root).items()}
    got = {r.node: r.root for r in connected_components(frame(edges, "a long, b long")).collect()}
    touched = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root[n] for n in touched}
    assert connected_components(frame([], "a long, b long")).count() == 0


def test_packing_is_whole(spark, frame):
    rng = random.Random(2)
    lengths = [None, 0, 1, 512, 4096, 4097, 20_000] + [int(rng.lognormvariate(5, 1.5)) for _ in range(600)]
    docs = frame([(i // 2, n, "x", 1, 2, 3) for i, n in enumerate(lengths)], "doc_id long, n long, PIECE string, _n int, tie int, Rank int").withColumn("text", F.concat(F.lit("t"), F.col("n").cast("string")))
    out = packing.pack(docs, F.col("n"), salts=4)
    assert out.columns == ["doc_id", "n", "_n", "tie", "Rank", "piece", "n_tokens", "bin_id", "bin_offset", "capacity"]
    out = out.collect()
    assert {(r["_n"], r["tie"], r["Rank"]) for r in out} == {(1, 2, 3)}
    assert sum(r.n_tokens for r in out) == sum(n or 0 for n in lengths)
    bins = {}
    for r in out:
        if r.n_tokens:
            bins.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.n_tokens))
    assert sum(r.bin_id is None for r in out) == 2 == sum(not n for n in lengths)
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), inside in bins.items():
        inside.sort()
        ends = [a + n for a, n in inside]
        assert [a for a, _ in inside] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert capacity == min(c for c in packing.CAPACITIES if c >= ends[-1])


def test_plan_against_plain_best_fit():
    rng = random.Random(8)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    plan = packing.Plan({n: lengths.count(n) for n in set(lengths)}, capacities=(100,), overhead=0)
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(100 - n)
    assert plan.n_bins <= len(rooms) * 1.01
    several = packing.Plan({n: lengths.count(n) for n in set(lengths)}, capacities=(25, 50, 100), overhead=0)
    assert sum(n * c for _, n, c in several.bins) <= sum(n * c for _, n, c in plan.bins)


def fillings(left, length, capacity):
    """What a bin would hold, piece by piece: always the longest one, no longer than ``length``, that fits."""
    left, used = dict(left), 0
    while fit := [n for n, c in left.items() if c and n <= min(length, capacity - used)]:
        left[max(fit)] -= 1
        used += max(fit)
    return used


def test_openings_are_the_cheapest_of_simulated_fillings():
    rng = random.Random(12)
    for _ in range(60):
        histogram = {rng.randint(1, 64): rng.randint(1, 5) for _ in range(rng.randint(1, 12))}
        plan, overhead = packing.Plan({}, (16, 40, 64), 3), 3
        plan.left, plan.lengths, length = dict(histogram), sorted(histogram), max(histogram)
        per_token = {}
        for c in (16, 40, 64):
            if c >= length:
                used = fillings(histogram, length, c)
                per_token[c] = (min(x for x in (16, 40, 64) if x >= used) + overhead) / used
        assert plan.opening(length) == min(per_token, key=lambda c: (per_token[c], -c))


def test_plans_depend_on_capacity_not_on_pieces():
    """A plan for a thousand times the pieces has about as many rows; one for 32,768 tokens is made in seconds."""
    rng = random.Random(13)
    shape = [int(rng.lognormvariate(5.5, 1.2)) % 4096 + 1 for _ in range(3000)]
    rows = [len(packing.plan_rows(packing.Plan({n: shape.count(n) * times for n in set(shape)}))) for times in (1_000, 1_000_000)]
    assert rows[1] <= 1.3 * rows[0] < packing.BROADCAST
    began = time.perf_counter()
    plan = packing.Plan({n: rng.randint(1, 1000) for n in range(1, 32_769)}, (4096, 8192, 16_384, 32_768))
    assert time.perf_counter() - began < 30 and sum(n for _, _, n, _, _ in plan.places) == sum(plan_counts(plan).values())


def plan_counts(plan):
    out = {}
    for length, rank, n, _, _ in plan.places:
        assert rank == out.get(length, 0)  # ranks of a length follow one another without gaps
        out[length] = rank + n
    return out


def test_large_plans_are_joined_without_broadcast(spark, frame, monkeypatch):
    docs = frame([(i, i % 50 * 90) for i in range(400)], "doc_id long, n long").withColumn("text", F.col("n").cast("string"))
    whole = sorted(map(tuple, packing.pack(docs, F.col("n")).collect()), key=str)
    monkeypatch.setattr(packing, "BROADCAST", 3)
    assert sorted(map(tuple, packing.pack(docs, F.col("n")).collect()), key=str) == whole


def test_packing_edges(spark, frame):
    long = frame([(1, "w " * 300_000)], "doc_id long, text string")
    assert packing.pack(long, packing.n_words(F.col("text"))).agg(F.sum("n_tokens"), F.max("piece")).first() == (300_000, 73)
    assert packing.pack(frame([], "doc_id long, text string"), packing.n_words(F.col("text"))).count() == 0
    words = frame([(1, None), (2, ""), (3, " a\x0bb\n"), (4, "é ö")], "doc_id long, text string").select("doc_id", packing.n_words(F.col("text")).alias("n"))
    assert dict(words.collect()) == {1: 0, 2: 0, 3: 2, 4: 2}
