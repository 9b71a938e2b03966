"""Chat formatting: tool calls and their results linked, ordered, validated, and written as canonical JSON.

A message is (conv_id, turn, role, text). Assistant texts may hold ``<tool_call>{"id", "name", "arguments"}</tool_call>``
blocks; a message of role ``tool`` is ``{"tool_call_id", "content"}``. An argument ``{"$ref": id}`` stands for the result
of another call. Per message come out: its calls, how many of them are valid and how many have a result, whether a
result has its call, its ``level`` in the topological order, and the message as canonical JSON (sorted keys, no spaces,
no escapes but needed ones).

* *Linking* is an equi-join of calls and results by (conversation, identifier). Of calls with one identifier in a
  conversation the first (by turn, then by place) owns it.
* *Order.* A call without references is at level 0, its result one level later, and a call that refers to others one
  level after the last of their results. Calls in a cycle, or that refer to no call, never settle: their level is null.
  (level, turn) orders a conversation topologically. Conversations are ordered in one pass, as long as their calls and
  references are HELD at most; longer ones in rounds over all of them at once, with the same result. See ``levels``.
* *Validation.* Arguments must be an object with the schema's required members, of the schema's types, and no others
  unless the schema permits them.

Nothing but ids and references is gathered by conversation, and of those HELD at most, so its length doesn't matter. Edge
cases: a null or unparsable text, a very long one too, is plain text. A block that is no JSON object is a call without id,
name or arguments, with an error; its text stays in the content, and the calls beside it are calls. An opening tag without
a closing one is text. JSON that can't be written back as it was meant is not parsed, either: objects that name a member
twice, ``NaN``, infinite numbers and those that no double holds, escaped lone surrogates. Values may be nested however
deep. A tool message can't change its role: a member ``role`` of it is replaced. A tool message without a call is
``linked`` false; repeated messages are kept and linked each; an unknown tool or a missing id makes a call invalid. A null
``conv_id`` never links. Other columns are left out. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from json.decoder import scanstring
from math import isfinite
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import materialize

OPEN, CLOSE = "<tool_call>", "</tool_call>"
TYPES: dict[str, Any] = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}
PARSED = "calls array<struct<id string, name string, valid boolean, error string, refs array<string>>>, result_of string, message string"
#: Calls and references of a conversation that one task orders at once.
HELD = 500_000
#: No way through a conversation's calls is longer; only lengths in a cycle would be.
LONGEST = 1 << 40
#: The schemas of the query's tools.
TOOLS = {"reply": {"required": ["prompt", "turn"], "properties": {"prompt": "string", "turn": "integer", "context": "object"}}}


def canonical(value: Any) -> str:
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except RecursionError:
        return deeply_written(value)


def deeply_written(value: Any) -> str:
    """Canonical JSON of a value that is nested deeper than recursion goes."""
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, value)]  # what is yet to be written: text as it is, or a value
    while todo:
        is_text, v = todo.pop()
        if is_text:
            out.append(v)
        elif isinstance(v, (dict, list)) and v:
            names = [json.dumps(k, ensure_ascii=False) + ":" for k in sorted(v)] if isinstance(v, dict) else [""] * len(v)
            values = [v[k] for k in sorted(v)] if isinstance(v, dict) else v
            first, last = "{}" if isinstance(v, dict) else "[]"
            todo.append((True, last))
            for k in range(len(v) - 1, -1, -1):
                todo += [(False, values[k]), (True, (first if k == 0 else ",") + names[k])]
        else:
            out.append(json.dumps(v, ensure_ascii=False, allow_nan=False))
    return "".join(out)


def once(pairs: list[tuple[str, Any]]) -> dict:
    """An object of members with names of their own."""
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a member is named twice")
    return out


def finite(number: str) -> float:
    if not isfinite(value := float(number)):
        raise ValueError(f"no double holds {number}")
    return value


def deeply_read(text: str) -> Any:
    """The value of a JSON text that is nested deeper than recursion goes."""
    after_space = lambda i: SPACE.match(text, i).end()
    held: list[tuple[str, list]] = []  # open objects and lists: how they close, and what they hold
    names: list[str] = []

    def named(i: int) -> int:
        """Reads a member's name; where its value begins."""
        if text[i : i + 1] != '"':
            raise ValueError("a member has no name")
        name, i = scanstring(text, i + 1, True)
        names.append(name)
        i = after_space(i)
        if text[i : i + 1] != ":":
            raise ValueError("a member has no value")
        return after_space(i + 1)

    at = after_space(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            close = "}" if c == "{" else "]"
            at = after_space(at + 1)
            if text[at : at + 1] != close:
                held.append((close, []))
                at = named(at) if close == "}" else at
                continue
            value, at = {} if close == "}" else [], at + 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif found := ATOM.match(text, at):
            value, at = json.loads(found[0], parse_float=finite), found.end()
        else:
            raise ValueError("no value")
        while True:  # a value has ended, and whatever ends with it
            at = after_space(at)
            if not held:
                if at < len(text):
                    raise ValueError("more than a value")
                return value
            close, inside = held[-1]
            inside.append((names.pop(), value) if close == "}" else value)
            c, at = text[at : at + 1], at + 1
            if c == ",":
                at = after_space(at)
                at = named(at) if close == "}" else at
                break
            if c != close:
                raise ValueError("not closed")
            held.pop()
            value = once(inside) if close == "}" else inside


SPACE, ATOM = re.compile(r"[ \t\n\r]*"), re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")


def parsed(text: str | None) -> dict | None:
    """The JSON object of a text, or None where it holds none that canonical JSON can express."""
    try:
        try:
            found = json.loads(text or "", object_pairs_hook=once, parse_float=finite, parse_constant=finite)
        except RecursionError:
            found = deeply_read(text or "")
        if not isinstance(found, dict):
            return None
        canonical(found).encode()
    except ValueError:  # UnicodeEncodeError, of lone surrogates, is a ValueError
        return None
    return found


def fault(call: dict, tools: dict[str, dict]) -> str | None:
    """Why a call isn't valid, or None."""
    schema, arguments = tools.get(call.get("name")) if isinstance(call.get("name"), str) else None, call.get("arguments")
    if not isinstance(call.get("id"), str) or not call["id"]:
        return "no id"
    if schema is None:
        return "unknown tool"
    if not isinstance(arguments, dict):
        return "arguments are no object"
    for name in schema.get("required", ()):
        if name not in arguments:
            return f"missing: {name}"
    for name in sorted(arguments):
        kind = schema.get("properties", {}).get(name)
        if kind is None and not schema.get("additional", False):
            return f"not in the schema: {name}"
        if kind and not (isinstance(arguments[name], dict) and set(arguments[name]) == {"$ref"}):
            if not isinstance(arguments[name], TYPES[kind]) or (isinstance(arguments[name], bool) and kind in ("integer", "number")):
                return f"not of type {kind}: {name}"
    return None


def references(value: Any) -> list[str]:
    """The ids that ``{"$ref": id}`` objects anywhere in a value name."""
    found, todo = set(), [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict) and set(v) == {"$ref"} and isinstance(v["$ref"], str):
            found.add(v["$ref"])
        elif isinstance(v, (dict, list)):
            todo += v.values() if isinstance(v, dict) else v
    return sorted(found)


def blocks_of(text: str) -> Iterator[tuple[str, str | None]]:
    """(text before it, what is in it) of each block, and at last (the rest, None)."""
    at = 0
    while (start := text.find(OPEN, at)) >= 0 and (end := text.find(CLOSE, start + len(OPEN))) >= 0:
        yield text[at:start], text[start + len(OPEN) : end]
        at = end + len(CLOSE)
    yield text[at:], None


def message(role: str | None, text: str | None, tools: dict[str, dict]) -> tuple[list[dict], str | None, str]:
    """A message's calls, the id whose result it is, and its canonical JSON."""
    if role == "tool" and (found := parsed(text)) and isinstance(found.get("tool_call_id"), str):
        return [], found["tool_call_id"], canonical({**found, "role": role})
    calls, written, content = [], [], []
    for before, inside in blocks_of(text) if role == "assistant" and text and OPEN in text else ():
        content.append(before)
        if inside is None:
            break
        if (call := parsed(inside)) is None:
            calls.append({"id": None, "name": None, "valid": False, "error": "no JSON object", "refs": []})
            content.append(OPEN + inside + CLOSE)
            continue
        why, arguments = fault(call, tools), call.get("arguments")
        calls.append({"id": call.get("id") if isinstance(call.get("id"), str) else None, "name": call["name"] if isinstance(call.get("name"), str) else None, "valid": why is None, "error": why, "refs": references(arguments)})
        written.append({k: call.get(k) for k in ("id", "name", "arguments")})
    if calls:
        return calls, None, canonical({"role": role, "content": "".join(content).strip(), "tool_calls": written})
    return [], None, canonical({"role": role, "content": text})


def settled(refs: dict[str, list[str]]) -> dict[str, int]:
    """The levels of a conversation's calls that settle, by the distinct calls that each refers to: a call is reached when
    the last of those is, so each reference is followed once."""
    users, waits = defaultdict(list), {call: len(of) for call, of in refs.items()}
    for call, of in refs.items():
        for r in of:
            users[r].append(call)
    level = {call: 0 for call in refs if not waits[call]}
    way: dict[str, int] = defaultdict(int)
    reached = list(level)
    for call in reached:  # which grows meanwhile
        for user in users[call]:
            way[user] = max(way[user], level[call] + 2)
            waits[user] -= 1
            if not waits[user]:
                level[user] = way[user]
                reached.append(user)
    return level


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of those ``calls`` (conv_id, id, refs), unique by conversation and id, that settle.

    A conversation of HELD calls and references at most is settled in one task, in time linear in them, however its
    references follow one another. Longer ones go through ``levels_in_rounds``, which holds none of them whole.
    """
    calls = materialize(calls.select("conv_id", "id", F.array_distinct("refs").alias("refs")))
    sizes = calls.groupBy("conv_id").agg(F.sum(F.size("refs") + 1).alias("n"))
    large = materialize(sizes.where(F.col("n") > HELD).select("conv_id"))
    any_large = not large.isEmpty()
    held = calls.join(large, "conv_id", "left_anti") if any_large else calls

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in zip(batch["conv_id"], batch["id"], batch["refs"], strict=True))
        out: list[tuple] = []
        for conv_id, of in groupby(rows, key=lambda r: r[0]):
            out += [(conv_id, call, level) for call, level in settled({call: list(refs) for _, call, refs in of}).items()]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["conv_id", "id", "level"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "id", "level"])

    schema = f"conv_id {calls.schema['conv_id'].dataType.simpleString()}, id string, level int"
    out = held.repartition("conv_id").sortWithinPartitions("conv_id").mapInPandas(each, schema)
    return out.unionByName(levels_in_rounds(calls.join(large, "conv_id", "left_semi"))) if any_large else out


def levels_in_rounds(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of those ``calls`` (conv_id, id, refs), unique by conversation and id, that settle.

    Every call has a base (the longest way known to a call without references) and edges to calls that it still waits
    for, with the length of the way there. In a round, an edge to a settled call goes into the base, one to a call that
    waits for a single other is replaced by one to that other, and the rest stay. So there are never more edges than
    references; a chain of n calls takes log2(n) rounds, since ways double in length, and calls that wait for several
    settle in as many rounds as such calls follow one another. A round in which no call settles is the last.
    """
    calls = materialize(calls)
    nodes = calls.select("conv_id", "id", F.lit(0).cast("long").alias("base"))
    edges = materialize(calls.select("conv_id", "id", F.explode(F.array_distinct("refs")).alias("ref"), F.lit(2).cast("long").alias("way")))
    waiting = edges.select("conv_id", "id").distinct().count()
    while waiting:
        # of each call: its base, how many it waits for, and, where it is one, which
        waits = edges.groupBy("conv_id", "id").agg(F.count("*").alias("edges"), F.min("ref").alias("next"), F.min("way").alias("more"))
        ends = nodes.join(waits, ["conv_id", "id"], "left").select("conv_id", F.col("id").alias("ref"), F.col("base").alias("end_base"), F.coalesce("edges", F.lit(0)).alias("edges"), "next", "more")
        met = materialize(edges.join(ends, ["conv_id", "ref"], "left"))
        gained = met.where("edges < 2").groupBy("conv_id", "id").agg(F.max(F.col("way") + F.col("end_base")).alias("gain"))
        nodes = materialize(nodes.join(gained, ["conv_id", "id"], "left").select("conv_id", "id", F.greatest("base", "gain").alias("base")))
        single = F.col("edges") == 1
        on = met.where("edges > 0 or edges is null").select(
            "conv_id", "id", F.when(single, F.col("next")).otherwise(F.col("ref")).alias("ref"),
            F.least(F.col("way") + F.when(single, F.col("more")).otherwise(0), F.lit(LONGEST)).alias("way"),
        )
        edges = materialize(on.groupBy("conv_id", "id", "ref").agg(F.max("way").alias("way")))
        before, waiting = waiting, edges.select("conv_id", "id").distinct().count()
        if waiting == before:  # what is left is a cycle, or waits for one, or for a call that isn't there
            break
    unsettled = edges.select("conv_id", "id").distinct()
    return nodes.join(unsettled, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.col("base").cast("int").alias("level"))


def format_chat(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """A row per message: ``conv_id``, ``turn``, ``role``, ``kind`` (message, calls or result), ``n_calls``, ``n_valid``,
    ``n_answered`` (calls with a result), ``linked`` (of a result: whether its call is there; else null), ``level``
    (null for plain messages and what doesn't settle), ``error`` (the first call's that has one) and ``message``."""

    @F.pandas_udf(PARSED)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for roles, texts in batches:
            yield pd.DataFrame([message(r, t, tools) for r, t in zip(roles, texts, strict=True)], columns=["calls", "result_of", "message"])

    rows = materialize(messages.select("conv_id", "turn", "role", read.asNondeterministic()("role", "text").alias("_m"), F.monotonically_increasing_id().alias("_row")).select("conv_id", "turn", "role", "_row", "_m.*"))
    calls = rows.select("conv_id", "turn", "_row", F.posexplode("calls").alias("at", "call")).where("call.id is not null and conv_id is not null").select("conv_id", "turn", "_row", "at", "call.id", "call.refs")
    owners = materialize(calls.groupBy("conv_id", "id").agg(F.min_by("refs", F.struct("turn", "_row", "at")).alias("refs")))
    level = levels(owners)
    results = rows.where("result_of is not null").select("conv_id", F.col("result_of").alias("id"), "_row")
    answered = results.select("conv_id", "id").distinct().withColumn("answered", F.lit(1))
    known = materialize(owners.select("conv_id", "id").join(level, ["conv_id", "id"], "left").join(answered, ["conv_id", "id"], "left"))
    of_calls = calls.join(known, ["conv_id", "id"]).groupBy("_row").agg(F.max("level").alias("call_level"), F.count("answered").alias("n_answered"))
    of_results = results.join(known, ["conv_id", "id"]).select("_row", (F.col("level") + 1).alias("result_level"), F.lit(True).alias("has_call"))
    return rows.join(of_calls, "_row", "left").join(of_results, "_row", "left").select(
        "conv_id", "turn", "role",
        F.when(F.col("result_of").isNotNull(), "result").when(F.size("calls") > 0, "calls").otherwise("message").alias("kind"),
        F.size("calls").alias("n_calls"),
        F.size(F.filter("calls", lambda c: c["valid"])).alias("n_valid"),
        F.coalesce("n_answered", F.lit(0)).alias("n_answered"),
        F.when(F.col("result_of").isNotNull(), F.coalesce("has_call", F.lit(False))).alias("linked"),
        F.coalesce("call_level", "result_level").alias("level"),
        F.get(F.filter(F.transform("calls", lambda c: c["error"]), lambda e: e.isNotNull()), F.lit(0)).alias("error"),
        "message",
    )


def as_tool_use(conversations: DataFrame) -> DataFrame:
    """Plain conversations in the shape of tool use, with all that can be wrong with it.

    A user turn is the call of a tool ``reply`` with the turn's text, which refers to the call two turns before; the
    assistant's turn after it is the result. By ``conv_id * 3 + turn`` some calls lack an argument (3 modulo 13), refer
    to two calls (5) or to themselves (7), name an unknown tool (9), give an argument too many (11) or come after a block
    that is no JSON (1), and some results name no call (4 modulo 11).
    """
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    ref = lambda back: F.when(F.col("turn") >= back, F.struct(name(F.col("turn") - back).alias("$ref")))
    place = F.col("conv_id") * 3 + F.col("turn")
    kind = F.pmod(place, F.lit(13))
    context = (
        F.when(kind == 5, F.to_json(F.struct(ref(2).alias("before"), ref(4).alias("earlier"))))
        .when(kind == 7, F.to_json(ref(0))).otherwise(F.to_json(ref(2)))
    )
    member = lambda key, value: F.concat(F.lit(f',"{key}":'), value)
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]\z", "")
    arguments = F.concat(
        F.lit('{"turn":'), F.col("turn").cast("string"), F.when(kind != 3, member("prompt", quoted(F.coalesce("text", F.lit(""))))).otherwise(""),
        F.when(kind == 11, member("tone", F.lit('"plain"'))).otherwise(""), F.coalesce(member("context", context), F.lit("")), F.lit("}"),
    )
    call = F.concat(F.lit('{"id":'), quoted(name(F.col("turn"))), member("name", F.when(kind == 9, '"answer"').otherwise('"reply"')), member("arguments", arguments), F.lit("}"))
    answers = F.when(F.pmod(place, F.lit(11)) == 4, F.lit("gone")).otherwise(name(F.col("turn") - 1))
    result = F.to_json(F.struct(answers.alias("tool_call_id"), F.col("text").alias("content")))
    asked, told = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn",
        F.when(asked, "assistant").when(told, "tool").otherwise(F.col("role")).alias("role"),
        F.when(asked, F.concat(F.when(kind == 1, OPEN + "not JSON" + CLOSE).otherwise(""), F.lit(OPEN), call, F.lit(CLOSE))).when(told, result).otherwise(F.col("text")).alias("text"),
    )


#: DuckDB SQL for the query. Of the calls of a conversation, ``lost`` are those that never settle: the ones that refer
#: to themselves or to no call, and whatever refers to those; ``ways`` are the lengths of all ways to the others.
ORACLE = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text, (conv_id * 3 + turn) % 13 AS kind, (conv_id * 3 + turn) % 11 = 4 AS astray,
         'c' || CAST(conv_id AS VARCHAR) || '-' AS c FROM conversations),
calls AS (
  SELECT conv_id, turn, CASE WHEN kind = 7 THEN [turn] WHEN turn < 2 THEN [] WHEN kind = 5 AND turn >= 4 THEN [turn - 2, turn - 4] ELSE [turn - 2] END AS refs
  FROM t WHERE role = 'user'),
edges AS (SELECT conv_id, turn, unnest(refs) AS ref FROM calls),
lost AS (
  SELECT e.conv_id, e.turn FROM edges e LEFT JOIN calls c ON c.conv_id = e.conv_id AND c.turn = e.ref WHERE c.turn IS NULL OR e.ref = e.turn
  UNION SELECT e.conv_id, e.turn FROM edges e JOIN lost ON lost.conv_id = e.conv_id AND lost.turn = e.ref),
ways AS (
  SELECT conv_id, turn, 0 AS level FROM calls WHERE len(refs) = 0
  UNION SELECT e.conv_id, e.turn, level + 2 FROM edges e JOIN ways ON ways.conv_id = e.conv_id AND ways.turn = e.ref WHERE e.ref <> e.turn),
levels AS (
  SELECT c.conv_id, c.turn, max(CASE WHEN lost.turn IS NULL THEN level END) AS level
  FROM calls c LEFT JOIN ways w ON w.conv_id = c.conv_id AND w.turn = c.turn LEFT JOIN lost ON lost.conv_id = c.conv_id AND lost.turn = c.turn GROUP BY ALL),
parts AS (
  SELECT t.*, own.level AS own_level, asked.level AS asked_level, asked.turn IS NOT NULL AND NOT astray AS has_call,
    EXISTS (FROM t AS r WHERE r.conv_id = t.conv_id AND r.turn = t.turn + 1 AND r.role = 'assistant' AND NOT r.astray) AS answered,
    CASE WHEN kind = 7 THEN '"context":{"$ref":"' || c || CAST(t.turn AS VARCHAR) || '"},' WHEN kind = 5 AND t.turn >= 2
         THEN '"context":{"before":{"$ref":"' || c || CAST(t.turn - 2 AS VARCHAR) || '"}' || CASE WHEN t.turn >= 4 THEN ',"earlier":{"$ref":"' || c || CAST(t.turn - 4 AS VARCHAR) || '"}' ELSE '' END || '},'
         WHEN kind = 5 THEN '"context":{},' WHEN t.turn >= 2 THEN '"context":{"$ref":"' || c || CAST(t.turn - 2 AS VARCHAR) || '"},' ELSE '' END AS context
  FROM t LEFT JOIN levels own ON own.conv_id = t.conv_id AND own.turn = t.turn
  LEFT JOIN levels asked ON asked.conv_id = t.conv_id AND asked.turn = t.turn - 1)
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'tool' ELSE role END AS role,
  CASE role WHEN 'user' THEN 'calls' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE WHEN role <> 'user' THEN 0 WHEN kind = 1 THEN 2 ELSE 1 END AS n_calls,
  CASE WHEN role = 'user' AND kind NOT IN (3, 9, 11) THEN 1 ELSE 0 END AS n_valid,
  CAST(CASE WHEN role = 'user' AND answered THEN 1 ELSE 0 END AS BIGINT) AS n_answered,
  CASE WHEN role = 'assistant' THEN has_call END AS linked,
  CASE WHEN role = 'user' THEN own_level WHEN role = 'assistant' AND has_call THEN asked_level + 1 END AS level,
  CASE WHEN role = 'user' THEN CASE kind WHEN 1 THEN 'no JSON object' WHEN 3 THEN 'missing: prompt' WHEN 9 THEN 'unknown tool' WHEN 11 THEN 'not in the schema: tone' END END AS error,
  CASE role
    WHEN 'user' THEN '{"content":"' || CASE WHEN kind = 1 THEN '<tool_call>not JSON</tool_call>' ELSE '' END || '","role":"assistant","tool_calls":[{"arguments":{' || context || CASE WHEN kind <> 3 THEN '"prompt":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',' ELSE '' END
      || CASE WHEN kind = 11 THEN '"tone":"plain",' ELSE '' END || '"turn":' || CAST(turn AS VARCHAR) || '},"id":"' || c || CAST(turn AS VARCHAR) || '","name":"' || CASE WHEN kind = 9 THEN 'answer' ELSE 'reply' END || '"}]}'
    WHEN 'assistant' THEN '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || CAST(to_json(text) AS VARCHAR) || ',' END || '"role":"tool","tool_call_id":"' || CASE WHEN astray THEN 'gone' ELSE c || CAST(turn - 1 AS VARCHAR) END || '"}'
    ELSE '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' END AS message
FROM parts
"""
