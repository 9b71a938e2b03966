"""Licence scans: Aho-Corasick over identifier tags and notice phrases, licence expressions by shunting-yard.

A text is reduced to its words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``), joined by single spaces. One
automaton over all phrases, with a space before and after each, finds every place where a phrase's words stand
consecutively, in one pass whatever the number of phrases; places may overlap.

* *Base phrases* (BASE) give the base labels, their places are counted.
* *Notice phrases* (NOTICES) give labels of the method's own, each with a weight: how surely the phrase means that licence.
* *Identifier tags* (TAGS): what follows one on its line is read as a licence expression: identifiers, ``AND``, ``OR``,
  ``WITH`` (of any case) and brackets, WITH before AND before OR. A shunting-yard parser makes postfix of it, which is
  evaluated twice: to the identifiers it names, and to its grade. Grades run from 0 (public domain) over permissive, weak
  and strong copyleft to 4 (no licence, or one that is unknown): of ``OR`` the lower counts, since the reader may choose,
  of ``AND`` the higher, and ``WITH`` an exception takes a grade off copyleft. What can't be parsed is no expression, but
  for its longest beginning that is one, as in ``MIT, see the file``.

``score``: the certainty that the text states a licence: one minus the product of one minus the weight of each distinct
label (a base label's is WEIGHT, an expression's TAGGED). ``grade`` is the highest of any statement of the text, null
where nothing is stated.

One pass over each text, without a shuffle; a row's memory is a few times its text. Edge cases: null, empty and blank texts
have no words, places or labels, and score 0. Very long texts are read whole. Repeated rows get equal results. Labels are
distinct and sorted, so ties have no say. Columns of the input named like the outputs are replaced, all others kept. An
empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import Rows

#: Phrases and labels that the result must count.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrases that state a licence, by label: (phrase, weight) each.
NOTICES = {
    "apache-2.0": [("apache license version 2 0", 0.95), ("licensed under the apache license", 0.9), ("apache license", 0.6)],
    "mit": [("mit license", 0.9), ("mit licence", 0.9), ("permission is hereby granted free of charge to any person obtaining a copy", 0.95)],
    "bsd": [("bsd license", 0.8), ("redistribution and use in source and binary forms", 0.95)],
    "gpl-2.0": [("general public license version 2", 0.95)],
    "gpl-3.0": [("general public license version 3", 0.95)],
    "lgpl": [("lesser general public license", 0.95)],
    "agpl": [("affero general public license", 0.95)],
    "mpl-2.0": [("mozilla public license", 0.9)],
    "cc-by-4.0": [("cc by 4 0", 0.95), ("creative commons attribution 4 0", 0.95)],
    "cc-by-sa": [("cc by sa", 0.95), ("creative commons attribution sharealike", 0.95)],
    "cc-by-nc": [("cc by nc", 0.95), ("creative commons attribution noncommercial", 0.95)],
    "cc0": [("cc0", 0.9), ("public domain dedication", 0.9)],
    "public-domain": [("released into the public domain", 0.9), ("in the public domain", 0.6)],
    "proprietary": [("proprietary and confidential", 0.9), ("unauthorized copying of this file", 0.9), ("no part of this publication may be reproduced", 0.9)],
    "copyright": [("copyright c", 0.5), ("copyright by", 0.3)],
}
#: Tags, as words, that a licence expression follows.
TAGS = ("spdx license identifier", "license expression", "license identifier")
WEIGHT, TAGGED = 0.7, 0.99
#: Grades by the beginning of an identifier, the longest that fits; UNKNOWN for others.
GRADES = {
    "cc0": 0, "unlicense": 0, "public-domain": 0, "0bsd": 0,
    "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "zlib": 1, "cc-by": 1, "python": 1, "psf": 1, "bsl-1.0": 1,
    "lgpl": 2, "mpl": 2, "epl": 2, "cddl": 2,
    "gpl": 3, "agpl": 3, "cc-by-sa": 3,
    "cc-by-nc": 4, "cc-by-nd": 4, "reserved": 4, "proprietary": 4, "copyright": 4, "none": 4,
}
UNKNOWN, COPYLEFT = 4, (2, 3)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "grade")
FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, grade int"
#: Bytes to what stands for them in words: itself, a lower-case letter, or a space.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")


def words_of(text: str | None) -> list[bytes]:
    """A text's words. Of UTF-8, all bytes of characters from U+0080 on are word bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(KEPT).split()


def tokens_of(text: str, at: int) -> list[str]:
    """The tokens from a place on, till something on its line that is none; a full stop or colon at a token's end ends it."""
    out = []
    while found := TOKEN.match(text, at):
        out.append(found[1].lower().rstrip(".:"))
        at = found.end()
        if found[1][-1] in ".:":
            break
    return [t for t in out if t]


def beginning(tokens: list[str]) -> list[str]:
    """The longest beginning of ``tokens`` that is an expression; empty if there is none."""
    whole, depth, before = 0, 0, "or"
    for k, t in enumerate(tokens):
        wanted = before in PRECEDENCE or before == "("  # an identifier or an opening bracket
        if wanted != (t not in PRECEDENCE and t != ")") or (t == "(" and before == "with") or (t == ")" and not depth):
            break
        depth += (t == "(") - (t == ")")
        before = t
        if not depth and t not in PRECEDENCE:
            whole = k + 1
    return tokens[:whole]


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: the tokens of an expression in postfix order."""
    out: list[str] = []
    held: list[str] = []
    for t in tokens:
        if t == "(":
            held.append(t)
        elif t == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif t in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[t]:
                out.append(held.pop())
            held.append(t)
        else:
            out.append(t)
    return out + held[::-1]


def grade_of(identifier: str) -> int:
    fits = [known for known in GRADES if identifier.startswith(known)]
    return GRADES[max(fits, key=len)] if fits else UNKNOWN


def evaluated(expression: list[str]) -> tuple[set[str], int]:
    """The licences that an expression in postfix order names, and its grade. The right side of ``with`` is an exception,
    no licence; only a single identifier can have one."""
    held: list[tuple[set[str], int]] = []
    for t in expression:
        if t not in PRECEDENCE:
            held.append(({t}, grade_of(t)))
            continue
        (right, high), (left, low) = held.pop(), held.pop()
        if t == "with":
            held.append((left, low - 1 if low in COPYLEFT else low))
        else:
            held.append((left | right, min(low, high) if t == "or" else max(low, high)))
    return held[0]


def automaton() -> ahocorasick.Automaton:
    """All phrases, each with its number of words, base label, labels and weights, and whether it is a tag."""
    known: dict[str, tuple] = {}
    for phrase, label in BASE.items():
        known[phrase] = (label, [], False)
    for label, phrases in NOTICES.items():
        for phrase, weight in phrases:
            base, labels, tag = known.get(phrase, (None, [], False))
            known[phrase] = (base, [*labels, (label, weight)], tag)
    for phrase in TAGS:
        base, labels, _ = known.get(phrase, (None, [], True))
        known[phrase] = (base, labels, True)
    out = ahocorasick.Automaton()
    for phrase, value in known.items():
        out.add_word(f" {phrase} ", (len(phrase), *value))
    out.make_automaton()
    return out


def expressions_of(text: str) -> Iterator[list[str]]:
    """The postfix of each licence expression that a tag in ``text`` has."""
    for tag in TAG.finditer(text):
        if found := postfix(beginning(tokens_of(text, tag.end()))):
            yield found


#: A tag as it stands in a text, up to what follows it.
TAG = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(t.replace(" ", "[-_ ]") for t in TAGS) + r")[ \t]{0,9}[:=][ \t]{0,9}", re.IGNORECASE | re.ASCII)


def scanned(text: str | None, phrases: ahocorasick.Automaton) -> tuple:
    """A text's row of FOUND."""
    words = words_of(text)
    joined = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    hits = sorted(((end - length - 1, value) for end, (length, *value) in phrases.iter(joined)), key=lambda hit: hit[0])
    base: set[str] = set()
    weights: dict[str, float] = {}
    places: list[int] = []
    tags, at, word = False, 0, 0
    for start, (label, notices, tag) in hits:  # by place, so that words are counted once
        word, at = word + joined.count(" ", at, start), start
        if label is not None:
            base.add(label)
            weights[label] = max(weights.get(label, 0.0), WEIGHT)
            places.append(word)
        for notice, weight in notices:
            weights[notice] = max(weights.get(notice, 0.0), weight)
        tags |= tag
    grades, expressions = [grade_of(label) for label in weights], []
    for found in expressions_of(text) if tags else ():
        named, grade = evaluated(found)
        expressions.append(" ".join(found))
        grades.append(grade)
        for label in named:
            weights[label] = TAGGED
    doubt = 1.0
    for label in sorted(weights):
        doubt *= 1 - weights[label]
    return (
        len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)),
        ",".join(sorted(weights)), 1 - doubt, expressions, max(grades, default=None),
    )


def scan(documents: DataFrame) -> DataFrame:
    """``documents`` (text, ...) with OUTPUTS: ``n_base`` places of base phrases, the first and last of them by word (from
    0; null without any), the sorted distinct ``base_labels`` and ``labels``, comma-joined, ``score``, the licence
    ``expressions`` in postfix order, and the highest ``grade``."""

    @F.pandas_udf(FOUND)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        phrases = automaton()
        for texts in batches:
            out = pd.DataFrame([scanned(t, phrases) for t in texts], columns=list(OUTPUTS))
            yield out.astype({"first_word": "Int64", "last_word": "Int64", "grade": "Int32", "score": float})

    rows = Rows(documents, OUTPUTS)
    return rows.unpacked(documents.select(rows.row, of("text").alias("found")), "found.*")
