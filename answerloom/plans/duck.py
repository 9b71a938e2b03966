"""DuckDB expressions for the oracles: the string functions once more, in another engine."""

from __future__ import annotations

from answerloom.functions.tables import ARTICLES, CONTRACTIONS, NUMBERS, PUNCTUATION


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: White space: what Unicode calls so, and the four separators U+001C to U+001F.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def filled(template: str, **values: str) -> str:
    """A template as a concatenation, with expressions for its ``{name}`` places."""
    parts = [template]
    for name, value in values.items():
        parts = [x for part in parts for x in ([part] if isinstance(part, list) else split(part, "{" + name + "}", value))]
    return " || ".join(part[0] if isinstance(part, list) else quoted(part) for part in parts if part)


def split(text: str, place: str, value: str) -> list:
    out: list = []
    for k, part in enumerate(text.split(place)):
        out += ([[value]] if k else []) + [part]
    return out


def json(x: str) -> str:
    """A string as a JSON string."""
    return f"CAST(to_json({x}) AS VARCHAR)"


def mapping(pairs: dict[str, str], key: str) -> str:
    return f"coalesce(map_extract_value(MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in pairs.items())}}}, {key}), {key})"


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the value, which is evaluated once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def normalize(x: str) -> str:
    t = "t_"
    out = t
    for p in PUNCTUATION:
        near = f"contains({t}, {quoted(p + ' ')}) OR contains({t}, {quoted(' ' + p)})"
        out = rf"replace({out}, {quoted(p)}, CASE WHEN {near} OR regexp_matches({t}, '\p{{Nd}},\p{{Nd}}') THEN '' ELSE ' ' END)"
    out = rf"replace(replace(regexp_replace({out}, '\.(\p{{Nd}})', chr(1) || '\1', 'g'), '.', ''), chr(1), '.')"
    words = rf"list_filter(regexp_split_to_array(lower({out}), '{SPACE}+'), lambda w: w <> '')"
    words = f"list_filter(list_transform({words}, lambda w: {mapping(NUMBERS, 'w')}), lambda w: w NOT IN ({', '.join(map(quoted, ARTICLES))}))"
    words = f"array_to_string(list_transform({words}, lambda w: {mapping(CONTRACTIONS, 'w')}), ' ')"
    return bound(strip(f"replace(replace({x}, chr(10), ' '), chr(9), ' ')"), t, words)


def strict(x: str) -> str:
    return strip(f"list_last(regexp_extract_all({x}, '(?s)<answer>(.*?)</answer>', 1))")


def lenient(x: str) -> str:
    return f"coalesce({strict(x)}, {strip(x)})"


def matches(prediction: str, golds: str) -> str:
    return bound(normalize(prediction), "p_", f"len(list_filter(list_transform({golds}, lambda g_: {normalize('g_')}), lambda n_: n_ = p_))")


def fraction(dataset: str, prediction: str, golds: str) -> str:
    """The score as [num, den]."""
    panel = f"{dataset} IN ('vqav2', 'textvqa') AND len({golds}) >= 2"
    m, n = "m_", f"len({golds})"
    both = f"CASE WHEN {panel} THEN [{m} * least(3, greatest({m} - 1, 0)) + ({n} - {m}) * least(3, {m}), 3 * {n}] ELSE [CASE WHEN {m} > 0 THEN 1 ELSE 0 END, 1] END"
    return bound(matches(prediction, golds), m, both)
