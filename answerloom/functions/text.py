"""String functions: stripping, cleaning, answer normalization, tag extraction, templates and number formats.

All are native Column expressions. White space and digits follow Unicode (``(?U)``), with the four separators
U+001C to U+001F counted as white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.tables import ARTICLES, CONTRACTIONS, NUMBERS, PUNCTUATION

SPACE = r"[\s\x1c-\x1f]"
OPEN, CLOSE = "<answer>", "</answer>"
TAGGED = r"(?s)<answer>(.*?)</answer>"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end. A run of it is looked at once, from where it begins, so long runs
    inside of a text take linear time."""
    return F.regexp_replace(x, rf"(?U)^{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def clean_answer(x: Column) -> Column:
    """Stripped, without one final period, lower-cased."""
    return F.lower(F.regexp_replace(strip(x), r"\.\z", ""))


def first_line(x: Column) -> Column:
    return F.split(x, "\n", 2)[0]


def drop_punctuation(x: Column) -> Column:
    """Each mark goes if it stands by a space anywhere in the text, or if digits are parted by a comma; else it
    becomes a space. Periods go unless a digit follows."""
    marks = "".join(PUNCTUATION)
    each = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
    by_space = F.array_join(F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?<= ){each}|{each}(?= )"), F.lit(0))), "")
    gone = F.when(x.rlike(r"(?U)\d,\d"), F.lit(marks)).otherwise(by_space)
    without = F.call_function("translate", x, gone, F.lit(""))
    return F.regexp_replace(F.translate(without, marks, " " * len(marks)), r"(?U)\.(?!\d)", "")


def plain_words(x: Column) -> Column:
    """Lower-cased words: number words as digits, articles dropped, contractions with their apostrophes."""
    # most words are no keys: a hash set tells, so that few of them search the map
    mapped = lambda pairs, w: F.when(w.isin(*pairs), F.element_at(F.create_map(*[F.lit(s) for pair in pairs.items() for s in pair]), w)).otherwise(w)
    words = F.filter(F.split(F.lower(x), rf"(?U){SPACE}+"), lambda w: w != "")
    words = F.transform(words, lambda w: mapped(NUMBERS, w))
    words = F.filter(words, lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(words, lambda w: mapped(CONTRACTIONS, w)), " ")


def normalize_answer(x: Column) -> Column:
    """The normal form in which answers are compared."""
    return plain_words(drop_punctuation(strip(F.translate(x, "\n\t", "  "))))


def up_to_last(x: Column, mark: str, with_mark: bool) -> Column:
    """What stands before the last ``mark``, or that and the mark; empty without one."""
    after = F.length(F.substring_index(x, mark, -1))
    return F.when(x.contains(mark), F.substring(x, F.lit(1), F.length(x) - after - (0 if with_mark else len(mark)))).otherwise(F.when(x.isNotNull(), ""))


def strict_answer(x: Column) -> Column:
    """The stripped content of the last answer tag; null if there is none, empty if it is.

    Nothing after the last closing tag is searched, so every tag that opens is closed, and the search is linear."""
    return strip(F.try_element_at(F.regexp_extract_all(up_to_last(x, CLOSE, True), F.lit(TAGGED), F.lit(1)), F.lit(-1)))


def extract_answer(x: Column) -> Column:
    """The stripped content of the last answer tag, or else the whole text, stripped."""
    return F.coalesce(strict_answer(x), strip(x))


def reasoning_part(x: Column) -> Column:
    """What stands before the last complete answer tag, stripped; null without one."""
    closed = up_to_last(x, CLOSE, True)
    return F.when(closed.contains(OPEN), strip(up_to_last(closed, OPEN, False)))


def fill(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled at once, so that a value may hold braces."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((i for n in values if (i := rest.find("{" + n + "}")) >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = next(n for n in values if rest.startswith("{" + n + "}", at))
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def remove_suffix(x: Column, suffix: Column) -> Column:
    return F.when(x.endswith(suffix), F.substring(x, F.lit(1), F.length(x) - F.length(suffix))).otherwise(x)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, its exact value rounded half-even, without thousands separators."""
    return F.call_function("format_number", x, F.lit("0" + ("." + "0" * digits if digits else "")))


def signed(x: Column, digits: int) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), fixed(x, digits))
