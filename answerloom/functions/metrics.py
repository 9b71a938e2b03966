"""Answer metrics and rewards as Column expressions.

Scores are kept as an exact fraction ``num / den`` wherever they are summed: the accuracy over a panel of n answers,
m of them equal to the prediction, is the mean over annotators of ``min(1, matches among the others / 3)``, which is
``(m * min(3, m - 1) + (n - m) * min(3, m)) / (3 n)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.tables import PANEL_DATASETS
from answerloom.functions.text import CLOSE, OPEN, normalize_answer, strict_answer, strip

MIN_REASONING, MAX_ANSWER = 100, 80


def matches(prediction: Column, golds: Column) -> Column:
    """How many of the gold answers equal the prediction in normal form."""
    own = F.array(normalize_answer(prediction))
    # the prediction's normal form is bound once, not once for each gold answer
    return F.element_at(F.transform(own, lambda p: F.size(F.filter(F.transform(golds, normalize_answer), lambda g: F.coalesce(g == p, F.lit(False))))), 1)


def fraction(dataset: Column, prediction: Column, golds: Column) -> Column:
    """(num, den): accuracy over the panel for panel data sets with two golds or more, exact match otherwise."""
    m, n = matches(prediction, golds).cast("long"), F.size(golds).cast("long")
    pair = lambda m: F.when(
        dataset.isin(*PANEL_DATASETS) & (n >= 2),
        F.struct((m * F.least(F.lit(3), F.greatest(m - 1, F.lit(0))) + (n - m) * F.least(F.lit(3), m)).alias("num"), (3 * n).alias("den")),
    ).otherwise(F.struct((m > 0).cast("long").alias("num"), F.lit(1).cast("long").alias("den")))
    return F.element_at(F.transform(F.array(m), pair), 1)


def value(pair: Column) -> Column:
    return pair["num"] / pair["den"]


def exact_match(prediction: Column, golds: Column) -> Column:
    return (matches(prediction, golds) > 0).cast("double")


def panel_accuracy(prediction: Column, golds: Column) -> Column:
    return value(fraction(F.lit(PANEL_DATASETS[0]), prediction, golds))


def score(dataset: Column, prediction: Column, golds: Column) -> Column:
    return value(fraction(dataset, prediction, golds))


def completion_text(text: Column, messages: Column) -> Column:
    """A completion given as a string, or else the first message's content."""
    return F.coalesce(text, F.get(messages, F.lit(0))["content"])


def correctness_reward(dataset: Column, text: Column, golds: Column) -> Column:
    """The score of the strictly extracted answer; 0 without one."""
    return F.coalesce(F.when(strict_answer(text).isNotNull(), score(dataset, F.coalesce(strict_answer(text), F.lit("")), golds)), F.lit(0.0))


def well_formed(text: Column) -> Column:
    """Reasoning of some length, then one short answer in a tag that ends the text."""
    t = strip(text)
    once = (F.length(t) - F.length(F.replace(t, F.lit(OPEN), F.lit("")))) == len(OPEN)
    reasoning = F.substring_index(t, OPEN, 1)
    tail = F.substring_index(t, OPEN, -1)
    answer = strip(F.when(tail.endswith(CLOSE), F.substring(tail, F.lit(1), F.length(tail) - len(CLOSE))).otherwise(tail))
    found = once & t.endswith(CLOSE) & (F.length(strip(reasoning)) >= MIN_REASONING) & F.length(answer).between(1, MAX_ANSWER) & ~answer.contains("<")
    return F.coalesce(found, F.lit(False))


def format_reward(text: Column) -> Column:
    return well_formed(text).cast("double")


#: Rewards by name: (dataset, text, golds) -> Column; all but the format's have weight 1 unless told otherwise.
REWARDS = {"correctness": correctness_reward, "format": lambda dataset, text, golds: format_reward(text)}
WEIGHTS = {"format": 0.2}


def weighted_reward(names: list[str], dataset: Column, text: Column, golds: Column, weights: list[float] | None = None) -> Column:
    """The weighted sum of named rewards."""
    weights = weights or [WEIGHTS.get(n, 1.0) for n in names]
    if len(weights) != len(names):
        raise ValueError(f"{len(names)} rewards and {len(weights)} weights")
    parts = [F.lit(w) * REWARDS[n](dataset, text, golds) for n, w in zip(names, weights, strict=True)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total
