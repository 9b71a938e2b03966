"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Random indexing gives every token a sparse ternary *index vector* that follows from its hash, and a *context
vector*, the sum of the index vectors of the tokens around it. A document's vector is the mean, over all of its
tokens, of context plus index vector. A network of one tanh layer and one logistic output is trained on these
vectors, and its probabilities are calibrated by a temperature fitted on training rows that the weights never saw.

What is fitted is fitted on all labelled rows outside the held-out fold. Tokens and contexts are counted in Spark. The rows'
vectors lie in blocks of about ``sample`` rows; the driver trains a first network on one block, and where there are more,
L-BFGS goes on from there with the loss and gradient of all rows, which a Spark job adds up block by block; the scaling of
the inputs and the temperature are those of all rows, too. Scoring is one pass over whole texts without a shuffle.

Tokens are runs of word characters, and single symbols. A token like the one before it, an upper-case word of two letters
or more, and a number become markers, so that shape and repetition have vectors too.

Edge cases: null and empty texts have no tokens, so the zero vector, and a defined score (the network's at zero).
Without labelled rows every score is 0.5; with labels of one class only, it is that class's smoothed share. Rows are
scored independently, so ties and repeats get equal scores. A label row whose quality is null or not 0/1 is ignored;
of several labels for one id the largest counts. Texts are read whole, and tokens are taken whole, however long. An
empty table gives an empty one. Columns of the input named like the outputs are replaced, all others kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm.common import Rows, held_out, materialize, small_batches

TOKEN = re.compile(r"\w+|[^\w\s]")
SAME, UPPER, NUMBER = "<same>", "<upper>", "<number>"
#: Of the random indexing: dimensions, non-zeros of an index vector, tokens to either side.
DIM, NONZERO, WINDOW = 48, 6, 2
#: Of the training: units of the hidden layer, weight of the squared weights, temperatures tried, passes over all rows.
HIDDEN, DECAY, TEMPERATURES, PASSES = 24, 1e-4, np.geomspace(0.25, 8, 61), 30
#: Tokens that a task counts before it hands them on.
COUNTED = 50_000


def normal_form(token: str) -> str:
    """The token that stands for it in the vocabulary."""
    if token.isdigit():
        return NUMBER
    if token.isupper() and len(token) > 1:
        return UPPER
    return token.lower()


class Ids(dict):
    """Vocabulary ids of raw tokens; 0 is for tokens outside it. A bounded number of them, none very long, is remembered."""

    def __init__(self, vocabulary: dict[str, int], most: int = 1 << 18):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, token: str) -> int:
        found = self.vocabulary.get(normal_form(token), 0)
        if len(self) < self.most and len(token) <= 64:
            self[token] = found
        return found


def token_ids(text: str | None, ids: Ids) -> np.ndarray:
    raw = TOKEN.findall(text or "")
    out = np.fromiter(map(ids.__getitem__, raw), np.int32, len(raw))
    if len(raw) > 1:
        out[1:][np.fromiter(map(eq, raw[1:], raw), bool, len(raw) - 1)] = ids.vocabulary.get(SAME, 0)
    return out


def index_vectors(tokens: list[str]) -> np.ndarray:
    """Ternary vectors that depend on nothing but the token; row 0, for unknown tokens, is zero."""
    out = np.zeros((len(tokens) + 1, DIM), np.float32)
    for k, token in enumerate(tokens, 1):
        rng = np.random.default_rng(zlib.crc32(token.encode()))
        at = rng.choice(DIM, NONZERO, replace=False)
        out[k, at] = rng.choice(np.array([-1, 1], np.float32), NONZERO)
    return out


def context_sums(ids: np.ndarray, index: np.ndarray, out: np.ndarray, block: int = 1 << 15) -> None:
    """Add to ``out`` the index vectors of each token's neighbours within one text, ``block`` tokens at a time."""
    for at in range(0, len(ids), block):
        own = ids[at : at + block]
        near = np.zeros((len(own), index.shape[1]), np.float32)
        for step in range(1, WINDOW + 1):
            before, after = ids[max(0, at - step) : max(0, at + len(own) - step)], ids[at + step : at + len(own) + step]
            near[len(own) - len(before) :] += index[before]
            near[: len(after)] += index[after]
        order = np.argsort(own, kind="stable")
        tokens, starts = np.unique(own[order], return_index=True)
        out[tokens] += np.add.reduceat(near[order], starts)


@dataclass
class Network:
    """Weights of the two layers, the scaling of the inputs, and the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant(share: float) -> Network:
    """A network with the same score for every document."""
    return Network(np.zeros(DIM), np.ones(DIM), np.zeros((DIM, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def first_weights(hidden: int, rng: np.random.Generator) -> list[np.ndarray]:
    return [rng.normal(0, 1 / np.sqrt(DIM), (DIM, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]


def log_loss(logits: np.ndarray, t: np.ndarray) -> float:
    return float((np.logaddexp(0, logits) - t * logits).sum())


def gradients(z: np.ndarray, t: np.ndarray, params: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The logits of scaled inputs, and the gradients of the summed log loss."""
    h = np.tanh(z @ params[0] + params[1])
    logits = h @ params[2] + params[3]
    d = 1 / (1 + np.exp(-np.clip(logits, -30, 30))) - t
    back = np.outer(d, params[2]) * (1 - h * h)
    return logits, [z.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]


def train(x: np.ndarray, y: np.ndarray, for_temperature: np.ndarray, hidden: int = HIDDEN, epochs: int = 300, seed: int = 7) -> Network:
    """Adam on the log loss of the rows not kept for the temperature, then the temperature on those."""
    fit = ~for_temperature
    if not fit.any():
        return constant(0.5)
    if len(set(y[fit])) < 2:
        return constant((y[fit].sum() + 1) / (fit.sum() + 2))
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    z, t = (x[fit] - mean) / scale, y[fit]
    params = first_weights(hidden, np.random.default_rng(seed))
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        grads = [g / len(t) for g in gradients(z, t, params)[1]]
        for k in (0, 2):
            grads[k] = grads[k] + DECAY * params[k]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    if for_temperature.any() and len(set(y[for_temperature])) == 2:
        logits, t = net.logits(x[for_temperature]), y[for_temperature]
        net.temperature = float(min(TEMPERATURES, key=lambda temp: log_loss(logits / temp, t)))
    return net


def descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, passes: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with steps halved until the loss falls enough; ``loss`` (value and gradient) is asked ``passes`` times at most."""
    value, slope = loss(at)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    passes -= 1
    while passes > 0 and np.abs(slope).max() > 1e-6:
        way, shares = slope.copy(), []
        for s, g in reversed(pairs):
            shares.append(s @ way / (s @ g))
            way -= shares[-1] * g
        way *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else min(1, 0.1 / np.linalg.norm(slope))
        for (s, g), share in zip(pairs, reversed(shares), strict=True):
            way += (share - g @ way / (s @ g)) * s
        step = 1.0
        while passes > 0:
            passes -= 1
            new_value, new_slope = loss(at - step * way)
            if new_value <= value - 1e-4 * step * (way @ slope):
                break
            step /= 2
        else:
            return at
        s, g = -step * way, new_slope - slope
        if s @ g > 1e-12:
            pairs = [*pairs[1 - memory :], (s, g)]
        at, value, slope = at + s, new_value, new_slope
    return at


@dataclass
class Model:
    vocabulary: dict[str, int]
    vectors: np.ndarray
    network: Network


def pooled(texts: pd.Series, ids: Ids, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIM))
    for k, text in enumerate(texts):
        found = token_ids(text, ids)
        if len(found):
            at, n = np.unique(found, return_counts=True)
            out[k] = n @ vectors[at] / len(found)
    return out


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, quality) of all labelled rows outside the held-out fold, written.

    Of an id that stands on several rows one is taken, by its text's hash.
    """
    taught = F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    known = materialize(labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")))
    # merged, not broadcast: the grouping below needs texts dealt by id anyway
    texts = documents.select("doc_id", "text").where(taught).join(known.hint("merge"), "doc_id")
    return materialize(texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("quality").alias("quality")))


def word_vectors(texts: DataFrame, vocabulary: int) -> tuple[dict[str, int], np.ndarray]:
    """Ids and vectors of the ``vocabulary`` most frequent tokens, by all occurrences in ``texts``."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                raw = TOKEN.findall(text)
                counts.update(map(normal_form, raw))
                counts[SAME] += sum(map(eq, raw[1:], raw))
            if len(counts) > COUNTED:
                yield pd.DataFrame({"token": list(counts), "n": list(counts.values())})
                counts.clear()
        if counts:
            yield pd.DataFrame({"token": list(counts), "n": list(counts.values())})

    often = (
        texts.select("text").mapInPandas(counted, "token string, n long")
        .groupBy("token").agg(F.sum("n").alias("n")).where("n >= 2")
        .orderBy(F.desc("n"), "token").limit(vocabulary).collect()
    )
    tokens = [r["token"] for r in often]
    ids = {token: k for k, token in enumerate(tokens, 1)}
    index = index_vectors(tokens)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, of = np.zeros(index.shape), Ids(ids)
        for batch in batches:
            for text in batch["text"]:
                context_sums(token_ids(text, of), index, sums)
        if len(at := np.flatnonzero(sums.any(1))):
            yield pd.DataFrame({"id": at, "v": list(sums[at])})

    found = (
        texts.select("text").mapInPandas(contexts, "id int, v array<double>")
        .groupBy("id").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(DIM)]).alias("v"))
    ).toArrow()
    vectors = np.zeros((len(tokens) + 1, DIM), np.float32)
    if found.num_rows:
        vectors[found["id"].to_numpy()] = np.array(found["v"].to_pylist(), np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    vectors = (vectors + index / np.sqrt(NONZERO)).astype(np.float32)
    vectors[0] = 0
    return ids, vectors


def in_blocks(texts: DataFrame, ids: dict[str, int], vectors: np.ndarray, n_blocks: int) -> DataFrame:
    """(block, x, y, kept), written: the vectors, labels and temperature flags of the rows of a block, in the order of ids."""

    def vectors_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Ids(ids)
        for batch in batches:
            x = pooled(batch["text"], of, vectors).astype(np.float32)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [v.tobytes() for v in x]})

    def laid(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        kept = np.array([zlib.crc32(b"temperature %d" % d) % 5 == 0 for d in rows["doc_id"]], bool)
        y = rows["quality"].to_numpy().astype(np.uint8)
        return pd.DataFrame([(rows["block"].iloc[0], b"".join(rows["x"]), y.tobytes(), kept.tobytes())], columns=["block", "x", "y", "kept"])

    rows = texts.mapInPandas(vectors_of, "doc_id long, quality int, x binary").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)))
    return materialize(rows.repartition(n_blocks, "block").groupBy("block").applyInPandas(laid, "block long, x binary, y binary, kept binary"))


def unpacked(block: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's x, y and kept as arrays."""
    x = np.frombuffer(block.x, np.float32).reshape(-1, DIM).astype(float)
    return x, np.frombuffer(block.y, np.uint8).astype(float), np.frombuffer(block.kept, bool)


def summed(blocks: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(x, y, kept)`` over all blocks, which are added in the order of their numbers: the same in each run.

    The driver receives that array, of some thousand numbers at most, for each block.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(b.block, of(*unpacked(b)).tobytes()) for b in batch.itertuples()], columns=["block", "v"])

    parts = sorted(blocks.mapInPandas(each, "block long, v binary").collect(), key=lambda r: r["block"])
    return np.sum([np.frombuffer(r["v"]) for r in parts], axis=0)


def refined(blocks: DataFrame, start: Network, passes: int = PASSES) -> Network:
    """The network that ``passes`` over all rows lead to from ``start``, with the scaling and temperature of all rows."""

    def moments(x: np.ndarray, y: np.ndarray, kept: np.ndarray) -> np.ndarray:
        own = x[~kept]
        return np.concatenate(([len(own), y[~kept].sum(), kept.sum(), y[kept].sum()], own.sum(0), (own * own).sum(0)))

    n, good, n_kept, good_kept, *sums = summed(blocks, moments)
    if not n:
        return constant(0.5)
    if good in (0, n):
        return constant((good + 1) / (n + 2))
    mean = np.array(sums[:DIM]) / n
    scale = np.sqrt(np.maximum(np.array(sums[DIM:]) / n - mean**2, 0)) + 1e-6
    if start.w1.any():  # the same network over the new scaling
        params = [start.w1 * (scale / start.scale)[:, None], start.b1 + (mean - start.mean) / start.scale @ start.w1, start.w2, np.array([start.b2])]
    else:
        params = first_weights(HIDDEN, np.random.default_rng(7))
    ends = np.cumsum([p.size for p in params])[:-1]

    def layers(flat: np.ndarray) -> list[np.ndarray]:
        return [part.reshape(p.shape) for part, p in zip(np.split(flat, ends), params, strict=True)]

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        def of(x: np.ndarray, y: np.ndarray, kept: np.ndarray) -> np.ndarray:
            logits, grads = gradients((x[~kept] - mean) / scale, y[~kept], layers(flat))
            return np.concatenate(([log_loss(logits, y[~kept])], *[g.ravel() for g in grads]))

        found = summed(blocks, of) / n
        decay = np.concatenate([(p if k in (0, 2) else 0 * p).ravel() for k, p in enumerate(layers(flat))])
        return found[0] + DECAY / 2 * (decay @ decay), found[1:] + DECAY * decay

    w1, b1, w2, b2 = layers(descend(loss, np.concatenate([p.ravel() for p in params]), passes))
    net = Network(mean, scale, w1, b1, w2, float(b2[0]))

    def by_temperature(x: np.ndarray, y: np.ndarray, kept: np.ndarray) -> np.ndarray:
        logits = net.logits(x[kept])
        return np.array([log_loss(logits / temp, y[kept]) for temp in TEMPERATURES])

    if 0 < good_kept < n_kept:
        net.temperature = float(TEMPERATURES[summed(blocks, by_temperature).argmin()])
    return net


def fit(documents: DataFrame, labels: DataFrame, sample: int = 12_000, vocabulary: int = 16_384) -> Model:
    """A model from all labelled rows outside the held-out fold.

    The driver receives ``vocabulary`` tokens with their vectors, one vector for each of ``sample`` rows at most, which the
    first network is trained on, and sums; never texts.
    """
    with small_batches(documents.sparkSession):
        texts = labelled(documents, labels)
        ids, vectors = word_vectors(texts, vocabulary)
        n_blocks = max(1, -(-texts.count() // sample))
        blocks = in_blocks(texts, ids, vectors, n_blocks)
        x, y, kept = np.zeros((0, DIM)), np.zeros(0), np.zeros(0, bool)
        for block in blocks.where("block = 0").collect():
            x, y, kept = (a[:sample] for a in unpacked(block))
        network = train(x, y, kept)
        return Model(ids, vectors, refined(blocks, network) if n_blocks > 1 else network)


def score(spark: SparkSession, documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the threshold)."""
    shared = spark.sparkContext.broadcast(model)  # `vocabulary` tokens and vectors: some MB, whatever the corpus

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        ids = Ids(m.vocabulary)
        for texts in batches:
            yield pd.Series(m.network.score(pooled(texts, ids, m.vectors)))

    rows = Rows(documents, ("score", "predicted"))
    # marked as not deterministic so that a filter on the score doesn't compute it a second time
    out = documents.select(rows.row, scored.asNondeterministic()("text").alias("score"))
    return rows.unpacked(out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
