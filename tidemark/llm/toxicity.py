"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of its hash and the sum of the embeddings of its character grams. Both directions run
over every window of ``SPAN`` words, half overlapping; attention pools their states and a logistic unit scores the
window. A text scores as its worst window. Training sees document labels only: first random windows, later the worst
window of each text, so that the network learns which part of a toxic text is toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.llm import common

SPAN, STEP = 40, 20  # words of a window, and from one window to the next
HIDDEN, WIDTH = 16, 12  # states a direction; numbers of a word's hash and of its characters
WORDS, GRAMS = 1 << 14, 1 << 15  # rows of the two embedding tables
SIZES = (3, 4, 5)  # bytes of a character gram, the word's ends marked

_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(offsets: np.ndarray, data: np.ndarray):
    """Distinct words of some texts as (bucket of the word, buckets of its grams, first gram of each word), the distinct
    word at each place, and the first place of each text."""
    hashes, starts, ends, first = common.words(offsets, data, lower=True, space=_APART)
    if not len(hashes):
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int64), first
    distinct, example, place = np.unique(hashes, return_index=True, return_inverse=True)
    starts, sizes = starts[example], (ends - starts)[example]
    # All distinct words one after the other, each between two marks.
    begin = np.cumsum(sizes + 2) - sizes - 2
    code = np.full(int((sizes + 2).sum()), common._BYTE[0], np.uint64)
    code[common.within(begin + 1, sizes)] = common._BYTE[common._LOWER[data[common.within(starts, sizes)]]]
    grams, owner = [], []
    for size in SIZES:
        made = common.rolling(code, size) + np.uint64(size)
        counts = np.maximum(sizes + 3 - size, 0)
        grams.append((made[common.within(begin, counts)] % np.uint64(GRAMS)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(sizes)), counts))
    order = np.argsort(np.concatenate(owner), kind="stable")
    counts = np.bincount(np.concatenate(owner), minlength=len(sizes))
    return ((distinct % np.uint64(WORDS)).astype(np.int64), np.concatenate(grams)[order], np.cumsum(counts) - counts), place, first


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of every window; the last window of a text ends with it, and a text without
    words has one empty window."""
    counts = np.diff(first)
    number = np.maximum(-(-(counts - SPAN) // STEP), 0) + 1
    text = np.repeat(np.arange(len(counts)), number)
    start = np.minimum(common.within(np.zeros(len(counts), np.int64), number) * STEP, np.maximum(counts - SPAN, 0)[text])
    return first[:-1][text] + start, np.minimum(counts, SPAN)[text], text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights by name, in single precision."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        draw = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (draw.standard_normal(shape) * scale).astype(np.float32)
        weights = {"word": normal(WORDS, WIDTH, scale=0.1), "gram": normal(GRAMS, WIDTH, scale=0.1),
                   "attend": normal(2 * HIDDEN, scale=0.1), "out": normal(2 * HIDDEN, scale=0.3), "bias": np.full(1, -1, np.float32),
                   "turn": normal(2 * HIDDEN, 2 * HIDDEN, scale=0.2)}
        for side in "fb":
            weights["in" + side] = normal(2 * WIDTH, 3 * HIDDEN, scale=0.3)
            weights["add" + side] = np.zeros(3 * HIDDEN, np.float32)
            weights["again" + side] = normal(HIDDEN, 3 * HIDDEN, scale=0.25)
        return cls(weights)

    def embed(self, distinct) -> np.ndarray:
        """Inputs of distinct words."""
        word, grams, begin = distinct
        if not len(word):
            return np.zeros((0, 2 * WIDTH), np.float32)
        counts = np.diff(np.append(begin, len(grams)))
        characters = np.add.reduceat(self.weights["gram"][grams], begin) / np.sqrt(counts)[:, None].astype(np.float32)
        return np.concatenate([self.weights["word"][word], characters], axis=1)

    def forward(self, inputs: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows whose words are rows ``index`` of ``inputs``; with ``keep``, also what backward needs."""
        w, (n, span) = self.weights, index.shape
        states = np.zeros((n, span, 2 * HIDDEN), np.float32)
        trace: dict = {}
        for d, side in enumerate("fb"):
            given = (inputs @ w["in" + side] + w["add" + side]) if len(inputs) else np.zeros((1, 3 * HIDDEN), np.float32)
            h, steps = np.zeros((n, HIDDEN), np.float32), []
            for t in (range(span) if d == 0 else range(span - 1, -1, -1)):
                x, again = given[index[:, t]], h @ w["again" + side]
                gates = _sigmoid(x[:, :2 * HIDDEN] + again[:, :2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN:] + r * again[:, 2 * HIDDEN:])
                on = mask[:, t, None]
                if keep:
                    steps.append((t, h, z, r, new, again[:, 2 * HIDDEN:]))
                h = np.where(on, new + z * (h - new), h)
                states[:, t, d * HIDDEN:(d + 1) * HIDDEN] = h
            trace[side] = steps
        turned = np.tanh(states @ w["turn"])
        energy = np.where(mask, turned @ w["attend"], -1e9)
        share = np.exp(energy - energy.max(1, keepdims=True)) * mask
        share /= np.maximum(share.sum(1, keepdims=True), 1e-9)
        pooled = (share[:, :, None] * states).sum(1)
        logit = pooled @ w["out"] + w["bias"][0]
        return (logit, (trace, states, turned, share, pooled)) if keep else logit

    def backward(self, distinct, inputs, index, mask, kept, slope) -> dict[str, np.ndarray]:
        """Gradients, given the loss's slope by each logit; those of the embedding tables as (rows, values)."""
        w, (trace, states, turned, share, pooled) = self.weights, kept
        grad = {"out": pooled.T @ slope, "bias": np.array([slope.sum()], np.float32)}
        to_pooled = slope[:, None] * w["out"]
        to_states = share[:, :, None] * to_pooled[:, None, :]
        to_share = (states * to_pooled[:, None, :]).sum(2)
        to_energy = share * (to_share - (share * to_share).sum(1, keepdims=True))
        grad["attend"] = np.einsum("nt,nth->h", to_energy, turned)
        to_turned = to_energy[:, :, None] * w["attend"] * (1 - turned * turned)
        flat = states.reshape(-1, 2 * HIDDEN)
        grad["turn"] = flat.T @ to_turned.reshape(-1, 2 * HIDDEN)
        to_states += to_turned @ w["turn"].T
        to_inputs = np.zeros_like(inputs)
        for d, side in enumerate("fb"):
            again = w["again" + side]
            grad["again" + side] = np.zeros_like(again)
            to_given = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
            carry = np.zeros((len(index), HIDDEN), np.float32)
            for t, h, z, r, new, candidate in reversed(trace[side]):
                on = mask[:, t, None]
                whole = carry + to_states[:, t, d * HIDDEN:(d + 1) * HIDDEN]
                live = np.where(on, whole, 0)
                to_new = live * (1 - z) * (1 - new * new)
                to_z = live * (h - new) * z * (1 - z)
                to_r = to_new * candidate * r * (1 - r)
                through = np.concatenate([to_z, to_r, to_new * r], axis=1)
                grad["again" + side] += h.T @ through
                np.add.at(to_given, index[:, t], np.concatenate([to_z, to_r, to_new], axis=1))
                carry = np.where(on, live * z, whole) + through @ again.T
            grad["in" + side] = inputs.T @ to_given
            grad["add" + side] = to_given.sum(0)
            to_inputs += to_given @ w["in" + side].T
        word, grams, begin = distinct
        counts = np.diff(np.append(begin, len(grams)))
        characters = to_inputs[:, WIDTH:] / np.sqrt(counts)[:, None].astype(np.float32)
        for name, rows, values in (("word", word, to_inputs[:, :WIDTH]), ("gram", grams, np.repeat(characters, counts, axis=0))):
            order = np.argsort(rows, kind="stable")
            rows, begin_at = np.unique(rows[order], return_index=True)
            grad[name] = rows, np.add.reduceat(values[order], begin_at)
        return grad


def _gather(starts, sizes, place):
    """Distinct word at every place of some windows, and which places are words."""
    mask = np.arange(SPAN)[None, :] < sizes[:, None]
    spots = np.where(mask, starts[:, None] + np.arange(SPAN)[None, :], 0)
    return (np.where(mask, place[spots], 0) if len(place) else np.zeros(spots.shape, np.int64)), mask


def logits(network: Network, distinct, place, first) -> tuple[np.ndarray, np.ndarray]:
    """Logit and text of every window."""
    starts, sizes, text = windows(first)
    inputs = network.embed(distinct)
    out = np.zeros(len(starts), np.float32)
    for k in range(0, len(starts), 1024):
        index, mask = _gather(starts[k:k + 1024], sizes[k:k + 1024], place)
        out[k:k + 1024] = network.forward(inputs, index, mask)
    return out, text


class _Adam:
    """Adam; rows of the embedding tables move only when they occur."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.step = network, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in network.weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in network.weights.items()}

    def move(self, grad: dict) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for name, g in grad.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            g = np.clip(g, -1, 1)
            mean = self.mean[name][rows] = 0.9 * self.mean[name][rows] + 0.1 * g
            square = self.square[name][rows] = 0.999 * self.square[name][rows] + 0.001 * g * g
            self.network.weights[name][rows] -= scale * mean / (np.sqrt(square) + 1e-8)


def train(texts: list[str], labels: list[int], weights: list[float], epochs: int = 12, seed: int = 0) -> Network:
    """A network from texts and their labels; without texts, one that gives low scores."""
    network = Network.fresh(seed)
    if not texts:
        network.weights["bias"][0] = -3
        return network
    draw = np.random.default_rng(seed)
    raw = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    distinct, place, first = features(offsets, np.frombuffer(b"".join(raw), np.uint8))
    label, weight = np.array(labels, np.float32), np.array(weights, np.float32)
    starts, sizes, text = windows(first)
    begin = np.searchsorted(text, np.arange(len(texts)))
    count = np.diff(np.append(begin, len(text)))
    adam = _Adam(network, 0.01)
    for epoch in range(epochs):
        adam.rate = 0.01 if epoch < epochs * 2 // 3 else 0.003
        if epoch < 3:
            chosen = np.concatenate([begin + draw.integers(0, count) for _ in range(3)])
        elif epoch % 3 == 0:  # the worst windows change slowly; all windows are scored every third epoch
            score = logits(network, distinct, place, first)[0]
            by_score = np.lexsort((-score, text))
            second = np.flatnonzero((count > 1) & (label == 0))
            chosen = np.concatenate([by_score[begin], by_score[begin[second] + 1]])
        chosen = draw.permutation(chosen)
        for part in np.array_split(chosen, max(1, len(chosen) // 64)):
            index, mask = _gather(starts[part], sizes[part], place)
            used, local = np.unique(index, return_inverse=True)
            local = local.reshape(index.shape)
            word, grams, at = distinct
            if len(word):
                lengths = np.diff(np.append(at, len(grams)))[used]
                mine = word[used], grams[common.within(at[used], lengths)], np.cumsum(lengths) - lengths
            else:
                mine = distinct
            inputs = network.embed(mine)
            if not len(inputs):
                continue
            logit, kept = network.forward(inputs, local, mask, keep=True)
            slope = ((_sigmoid(logit) - label[text[part]]) * weight[text[part]] / len(part)).astype(np.float32)
            adam.move(network.backward(mine, inputs, local, mask, kept, slope))
    return network


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
        rows_per_label: int = 900) -> Network:
    """Train on a bounded sample: at most ``rows_per_label`` labelled documents of each label, by the order of the id's hash.

    Rows with a null id, label or text are not used; where an id has several labels, the highest counts.
    """
    marked = (labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id"))
              .agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label")).withColumn("draw", F.xxhash64("id", F.lit(2))))
    total = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    order = Window.partitionBy("label").orderBy("draw", "id")
    near = common.least_draws(marked, "label", "draw", rows_per_label)
    picked = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rows_per_label).select("id", "label", "place")
    # At most twice rows_per_label ids: small enough to send to every task.
    sample = (docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
              .join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("label", "id").collect())
    drawn = {k: max(1, sum(r["label"] == k for r in sample)) for k in (0, 1)}
    known = sum(total.values()) or 1
    # Weights halfway, in logarithms, between an even and the true share of the labels.
    share = {k: (total.get(k, 0) / known * len(sample) / drawn[k]) ** 0.5 for k in (0, 1)}
    return train([r["text"] for r in sample], [r["label"] for r in sample], [share[r["label"]] for r in sample])


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score(docs: DataFrame, network: Network, text: str = "text", least: float = 0.3) -> DataFrame:
    """Every row with ``score`` (0 to 1, that of the worst window) and ``predicted`` (1 from ``least`` on).

    All windows of whole texts are scored. A null, empty or wordless text has one empty window, and so the score of no
    evidence. Columns of these names are replaced, all others pass through; repeated rows get equal scores.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(network.weights)

    def make():
        model = Network(shipped.value)

        def run(texts: pa.Array):
            offsets, data = common.utf8(texts)
            worst = np.zeros(len(texts))
            for first, last in common.slices(offsets, common.SLICE_BYTES // 4):
                local = offsets[first:last + 1] - offsets[first]
                logit, owner = logits(model, *features(local, data[offsets[first]:offsets[last]]))
                worst[first:last] = np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(last - first)))
            found = _sigmoid(worst)
            return pa.array(found, pa.float64()), pa.array(found >= least).cast(pa.int32())
        return run

    return common.append(docs, [text], FIELDS, make)
