"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters (one
vector per byte value and place in the filter's width, so a filter's response is a sum of table rows) slide
over each chunk; responses are rectified and max-pooled per chunk; the pooled values are combined over the chunks
by mean and by maximum, and a logistic unit gives one probability.

The network is fitted on the driver to a bounded sample of labelled rows: at most SAMPLE_PER_LABEL rows of each
label, chosen by hash and weighted to the labels' shares over all rows, each with all chunks of its whole text; the driver holds their bytes.
Scoring runs on the executors over all chunks of every document.

Defined cases: a null or empty text is one chunk of padding and gets the network's score for that; null labels
are not learned from; of several labels of an id the smallest counts, of several texts the first in order; with labels of one kind only, every
score is that label, without any it is 0.5; equal rows get equal rows; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, per_text

WIDTH, FILTERS = 5, 12
CHUNK, STEP = 512, 256
#: The bound on what is learned from, in rows of each label.
SAMPLE_BYTES = 64 << 20  # of the sampled rows' texts
SAMPLE_PER_LABEL = 1500
STEPS, BATCH_DOCS, RATE, SEED = 800, 32, 0.01, 11
PAD = 256
_SLICE = 64  # steps of positions that are worked on at a time, so that memory is bounded for any text


def byte_values(text: str) -> np.ndarray:
    """The text's bytes, padded so that its last chunk is whole."""
    return padded(text.encode("utf-8", "surrogatepass"))


def padded(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8).astype(np.int16)
    length = CHUNK + WIDTH - 1
    n = max(1, -(-(len(data) - length) // STEP) + 1)
    return np.concatenate((data, np.full((n - 1) * STEP + length - len(data), PAD, np.int16)))


class ByteNetwork:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.head = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def responses(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """(steps, STEP, filters) for each slice of positions."""
        for at in range(0, len(data) - WIDTH + 1, _SLICE * STEP):
            part = data[at : at + _SLICE * STEP + WIDTH - 1]
            n = len(part) - WIDTH + 1
            z = self.table[0].take(part[:n], axis=0)
            for j in range(1, WIDTH):
                z += self.table[j].take(part[j : j + n], axis=0)
            yield z.reshape(-1, STEP, FILTERS)

    def peaks(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, filters): the largest response in each STEP of positions, and its position."""
        value, best = [], []
        for z in self.responses(data):
            best.append(z.argmax(axis=1))
            value.append(np.take_along_axis(z, best[-1][:, None, :], axis=1)[:, 0, :])
        place = np.concatenate(best)
        return np.concatenate(value), place + np.arange(len(place))[:, None] * STEP

    def pooled_chunks(self, data: np.ndarray) -> np.ndarray:
        """(chunks, filters): maxima over chunks of CHUNK positions, one every STEP."""
        value = np.concatenate([z.max(axis=1) for z in self.responses(data)])
        return np.maximum(np.maximum(value[:-1], value[1:]) + self.bias, 0)

    def score(self, text: str) -> float:
        pooled = self.pooled_chunks(byte_values(text))
        return self.probability(np.concatenate((pooled.mean(axis=0), pooled.max(axis=0))))

    def probability(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.float64(features @ self.head + self.offset[0]), -30, 30))))


def fit(documents: list[np.ndarray], labels: list[int], prior: float = 0.5, steps: int = STEPS, seed: int = SEED) -> ByteNetwork:
    """documents: byte_values() of each. Adam on the logistic loss, weighted to the share `prior` of label 1."""
    net, rng = ByteNetwork(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    share = np.array([p * len(y) / max(1, (y == v).sum()) for v, p in ((0, 1 - prior), (1, prior))])
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in ("table", "bias", "head", "offset")}
    step = 0
    while step < steps:
        order = rng.permutation(len(documents))
        for at in range(0, len(order), BATCH_DOCS):
            if step == steps:
                break
            chosen = order[at : at + BATCH_DOCS]
            grads = {k: np.zeros_like(getattr(net, k)) for k in moments}
            for d in chosen:
                _add_gradient(net, documents[d], y[d], share[int(y[d])] / len(chosen), grads)
            step += 1
            for k, (m, v) in moments.items():
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                update = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - update).astype(np.float32))
    return net


def _add_gradient(net: ByteNetwork, data: np.ndarray, label: float, weight: float, grads: dict[str, np.ndarray]) -> None:
    value, place = net.peaks(data)
    later = value[1:] > value[:-1]
    best = np.where(later, place[1:], place[:-1])  # (chunks, filters)
    value = np.maximum(value[:-1], value[1:]) + net.bias
    pooled = np.maximum(value, 0)
    top = pooled.argmax(axis=0)
    features = np.concatenate((pooled.mean(axis=0), pooled.max(axis=0)))
    off = (net.probability(features) - label) * weight
    grads["head"] += off * features
    grads["offset"] += off
    each = np.repeat(off * net.head[None, :FILTERS] / len(best), len(best), axis=0)
    each[top, np.arange(FILTERS)] += off * net.head[FILTERS:]
    each *= value > 0
    grads["bias"] += each.sum(axis=0)
    filters = np.broadcast_to(np.arange(FILTERS), best.shape)
    for j in range(WIDTH):
        np.add.at(grads["table"], (j, data[best + j], filters), each)


def labelled_ids(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(id, y) of each labelled id."""
    return labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("y"))


def sampled(one: DataFrame, per_label: int) -> DataFrame:
    """At most per_label ids of each label, by hash."""
    parts = [one.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(per_label) for v in (0, 1)]
    return parts[0].union(parts[1])


def within(sizes: list[tuple[object, int, int]], most_bytes: int) -> list:
    """Ids of the (id, y, bytes), in their order, as long as those of a label come to half of most_bytes at most; of each label one at least."""
    kept, used = [], {0: 0, 1: 0}
    for i, y, n in sizes:
        used[y] += n
        if used[y] <= most_bytes // 2 or used[y] == n:
            kept.append(i)
    return kept


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_label: int = SAMPLE_PER_LABEL, most_bytes: int = SAMPLE_BYTES) -> ByteNetwork | float:
    """The network, or a constant score where there are fewer than two labels. labels: the rows to learn from; most_bytes of their texts come to the driver."""
    one = labelled_ids(labels, doc_id, label)
    prior = one.agg(F.avg("y")).first()[0]
    sample = sampled(one, per_label)
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(sample), "id")  # at most 2 * per_label rows
    scratch = Scratch(docs.sparkSession)
    held = scratch.keep(picked.groupBy("id", "y").agg(F.min(F.coalesce("t", F.lit(""))).alias("t")).select("id", "y", F.encode("t", "utf-8").alias("raw")))
    sizes = held.orderBy(F.xxhash64("id"), "id").select("id", "y", F.octet_length("raw").alias("n")).collect()
    chosen = within([tuple(r) for r in sizes], most_bytes)
    rows = held.where(F.col("id").isin(chosen)).orderBy("id").toPandas()
    scratch.drop(held)
    kinds = sorted(set(rows["y"]))
    if len(kinds) < 2:
        return float(kinds[0]) if kinds else 0.5
    return fit([padded(raw) for raw in rows["raw"]], rows["y"].tolist(), prior)


def score_documents(docs: DataFrame, model: ByteNetwork | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and score."""

    def make() -> Callable[[str], tuple]:
        return lambda t: (model.score(t) if isinstance(model, ByteNetwork) else model,)

    return per_text(docs, [doc_id], text, [T.StructField("score", T.DoubleType())], make)
