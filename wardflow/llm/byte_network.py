"""Text quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by a
filter's width less its stride, so that every window of the whole text lies in
some chunk.  Bytes get learned vectors; learned filters slide over each chunk
and are max-pooled in it; a hidden layer describes the chunk.  The document
takes the largest and the mean value of every hidden unit over all its chunks,
and a logistic layer combines these into one probability.

The network learns on the driver from a bounded sample: at most
``MAX_PER_CLASS`` labelled documents of each class, chosen by a hash, whose
text has at most ``MAX_TEACHING_BYTES`` bytes; a teaching text is read whole.
The classes' shares among all labelled rows set the level of the
probabilities.  Scoring is a per-batch function on the executors that reads
whole texts, of any length, in slabs of ``SLAB`` chunks.

Defined cases: a null or empty text is one chunk of padding and is scored like
any other; a doc_id with several label rows is good if any says so, a doc_id
with several texts teaches with the least of them, rows with a null id or
label teach nothing; repeated documents get the same score; with only one
class labelled (or none) every score is that class's smoothed share (0.5
without labels).  Columns of the input that an output column names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import cut, map_arrow, prepare

#: Labelled documents that teach: at most this many of each class, of at most this many bytes each.
MAX_PER_CLASS = 1500
MAX_TEACHING_BYTES = 32_768
#: The network's shape.
CHUNK, WIDTH, STRIDE = 256, 16, 2
VECTOR, FILTERS, HIDDEN = 8, 32, 32
#: Training.
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 32, 0.01, 1e-4, 11
#: Chunks computed at once while scoring: bounds a task's memory at any text length.
SLAB = 2048
PAD = 256
_STEP = CHUNK - (WIDTH - STRIDE)


def chunks_of(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """(chunks, CHUNK) byte values of a text, padded with PAD; optionally only those from ``first`` to ``last``."""
    many = n_chunks(len(data))
    last = many if last is None else min(last, many)
    part = np.frombuffer(data, np.uint8)[first * _STEP:(last - 1) * _STEP + CHUNK]
    flat = np.full((last - first - 1) * _STEP + CHUNK, PAD, np.int16)
    flat[:part.size] = part
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::_STEP]


def n_chunks(size: int) -> int:
    return max(1, -(-(size - CHUNK) // _STEP) + 1)


@dataclass
class Network:
    """Weights by name; ``base`` is the probability of everything where nothing was learned."""
    weights: dict[str, np.ndarray]
    shift: float = 0.0
    base: float | None = None

    @classmethod
    def start(cls, seed: int = SEED) -> Network:
        draw = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (draw.normal(size=shape) * scale).astype(np.float32)

        vectors = normal(257, VECTOR, scale=1.0)
        vectors[PAD] = 0
        return cls({
            "vectors": vectors,
            "filters": normal(WIDTH * VECTOR, FILTERS, scale=(WIDTH * VECTOR) ** -0.5),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(FILTERS, HIDDEN, scale=FILTERS ** -0.5),
            "hidden_bias": np.full(HIDDEN, 0.1, np.float32),
            "out": normal(2 * HIDDEN, scale=0.1),
            "out_bias": np.zeros(1, np.float32),
        })

    def pooled(self, chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each chunk and, if asked for, its window's first byte."""
        w, k = self.weights, len(chunks)
        x = w["vectors"][chunks]
        best = at = None
        for phase in range(0, WIDTH, STRIDE):
            m = (CHUNK - phase) // WIDTH
            windows = x[:, phase:phase + m * WIDTH].reshape(k * m, WIDTH * VECTOR)
            found = (windows @ w["filters"]).reshape(k, m, FILTERS)
            if not places:
                top = found.max(1)
                best = top if best is None else np.maximum(best, top)
                continue
            arg = found.argmax(1)
            top = np.take_along_axis(found, arg[:, None], 1)[:, 0]
            arg = arg * WIDTH + phase
            if best is None:
                best, at = top, arg
            else:
                at = np.where(top > best, arg, at)
                best = np.maximum(best, top)
        return best + w["filter_bias"], at

    def described(self, chunks: np.ndarray) -> np.ndarray:
        """Hidden units of each chunk."""
        w = self.weights
        pool = np.maximum(self.pooled(chunks)[0], 0)
        return np.maximum(pool @ w["hidden"] + w["hidden_bias"], 0)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Each text's probability of class 1, read whole."""
        if self.base is not None:
            return np.full(len(texts), self.base)
        w = self.weights
        top = np.zeros((len(texts), HIDDEN), np.float32)  # hidden units are not negative
        total = np.zeros((len(texts), HIDDEN), np.float64)
        many = np.array([n_chunks(len(t)) for t in texts])
        for slab, owner in _slabs(texts, many):
            units = self.described(slab)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            who = owner[starts]
            top[who] = np.maximum(top[who], np.maximum.reduceat(units, starts, axis=0))
            total[who] += np.add.reduceat(units.astype(np.float64), starts, axis=0)
        both = np.hstack([top, total / many[:, None]])
        z = both @ w["out"].astype(np.float64) + float(w["out_bias"][0]) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _slabs(texts: list[bytes], many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(chunks, owning text) in pieces of at most SLAB chunks."""
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for first in range(0, int(many[i]), SLAB):
            piece = chunks_of(text, first, first + SLAB)
            if size + len(piece) > SLAB and held:
                yield np.concatenate(held), np.repeat(owners, [len(h) for h in held])
                held, owners, size = [], [], 0
            held.append(piece)
            owners.append(i)
            size += len(piece)
    if held:
        yield np.concatenate(held), np.repeat(owners, [len(h) for h in held])


def gradients(net: Network, texts: list[bytes], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean logistic loss of a batch of texts and its gradient for each weight."""
    w = net.weights
    parts = [chunks_of(t) for t in texts]
    lengths = np.array([len(p) for p in parts])
    chunks, owner = np.concatenate(parts), np.repeat(np.arange(len(texts)), lengths)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    before, at = net.pooled(chunks, places=True)
    pool = np.maximum(before, 0)
    units = np.maximum(pool @ w["hidden"] + w["hidden_bias"], 0)
    top = np.maximum.reduceat(units, starts, axis=0)
    mean = np.add.reduceat(units, starts, axis=0) / lengths[:, None]
    both = np.hstack([top, mean])
    z = both @ w["out"] + w["out_bias"][0]
    loss = float(np.logaddexp(0, z).mean() - (y * z).mean())
    dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)

    grad = {"out": both.T @ dz, "out_bias": np.array([dz.sum()], np.float32)}
    dboth = dz[:, None] * w["out"]
    is_top = units == top[owner]
    share = is_top / np.maximum(np.add.reduceat(is_top.astype(np.float32), starts, axis=0), 1)[owner]
    dunits = share * dboth[owner, :HIDDEN] + dboth[owner, HIDDEN:] / lengths[owner][:, None]
    dunits = np.where(units > 0, dunits, 0).astype(np.float32)
    grad["hidden"], grad["hidden_bias"] = pool.T @ dunits, dunits.sum(0)
    dpool = np.where(before > 0, dunits @ w["hidden"].T, 0)
    grad["filter_bias"] = dpool.sum(0)
    # only each filter's best window of each chunk takes part
    seen = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
    windows = w["vectors"][seen].reshape(len(chunks), FILTERS, WIDTH * VECTOR)
    grad["filters"] = np.einsum("kf,kfw->wf", dpool, windows, optimize=True)
    back = (dpool[:, :, None] * w["filters"].T).reshape(-1, VECTOR)
    flat = seen.ravel()
    grad["vectors"] = np.stack([np.bincount(flat, back[:, v], 257) for v in range(VECTOR)], 1).astype(np.float32)
    grad["vectors"][PAD] = 0
    return loss, grad


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam over shuffled batches of whole texts; the rate falls along a half cosine."""
    net, draw = Network.start(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    steps, step = max(1, epochs * -(-len(texts) // BATCH)), 0
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            pick = order[i:i + BATCH]
            _, grad = gradients(net, [texts[j] for j in pick], labels[pick].astype(np.float32))
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps))
            for name, value in net.weights.items():
                g = grad[name] + DECAY * value
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                value -= rate * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
    return net


def teaching_sample(docs: DataFrame, labels: DataFrame, label: str,
                    max_per_class: int = MAX_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of the bounded sample, and the number of labelled documents by class."""
    marks = cut(labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where("id is not null and y is not null")
                .groupBy("id").agg(F.max((F.col("y") != 0).cast("int")).alias("y")))
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit("teach"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("y") == 1, max_per_class / max(sizes.get(1, 1), 1)).otherwise(
        max_per_class / max(sizes.get(0, 1), 1))
    # the share leaves a few more than the bound at times: order and limit see the sample only
    chosen = marks.where(place < share)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).where(
        F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TEACHING_BYTES)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    return rows.orderBy(F.xxhash64(F.lit("teach"), "id"), "id").limit(2 * max_per_class), sizes


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_per_class: int = MAX_PER_CLASS) -> Network:
    """The network for ``label`` (0 or 1); ``labels`` holds only rows that may teach."""
    prepare(docs.sparkSession)
    rows, sizes = teaching_sample(docs, labels, label, max_per_class)
    if len(sizes) < 2:
        n = sum(sizes.values())
        return Network({}, base=(sizes.get(1, 0) + 1) / (n + 2))
    sample = rows.toArrow()
    texts = [t or b"" for t in sample.column("text").to_pylist()]
    y = np.array(sample.column("y").to_pylist(), np.float32)
    taught = [float(max((y == c).sum(), 1)) for c in (0, 1)]
    net = train(texts, y)
    # from the sample's balance of classes to that of all labelled rows
    net.shift = float(np.log(sizes[1] / sizes[0]) - np.log(taught[1] / taught[0]))
    return net


def score_quality(docs: DataFrame, net: Network, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score (probability of class 1) and predicted (score >= threshold)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    add = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        model = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            score = model.probabilities([t or b"" for t in texts.to_pylist()]) if len(texts) else np.zeros(0)
            return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]

        return work

    return map_arrow(docs, {"text": "binary"}, add, make, keep)
