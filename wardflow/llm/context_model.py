"""Variable-order byte context trees, counted by Spark and run as a sparse automaton.

A tree holds, per class (a language, or accepted/rejected), every context of
up to ``order`` bytes that the class's training rows have: it grows with the
corpus, and no class takes room from another.  Its entries are sorted arrays,
one pair for each class and context length: (context, byte) with its code
length, and context with what an escape from it costs.  A byte's code length is
that of the longest context which knows the byte, plus the escapes before it;
as whatever a context has seen, its suffixes have seen too, entries need no
rows for unseen bytes.  The driver and every worker hold all trees.

A batch's distinct grams are looked up once, so text costs one hash a byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import gather_arrow

#: Bytes before a text's start.
PAD = 10
#: Bytes that are looked up together.
PIECE = 1 << 20
#: The longest code length of a byte.
MAX_BITS = -np.log2(1e-30)
#: Distinct grams that a task holds before it writes them out.
FLUSH_GRAMS = 2_000_000


def _pack(flat: np.ndarray, order: int) -> np.ndarray:
    """Each run of ``order`` + 1 bytes in 64 bits."""
    key = np.zeros(flat.size - order, np.int64)
    for k in range(order + 1):
        key = (key << 8) | flat[k:k + key.size]
    return key


def _grams(data: list[bytes], order: int) -> np.ndarray:
    """All (context, byte) grams of ``order`` + 1 bytes, packed in 64 bits."""
    lead = bytes([PAD]) * order
    flat = np.frombuffer(lead + lead.join(data) if data else b"", dtype=np.uint8)
    if flat.size <= order:
        return np.empty(0, np.int64)
    key = _pack(flat, order)
    # a text's first symbol follows `order` pads; grams that end in the next text's pads go
    ends = np.cumsum([len(d) + order for d in data]) - order
    keep = np.ones(key.size, bool)
    for k in range(order):
        at = ends[:-1] + k
        keep[at[at < key.size]] = False
    return key[keep]


def count_grams(rows: DataFrame, label: str, text: str, order: int, part: str | None = None) -> DataFrame:
    """(label, gram, n): counts of all texts, combined in each task before the shuffle.

    With ``part``, a boolean column, also n_part: the counts of the texts where it holds.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    sums = ["n", "n_part"] if part else ["n"]
    out = T.StructType([T.StructField("label", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("gram", *sums)]])

    def make():
        held: dict[str, list[tuple[np.ndarray, ...]]] = {}

        def merge(parts):
            uniq, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return uniq, *[np.bincount(at, weights=np.concatenate([p[i] for p in parts]), minlength=uniq.size).astype(np.int64)
                           for i in range(1, 1 + len(sums))]

        def drain():
            if not held:
                return None
            merged = {k: merge(v) for k, v in held.items()}
            held.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([k for k, (u, *_) in merged.items() for _ in range(u.size)], pa.string()),
                *[pa.array(np.concatenate([m[i] for m in merged.values()])) for i in range(1 + len(sums))],
            ], names=out.names)

        def add(labels, texts, *inside):
            groups: dict[tuple, list[bytes]] = {}
            for name, data, *x in zip(labels.to_pylist(), texts.to_pylist(), *[i.to_pylist() for i in inside], strict=True):
                if data:
                    groups.setdefault((name, *x), []).append(data)
            for (name, *x), data in groups.items():
                grams, ns = np.unique(_grams(data, order), return_counts=True)
                held.setdefault(name, []).append((grams, ns, *[ns if i else np.zeros_like(ns) for i in x]))
                if len(held[name]) >= 16 * len(sums):
                    held[name] = [merge(held[name])]
            if sum(p[0].size for v in held.values() for p in v) > FLUSH_GRAMS:
                return drain()
            return None

        return add, drain

    rows = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    read = {label: "string", text: "binary"} | ({part: "boolean"} if part else {})
    return gather_arrow(rows, read, out, make).groupBy("label", "gram").agg(*[F.sum(c).alias(c) for c in sums])


@dataclass
class ContextCounts:
    """Counts by class and context length: sorted grams (context and byte) and how often they occur."""

    levels: dict[str, list[tuple[np.ndarray, np.ndarray]]]

    def __iter__(self) -> Iterator[tuple[str, int, int, int]]:
        """(label, context order, gram, n)."""
        for name, levels in self.levels.items():
            for k, (grams, ns) in enumerate(levels):
                for g, n in zip(grams.tolist(), ns.tolist(), strict=True):
                    yield name, k, g, n


def _mask(k: int) -> int:
    """Of a gram's last k + 1 bytes."""
    return (1 << 8 * (k + 1)) - 1


def context_counts(grams: DataFrame, order: int, least: int = 1) -> ContextCounts:
    """The counts of every context that occurs ``least`` times, and of the empty one.

    The longest grams come to the driver; the shorter ones are their sums.
    """
    return summed(grams.select("label", "gram", "n").toArrow(), order, least)


def crossed_counts(grams: DataFrame, order: int) -> Iterator[ContextCounts]:
    """The counts of all texts, of those where ``count_grams``' part holds, and of the others, one after another."""
    rows = grams.toArrow()
    yield summed(rows, order)
    inside = rows.column("n_part")
    yield summed(rows.set_column(2, "n", inside).filter(pc.greater(inside, 0)), order)
    other = pc.subtract(rows.column("n"), inside)
    yield summed(rows.set_column(2, "n", other).filter(pc.greater(other, 0)), order)


def summed(rows: pa.Table, order: int, least: int = 1) -> ContextCounts:
    """``context_counts`` of collected (label, gram, n)."""
    rows = rows.combine_chunks()
    label = rows.column("label").combine_chunks()
    label = label.dictionary_encode() if len(label) else label
    names = label.dictionary.to_pylist() if len(label) else []
    which = label.indices.to_numpy() if len(label) else np.empty(0, np.int32)
    gram, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    out = {}
    for i, name in sorted(enumerate(names), key=lambda x: x[1]):
        of = which == i
        at = np.argsort(gram[of])
        keys, ns = gram[of][at], n[of][at]
        levels = []
        for k in range(order, -1, -1):
            short = keys & _mask(k)
            if k < order:
                short, at = np.unique(short, return_inverse=True)
                ns = np.bincount(at, weights=ns, minlength=short.size).astype(np.int64)
            keys = short
            known = np.ones(keys.size, bool)
            if k and least > 1:
                _, at = np.unique(keys >> 8, return_inverse=True)
                known = np.bincount(at, weights=ns)[at] >= least
            levels.append((keys[known], ns[known]))
        out[name] = levels[::-1]
    return ContextCounts(out)


def escape_rows(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, parent: np.ndarray,
                rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prediction by partial matching, escape method C with exclusion.

    Probabilities of the bytes that contexts have seen, and the factor that a context
    puts before the shorter one's for other bytes.  ``parent``: the shorter context's
    probabilities of the seen bytes, ``rest``: what it leaves to the others.
    """
    return n / (total + kinds), kinds / (total + kinds) / np.maximum(rest, 1e-12)


def witten_bell_rows(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, parent: np.ndarray,
                     rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Witten-Bell interpolation with the shorter context; arguments as in ``escape_rows``."""
    return (n + kinds * parent) / (total + kinds), kinds / (total + kinds)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``keys``, and whether the key is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, keys.size - 1))
    return at, keys[at] == wanted if keys.size else np.zeros(wanted.size, bool)


class Automaton:
    """Per class and context length: seen bytes' code lengths and escapes, in bits."""

    def __init__(self, counts: ContextCounts, order: int, smooth: Callable[..., tuple[np.ndarray, np.ndarray]]):
        self.order = order
        self.labels = sorted(counts.levels)
        self.tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        for name in self.labels:
            tables, below, p = [], np.empty(0, np.int64), np.empty(0)
            for k, (grams, n) in enumerate(counts.levels[name]):
                parent = p[np.searchsorted(below, grams & _mask(k - 1))] if k else np.full(grams.size, 1 / 256)
                contexts, first, of = np.unique(grams >> 8, return_index=True, return_inverse=True)
                total = np.bincount(of, weights=n, minlength=contexts.size)
                kinds = np.bincount(of, minlength=contexts.size)
                rest = 1.0 - np.bincount(of, weights=parent, minlength=contexts.size)
                p, escape = smooth(n, total[of], kinds[of], parent, rest[of])
                tables.append((grams, -np.log2(p).astype(np.float32), contexts,
                               -np.log2(escape[first]).astype(np.float32)))
                below = grams
            self.tables.append(tables)

    @property
    def contexts(self) -> dict[str, int]:
        """How many contexts each class holds."""
        return {name: sum(t[2].size for t in tables) for name, tables in zip(self.labels, self.tables, strict=True)}

    def _bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the grams' last bytes: (grams, classes)."""
        out = np.zeros((grams.size, len(self.labels)))
        for x, tables in enumerate(self.tables):
            left = np.arange(grams.size)
            for k in range(self.order, -1, -1):
                known, cost, contexts, escape = tables[k]
                short = grams[left] & _mask(k)
                at, hit = _at(known, short)
                out[left[hit], x] += cost[at[hit]]
                left, short = left[~hit], short[~hit]
                at, hit = _at(contexts, short >> 8)
                out[left[hit], x] += escape[at[hit]]
            out[left, x] += 8.0  # 1 / 256: a byte that the class never had
        return np.minimum(out, MAX_BITS)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each class: (texts, classes)."""
        out = np.zeros((len(texts), len(self.labels)))
        sizes = np.array([len(t) for t in texts], np.int64)
        if not self.labels or not sizes.sum():
            return out
        lead, k = bytes([PAD]) * self.order, self.order
        flat = np.frombuffer(lead + lead.join(texts), np.uint8)
        begins = np.cumsum(sizes + k) - (sizes + k)
        for a in range(0, flat.size - k, PIECE):
            key = _pack(flat[a:a + PIECE + k], k)
            place = np.arange(a, a + key.size)
            owner = np.searchsorted(begins, place, side="right") - 1
            inside = place < begins[owner] + sizes[owner]
            owner, grams = owner[inside], pa.array(key[inside]).dictionary_encode()
            bits, at = self._bits(grams.dictionary.to_numpy()), grams.indices.to_numpy()
            for x in range(len(self.labels)):
                out[:, x] += np.bincount(owner, weights=bits[:, x][at], minlength=len(texts))
        return out
