"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are the windows of 10 consecutive words of the benchmark items
(an item with fewer words is one shorter window).  Words become numbers of the
benchmark's own vocabulary, 0 for any other word.  For each pattern length a
shift table over blocks of two words tells how far a cursor may jump; where
it may not, suffix-hash buckets (with a hash of the prefix, as usual) select
patterns and a direct comparison of all words confirms the occurrence.  All
segments of a batch's texts advance together, so the scan is array code.

Documents never move: the compiled benchmark goes to the tasks.  It is cut
into blocks of about ``MAX_BLOCK_WORDS`` words, none of twice as many, each broadcast within that
bound; a benchmark of several blocks costs as many passes over a text inside
the same stage.  A long item is cut into pieces that overlap by a window less one
word, so every window lies in one of them, and a text that many items share
lies once in each block that has some of their names.

Defined cases: null and empty texts have no words and no hits; null or
word-free items never occur; items with the same id count once, and a null id
counts as an item with an empty name; repeated documents are each searched.
Input columns that an output column names are replaced.  Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import cut, map_arrow, prepare
from wardflow.llm.words import words_of

WINDOW = 10
#: Words of benchmark items in one broadcast: about 60 MB compiled.
MAX_BLOCK_WORDS = 200_000
#: Blocks that one stage searches, one after the other; then its rows are written.
BLOCKS_A_STAGE = 16
#: Words that one cursor scans.
SEGMENT = 256

_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two word numbers."""
    h = a.astype(np.uint64) * _MIX_A + b.astype(np.uint64) * _MIX_B
    return h ^ (h >> np.uint64(29))


class WuManber:
    """Patterns of one length m, as rows of word numbers."""

    def __init__(self, patterns: np.ndarray):
        self.m = patterns.shape[1]
        self.block = min(2, self.m)
        bits = max(12, int(np.ceil(np.log2(patterns.size + 1))) + 3)
        self.mask = np.uint64((1 << min(bits, 26)) - 1)
        self.shift = np.full(int(self.mask) + 1, self.m - self.block + 1, np.int32)
        for j in range(self.block - 1, self.m):
            slot = self._blocks(patterns, j) & self.mask
            np.minimum.at(self.shift, slot.astype(np.int64), self.m - 1 - j)
        # buckets: patterns in the order of their suffix and prefix hash
        self.key = self._bucket(patterns)
        self.order = np.argsort(self.key, kind="stable")
        self.key = self.key[self.order]
        self.patterns = patterns

    def _blocks(self, rows: np.ndarray, j: int) -> np.ndarray:
        return _pair(rows[:, j - 1] if self.block == 2 else rows[:, j], rows[:, j])

    def _bucket(self, rows: np.ndarray) -> np.ndarray:
        suffix, prefix = self._blocks(rows, self.m - 1), self._blocks(rows, self.block - 1)
        return suffix * np.uint64(31) + prefix

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Ends of windows where the shift table lets no cursor pass."""
        n = ids.size
        if n < self.m:
            return np.empty(0, np.int64)
        at = np.arange(self.m - 1, n, SEGMENT)
        stop = np.minimum(at + SEGMENT, n)
        found = []
        while at.size:
            a = ids[at - 1] if self.block == 2 else ids[at]
            jump = self.shift[(_pair(a, ids[at]) & self.mask).astype(np.int64)]
            hit = jump == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence in a sequence of word numbers."""
        ends = self.candidates(ids)
        if not ends.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rows = ids[(ends - self.m + 1)[:, None] + np.arange(self.m)]
        key = self._bucket(rows)
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        starts, which = [], []
        for j in range(int((hi - lo).max(initial=0))):
            here = np.flatnonzero(lo + j < hi)
            pattern = self.order[lo[here] + j]
            same = (self.patterns[pattern] == rows[here]).all(axis=1)
            starts.append(ends[here[same]] - self.m + 1)
            which.append(pattern[same])
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(starts), np.concatenate(which)


class Benchmark:
    """A block of benchmark texts with the names of their items, compiled: vocabulary, searchers, texts of each pattern."""

    def __init__(self, items: list[tuple[list[str], bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [names for names, _ in items]
        lists: dict[int, dict[tuple, set[int]]] = {}
        for number, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                lists.setdefault(m, {}).setdefault(tuple(ids[i:i + m]), set()).add(number)
        self.searchers = []
        for by in lists.values():
            owners = [sorted(s) for s in by.values()]
            offsets = np.concatenate([[0], np.cumsum([len(o) for o in owners])])
            self.searchers.append((WuManber(np.array(list(by), np.int64)), offsets,
                                   np.array([x for o in owners for x in o], np.int64)))

    def search(self, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """For each text: number of words, merged hit ranges [start, end), names of the items that occur."""
        words = [words_of(t) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1  # a 0 after each text, which no pattern has
        ids = np.zeros(int((sizes + 1).sum()), np.int64)
        for w, b in zip(words, begins, strict=True):
            if w:
                ids[b:b + len(w)] = np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.int64, len(w))
        cover = np.zeros(ids.size + 1, np.int32)
        pairs = []
        for searcher, offsets, owners in self.searchers:
            start, pattern = searcher.occurrences(ids)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + searcher.m, -1)
            text = np.searchsorted(begins, start, "right") - 1
            many = offsets[pattern + 1] - offsets[pattern]
            flat = np.repeat(offsets[pattern], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.unique(np.stack([np.repeat(text, many), owners[flat]]), axis=1))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        inside = np.concatenate([[False], np.cumsum(cover) > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
        for s, e in edges.tolist():
            i = int(np.searchsorted(begins, s, "right")) - 1
            spans[i].append((s - int(begins[i]), e - int(begins[i])))
        names: list[set[str]] = [set() for _ in texts]
        for p in pairs:
            for i, item in p.T.tolist():
                names[i].update(self.names[item])
        return sizes.tolist(), spans, [sorted(n) for n in names]


def pieces_of(rows: DataFrame, window: int, most_words: int) -> DataFrame:
    """(name, text) with texts of more than ``most_words`` words in pieces that share ``window`` - 1 words."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(data) if len(data) > most_words else []
                if len(words) <= most_words:
                    names.append(name)
                    texts.append(data)
                    continue
                for at in range(0, len(words) - (window - 1), most_words - (window - 1)):
                    names.append(name)
                    texts.append(b" ".join(words[at:at + most_words]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["name", "text"])

    return rows.mapInArrow(parts, "name string, text binary")


def blocks_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW,
              max_words: int = MAX_BLOCK_WORDS) -> list[DataFrame]:
    """(names, text): the benchmark in blocks, none of more than twice ``max_words`` words (or one row), by a hash.

    A text stands once with the names of all its items, or with some of them in several rows, where
    these alone would be long.
    """
    rows = benchmark.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), F.col(text).cast("binary").alias("text"))
    most = max(2 * window, max_words // 16)
    rows = cut(pieces_of(rows, window, most).distinct())
    length = F.ceil((F.octet_length("name") + 1) / 2)
    lists = rows.groupBy("text").agg(F.ceil(F.sum(length) / most).alias("lists"))
    rows = cut(rows.join(lists, "text").groupBy("text", F.pmod(F.xxhash64("name"), F.col("lists")).alias("nth"))
               .agg(F.collect_list("name").alias("names"), F.sum(length).alias("long")))
    # a word and its space take two bytes at least; names count like words
    weight = F.ceil((F.octet_length("text") + 1) / 2) + F.col("long")
    total, heaviest = rows.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    parts = total // max_words + 1

    def block(many: int) -> Column:
        return F.pmod(F.xxhash64("nth", "text"), F.lit(many))

    while parts > 1:
        found = rows.groupBy(block(parts).alias("block")).agg(F.sum(weight).alias("n")).agg(F.max("n")).first()[0]
        if found <= max(2 * max_words, heaviest):
            break
        parts *= 2
    return [rows.where(block(parts) == i).select("names", "text", weight.alias("weight")) for i in range(parts)]


def _merged(a: list, b: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted([tuple(x) for x in a] + [tuple(x) for x in b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                       max_block_words: int = MAX_BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, spans (merged hit ranges in words) and items (names that occur, sorted)."""
    spark = prepare(docs.sparkSession)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    add = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)),
                        T.StructField("items", T.ArrayType(T.StringType()))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    blocks = blocks_of(benchmark, window=window, max_words=max_block_words)
    out = docs
    for i, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast([(list(r.names), bytes(r.text)) for r in block.collect()])

        def make(shared=shared, first=i == 0):
            compiled = Benchmark(shared.value, window)

            def work(texts: pa.Array, *before: pa.Array) -> list[pa.Array]:
                sizes, spans, names = compiled.search(texts.to_pylist())
                if not first:
                    old = [[(x["start"], x["end"]) for x in o] for o in before[0].to_pylist()]
                    spans = [_merged(o, s) for o, s in zip(old, spans, strict=True)]
                    names = [sorted({*o, *n}) for o, n in zip(before[1].to_pylist(), names, strict=True)]
                return [pa.array(sizes, pa.int64()),
                        pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind),
                        pa.array(names, pa.list_(pa.string()))]

            return work

        read = {text: "binary"} | ({} if i == 0 else {"spans": span_type(), "items": "array<string>"})
        last = i == len(blocks) - 1
        columns = keep if last or keep is None else [*keep, *([] if text in keep else [text])]
        out = map_arrow(out, read, add, make, columns)
        if i % BLOCKS_A_STAGE == BLOCKS_A_STAGE - 1 and not last:
            out = cut(out)
    return out


def span_type() -> str:
    return "array<struct<start:bigint,end:bigint>>"


def contaminated_words():
    """Words inside any span: an expression over ``spans``."""
    return F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with their own columns."""
    columns = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(columns)],
                          F.col("text").alias("__text"))
    found = find_contamination(renamed, benchmark, "__text", keep=[f"__o{i}" for i in range(len(columns))])
    return found.where(F.size("items") == 0).select(
        *[F.col(f"__o{i}").alias(c) for i, c in enumerate(columns)])
