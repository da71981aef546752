"""Hard negatives by an inverted multi-index with certified windows.

A row's vector becomes whole numbers, floor(scale * x); scores are inner products of these, exact.
Each half of the dimensions has a codebook (k-means on a bounded sample); a
row's two codewords name its cell.  For an anchor, no member of a cell scores
more than the sum of two half-score bounds: the half's product with the
codeword plus its norm times the codeword's radius, the largest distance of a
member.  A heap walks the pairs of codewords in falling order of that sum
(the multi-sequence walk), and a search stops as soon as the next bound
cannot change a result any more: first for an anchor's positives (best rows of its label),
then for the windows of scores that its positives open for rows of other labels.

All rows are indexed.  Rows stand in blocks of whole first codewords; a
codeword with more rows than a block holds is split by a hash.  Anchors stand
in blocks, too; each pair of blocks is one task of a cogroup, which searches
the pair exactly, and the few best rows of each block merge in Spark.  Codebooks
steer the walk only: any codebook gives the same result.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; vectors of different lengths are compared as if padded
with zeros.  Ties go to the smaller id, null ids last; repeated rows are rows of their own,
and an anchor is no candidate of itself only.  A negative positive score
opens no window, and a score of 0 only that of 0.  An empty table, or one without anchors, gives no rows.  Scores
above 2^53 are computed with Python's integers and clamped to 64 bits.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import cut, map_arrow, prepare

#: Values (rows x dimensions) of a block of rows, of anchors, and of the codebooks' sample.
ROW_VALUES, ANCHOR_VALUES, SAMPLE_VALUES = 1 << 20, 1 << 18, 1 << 20
#: Rows that a cell should hold, and codewords of a half at most.
CELL_ROWS, MAX_WORDS = 256, 1024
ROUNDS, SEED = 8, 13
EXACT = 2.0 ** 53
_LAST = np.iinfo(np.int64).max


@dataclass
class Codebooks:
    """Two half-space codebooks over vectors of ``dims`` whole numbers."""
    dims: int
    scale: float
    first: np.ndarray
    second: np.ndarray

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, :self.first.shape[1]], vectors[:, self.first.shape[1]:]

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(vectors)
        return nearest(a, self.first), nearest(b, self.second)


def whole(lists: pa.Array, dims: int, scale: float) -> np.ndarray:
    """(rows, dims) floor(scale * x) of list arrays, padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    many, sizes = len(lists), np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((many, dims))
    if (sizes == dims).all():
        out[:] = flat.reshape(many, dims)
    else:
        row = np.repeat(np.arange(many), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.floor(out * scale)


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not words.shape[1]:
        return np.zeros(len(x), np.int32)
    return ((words * words).sum(1) - 2 * (x @ words.T)).argmin(1).astype(np.int32)


def codebook(x: np.ndarray, words: int, seed: int) -> np.ndarray:
    """k-means: ``words`` centres of the rows of ``x``."""
    draw = np.random.default_rng(seed)
    centres = x[draw.permutation(len(x))[:words]].copy()
    for _ in range(ROUNDS):
        which = nearest(x, centres)
        many = np.bincount(which, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, which, x)
        centres[many > 0] = sums[many > 0] / many[many > 0, None]
    return centres


def fit(rows: DataFrame, dims: int, many: int, scale: float) -> Codebooks:
    """Codebooks from a bounded sample by hash; their number of words follows the number of rows."""
    most = max(1, min(many, SAMPLE_VALUES // max(dims, 1)))
    sample = rows.orderBy(F.xxhash64(F.lit("words"), "rid"), "rid").limit(most).select("vector").toArrow()
    x = whole(sample.column("vector"), dims, scale)
    words = int(min(MAX_WORDS, max(1, round((many / CELL_ROWS) ** 0.5)), len(x)))
    half = dims // 2
    return Codebooks(dims, scale, codebook(x[:, :half], words, SEED), codebook(x[:, half:], words, SEED + 1))


class Block:
    """Rows of one block, by cell, with the radii of their codewords."""

    def __init__(self, books: Codebooks, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        one, two = books.cells(vectors)
        order = np.lexsort((two, one))
        self.books, self.vectors = books, vectors[order]
        self.ids, self.rids, self.labels = ids[order], rids[order], labels[order]
        cell = one[order].astype(np.int64) * len(books.second) + two[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.cell = {int(cell[s]): (int(s), int(e)) for s, e in zip(starts, np.r_[starts[1:], len(cell)], strict=True)}
        self.used, self.radius = [], []
        for which, part, words in zip((one, two), books.halves(vectors), (books.first, books.second), strict=True):
            far = np.zeros(len(words))
            np.maximum.at(far, which, np.sqrt(((part - words[which]) ** 2).sum(1)))
            self.used.append(np.unique(which))
            self.radius.append(far)
        self.norm = float(np.sqrt((vectors ** 2).sum(1).max()))

    def walk(self, q: np.ndarray):
        """(bound, scores, rows' slice) of the cells with rows, by falling bound."""
        sequences = []
        for part, words, used, far in zip(self.books.halves(q[None]), (self.books.first, self.books.second),
                                          self.used, self.radius, strict=True):
            bound = words[used] @ part[0] + np.sqrt((part ** 2).sum()) * far[used]
            by = np.argsort(-bound, kind="stable")
            sequences.append((bound[by], used[by]))
        (one, first), (two, second) = sequences
        size = float(np.sqrt((q ** 2).sum())) * self.norm
        slack = 1e-9 * size + 1e-6  # rounding of the bounds
        heap, seen = [(-(one[0] + two[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            for n in ((i + 1, j), (i, j + 1)):
                if n[0] < len(one) and n[1] < len(two) and n not in seen:
                    seen.add(n)
                    heapq.heappush(heap, (-(one[n[0]] + two[n[1]]), *n))
            there = self.cell.get(int(first[i]) * len(self.books.second) + int(second[j]))
            if there is not None:
                yield -bound + slack, self._scores(q, there, size), slice(*there)

    def _scores(self, q: np.ndarray, there: tuple[int, int], size: float) -> np.ndarray:
        rows = self.vectors[there[0]:there[1]]
        if size < EXACT:
            return (rows @ q).astype(np.int64)
        whole_q = [int(v) for v in q]
        exact = (sum(int(a) * b for a, b in zip(r, whole_q, strict=True)) for r in rows)
        return np.array([min(max(s, -_LAST), _LAST) for s in exact], np.int64)


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> list[tuple[np.ndarray, ...]]:
    """The first ``most`` of (scores, ids, rids) by falling score, then id."""
    scores, ids, rids = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((rids, ids, -scores))[:most]
    return [(scores[order], ids[order], rids[order])]


def positives(block: Block, q: np.ndarray, rid: int, label: int, most: int) -> tuple[np.ndarray, ...] | None:
    """The block's first ``most`` other rows of the label: (scores, ids, rids)."""
    kept: list = []
    for bound, scores, at in block.walk(q):
        if kept and len(kept[0][0]) == most and kept[0][0][-1] > bound:
            break  # what is left scores less than the last of these
        ok = (block.labels[at] == label) & (block.rids[at] != rid)
        if ok.any():
            kept = _best([*kept, (scores[ok], block.ids[at][ok], block.rids[at][ok])], most)
    return kept[0] if kept else None


def negatives(block: Block, q: np.ndarray, label: int, windows: list[tuple[int, int]],
              most: int) -> list[tuple[np.ndarray, ...] | None]:
    """For each window (low, high) of scores the block's first ``most`` rows of other labels."""
    kept: list[list] = [[] for _ in windows]
    open_windows = {i for i, (low, high) in enumerate(windows) if low <= high}
    for bound, scores, at in block.walk(q):
        open_windows = {i for i in open_windows if bound >= windows[i][0] and not (
            kept[i] and len(kept[i][0][0]) == most and kept[i][0][0][-1] > bound)}
        if not open_windows:
            break
        other = block.labels[at] != label
        for i in open_windows:
            ok = other & (scores >= windows[i][0]) & (scores <= windows[i][1])
            if ok.any():
                kept[i] = _best([*kept[i], (scores[ok], block.ids[at][ok], block.rids[at][ok])], most)
    return [k[0] if k else None for k in kept]


def _block(books: Codebooks, rows: pa.Table) -> Block:
    ids = rows.column("id").fill_null(_LAST).to_numpy()
    return Block(books, ids, rows.column("rid").to_numpy(), rows.column("label").to_numpy(),
                 whole(rows.column("vector"), books.dims, books.scale))


def _blocks(counts: dict[int, int], per_block: int) -> tuple[list[tuple[int, int, int]], int]:
    """(codeword, first block, blocks) of each codeword, and the number of blocks; at most MAX_WORDS codewords.

    Neighbouring codewords share a block up to its size; a larger one has blocks of its own.
    """
    out, block, filled = [], 0, 0
    for word in sorted(counts):
        split = -(-counts[word] // per_block)
        if filled and filled + counts[word] > per_block:
            block, filled = block + 1, 0
        out.append((word, block, split))
        filled += counts[word]
        if split > 1:
            block, filled = block + split, 0
    return out, block + (filled > 0)


def mine(rows: DataFrame, anchors: Column, id_column: str = "vec_id", label: str = "label", vector: str = "embedding",
         most_positives: int = 5, most_negatives: int = 10, low: int = 30, high: int = 90,
         scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``rows``; a negative's score lies between
    ``low`` and ``high`` percent of the positive's.
    """
    spark = prepare(rows.sparkSession)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    table = cut(rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & fine).select(
        F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vector).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
        F.monotonically_increasing_id().alias("rid")))
    many, asked, dims = table.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("vector"))).first()
    out = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not asked:
        return spark.createDataFrame([], out)
    books = spark.sparkContext.broadcast(fit(table, dims, many, scale))

    def cells():
        found = books.value
        return lambda vectors: [pa.array(found.cells(whole(vectors, found.dims, found.scale))[0], pa.int32())]

    kind = table.schema["vector"].dataType.simpleString()
    placed = cut(map_arrow(table, {"vector": kind}, T.StructType([T.StructField("word", T.IntegerType())]), cells))
    per_block, per_group = max(1, ROW_VALUES // max(dims, 1)), max(1, ANCHOR_VALUES // max(dims, 1))
    words, many_blocks = _blocks({r.word: r["count"] for r in placed.groupBy("word").count().collect()}, per_block)
    words = spark.createDataFrame(words, "w int, first int, split int")
    groups = -(-asked // per_group)
    placed = placed.join(F.broadcast(words), placed.word == words.w).select(
        "id", "rid", "label", "vector", (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("split"))).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    key = ["block", "grp"]
    queries = table.where("is_anchor").select("id", "rid", "label", "vector", F.pmod(
        F.xxhash64("rid"), F.lit(groups)).cast("int").alias("grp"))

    def each_block(asking: DataFrame) -> DataFrame:
        return asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many_blocks - 1))))

    def first_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {"anchor": [], "rid": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            block, q = _block(books.value, left), whole(right.column("vector"), books.value.dims, books.value.scale)
            for i, (rid, mark) in enumerate(zip(right.column("rid").to_pylist(), right.column("label").to_pylist(), strict=True)):
                got = positives(block, q[i], rid, mark, most_positives)
                if got is not None:
                    found["anchor"].append(np.full(len(got[0]), rid))
                    for name, part in zip(("score", "id", "rid"), got, strict=True):
                        found[name].append(part)
        return _table(found)

    near = placed.groupBy(*key).cogroup(each_block(queries).groupBy(*key)).applyInArrow(
        first_pass, "anchor long, rid long, id long, score long")
    nth = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "rid")
    near = near.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= most_positives)
    near = cut(near.select("anchor", F.col("nth").alias("pos"), F.col("id").alias("pid"), F.col("score").alias("pscore")))
    opened = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("pos", "pscore"))).alias("opened"))
    second = queries.join(opened, queries.rid == opened.anchor).select(
        "rid", "label", "vector", "grp", F.col("opened.pos").alias("pos"), F.col("opened.pscore").alias("pscore"))

    def second_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {"anchor": [], "pos": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            block, q = _block(books.value, left), whole(right.column("vector"), books.value.dims, books.value.scale)
            for i, r in enumerate(right.select(["rid", "label", "pos", "pscore"]).to_pylist()):
                windows = [(-(-low * s // 100), high * s // 100) for s in r["pscore"]]
                for pos, got in zip(r["pos"], negatives(block, q[i], r["label"], windows, most_negatives), strict=True):
                    if got is not None:
                        found["anchor"].append(np.full(len(got[0]), r["rid"]))
                        found["pos"].append(np.full(len(got[0]), pos))
                        found["score"].append(got[0])
                        found["id"].append(got[1])
        return _table(found)

    far = placed.groupBy(*key).cogroup(each_block(second).groupBy(*key)).applyInArrow(
        second_pass, "anchor long, pos long, id long, score long")
    nth = Window.partitionBy("anchor", "pos").orderBy(F.desc("score"), "id")
    far = far.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= most_negatives)
    names = queries.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))

    def known(c: str) -> Column:
        return F.when(F.col(c) != int(_LAST), F.col(c))

    return far.join(near, ["anchor", "pos"]).join(names, "anchor").select(
        "anchor_id", known("pid").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        known("id").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score"))


def _table(found: dict[str, list[np.ndarray]]) -> pa.Table:
    return pa.table({name: pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
                     for name, parts in found.items()})
