"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct word shingles, as 64-bit hashes.  One
permutation (sigma) spreads the set over a ring; a second one (pi),
circularly shifted by k, gives the k-th signature coordinate, min pi(sigma(x)
+ k).  Coordinates are banded; documents that agree in a band are candidates,
and every link is confirmed on the full sets.

Groups of copies are never expanded into pairs:
1. documents with equal sets collapse into one node;
2. each node is compared with the leader of its buckets that it shares most
   bands with, one pair per node, and links give first components;
3. buckets whose members lie in several components are compared member by
   member across components, inside tasks, in blocks of bounded size; a task returns a
   spanning forest of its links.  So every candidate pair of different
   components is compared, and no link between components is lost.
Components come from repeated contraction, each round written as tables.

``banding`` gives bands and rows by similarity: 24 bands of 5 rows miss a pair at
0.85 with probability (1 - 0.85^5)^24 = 8e-7, 28 of 4 one at 0.8 with 4e-7; below,
as many bands as keep the miss under ``MISS``.

Defined cases: a null, empty or word-free text has no shingle and is linked
with nothing; a text with fewer words than a shingle is one shingle of all
its words; rows with a null doc_id are nodes of their own (known by a hash of
their text) with a null component unless it holds a real id; repeated rows share a
component.  An id with several texts is one document: each text is compared, and all
that any of them is linked with is one component.  ``kept`` marks the rows whose id is the
component's.  Texts are shingled whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import cut, map_arrow, prepare, written
from wardflow.llm.words import spaced_words_of

#: (least percent, bands, rows): the first that a similarity reaches.
BANDINGS = ((85, 24, 5), (80, 28, 4))
#: Below them: the chance that banding may miss a pair at the threshold, and the bands it may take for more rows.
MISS, MAX_BANDS = 1e-6, 64
#: Shingles of one side of a block comparison (8 bytes each).
BLOCK_SHINGLES = 400_000
#: Rows that a task takes: of a few numbers, and of nodes with their bands.
TASK_ROWS, TASK_NODES = 100_000, 10_000
#: Word hashes that a task remembers.
CACHE_WORDS = 300_000
#: Keys from here on stand for rows without doc_id.
NO_ID = 1 << 62

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) for links of at least ``percent``: most rows that keep the miss under MISS."""
    for least, bands, rows in BANDINGS:
        if percent >= least:
            return bands, rows
    p = max(percent, 1) / 100
    for rows in (3, 2, 1):
        bands = math.ceil(math.log(MISS) / math.log(1 - p ** rows))
        if bands <= MAX_BANDS or rows == 1:
            return bands, rows


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.cache: dict[bytes, int] = {}
        self.weights = [_mix64(np.array([_A + np.uint64(i) * _C], np.uint64))[0] | np.uint64(1) for i in range(words)]

    def hashes(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        new = set(words).difference(cache)
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = set(words)
        for w in new:
            cache[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = spaced_words_of(text) if text else []
        if not words:
            return np.empty(0, np.uint64)
        h = self.hashes(words)
        k = min(self.words, h.size)
        total = np.full(h.size - k + 1, np.uint64(k), np.uint64)
        for j in range(k):
            total += h[j:j + total.size] * self.weights[j]
        return np.unique(_mix64(total))


def sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation: places on a ring of 2^32."""
    return (_mix64(x * _C) >> np.uint64(32)).astype(np.uint32)


def pi(z: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit numbers."""
    z = z * np.uint32(0x9E3779B1)
    z ^= z >> np.uint32(15)
    z *= np.uint32(0x85EBCA77)
    z ^= z >> np.uint32(13)
    return z


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: the minimum under pi shifted by 1 to ``size``."""
    ring = sigma(shingles)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    for i in range(0, ring.size, 1024):  # keeps the table of values in cache
        np.minimum(out, pi(ring[None, i:i + 1024] + shifts).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int) -> list[int]:
    return [xxhash.xxh64_intdigest(part.tobytes(), seed=i) - (1 << 63) for i, part in enumerate(np.split(sig, bands))]


def row_key(doc_id: str, text: str) -> Column:
    """doc_id, or a number from ``NO_ID`` on that stands for the text."""
    return F.coalesce(F.col(doc_id).cast("long"),
                      F.xxhash64(F.col(text)).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))


def few(rows: DataFrame, most: int, a_task: int = TASK_ROWS) -> DataFrame:
    """``rows``, ``most`` at most, in no more partitions than they need.

    A shuffle between many nearly empty partitions makes their product of blocks, which the
    disks and the driver carry: here partitions follow the rows, at any setting.
    """
    return rows.coalesce(max(1, -(-most // a_task)))


def sets_of(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """key, tx (the text's hash), n_shingles, digest of the set, bands: the pass over all texts."""
    add = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
                        T.StructField("bands", T.ArrayType(T.LongType()))])

    def make():
        shingler = Shingler(words)

        def work(texts: pa.Array) -> list[pa.Array]:
            sizes, digests, keys = [], [], []
            for t in texts.to_pylist():
                s = shingler(t)
                sizes.append(s.size)
                digests.append(xxhash.xxh128_digest(s.tobytes()) if s.size else None)
                keys.append(band_keys(signature(s, bands * rows), bands) if s.size else None)
            return [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]

        return work

    return map_arrow(docs, {"text": "binary"}, add, make, keep=["key", "tx"])


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, z): packed texts of the wanted nodes (node, key, tx), one each."""
    add = T.StructType([T.StructField("z", T.BinaryType())])

    def make():
        packer = zstandard.ZstdCompressor(level=1)
        return lambda texts: [pa.array([packer.compress(t) for t in texts.to_pylist()], pa.binary())]

    wanted = wanted.select("node", F.col("key").alias("k"), F.col("tx").alias("x"))
    found = docs.where("text is not null").join(wanted, (docs["key"] == wanted["k"]) & (docs["tx"] == wanted["x"]))
    return map_arrow(found, {"text": "binary"}, add, make, keep=["node"]).dropDuplicates(["node"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (a.size + b.size - both)


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("node").alias("b"), F.col("z").alias("zb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    add = T.StructType([T.StructField("ok", T.BooleanType())])

    def make():
        shingler, reader = Shingler(words), zstandard.ZstdDecompressor()
        last: dict[bytes, np.ndarray] = {}

        def of(z: bytes) -> np.ndarray:
            if z not in last:  # rows come sorted by b: its set is made once
                if len(last) > 3:
                    last.clear()
                last[z] = shingler(reader.decompress(z))
            return last[z]

        def work(za: pa.Array, zb: pa.Array) -> list[pa.Array]:
            return [pa.array([linked(shingler(reader.decompress(x)), of(y), percent)
                              for x, y in zip(za.to_pylist(), zb.to_pylist(), strict=True)], pa.bool_())]

        return work

    return map_arrow(both, {"za": "binary", "zb": "binary"}, add, make, keep=["a", "b"]).where("ok").select("a", "b")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every left set with every right set, from an inverted index."""
    n, m = len(left), len(right)
    out = np.zeros((n, m), np.float32)
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(n + m), [s.size for s in [*left, *right]])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]])) if every.size else np.zeros(1, int)
    is_left = np.concatenate([[0], np.cumsum(owner < n)])
    a = is_left[cuts[1:]] - is_left[cuts[:-1]]
    b = np.diff(cuts) - a
    shared = np.flatnonzero((a > 0) & (b > 0))
    for part in np.array_split(shared, max(1, -(-shared.size // 2048))):
        x, y = np.zeros((n, part.size), np.float32), np.zeros((part.size, m), np.float32)
        sizes = cuts[part + 1] - cuts[part]
        flat = np.repeat(cuts[part], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        column, who = np.repeat(np.arange(part.size), sizes), owner[flat]
        x[who[who < n], column[who < n]] = 1
        y[column[who >= n], who[who >= n] - n] = 1
        out += x @ y
    return out


def forest(left: list[int], right: list[int], ok: np.ndarray, comp: dict[int, int]) -> list[tuple[int, int]]:
    """Links that join different components, as few as join them all."""
    up = {c: c for c in comp.values()}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    out = []
    for i, j in np.argwhere(ok).tolist():
        x, y = root(comp[left[i]]), root(comp[right[j]])
        if x != y:
            up[x] = y
            out.append((left[i], right[j]))
    return out


def compare_blocks(rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) within blocks; ``rows``: band, i, j, side (0 left, 1 right, 2 both), node, comp."""
    given = rows.join(texts, "node").select("band", "i", "j", "side", "node", "comp", "z")

    def work(group: pa.Table) -> pa.Table:
        shingler, reader = Shingler(words), zstandard.ZstdDecompressor()
        node, side, comp = (group.column(c).to_pylist() for c in ("node", "side", "comp"))
        sets = [shingler(reader.decompress(z)) for z in group.column("z").to_pylist()]
        left, right = [i for i, s in enumerate(side) if s != 1], [i for i, s in enumerate(side) if s != 0]
        found: list[tuple[int, int]] = []
        if left and right:
            both = overlaps([sets[i] for i in left], [sets[i] for i in right])
            sizes = np.array([s.size for s in sets], np.float32)
            ok = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
            c = np.array(comp)
            ok &= c[left][:, None] != c[right][None, :]
            found = forest([node[i] for i in left], [node[i] for i in right], ok, dict(zip(node, comp, strict=True)))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return given.groupBy("band", "i", "j").applyInArrow(work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each linked node's component, by contraction.

    Each round points every node to its smallest neighbour, follows pointers
    twice and contracts the links; their number at least halves per component.
    Rounds are tables, as the planner's estimate of a checkpoint grows by powers.
    """
    most = links.count()
    edges = written(few(few(links, most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), most))
    label, labels = None, 2 * most
    while many := edges.count():
        edges = few(edges, many)
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ends.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("comp"))
        up = written(few(up, 2 * many))
        for _ in range(2):
            over = up.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            up = few(up.join(over, "comp").select("node", F.col("top").alias("comp")), 2 * many)
        up = written(up)
        x = up.select(F.col("node").alias("a"), F.col("comp").alias("x"))
        y = up.select(F.col("node").alias("b"), F.col("comp").alias("y"))
        edges = few(few(edges.join(x, "a"), many).join(y, "b").where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), many)
        edges = written(few(edges.distinct(), many))
        if label is None:
            label = up
        else:
            top = up.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            label = written(few(label.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), labels))
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("comp")).where("false")
    return label


def _with_comp(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _importance() -> Column:
    """Order of leaders: nodes with many equal copies first, then a fixed shuffle."""
    return F.least("copies", F.lit(1 << 20)) * F.lit(1 << 42) + F.xxhash64("node").bitwiseAND(F.lit((1 << 42) - 1))


def find_links(nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): confirmed links that connect every component of the candidate graph.

    ``nodes``: node, key and tx of a text with that set, copies, n_shingles, bands.
    """
    many = nodes.count()
    entries = many * banding(percent)[0]
    members = nodes.select("node", "n_shingles", _importance().alias("weight"), F.explode("bands").alias("band"))
    heads = (members.groupBy("band").agg(F.count("*").alias("n"), F.max_by("node", "weight").alias("leader"))
             .where("n > 1"))
    members = cut(few(members.join(heads, "band").select("band", "node", "n_shingles", "weight", "n", "leader"), entries))
    wanted = few(nodes.select("node", "key", "tx").join(members.select("node").distinct(), "node", "left_semi"), many)
    texts = cut(texts_of(docs, wanted))
    # one pair per node: the leader with which it shares most bands
    pairs = few(members.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("shared")), entries)
    pairs = few(pairs.groupBy("node").agg(F.max_by("leader", "shared").alias("leader")), many)
    pairs = cut(few(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), many))
    first = cut(confirm(pairs, texts, words, percent))
    comps = components(first)
    rows = few(_with_comp(members, comps), entries)
    mixed = rows.groupBy("band").agg(
        F.max("n").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.max_by("comp", "weight").alias("main"), F.min("node").alias("x"), F.max("node").alias("y"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h")).where("low <> high")
    # bands with the same members need one comparison
    mixed = few(few(mixed, entries).dropDuplicates(["n", "x", "y", "h"]), entries)
    two = few(mixed.where("n = 2").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), entries)
    second = confirm(two.join(pairs, ["a", "b"], "left_anti"), texts, words, percent)
    rows = rows.select("band", "node", "n_shingles", "comp").join(mixed.where("n > 2").select("band", "main"), "band")
    rows = cut(few(rows.withColumn("other", (F.col("comp") != F.col("main")).cast("int")), entries))
    size = F.sum(F.when(F.col("other") == 1, F.col("n_shingles"))), F.sum(F.when(F.col("other") == 0, F.col("n_shingles")))
    sizes = rows.groupBy("band").agg(*[F.ceil(F.coalesce(s, F.lit(0)) / BLOCK_SHINGLES).cast("int").alias(c)
                                       for s, c in zip(size, ("many_u", "many_v"), strict=True)])
    rows = rows.join(sizes, "band")
    # others (u) against the main component (v) and against each other: blocks i of u, j of v, then of u
    block = F.pmod(F.xxhash64("node"), F.when(F.col("other") == 1, F.col("many_u")).otherwise(F.col("many_v"))).cast("int")
    place = "struct(i as i, j as j, side as side)".replace("side as side", "{} as side")
    as_left = "transform(sequence(0, many_v + many_u - 1), x -> " + place.format(
        "if(x - many_v = k, 2, 0)").replace("i as i", "k as i").replace("j as j", "x as j") + ")"
    as_left = f"filter({as_left}, p -> p.j < many_v or p.j - many_v >= k)"
    as_right = ("if(k > 0, transform(sequence(0, k - 1), x -> "
                "struct(x as i, many_v + k as j, 1 as side)), cast(array() as array<struct<i:int,j:int,side:int>>))")
    main = "transform(sequence(0, many_u - 1), x -> struct(x as i, k as j, 1 as side))"
    rows = rows.withColumn("k", block).select("band", "node", "comp", F.explode(F.expr(
        f"if(other = 1, concat({as_left}, {as_right}), {main})")).alias("p")).select("band", "node", "comp", "p.*")
    third = compare_blocks(rows, texts, words, percent)
    return cut(first.unionByName(second).unionByName(third))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, key.

    Links: 100 x intersection >= ``percent`` x union of the shingle sets of ``words`` words.
    """
    prepare(docs.sparkSession)
    bands, rows = banding(percent)
    keyed = docs.select(row_key("doc_id", "text").alias("key"), F.xxhash64("text").alias("tx"), F.col("text"))
    sets = cut(sets_of(keyed, words, bands, rows))
    many = sets.count()
    groups = cut(few(sets.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct("key", "tx")).alias("of"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands")), many, TASK_NODES))
    # ids with several sets: their sets are nodes by a hash, and linked with one another
    several = cut(few(sets.where("digest is not null").groupBy("key").agg(
        F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select(F.col("key").alias("s")), many))
    by_hash = F.xxhash64("digest").bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    nodes = cut(few(groups.join(several, F.col("of.key") == F.col("s"), "left").select(
        "digest", F.when(F.col("s").isNull(), F.col("of.key")).otherwise(by_hash).alias("node"), F.col("of.key").alias("key"),
        F.col("of.tx").alias("tx"), "copies", "n_shingles", "bands"), many, TASK_NODES))
    links = find_links(nodes, keyed, words, percent)
    if not several.isEmpty():
        mine = sets.select("key", "digest").join(several, F.col("key") == F.col("s"), "left_semi").distinct().join(
            nodes.select("digest", "node"), "digest").select("key", "node")
        first = mine.groupBy("key").agg(F.min("node").alias("a"))
        links = cut(links.unionByName(mine.join(first, "key").where("a <> node").select("a", F.col("node").alias("b"))))
    named = few(_with_comp(nodes.select("digest", "node", "key"), components(links)), many)
    # a component's id is the least key of its rows
    least = few(named.groupBy("comp").agg(F.min("key").alias("id")), many)
    named = few(named.join(least, "comp").select("digest", F.col("id").alias("comp")), many)
    out = few(sets.select("key", "n_shingles", "digest").join(named, "digest", "left"), many)
    comp = F.coalesce("comp", "key")
    return out.select(F.when(F.col("key") < NO_ID, F.col("key")).alias("doc_id"), "n_shingles",
                      F.when(comp < NO_ID, comp).alias("component_id"), (comp == F.col("key")).alias("kept"), "key")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component, once each.

    A later row with the same id and text as a kept one goes; rows with one id
    and different texts stay if both stand for components.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), words, percent).where("kept").select(
        F.col("key").alias("__kept")).distinct()
    rows = docs.withColumn("__key", row_key("doc_id", "text")).join(kept, F.col("__key") == F.col("__kept"), "left_semi")
    return rows.dropDuplicates(["__key", "text"]).select(*[F.col(f"`{c}`") for c in docs.columns])


