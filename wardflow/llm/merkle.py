"""A Merkle manifest of a dataset, level by level with equijoins.

Every row is a leaf: the hash of its fields, each written as its UTF-8 byte
count, a colon and its value (``-`` for a null).  The leaves of a partition
(a source) stand in order of their key; while a partition has more than one
node, every ``fan_out`` consecutive ones become one node, the hash of their
digests as hex text.  What remains is the partition's subroot; the subroots, in
order of the partition's name, make the root the same way.

A level is one frame of (tree, idx, n, h).  Its nodes meet their siblings by
equijoins on the computed sibling index: idx XOR 1 for a binary tree, the other
slots of the run, by their offset, otherwise.  Rows of slot zero, which have the
whole run beside them, emit the parents.  Joins hash (tree, idx), so a partition
that holds most rows spreads like any other; no run leaves Spark, and a level
is written to the checkpoint folder before the next one reads it.  Positions
come from one range partitioning with counts before each piece, not from a
window over a partition.  Rows and partitions are counted once, which bounds the rows of every
level: a side that is bounded to ``SMALL_BYTES`` is broadcast, larger ones meet by shuffles.

Proofs go from the root down: a node's path is its own siblings and then its
parent's path, so a level costs its own size, not that of all rows.

Defined cases: a partition with one row has that leaf as subroot, and a dataset
with one partition has its subroot as root; a run of one node is hashed like
any other; without siblings a proof is the hash of nothing.  Rows with equal
keys stand in order of their leaf (equal leaves in the order they were read),
null keys and null partitions first.  An empty table gives no rows.  Columns
that aren't named are not part of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.llm.common import prepare, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 3
#: A join's side of at most this size, by its bound, is broadcast; a node and its siblings take about this much.
SMALL_BYTES = 4 << 20
NODE_BYTES = 256


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field's unambiguous text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The leaf of a row with these fields."""
    return digest(*[field(v) for v in values])


def numbered(nodes: DataFrame, *order: Column) -> DataFrame:
    """``nodes`` (with a column tree) and idx, from 0 in each tree by ``order``, and n, the tree's nodes."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("tree"), *order]
    # the id holds a row's partition and its place there
    placed = written(nodes.repartitionByRange(parts, *by).sortWithinPartitions(*by)
                 .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    pieces = placed.groupBy("_part", "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_many"))
    tree = Window.partitionBy("tree")
    pieces = pieces.select(
        F.col("_part").alias("_p"), F.col("tree").alias("_t"), "_first",
        (F.sum("_many").over(tree.orderBy("_part")) - F.col("_many")).alias("_before"), F.sum("_many").over(tree).alias("n"))
    both = placed.join(pieces, (placed._part == pieces._p) & (placed.tree == pieces._t))
    return both.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_at", "_part", "_p", "_t", "_first", "_before")


def _side(frame: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``frame``, to be broadcast if its bounded size allows."""
    return F.broadcast(frame) if rows * row_bytes <= SMALL_BYTES else frame


def _level(frame: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``frame`` written; a small one in one piece."""
    return written(frame.coalesce(1) if rows * row_bytes <= SMALL_BYTES else frame)


def with_siblings(nodes: DataFrame, fan_out: int, most: int) -> DataFrame:
    """``nodes`` (at most ``most``) with the digests of the run's other nodes: before, after (left to right) and whether it is slot zero."""
    slot, out = F.col("idx") % fan_out, nodes
    for j in range(1, fan_out):
        other = nodes.select(F.col("tree").alias(f"t{j}"), F.col("idx").alias(f"i{j}"), F.col("h").alias(f"h{j}"))
        at = F.col("idx").bitwiseXOR(F.lit(1)) if fan_out == 2 else F.col("idx") - slot + (slot + j) % fan_out
        out = out.join(_side(other, most, NODE_BYTES), (F.col("tree") == other[f"t{j}"]) & (at == other[f"i{j}"]), "left")
    # siblings by rising offset: first those of later slots, then, round the run's end, those of earlier ones
    here = [F.coalesce(F.when(slot + j < fan_out, F.col(f"h{j}")), F.lit("")) for j in range(1, fan_out)]
    left = [F.coalesce(F.when(slot + j >= fan_out, F.col(f"h{j}")), F.lit("")) for j in range(1, fan_out)]
    return out.withColumn("before", F.concat(*left)).withColumn("after", F.concat(*here)).drop(
        *[f"{c}{j}" for j in range(1, fan_out) for c in "tih"])


@dataclass
class Forest:
    """Levels of trees, leaves first: (tree, idx, n, h, before, after), and the roots (tree, h, height).

    ``bounds``: at most so many rows in each level.
    """
    levels: list[DataFrame]
    roots: DataFrame
    bounds: list[int]


def grow(nodes: DataFrame, fan_out: int) -> Forest:
    """All levels above ``nodes`` (tree, idx, n, h and columns that only the first level keeps)."""
    longest, rows, trees = nodes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*"), F.count_if(F.col("idx") == 0)).first()
    levels, bounds, roots, height = [], [], None, 0
    while True:
        done = nodes.where("n = 1").select("tree", "h", F.lit(height).alias("height"))
        roots = done if roots is None else roots.unionByName(done)
        if height == 0 or longest > 1:  # the first level is kept whole: it may hold lone leaves
            level = _level(with_siblings(nodes, fan_out, rows), rows, NODE_BYTES)
            levels.append(level)
            bounds.append(rows)
        if longest <= 1:
            return Forest(levels, written(roots), bounds)
        run = level.where((F.col("n") > 1) & (F.col("idx") % fan_out == 0))
        nodes = run.select("tree", F.expr(f"idx div {fan_out}").alias("idx"),
                           F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("n"), digest("h", "after").alias("h"))
        # every tree adds at most one node that is not the parent of a whole run
        longest, rows, height = -(-longest // fan_out), rows // fan_out + trees, height + 1


def descend(forest: Forest, tops: DataFrame, fan_out: int, keep: list[str]) -> DataFrame:
    """The first level's nodes (columns ``keep``) with root columns and their path.

    ``tops``: (tree, height, path and further columns of each root).  A path
    lists the texts before and after the node, level by level.
    """
    more = [c for c in tops.columns if c not in ("tree", "height")]
    above, wide = None, 1024
    for k in reversed(range(len(forest.levels))):
        # the parents: the paths of the level above and the roots that end there
        size = (forest.bounds[k + 1] if k + 1 < len(forest.levels) else 0) + forest.bounds[k] // fan_out + 1
        wide += 2 * 64 * fan_out  # bytes of a path so far, about
        ends = tops.where(F.col("height") == k + 1).select("tree", F.lit(0).cast("long").alias("idx"), *more)
        above = ends if above is None else above.unionByName(ends)
        parents = above.select(F.col("tree").alias("pt"), F.col("idx").alias("pi"), *[F.col(c).alias(f"p_{c}") for c in more])
        rows = forest.levels[k].where("n > 1").withColumn("up", F.expr(f"idx div {fan_out}"))
        both = rows.join(_side(parents, size, wide), (rows.tree == parents.pt) & (rows.up == parents.pi))
        path = F.concat(F.array("before", "after"), F.col("p_path"))
        columns = [path.alias("path") if c == "path" else F.col(f"p_{c}").alias(c) for c in more]
        above = both.select("tree", "idx", *(keep if k == 0 else []), *columns)
        if k > 0:
            above = _level(above, forest.bounds[k], wide)
    lone = forest.levels[0].where("n = 1").join(tops.where("height = 0").drop("height"), "tree")
    lone = lone.select("tree", "idx", *keep, *more)
    return lone if above is None else above.unionByName(lone)


def fold(start: Column, path: str) -> Column:
    """The root that ``start`` and its path give."""
    steps = F.when(F.size(path) > 0, F.sequence(F.lit(0), F.size(path) - 2, F.lit(2))).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(steps, start, lambda h, i: F.sha2(F.concat(
        F.get(path, i), h, F.get(path, i + 1)).cast("binary"), 256))


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", partition: str = "source",
          fan_out: int = FAN_OUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: key, partition, leaf, subroot, root and path, and the columns of ``carry``.

    ``carry`` are expressions over ``docs`` (for example the leaf of another
    state of the row), computed in the one pass over the rows.
    """
    prepare(docs.sparkSession)
    extra = {f"c{i}": c for i, c in enumerate((carry or {}).values())}
    name = F.col(f"`{partition}`").cast("string")
    rows = written(docs.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("tree"), F.col(f"`{key}`").alias("key"),
        name.alias("name"), leaf(*[F.col(f"`{f}`") for f in fields]).alias("h"),
        *[c.alias(n) for n, c in extra.items()], F.monotonically_increasing_id().alias("row")))
    lower = grow(numbered(rows, F.col("key").asc_nulls_first(), F.col("h"), F.col("row")).drop("row"), fan_out)
    # "" is the null partition's name and sorts first; the others follow in byte order
    subroots = lower.roots.select(F.lit("").alias("tree"), F.col("tree").alias("part"), "h", F.col("height").alias("own"))
    upper = grow(numbered(subroots, F.col("part")), fan_out)
    tops = upper.roots.select("tree", "height", F.col("h").alias("root"), F.array().cast("array<string>").alias("path"))
    tops = descend(upper, tops, fan_out, ["part", "own", "h"]).select(
        F.col("part").alias("tree"), F.col("own").alias("height"), F.col("h").alias("subroot"), "root", "path")
    found = descend(lower, written(tops), fan_out, ["key", "name", "h", *extra])
    return found.select(F.col("key").alias(key), F.col("name").alias(partition), F.col("h").alias("leaf"), "subroot", "root",
                        "path", *[F.col(n).alias(c) for n, c in zip(extra, carry or {}, strict=True)])


def proof(path: str) -> Column:
    """The hash of a path's siblings, level by level, left to right."""
    return digest(F.array_join(path, ""))
