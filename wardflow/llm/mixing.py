"""Mixing sources to target weights by systematic sampling.

Each source gets a target in words: sources, by code point with null last,
weigh 5, 2, 1, repeating, and share 150 % of all words; a target stops at
twice its source's words and the excess is shared again by weight.  Within a
source every document expects target / source words copies; documents in
order of size carry a running sum of expected copies, one random offset is
added, and a document is taken once for each integer that its step crosses.
Order by size makes neighbours alike, so the words taken come near the target.

The running sum is distributed: documents are range-partitioned by (source,
size, id), so a hot source spreads over many tasks, ranks within partitions
are written once, and only partition totals are summed up.

Defined cases: null and empty texts have size 0 and may be taken (0 words);
a null source is a source, the last; null ids come first; repeated rows count
each; an empty table gives an empty result.  Reruns agree: the offset depends
on ``seed`` and the source only.  Input columns that an output column names are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.llm.common import cut, prepare

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            cap: float = CAP) -> DataFrame:
    """(source, source_size, target, offset) by filling up to the caps in order of cap / weight.

    One row per source: the windows without a key see sources, not documents.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth - 1) % len(weights) + 1)
    rows = sums.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(cap))
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("rest", F.col("total") - F.coalesce(
        F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("weights", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("full", F.col("cap") * F.col("weights") <= F.col("w") * F.col("rest"))
    open_rows = F.when(~F.col("full"), F.col("rest") / F.col("weights"))
    # the first source that is not full sets the level of all later ones
    lead = F.first(open_rows, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("level", lead)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.col("w") * F.col("level"))
    text = F.concat(F.lit(SEED + "|"), F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("null")))
    offset = F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))
    return rows.select("source", "source_size", target.alias("target"), offset.alias("offset"))


def _crossed(rank: Column) -> Column:
    """Integers crossed by the step to ``rank`` (from 1) of the running sum of expected copies."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (F.floor(F.col("offset") + rank * rate) - F.floor(F.col("offset") + (rank - 1) * rate)).cast("long")


def ranked(docs: DataFrame, seed_columns: tuple[str, str, str] = ("doc_id", "source", "text")) -> DataFrame:
    """(doc_id, source, size, fingerprint, rank, source_size, target, offset), one row per document."""
    prepare(docs.sparkSession)
    doc_id, source, text = seed_columns
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"),
                         F.xxhash64(F.col(text)).alias("fingerprint"))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col("fingerprint")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row's id holds its partition and its place there
    placed = cut(narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                 .withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    pieces = placed.groupBy(part, "source").agg(F.min("at").alias("first"), F.count("*").alias("n"),
                                                F.sum("size").alias("size"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part")
                             .rowsBetween(Window.unboundedPreceding, -1))
    pieces = cut(pieces.withColumn("before", F.coalesce(before, F.lit(0))))
    goal = targets(pieces).withColumnRenamed("source", "s")
    pieces = pieces.join(goal, pieces.source.eqNullSafe(goal.s)).select(
        F.col("part").alias("p"), "s", "first", "before", "source_size", "target", "offset")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    out = placed.join(pieces, (placed.part == pieces.p) & placed.source.eqNullSafe(pieces.s))
    return out.withColumn("rank", F.col("at") - F.col("first") + F.col("before") + 1).drop(
        "at", "part", "p", "s", "first", "before")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies and taken (copies x size)."""
    out = ranked(docs).withColumn("copies", _crossed(F.col("rank")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Texts are shuffled once, by document; equal rows stand at following
    ranks, so the n-th of them gets the n-th of these ranks.
    """
    columns = docs.columns
    ranks = ranked(docs).groupBy("doc_id", "source", "size", "fingerprint").agg(
        F.min("rank").alias("rank"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.first("offset").alias("offset"))
    ranks = ranks.select(F.col("doc_id").alias("id"), F.col("source").alias("s"), F.col("fingerprint").alias("f"),
                         "rank", "source_size", "target", "offset")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                       F.xxhash64("text").alias("fingerprint"))
    both = rows.join(ranks, rows["row.doc_id"].eqNullSafe(ranks.id) & (rows.fingerprint == ranks.f)
                     & rows["row.source"].eqNullSafe(ranks.s))
    nth = F.row_number().over(Window.partitionBy("id", "f", "s").orderBy("f")) - 1
    both = both.withColumn("copies", _crossed(F.col("rank") + nth))
    return (both.where("copies > 0").select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy"))
            .select(*[F.col("row").getField(c).alias(c) for c in columns]))
