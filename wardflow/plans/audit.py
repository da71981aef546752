"""Data-quality audits of the star (A11-A13, A15, A16) as DataFrames.

The source database enforced keys and references with DDL at load time;
here each rule is a query whose result lists the findings, so a load can be
checked before it is published (see ``sources.etl``).

Plans are built for large facts: a key check is one aggregation by key
(partial aggregation collapses a hot key inside each task), and the reference
check counts distinct references, which then meet the keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.functions.bands import is_private_trust
from wardflow.functions.numeric import rate_pct
from wardflow.schemas import FOREIGN_KEYS, PRIMARY_KEYS, ROW_BOUND, UNIQUE_KEYS
from wardflow.sources.star import Star

# The headline readmission rate (percent) with the tolerance
# that the reconciliation allows.
EXPECTED_READMISSION_RATE = 17.0
READMISSION_TOLERANCE = 1.0


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def key_check(df: DataFrame, table: str, key: str, kind: str = "primary") -> DataFrame:
    """One row: rows, null keys, distinct keys and keys seen more than once."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    present = F.col(key).isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).cast("bigint").alias("null_keys"),
        F.count(F.when(present, F.lit(1))).cast("bigint").alias("distinct_keys"),
        F.count(F.when(present & (F.col("n") > 1), F.lit(1))).cast("bigint").alias("duplicated_keys"),
    ).select(F.lit(table).alias("table_name"), F.lit(key).alias("key_column"),
             F.lit(kind).alias("kind"), "*")


def key_audit(star: Star) -> DataFrame:
    """A11 + A12: primary keys (unique, not null) and extra unique columns.

    Each fact's key is aggregated in its own type, one shuffle a fact; the keys of
    all dimensions share one aggregate by (table, column, key as text).
    """
    keys = [(t, k, "primary") for t, k in PRIMARY_KEYS.items()]
    keys += [(t, c, "unique") for t, cols in UNIQUE_KEYS.items() for c in cols]
    small = [k for k in keys if not k[0].startswith("fact_")]
    out = _union([key_check(star.columns(t, k), t, k, kind) for t, k, kind in keys if t.startswith("fact_")]
                 + [_small_key_checks(star, small)])
    ok = (F.col("null_keys") == 0) & (F.col("duplicated_keys") == 0)
    if_unique = (F.col("kind") == "unique") & (F.col("duplicated_keys") == 0)
    return out.withColumn("status", F.when(ok | if_unique, F.lit("ok")).otherwise(F.lit("violation")))


def _small_key_checks(star: Star, keys: list[tuple[str, str, str]]) -> DataFrame:
    """``key_check`` of several tables in one aggregate; a table without rows has a row too."""
    every = _union([star.columns(t, k).select(F.lit(i).alias("nth"), F.col(k).cast("string").alias("key"))
                    for i, (t, k, _) in enumerate(keys)])
    present = F.col("key").isNotNull()
    found = every.groupBy("nth", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("nth").agg(
        F.sum("n").alias("rows"), F.sum(F.when(~present, F.col("n"))).alias("null_keys"),
        F.count(F.when(present, F.lit(1))).alias("distinct_keys"),
        F.count(F.when(present & (F.col("n") > 1), F.lit(1))).alias("duplicated_keys"))
    spec = star.spark.createDataFrame([(i, *k) for i, k in enumerate(keys)],
                                      "nth int, table_name string, key_column string, kind string")
    return spec.join(found, "nth", "left").select("table_name", "key_column", "kind", *[
        F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
        for c in ("rows", "null_keys", "distinct_keys", "duplicated_keys")])


def reference_check(star: Star, references: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rows whose non-null reference has no match in the referenced key: (table, column, ref table, ref column).

    Each table is read once: a row emits its references, and (reference, value)
    is counted, first inside each task, so distinct values are shuffled and not
    rows; no row meets a dimension.  These counts meet the referenced keys in one join,
    as text, so an id may be a number on one side.
    """
    every, keys = [], []
    for table in dict.fromkeys(t for t, *_ in references):
        refs = [(i, c) for i, (t, c, *_) in enumerate(references) if t == table]
        pairs = F.array(*[F.struct(F.lit(i).alias("nth"), F.col(c).cast("string").alias("value")) for i, c in refs])
        every.append(star.columns(table, *dict.fromkeys(c for _, c in refs)).select(F.inline(pairs)))
    for target in dict.fromkeys((t, c) for _, _, t, c in references):
        to = F.array(*[F.lit(i) for i, (_, _, t, c) in enumerate(references) if (t, c) == target])
        keys.append(star.columns(*target).select(F.explode(to).alias("nth"), F.col(target[1]).cast("string").alias("value")))
    found = _union(every).where(F.col("value").isNotNull()).groupBy("nth", "value").agg(F.count(F.lit(1)).alias("n"))
    known = _union(keys).where(F.col("value").isNotNull()).distinct().withColumn("known", F.lit(True))
    missing = F.col("known").isNull()
    sums = found.join(known, ["nth", "value"], "left").groupBy("nth").agg(
        F.sum("n").alias("checked"), F.sum(F.when(missing, F.col("n"))).alias("orphans"),
        F.count(F.when(missing, F.lit(1))).alias("orphan_values"))
    spec = star.spark.createDataFrame([(i, *r) for i, r in enumerate(references)],
                                      "nth int, table_name string, column_name string, ref_table string, ref_column string")
    return spec.join(sums, "nth", "left").select(
        "table_name", "column_name", "ref_table", "ref_column",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("checked", "orphans", "orphan_values")])


def reference_audit(star: Star) -> DataFrame:
    """Every declared reference (nulls allowed)."""
    status = F.when(F.col("orphans") == 0, F.lit("ok")).otherwise(F.lit("violation"))
    return reference_check(star, FOREIGN_KEYS).withColumn("status", status)


def row_counts(star: Star, expected: dict[str, int] | DataFrame | None = None,
               tables: list[str] | None = None) -> DataFrame:
    """Rows per table next to the expected count (null = not checked).

    ``expected``: counts by table, or a frame (table_name, expected) that
    is counted in the same job.
    """
    tables = tables or list(PRIMARY_KEYS)
    out = _union([star.columns(t, PRIMARY_KEYS.get(t) or star.table(t).columns[0])
                  .agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
                  .select(F.lit(t).alias("table_name"), "rows") for t in tables])
    if not isinstance(expected, DataFrame):
        expected = star.spark.createDataFrame(list((expected or {}).items()), "table_name string, expected long")
    out = out.join(expected.select("table_name", F.col("expected").cast("bigint").alias("expected")),
                   "table_name", "left")
    status = (F.when(F.col("expected").isNull(), F.lit("n/a"))
              .when(F.col("rows") == F.col("expected"), F.lit("ok"))
              .otherwise(F.lit("mismatch")))
    return out.withColumn("status", status)


def sector_agreement(star: Star) -> DataFrame:
    """Hospitals by the ``private`` flag against the private trust type."""
    by_type = F.coalesce(is_private_trust("nhs_trust_type"), F.lit(False))
    h = star.hospitals().select("hospital_id", "private", by_type.alias("private_by_type"))
    return h.groupBy("private", "private_by_type").agg(F.count(F.lit(1)).cast("bigint").alias("hospitals")).withColumn(
        "status", F.when(F.col("private").eqNullSafe(F.col("private_by_type")), F.lit("ok")).otherwise(F.lit("mismatch")))


def headline_check(star: Star, expected: float = EXPECTED_READMISSION_RATE,
                   tolerance: float = READMISSION_TOLERANCE) -> DataFrame:
    """Global readmission rate against its expected benchmark."""
    v = star.visits("readmission_30_days_flag")
    got = F.col("readmission_rate")
    return (v.agg(rate_pct("readmission_30_days_flag").alias("readmission_rate"))
            .select(F.lit("readmission_rate").alias("metric"), got,
                    F.lit(expected).alias("expected"), F.lit(tolerance).alias("tolerance"),
                    F.when(F.abs(got - F.lit(expected)) <= F.lit(tolerance), F.lit("ok"))
                    .otherwise(F.lit("off")).alias("status")))


def dimension_bounds(star: Star) -> DataFrame:
    """Rows of each broadcast dimension against its declared bound."""
    frames = [star.dim(t).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
              .select(F.lit(t).alias("table_name"), "rows", F.lit(bound).cast("bigint").alias("bound"))
              for t, bound in ROW_BOUND.items()]
    out = _union(frames)
    return out.withColumn("status", F.when(F.col("rows") <= F.col("bound"), F.lit("ok"))
                          .otherwise(F.lit("violation")))
