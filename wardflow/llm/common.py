"""Helpers shared by the training-data operators.

``map_arrow`` runs a per-batch function over selected columns and appends its
arrays, so 64-bit ids and nulls pass through unchanged.  ``cut`` writes a
frame below the session's ``spark.checkpoint.dir`` and reads it back.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: bound a Python worker's memory with long texts (a row is never split).
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


#: Applications that have this package's modules on their executors.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="wardflow-py-"), "wardflow_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on, which stay set: their frames run when the caller asks.

    The checkpoint folder is the session's; a scratch one only for a local session without any.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wardflow-llm-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Written as Parquet below the shared checkpoint folder and read back.

    Like ``cut``, but the planner then knows the files' size.  A checkpoint
    keeps the estimate of its plan, which in a chain of joins is a product that
    doubles its digits with every step.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_bucket(column: str, parts: int) -> Column:
    """crc32 of a column's text, modulo ``parts``; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def replacing(df: DataFrame, names: list[str]) -> list[str]:
    """The frame's columns that an operator's own output columns don't replace."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def give_back() -> None:
    """Memory that Arrow's pool and the C library keep after use goes back to the system (the latter with glibc only)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``run``'s batches; then its memory is given back: the Python worker stays for later stages."""
    try:
        yield from run(batches)
    finally:
        give_back()


def map_arrow(df: DataFrame, read: dict[str, str], add: T.StructType,
              make: Callable[[], Callable[..., list[pa.Array]]],
              keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` (default: all) with the arrays of a batch function.

    ``read`` names the function's inputs: {column: cast type}.  ``make`` runs
    once in each task and returns the function, which gets the input arrays
    and returns one array for each field of ``add``.  Input columns that ``add``
    also names are replaced.
    """
    names = [f.name for f in add]
    keep = replacing(df.select(*[F.col(f"`{c}`") for c in keep]) if keep is not None else df, names)
    inputs = [F.col(f"`{c}`").cast(kind).alias(f"__in{i}") for i, (c, kind) in enumerate(read.items())]
    kept = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    given = df.select(*kept, *inputs)
    fields = [T.StructField(f"__k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, *add.fields])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = batch.columns
            yield pa.RecordBatch.from_arrays(
                [*columns[:n_keep], *work(*columns[n_keep:])], names=[f.name for f in schema])

    out = given.mapInArrow(partial(releasing, run), schema)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *names)


def gather_arrow(df: DataFrame, read: dict[str, str], out: T.StructType,
                 make: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """Per-task aggregation: ``make`` gives (add, drain).

    ``add`` gets the input arrays of each batch and may return a RecordBatch
    to flush early; ``drain`` returns the last one (or None).
    """
    inputs = [F.col(f"`{c}`").cast(kind).alias(f"__in{i}") for i, (c, kind) in enumerate(read.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, drain = make()
        for batch in batches:
            flushed = add(*batch.columns)
            if flushed is not None:
                yield flushed
        last = drain()
        if last is not None:
            yield last

    return df.select(*inputs).mapInArrow(partial(releasing, run), out)
