"""Python workers stay between stages: what Arrow allocated in a task must not stay with them."""

import os
import time

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from wardflow.llm.common import map_arrow


def test_idle_workers_return_arrow_memory(spark):
    def resident(pid):
        with open(f"/proc/{pid}/statm") as f:
            return int(f.read().split()[1]) * 4096 / (1 << 20)

    def make():
        def work(x):
            one, before = pa.array([1.0] * (1 << 15)), resident(os.getpid())
            held = [pc.add(one, float(i)) for i in range(600)]  # 150 MB
            assert resident(os.getpid()) - before > 100 and len(held) == 600
            return [pa.array([os.getpid()] * len(x), pa.int64()), pa.array([before] * len(x), pa.float64())]
        return work

    add = T.StructType([T.StructField("pid", T.LongType()), T.StructField("before", T.DoubleType())])
    row = map_arrow(spark.range(0, 1, 1, 1), {"id": "long"}, add, make).collect()[0]
    time.sleep(1)
    assert resident(row.pid) - row.before < 30


def test_idle_workers_return_small_objects_memory(spark):
    """Freed memory below one object that stays is not returned by itself."""
    def resident(pid):
        with open(f"/proc/{pid}/statm") as f:
            return int(f.read().split()[1]) * 4096 / (1 << 20)

    def make():
        def work(x):
            before = resident(os.getpid())
            held = [bytes([i % 255 + 1]) * 2000 for i in range(80_000)]  # 150 MB
            assert resident(os.getpid()) - before > 100
            os.__dict__["stays"] = held.pop()
            return [pa.array([os.getpid()] * len(x), pa.int64()), pa.array([before] * len(x), pa.float64())]
        return work

    add = T.StructType([T.StructField("pid", T.LongType()), T.StructField("before", T.DoubleType())])
    row = map_arrow(spark.range(0, 1, 1, 1), {"id": "long"}, add, make).collect()[0]
    time.sleep(1)
    assert resident(row.pid) - row.before < 30
