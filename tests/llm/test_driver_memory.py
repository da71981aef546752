"""What the driver carries: tasks and blocks of small frames, and trees that have served."""

import numpy as np
import pyspark
from pyspark.sql import functions as F

from wardflow.llm import language_id, near_dedup


def tasks_of(spark, work):
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    try:
        work()
    finally:
        sc._jsc.clearJobGroup()
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("counted") for s in told.getJobInfo(j).stageIds}
    return sum(told.getStageInfo(s).numCompletedTasks for s in stages if told.getStageInfo(s))


def test_small_links_make_few_tasks(spark):
    """Partitions follow the links, at any number of shuffle partitions."""
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false",
             "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    links = spark.createDataFrame([(i, i + 1) for i in range(1000) if i % 5], "a long, b long").repartition(64)
    found = []
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        links = near_dedup.cut(links)
        n = tasks_of(spark, lambda: found.extend(near_dedup.components(links).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.node, r.comp) for r in found} == {(i, (i - 1) // 5 * 5 + 1) for i in range(1, 1001)}
    assert n < 1000


def test_many_links_keep_many_tasks(spark, monkeypatch):
    """Frames of more rows than a task takes have several partitions, and the same components."""
    monkeypatch.setattr(near_dedup, "few", lambda rows, most, a_task=0, few=near_dedup.few: few(rows, most, 100))
    assert near_dedup.few(spark.range(0, 1000, 1, 32), 1000).rdd.getNumPartitions() == 10
    links = near_dedup.cut(spark.createDataFrame([(i, i + 1) for i in range(1000) if i % 5], "a long, b long").repartition(16))
    found = near_dedup.components(links).collect()
    assert {(r.node, r.comp) for r in found} == {(i, (i - 1) // 5 * 5 + 1) for i in range(1, 1001)}


def test_crossed_trees_go_after_use(spark, monkeypatch):
    """The driver's and the workers' copies of the trees that gave the usual code length are gone when it is known."""
    rng = np.random.default_rng(9)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    _, crossed = language_id.fit_crossed(docs)
    shared, make = [], pyspark.SparkContext.broadcast
    monkeypatch.setattr(pyspark.SparkContext, "broadcast", lambda self, value: shared.append(make(self, value)) or shared[-1])
    assert language_id.usual_length(docs, crossed) > 0
    assert len(shared) == 2 and not any(b._jbroadcast.isValid() for b in shared)
    assert language_id.usual_length(docs.where(F.lit(False)), crossed) is None


def test_long_chains_end(spark):
    """Many rounds: the planner's estimates of checkpointed joins grew to numbers that took minutes to write."""
    links = near_dedup.cut(spark.createDataFrame([(i, i + 1) for i in range(1, 50)], "a long, b long").repartition(4))
    assert {(r.node, r.comp) for r in near_dedup.components(links).collect()} == {(i, 1) for i in range(1, 51)}
