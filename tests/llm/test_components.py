"""Components by rounds, and the work that the driver has with them."""

import random

import pytest
from gatewright.llm import components
from gatewright.llm.storage import written


def _union_find(edges) -> dict:
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_components_grow_by_rounds(spark, monkeypatch, few):
    """Components of edges that come in rounds, in one partition and by shuffles, against a loop."""
    monkeypatch.setattr(components, "FILE_ROWS", few)
    rng, seen, found = random.Random(few), [], None
    chain = [(i, i + 1) for i in range(900, 940)]
    rng.shuffle(chain)
    for turn in range(3):
        fresh = [(rng.randrange(120), rng.randrange(120)) for _ in range(25)] + chain[turn::3]
        fresh += [fresh[0], (500 + turn, 500 + turn)]  # a repeated link, and a loop, which makes no node
        table = written(spark.createDataFrame(fresh, "a bigint, b bigint"))
        found = components.components(table) if found is None else components.merged(found, table, len(fresh))
        seen += [x for x in fresh if x[0] != x[1]]
        rows = found.collect()
        assert len(rows) == len({r.node for r in rows})
        assert {r.node: r.component for r in rows} == _union_find(seen)
    nothing = components.merged(found, table.limit(0), 0)
    assert sorted(nothing.collect()) == sorted(found.collect())


def test_small_components_are_few_tasks(spark):
    """The tasks of a small graph do not follow the shuffle partitions, whatever adaptive execution merges."""
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    edges = written(spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        tracker, tasks = spark.sparkContext.statusTracker(), 0
        spark.sparkContext.setJobGroup("components", "")
        found = components.components(edges)
        for job in tracker.getJobIdsForGroup("components"):
            for stage in tracker.getJobInfo(job).stageIds:
                tasks += getattr(tracker.getStageInfo(stage), "numTasks", 0)
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found.where("component = 0").count() == 101
    assert tasks < 100  # a step by shuffles alone has over 100
