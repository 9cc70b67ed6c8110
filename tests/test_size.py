"""What would only fail at size: plans whose broadcasts grow with the input."""

import pytest
from gatewright.operators import resolution
from gatewright.plans import bridges, catalog, facts
from gatewright.plans.lint import COLUMNS, KINDS, derive, lint_nodes


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [lambda n: resolution.bind(facts.events(n)), lint_nodes])
def test_full_lint_broadcasts_nothing_of_the_nodes(spark, make):
    """The optimizer sees a table of keys and would broadcast all events of all files."""
    plan = _plan(make(bridges.text_nodes(spark, "/root/testdata/sf0.001", COLUMNS, KINDS)))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["diagnostics_formatted", "diagnostics_summary"])
def test_diagnostics_broadcast_nothing(spark, name):
    plan = _plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_facts_are_kept_outside_the_heap(spark):
    f = derive(bridges.text_nodes(spark, "/root/testdata/sf0.001", COLUMNS, KINDS))
    levels = [x.storageLevel for x in (f.nodes, f.bound, f.symbols)]
    f.release()
    assert all(x.useDisk and not x.useMemory for x in levels)


def test_parse_tasks_grow_in_number_and_not_in_size(spark, tmp_path):
    """Every file is parsed by a task of bounded size, and the keys are dealt out, not the texts."""
    n = 40_000
    spark.range(n).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    nodes = bridges.text_nodes(spark, str(tmp_path), ["file_idx", "kind"], frozenset({"FinalBlock"}))
    assert nodes.rdd.getNumPartitions() >= 8
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("endmodule") < plan.index("Repartition")
    small = bridges.text_files(spark, str(tmp_path), 8)
    assert small.count() == small.select("path").distinct().count() == n


#: Run in a process of its own, as a peak of memory is never forgotten: MB over the start at the peak, and afterwards.
_HOPS = """
import resource, sys
import numpy as np, pyarrow as pa
from gatewright.llm import jaccard_join as j
from gatewright.llm.exchange import bucket_blobs, listing, squeeze
rng = np.random.default_rng(1)
now = lambda: int(open("/proc/self/statm").read().split()[1]) * resource.getpagesize() >> 20
if sys.argv[1] == "count":
    n, run, blobs = 4 << 20, j._count_hop(4), []
    for part in np.split(rng.permutation(np.repeat(np.arange(n // 2, dtype=np.uint64) << np.uint64(30), 2)), 16):
        ids = np.arange(1000)
        blobs += [x for _, x in bucket_blobs(np.sort(part), rng.integers(0, 1000, len(part)), 1, listing(ids, ids), 56)]
    hop = 0
else:
    n, run, hop = 4 << 20, j._doc_hop(75), 1
    blobs = [squeeze(np.repeat(np.arange(k * 262, k * 262 + 262), 1000), np.full(262000, 1000), rng.integers(0, 1 << 56, 262000), np.full(262000, 4)) for k in range(16)]
table = pa.table({"hop": pa.array([hop] * len(blobs), pa.int32()), "b": pa.array([0] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})
del blobs
j.trim()
start = now()
out = run(table)
size = out.nbytes >> 20
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10) - start, now() - start - size, n * 8 >> 20)
"""


@pytest.mark.parametrize("hop", ["count", "doc"])
def test_a_bucket_is_held_few_times(hop):
    import subprocess
    import sys

    peak, after, column = map(int, subprocess.run([sys.executable, "-c", _HOPS, hop], capture_output=True, text=True, check=True).stdout.split())
    print(peak, after, column)
    assert peak < 10 * column and after < 2 * column
