"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a groupBy-min and an equi-join, so no component is gathered anywhere;
the number of rounds grows with the logarithm of the longest chain.  A graph of at most FILE_ROWS
edges takes the same steps in one partition, hence without a shuffle: a step is one task instead of some for
every shuffle partition, all of which the driver would keep account of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import FILE_ROWS, discard, written


def _narrow(df: DataFrame, rows: int) -> DataFrame:
    """`df` in one partition if it has few rows: what is grouped or merged there needs no exchange."""
    return df.coalesce(1) if rows <= FILE_ROWS else df


def _join(left: DataFrame, right: DataFrame, on: str, rows: int, how: str = "inner") -> DataFrame:
    return _narrow(left, rows).join(_narrow(right, rows).hint("merge") if rows <= FILE_ROWS else right, on, how)


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    both = _narrow(e.union(e.select("b", "a")).toDF("u", "v"), rows)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _join(both, low, "u", rows).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    down = _narrow(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), rows)
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _join(down, low, "u", rows).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return _narrow(moved.union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))), rows)


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) of every node of `edges` (a, b), as a written table; the component is its smallest node.

    `rows` is the number of edges or a bound of it, where it is known.
    """
    n = edges.count() if rows is None else rows
    # written first: a step reads its edges several times, and its plan must not hold theirs as often
    e, seen = written(_narrow(edges.select("a", "b").where("a <> b"), n).distinct(), n), None
    while True:
        last, e = e, written(_small_star(_large_star(e, n), n).where("a <> b").distinct(), n)
        # stars are stable: the order-free digest of the edges repeats
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    out = written(_narrow(nodes.union(_narrow(e.select(F.col("a"), F.col("a")), n).distinct()), n), n)
    discard(e)
    return out


def merged(found: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """The components of the graph of `found`, as `components` returns it, with `rows` more `edges` (a, b); a written table.

    Only the edges between components of `found` are looked at again, each component as its smallest node.
    """
    n = found.count() + 2 * rows
    of = [found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in "ab"]
    ends = _join(_join(edges.select("a", "b"), of[0], "a", n, "left"), of[1], "b", n, "left")
    moved = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")), rows)
    old = _join(found, moved.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", n, "left").select("node", F.coalesce("_to", "component").alias("component"))
    new = _join(moved, found.select("node"), "node", n, "left_anti").select("node", "component")
    out = written(_narrow(old.union(new), n), n)
    discard(moved)
    return out
