"""Dropping documents by id without shuffling the texts of those that stay.

The ids to drop fill a Bloom filter whose size follows their number (BITS_PER_ID bits
for each, HASHES of them set), so that about one document in a hundred tests positive
wrongly at any size.  The filter is a table of blocks of BLOCK_BITS bits, broadcast up to
MOST_BITS bits (its size is known before, from the count of ids).  Documents that miss
it pass in the scan; only those inside (the ones to drop and a few others) are joined
with the ids, so the outcome is exact.  Beyond MOST_BITS the whole table takes one
left-anti join by id, whose cost is one shuffle of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_ID, HASHES = 16, 2
BLOCK_BITS = 1 << 15
#: 32 MB of filter, enough for 16 million ids.
MOST_BITS = 1 << 28


def filter_blocks(ids: DataFrame, blocks: int) -> DataFrame:
    """(block, bits array<bigint>) of the hashes of a one-column table of ids; blocks without an id are left out."""
    h = ids.select(F.xxhash64(ids.columns[0]).alias("h"))
    spots = h.select(F.expr(f"cast(pmod(h, {blocks}) as int) block"), F.explode(F.expr(f"transform(sequence(1, {HASHES}), j -> cast(pmod(xxhash64(h, j), {BLOCK_BITS}) as int))")).alias("p"))
    words = spots.selectExpr("block", "shiftright(p, 6) w", "shiftleft(1L, p & 63) b").groupBy("block", "w").agg(F.bit_or("b").alias("b"))
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))  # at most BLOCK_BITS / 64 entries
    return held.select("block", F.expr(f"transform(sequence(0, {BLOCK_BITS // 64 - 1}), i -> coalesce(m[i], 0L)) bits"))


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame | None, DataFrame]:
    """(rows whose `key` is surely not in `ids`, rows to look at), all columns each; (None, docs) if the filter would be too large."""
    n = ids.count()
    blocks = max(1, -(-n * BITS_PER_ID // BLOCK_BITS))
    if blocks * BLOCK_BITS > MOST_BITS:
        return None, docs
    table = filter_blocks(ids, blocks).select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))
    tested = docs.withColumn("__h", F.xxhash64(F.col(key).cast("bigint"))).withColumn("__block", F.expr(f"cast(pmod(__h, {blocks}) as int)"))
    tested = tested.join(F.broadcast(table), "__block", "left")
    bit = lambda j: f"(shiftright(__bits[shiftright(cast(pmod(xxhash64(__h, {j}), {BLOCK_BITS}) as int), 6)], cast(pmod(xxhash64(__h, {j}), {BLOCK_BITS}) as int) & 63) & 1L) = 1L"
    inside = f"coalesce({' AND '.join(bit(j) for j in range(1, HASHES + 1))}, false)"
    own = [F.col(f"`{c}`") for c in docs.columns]
    return tested.where(f"NOT {inside}").select(*own), tested.where(inside).select(*own)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` (all columns) whose doc_id is not among `ids` (one column); null matches null.

    `ids` is read several times: pass a written table.  Columns of `docs` may have any name but those that begin with two
    underscores here (`__h`, `__block`, `__bits`, `__dropped_id`); repeated rows stay or go together.
    """
    ids = ids.toDF("__dropped_id").select(F.col("__dropped_id").cast("bigint").alias("__dropped_id")).distinct()
    far, near = split_by_ids(docs, ids)
    kept = near.join(ids, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__dropped_id")), "left_anti")
    return kept if far is None else far.union(kept)
