"""Bounded samples of rows for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A sample is looked for among the ids below a hash limit that this many times its size should pass.
SPARE = 4


def bounded_sample(docs: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most `most` rows of (doc_id, *columns): the documents with the smallest id hashes, one row for each id.

    Of rows that share doc_id the smallest (by `columns`) stands for all, so the bound is one of rows.  Only ids below a
    limit on their hash are made distinct and sorted; should too few pass, as ids repeat, all ids are.  The ids picked
    (at most `most` longs, so a proven bound) are broadcast to fetch the rows.  The same rows give the same sample.
    """
    ids = docs.select("doc_id").where("doc_id is not null")
    n = ids.count()
    picked = None
    if n > 2 * SPARE * most:
        few = ids.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < (SPARE * most << 53) // n).distinct()
        if few.count() >= most:
            picked = few
    picked = (ids.distinct() if picked is None else picked).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", *columns).join(F.broadcast(picked), "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("_row")).select("doc_id", *[F.col(f"_row.`{c}`").alias(c) for c in columns])


def sample_per_value(docs: DataFrame, value: str, most: int, *columns: str) -> tuple[DataFrame, dict]:
    """(rows of `columns` and `value`, documents per value): all documents of a value, or about `most` by id hash where it has more.

    Documents are counted per value first, with partial sums, so no value gathers in one task; the counts become
    limits on the id hash.  Of rows that share doc_id and value the smallest stands for all.  The same rows give the same
    sample on every run.
    """
    docs = docs.where(f"doc_id is not null and `{value}` is not null")
    seen = {r[0]: r[1] for r in docs.select(value, "doc_id").distinct().groupBy(value).count().collect()}
    cuts = [(x, min(1 << 53, -(-(most << 53) // n))) for x, n in seen.items()]
    limits = docs.sparkSession.createDataFrame(cuts, T.StructType([T.StructField(value, docs.schema[value].dataType), T.StructField("_cut", T.LongType())]))
    few = docs.select("doc_id", value, *columns).join(F.broadcast(limits), value).where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < F.col("_cut"))
    rows = few.groupBy("doc_id", value).agg(F.min(F.struct(*columns)).alias("_row"))
    return rows.select("doc_id", value, *[F.col(f"_row.`{c}`").alias(c) for c in columns]), seen
