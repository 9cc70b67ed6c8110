"""Training-corpus pipeline: five stages over `documents`, each one of the corpus operators.

Every stage gets the documents that its predecessor kept and returns a DataFrame; all but
the last return the columns of `documents`.  The last returns the sampled documents with
their mixing columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewright.llm import decontaminate, jaccard_join, language_id, mixing, pii
from gatewright.llm.queries import small_batches, table
from gatewright.llm.storage import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go."""
    small_batches(spark)
    return language_id.keep_known(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    small_batches(spark)
    return jaccard_join.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind, and n_chars follows."""
    small_batches(spark)
    out = pii.redact(docs, pii.train(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.selectExpr(*[f"cast(length(text) as {kind.simpleString()}) n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares follow the production targets."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: Learned and iterative stages have no SQL equivalent; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
