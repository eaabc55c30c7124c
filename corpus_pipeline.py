"""Training-corpus pipeline: quality rules, SimHash near-dedup, benchmark
decontamination, mixing to target weights, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; ``run`` writes every stage's rows to the shared folder and
reads them back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import decontaminate, mixing, quality_rules, sharding, simhash
from ticketlens.llm.common import documents, rows_where, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with their failing lines removed
    and ``n_chars`` set to the new length."""
    kept = rows_where(quality_rules.clean(docs), F.col("kept"))
    out = kept.select(*[F.col("clean_text").alias("text") if c == "text"
                        else F.when(F.col("n_removed") > 0, F.length("clean_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias(c)
                        if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    flagged = decontaminate.contaminated(docs, documents(spark, sf_dir, "benchmark"))
    return rows_where(flagged, ~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with shard and slot."""
    return sharding.shard(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination),
          ("mixing", mixture), ("sharding", shards)]

# Fingerprints, components and the permutation have no SQL counterpart; the
# pipeline is tested against a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
