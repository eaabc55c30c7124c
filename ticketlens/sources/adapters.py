"""Adapters from the driver's tables to the reference's record shapes.

``tweets_from_conversations`` turns chat turns into the tweet table (T1) that
pair building expects. Besides one tweet per turn it derives, for every
assistant turn, two extra replies so that sign-off stripping, sign-off
dropping and first-reply selection all have work to do:

* an acknowledgement ``Thanks! ^XY`` posted 5 s *before* the real reply
  (strips to 7 characters -> dropped as a sign-off, so the later real reply
  must win first-reply selection);
* the real reply with `` ^XY`` initials appended (the sign-off strip must
  remove them again);
* a follow-up ``Following up: <reply>`` posted 5 s *after* (a long reply that
  loses first-reply selection).

``XY`` = the first two hex digits of md5(reply) upper-cased, digits mapped to
G-P, so Spark and DuckDB derive the same letters. Every turn is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.schemas import TWEETS

BRAND = "support"
BASE_EPOCH = 1704067200  # 2024-01-01T00:00:00Z


def _initials(text):
    return F.translate(F.upper(F.substring(F.md5(text), 1, 2)), "0123456789", "GHIJKLMNOP")


def tweets_from_conversations(conversations: DataFrame, brand: str = BRAND) -> DataFrame:
    c = conversations.select("conv_id", "turn", "role", "text")
    tid = c.conv_id * 1000 + c.turn * 10
    is_agent = c.role == "assistant"
    base = c.select(
        tid.alias("tid"),
        F.when(is_agent, F.lit(brand)).when(c.role == "system", F.lit("system"))
         .otherwise(F.concat(F.lit("u"), c.conv_id.cast("string"))).alias("author_id"),
        (c.role == "user").alias("inbound"),
        F.when(is_agent & (c.turn > 0), c.conv_id * 1000 + (c.turn - 1) * 10)
         .cast("long").alias("in_response_to_tweet_id"),
        is_agent.alias("is_agent"),
        c.text,
    )
    variants = F.array(
        F.struct(F.lit(0).alias("v"), F.lit(0).alias("dt"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("v"), F.lit(-5).alias("dt"),
                 F.concat(F.lit("Thanks! ^"), _initials(F.col("text"))).alias("text")),
        F.struct(F.lit(2).alias("v"), F.lit(5).alias("dt"),
                 F.concat(F.lit("Following up: "), F.col("text")).alias("text")),
    )
    agent_main = F.concat(F.col("text"), F.lit(" ^"), _initials(F.col("text")))
    rows = base.select(
        "*", F.explode(F.when(F.col("is_agent"), variants)
                        .otherwise(F.array(variants[0]))).alias("x"))
    text = F.when(F.col("is_agent") & (F.col("x.v") == 0), agent_main).otherwise(F.col("x.text"))
    out = rows.select(
        (F.col("tid") + F.col("x.v")).cast("long").alias("tweet_id"),
        "author_id", "inbound",
        F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("tid") * 60 + F.col("x.dt")).alias("created_at"),
        text.alias("text"),
        "in_response_to_tweet_id",
    )
    return out.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in TWEETS.fields])


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition a scan that yields fewer partitions than the
    session has cores (a file with few, large row groups would otherwise run
    every per-row text rule in one task). On a cluster reading many files the
    scan already has more splits than cores and this adds no shuffle. Filters
    and column pruning still reach the Parquet scan below the repartition.
    """
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n)


# Tables whose rows carry long texts scanned by per-row rules (regexes,
# tokenisers): these are spread over the cores when the scan is too coarse.
TEXT_TABLES = {"documents", "pages"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df
