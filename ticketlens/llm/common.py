"""Helpers shared by the training-data operators; ``stored`` is that of ``ticketlens.session``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.session import checkpoint_dir, stored

# Word separators of every contract: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of characters that are no separator."""
    return F.array_remove(F.split(text, SPACE), "")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hold_row(df: DataFrame, clash: str) -> tuple[DataFrame, list[str]]:
    """``df`` as one struct column ``clash`` beside the operator's own columns,
    so that extra columns of any name cannot collide; and its column names."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(clash)), df.columns


def unheld(clash: str, names: list[str]) -> list[Column]:
    return [F.col(clash).getField(c).alias(c) for c in names]


def bucket_count(rows: int, per_bucket: int = 4096, least: int = 1024, most: int = 65536) -> int:
    """Number of hash or range buckets for a two-level running total: enough for
    buckets of about ``per_bucket`` rows, never more than ``most`` (which bounds
    every table with a row per bucket)."""
    return max(least, min(most, -(-rows // per_bucket)))


def rows_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of ``df`` that fulfil ``condition``, tested after the columns of
    ``df`` are computed. (A plain filter is pushed below them, with the
    expressions of all of them written out in it.) The row number is what keeps
    the optimiser from moving the filter; it is not used otherwise."""
    return (df.withColumn("__at", F.monotonically_increasing_id())
            .where(condition & (F.col("__at") >= 0)).drop("__at"))
