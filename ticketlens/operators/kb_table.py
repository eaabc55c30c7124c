"""A knowledge base that is kept as a table and changed in place.

Documents lie in ``buckets`` folders by a hash of their id. A batch of pairs reads and
rewrites only the folders that its ids fall in, by dynamic partition overwrite: what the others
hold is not even listed. The new content of a folder is a function of its old content and the
batch, written to the shared scratch folder first, so a run that was lost half way can be
started again with the same batch and ends in the same table.

Two writers at a time are not provided for, as with any plain Parquet folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.operators.retrieval import kb_documents
from ticketlens.schemas import KB
from ticketlens.session import stored

BUCKETS = 64
FILE_ROWS = 1 << 20
_STORED = T.StructType([*KB.fields, T.StructField("bucket", T.IntegerType())])


def bucket_of(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the table, with their bucket; none if nothing was written yet."""
    try:
        return spark.read.schema(_STORED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)


def merge_kb(spark: SparkSession, path: str, pairs: DataFrame, upsert: bool = False, buckets: int = BUCKETS,
             order_col: str | None = None) -> dict[str, int]:
    """Adds the documents of ``pairs`` (K3): ids that the table holds already keep their document, or get the new one
    with ``upsert``. Rows without an id are left out. In one batch the first row of an id counts (by ``order_col``). Returns how many were ``added`` and
    ``replaced`` by another document, and how many folders were ``rewritten``. ``buckets`` must stay the same for one table."""
    new = stored(kb_documents(pairs, order_col).where("id IS NOT NULL").withColumn("bucket", bucket_of("id", buckets)), "kb-batch")
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # ``buckets`` at most
    if not touched:
        return {"added": 0, "replaced": 0, "rewritten": 0}
    old = read_kb(spark, path).where(F.col("bucket").isin(touched))
    was, now = F.col("was"), F.col("now")
    both = old.select("bucket", "id", F.struct("document", "metadata").alias("was")).join(
        new.select("bucket", "id", F.struct("document", "metadata").alias("now")), ["bucket", "id"], "full")
    kept = F.coalesce(now, was) if upsert else F.coalesce(was, now)
    staged = stored(both.select("bucket", "id", kept.alias("kept"), was.isNull().alias("added"),
                                (was.isNotNull() & ~kept.eqNullSafe(was)).alias("replaced")), "kb-staged")
    # folders without a change need not be written again
    per = staged.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.count_if("added").alias("added"),
                                       F.count_if("replaced").alias("replaced")).collect()
    todo = [r["bucket"] for r in per if r["added"] or r["replaced"]]
    if todo:
        files = -(-max(r["rows"] for r in per) // FILE_ROWS)  # of a folder, each one task's work
        (staged.where(F.col("bucket").isin(todo)).select("id", "kept.document", "kept.metadata", "bucket")
         .repartition("bucket", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(files)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    return {"added": sum(r["added"] for r in per), "replaced": sum(r["replaced"] for r in per), "rewritten": len(todo)}


def ensure_kb_table(spark: SparkSession, path: str, pairs: DataFrame, buckets: int = BUCKETS) -> dict[str, int]:
    """K5: fills the table from ``pairs`` if it is empty, else leaves it alone."""
    if read_kb(spark, path).isEmpty():
        return merge_kb(spark, path, pairs, buckets=buckets)
    return {"added": 0, "replaced": 0, "rewritten": 0}
