"""The knowledge base as a table that batches are merged into."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ticketlens.operators.kb_table import ensure_kb_table, merge_kb, read_kb
from ticketlens.plans.q_retrieval import _pairs, _pairs_sql
from ticketlens.plans.registry import query
from ticketlens.session import checkpoint_dir, stored

STEPS_SQL = _pairs_sql() + """,
n AS (SELECT count(DISTINCT tweet_id) FILTER (WHERE tweet_id % 3 <> 0) AS first, count(DISTINCT tweet_id) AS total,
             count(DISTINCT tweet_id) FILTER (WHERE tweet_id % 20 = 0) AS changed FROM pairs)
SELECT step, CAST(added AS BIGINT) AS added, CAST(replaced AS BIGINT) AS replaced FROM (
  SELECT 1 AS step, first AS added, 0 AS replaced FROM n UNION ALL SELECT 2, 0, 0
  UNION ALL SELECT 3, total - first, 0 FROM n UNION ALL SELECT 4, 0, 0
  UNION ALL SELECT 5, 0, changed FROM n UNION ALL SELECT 6, 0, 0)"""

ROWS_SQL = _pairs_sql() + """
SELECT CAST(tweet_id AS VARCHAR) AS id, CASE WHEN tweet_id % 20 = 0 THEN 'changed: ' WHEN tweet_id % 3 = 0 THEN 'late: ' ELSE '' END
       || customer_text AS document, agent_text FROM pairs"""


def _merged(spark, sf_dir):
    """Fills a table with two thirds of the pairs, then adds all (texts of known ids altered, which must not count), then
    replaces some; every batch is merged twice, as a job that was started again would."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/kb-{uuid.uuid4().hex}"
    pairs = stored(_pairs(spark, sf_dir), "kb-pairs")
    some = pairs.where("tweet_id % 3 <> 0")
    late = pairs.withColumn("customer_text", F.concat(F.lit("late: "), "customer_text"))
    changed = pairs.where("tweet_id % 20 = 0").withColumn("customer_text", F.concat(F.lit("changed: "), "customer_text"))
    steps = [ensure_kb_table(spark, path, some), ensure_kb_table(spark, path, pairs), merge_kb(spark, path, late),
             merge_kb(spark, path, late), merge_kb(spark, path, changed, upsert=True), merge_kb(spark, path, changed, upsert=True)]
    return path, steps


@query("kb_table_steps", STEPS_SQL, covers=["K2", "K3", "K4", "K5"])
def kb_table_steps(spark, sf_dir):
    _, steps = _merged(spark, sf_dir)
    return spark.createDataFrame([(i + 1, s["added"], s["replaced"]) for i, s in enumerate(steps)], "step int, added long, replaced long")


@query("kb_table_rows", ROWS_SQL, covers=["K3", "S4", "S5"])
def kb_table_rows(spark, sf_dir):
    path, _ = _merged(spark, sf_dir)
    return read_kb(spark, path).select("id", "document", "metadata.agent_text")
