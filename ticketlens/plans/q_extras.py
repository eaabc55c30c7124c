"""Queries for the documented-only metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.operators import extras as X
from ticketlens.plans.q_metrics import RATERS_CTE, _raters
from ticketlens.plans.registry import query
from ticketlens.sources.adapters import read_table

MAJ_SQL = """
WITH c AS (SELECT lang AS label, count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY lang),
r AS (SELECT *, row_number() OVER (ORDER BY c DESC, label) AS rk, sum(c) OVER () AS n,
             count(*) OVER () AS k FROM c)
SELECT label AS majority_label, c / n AS accuracy, (2 * (c / n) / (c / n + 1)) / k AS macro_f1,
       k AS n_labels
FROM r WHERE rk = 1"""


@query("extras_majority_baseline", MAJ_SQL, covers=["X1"])
def extras_majority_baseline(spark, sf_dir):
    return X.majority_baseline(read_table(spark, sf_dir, "documents").select("lang"), "lang")


@query("extras_pearson", RATERS_CTE + """
SELECT round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 9) AS pearson, count(*) AS n FROM r""",
       covers=["X4"])
def extras_pearson(spark, sf_dir):
    return X.pearson(_raters(spark, sf_dir), "a", "b").select(F.round("pearson", 9).alias("pearson"), "n")


def _turn_pairs(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a = c.filter((F.col("role") == "assistant") & (F.col("turn") > 0)).alias("a")
    b = c.alias("b")
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") - 1)) \
        .select((F.col("a.conv_id") * 1000 + F.col("a.turn")).alias("pair_id"),
                F.col("b.text").alias("hyp"), F.col("a.text").alias("ref"))


BLEU_CTE = r"""
WITH p AS (
  SELECT a.conv_id * 1000 + a.turn AS pair_id, b.text AS hyp, a.text AS ref
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
  WHERE a.role = 'assistant' AND a.turn > 0
),
t AS (
  SELECT pair_id,
    list_filter(regexp_split_to_array(lower(coalesce(hyp, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h,
    list_filter(regexp_split_to_array(lower(coalesce(ref, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS r
  FROM p
),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (
  SELECT pair_id, n, gram, count(*) AS ch FROM (
    SELECT pair_id, n, unnest(list_transform(range(0, greatest(len(h) - n + 1, 0)),
                                            lambda i: array_to_string(h[i + 1:i + n], ' '))) AS gram
    FROM t, ns) GROUP BY pair_id, n, gram
),
rg AS (
  SELECT pair_id, n, gram, count(*) AS cr FROM (
    SELECT pair_id, n, unnest(list_transform(range(0, greatest(len(r) - n + 1, 0)),
                                            lambda i: array_to_string(r[i + 1:i + n], ' '))) AS gram
    FROM t, ns) GROUP BY pair_id, n, gram
),
m AS (SELECT pair_id, n, sum(least(ch, cr)) AS m FROM hg JOIN rg USING (pair_id, n, gram) GROUP BY pair_id, n),
s AS (
  SELECT t.pair_id, len(t.h) AS hl, len(t.r) AS rl, ns.n, coalesce(m.m, 0) AS m,
         greatest(len(t.h) - ns.n + 1, 0) AS tot
  FROM t CROSS JOIN ns LEFT JOIN m ON m.pair_id = t.pair_id AND m.n = ns.n
)"""


def _bleu_sql(group: str, select_id: str) -> str:
    return f"""
SELECT {select_id}
  CASE WHEN min(CASE WHEN m > 0 AND tot > 0 THEN 1 ELSE 0 END) = 1 AND sum(hl) FILTER (WHERE n = 1) > 0
       THEN (CASE WHEN sum(hl) FILTER (WHERE n = 1) < sum(rl) FILTER (WHERE n = 1)
                  THEN exp(1 - CAST(sum(rl) FILTER (WHERE n = 1) AS DOUBLE) / sum(hl) FILTER (WHERE n = 1))
                  ELSE 1.0 END)
            * exp((ln(sum(m) FILTER (WHERE n = 1) / sum(tot) FILTER (WHERE n = 1))
                 + ln(sum(m) FILTER (WHERE n = 2) / sum(tot) FILTER (WHERE n = 2))
                 + ln(sum(m) FILTER (WHERE n = 3) / sum(tot) FILTER (WHERE n = 3))
                 + ln(sum(m) FILTER (WHERE n = 4) / sum(tot) FILTER (WHERE n = 4))) / 4)
       ELSE 0.0 END AS bleu
FROM s {group}"""


SENT_SQL = BLEU_CTE + """
SELECT pair_id, round(bleu, 9) AS bleu FROM (""" + _bleu_sql("GROUP BY pair_id", "pair_id,") + ")"


@query("extras_sentence_bleu", SENT_SQL, covers=["X2"])
def extras_sentence_bleu(spark, sf_dir):
    return X.sentence_bleu(_turn_pairs(spark, sf_dir), "pair_id", "hyp", "ref").select(
        "pair_id", F.round("bleu", 9).alias("bleu"))


# X3 oracle: the LCS row recurrence as a recursive CTE over hypothesis tokens.
# cur[j] = max(prev[j], max over k <= j with r[k] = h[i] of prev[k-1] + 1)
ROUGE_SQL = r"""
WITH RECURSIVE p AS (
  SELECT a.conv_id * 1000 + a.turn AS pair_id, b.text AS hyp, a.text AS ref
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
  WHERE a.role = 'assistant' AND a.turn > 0
),
t AS (
  SELECT pair_id,
    list_filter(regexp_split_to_array(lower(coalesce(hyp, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h,
    list_filter(regexp_split_to_array(lower(coalesce(ref, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS r
  FROM p
),
dp(pair_id, i, row) AS (
  SELECT pair_id, 0, list_transform(range(0, len(r) + 1), lambda x: 0) FROM t
  UNION ALL
  SELECT pair_id, i + 1,
         list_prepend(0, list_transform(range(1, len(r) + 1),
                      lambda j: greatest(row[j + 1], list_max(c[1:j]))))
  FROM (
    SELECT dp.pair_id, dp.i, dp.row, t.r,
           list_transform(range(1, len(t.r) + 1),
                          lambda k: CASE WHEN t.r[k] = t.h[dp.i + 1] THEN dp.row[k] + 1 ELSE 0 END) AS c
    FROM dp JOIN t ON dp.pair_id = t.pair_id
    WHERE dp.i < len(t.h)
  ) s
),
l AS (
  SELECT t.pair_id, CAST(dp.row[len(t.r) + 1] AS BIGINT) AS lcs, len(t.h) AS hyp_len, len(t.r) AS ref_len
  FROM t JOIN dp ON dp.pair_id = t.pair_id AND dp.i = len(t.h)
),
s AS (
  SELECT *, CASE WHEN hyp_len > 0 THEN lcs / hyp_len ELSE 0.0 END AS pr,
            CASE WHEN ref_len > 0 THEN lcs / ref_len ELSE 0.0 END AS rc FROM l
)
SELECT pair_id, lcs, round(pr, 9) AS rouge_l_p, round(rc, 9) AS rouge_l_r,
       round(CASE WHEN lcs > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 9) AS rouge_l_f
FROM s"""


@query("extras_rouge_l", ROUGE_SQL, covers=["X3"])
def extras_rouge_l(spark, sf_dir):
    return X.rouge_l(_turn_pairs(spark, sf_dir), "pair_id", "hyp", "ref").select(
        "pair_id", "lcs", F.round("rouge_l_p", 9).alias("rouge_l_p"),
        F.round("rouge_l_r", 9).alias("rouge_l_r"), F.round("rouge_l_f", 9).alias("rouge_l_f"))
