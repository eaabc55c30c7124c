"""Metrics the reference documents without code.

* X1 majority-class baseline: computed from label counts alone — predicting
  the most frequent gold label m for every row gives accuracy n_m / n,
  precision_m = n_m / n, recall_m = 1 and 0 for every other label, so the
  macro F1 is f1_m / |labels|. No row-level join or broadcast.
* X2 BLEU-4 (sentence and corpus): n-gram counts of hypothesis and
  reference are exploded per pair and joined on (pair, n, gram); clipped
  matches are min(count_h, count_r). Unsmoothed; brevity penalty
  exp(1 - r/h) when h < r.
* X3 ROUGE-L: longest common token subsequence per pair; precision = lcs /
  |hyp|, recall = lcs / |ref|, F = 2PR / (P + R) (beta = 1), 0 when nothing
  matches. Tokens are made JVM-side (same tokenizer as X2); the LCS length
  is an Arrow-batched pandas UDF running the bit-parallel LCS recurrence
  (one big-int word per token, O(|hyp| * |ref| / 64) per pair), so whole
  texts are scored with no length cap. Pairs are spread over tasks by Spark.
* X4 Pearson correlation of two numeric columns (judge vs human scores).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ticketlens.operators.retrieval import TOKEN_SPLIT_RE

MAX_N = 4


def majority_baseline(df: DataFrame, true_col: str) -> DataFrame:
    """(majority_label, accuracy, macro_f1, n_labels) of always predicting the mode."""
    counts = df.filter(F.col(true_col).isNotNull()).groupBy(F.col(true_col).alias("label")) \
        .agg(F.count(F.lit(1)).alias("c"))
    # one row per label: the global window ranks a bounded label set
    ranked = counts.withColumn("_r", F.row_number().over(Window.orderBy(F.col("c").desc(), "label"))) \
        .withColumn("_n", F.sum("c").over(Window.partitionBy())) \
        .withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy()))
    top = ranked.filter("_r = 1")
    p = F.col("c") / F.col("_n")
    f1 = 2 * p / (p + 1)
    return top.select(F.col("label").alias("majority_label"), p.alias("accuracy"),
                      (f1 / F.col("_k")).alias("macro_f1"), F.col("_k").alias("n_labels"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation and row count."""
    return df.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson"),
                  F.count(F.lit(1)).alias("n"))


def _tokens(col: str):
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), TOKEN_SPLIT_RE), "")


def _ngrams(df: DataFrame, id_col: str, tok_col: str, side: str) -> DataFrame:
    """(id, n, gram, count) for n = 1..MAX_N. The token array is zipped with
    itself shifted by 1..MAX_N-1 and exploded once (inside codegen); each
    position yields its grams of every order whose last token exists."""
    t = F.col(tok_col)
    z = F.arrays_zip(*[F.slice(t, i + 1, 1 << 30).alias(f"t{i}") for i in range(MAX_N)])
    pos = df.select(F.col(id_col).alias("_id"), F.explode(z).alias("_z"))
    parts = [F.col(f"_z.t{i}") for i in range(MAX_N)]
    grams = F.array(*[F.when(parts[n - 1].isNotNull(), F.struct(
        F.lit(n).alias("n"), F.concat_ws(" ", *parts[:n]).alias("gram"))) for n in range(1, MAX_N + 1)])
    rows = pos.select("_id", F.explode(grams).alias("_g")).filter(F.col("_g").isNotNull())
    return rows.groupBy("_id", F.col("_g.n").alias("n"), F.col("_g.gram").alias("gram")) \
        .agg(F.count(F.lit(1)).alias(f"c_{side}"))


def bleu_stats(df: DataFrame, id_col: str, hyp_col: str, ref_col: str) -> DataFrame:
    """Per pair: hypothesis/reference lengths and, for n = 1..4, clipped matches and totals."""
    base = df.select(F.col(id_col).alias("_id"), _tokens(hyp_col).alias("_h"), _tokens(ref_col).alias("_r"))
    h = _ngrams(base, "_id", "_h", "h")
    r = _ngrams(base, "_id", "_r", "r")
    match = h.join(r, ["_id", "n", "gram"]).groupBy("_id", "n").agg(
        F.sum(F.least("c_h", "c_r")).alias("m"))
    lens = base.select("_id", F.size("_h").alias("hyp_len"), F.size("_r").alias("ref_len"))
    per_n = lens.select("_id", "hyp_len", "ref_len", F.explode(F.sequence(F.lit(1), F.lit(MAX_N))).alias("n"))
    out = per_n.join(match, ["_id", "n"], "left").select(
        "_id", "hyp_len", "ref_len", "n", F.coalesce("m", F.lit(0)).cast("long").alias("matches"),
        F.greatest(F.col("hyp_len") - F.col("n") + 1, F.lit(0)).cast("long").alias("total"))
    return out.withColumnRenamed("_id", id_col)


def _bleu(matches: list, totals: list, hyp_len, ref_len):
    logs = [F.log(m.cast("double") / t.cast("double")) for m, t in zip(matches, totals)]
    ok = None
    for m, t in zip(matches, totals):
        c = (m > 0) & (t > 0)
        ok = c if ok is None else ok & c
    bp = F.when(hyp_len < ref_len, F.exp(1 - ref_len.cast("double") / hyp_len.cast("double"))).otherwise(1.0)
    return F.when(ok & (hyp_len > 0), bp * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / 4)).otherwise(0.0)


def sentence_bleu(df: DataFrame, id_col: str, hyp_col: str, ref_col: str) -> DataFrame:
    """(id, bleu) per pair."""
    s = bleu_stats(df, id_col, hyp_col, ref_col)
    p = s.groupBy(id_col, "hyp_len", "ref_len").pivot("n", list(range(1, MAX_N + 1))).agg(
        F.first("matches").alias("m"), F.first("total").alias("t"))
    ms = [F.col(f"{n}_m") for n in range(1, MAX_N + 1)]
    ts = [F.col(f"{n}_t") for n in range(1, MAX_N + 1)]
    return p.select(id_col, _bleu(ms, ts, F.col("hyp_len"), F.col("ref_len")).alias("bleu"))


def corpus_bleu(df: DataFrame, id_col: str, hyp_col: str, ref_col: str) -> DataFrame:
    """Corpus BLEU-4 (sums of clipped matches and totals over all pairs)."""
    s = bleu_stats(df, id_col, hyp_col, ref_col)
    agg = s.agg(*[F.sum(F.when(F.col("n") == n, F.col("matches"))).alias(f"m{n}") for n in range(1, MAX_N + 1)],
                *[F.sum(F.when(F.col("n") == n, F.col("total"))).alias(f"t{n}") for n in range(1, MAX_N + 1)],
                F.sum(F.when(F.col("n") == 1, F.col("hyp_len"))).alias("hyp_len"),
                F.sum(F.when(F.col("n") == 1, F.col("ref_len"))).alias("ref_len"))
    ms = [F.col(f"m{n}") for n in range(1, MAX_N + 1)]
    ts = [F.col(f"t{n}") for n in range(1, MAX_N + 1)]
    return agg.select(_bleu(ms, ts, F.col("hyp_len"), F.col("ref_len")).alias("bleu"),
                      "hyp_len", "ref_len")


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two token sequences.

    Bit-parallel form of the LCS recurrence: bit j of ``v`` is 0 where the
    DP row steps up at reference position j, so LCS = |b| - popcount(v).
    """
    if len(a) == 0 or len(b) == 0:
        return 0
    pos: dict = {}
    for j, tok in enumerate(b):
        pos[tok] = pos.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        m = pos.get(tok)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


@pandas_udf(LongType())
def _lcs_udf(h: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(a if a is not None else (), b if b is not None else ())
                      for a, b in zip(h, r)], dtype="int64")


def rouge_l(df: DataFrame, id_col: str, hyp_col: str, ref_col: str) -> DataFrame:
    """(id, lcs, hyp_len, ref_len, rouge_l_p, rouge_l_r, rouge_l_f) per pair."""
    base = df.select(F.col(id_col), _tokens(hyp_col).alias("_h"), _tokens(ref_col).alias("_r"))
    s = base.select(id_col, _lcs_udf("_h", "_r").alias("lcs"), F.size("_h").alias("hyp_len"),
                    F.size("_r").alias("ref_len"))
    p = F.when(F.col("hyp_len") > 0, F.col("lcs") / F.col("hyp_len")).otherwise(0.0)
    r = F.when(F.col("ref_len") > 0, F.col("lcs") / F.col("ref_len")).otherwise(0.0)
    return s.select(id_col, "lcs", "hyp_len", "ref_len", p.alias("rouge_l_p"), r.alias("rouge_l_r"),
                    F.when(F.col("lcs") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("rouge_l_f"))


def corpus_rouge_l(df: DataFrame, id_col: str, hyp_col: str, ref_col: str) -> DataFrame:
    """Mean precision, recall and F over all pairs."""
    return rouge_l(df, id_col, hyp_col, ref_col).agg(
        F.avg("rouge_l_p").alias("rouge_l_p"), F.avg("rouge_l_r").alias("rouge_l_r"),
        F.avg("rouge_l_f").alias("rouge_l_f"), F.count(F.lit(1)).alias("pairs"))
