"""Judge scoring summaries and judge-human agreement.

Quadratic-weighted kappa without a label x label product: with label
indices i (rater a) and j (rater b) over n rows,

    sum w*O = sum (i - j)^2
    sum w*E = sum i^2 + sum j^2 - 2 * (sum i) * (sum j) / n

so kappa = 1 - sum w*O / sum w*E is one aggregate over the counts of label
pairs, once each label has its index in the sorted union of both raters' labels
(weights use the index, not the value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.schemas import CALIBRATION_REQUIRED


def quadratic_kappa(df: DataFrame, a: str, b: str, group: list[str] | None = None) -> DataFrame:
    """Cohen's quadratic-weighted kappa of columns ``a`` and ``b`` (per ``group``).

    Rows are counted by (group, a, b) first; all that follows runs on those
    counts. A label's index is its place among the labels of its own group.
    Returns n, kappa; kappa is null when the expected disagreement is 0
    (e.g. both raters constant), where the reference yields NaN.
    """
    group = list(group or [])
    g = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    gs = [f"_g{i}" for i in range(len(group))]
    counts = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()) \
        .groupBy(*g, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    labels = counts.select(*gs, F.col("_a").alias("_l")).union(counts.select(*gs, F.col("_b").alias("_l"))).distinct()
    # a window over the distinct labels of a rating scale
    w = (Window.partitionBy(*gs) if gs else Window).orderBy("_l")
    index = labels.select(*gs, "_l", (F.dense_rank().over(w) - 1).cast("double").alias("_i"))
    for col, out in (("_a", "_ia"), ("_b", "_ib")):
        side = index.select(*[F.col(c).alias(f"{c}x") for c in gs], F.col("_l").alias("_lx"), F.col("_i").alias(out))
        on = F.col(col) == F.col("_lx")
        for c in gs:
            on = on & F.col(c).eqNullSafe(F.col(f"{c}x"))
        counts = counts.join(side, on).drop("_lx", *[f"{c}x" for c in gs])
    i, j, n = F.col("_ia"), F.col("_ib"), F.col("_n")
    agg = counts.groupBy(*gs).agg(
        F.sum(n).alias("n"), F.sum(n * (i - j) * (i - j)).alias("_wo"),
        F.sum(n * i * i).alias("_a2"), F.sum(n * j * j).alias("_b2"),
        F.sum(n * i).alias("_a1"), F.sum(n * j).alias("_b1"))
    we = F.col("_a2") + F.col("_b2") - 2 * F.col("_a1") * F.col("_b1") / F.col("n")
    kappa = F.when(F.abs(we) > 1e-12, 1 - F.col("_wo") / we)
    return agg.select(*[F.col(c).alias(x) for c, x in zip(gs, group, strict=True)], F.coalesce("n", F.lit(0)).alias("n"), kappa.alias("kappa"))


def agreement_accuracy(a: str, b: str) -> Column:
    """J7 (aggregate expression): share of rows where the two booleans agree."""
    return F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0))


def strength_band(kappa: Column) -> Column:
    """Fixed bands: >= 0.8 strong, 0.6-0.8 moderate, else weak."""
    return (F.when(kappa >= 0.8, F.lit("strong")).when(kappa >= 0.6, F.lit("moderate"))
             .when(kappa.isNotNull(), F.lit("weak")))


def calibration_agreement(df: DataFrame) -> DataFrame:
    """J6-J8 on aligned human/judge columns: both kappas, both accuracies, summary.

    Expects human_* columns (T11) and judge columns brand_voice_score,
    factual_policy_adherence, pii_safety_pass, language_match_pass.
    """
    kb = quadratic_kappa(df, "human_brand_voice_score", "brand_voice_score") \
        .select(F.col("n"), F.col("kappa").alias("brand_voice_kappa"))
    kp = quadratic_kappa(df, "human_policy_adherence", "factual_policy_adherence") \
        .select(F.col("kappa").alias("policy_kappa"))
    acc = df.agg(agreement_accuracy("human_pii_safety_pass", "pii_safety_pass").alias("pii_accuracy"),
                 agreement_accuracy("human_language_match_pass", "language_match_pass")
                 .alias("lang_accuracy"))
    return _one_row([kb, kp, acc]).withColumn(
        "avg_kappa", F.try_divide(F.coalesce(F.col("brand_voice_kappa"), F.lit(0.0))
                                  + F.coalesce(F.col("policy_kappa"), F.lit(0.0)),
                                  (F.col("brand_voice_kappa").isNotNull().cast("int")
                                   + F.col("policy_kappa").isNotNull().cast("int")).cast("double"))
    ).withColumn("avg_accuracy", (F.col("pii_accuracy") + F.col("lang_accuracy")) / 2) \
     .withColumn("strength", strength_band(F.col("avg_kappa")))


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """Combine one-row frames side by side without a join: union with null
    padding, then ``first(ignorenulls)`` per column (a single tiny aggregate)."""
    cols = [c for f in frames for c in f.columns]
    padded = None
    for f in frames:
        sel = [F.col(c) if c in f.columns else F.lit(None).cast(_type_of(frames, c)).alias(c)
               for c in cols]
        part = f.select(*sel)
        padded = part if padded is None else padded.unionByName(part)
    return padded.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def _type_of(frames, c):
    for f in frames:
        if c in f.columns:
            return f.schema[c].dataType
    raise KeyError(c)


def drop_failed(calibration: DataFrame, verdicts: DataFrame, key: str = "pair_id") -> DataFrame:
    """Keep pairs whose judgment succeeded; the join keeps rows aligned by key."""
    return calibration.join(verdicts.filter(F.col("verdict").isNotNull()), key, "inner")


def check_required(df: DataFrame, required=CALIBRATION_REQUIRED) -> DataFrame:
    """Schema check naming missing fields (sorted), plus a per-row null check column."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing fields: {missing}")
    nulls = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]),
                     lambda x: x.isNotNull())
    return df.withColumn("missing_fields", nulls)


def judge_summary(verdicts: DataFrame, verdict_col: str = "verdict") -> DataFrame:
    """Evaluated, failures, and — when any verdict exists — averages rounded
    half-even to 3 decimals. No verdicts -> averages null."""
    v = F.col(verdict_col)
    ok = v.isNotNull()
    return verdicts.agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(~ok).alias("failures"),
        F.bround(F.avg(v["brand_voice_score"]), 3).alias("avg_brand_voice_score"),
        F.bround(F.avg(v["factual_policy_adherence"]), 3).alias("avg_factual_policy_adherence"),
        F.bround(F.avg(v["pii_safety_pass"].cast("double")), 3).alias("pii_safety_pass_rate"),
        F.bround(F.avg(v["language_match_pass"].cast("double")), 3).alias("language_match_pass_rate"))


# Our own wording; callers pass theirs.
JUDGE_USER_TEMPLATE = "A customer wrote:\n{inquiry}\n\nWe would answer:\n{reply}\n\nHow good is this answer?"


def judge_messages(df: DataFrame, inquiry_col: str, reply_col: str, system_prompt: str,
                   user_template: str = JUDGE_USER_TEMPLATE) -> DataFrame:
    """Prompt messages for the judge; only inquiry and reply are shown, no gold."""
    user = F.lit(user_template)
    user = F.replace(user, F.lit("{inquiry}"), F.coalesce(F.col(inquiry_col), F.lit("")))
    user = F.replace(user, F.lit("{reply}"), F.coalesce(F.col(reply_col), F.lit("")))
    return df.withColumn("messages", F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content"))))
