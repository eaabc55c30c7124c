"""Golden sets and gold labels (A1/A2/A10 composition, H1-H6, M3, M15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import labels as Lb
from ticketlens.operators.sampling import SEED, number_entries, quota_sample

# Golden-set quotas (English by intent bucket, others by language), in order.
ENGLISH_QUOTAS = {
    "order_tracking_delay": 30,
    "damaged_defective_item": 30,
    "billing_unauthorized_charge": 30,
    "legal_regulatory_churn": 15,
    "pii_leak": 15,
}
NON_ENGLISH_QUOTAS = {"ja": 20, "es": 15, "fr": 15, "pt": 15, "hi": 15}


def build_golden_set(pairs: DataFrame, text_col: str, lang_col: str, id_col: str,
                     english_quotas: dict = ENGLISH_QUOTAS,
                     other_quotas: dict = NON_ENGLISH_QUOTAS, seed: int = SEED) -> DataFrame:
    """A1 + A2 + A10: stratified golden rows (T6), numbered in stratum order.

    English rows are bucketed by the heuristic intent classifier; every other
    listed language is one stratum. Labels are left null for annotators.
    """
    pairs = pairs.withColumn("_low", F.lower(F.col(text_col)))  # one lower-casing per row
    bucket = Lb.classify_intent(F.col(text_col), low=F.col("_low"))
    lang = F.col(lang_col)
    stratum = F.when(lang == "en", F.concat(F.lit("en:"), bucket)).otherwise(lang)
    source = F.when(lang == "en", bucket).otherwise(lang)
    quotas = {f"en:{k}": v for k, v in english_quotas.items()}
    quotas.update(other_quotas)
    order = {k: i for i, k in enumerate(quotas)}
    order_map = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    src = pairs.select(F.col(id_col), F.col(text_col).alias("input_tweet"),
                       lang.alias("expected_language"), stratum.alias("_stratum"),
                       source.alias("source_intent"))
    s = quota_sample(src, "_stratum", quotas, id_col, seed)
    s = number_entries(s, [order_map[F.col("_stratum")], F.col("sample_rank")])
    return s.select(F.col("test_id").cast("long"), F.col(id_col), "input_tweet", "expected_language",
                    F.lit(None).cast("string").alias("gold_intent"),
                    F.lit(None).cast("string").alias("gold_decision"),
                    F.lit(None).cast("string").alias("gold_reason"),
                    F.lit(None).cast("string").alias("required_routing"),
                    F.array().cast("array<string>").alias("forbidden_elements"),
                    "source_intent")


def derive_gold_labels(golden: DataFrame, coarse: bool = False,
                       text_col: str = "input_tweet", source_col: str = "source_intent") -> DataFrame:
    """H1-H4: gold intent from the bucket, decision and reason from the rules."""
    intent = Lb.map_intent(F.col(source_col))
    return golden.withColumn("gold_intent", intent) \
        .withColumn("gold_decision", Lb.gold_decision(F.col(text_col), F.col("gold_intent"))) \
        .withColumn("gold_reason", Lb.gold_reason(F.col(text_col), F.col("gold_intent"), coarse))


def label_counts(gold: DataFrame, col: str = "gold_decision") -> DataFrame:
    """H5: rows per label value."""
    return gold.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def normalise_annotations(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """H6 + H7: annotation CSV rows -> T7 (trimmed, blank -> null, decision upper-case, lists)."""
    return df.select(*keep,
        F.col("test_id").cast("long").alias("test_id"),
        F.col("input_tweet").cast("string").alias("input_tweet"),
        F.col("expected_language").cast("string").alias("expected_language"),
        Lb.blank_to_null("gold_intent").alias("gold_intent"),
        F.upper(Lb.blank_to_null("gold_decision")).alias("gold_decision"),
        Lb.blank_to_null("gold_reason").alias("gold_reason"),
        Lb.parse_list("required_routing").alias("required_routing"),
        Lb.parse_list("forbidden_elements").alias("forbidden_elements"))


def gold_availability(rows: DataFrame) -> DataFrame:
    """Rows with a (non-null) gold intent / decision."""
    return rows.agg(F.count("gold_intent").alias("intent"), F.count("gold_decision").alias("decision"))
