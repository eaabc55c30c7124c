"""Intent buckets, gold labels and annotation cell parsing (A1, H1-H4, H7, H8, M3)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.functions.guardrails import (ACCOUNT_INTENT, LEGAL_INTENT, SEVERE_KEYWORDS,
                                             has_order_id, has_pii, severe_keyword)
from ticketlens.functions.text import col_of, contains_any, trim_u

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour for equal results).
# Keyword lists of the heuristic intent buckets, checked in this order after
# the order-id rule.
BUCKET_LEGAL = [
    "lawyer", "sue", "lawsuit", "attorney", "police", "chargeback", "consumer court", "fraud",
    "unauthorized charge", "account hacked", "data breach", "legal action", "solicitor",
]
BUCKET_TRACKING = [
    "tracking", "delay", "delayed", "late delivery", "where is my order", "not received",
    "never arrived", "lost package", "stuck in transit", "delivery date", "shipping",
    "package hasn't", "hasn't arrived", "hasnt arrived", "haven't received", "havent received",
]
BUCKET_DAMAGE = [
    "damaged", "defective", "broken", "cracked", "not working", "doesn't work", "doesnt work",
    "quality", "stains", "refurbished", "received used", "wrong item", "missing parts",
]
BUCKET_BILLING = [
    "charged twice", "double charge", "double charged", "billing", "bank statement",
    "credit card", "wrong amount", "overcharged", "over-charged", "unexpected charge",
    "extra charge", "refund", "charge on my", "deducted",
]
INTENT_BUCKETS = [
    ("legal_regulatory_churn", BUCKET_LEGAL),
    ("order_tracking_delay", BUCKET_TRACKING),
    ("damaged_defective_item", BUCKET_DAMAGE),
    ("billing_unauthorized_charge", BUCKET_BILLING),
]
PII_BUCKET = "pii_leak"
GENERAL = "general_inquiry"

# Sampling bucket -> gold intent; anything else maps to general_inquiry.
INTENT_MAP = {
    "order_tracking_delay": "order_status",
    "damaged_defective_item": "product_quality_complaint",
    "billing_unauthorized_charge": "payments_billing",
    "legal_regulatory_churn": "legal_regulatory_churn",
    "account_access_security": "account_access_security",
    "refund_related": "refund_related",
    "order_status": "order_status",
    "general_inquiry": "general_inquiry",
}
HIGH_RISK_INTENTS = [LEGAL_INTENT, ACCOUNT_INTENT]

ESCALATE = "ESCALATE"
AUTO_REPLY = "AUTO_REPLY"
REASON_PII = "PII_PRESENT"
REASON_KEYWORD = "SEVERE_KEYWORD_TRIGGER"
REASON_INTENT = "HIGH_RISK_INTENT"
REASON_COARSE = "PII_OR_SEVERE_SECURITY"
REASON_NONE = "NONE"

# Boolean words accepted in annotation cells.
BOOL_WORDS = {"true": True, "false": False, "1": True, "0": False, "yes": True, "no": False}
# ---------------------------------------------------------------------------


def classify_intent(text: Column | str, buckets=INTENT_BUCKETS, low: Column | None = None) -> Column:
    """A1: first matching bucket — order id -> pii_leak, then the keyword buckets in order."""
    t = col_of(text)
    low = low if low is not None else F.lower(t)
    expr = F.when(has_order_id(t), F.lit(PII_BUCKET))
    for name, words in buckets:
        expr = expr.when(contains_any(low, words), F.lit(name))
    return expr.otherwise(F.lit(GENERAL))


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def map_intent(bucket: Column | str, mapping: dict = INTENT_MAP) -> Column:
    """H1: bucket -> gold intent; unmapped (pii_leak, language codes, null) -> general_inquiry."""
    return F.coalesce(_map_lit(mapping)[col_of(bucket)], F.lit(GENERAL))


def gold_decision(text: Column | str, gold_intent: Column | str,
                  lexicon=SEVERE_KEYWORDS) -> Column:
    """H2: PII or severe keyword or high-risk intent -> ESCALATE, else AUTO_REPLY."""
    t = F.coalesce(col_of(text), F.lit(""))
    esc = has_pii(t) | severe_keyword(t, lexicon) | col_of(gold_intent).isin(*HIGH_RISK_INTENTS)
    return F.when(esc, F.lit(ESCALATE)).otherwise(F.lit(AUTO_REPLY))


def gold_reason(text: Column | str, gold_intent: Column | str, coarse: bool = False,
                lexicon=SEVERE_KEYWORDS) -> Column:
    """H3 (fine) / H4 (``coarse=True``) escalation reason of the gold label."""
    t = F.coalesce(col_of(text), F.lit(""))
    pii = has_pii(t)
    kw = severe_keyword(t, lexicon)
    risky = F.coalesce(col_of(gold_intent).isin(*HIGH_RISK_INTENTS), F.lit(False))
    if coarse:
        return F.when(pii | kw | risky, F.lit(REASON_COARSE)).otherwise(F.lit(REASON_NONE))
    return (F.when(pii, F.lit(REASON_PII)).when(kw, F.lit(REASON_KEYWORD))
             .when(risky, F.lit(REASON_INTENT)).otherwise(F.lit(REASON_NONE)))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, null when blank."""
    return F.nullif(trim_u(col_of(c)), F.lit(""))


def parse_list(c: Column | str) -> Column:
    """H7: comma list -> trimmed non-blank items; null/blank -> [].

    Deliberate divergence: the reference turns an empty/NA cell read by pandas
    into ["nan"]; an empty list is returned here.
    """
    items = F.transform(F.split(F.coalesce(col_of(c), F.lit("")), ","), lambda x: trim_u(x))
    return F.filter(items, lambda x: x != "")


def parse_bool(c: Column | str) -> Column:
    """H8: true/false/1/0/yes/no (any case, trimmed) -> boolean; blank or unknown -> null."""
    v = F.lower(trim_u(col_of(c).cast("string")))
    return _map_lit(BOOL_WORDS)[v]


def gold_with_fallback(gold_intent: Column | str, source_intent: Column | str,
                       gold_dec: Column | str) -> tuple[Column, Column]:
    """M3: intent -> source bucket -> general_inquiry; decision -> AUTO_REPLY (empty counts as missing)."""
    intent = F.coalesce(F.nullif(col_of(gold_intent), F.lit("")),
                        F.nullif(col_of(source_intent), F.lit("")), F.lit(GENERAL))
    decision = F.coalesce(F.nullif(col_of(gold_dec), F.lit("")), F.lit(AUTO_REPLY))
    return intent, decision


def binarise_decision(c: Column | str) -> Column:
    """M8: anything other than ESCALATE counts as AUTO_REPLY."""
    return F.when(col_of(c) == ESCALATE, F.lit(ESCALATE)).otherwise(F.lit(AUTO_REPLY))
