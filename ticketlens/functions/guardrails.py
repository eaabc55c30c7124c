"""Guardrails: personal-data patterns and severe-keyword rules as Column expressions.

Every function is a pure Column -> Column expression, so the whole rule scan
runs inside whole-stage codegen next to the Parquet scan, per row, with no
shuffle. ``check_escalation`` returns one struct so that callers materialise
the rule result once and reuse it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.functions.text import WS, col_of, contains_any

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour for equal results).
# Patterns: order id = 3-7-7 digit groups joined by '-', word-bounded;
# email = local part, '@', domain label, '.', rest; card = 13-16 digits with
# optional single space/hyphen separators, word-bounded; phone = optional '+',
# digit, 7+ of digit/whitespace/hyphen, digit. Java syntax with (?U).
ORDER_ID_RE = r"(?U)\b\d{3}-\d{7}-\d{7}\b"
EMAIL_RE = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
CARD_RE = r"(?U)\b(?:\d[ -]?){12,15}\d\b"
PHONE_RE = rf"(?U)\+?\d(?:\d|{WS}|-){{7,}}\d"

# PII kinds in check order, with the reason reported for each.
PII_RULES = [
    ("order_id", ORDER_ID_RE, "Contains order ID (PII protection rule)"),
    ("email", EMAIL_RE, "Contains email address (PII protection rule)"),
    ("card", CARD_RE, "Contains credit card number (PII protection rule)"),
    ("phone", PHONE_RE, "Contains phone number (PII protection rule)"),
]

# Severe keywords and their reasons, in priority order (first hit wins).
SEVERE_KEYWORDS = [
    ("lawyer", "Legal threat detected"),
    ("sue", "Legal threat detected"),
    ("lawsuit", "Legal threat detected"),
    ("attorney", "Legal threat detected"),
    ("police", "Law enforcement involvement detected"),
    ("chargeback", "Chargeback threat detected"),
    ("consumer court", "Legal threat detected"),
    ("fraud", "Fraud allegation detected"),
    ("unauthorized charge", "Unauthorized charge reported"),
    ("account hacked", "Account compromise reported"),
    ("hacked", "Account compromise reported"),
    ("data breach", "Security incident reported"),
    ("legal action", "Legal threat detected"),
    ("solicitor", "Legal threat detected"),
]

# Keywords that make an escalation a legal one.
LEGAL_KEYWORDS = [
    "lawyer", "sue", "lawsuit", "attorney", "police", "legal action", "solicitor", "consumer court",
]

LEGAL_INTENT = "legal_regulatory_churn"
ACCOUNT_INTENT = "account_access_security"
# ---------------------------------------------------------------------------


def has_order_id(c: Column | str) -> Column:
    """G1."""
    return col_of(c).rlike(ORDER_ID_RE)


def has_email(c: Column | str) -> Column:
    """G2. The regex only runs on texts containing '@' (same result, far fewer scans)."""
    c = col_of(c)
    return F.when(F.instr(c, "@") > 0, c.rlike(EMAIL_RE)).when(c.isNotNull(), F.lit(False))


def has_card(c: Column | str) -> Column:
    """G3."""
    return col_of(c).rlike(CARD_RE)


def has_phone(c: Column | str) -> Column:
    """G4 — also fires on most order ids, card numbers and long digit runs."""
    return col_of(c).rlike(PHONE_RE)


def pii_test(kind: str, pattern: str, c: Column) -> Column:
    """Boolean test of one PII rule (email uses the '@' pre-check)."""
    return has_email(c) if kind == "email" and pattern == EMAIL_RE else c.rlike(pattern)


def has_pii(c: Column | str) -> Column:
    """Any of the four PII patterns (null text -> false)."""
    c = col_of(c)
    return F.coalesce(has_order_id(c) | has_email(c) | has_card(c) | has_phone(c), F.lit(False))


def pii_reason(c: Column | str, rules=PII_RULES, flags: dict | None = None) -> Column:
    """Reason of the first PII kind that matches, in rule order; null when none.

    ``flags`` may map kind -> an already computed boolean column.
    """
    c = col_of(c)
    expr = None
    for kind, pattern, reason in rules:
        hit = flags[kind] if flags is not None else pii_test(kind, pattern, c)
        expr = F.when(hit, F.lit(reason)) if expr is None else expr.when(hit, F.lit(reason))
    return expr


def pii_kind(c: Column | str, rules=PII_RULES) -> Column:
    """Like ``pii_reason`` but returns the kind name (order_id/email/card/phone)."""
    c = col_of(c)
    expr = None
    for kind, pattern, _ in rules:
        hit = pii_test(kind, pattern, c)
        expr = F.when(hit, F.lit(kind)) if expr is None else expr.when(hit, F.lit(kind))
    return expr


def _low(c, low):
    return low if low is not None else F.lower(col_of(c))


def _has(low: Column, kw: str, whole_word: bool, hits: dict | None) -> Column:
    """One keyword test; ``hits`` maps keyword -> an already computed boolean."""
    if hits is not None and kw in hits:
        return hits[kw]
    return contains_any(low, [kw], whole_word)


def keyword_hits(low: Column, words: list[str], whole_word: bool = False) -> Column:
    """array<boolean>: for each keyword in order, whether the lower-cased text contains it.

    Materialise it once per row (``operators.guardrail_ops.with_guardrails``);
    every keyword rule then reads elements instead of rescanning the text.
    """
    return F.array(*[contains_any(low, [w], whole_word) for w in words])


def severe_keyword(c: Column | str, lexicon=SEVERE_KEYWORDS, whole_word: bool = False,
                   low: Column | None = None, hits: dict | None = None) -> Column:
    """True when the lower-cased text contains a severe keyword.

    Substring semantics by default ('sue' fires inside 'issue'); pass
    ``whole_word=True`` for word-bounded matching. ``low`` may carry an
    already lower-cased column and ``hits`` precomputed keyword tests (see
    ``operators.guardrail_ops.with_guardrails``).
    """
    if hits is not None and all(k in hits for k, _ in lexicon):
        cond = None
        for k, _ in lexicon:
            cond = hits[k] if cond is None else (cond | hits[k])
        return F.coalesce(cond, F.lit(False)) if cond is not None else F.lit(False)
    return F.coalesce(contains_any(_low(c, low), [k for k, _ in lexicon], whole_word),
                      F.lit(False))


def keyword_reason(c: Column | str, lexicon=SEVERE_KEYWORDS, whole_word: bool = False,
                   low: Column | None = None, hits: dict | None = None) -> Column:
    """Reason of the first keyword in lexicon order that the text contains; null if none."""
    low = _low(c, low)
    expr = None
    for kw, reason in lexicon:
        cond = _has(low, kw, whole_word, hits)
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))
    return expr


def matched_keyword(c: Column | str, lexicon=SEVERE_KEYWORDS, whole_word: bool = False,
                    low: Column | None = None, hits: dict | None = None) -> Column:
    """The first keyword (lexicon order) the text contains; null if none."""
    low = _low(c, low)
    expr = None
    for kw, _ in lexicon:
        cond = _has(low, kw, whole_word, hits)
        expr = F.when(cond, F.lit(kw)) if expr is None else expr.when(cond, F.lit(kw))
    return expr


def check_escalation(c: Column | str, lexicon=SEVERE_KEYWORDS, whole_word: bool = False,
                     low: Column | None = None, flags: dict | None = None,
                     hits: dict | None = None) -> Column:
    """struct<flag boolean, reason string>.

    Null or empty text -> (false, ""); otherwise the first PII reason, then the
    first keyword reason, else (false, ""). Whitespace-only text is scanned
    like any other text (it matches nothing).
    """
    c = col_of(c)
    reason = F.when(c.isNull() | (c == ""), F.lit(None)).otherwise(
        F.coalesce(pii_reason(c, flags=flags), keyword_reason(c, lexicon, whole_word, low, hits)))
    return F.struct(reason.isNotNull().alias("flag"),
                    F.coalesce(reason, F.lit("")).alias("reason"))


def is_legal(c: Column | str, keywords=LEGAL_KEYWORDS, low: Column | None = None,
             hits: dict | None = None) -> Column:
    """Legal trigger, independent of which rule flagged the text."""
    if hits is not None and all(k in hits for k in keywords):
        cond = None
        for k in keywords:
            cond = hits[k] if cond is None else (cond | hits[k])
        return F.coalesce(cond, F.lit(False)) if cond is not None else F.lit(False)
    return F.coalesce(contains_any(_low(c, low), list(keywords)), F.lit(False))


def escalation_intent(c: Column | str, keywords=LEGAL_KEYWORDS, low: Column | None = None,
                      hits: dict | None = None) -> Column:
    """Legal keyword -> legal intent, otherwise account/security."""
    return F.when(is_legal(c, keywords, low, hits), F.lit(LEGAL_INTENT)).otherwise(F.lit(ACCOUNT_INTENT))


def pii_leak(c: Column | str, flags: dict | None = None) -> Column:
    """Reply leaks PII (any of the four patterns; keywords ignored; empty -> false)."""
    c = col_of(c)
    anyhit = (F.coalesce(flags["order_id"] | flags["email"] | flags["card"] | flags["phone"],
                         F.lit(False)) if flags is not None else has_pii(c))
    return F.when(c.isNull() | (c == ""), F.lit(False)).otherwise(anyhit)
