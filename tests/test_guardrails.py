import time

import pytest
from pyspark.sql import functions as F

from ticketlens.functions import guardrails as G
from ticketlens.operators.guardrail_ops import pii_hits


def run(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r[0] for r in df.orderBy("id").select(fn(F.col("text"))).collect()]


def check(spark, text, **kw):
    return run(spark, [text], lambda c: G.check_escalation(c, **kw))[0]


@pytest.mark.parametrize("text,needle", [
    ("ref 111-2222222-3333333 is late", "order ID"),
    ("write to a.b+c@mail.example.org please", "email"),
    ("ring me on +44 20 7946 0958", "phone"),
    ("paid with 4111 1111 1111 1111 yesterday", "credit card"),
])
def test_pii_kinds(spark, text, needle):
    flag, reason = check(spark, text)
    assert flag and needle in reason


def test_unicode_digits_and_spaces(spark):
    # full-width digits in 3-7-7 form and a phone split by NBSP / thin space
    assert check(spark, "order １２３-４５６７８９０-１２３４５６７ please")["reason"].startswith("Contains order ID")
    assert "phone" in check(spark, "call 020 7946 0958 now")["reason"]


def test_order_id_glued_to_letters_is_phone(spark):
    flag, reason = check(spark, "注文123-4567890-1234567です")
    assert flag and "phone" in reason


def test_substring_keyword_default_and_whole_word(spark):
    assert check(spark, "an issue with my parcel") == (True, "Legal threat detected")
    assert check(spark, "an issue with my parcel", whole_word=True) == (False, "")


@pytest.mark.parametrize("kw,reason", G.SEVERE_KEYWORDS)
def test_each_keyword(spark, kw, reason):
    flag, got = check(spark, f"Honestly, {kw.upper()} is what this feels like.")
    assert flag
    # priority order: the first keyword of the lexicon contained in the text wins
    first = next(r for k, r in G.SEVERE_KEYWORDS if k in f"honestly, {kw} is what this feels like.")
    assert got == first


def test_priority_and_intents(spark):
    assert check(spark, "the police said it was fraud")["reason"] == "Law enforcement involvement detected"
    rows = run(spark, ["mail x@y.io or my lawyer calls", "this is fraud", "chargeback now", "I got hacked"],
               lambda c: F.struct(G.check_escalation(c)["reason"], G.escalation_intent(c)))
    assert rows[0][0].startswith("Contains email") and rows[0][1] == "legal_regulatory_churn"
    assert [r[1] for r in rows[1:]] == ["account_access_security"] * 3


@pytest.mark.parametrize("text", ["Where is my refund? It has been 5 days.", "When will it ship?", "", None, "  "])
def test_clean(spark, text):
    assert check(spark, text) == (False, "")


def test_pii_leak(spark):
    got = run(spark, ["order 123-4567890-1234567", "mail a@b.co", "We are happy to help", "", None,
                      "my lawyer"], G.pii_leak)
    assert got == [True, True, False, False, False, False]


def test_spans_cut_the_match_out_of_the_text(spark):
    texts = ["a@b.co", "😀 x@y.io 123-4567890-1234567, +1 555 123 4567\n😀a.b@c.d.e 4111 1111 1111 1111 end", "", None, "nothing",
             "é" * 50 + " ".join(f"u{i}@h{i}.org" for i in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    seen = set()
    for r in pii_hits(df, "id", "text").collect():
        assert texts[r.id][r.start:r.end] == r.match and r.match
        seen.add((r.id, r.kind, r.ordinal))
    assert {k for i, k, _ in seen if i == 1} == {"order_id", "email", "card", "phone"}
    assert {(5, "email", n + 1) for n in range(2000)} <= seen
    assert not {i for i, _, _ in seen} & {2, 3, 4}
    import re
    for i in (0, 1, 5):  # same matches as the pattern gives from left to right
        want = [(m.start(), m.end()) for m in re.finditer(G.EMAIL_RE, texts[i])]
        got = pii_hits(df.where(f"id = {i}"), "id", "text").where("kind = 'email'").orderBy("ordinal").collect()
        assert [(r.start, r.end) for r in got] == want


def test_many_matches_in_one_text_take_seconds(spark):
    text = " ".join(f"u{i}@h.org" for i in range(100_000))
    start = time.time()
    r = pii_hits(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").where("kind = 'email'").agg(
        F.count(F.lit(1)).alias("n"), F.max("end").alias("end")).first()
    assert (r.n, r.end) == (100_000, len(text)) and time.time() - start < 60
