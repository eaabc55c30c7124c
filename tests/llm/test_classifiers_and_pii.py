"""Toxicity, quality and PII: brute force, edge cases, held-out accuracy."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from ticketlens.llm import pii, quality_mil, toxicity
from ticketlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(p, y):
    r, pos = p.rank(), y == 1
    return (r[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def held_out(spark, name, label):
    d = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    return d.select("score", "predicted", F.col(label).alias("y")).toPandas()


def test_toxicity_held_out(spark):
    d = held_out(spark, "op2_toxicity", "toxic")
    assert auc(d.score, d.y) > 0.9 and d.score.between(0, 1).all()


def test_quality_held_out(spark):
    d = held_out(spark, "op6_quality_classifier", "quality")
    assert auc(d.score, d.y) > 0.98 and d.score.between(0, 1).all()


def test_grammar():
    lex = toxicity.Lexicon({"fool": 2.0}, {"blorg": 1.0})
    kinds = lambda t: [k for k, _ in toxicity.parse(t.split(), lex)]
    assert kinds("what a fool") == ["plain"]
    assert kinds("you absolute fool") == ["targeted"] == kinds("a fool like you")
    assert kinds("he is not a fool") == ["negated"]
    assert kinds("the paper wrote about some old and quite famous fool") == ["reported"]
    assert kinds("i will kill you") == ["threat"] and kinds("to kill time") == []
    assert kinds("blorgish talk") == ["plain"] and kinds("blorg") == []
    assert kinds("fool fool you") == ["targeted", "targeted"] and kinds("") == []


def test_toxicity_edge_cases(spark, docs_of, prose):
    texts = [None, "", "FOOLISH!", *[" ".join(prose(i, 40)) + (" numpty." if i % 3 == 0 else ".") for i in range(150)], "x " * 200_000]
    df = docs_of(texts)
    labels = spark.createDataFrame([(i, int(3 <= i < 153 and (i - 3) % 3 == 0)) for i in range(len(texts))] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert "numpty" in model.lexicon.words or any("numpty".startswith(b) for b in model.lexicon.beginnings)
    rows = toxicity.scored(df, model).orderBy("doc_id").collect()
    assert len(rows) == len(texts) and rows[0].score == rows[1].score
    assert all((r.score >= 0.7) == (3 <= r.doc_id < 153 and (r.doc_id - 3) % 3 == 0) for r in rows)
    none = toxicity.fit(df, labels.limit(0))
    assert all(r.score < 0.05 for r in toxicity.scored(df, none).collect())
    assert toxicity.scored(df.limit(0), model).count() == 0


def test_passages(prose):
    texts = ["", " \n", "one", " ".join(prose(1, 50)), " ".join(prose(2, 51)), "\n" + "é😀 " * 120, "###!!|| A1"]
    x, bag = quality_mil.encode(texts)
    assert np.bincount(bag).tolist() == [1, 1, 1, 1, 2, 3, 1]
    assert np.isfinite(x).all() and (x[:2] == 0).all()
    for i, t in enumerate(texts):  # alone or in a chunk, a text has the same passages
        assert np.allclose(quality_mil.encode([t])[0], x[bag == i])
    assert quality_mil.encode(["a a a b"])[0][0, 11] == 0.5


def test_quality_edge_cases(spark, docs_of, prose):
    texts = [None, "", *[" ".join(prose(i, 60)) if i % 2 else " ".join(w.upper() + "!!" for w in prose(i, 60)) for i in range(80)], "x " * 100_000]
    df = docs_of(texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(2, 82)], "doc_id long, quality int")
    model = quality_mil.fit(df, labels)
    rows = quality_mil.scored(df, model).orderBy("doc_id").collect()
    assert len(rows) == len(texts) and rows[0].score == rows[1].score
    assert all((r.score >= 0.3) == bool(r.doc_id % 2) for r in rows[2:82])
    one = quality_mil.fit(df, labels.where("quality = 1"))
    assert {round(r.score, 6) for r in quality_mil.scored(df, one).collect()} == {round(40.5 / 41, 6)}
    assert quality_mil.scored(df, quality_mil.fit(df, labels.limit(0))).count() == len(texts)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_base(text):
    def ok(kind, s):
        d = [int(c) for c in s if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
            return 14 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15
    found = [(m.start(), r, kind, m.end()) for r, (kind, p) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(kind, m.group())]
    return sorted(found)


TEXTS = [None, "", "no data", "mail a.b+c@x.example.org and d@e", "x@y.z@w.q.r_s@t.u.v", "a@b_x@c.d", "..%@a-.b", "é😀 me@home.net é 10.0.0.1",
         "1.2.3.4.5.6.7.8 256.1.1.1 001.02.003.0004 1.2.3.4444444444444", "12.34.56", "card 4111 1111 1111 1111 and 4111-1111-1111-1112",
         "4111111111111111 5500005555555559 4111 1111  1111 1111", "3 4111111111111111", "411111111111111 1+1", "+1 (226) 555-1404, +44 20 7946 0958.",
         "+1+1 226 555 1404 (226) 555-1404", "+12 3", "+1.2.3.4.5.6.7.8.9.0 x", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "1" * 30_000,
         "a" * 30_000 + "@", "1 " * 20_000, "a." * 20_000 + "@b" + ".c" * 20_000, "+" + " " * 20_000 + "1", "me [at] there.org 2001:db8:1:2:3:4:5:6"]


def test_base_spans(docs_of):
    out = pii.find(docs_of(TEXTS + TEXTS), pii.Model()).orderBy("doc_id").collect()
    assert len(out) == 2 * len(TEXTS)
    for r in pii.digest(pii.find(docs_of(TEXTS), pii.Model())).orderBy("doc_id").collect():
        want = brute_base(r.text)
        spans = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert r.spans == spans, (r.text or "")[:80]
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in want) for k, _ in BASE]
        assert r.shard.startswith("x")


def test_redaction(docs_of):
    r = {x.doc_id: x.redacted for x in pii.find(docs_of(["", "write me@home.net now", "é 1.2.3.4", None]), pii.Model()).collect()}
    assert r == {0: "", 1: "write [PII] now", 2: "é [PII]", 3: ""}
    assert pii.find(docs_of([""]).limit(0), pii.fit(docs_of([""]).limit(0))).count() == 0


def test_model_adds_spans(spark):
    rows = QUERIES["op7_pii"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and sum(r.n_added for r in rows) > 0
    assert sum("secret:" in r.spans for r in rows) > 0


def test_phone_numbers_without_plus(docs_of, prose):
    def text(i):
        a, b = " ".join(prose(i, 12)), " ".join(prose(i + 1, 8))
        n = f"{200 + i} {555 + i % 400:03d} {1000 + 7 * i}"
        return [f"{a}, call ({n[:3]}) {n[4:7]}-{n[8:]} {b}", f"{a} phone: {n} {b}", f"{a} tel {n.replace(' ', '')}, {b}",
                f"{a} order {n.replace(' ', '')} {b}", f"{a} lot {n} {b} me{i}@home.net"][i % 5]
    df = docs_of([text(i) for i in range(400)])
    for r in pii.find(df, pii.fit(df)).collect():
        wanted = r.doc_id % 5 < 3
        assert any(x.kind == "number" for x in r.spans) == wanted, r.text
        assert bool(re.search("[0-9]{4}", r.redacted)) != wanted, r.redacted


def test_rare_kinds_get_thresholds_from_all_rows(docs_of, prose):
    """Kinds that the sample does not hold are found as in a small table."""
    def text(i):
        a = " ".join(prose(i, 10))
        return f"{a} 2001:db8:1:2:3:4:5:{i:x} {a}" if i % 100 == 7 else f"{a} token = {'kx' * 15}{i:010d} {a} order {7 * i + 10 ** 11}"
    df = docs_of([text(i) for i in range(600)])
    model = pii.fit(df, sample=60)
    assert set(model.thresholds) >= {"ipv6", "secret", "mailbox"} and model.thresholds["mailbox"] == pii.FALLBACK
    for r in pii.find(df.where("doc_id % 100 in (7, 8)"), model).collect():
        assert [x.kind for x in r.spans] == ["ipv6" if r.doc_id % 100 == 7 else "secret"]


def test_added_kinds_have_no_length_limit(docs_of):
    whole = [f"key={'k9' * 100}", f"password: '{'x' * 20_000}", "0a1f" * 50, "b7" * 20_000, f"{'a.b' * 30} [at] {'there' * 30}.org"]
    long = ["a" * 60_000, "key=" * 20_000, "0a" * 30_000 + "g", "a (at" * 10_000]
    everything = pii.Model(thresholds={"secret": 0.0, "hex": 0.0, "mailbox": 0.0})  # without trees the score is 0
    out = pii.find(docs_of(whole + long), everything).orderBy("doc_id").collect()
    assert [r.redacted for r in out[:len(whole)]] == ["[PII]"] * len(whole)
    span = F.struct(F.lit("hex").alias("kind"), F.col("text"), F.lit("").alias("before"), F.lit("").alias("after"))
    labelled = docs_of(["0a" * 12, "0a" * 100]).select("doc_id", span.alias("x")).select("doc_id", pii.weak_label(F.col("x")).alias("y"))
    assert {r.doc_id: r.y for r in labelled.collect()} == {0: 0, 1: 1}
