"""Pruned lexical top-k, hashed text vectors and the fused ranking against brute force."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticketlens.operators.features import hashed_vectors
from ticketlens.operators.fusion import fused_topk
from ticketlens.operators.lexical import build_index, lexical_topk
from ticketlens.operators.pivots import build_cells

TEXTS = "id long, text string, token string"


def corpus(seed, n, words=60):
    """A few words are in almost every text; texts repeat, are empty or null."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) ** 1.3 for i in range(words)]
    texts = [None, "", " .. ", *[" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 25))) for _ in range(n * 2 // 3)]]
    return [(i, rng.choice(texts)) for i in range(n)]


def words_of(text):
    return (text or "").lower().replace(".", " ").split()


def idf_of(kb):
    df = Counter(t for _, x in kb for t in set(words_of(x)))
    return {t: math.log((len(kb) + 1) / (c + 1)) + 1 for t, c in df.items()}


def shares(q, kb, idf):
    have = set(words_of(q)) & set(idf)
    return {i: round(sum(idf[t] for t in have & set(words_of(x))), 9) for i, x in kb}, sum(idf[t] for t in have)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine") for r in rows], TEXTS)


@pytest.mark.parametrize("seed,k,seeds", [(1, 3, 256), (2, 5, 8), (3, 1, 1), (4, 400, 4)])
def test_pruned_lexical(spark, monkeypatch, seed, k, seeds):
    from ticketlens.operators import lexical
    monkeypatch.setattr(lexical, "SEED_POSTINGS", seeds)
    kb, queries = corpus(seed, 250), corpus(seed + 50, 40) + [(999, "nowhere"), (1000, "w0 w1 w2"), (1001, "w55")]
    idf = idf_of(kb)
    hits, work = lexical_topk(frame(spark, queries), build_index(frame(spark, kb), "id", "text"), k, "id", "text")
    want = set()
    for qid, text in queries:
        s, _ = shares(text, kb, idf)
        best = sorted((-v, i) for i, v in s.items() if v > 0)[:k]
        want |= {(qid, r + 1, i) for r, (_, i) in enumerate(best)}
    got = hits.collect()
    assert {(r.qid, r["rank"], r.kid) for r in got} == want
    assert all(r.score == pytest.approx(shares(dict(queries)[r.qid], kb, idf)[0][r.kid], abs=1e-8) for r in got)
    assert work.where("expanded > postings").count() == 0


def test_few_postings_are_read(spark):
    """Queries of rare words and words of every document: the postings of the latter stay unread."""
    kb = [(i, f"the a of only{i} pair{i // 2} and") for i in range(600)]
    queries = [(i, f"the a of and only{i} pair{i // 2}") for i in range(0, 600, 20)]
    hits, work = lexical_topk(frame(spark, queries), build_index(frame(spark, kb), "id", "text"), 2, "id", "text")
    assert {(r.qid, r.kid) for r in hits.where("rank = 1").collect()} == {(i, i) for i, _ in queries}
    n = work.agg(F.sum("expanded").alias("e"), F.sum("postings").alias("p")).first()
    assert n.e < 0.01 * n.p


def test_no_documents_or_queries(spark):
    none, some = frame(spark, []), frame(spark, corpus(1, 5))
    assert lexical_topk(some, build_index(none, "id", "text"), 3, "id", "text")[0].count() == 0
    assert lexical_topk(none, build_index(some, "id", "text"), 3, "id", "text")[0].count() == 0


def vector(text, idf, n, dims):
    v = [0] * dims
    for t in words_of(text):
        code = hashlib.md5(t.encode()).hexdigest()
        w = idf.get(t, math.log(n + 1) + 1) * 256
        v[int(code[:8], 16) % dims] += (-1 if int(code[8], 16) % 2 else 1) * round(w)
    length = math.sqrt(sum(x * x for x in v))
    return [x / length if length else 0.0 for x in v]


def test_hashed_vectors(spark):
    kb = corpus(5, 60)
    index = build_index(frame(spark, kb), "id", "text")
    some = [*corpus(6, 30), (77, "unheard w1 unheard"), (78, "x " * 30_000)]
    got = {r.id: r.vec for r in hashed_vectors(frame(spark, some), "id", "text", index, 16).collect()}
    assert set(got) == {i for i, _ in some}
    for i, text in some:
        assert got[i] == pytest.approx(vector(text, idf_of(kb), len(kb), 16), abs=1e-12)


@pytest.mark.parametrize("seed,k,weight", [(1, 3, 0.5), (2, 4, 0.9), (3, 2, 0.0), (4, 300, 0.3), (5, 3, 1.0)])
def test_fused(spark, seed, k, weight):
    kb, queries = corpus(seed, 150), corpus(seed + 9, 25) + [(555, "w0 w1"), (556, "nothing here")]
    d, q = frame(spark, kb), frame(spark, queries)
    index = build_index(d, "id", "text")
    cells = build_cells(hashed_vectors(d, "id", "text", index, 16), "id", "vec")
    qv = q.drop("token").join(hashed_vectors(q, "id", "text", index, 16), "id")
    hits, scored = fused_topk(qv, index, cells, k, "id", "text", "vec", weight, depth=1)
    idf, want = idf_of(kb), {}
    vecs = {i: vector(x, idf, len(kb), 16) for i, x in kb}
    for qid, text in queries:
        s, whole = shares(text, kb, idf)
        v = vector(text, idf, len(kb), 16)
        score = {i: round(weight * (s[i] / whole if whole else 0) + (1 - weight) * (1 - sum((a - b) ** 2 for a, b in zip(v, vecs[i])) / 4), 9)
                 for i, _ in kb}
        want[qid] = sorted(((-x, i) for i, x in score.items()))[:k]
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((-r.score, r.kid))
    assert {i: [round(s, 7) for s, _ in x] for i, x in got.items()} == {i: [round(s, 7) for s, _ in x] for i, x in want.items()}
    # ties within rounding may swap; all else is the same document
    assert sum(a != b for i in want for (_, a), (_, b) in zip(got[i], want[i])) <= 2
    if weight == 0.9:  # the lexical bound keeps most documents from being scored
        assert scored.where("qid = 555").first().scored < len(kb)


def test_fused_over_nothing(spark):
    d = frame(spark, [])
    index = build_index(d, "id", "text")
    q = frame(spark, [(1, "a")]).withColumn("vec", F.array(F.lit(1.0)))
    assert fused_topk(q, index, build_cells(hashed_vectors(d, "id", "text", index), "id", "vec"), 3, "id", "text", "vec")[0].collect() == []


def test_rare_tokens_meet_their_idf_in_a_join_of_their_own(spark, monkeypatch):
    """Beyond ``FREQUENT`` tokens only the frequent ones are broadcast; the vectors stay the same and no side is copied."""
    from ticketlens.operators import features
    rows = [(i, t) for i, t in enumerate(["a a b c", "a b", "a x", None, "", "c a", "zz a a"])]
    df = spark.createDataFrame(rows, "id int, text string")
    index = build_index(df, "id", "text")
    asked = spark.createDataFrame([*rows, (9, "new a words zz"), (10, "--")], "id int, text string")

    def vectors():
        return {r.id: r.vec for r in hashed_vectors(asked, "id", "text", index).collect()}

    whole = vectors()
    for bound in (0, 1, 2, 4):
        monkeypatch.setattr(features, "FREQUENT", bound)
        assert vectors() == whole
    monkeypatch.setattr(features, "FREQUENT", 1)
    assert "_salt" not in hashed_vectors(asked, "id", "text", index)._jdf.queryExecution().toString()


def test_documents_are_completed_without_a_row_a_token(spark):
    """The tokens of a candidate are looked up in its row; a document of many candidates is no row per token and query."""
    from ticketlens.operators.lexical import complete_scores, query_terms
    index = build_index(spark.createDataFrame([(1, "a b c"), (2, "a a"), (3, None)], "id int, text string"), "id", "text")
    q = spark.createDataFrame([(7, "b a x"), (8, "c"), (9, None)], "id int, text string")
    terms = query_terms(q, index, "id", "text")
    idf = {r.token: r.idf for r in index.idf.collect()}
    partial = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.0), (8, 2, 0.0), (8, 3, 1.0), (9, 1, 0.25), (8, 1, 0.0)], "qid int, kid int, part double")
    out = complete_scores(partial, terms, index)
    assert {(r.qid, r.kid): r.score for r in out.collect()} == {
        (7, 1): round(0.5 + idf["a"] + idf["b"], 9), (7, 2): round(idf["a"], 9), (8, 2): 0.0, (8, 3): 1.0, (9, 1): 0.25,
        (8, 1): round(idf["c"], 9)}
    assert "explode(toks" not in out._jdf.queryExecution().toString()


def test_vectors_stand_in_one_table(spark, tmp_path):
    """The laid-out KB is one stored table of vectors; a table that is removed leaves nothing."""
    import os

    from ticketlens.session import removed, stored
    df = stored(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id int, vec array<double>"), "trial")
    path = df.stored_at.removeprefix("file://")
    cells = build_cells(df, "id", "vec")
    assert os.path.isdir(path)
    removed(df)
    assert not os.path.exists(path) and cells.members.count() == 50
    files = {os.path.dirname(f) for f in cells.members.inputFiles()}
    assert len([f for f in files if "pivot-cells" in f]) == 1 and not any("pivot-blocks" in f for f in files)


def test_rows_that_share_an_id_complete_it_together(spark):
    """A document id or a candidate that comes twice adds its shared tokens twice, as a join of rows does."""
    from ticketlens.operators.lexical import complete_scores, query_terms
    index = build_index(spark.createDataFrame([(1, "a b"), (1, "a"), (2, "a c")], "id int, text string"), "id", "text")
    terms = query_terms(spark.createDataFrame([(7, "b a")], "id int, text string"), index, "id", "text")
    idf = {r.token: r.idf for r in index.idf.collect()}
    partial = spark.createDataFrame([(7, 1, 0.0), (7, 2, 0.0), (7, 2, 1.0)], "qid int, kid int, part double")
    assert sorted((r.kid, r.score) for r in complete_scores(partial, terms, index).collect()) == [
        (1, round(2 * idf["a"] + idf["b"], 9)), (2, round(2 * idf["a"], 9)), (2, round(1 + 2 * idf["a"], 9))]
