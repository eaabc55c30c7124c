"""Steps whose disk or memory grew faster than their input: plans and sizes on rows of their own."""

import re

import pytest
from pyspark.sql import functions as F


def tree(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


# --------------------------------------------------------------------------- language
def test_trigram_rows_are_summed_by_hash(spark):
    """The aggregate above the exploded trigrams must not sort them: they are hundreds of times the rows of the texts."""
    from ticketlens.operators.language import train_and_detect
    d = spark.createDataFrame([(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, None, None)], "id long, text string, lang string")
    lines = tree(train_and_detect(d, "id", "text", "lang", keep=["lang"], out="found"))
    at = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    above = [line for line in lines[:at] if "Aggregate(" in line]
    assert "HashAggregate" in above[-1] and "partial_sum" in above[-1]


def test_rows_sharing_an_id_are_one_text(spark):
    from ticketlens.operators.language import detect_language, train_language_profiles
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")], "text string, lang string")
    d = spark.createDataFrame([(1, "the mat", "a"), (1, "the mat", "b"), (2, "la table", None), (3, "", "c")], "id long, text string, tag string")
    got = {r.id: r for r in detect_language(d, "id", "text", train_language_profiles(train, "text", "lang"), keep=["tag"]).collect()}
    assert len(got) == 3 and got[1].tag in "ab" and got[2].tag is None
    assert [got[i].lang for i in (1, 2, 3)] == ["en", "fr", "unknown"]


# --------------------------------------------------------------------------- smart KB sample
def test_smart_sample_has_its_whole_size(spark, tmp_path):
    """300 texts a language and English filled up to 5,000 in all, in the query as in its SQL."""
    import duckdb

    import __spark_entry__ as E
    rows = [(i, f"texto {i}", "es" if i % 2 else "fr") for i in range(700)]
    rows += [(i, f"text {i} " + "x" * (i % 90), "en") for i in range(1000, 6400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in E.queries()["sample_smart_kb"](spark, str(tmp_path)).collect()]
    assert sum(r[1] == "es" for r in got) == 300 and sum(r[1] == "en" for r in got) == 3 * ((5000 - 600) // 3)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(got, key=repr) == sorted(con.execute(E.oracle_sql()["sample_smart_kb"]).fetchall(), key=repr)


# --------------------------------------------------------------------------- many lexical queries
@pytest.fixture(scope="module")
def kb_and_tickets(spark):
    import random
    r = random.Random(5)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 400}"
    kb = [(str(i), " ".join(word() for _ in range(r.randint(0, 25)))) for i in range(300)] + [("x", None), ("y", "")]
    t = [(i, " ".join(word() for _ in range(r.randint(0, 20)))) for i in range(120)] + [(900, None), (901, "unknown only"), (None, "w1 w2 w3")]
    return (spark.createDataFrame(kb, "id string, document string").coalesce(2),
            spark.createDataFrame(t, "ticket long, text string").coalesce(2))


def test_blocks_give_the_hits_of_postings(spark, kb_and_tickets, monkeypatch):
    from ticketlens.operators import lexical as L
    kb, t = kb_and_tickets
    monkeypatch.setattr(L, "BLOCK_ROWS", 64)
    index = L.build_index(kb, "id", "document")
    rows = lambda df: sorted((r.qid, r["rank"], r.kid, round(r.score, 6)) for r in df.where("qid IS NOT NULL").collect())
    few, _ = L.lexical_topk(t, index, 3, "ticket", "text")
    many, work = L.lexical_topk(t, index, 3, "ticket", "text", block_queries=0)
    assert len(rows(few)) > 300 and rows(many) == rows(few)
    assert work.where("expanded <> postings").isEmpty()


def test_many_queries_make_no_row_a_posting(spark, kb_and_tickets, monkeypatch):
    """Beyond the bound, what the tasks exchange are texts, once a block, and k hits a query and block."""
    from ticketlens.operators import lexical as L
    kb, t = kb_and_tickets
    monkeypatch.setattr(L, "BLOCK_QUERIES", 10)
    monkeypatch.setattr(L.lexical_topk, "__defaults__", (10,))
    kept = []
    real = L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: kept.append((name, real(df, name))) or kept[-1][1])
    hits, _ = L.lexical_topk(t, L.build_index(kb, "id", "document"), 2, "ticket", "text")
    assert "FlatMapCoGroupsInPandas" in "\n".join(tree(hits))
    assert all(df.count() <= 402 for name, df in kept if name != "lexical-idf")


# --------------------------------------------------------------------------- pivot searches
def test_a_query_is_sent_once_a_group(spark):
    """Vectors without clusters: every block is visited, yet a query's vector goes out once a group of blocks."""
    import numpy as np

    from ticketlens.operators import pivots as P
    rng = np.random.default_rng(8)
    kb = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(rng.normal(size=(400, 8)))], "id long, v array<double>")
    cells = P.build_cells(kb, "id", "v", block_rows=16)
    q = kb.where("id < 50").selectExpr("id AS qid", "v AS vec")
    visits = P._visits(q, cells, P._first(10 ** 9)).persist()
    assert int(cells.cuts.sum()) >= 20 and visits.count() == 50
    assert P.compared_pairs(P._by_block(visits), cells).first().compared == 50 * 400


def test_groups_of_blocks_give_the_same_neighbours(spark, monkeypatch):
    import numpy as np

    from ticketlens.operators import pivots as P
    from ticketlens.operators.retrieval import knn_ids
    monkeypatch.setattr(P, "GROUP_VALUES", 8 * 40)
    rng = np.random.default_rng(9)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(np.round(rng.normal(size=(300, 8)), 1))]
    kb = spark.createDataFrame(rows, "id long, v array<double>")
    cells = P.build_cells(kb, "id", "v", block_rows=16)
    assert cells.groups().max() >= 5 and (np.diff(cells.groups()) >= 0).all()
    rank = lambda df: sorted((r.qid, r["rank"], r.kid) for r in df.collect())
    hits, visits = P.pivot_knn(kb, cells, 3, "id", "v", exclude_self=True, first_rows=40, q_block_rows=64)
    assert rank(hits) == rank(knn_ids(kb, kb, 3, "id", "v", "id", "v", exclude_self=True))
    assert visits.count() == visits.distinct().count()
    near = P.pivot_within(kb.where("id < 20").selectExpr("id AS qid", "v AS vec", "9.0D AS radius"), cells)
    x = np.array([v for _, v in rows])
    want = sum(int((((x - x[i]) ** 2).sum(1) <= 9.0).sum()) for i in range(20))
    assert near.count() == near.distinct().count() == want
