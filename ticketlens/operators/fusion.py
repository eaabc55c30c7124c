"""Two-stage retrieval (X5): lexical and vector rankings fused by a threshold algorithm in three phases.

The fused score of a document is ``weight`` times its lexical share (of the
query's IDF, how much it holds) plus the rest times its vector likeness (1 at squared distance 0,
0 at 4, the largest between vectors of length 1).

1. Both rankings are read to a small depth and the documents seen are scored in full. The k-th
   best is a score that the result cannot fall below.
2. The best lexical share and the best likeness are known now. A document of the result must make
   up the k-th score with the best likeness at most, which bounds its lexical share from below (and, where that
   bound is none, its distance from above). All documents within the bound are fetched by a range search.
3. What a fetched document lacks is looked up, and the best k are ranked.

No candidate cap decides the result: it is exact, and the number of rounds is fixed. Scale: the
searches are those of the pruned index and of the pivot cells; a fetched document costs one
lookup of its vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.operators.lexical import LexicalIndex, complete_scores, lexical_topk, lexical_within, query_terms
from ticketlens.operators.pivots import Cells, pivot_knn, pivot_within
from ticketlens.session import stored

DEPTH = 4     # of the first lists, in results asked for
EPS = 1e-7    # by which bounds are loosened; scores are rounded to nine digits


def fused_score(share: Column, distance: Column, weight: float) -> Column:
    return F.round(F.lit(weight) * share + F.lit(1.0 - weight) * (1 - distance / 4), 9)


def _squared(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def fused_topk(queries: DataFrame, index: LexicalIndex, cells: Cells | None, k: int, q_id: str, q_text: str, q_vec: str,
               weight: float = 0.5, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """``(qid, rank, kid, score)``: the ``k`` documents of the largest fused score (ties: smaller id) of every
    query, exact; and per query how many documents were ``scored``. ``queries`` holds an id, a text and a
    vector of length 1 (or all zeros) a row, ``index`` and ``cells`` the same documents. ``weight`` is
    between 0 and 1. Query ids must be distinct; a query without a known word is ranked by its vector alone."""
    spark, q_type = queries.sparkSession, queries.schema[q_id].dataType
    if cells is None or k <= 0:
        none = spark.createDataFrame([], "rank int, score double, scored long")
        qid, kid = F.lit(None).cast(q_type).alias("qid"), F.lit(None).cast(index.docs.schema["kid"].dataType).alias("kid")
        return none.select(qid, "rank", kid, "score"), none.select(qid, "scored")
    q = stored(queries.select(F.col(q_id).alias("qid"), F.col(q_text).alias("text"), F.col(q_vec).alias("vec")), "fusion-queries")
    terms = stored(query_terms(q, index, "qid", "text"), "fusion-terms")
    whole = terms.groupBy("qid").agg(F.sum("idf").alias("whole"))
    q = stored(q.join(whole, "qid", "left"), "fusion-queries")
    lex = stored(lexical_topk(q, index, depth * k, "qid", "text")[0], "fusion-lexical")
    near = stored(pivot_knn(q, cells, depth * k, "qid", "vec")[0], "fusion-near")
    first = stored(_completed(lex.select("qid", "kid", F.col("score").alias("lexical")).join(
        near.select("qid", "kid", "distance"), ["qid", "kid"], "full"), q, terms, index, cells, weight), "fusion-first")
    bounds = stored(_bounds(first, lex, near, q, k, weight), "fusion-bounds")
    # phase 2: by the lexical share where it is bounded, else by the distance
    by_text = lexical_within(terms, bounds.where("least > 0").select("qid", F.col("least").alias("kth")), index) \
        .select("qid", "kid", F.col("score").alias("lexical"), F.lit(None).cast("double").alias("distance"))
    open_queries = stored(bounds.where("least <= 0").join(q.select("qid", "vec"), "qid").select("qid", "vec", "radius"), "fusion-open")
    fetched = by_text
    if not open_queries.isEmpty():
        fetched = by_text.unionByName(pivot_within(open_queries, cells).select(
            "qid", "kid", F.lit(None).cast("double").alias("lexical"), F.col("score").alias("distance")))
    fetched = stored(fetched, "fusion-fetched")
    fresh = fetched.join(first.select("qid", "kid"), ["qid", "kid"], "left_anti")
    scored = first.unionByName(_completed(fresh, q, terms, index, cells, weight))
    scored = stored(scored, "fusion-scored")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "kid")
    hits = scored.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("qid", "rank", "kid", "score")
    return hits, scored.groupBy("qid").agg(F.count(F.lit(1)).alias("scored"))


def _bounds(first: DataFrame, lex: DataFrame, near: DataFrame, q: DataFrame, k: int, weight: float) -> DataFrame:
    """``(qid, least, radius)``: the lexical score that a document of the result has at least (0 or less: none is
    needed) and the squared distance it has at most."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "kid")
    kth = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("qid", F.col("score").alias("kth"))
    d = q.select("qid", "whole").join(kth, "qid", "left") \
        .join(lex.where("rank = 1").select("qid", F.col("score").alias("top")), "qid", "left") \
        .join(near.where("rank = 1").select("qid", F.col("distance").alias("nearest")), "qid", "left")
    rest = 1.0 - weight
    kth, share = F.coalesce("kth", F.lit(0.0)) - EPS, F.coalesce(F.col("top") / F.col("whole"), F.lit(0.0))
    like = 1 - F.coalesce("nearest", F.lit(0.0)) / 4
    least = (kth - F.lit(rest) * like) * F.col("whole") / F.lit(weight) - EPS if weight > 0 else F.lit(0.0)
    # a distance beyond 4 does not occur
    radius = (1 - (kth - F.lit(weight) * share) / F.lit(rest)) * 4 + EPS if rest > 0 else F.lit(5.0)
    return d.select("qid", F.coalesce(least, F.lit(0.0)).alias("least"), radius.alias("radius"))


def _completed(seen: DataFrame, q: DataFrame, terms: DataFrame, index: LexicalIndex, cells: Cells, weight: float) -> DataFrame:
    """``(qid, kid, score)``: the fused scores of ``seen`` (``qid, kid, lexical, distance``), whose nulls are looked up."""
    seen = stored(seen, "fusion-seen")
    missing = seen.where("lexical IS NULL").select("qid", "kid", F.lit(0.0).alias("part"))
    more = complete_scores(missing, terms, index).select("qid", "kid", F.col("score").alias("looked_up"))
    far = seen.where("distance IS NULL").select("qid", "kid")
    far = far.join(cells.members.select("kid", F.col("vec").alias("kv")), "kid") \
        .join(q.select("qid", "vec"), "qid").select("qid", "kid", _squared("vec", "kv").alias("measured"))
    both = seen.join(more, ["qid", "kid"], "left").join(far, ["qid", "kid"], "left").join(q.select("qid", "whole"), "qid")
    share = F.coalesce(F.coalesce("lexical", "looked_up") / F.col("whole"), F.lit(0.0))
    return both.select("qid", "kid", fused_score(share, F.coalesce("distance", "measured"), weight).alias("score"))
