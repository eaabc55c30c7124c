"""Benchmark decontamination by spaced-seed hashing.

Words (lower-cased runs of letters and digits) of the test items and of the
documents are hashed under fixed masks that look at six of up to nine
neighbouring positions and ignore the rest. Equal hashes give a diagonal
(document, item, offset), which is verified on the words themselves: some
window of ``window`` words agrees but for ``max_subs`` substitutions.

The two masks are lossless for 13 words with any 2 substitutions: wherever the
substitutions fall, one of the masks fits between them (tested by enumeration).
Items shorter than the window have to occur whole and unchanged; items under
``MIN_WORDS`` words are not searched.

Scale: seeds are joined to the set of test seeds before anything is shuffled.
That set, and the hits of documents, are broadcast only below a counted bound,
else joined by shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import stored

WINDOW = 13
MAX_SUBS = 2
MIN_WORDS = 5
# Positions that a mask looks at, as pairs of neighbours at these offsets.
MASKS = ((0, 2, 5), (0, 5, 7))
BROADCAST_ROWS = 1_000_000   # of 16 bytes
BROADCAST_BYTES = 32 << 20


def tokens(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order; empty for null."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _from(a: Column, start: int) -> Column:
    return F.slice(a, start + 1, F.size(a))


def _zip(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def with_seeds(df: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """``df`` with ``seeds``: an array per mask (and per length of ``lengths``,
    for whole short items) of the hashes at each position. Hashes near the end
    reach past the text; they equal none that lies inside."""
    w = F.col(words)
    d = df.withColumn("__p", _zip(w, _from(w, 1)))
    p = F.col("__p")
    arrays = []
    for i, mask in enumerate(MASKS):
        hashed = reduce(_zip, [_from(p, o) for o in mask])
        d = d.withColumn(f"__m{i}", F.slice(hashed, 1, F.greatest(F.size(w) - max(mask) - 1, F.lit(0))))
        arrays.append(F.col(f"__m{i}"))
    for n in lengths:
        d = d.withColumn(f"__l{n}", F.slice(reduce(_zip, [_from(w, o) for o in range(n)]), 1, F.greatest(F.size(w) - n + 1, F.lit(0))))
        arrays.append(F.col(f"__l{n}"))
    return d.withColumn("seeds", F.array(*arrays)).drop("__p", *[f"__m{i}" for i in range(len(MASKS))], *[f"__l{n}" for n in lengths])


def _exploded(df: DataFrame, *keep: str) -> DataFrame:
    """A row per seed: ``keep``, ``mask``, ``at``, ``seed``; a null seed for an
    empty array. (Outer, as the optimiser guards a plain explode with a filter
    that repeats the whole expression below it.)"""
    return (df.select(*keep, F.posexplode_outer("seeds").alias("mask", "__s"))
            .select(*keep, "mask", F.posexplode_outer("__s").alias("at", "seed")))


def hits(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct ``(doc_id, item_id, item_words, offset)`` with an equal seed.
    ``docs``: ``doc_id, words``; ``items``: ``item_id, words``."""
    n = F.size("words")
    of_items = with_seeds(items, "words", lengths)
    test = (_exploded(of_items.select("item_id", F.col("words").alias("item_words"), "seeds", n.alias("n")), "item_id", "item_words", "n")
            .where((F.col("mask") < len(MASKS)) & (F.col("n") >= WINDOW)
                   | reduce(lambda a, b: a | b, [(F.col("mask") == len(MASKS) + i) & (F.col("n") == x) for i, x in enumerate(lengths)], F.lit(False))))
    test = stored(test.select("item_id", "item_words", "mask", F.col("at").alias("item_at"), "seed"), "seeds")
    known = test.select("mask", "seed").distinct()
    small = known.count() <= BROADCAST_ROWS
    seeds = _exploded(with_seeds(docs, "words", lengths).select("doc_id", "seeds"), "doc_id")
    found = seeds.join(F.broadcast(known) if small else known, ["mask", "seed"], "left_semi")
    return (found.join(test, ["mask", "seed"])
            .groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("offset"))
            .agg(F.first("item_words").alias("item_words")))


def overlaps(doc: Column, item: Column, offset: Column, window: int = WINDOW, max_subs: int = MAX_SUBS) -> Column:
    """Whether ``item`` laid on ``doc`` at ``offset`` agrees in some window but
    for ``max_subs`` words; a shorter item has to agree whole."""
    lo = F.greatest(F.lit(0), -offset)
    hi = F.least(F.size(item), F.size(doc) - offset) - 1
    misses = F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda q: F.when(
        F.get(doc, offset + q) == F.get(item, q), 0).otherwise(1)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    windows = F.when(F.size(misses) >= window, F.exists(
        F.sequence(F.lit(1), F.size(misses) - window + 1), lambda s: total(F.slice(misses, s, window)) <= max_subs))
    short = (F.size(misses) == F.size(item)) & (total(misses) == 0)
    return F.coalesce(F.when(F.size(item) >= window, windows).otherwise(short), F.lit(False))


def contaminated(df: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
                 item_key: str = "item_id", window: int = WINDOW, max_subs: int = MAX_SUBS) -> DataFrame:
    """``df`` with ``contaminated`` (boolean) and ``benchmark_items`` (sorted
    array of the ids of the items found).

    A null or empty text holds nothing; null item texts are skipped; rows that
    share an id (or have none) are each verified on their own text; empty tables
    give no rows, or no hits. Columns of these two names are replaced, other
    extra columns pass through.
    """
    df = df.drop("contaminated", "benchmark_items", "__hits", "__id", "__words")
    tests = items.select(F.col(item_key).alias("item_id"), tokens(F.col(item_text)).alias("words"))
    tests = stored(tests.where(F.size("words") >= MIN_WORDS).distinct(), "items")
    lengths = sorted(r.n for r in tests.select(F.size("words").alias("n")).where(F.col("n") < window).distinct().collect())
    docs = df.select(F.col(key).alias("doc_id"), tokens(F.col(text)).alias("words"))
    per_doc = hits(docs, tests, lengths).groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item_words", "offset")).alias("__hits"))
    per_doc = stored(per_doc.select(F.col("doc_id").alias("__id"), "__hits"), "hits")
    size = per_doc.select(F.sum(64 + F.aggregate("__hits", F.lit(0), lambda s, h: s + 40 + 8 * F.size(h.item_words))).alias("b")).first()["b"] or 0
    joined = df.join(F.broadcast(per_doc) if size <= BROADCAST_BYTES else per_doc, F.col(key).eqNullSafe(F.col("__id")), "left")
    d = joined.withColumn("__words", F.when(F.col("__hits").isNotNull(), tokens(F.col(text))))
    found = F.filter("__hits", lambda h: overlaps(F.col("__words"), h.item_words, h.offset, window, max_subs))
    ids = F.array_sort(F.array_distinct(F.transform(found, lambda h: h.item_id)))
    d = d.withColumn("benchmark_items", F.coalesce(ids, F.array().cast(f"array<{dict(items.dtypes)[item_key]}>")))
    return d.withColumn("contaminated", F.size("benchmark_items") > 0).drop("__hits", "__id", "__words")
