"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits over the word shingles of a text; bit set if set in over
half the shingle hashes. Texts link at ``max_bits`` or fewer differing bits.

Candidate search, over distinct fingerprints only:

1. The 64 bits are put in parts; bits that correlate (over all fingerprints) go
   into the same part, so that the parts are close to independent.
2. Each fingerprint gets a threshold for each part by dynamic programming on
   the estimated number of candidates (a count sketch of all part values), so that
   the thresholds plus one sum to ``max_bits + 1``; -1 skips a part. By the
   generalised pigeonhole principle every partner agrees with it within the
   threshold in at least one part.
3. It probes the index of (part, value) with every value within the threshold,
   and each candidate is verified on all 64 bits.

Dense groups: only components are asked for, so each fingerprint is first
linked to the smallest and the largest fingerprint under the same part value
(a row per index entry, not a row per pair). Values whose fingerprints already share a
component are left out of the pair search, and pairs inside one component are
not emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ticketlens.llm.common import stored
from ticketlens.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SKETCH_BITS = 16
CHUNK = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as an unsigned integer (see ``fingerprint``)."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and space only
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        part = words[a:a + CHUNK + shingle - 1] if n > 1 else words
        sets = [part] if n == 1 else zip(*[part[k:] for k in range(shingle)])
        hashes = np.array([digest(b" ".join(s), SEED) for s in sets], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text as a signed long: A-Z lower-cased, words between
    ASCII white space, ``shingle``-word shingles with repeats, XXH64 with seed
    42. Fewer words: the whole sequence. No word or null: zero."""
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
    return F.pandas_udf(f, LongType())(text)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(prints: DataFrame) -> np.ndarray:
    """64 x 64 sums of products of the bits, taken as -1 and 1, over the column
    ``fp``: a matrix per task, summed by Spark; 2,080 numbers reach the driver."""
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((64, 64))
        for d in batches:
            x = _bits(d["fp"].to_numpy()).astype(np.float32) * 2 - 1
            total += x.T @ x
        i, j = np.triu_indices(64)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j].astype(np.int64)})
    rows = prints.select("fp").mapInPandas(f, "i int, j int, s long").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((64, 64))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def bit_parts(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits of each part: a part starts with the free bit of largest
    correlation and takes the free bit most correlated with it until full."""
    c = np.abs(corr)
    np.fill_diagonal(c, 0)
    free, out = set(range(64)), []
    for p in range(parts):
        width = 64 // parts + (p < 64 % parts)
        own = [max(sorted(free), key=lambda b: c[b, sorted(free)].sum())]
        free.remove(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: c[b, own].sum())
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def parts_for(n: int, max_bits: int = MAX_BITS) -> int:
    """Number of parts with the least expected probes plus candidates for ``n``
    fingerprints (every choice finds all links)."""
    def cost(m: int) -> float:
        total, left = 0.0, max_bits - m + 1
        for p in range(m):
            t = left // m + (p < left % m)
            total += _ball(64 // m, t) * (1 + n / 2.0 ** (64 // m))
        return total
    return min(range(2, max_bits + 2), key=cost)


def _ball(width: int, radius: int) -> int:
    size, term = 1, 1
    for r in range(1, radius + 1):
        term = term * (width - r + 1) // r
        size += term
    return size


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as integers, first bit lowest."""
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(bits.shape[1], dtype=np.int64))


def _sketch_slot(values: np.ndarray) -> np.ndarray:
    """Counter of a part value: the value itself up to 16 bits, else hashed."""
    v = values.astype(np.uint64)
    return np.where(v < 1 << SKETCH_BITS, v, (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _index(batches: Iterator[pd.DataFrame], parts: list[list[int]]) -> Iterator[pd.DataFrame]:
    for d in batches:
        bits = _bits(d["fp"].to_numpy())
        for p, own in enumerate(parts):
            yield pd.DataFrame({"key": (np.int64(p) << 32) + _pack(bits[:, own]), "fp": d["fp"]})


def _neighbours(values: np.ndarray, width: int, radius: int) -> np.ndarray:
    """All values within ``radius`` (0, 1 or more) bits, a row each."""
    flips = [0]
    level = [(0, -1)]
    for _ in range(radius):
        level = [(f | 1 << b, b) for f, last in level for b in range(last + 1, width)]
        flips += [f for f, _ in level]
    return values[:, None] ^ np.array(flips, dtype=np.int64)[None, :]


def allocate(estimates: np.ndarray, max_bits: int) -> np.ndarray:
    """Thresholds by dynamic programming. ``estimates[i, p, t]`` is the cost of
    threshold ``t - 1`` in part ``p``. Returns thresholds (rows, parts) with the
    least total cost whose thresholds plus one sum to ``max_bits + 1``."""
    n, parts, kinds = estimates.shape
    best = np.full((n, max_bits + 2), np.inf)
    best[:, 0] = 0
    choices = []
    for p in range(parts):
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for t in range(kinds):
            for s in range(max_bits + 2 - t):
                cost = best[:, s] + estimates[:, p, t]
                better = cost < new[:, s + t]
                new[better, s + t] = cost[better]
                pick[better, s + t] = t
        best = new
        choices.append(pick)
    out, at, rows = np.zeros((n, parts), np.int8), np.full(n, max_bits + 1), np.arange(n)
    for p in range(parts - 1, -1, -1):
        out[:, p] = choices[p][rows, at]
        at = at - out[:, p]
    return out - 1


def _probes(batches: Iterator[pd.DataFrame], parts: list[list[int]], sketch: np.ndarray, max_bits: int) -> Iterator[pd.DataFrame]:
    top = -(-(max_bits + 1) // len(parts))  # largest threshold plus one that an even split needs
    for d in batches:
        fp = d["fp"].to_numpy()
        bits = _bits(fp)
        values = [_pack(bits[:, own]) for own in parts]
        costs = np.zeros((len(fp), len(parts), top + 2))
        for p, own in enumerate(parts):
            for t in range(top + 1):
                near = _neighbours(values[p], len(own), t)
                costs[:, p, t + 1] = near.shape[1] + sketch[p][_sketch_slot(near)].sum(axis=1)
        chosen = allocate(costs, max_bits)
        for p, own in enumerate(parts):
            for t in range(top + 1):
                mine = chosen[:, p] == t
                if mine.any():
                    near = _neighbours(values[p][mine], len(own), t)
                    yield pd.DataFrame({"key": ((np.int64(p) << 32) + near).ravel(), "fp": np.repeat(fp[mine], near.shape[1])})


def linked(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint that links to another
    one: ``root`` is the same within a component. ``prints`` has a column ``fp`` without repeats."""
    n = prints.count()
    empty = prints.sparkSession.createDataFrame([], "fp long, root long")
    if n < 2:
        return empty
    m = parts_for(n, max_bits)
    parts = bit_parts(correlations(prints), m)
    index = stored(prints.select("fp").mapInPandas(lambda b: _index(b, parts), "key long, fp long"), "index")
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    # links to the two ends of each value: one row an index entry
    ends = (index.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi"))
    shared = stored(index.join(ends, "key"), "shared")  # entries whose value is not theirs alone
    star = (shared.select("fp", F.explode(F.array("lo", "hi")).alias("v")).where(F.col("fp") != F.col("v"))
            .where(close("fp", "v")).select(F.col("fp").alias("u"), "v"))
    first = stored(components(star, "star"), "first")
    roots = prints.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", F.coalesce("root", "fp").alias("root"))
    roots = stored(roots, "roots")
    # all other links: probes against the values that hold more than one component
    open_keys = (index.join(roots, "fp").groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).select("key", "a", "b"))
    slots = 1 << SKETCH_BITS
    sketch = np.zeros((m, slots), np.int64)
    for r in (index.mapInPandas(lambda b: _slots(b), "part int, slot int, n long")
              .groupBy("part", "slot").agg(F.sum("n").alias("n")).toPandas().itertuples()):
        sketch[r.part, r.slot] = r.n
    probes = prints.select("fp").mapInPandas(lambda b: _probes(b, parts, sketch, max_bits), "key long, fp long")
    probes = probes.join(roots, "fp").select("key", F.col("fp").alias("x"), F.col("root").alias("xr"))
    # a value all of whose entries share the probe's component can give nothing new
    probes = probes.join(open_keys, "key").where(~((F.col("a") == F.col("b")) & (F.col("a") == F.col("xr")))).select("key", "x", "xr")
    entries = index.join(roots, "fp").select("key", F.col("fp").alias("y"), F.col("root").alias("yr"))
    pairs = probes.join(entries, (probes.key == entries.key) & (F.col("xr") != F.col("yr")) & close("x", "y"))
    more = components(pairs.select(F.col("xr").alias("u"), F.col("yr").alias("v")), "more")
    joined = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return joined.select("fp", F.coalesce("top", "root").alias("root"))


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        key = d["key"].to_numpy()
        one = pd.DataFrame({"part": (key >> 32).astype(np.int32), "slot": _sketch_slot(key & 0xFFFFFFFF).astype(np.int32)})
        yield one.groupby(["part", "slot"]).size().reset_index(name="n")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``df``: the fingerprint
    (signed long) and the smallest id that is reachable over links, its own included.

    A null or wordless text has fingerprint zero and links like any other; a
    null id is never the smallest, and a component of null ids only has a null
    ``component_id``; repeated rows come out repeated; an empty table gives no rows.
    """
    prints = stored(df.select(F.col(key).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    root = classes.join(linked(classes.select("fp"), max_bits), "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    root = stored(root, "linked")
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(root.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                 max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``df`` of each component: that of the smallest id, a null id
    last (of several rows with that id, the one of the smallest hash of the text;
    of rows that share both, any one).

    Rows are told apart by id and a 128-bit hash of the text, so rows that share an
    id, or have none, stand each for their own text. An empty table gives no rows.
    """
    hashes = [F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))]
    prints = stored(df.select(F.col(key).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp"),
                              *[h.alias(f"h{i}") for i, h in enumerate(hashes)]), "prints")
    copies = prints.groupBy("fp", "doc_id", "h0", "h1").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h0", "h1", "n")
    classes = stored(copies.groupBy("fp").agg(F.min(place).alias("least")), "classes")
    root = classes.join(linked(classes.select("fp"), max_bits), "fp", "left").select("least", F.coalesce("root", "fp").alias("root"))
    first = root.groupBy("root").agg(F.min("least").alias("r"))
    first = stored(first.select(F.col("r.doc_id").alias("__id"), F.col("r.h0").alias("__f0"), F.col("r.h1").alias("__f1"),
                                F.col("r.n").alias("__n")), "first-rows")
    rows = df.withColumns({f"__h{i}": h for i, h in enumerate(hashes)})
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.col("__h0") == F.col("__f0")) & (F.col("__h1") == F.col("__f1"))
    several = first.where("__n > 1")
    if not several.limit(1).count():
        return rows.join(first, same, "left_semi").drop("__h0", "__h1")
    # only rows that are there more than once are shuffled whole
    once = rows.join(first.where("__n = 1"), same, "left_semi")
    again = rows.join(several, same, "left_semi").dropDuplicates([key, "__h0", "__h1"])
    return once.union(again).drop("__h0", "__h1")
