"""N-gram language model in a log-frequency Bloom filter.

Training counts every n-gram up to ``ORDER`` words of the training texts. A count
is quantised on a scale of growing steps, and the filter holds
the pair (n-gram, level) for every level up to that of its count. A count is read back
by probing level 1, 2, ... until a probe fails; a longer n-gram counts no more than the
two n-grams it contains. Each level of the model is
smoothed with the one below by a Dirichlet prior, the lowest is the
add-0.1 estimate that the exact base score uses.

Scale. Counting: every task sends its partial counts as one packed row a
cell (a hash range of n-grams), a cell is summed and turned into its own part of the filter, of a size that
follows the entries it got, so the false-positive rate is the same at every corpus size. A filter of at most
``FILTER_BYTES`` is broadcast and scoring is one pass over the texts; frequent tokens, which have most levels to
probe, are read from it once, on the driver, and their levels broadcast. A larger one is never put together: the
texts are dealt into portions of ``PORTION_TOKENS`` tokens, a portion sends its distinct n-grams with their counts to
their cells, and every cell, once its filter is built, reads it for each distinct n-gram that it was sent and gives
each portion its levels back (a byte an n-gram, in the order sent). The portion's texts meet them again and
are scored. Texts and n-grams so travel a fixed number of times, and no part depends on the size of the corpus.

The base score is exact: tokens that are frequent in the whole table (at most
``HEAVY_TOKENS``, told apart by 64 bits) get their counts from a broadcast table in the same pass, all
others by a shuffle join on the token itself, where each has few rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import SPACE, stored, text_of, words_of
from ticketlens.session import setting

ORDER = 2
BITS_PER_ENTRY = 10
PROBES = 6
STEP = 2 ** 0.5          # growth of the scale of counts
PRIOR = 200.0            # weight of the shorter n-gram, in occurrences
ADD = 0.1
FILTER_BYTES = 32 << 20  # a filter that may be larger is not broadcast
CELL_GRAMS = 1 << 17     # n-gram occurrences a cell is laid out for
PORTION_TOKENS = 1 << 21  # tokens of a portion of texts, about
GROUP_CELLS = 8          # neighbouring cells that a portion asks in one row
HEAVY_TOKENS = 1 << 19
LEVELS = 120             # more than any count in 64 bits has
_FLUSH = 1 << 22         # n-gram occurrences a task holds before it counts and sends them on
_CHUNK = 1 << 18         # tokens looked up at once
BATCH_ROWS = 2000        # rows a Python worker is handed at once
END, START = 0x1F3D5B79A2C4E68D, 0x5EED0F7E47A57A27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Words of the whole text, A-Z lower-cased; the end token is not in it.
    (``lower`` does the same for a text of single bytes and is much quicker.)"""
    t = text_of(text)
    return words_of(F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)))


def _lowered(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def scale_of(most: int, step: float = STEP) -> np.ndarray:
    """First count of each level, ascending: 1, 2, 3, 4, 6, 8, ..."""
    n = max(1, math.ceil(math.log(max(most, 2), step)) + 1)
    return np.unique(np.ceil(step ** np.arange(n) - 1e-9)).astype(np.int64)


def level_values(step: float = STEP) -> np.ndarray:
    """The count that stands for a level (index 0: none): the mean of those quantised to it."""
    first = scale_of(1 << 50, step).astype(float)
    return np.concatenate([[0.0], (first[:-1] + first[1:] - 1) / 2])


def _mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on unsigned 64-bit integers (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(lists: list[np.ndarray], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per length 1..order the hash of the n-gram that ends at each token of the
    texts (words and the end token, one after the other), and the token count of each text.
    Before a text stand ``order - 1`` start symbols."""
    sizes = np.array([len(x) + 1 for x in lists], dtype=np.int64)
    pad = order - 1
    ends = np.cumsum(sizes + pad)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    is_token = np.ones(len(flat), dtype=bool)
    for i in range(pad):
        at = ends - sizes - pad + i
        flat[at], is_token[at] = START, False
    flat[ends - 1] = END
    words = is_token.copy()
    words[ends - 1] = False
    if len(lists):
        flat[words] = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]).view(np.uint64)
    at = np.flatnonzero(is_token)
    out = [_mix(flat[at])]
    for n in range(2, order + 1):
        g = _mix(flat[at - n + 1])
        for j in range(n - 2, -1, -1):
            g = _mix(g * np.uint64(0x9E3779B97F4A7C15) + flat[at - j])
        out.append(g)
    return out, sizes


def contexts(lists: int, order: int) -> list[np.ndarray]:
    """The runs of start symbols alone, of each length below ``order``."""
    out = []
    for n in range(1, order):
        g = _mix(np.full(1, START, dtype=np.uint64))
        for _ in range(n - 1):
            g = _mix(g * np.uint64(0x9E3779B97F4A7C15) + np.uint64(START))
        out.append(np.repeat(g, lists))
    return out


def _cell(g: np.ndarray, cells: int) -> np.ndarray:
    """The cell of an n-gram: a range of its hash's upper half."""
    return (((g >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)


def _at(g: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(g + np.uint64((level * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
    return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)


def _position(a: np.ndarray, b: np.ndarray, i: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    return (((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * bits) >> np.uint64(32)


def cell_filter(g: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY,
                probes: int = PROBES) -> tuple[int, np.ndarray]:
    """Entries and packed bits of the filter of distinct n-grams ``g``."""
    first = scale_of(int(counts.max()) if len(counts) else 1)
    level = np.searchsorted(first, counts, side="right")
    entries = int(level.sum())
    size = np.uint64(max(8, -(-entries * bits_per_entry // 8) * 8))
    bits = np.zeros(int(size), dtype=np.uint8)
    for v in range(1, int(level.max(initial=0)) + 1):
        a, b = _at(g[level >= v], v)
        for i in range(probes):
            bits[_position(a, b, i, size).astype(np.int64)] = 1
    return entries, np.packbits(bits, bitorder="little")


def _cells(n_tokens: int, order: int) -> int:
    return max(1, -(-n_tokens * order // CELL_GRAMS))


def _starts(g: np.ndarray) -> np.ndarray:
    """Places at which a new value begins in the sorted ``g``."""
    return np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.array([], dtype=int)


def _counted(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    g = np.concatenate([np.array([], np.uint64), *held])
    g.sort()
    at = _starts(g)
    return g[at], np.diff(np.append(at, len(g)))


def _merged(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of counted lists, ascending, and the sums of their counts."""
    g = np.concatenate([x for x, _ in held])
    n = np.concatenate([x for _, x in held])
    by = np.argsort(g, kind="stable")  # quick on sorted runs
    g, n = g[by], n[by].astype(np.int64)
    at = _starts(g)
    return g[at], np.add.reduceat(n, at) if len(at) else n


def _packed(name: str, place: np.ndarray, g: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """A row for each value of ``place`` (ascending, as ``g`` is) with its n-grams and their counts."""
    cut = np.flatnonzero(np.diff(place)) + 1
    at = np.concatenate([[0], cut]) if len(place) else np.array([], dtype=int)
    return pd.DataFrame({name: place[at], "grams": [x.tobytes() for x in np.split(g, cut)][:len(at)],
                         "counts": [x.astype(np.uint32).tobytes() for x in np.split(n, cut)][:len(at)]})


def filter_table(texts: DataFrame, column: str, n_tokens: int, order: int = ORDER,
                 bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """``(cell, cells, entries, bits)``: the filter of all n-grams of the hashed
    texts in ``column``, one row per cell that has any."""
    cells = _cells(n_tokens, order)

    def packed(g: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return _packed("cell", _cell(g, cells), g, n)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for d in batches:
            for lists in _portions(d[column]):
                found, _ = grams(lists, order)
                held += [*found, *contexts(len(lists), order)]
                if sum(map(len, held)) > _FLUSH:
                    yield packed(*_counted(held))
                    held = []
        if held:
            yield packed(*_counted(held))

    def build(d: pd.DataFrame) -> pd.DataFrame:
        g, n = _merged([(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint32)) for x, y in zip(d["grams"], d["counts"])])
        entries, bits = cell_filter(g, n, bits_per_entry)
        return pd.DataFrame({"cell": d["cell"].iloc[:1], "cells": [cells], "entries": [entries], "bits": [bits.tobytes()]})

    parts = texts.select(column).mapInPandas(partial, "cell long, grams binary, counts binary")
    return parts.groupBy("cell").applyInPandas(build, "cell long, cells long, entries long, bits binary")


def _portions(rows: pd.Series) -> Iterator[list[np.ndarray]]:
    """Whole texts, up to about ``_CHUNK`` tokens at a time."""
    part: list = []
    n = 0
    for x in rows:
        part.append(x)
        n += len(x) + 1
        if n >= _CHUNK:
            yield part
            part, n = [], 0
    if part:
        yield part


@dataclass
class Part:
    """The cells ``low`` to ``high`` of a filter, in memory."""
    cells: int
    low: int
    high: int
    offset: np.ndarray   # first byte of each cell
    size: np.ndarray     # bits of each cell
    bits: np.ndarray

    def levels(self, g: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The levels of the n-grams ``g``; ``known`` for those of other parts."""
        out = known.copy()
        c = _cell(g, self.cells) - self.low
        at = np.flatnonzero((c >= 0) & (c < self.high - self.low))
        at = at[self.size[c[at]] > 0]
        h, size, start = g[at], self.size[c[at]], self.offset[c[at]].view(np.uint64) << np.uint64(3)
        v = 0
        while len(at) and v < LEVELS:
            v += 1
            ok = self._holds(h, v, size, start)
            if len(ok) < len(at):
                at, h, size, start = at[ok], h[ok], size[ok], start[ok]
            out[at] = v
        return out

    def _holds(self, h: np.ndarray, level: int, size: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Places of those n-grams ``h`` that the filter holds at ``level``; ``size`` and
        ``start``: bits of their cells, and the first of them."""
        a, b = _at(h, level)
        ok = np.arange(len(h))
        for i in range(PROBES):
            p = _position(a, b, i, size)
            p += start
            byte = self.bits[(p >> np.uint64(3)).view(np.int64)]
            p &= np.uint64(7)
            hit = np.flatnonzero((byte >> p.astype(np.uint8)) & 1)
            if len(hit) < len(a):
                ok, a, b, size, start = ok[hit], a[hit], b[hit], size[hit], start[hit]
        return ok


@dataclass
class Model:
    """A stored filter and the totals that smoothing needs."""
    table: DataFrame
    n: int
    v: int
    order: int

    def part(self) -> Part:
        """The filter as a whole, which must be small."""
        first = self.table.select("cells").first()
        cells = first["cells"] if first else 1
        offset, length = np.zeros(cells, dtype=np.int64), np.zeros(cells, dtype=np.uint64)
        data, end = [], 0
        for r in self.table.select("cell", "bits").toLocalIterator():
            offset[r["cell"]], length[r["cell"]] = end, len(r["bits"]) * 8
            data.append(np.frombuffer(r["bits"], np.uint8))
            end += len(r["bits"])
        return Part(cells, 0, cells, offset, length, np.concatenate(data) if data else np.zeros(1, np.uint8))


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of ``rows`` for the jobs run inside: texts are long, and a worker holds a whole batch."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def fit(texts: DataFrame, column: str, n: int, v: int, order: int = ORDER, bits_per_entry: int = BITS_PER_ENTRY,
        name: str = "lm-filter") -> Model:
    """The model of hashed texts (``hashed``) that hold ``n`` tokens, ``v`` distinct."""
    with small_batches(texts.sparkSession):
        return Model(stored(filter_table(texts, column, n, order, bits_per_entry), name), n, v, order)


@dataclass
class Frequent:
    """Frequent tokens by mixed hash, ascending, with their share of the base score and, in
    a model, their level."""
    key: np.ndarray
    known: np.ndarray
    term: np.ndarray
    level: np.ndarray | None = None

    def find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each token of ``u``, and whether it is one of these."""
        at = np.minimum(np.searchsorted(self.key, u), len(self.key) - 1)
        return at, self.key[at] == u


def _found(part: Part, found: list[tuple[np.ndarray, np.ndarray]], state: np.ndarray,
           given: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """``state`` (a row per n-gram length, a column per token) completed by what ``part``
    holds; ``found`` has every length's codes and distinct n-grams, ``given`` the
    levels of the distinct tokens and for which of them they hold, the others being probed."""
    out = np.empty_like(state)
    for k, (codes, u) in enumerate(found):
        known = np.zeros(len(u), dtype=np.uint8)
        known[codes] = state[k]
        if k == 0 and given is not None:
            level, here = given
            rest = np.flatnonzero(~here)
            known[rest] = part.levels(u[rest], known[rest])
            out[k] = np.where(here, level, known)[codes]
        else:
            out[k] = part.levels(u, known)[codes]
    return out


def _log10(state: np.ndarray, sizes: np.ndarray, starts: list[int], n: int, v: int) -> np.ndarray:
    """log10 probability of every token from the levels of its n-grams. The history of a token is
    the n-gram that ends before it, or that of start symbols (levels ``starts``) at the beginning of a text."""
    value = level_values()
    first = np.cumsum(sizes) - sizes
    p = (value[state[0]] + ADD) / (n + ADD * (v + 1))
    for k in range(1, len(state)):
        history = np.empty_like(state[k - 1])
        history[1:] = state[k - 1][:-1]
        history[first] = starts[k - 1]
        # an n-gram occurs no more often than what it contains
        level = np.minimum(np.minimum(state[k], state[k - 1]), history)
        p = (value[level] + PRIOR * p) / (value[history] + PRIOR)
    return np.log10(np.minimum(p, 1.0))


def _row_values(p: np.ndarray, sizes: np.ndarray, codes: np.ndarray, often: Frequent | None, at: np.ndarray | None = None,
                hit: np.ndarray | None = None) -> pd.DataFrame:
    """A row a text: the sum ``score`` of its tokens' values ``p``; with ``often`` also what those tokens give to the
    base score (``base``, ``known``) and the places of all ``other`` tokens. ``codes`` numbers the distinct
    tokens, ``at`` and ``hit`` are those that ``often`` finds for them."""
    first = np.cumsum(sizes) - sizes
    d = pd.DataFrame({"score": np.add.reduceat(p, first), "base": 0.0, "known": 0, "other": None})
    if often is not None:
        d["base"] = np.add.reduceat(np.where(hit, often.term[at], 0.0)[codes], first)
        d["known"] = np.add.reduceat((hit & often.known[at])[codes].astype(np.int64), first)
        rest = np.flatnonzero(~hit[codes])
        of = np.searchsorted(first, rest, side="right") - 1
        d["other"] = np.split((rest - first[of]).astype(np.int32), np.searchsorted(of, np.arange(1, len(sizes))))
    return d


SCORED = "score double, base double, known long, other array<int>"


def scored(df: DataFrame, model: Model, column: str, name: str = "lm", frequent: Frequent | None = None) -> DataFrame:
    """``df`` with a struct ``name``: the model's log10 probability ``score`` of each
    hashed text, its end included; with ``frequent`` also what those tokens give to the base
    score (``base``, ``known``) and the places of all ``other`` tokens. The filter is broadcast.
    Rows keep all other columns."""
    spark, order, n, v = df.sparkSession, model.order, model.n, model.v
    part = model.part()
    if frequent is not None:
        frequent = replace(frequent, level=np.zeros(len(frequent.key), np.uint8))
        for i in range(0, len(frequent.key), _CHUNK >> 2):  # little memory at a time
            s = slice(i, i + (_CHUNK >> 2))
            frequent.level[s] = part.levels(frequent.key[s], frequent.level[s])
    starts = [int(part.levels(g, np.zeros(1, np.uint8))[0]) for g in contexts(1, order)]
    whole, table = spark.sparkContext.broadcast(part), spark.sparkContext.broadcast(frequent)

    def final(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        part, often = whole.value, table.value
        for rows in batches:
            out = [pd.DataFrame({"score": [], "base": [], "known": [], "other": []})]
            for lists in _portions(rows):
                g, sizes = grams(lists, order)
                found = [pd.factorize(x) for x in g]
                given, at, hit = None, None, None
                if often is not None:
                    at, hit = often.find(found[0][1])
                    given = often.level[at], hit
                state = _found(part, found, np.zeros((order, len(g[0])), np.uint8), given)
                out.append(_row_values(_log10(state, sizes, starts, n, v), sizes, found[0][0], often, at, hit))
            yield pd.concat(out[1:] or out)

    return df.withColumn(name, F.pandas_udf(final, SCORED)(F.col(column)))


def _asks(texts: DataFrame, column: str, training: str, cells: int, order: int) -> DataFrame:
    """``(portion, grp, grams, counts)``: for every portion and group of cells the distinct n-grams of the portion's
    hashed texts, ascending, and how often they occur in its training texts. A task holds whole portions."""
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for d in batches:
            for (portion, train), rows in d.groupby(["portion", training], sort=False)[column]:
                for lists in _portions(rows):
                    found, _ = grams(lists, order)
                    held.setdefault(portion, {True: [], False: [(x, np.zeros(1, np.int64)) for x in contexts(1, order)]})[bool(train)].append(
                        _counted([*found, *contexts(len(lists), order)]))
        for portion in list(held):
            by = held.pop(portion)
            g, n = _merged(by[True] + [(x, np.zeros(len(x), np.int64)) for x, _ in by[False]])
            yield _packed("grp", _cell(g, cells) // GROUP_CELLS, g, n).assign(portion=portion)[["portion", "grp", "grams", "counts"]]

    return texts.select("portion", training, column).mapInPandas(ask, "portion int, grp long, grams binary, counts binary")


def _answers(asks: DataFrame, cells: int, bits_per_entry: int) -> DataFrame:
    """``(portion, grp, levels)``: the level of every n-gram asked, in the order asked, read from the filters of the
    group's cells, which are built from all counts sent to them."""
    def answer(d: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(x, np.uint64) for x in d["grams"]]
        g = np.concatenate(lists)
        by = np.argsort(g, kind="stable")
        at = _starts(g[by])
        u, n = g[by][at], np.add.reduceat(np.concatenate([np.frombuffer(x, np.uint32) for x in d["counts"]]).astype(np.int64)[by], at)
        of = _cell(u, cells)
        level = np.zeros(len(u), np.uint8)
        for a, b in zip(c := _starts(of), np.append(c[1:], len(of))):
            some = n[a:b] > 0
            if some.any():
                _, bits = cell_filter(u[a:b][some], n[a:b][some], bits_per_entry)
                one = Part(cells, int(of[a]), int(of[a]) + 1, np.zeros(1, np.int64), np.array([len(bits) * 8], np.uint64), bits)
                level[a:b] = one.levels(u[a:b], level[a:b])
        out = np.empty(len(g), np.uint8)
        out[by] = np.repeat(level, np.diff(np.append(at, len(g))))
        ends = np.cumsum([len(x) for x in lists])
        return pd.DataFrame({"portion": d["portion"], "grp": d["grp"],
                             "levels": [out[e - len(x):e].tobytes() for x, e in zip(lists, ends)]})

    return asks.groupBy("grp").applyInPandas(answer, "portion int, grp long, levels binary")


def _scored_portion(levels: list, lists: list, order: int, n: int, v: int, often: Frequent | None) -> Iterator[pd.DataFrame]:
    """The values of a portion's texts, in chunks; ``levels`` has those of its distinct n-grams, ascending."""
    chunks = []
    for part in _portions(lists):
        g, sizes = grams(part, order)
        chunks.append((sizes, [pd.factorize(x) for x in g]))
    u, _ = _counted([*contexts(1, order), *[d for _, found in chunks for _, d in found]])
    level = np.frombuffer(b"".join(levels), np.uint8)
    if len(level) != len(u):
        raise RuntimeError(f"{len(level)} levels came for {len(u)} n-grams of a portion")
    starts = [int(level[np.searchsorted(u, x)[0]]) for x in contexts(1, order)]
    for sizes, found in chunks:
        state = np.empty((order, int(sizes.sum())), np.uint8)
        for k, (codes, d) in enumerate(found):
            by = np.argsort(d)  # ascending keys are looked up much quicker
            here = np.empty(len(d), np.uint8)
            here[by] = level[np.searchsorted(u, d[by])]
            state[k] = here[codes]
        codes, d = found[0]
        at, hit = often.find(d) if often is not None else (None, None)
        yield _row_values(_log10(state, sizes, starts, n, v), sizes, codes, often, at, hit)


def scored_by_portions(df: DataFrame, text: str, training: Column, n: int, v: int, every: int, keep: list[str], order: int = ORDER,
                       bits_per_entry: int = BITS_PER_ENTRY, name: str = "lm", frequent: Frequent | None = None) -> DataFrame:
    """The columns ``keep`` of every row of ``df``, its ``words`` with their hashes ``h``, and a struct ``name`` as ``scored``
    gives it, learned from the texts where ``training`` is true; ``every``: tokens of the whole table.
    For any size: the filter is built and read cell by cell. Rows equal in all of ``keep`` and the text stand in one portion."""
    spark, cells = df.sparkSession, _cells(n, order)
    least = 2 * spark.sparkContext.defaultParallelism
    count = max(1, -(-every // PORTION_TOKENS), min(least, -(-every // _CHUNK)))
    d = df.select(*keep, F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"),
                  F.pmod(F.xxhash64(*keep, text), F.lit(count)).cast("int").alias("portion"))
    dealt = d.select("text", "training", "portion").repartitionById(count, F.col("portion")).select("portion", "training", hashed(F.col("text")).alias("h"))
    answers = stored(_answers(_asks(dealt, "h", "training", cells, order), cells, bits_per_entry), f"{name}-levels")
    # a portion's levels stand before its texts
    both = d.drop("training").withColumn("grp", F.lit((1 << 63) - 1)).unionByName(answers, allowMissingColumns=True)
    both = both.repartitionById(count, F.col("portion")).sortWithinPartitions("portion", "grp")
    both = both.select("portion", "levels", *keep, tokens(F.col("text")).alias("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    table = spark.sparkContext.broadcast(frequent)

    def final(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        portion, levels, lists = None, [], []

        def done() -> Iterator[pd.DataFrame]:
            if levels:
                yield pd.DataFrame({"score": [None] * len(levels), "base": None, "known": None, "other": None})
            if lists:
                yield from _scored_portion(levels, lists, order, n, v, table.value)

        for portions, states, rows in batches:
            for p, state, row in zip(portions, states, rows):
                if p != portion:
                    yield from done()
                    portion, levels, lists = p, [], []
                if state is None:
                    lists.append(row)
                else:
                    levels.append(state)
        yield from done()

    # not deterministic: a filter must not be moved below it
    out = both.withColumn(name, F.pandas_udf(final, SCORED).asNondeterministic()(F.col("portion"), F.col("levels"), F.col("h")))
    return out.where(F.col("levels").isNull()).drop("portion", "levels")


def vocabulary(df: DataFrame, text: str, training: Column, name: str = "lm-words") -> DataFrame:
    """``(token, c, every)``: occurrences of each token in the training texts and in all;
    the end token is the empty string."""
    count = [F.sum(F.col("tr").cast("long")).alias("c"), F.count(F.lit(1)).alias("every")]
    t = text_of(text)
    plain = F.octet_length(t) == F.length(t)
    d = df.select(training.alias("tr"), plain.alias("plain"), F.when(plain, F.lower(t)).otherwise(t).alias("t"))
    # the words of ``tokens``, but lower-cased and sifted as rows, which is compiled
    w = d.select("tr", "plain", F.explode(F.split("t", SPACE)).alias("w")).where("w != ''")
    w = w.select("tr", F.when(F.col("plain"), F.col("w")).otherwise(_lowered(F.col("w"))).alias("token"))
    ends = d.agg(*count).where("every > 0").select(F.lit("").alias("token"), "c", "every")
    return stored(w.groupBy("token").agg(*count).union(ends), name)


def totals(words: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts."""
    r = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    return int(r[0]), int(r[1])


def frequent_tokens(words: DataFrame, n: int, v: int, rows: int = HEAVY_TOKENS) -> Frequent:
    """The most frequent tokens, at most ``rows`` of them: those that occur in the whole table at least as
    often as some power of two. The end token is always among them. A hash shared by
    two of them is left out, so that both count as others."""
    by = words.groupBy(F.floor(F.log2("every")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("e")).collect()  # 64 rows at most
    least, total = 1 << 62, 0
    for r in by:
        total += r["n"]
        if total > rows:
            break
        least = 1 << r["e"]
    d = words.where((F.col("every") >= least) & (F.col("token") != "")).select(F.xxhash64("token").alias("h"), "c").toPandas()
    end = words.where("token = ''").select("c").collect()
    d = d[~d["h"].duplicated(keep=False)]
    key = _mix(np.append(d["h"].to_numpy(np.int64).view(np.uint64), np.uint64(END)))
    c = np.append(d["c"].to_numpy(np.int64), end[0]["c"] if end else 0)
    order = np.argsort(key)
    return Frequent(key[order], c[order] > 0, np.log10((c[order] + ADD) / (n + ADD * (v + 1))))


def judged(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = ORDER,
           bits_per_entry: int = BITS_PER_ENTRY, frequent: int = HEAVY_TOKENS, bound: int = FILTER_BYTES) -> DataFrame:
    """Scores of every row of ``df``, learned from those where ``held_out`` is
    false: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A null text is empty (its one token is the end), a null id is a value like any other,
    and repeated rows are rows of their own. Without training texts every token has the
    probability 1 of the add-0.1 estimate. An empty table gives no rows; other columns are ignored."""
    d = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    words = vocabulary(d, "text", ~F.col("held_out"))
    n, v = totals(words)
    often = frequent_tokens(words, n, v, frequent)
    with small_batches(df.sparkSession):
        if n * order * bits_per_entry <= 8 * bound:
            model = fit(d.where(~F.col("held_out")).select(hashed(F.col("text")).alias("h")), "h", n, v, order, bits_per_entry)
            split = d.select("doc_id", "held_out", tokens(F.col("text")).alias("words"))
            out = scored(split.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h")), model, "h", "lm", often)
        else:
            every = words.agg(F.coalesce(F.sum("every"), F.lit(0))).first()[0]
            out = scored_by_portions(d, "text", ~F.col("held_out"), n, v, every, ["doc_id", "held_out"], order, bits_per_entry, "lm", often)
        # the row number is written with the row, so it stays the same from here on
        rows = stored(out.select("doc_id", "held_out", (F.size("h") + 1).cast("long").alias("n_tokens"), "lm.score", "lm.base", "lm.known",
                                 F.transform("lm.other", lambda i: F.get("words", i)).alias("other"),
                                 F.monotonically_increasing_id().alias("row")), "lm-rows")
    # the others are rare in the whole table, so no token is hot in this join
    other = rows.select("row", F.explode("other").alias("token")).join(words.select("token", "c"), "token")
    base = other.groupBy("row").agg(F.sum(F.log10((F.col("c") + ADD) / F.lit(n + ADD * (v + 1)))).alias("more"),
                                    F.count_if(F.col("c") > 0).alias("also"))
    return rows.join(base, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
