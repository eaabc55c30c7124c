"""Language-model scores against dictionaries of exact counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import lm_bloom
from ticketlens.llm.toxicity import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
START, END = 0, None
ROWS = "doc_id long, text string, score string, row int"


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(lm_bloom.UPPER, lm_bloom.LOWER))) + [END]


def is_held(key):
    return zlib.crc32(str("" if key is None else key).encode()) % 10 == 0


def brute(rows, order):
    """The contract's columns; counts quantised on the same scale, without a filter."""
    counts = [Counter() for _ in range(order + 1)]
    for key, text in rows:
        if not is_held(key):
            x = [START] * (order - 1) + words(text)
            for k in range(1, order + 1):
                counts[k].update(tuple(x[j - k + 1:j + 1]) for j in range(order - 1, len(x)))
            for k in range(1, order):
                counts[k][(START,) * k] += 1
    known = {g: c for g, c in counts[1].items() if g != (START,)}
    n, v = sum(known.values()), len(known)
    first, value = lm_bloom.scale_of(1 << 50), lm_bloom.level_values()

    def level(g):
        return int(np.searchsorted(first, counts[len(g)][g], side="right"))

    out = []
    for key, text in rows:
        x, base, score, seen = [START] * (order - 1) + words(text), 0.0, 0.0, 0
        for j in range(order - 1, len(x)):
            c = known.get((x[j],), 0)
            base += math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            seen += c > 0
            p = (value[level((x[j],))] + 0.1) / (n + 0.1 * (v + 1))
            for k in range(2, order + 1):
                gram, history = tuple(x[j - k + 1:j + 1]), tuple(x[j - k + 1:j])
                here = min(level(gram), level(gram[1:]), level(history))
                p = (value[here] + lm_bloom.PRIOR * p) / (value[level(history)] + lm_bloom.PRIOR)
            score += math.log10(min(p, 1.0))
        out.append((key, is_held(key), len(words(text)), seen, n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def judged(spark, rows, **options):
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], ROWS)
    out = lm_bloom.judged(df, held_out(F.col("doc_id"), 10, 0), **options).collect()
    return sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                   for r in out], key=str)


@pytest.fixture(scope="module")
def rows():
    """Null and repeated ids, null, empty and very long texts, repeated rows, a word of held-out texts only."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeioustA") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    texts = [None, "", " \n", "x", *[" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(8)]]
    out = [(rng.choice([None, i, i, i, 11]), rng.choice(texts)) for i in range(300)]
    return out + [(999, "İé word " * 3000)] * 2 + [(i, "unheard of") for i in range(2000) if is_held(i)]


# at 48 bits an entry a false positive is not to be expected among these few thousand n-grams
@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_dictionaries(spark, rows, order):
    assert judged(spark, rows, order=order, bits_per_entry=48) == brute(rows, order)


def test_a_filter_in_parts_and_few_frequent_tokens_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(lm_bloom, "CELL_GRAMS", 300)
    assert judged(spark, rows, bits_per_entry=48, bound=20_000, frequent=20) == brute(rows, 2)


def test_empty_and_untrained(spark):
    assert judged(spark, []) == []
    alone = next(i for i in range(100) if is_held(i))
    assert judged(spark, [(alone, "a b"), (alone, None)]) == [(alone, True, 1, 0, 0, 0.0, 0.0), (alone, True, 3, 0, 0, 0.0, 0.0)]


def test_false_positives_are_few():
    """Ten bits an entry: absent n-grams pass for present in under 2 percent, present ones never for absent."""
    rng = np.random.default_rng(0)
    g = rng.integers(0, 1 << 62, 40_000).astype(np.uint64)
    counts = rng.geometric(0.4, 20_000)
    entries, bits = lm_bloom.cell_filter(g[:20_000], counts)
    part = lm_bloom.Part(1, 0, 1, np.zeros(1, np.int64), np.array([len(bits) * 8], np.uint64), bits)
    true = np.searchsorted(lm_bloom.scale_of(100), counts, side="right")
    found = part.levels(g, np.zeros(len(g), np.uint8))
    assert entries == true.sum()
    assert (found[:20_000] >= true).all() and (found[:20_000] > true).mean() < 0.02
    assert (found[20_000:] > 0).mean() < 0.02


def test_scale_of_counts():
    first = lm_bloom.scale_of(1000)
    assert first[:6].tolist() == [1, 2, 3, 4, 6, 8]
    value = lm_bloom.level_values()
    assert value[:5].tolist() == [0, 1, 2, 3, 4.5]
    assert (np.diff(lm_bloom.scale_of(1 << 50)) > 0).all() and len(value) < lm_bloom.LEVELS


def test_context_helps_on_held_out_texts(spark, prose):
    """Texts drawn from a chain of words: the model must beat the base score where it has not learned."""
    rng = random.Random(8)
    vocabulary = prose(1, 60)
    after = {w: rng.sample(vocabulary, 4) for w in vocabulary}

    def text():
        out = [rng.choice(vocabulary)]
        while len(out) < 80:
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    out = [r for r in judged(spark, [(i, text()) for i in range(400)]) if r[1]]
    assert len(out) > 20 and all(r[6] > 0.75 * r[5] for r in out)


def test_frequent_tokens_are_not_probed_again():
    """Levels that are given are taken as they are; only the other tokens, and longer n-grams, are read from the filter."""
    rng = np.random.default_rng(3)
    g = np.sort(rng.integers(0, 1 << 62, 600).astype(np.uint64))
    entries, bits = lm_bloom.cell_filter(g, rng.geometric(0.1, 600), bits_per_entry=48)
    part = lm_bloom.Part(1, 0, 1, np.zeros(1, np.int64), np.array([len(bits) * 8], np.uint64), bits)
    often = lm_bloom.Frequent(g[:400:2], np.ones(200, bool), np.zeros(200), part.levels(g[:400:2], np.zeros(200, np.uint8)))
    u, codes = g[rng.permutation(400)], rng.integers(0, 400, 1000)
    longer = g[400:][rng.permutation(200)], rng.integers(0, 200, 1000)
    found, state = [(codes, u), longer[::-1]], np.zeros((2, 1000), np.uint8)
    probed = []

    class Watched(lm_bloom.Part):
        def levels(self, g, known):
            probed.extend(g.tolist())
            return super().levels(g, known)

    at, hit = often.find(u)
    out = lm_bloom._found(Watched(**vars(part)), found, state, (often.level[at], hit))
    assert (out == lm_bloom._found(part, found, state)).all() and out.max() > 8
    assert sorted(probed) == sorted([*g[1:400:2].tolist(), *g[400:].tolist()])


def test_vocabulary_has_the_words_of_tokens(spark):
    texts = ["Ab\tAB  ab\x0bÉcole ÉCOLE\n", "ÄÖ ab ab İX", "", None, " \r\n", "x" * 3 + "\x0cY"]
    df = spark.createDataFrame([(t, i % 2 == 0) for i, t in enumerate(texts)], "text string, tr boolean")
    got = {r.token: (r.c, r.every) for r in lm_bloom.vocabulary(df, "text", F.col("tr")).collect()}
    every, c = Counter(), Counter()
    for i, t in enumerate(texts):
        x = ["" if w is END else w for w in words(t)]
        every.update(x)
        c.update(x if i % 2 == 0 else [])
    assert got == {w: (c[w], every[w]) for w in every}
    assert lm_bloom.vocabulary(df.limit(0), "text", F.col("tr")).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_portions_score_as_the_broadcast_filter_and_store_no_texts(spark, rows, order, monkeypatch):
    """A filter too large to broadcast is built and read by cells: the same scores, false positives included, and
    nothing that holds the texts is stored on the way."""
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], ROWS)
    whole = judged(spark, rows, order=order, bits_per_entry=5)
    stored, tables = lm_bloom.stored, []
    monkeypatch.setattr(lm_bloom, "stored", lambda d, name: tables.append((name, dict(d.dtypes))) or stored(d, name))
    for name, value in (("CELL_GRAMS", 300), ("PORTION_TOKENS", 2000), ("_CHUNK", 500), ("GROUP_CELLS", 3)):
        monkeypatch.setattr(lm_bloom, name, value)
    few = judged(spark, rows, order=order, bits_per_entry=5, bound=1 << 30)
    parts = judged(spark, rows, order=order, bits_per_entry=5, bound=1, frequent=20)
    assert parts == few and few != whole  # other cells, other false positives
    assert judged(spark, rows, order=order, bits_per_entry=48, bound=1) == brute(rows, order)
    assert {name for name, _ in tables} == {"lm-words", "lm-filter", "lm-levels", "lm-rows"}
    assert not any({"text", "words", "h"} & set(kinds) for _, kinds in tables)
    assert lm_bloom.judged(df.limit(0), held_out(F.col("doc_id"), 10, 0), bound=-1).count() == 0
