"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded
(character classes, word lengths, repetition), embedded by a small layer, and
weighed by a gated attention, softmax over the bag of ``w . (tanh(V h) * sigmoid(U h))``.
The weighted passage representation is scored. Only document labels are used;
the attention learns which passages decide.

Training takes a bounded sample of labelled documents (their encoded passages,
not their texts, reach the driver). Scoring is a projection beside the scan;
documents are encoded in chunks of about ``CHUNK`` bytes, whole texts, every passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import stored, text_of

PASSAGE = 50
CHUNK = 1 << 20
SAMPLE_ROWS = 6000       # labelled documents, about, that are trained on
EMBED, GATE = 16, 8
BATCH = 256              # documents a training step sees
STEPS, EPOCHS = 400, 12  # at least so many steps and so many passes over the sample
RATE = 0.02

# Character classes of bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 line feed,
# 5 sentence mark, 6 shout mark, 7 symbol, 8 bar, 9 other punctuation, 10 beyond ASCII.
_CLASS = np.full(256, 9, np.int64)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2),
                   (" \t\r\x0b\x0c", 3), ("\n", 4), (".,;:", 5), ("!?", 6), ("#$%&*<>=+^~@\\_", 7), ("|", 8)):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[128:] = 10
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.array([pow(31, i, 1 << 32) for i in range(64)], np.int64)
N_FEATURES = 17


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of several texts: features (a row each) and the index of the
    text of each. An empty or wordless text is one passage of zeros."""
    # outer white space is no part of any passage (it would count with the neighbour's)
    raw = [t.encode("utf-8", "replace").strip() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    size = np.array([len(r) + 1 for r in raw])
    doc_at = np.concatenate([[0], np.cumsum(size)[:-1]])
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)                      # of words
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    doc = np.searchsorted(doc_at, starts, side="right") - 1
    words_of = np.bincount(doc, minlength=len(raw))
    nth = np.arange(len(starts)) - np.concatenate([[0], np.cumsum(words_of)[:-1]])[doc]
    passages = np.maximum(1, -(-words_of // PASSAGE))
    offset = np.concatenate([[0], np.cumsum(passages)[:-1]])
    bag = np.repeat(np.arange(len(raw)), passages)
    own = offset[doc] + nth // PASSAGE                  # passage of each word
    n = int(passages.sum())
    x = np.zeros((n, N_FEATURES))
    if not len(starts):
        return x, bag
    # bytes up to the next word belong to the word's passage
    span = np.diff(np.append(starts, len(data)))
    at = np.repeat(own, span)
    kinds = np.bincount(at * 11 + _CLASS[data[starts[0]:]], minlength=n * 11).reshape(n, 11).astype(float)
    words = np.bincount(own, minlength=n).astype(float)
    length = ends - starts
    chars = np.maximum(kinds[:, [0, 1, 2, 5, 6, 7, 8, 9, 10]].sum(axis=1), 1)
    x[:, 0] = kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    for j, k in enumerate((2, 5, 6, 7, 8, 9, 10), 1):
        x[:, j] = np.sqrt(kinds[:, k] / chars)
    x[:, 8] = kinds[:, 4] / np.maximum(words, 1)
    x[:, 9] = np.bincount(own, length, minlength=n) / np.maximum(words, 1) / 10
    x[:, 10] = np.log1p(words) / 4
    # words as numbers, for repetition
    body = data[starts[0]:].astype(np.int64)
    pos = np.minimum(np.arange(len(body)) - np.repeat(starts - starts[0], span), 63)
    inside = ~space[starts[0]:]
    value = np.add.reduceat(np.where(inside, (body + 1) * _POWERS[pos], 0), starts - starts[0])
    same = np.zeros(len(starts))
    same[1:] = (value[1:] == value[:-1]) & (own[1:] == own[:-1])
    x[:, 11] = np.bincount(own, same, minlength=n) / np.maximum(words, 1)
    order = np.lexsort((value, own))
    new = np.ones(len(order), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (own[order][1:] != own[order][:-1])
    x[:, 12] = np.bincount(own[order][new], minlength=n) / np.maximum(words, 1)
    x[:, 13] = (words > 0) & (words < 20)
    x[:, 14] = np.bincount(own, length == 1, minlength=n) / np.maximum(words, 1)
    x[:, 15] = np.bincount(own, length > 20, minlength=n) / np.maximum(words, 1)
    x[:, 16] = words > 0
    return x, bag


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


class Model:
    """Scale of the features and the weights of embedding, gates and score."""

    def __init__(self, mean, scale, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.w = mean, scale, weights

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        w = self.w
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        a = (v * u) @ w["a"]
        start = np.searchsorted(bag, np.arange(bags))  # bags are runs of at least one passage
        weight = np.exp(a - np.maximum.reduceat(a, start)[bag])
        weight /= np.add.reduceat(weight, start)[bag]
        m = np.add.reduceat(weight[:, None] * h, start, axis=0)
        p = 1 / (1 + np.exp(-np.clip(m @ w["s"] + w["b"], -30, 30)))
        return {"z": z, "h": h, "v": v, "u": u, "weight": weight, "m": m, "p": p}

    def scores(self, texts: list[str]) -> np.ndarray:
        out = []
        for part in _chunks(texts):
            x, bag = encode(part)
            out.append(self.forward(x, bag, len(part))["p"])
        return np.concatenate(out) if out else np.zeros(0)


def _batches(x: np.ndarray, bag: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Iterator[tuple]:
    """Passages, bag numbers and labels of ``BATCH`` bags at a time, in a new order each pass."""
    start = np.searchsorted(bag, np.arange(len(y) + 1))
    parts = -(-len(y) // BATCH)
    for _ in range(max(EPOCHS, -(-STEPS // parts))):
        for some in np.array_split(rng.permutation(len(y)), parts):
            rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in some])
            yield x[rows], np.repeat(np.arange(len(some)), start[some + 1] - start[some]), y[some]


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Adam on the cross entropy of the bags' labels, in batches of bags. With one
    label only (or none) the model scores every text with the share of label 1."""
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(f), np.ones(f))
    w = {"E": rng.normal(0, f ** -0.5, (f, EMBED)), "e": np.zeros(EMBED), "V": rng.normal(0, EMBED ** -0.5, (EMBED, GATE)),
         "U": rng.normal(0, EMBED ** -0.5, (EMBED, GATE)), "a": rng.normal(0, GATE ** -0.5, GATE), "s": np.zeros(EMBED), "b": np.zeros(1)}
    model = Model(mean, scale, w)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w["b"][:] = np.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return model
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for t, (xs, bag, y) in enumerate(_batches(x, bag, y, rng), 1):
        o = model.forward(xs, bag, len(y))
        d = (o["p"] - y) / len(y)
        g = {"s": o["m"].T @ d + 1e-4 * w["s"], "b": np.array([d.sum()])}
        dm = (d[:, None] * w["s"][None, :])[bag]
        dweight = (dm * o["h"]).sum(axis=1)
        mean_d = np.bincount(bag, o["weight"] * dweight, minlength=len(y))
        da = o["weight"] * (dweight - mean_d[bag])
        g["a"] = (o["v"] * o["u"]).T @ da
        dv = da[:, None] * w["a"] * o["u"] * (1 - o["v"] ** 2)
        du = da[:, None] * w["a"] * o["v"] * o["u"] * (1 - o["u"])
        g["V"], g["U"] = o["h"].T @ dv, o["h"].T @ du
        dh = o["weight"][:, None] * dm + dv @ w["V"].T + du @ w["U"].T
        dz = dh * (1 - o["h"] ** 2)
        g["E"], g["e"] = o["z"].T @ dz, dz.sum(axis=0)
        for k in w:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            w[k] -= RATE * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    return model


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        rows: int = SAMPLE_ROWS) -> Model:
    """Train on about ``rows`` labelled documents, drawn by a hash of the text, a
    row per distinct text (the larger label of a text with several)."""
    lab = labels.select(F.col(key).alias("__id"), F.col(label).alias("label")).where(F.col("label").isNotNull())
    share = int(min(1.0, rows / max(1, lab.count())) * (1 << 20))
    drawn = df.select(F.col(key).alias("__id"), text_of(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share)
    sample = stored(drawn.join(lab, "__id").groupBy("text").agg(F.max("label").alias("label")), "quality-sample")

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            xs = []
            for part in _chunks(d["text"].tolist()):
                x, bag = encode(part)
                xs += [x[bag == i].ravel().tolist() for i in range(len(part))]
            yield pd.DataFrame({"x": xs, "y": d["label"].astype("float64")})

    got = sample.select("text", "label").mapInPandas(encoded, "x array<double>, y double").toPandas()  # bounded by the sample
    got = got.assign(k=[tuple(x[:N_FEATURES]) + (len(x),) for x in got["x"]]).sort_values(["k", "y"])  # one order whatever the tasks
    x = [np.array(v).reshape(-1, N_FEATURES) for v in got["x"]]
    bag = np.repeat(np.arange(len(x)), [len(v) for v in x]) if x else np.zeros(0, int)
    return train(np.concatenate(x) if x else np.zeros((0, N_FEATURES)), bag, got["y"].to_numpy())


def scored(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the quality score of each whole text (0 to 1). A null or
    empty text is one passage of zeros; repeated rows and extra columns pass
    through; an empty table stays empty. A column ``name`` of ``df`` is replaced."""
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([t or "" for t in texts]), dtype="float64")

    return df.withColumn(name, F.pandas_udf(f, "double")(F.col(text)))
