"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, the words of a clause become symbols - insult,
threat, target, negation, report, other - and a transducer composed of one
small machine per pattern reads them once, left to right. Its states are pairs
of distances (to the last target, negation, modal and report); its output is
the kind and weight of each matched pattern:

    plain     an insult
    targeted  an insult with a target up to three words before or after it
    threat    a target or modal, then a word of violence and a target
    negated   an insult up to three words after a negation
    reported  an insult after a word of reporting in the same clause

A document is scored on its strongest and on the number of its matched clauses
of each kind, by weights fitted to labelled documents. The insults are learned:
words, and word beginnings, that occur in toxic documents only, in more of them
than chance allows among all the words tried. Texts that are copies or (by one
min-hash) near copies of each other are learned from once.

Everything learned is bounded: about ``SAMPLE_ROWS`` labelled documents, drawn
by hash. Scoring is a projection beside the scan with a few hundred entries in memory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import stored, text_of

SAMPLE_ROWS = 20_000     # labelled documents, about, that are learned from
MIN_DOCS = 4             # toxic documents that a learned entry needs at least
CHANCE = 0.01            # expected entries that pass by chance
PRECISION = 0.95         # share of toxic documents among those with the entry
BEGINNINGS = (3, 4, 5, 6, 7, 8)  # lengths of word beginnings that may be learned
REACH = 3
KINDS = ("plain", "targeted", "threat", "negated", "reported")

TARGETS = frozenset("you your he she they them him her this that these those it du ihr sie er tu vous il elle ils tú usted él ella ellos".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't nicht kein keine nie pas jamais ne nunca ni".split())
REPORTS = frozenset("said says say called calls wrote quoted claimed claims told reported sagte nannte dit écrit dijo llamó".split())
MODALS = frozenset("will shall going gonna should must werde werden vais voy".split())
VIOLENCE = frozenset("kill hurt beat shoot stab murder destroy burn töten schlagen tuer frapper matar golpear".split())
CLAUSE = re.compile(r"[.,;:!?\n]+")
EDGES = "\"'()[]{}«»“”„‘’*_~<>|#$%&^+=/-"


class Lexicon:
    """Weights of insults: whole words, and beginnings of words."""

    def __init__(self, words: dict[str, float] | None = None, beginnings: dict[str, float] | None = None):
        self.words, self.beginnings = dict(words or {}), dict(beginnings or {})
        self.heads = {e[:3] for e in (*self.words, *self.beginnings)}

    def weight(self, word: str) -> float:
        """Weight of a bare word; 0 if it is no insult."""
        w = self.words.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) > n:
                w = max(w, self.beginnings.get(word[:n], 0.0))
        return w


def _bare(word: str) -> str:
    return word.strip(EDGES)


def parse(clause: list[str], lexicon: Lexicon) -> list[tuple[str, float]]:
    """(kind, weight) of the patterns of one clause of bare, lower-case words:
    one run of the composed transducer. An insult is held back for ``REACH``
    words, as a target may follow it."""
    out: list[tuple[str, float]] = []
    target = negation = modal = violence = -REACH - 1   # positions last seen
    reported, held = False, []                          # held: (position, weight) of open insults
    for i, word in enumerate(clause):
        for at, w in [h for h in held if i - h[0] > REACH]:
            out.append(("plain", w))
            held.remove((at, w))
        if word in TARGETS:
            out += [("targeted", w) for _, w in held]
            held = []
            if i - violence <= REACH and (violence - modal <= REACH and modal >= 0 or violence - target <= REACH and target >= 0):
                out.append(("threat", 1.0))
                violence = -REACH - 1
            target = i
        if word in NEGATIONS:
            negation = i
        if word in REPORTS:
            reported = True
        if word in MODALS:
            modal = i
        if word in VIOLENCE:
            violence = i
        w = lexicon.weight(word)
        if w > 0:
            if i - negation <= REACH and negation >= 0:
                out.append(("negated", w))
            elif reported:
                out.append(("reported", w))
            elif i - target <= REACH and target >= 0:
                out.append(("targeted", w))
            else:
                held.append((i, w))
    return out + [("plain", w) for _, w in held]


def matches(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """For each kind: the weight of the strongest match, and the logarithm of
    one plus the number of matches. Only clauses with a word of the lexicon
    (judged by its first letters) or of violence are parsed."""
    strongest, count = np.zeros(len(KINDS)), np.zeros(len(KINDS))
    heads = lexicon.heads | {v[:3] for v in VIOLENCE}
    for clause in CLAUSE.split((text or "").lower()):
        words = clause.split()
        if any(w[:3] in heads or w[0] in EDGES for w in words):
            for kind, weight in parse([_bare(w) for w in words], lexicon):
                k = KINDS.index(kind)
                strongest[k] = max(strongest[k], weight)
                count[k] += 1
    return np.concatenate([strongest, np.log1p(count)])


class Model:
    """Lexicon, and weights of a logistic score of the matches (bias first)."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + matches(text, self.lexicon) @ self.weights[1:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _units(text: str) -> set[str]:
    """Words of a text and, marked by ``*``, beginnings of its words."""
    words = {_bare(w) for w in CLAUSE.sub(" ", text.lower()).split()}
    words.discard("")
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


def sample_of(df: DataFrame, labels: DataFrame, rows: int, text: str, key: str, label: str) -> DataFrame:
    """About ``rows`` labelled rows, drawn by a hash of the text, a row per text
    (near copies, that share the smallest hash of five words, count once): ``text``, ``label``."""
    lab = labels.select(F.col(key).alias("__id"), F.col(label).alias("label")).where(F.col("label").isNotNull())
    n = lab.count()
    share = int(min(1.0, rows / max(1, n)) * (1 << 20))
    drawn = df.select(F.col(key).alias("__id"), text_of(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share)
    words = F.col("__w")
    fives = F.when(F.size(words) > 4, F.array_min(F.transform(
        F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(F.slice(words, i + 1, 5))))).otherwise(F.xxhash64("text"))
    one = (drawn.join(lab, "__id").withColumn("__w", F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))
           .select("text", "label", fives.alias("like")))
    # of texts alike the smallest, toxic if any is
    return stored(one.groupBy("like").agg(F.min("text").alias("text"), F.max("label").alias("label")).drop("like"), "toxic-sample")


def learn_lexicon(sample: DataFrame, precision: float = PRECISION) -> Lexicon:
    """Words and beginnings that only toxic documents of a bounded sample hold.
    A beginning replaces all longer entries that start with it."""
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not 0 < share < 1:
        return Lexicon()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic: Counter = Counter()
        for d in batches:
            for t in d["text"]:
                toxic.update(_units(t))
        yield pd.DataFrame(list(toxic.items()), columns=["unit", "toxic"])

    # toxic documents by entry, then how often those entries occur elsewhere
    counted = sample.where("label = 1").mapInPandas(count, "unit string, toxic long") \
        .groupBy("unit").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= MIN_DOCS)
    wanted = stored(counted, "toxic-units")
    clean = (sample.where("label = 0").mapInPandas(lambda b: _clean_counts(b), "unit string, n long")
             .groupBy("unit").agg(F.sum("n").alias("clean")))
    tried = max(1, wanted.count())
    least = max(MIN_DOCS, math.log(CHANCE / tried) / math.log(share))
    good = (wanted.join(clean, "unit", "left").select("unit", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))
            .where((F.col("toxic") >= least) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean"))))
            .toPandas())  # bounded by the sample
    words, beginnings = {}, {}
    # most documents first; of equals the longer entry
    order = sorted(good.itertuples(), key=lambda r: (-r.toxic, -len(r.unit), r.unit))
    for r in order:
        bare = r.unit.rstrip("*")
        if any(bare[:n] in beginnings for n in BEGINNINGS if n <= len(bare)):
            continue
        p = (r.toxic + 0.5) / (r.toxic + r.clean + 1)
        (beginnings if r.unit[-1] == "*" else words)[bare] = math.log(p / (1 - p))
    return Lexicon(words, beginnings)


def _clean_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    every: Counter = Counter()
    for d in batches:
        for t in d["text"]:
            every.update(_units(t))
        if len(every) > 200_000:  # sums of parts, so that a task holds no whole vocabulary
            yield pd.DataFrame(list(every.items()), columns=["unit", "n"])
            every = Counter()
    yield pd.DataFrame(list(every.items()), columns=["unit", "n"])


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
        rows: int = SAMPLE_ROWS) -> Model:
    """Learn the lexicon and the weights from about ``rows`` labelled documents.
    Without labelled toxic documents every text scores near 0."""
    sample = sample_of(df, labels, rows, text, key, label)
    lexicon = learn_lexicon(sample)

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({"x": [matches(t, lexicon).tolist() for t in d["text"]], "y": d["label"].astype("int64")})

    rows_ = sample.mapInPandas(matched, "x array<double>, y long").toPandas()  # bounded by the sample
    x = np.array(rows_["x"].tolist()).reshape(len(rows_), 2 * len(KINDS))
    return Model(lexicon, _logistic(x, rows_["y"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps, bias first; the weights of
    matches are kept from below at 0."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    if not len(y) or y.max() == 0:
        w[0] = -5.0
        return w
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    reg = np.full(a.shape[1], ridge * 10)
    reg[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(reg)
        step = np.linalg.solve(h, a.T @ (y - p) - reg * w)
        w = w + np.clip(step, -5, 5)
        w[1:] = np.maximum(w[1:], 0)
    return w


def scored(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the toxicity score of each whole text (0 to 1). A null text
    scores as an empty one; repeated rows and extra columns pass through; an empty table
    stays empty. A column ``name`` of ``df`` is replaced."""
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return df.withColumn(name, F.pandas_udf(f, "double")(F.col(text)))


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder
