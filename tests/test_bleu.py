"""X2 BLEU-4 (unsmoothed, brevity penalty) against a brute-force computation."""

import math
import re
from collections import Counter

from ticketlens.operators.extras import corpus_bleu, sentence_bleu


def toks(s):
    return [t for t in re.split(r"[^\w]+|_", (s or "").lower()) if t]


def grams(t, n):
    return Counter(" ".join(t[i:i + n]) for i in range(len(t) - n + 1))


def brute(h, r):
    ht, rt = toks(h), toks(r)
    logs = []
    for n in range(1, 5):
        hg, rg = grams(ht, n), grams(rt, n)
        m = sum(min(c, rg[g]) for g, c in hg.items())
        tot = max(len(ht) - n + 1, 0)
        if m == 0 or tot == 0:
            return 0.0
        logs.append(math.log(m / tot))
    bp = math.exp(1 - len(rt) / len(ht)) if len(ht) < len(rt) else 1.0
    return bp * math.exp(sum(logs) / 4)


ROWS = [
    (1, "the parcel never arrived at my door", "the parcel never arrived at my door"),
    (2, "the parcel never arrived", "sorry the parcel never arrived at your door today"),
    (3, "refund please", "we will refund you"),
    (4, "my card was charged twice for one order today",
     "we see the card was charged twice for one order and will fix it"),
    (5, "", "hello there"),
    (6, "completely unrelated words here", "nothing in common at all"),
]


def test_sentence_bleu_vs_brute_force(spark):
    df = spark.createDataFrame(ROWS, "id long, hyp string, ref string")
    got = {r.id: r.bleu for r in sentence_bleu(df, "id", "hyp", "ref").collect()}
    for i, h, r in ROWS:
        assert abs(got[i] - brute(h, r)) < 1e-12, (i, got[i], brute(h, r))
    assert got[1] == 1.0 and got[5] == 0.0


def test_corpus_bleu_vs_brute_force(spark):
    df = spark.createDataFrame(ROWS, "id long, hyp string, ref string")
    m = [0] * 4
    t = [0] * 4
    hl = rl = 0
    for _, h, r in ROWS:
        ht, rt = toks(h), toks(r)
        hl += len(ht)
        rl += len(rt)
        for n in range(1, 5):
            hg, rg = grams(ht, n), grams(rt, n)
            m[n - 1] += sum(min(c, rg[g]) for g, c in hg.items())
            t[n - 1] += max(len(ht) - n + 1, 0)
    bp = math.exp(1 - rl / hl) if hl < rl else 1.0
    exp = bp * math.exp(sum(math.log(a / b) for a, b in zip(m, t)) / 4)
    got = corpus_bleu(df, "id", "hyp", "ref").first()
    assert abs(got.bleu - exp) < 1e-12 and got.hyp_len == hl and got.ref_len == rl
