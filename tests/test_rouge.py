"""X3 ROUGE-L: the bit-parallel LCS against the plain DP, and the Spark
operator against a brute-force score on a small fixture."""

import random

from ticketlens.operators.extras import corpus_rouge_l, lcs_length, rouge_l


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[-1]))
        prev = cur
    return prev[-1]


def test_lcs_matches_dp():
    rng = random.Random(7)
    for _ in range(2000):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 50))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 90))]
        assert lcs_length(a, b) == lcs_dp(a, b)


def test_lcs_long_texts():
    rng = random.Random(3)
    a = [rng.choice("abcdefgh") for _ in range(700)]
    b = [rng.choice("abcdefgh") for _ in range(900)]
    assert lcs_length(a, b) == lcs_dp(a, b)


def brute(h, r):
    ht = [t for t in "".join(c if c.isalnum() else " " for c in (h or "").lower()).split()]
    rt = [t for t in "".join(c if c.isalnum() else " " for c in (r or "").lower()).split()]
    lcs = lcs_dp(ht, rt)
    p = lcs / len(ht) if ht else 0.0
    rc = lcs / len(rt) if rt else 0.0
    f = 2 * p * rc / (p + rc) if lcs else 0.0
    return lcs, p, rc, f


def test_rouge_l_operator(spark):
    rows = [
        (1, "my parcel never arrived", "sorry your parcel never arrived, we will check"),
        (2, "refund please", "we issued the refund"),
        (3, "", "hello"),
        (4, None, None),
        (5, "same words here", "same words here"),
        (6, "completely different", "nothing shared"),
    ]
    df = spark.createDataFrame(rows, "id long, hyp string, ref string")
    got = {r.id: r for r in rouge_l(df, "id", "hyp", "ref").collect()}
    for i, h, r in rows:
        lcs, p, rc, f = brute(h, r)
        g = got[i]
        assert g.lcs == lcs
        assert abs(g.rouge_l_p - p) < 1e-12 and abs(g.rouge_l_r - rc) < 1e-12
        assert abs(g.rouge_l_f - f) < 1e-12
    c = corpus_rouge_l(df, "id", "hyp", "ref").first()
    assert c.pairs == 6 and abs(c.rouge_l_f - sum(brute(h, r)[3] for _, h, r in rows) / 6) < 1e-12
