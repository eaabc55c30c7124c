import numpy as np
import pytest

from ticketlens.operators import metrics as M
from ticketlens.operators.judge import quadratic_kappa


def frame(spark, t, p):
    return spark.createDataFrame(list(zip(t, p)), "y_true string, y_pred string")


def test_fnr_basic(spark):
    t = ["ESCALATE"] * 3 + ["AUTO_REPLY"] * 3
    p = ["ESCALATE", "AUTO_REPLY", "AUTO_REPLY", "AUTO_REPLY", "AUTO_REPLY", "ESCALATE"]
    r = M.escalation_matrix(frame(spark, t, p), "y_true", "y_pred").first()
    assert (r.fnr, r.fn, r.tp, r.fp, r.tn, r.total_true_escalations) == (2 / 3, 2, 1, 1, 2, 3)


def test_fnr_zero_and_perfect(spark):
    r = M.escalation_matrix(frame(spark, ["AUTO_REPLY"] * 2, ["ESCALATE", "AUTO_REPLY"]), "y_true", "y_pred").first()
    assert r.fnr == 0.0 and r.total_true_escalations == 0
    r = M.escalation_matrix(frame(spark, ["ESCALATE"], ["ESCALATE"]), "y_true", "y_pred").first()
    assert (r.tn, r.fp, r.fn, r.tp) == (0, 0, 0, 1)
    r = M.escalation_matrix(frame(spark, ["ESCALATE"], ["maybe"]), "y_true", "y_pred").first()
    assert r.fn == 1  # unknown decision counts as AUTO_REPLY


def sk_report(t, p):
    labels = sorted(set(t) | set(p))
    out = {}
    for lab in labels:
        tp = sum(a == lab and b == lab for a, b in zip(t, p))
        fp = sum(a != lab and b == lab for a, b in zip(t, p))
        fn = sum(a == lab and b != lab for a, b in zip(t, p))
        pr = tp / (tp + fp) if tp + fp else 0.0
        rc = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        out[lab] = (pr, rc, f1, tp + fn)
    return out


@pytest.mark.parametrize("t,p", [
    (["a", "a", "b", "b", "c"], ["a", "b", "b", "a", "c"]),
    (["a"], ["b"]),
    (["a", "b", "b"], ["a", "b", "z"]),
])
def test_class_report_vs_brute_force(spark, t, p):
    rep = {r.label: (r.precision, r.recall, r.f1, r.support)
           for r in M.class_report(frame(spark, t, p), "y_true", "y_pred").collect()}
    exp = sk_report(t, p)
    assert rep.keys() == exp.keys()
    for k in exp:
        assert rep[k] == pytest.approx(exp[k])
    mac = M.macro_avg(M.class_report(frame(spark, t, p), "y_true", "y_pred")).first()
    assert mac.macro_f1 == pytest.approx(np.mean([v[2] for v in exp.values()]))


def test_align_mismatch_raises(spark):
    a = spark.createDataFrame([(1,)], "test_id int")
    b = spark.createDataFrame([(1,), (2,)], "test_id int")
    with pytest.raises(ValueError):
        M.align(a, b)


def kappa_brute(a, b):
    labels = sorted(set(a) | set(b))
    ix = {v: i for i, v in enumerate(labels)}
    n = len(labels)
    O = np.zeros((n, n))
    for x, y in zip(a, b):
        O[ix[x], ix[y]] += 1
    W = np.array([[(i - j) ** 2 for j in range(n)] for i in range(n)], float)
    E = np.outer(O.sum(1), O.sum(0)) / O.sum()
    den = (W * E).sum()
    return None if den == 0 else 1 - (W * O).sum() / den


@pytest.mark.parametrize("a,b", [
    ([1, 2, 3, 4, 5, 3], [1, 2, 3, 4, 5, 3]),
    ([1, 3, 5, 5, 1], [3, 3, 5, 1, 1]),
    ([4, 4, 4], [1, 3, 5]),
    ([2, 2], [2, 2]),
    ([1, 2, 3, 5, 5, 4, 2], [2, 2, 3, 4, 5, 5, 1]),
])
def test_kappa_vs_brute_force(spark, a, b):
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    got = quadratic_kappa(df, "a", "b").first().kappa
    exp = kappa_brute(a, b)
    if exp is None:
        assert got is None
    else:
        assert got == pytest.approx(exp)
