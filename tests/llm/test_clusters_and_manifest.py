"""Centroid clustering and the Merkle manifest against brute force."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from ticketlens.llm import centroids, merkle
from ticketlens.llm.queries import ORACLES


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in start[:k]]
    x = np.array([v for _, v in kept]).reshape(len(kept), 64)

    def nearest():
        d = np.stack([((x - np.array(c)) ** 2).sum(1) for c in at], 1)
        return d.argmin(1), d.min(1)

    if not at:
        return []
    for _ in range(rounds):
        a, _ = nearest()
        at = [[int(s) // int((a == j).sum()) for s in x[a == j].sum(0)] if (a == j).any() else c for j, c in enumerate(at)]
    a, d = nearest()
    code = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted([(kept[i][0], int(a[i]), int(d[i]), int(d[a == a[i]].sum()), int(d.sum()), code[a[i]]) for i in range(len(kept))], key=str)


def vectors(seed, n):
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    def f(v):
        return [float(np.float32(x)) for x in v]
    rows = [(pick.choice([None, i, 5]), f(rng.normal(size=64) * pick.choice([0.1, 1, 0]))) for i in range(n)]
    bad = [None, [], [1.0] * 63, [1.0] * 63 + [None], [1.0] * 63 + [math.nan], [1.0] * 63 + [math.inf], [1e30] * 64, [1.0] * 65]
    return rows, [(i, v) for i, v in enumerate(bad)], [(9, [0.5] * 64)] * 50


CASES = {"none": [], "three": vectors(1, 3)[0], "bad": vectors(1, 0)[1], "equal": vectors(1, 0)[2],
         "mixed": sum(vectors(2, 120), [])}


@pytest.mark.parametrize("case,chunk,widths", [
    ("none", 16_384, (8, 4, 2, 1)), ("three", 2, (8, 4, 2, 1)), ("bad", 16_384, (8, 4, 2, 1)), ("equal", 16_384, (8, 4, 2, 1)),
    ("mixed", 7, (8, 4, 2, 1)), ("mixed", 16_384, (8, 4, 2, 1)), ("mixed", 64, (5, 3))])
def test_clusters(spark, case, chunk, widths):
    rows = [r for r in CASES[case] if r[1] is None or 1e30 not in r[1]]
    df = spark.createDataFrame([(*r, "mine") for r in CASES[case]], "vec_id long, embedding array<float>, cluster string")
    got = centroids.clusters(df, chunk_rows=chunk, widths=widths).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows)


def test_dictionaries_are_lossless_and_short():
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 3, (4096, 16)).astype(np.int32)
    x[:, 8:] = x[0, 8:]
    blocks = centroids._dictionary(x, 0, (8, 4, 2, 1))
    back = np.empty_like(x)
    for name in [n for n in blocks if n[0] == "w"]:
        at, words = int(name[1:]), blocks[name]
        back[:, at:at + words.shape[1]] = words[blocks["c" + name[1:]]]
        assert 4 * len(words) <= len(x) or words.shape[1] == 1
    assert (back == x).all()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")])


def hash_tree(level):
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, a in enumerate(at):
            paths[i].append((level[a ^ 1] if a ^ 1 < len(level) else "", a & 1))
        at = [a >> 1 for a in at]
        level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def brute_manifest(rows):
    if not rows:
        return []
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {x: hash_tree([leaf(r) for r in by[x]]) for x in langs}
    root, tops = hash_tree([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops):
        for r, path in zip(by[x], trees[x][1]):
            hit = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            f = leaf(r | {"n_chars": r["n_chars"] + 1}) if hit else leaf(r)
            for sibling, right in path + top:
                f = h(sibling, f) if right else h(f, sibling)
            out.append((r["doc_id"], leaf(r), trees[x][0], root, h(*[s for s, _ in path + top]), f, f == root))
    return sorted(out, key=str)


def leaves(seed, n):
    rng = random.Random(seed)
    return [dict(doc_id=rng.choice([None, i, i, i, 7]), source=rng.choice([None, "a", "é"]), lang=rng.choice(["en", "en", "en", "fr", None, "é", "zz"]),
                 n_chars=rng.choice([None, i, 2 ** 63 - 1]), text=rng.choice([None, "", "x y", "日本", "long " * 30_000])) for i in range(n)]


@pytest.mark.parametrize("n,bits,digits", [(0, 4, 3), (1, 4, 3), (37, 1, 2), (300, 2, 1), (300, 4, 3)])
def test_manifest(spark, n, bits, digits):
    rows = leaves(n, n) + leaves(n, n // 3)  # some rows twice
    df = spark.createDataFrame([(*r.values(), "mine") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, root string")
    assert sorted(map(tuple, merkle.verified(df, bits=bits, digits=digits).collect()), key=str) == brute_manifest(rows)


def test_no_joins_with_siblings(spark):
    """Proofs come from nested structs: the last step has no join and one shuffle, of blocks."""
    nodes = spark.range(100).selectExpr("'a' tree", "id rank", "100L total", "sha2(string(id), 256) hash", "id kid")
    above = spark.range(1).selectExpr("'a' tree", "0L block", "cast(array() as array<struct<sibling:string,right:boolean>>) path", "'s' subroot", "'r' root")
    rolled = merkle.blocks_of(nodes)
    assert rolled._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    plan = merkle.proved(rolled, above)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_sql_of_both(spark):
    """The SQL against brute force too, on rows that the given tables do not have."""
    con = duckdb.connect()
    rows = leaves(3, 40)
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    rows = [r | {"n_chars": 5} if r["n_chars"] == 2 ** 63 - 1 else r for r in rows]
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r.values()) for r in rows])
    assert sorted(con.execute(ORACLES["op13_merkle_manifest"]).fetchall(), key=str) == brute_manifest(rows)
    some = [r for r in CASES["mixed"] if r[1] is None or 1e30 not in r[1]]
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in some])
    assert sorted(con.execute(ORACLES["op12_centroid_clustering"]).fetchall(), key=str) == brute_clusters(some)
