"""Quality rules, mixing, sharding and URL filter against brute force."""

import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import mixing, quality_rules, sharding, urlfilter
from ticketlens.llm.queries import ORACLES, QUERIES, URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_signals(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_quality_signals(docs_of, prose):
    loop = " ".join(prose(1, 12))
    texts = [None, "", " \t\n", "one", "a # b | c\n\na # b | c\n\x1c x　y", " ".join(prose(2, 60)),
             " ".join([loop] * 9), loop + " " + " ".join(prose(3, 50)) + " " + loop, "w " * 5000, "é😀 " * 30,
             "\n".join(" ".join(prose(4, 9)) for _ in range(6))]
    out = quality_rules.clean(docs_of(texts + texts)).orderBy("doc_id").collect()
    assert len(out) == 2 * len(texts)
    for r in out:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute_signals(r.text), r.text
        assert r.shard.startswith("x")  # extra columns pass through


def test_line_rules(docs_of, prose):
    good = " ".join(prose(5, 40)) + "."
    menu, symbols, shout = "home | news | sport | about | mail", "a### b$$$ c%%% d&&& e*** f###", "BUY!! NOW!! CHEAP!! ALL!!"
    texts = [good, good + "\nAll rights reserved.", menu + "\n" + good, "\n".join([symbols] * 6 + [shout] * 6 + [good[:60]])]
    out = quality_rules.clean(docs_of(texts)).orderBy("doc_id").collect()
    assert [r.n_removed for r in out] == [0, 1, 1, 12]
    assert [r.kept for r in out] == [True, True, True, False]
    assert out[1].clean_text == out[2].clean_text == good
    assert quality_rules.clean(docs_of(texts)).limit(0).count() == 0


def test_separators_in_prose_are_no_menu(docs_of, prose):
    def words(i, n=25):
        return " ".join(prose(i, n))
    french = f"{words(30)} « {words(31, 4)} » {words(32)} « {words(33, 2)} », {words(34)} « {words(35, 3)} » {words(36)}."
    german = f"{words(40)} »{words(41, 4)}« {words(42)} »{words(43, 2)}«, {words(44)} »{words(45, 3)}« {words(46)}."
    quoted = "« oui », « non », « si », « peut-être », ‹ ja ›, ‹ nein ›, ‹ doch › et »so«, »nun«, »ja«"
    far = f"{words(50, 60)} · {words(51, 60)} | {words(52, 60)} • {words(53, 60)}"
    loud = f"{words(60, 60)}!! {words(61, 60)}?! {words(62, 60)}!! {words(63, 60)}"
    table = "| name | size | price |"
    good = " ".join(prose(64, 60))
    clean = [french, german, f"{good} {quoted}", f"{good}\n{quoted}", far, loud, f"{good}\n{table}"]
    menus = ["Home » Shop » Phones » Cases", "Start › Neu › Alt › Mehr", "home | news | sport | about", "eins • zwei • drei • vier"]
    out = quality_rules.clean(docs_of(clean + [f"{m}\n{good}" for m in menus])).orderBy("doc_id").collect()
    assert [r.n_removed for r in out] == [0] * len(clean) + [1] * len(menus)
    assert all(r.kept and r.clean_text == (r.text if r.doc_id < len(clean) else good) for r in out)


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 5, 16, 17, 100, 1023):
        got = [r.p for r in spark.range(n).select(sharding.permute(F.col("id"), n, 9).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        assert got == [sharding.position(i, n, 9) for i in range(n)]


def test_sharding(docs_of):
    texts = [None, "", "same", "same", "é" * 1000] + [f"t{i}" for i in range(200)]
    out = sharding.shard(docs_of(texts), shards=16).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == 205 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    again = sharding.shard(docs_of(texts).repartition(7), shards=16).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert sharding.shard(docs_of(texts).limit(0)).count() == 0
    twice = sharding.shard(docs_of(["a"] * 40, ids=[None] * 40), shards=4).collect()
    assert len({(r.shard, r.slot) for r in twice}) == 40


def test_op10_checksums(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op10_sharding"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)


def brute_targets(sizes, weights=(1, 2, 3), epochs=3):
    """Share by weight; cap; share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target, free = Fraction(sum(sizes.values())), {}, set(order)
    while free:
        left = budget - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: Fraction(epochs * sizes[s]) for s in over}
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 1, None: 60}, {"a": 10}, {"a": 0, "b": 7}, {"x": 1, "y": 1, "z": 400}])
def test_targets(spark, sizes):
    d = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(d).collect()}
    for s, t in brute_targets(sizes).items():
        assert abs(got[s] - float(t)) < 1e-9 * max(1, float(t))


def test_mix(docs_of, prose):
    texts, sources = [], []
    for i in range(300):
        texts.append(" ".join(prose(i, 5 + i % 40)))
        sources.append(["a", "b", "c", None][0 if i < 200 else i % 4])
    texts += [None, "", texts[0]]
    sources += ["a", "b", "a"]
    df = docs_of(texts, sources)
    rows = mixing.taken_copies(df).collect()
    assert len(rows) == len(texts)
    total = sum(r["size"] for r in rows)
    assert total - max(r["size"] for r in rows) <= sum(r.taken for r in rows) <= total
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    near = {}
    for r in rows:
        near.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in near.items():
        assert abs(sum(taken) - target) <= 2 * 44
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken_copies(df.repartition(5)).collect()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixing.mix(df.limit(0)).count() == 0


def test_url_parts(spark):
    urls = [(0, None), (1, "no scheme"), (2, "http://A.Example.COM"), (3, "https://x.example.com/en/a?b#c"), (4, "http://h?x=/en/"),
            (5, "http://h#/en/?"), (6, "https://www.example.com/en/z.html"), (7, "http://a.net/es/1/"), (8, "http://net/fr/"), (9, "ftp://q.com//")]
    d = spark.createDataFrame(urls, "page_id int, url string")
    listed = d.where("page_id = 9").select(urlfilter.canonical(F.col("url")).alias("canon")).union(spark.sql("select cast(null as string)"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(d, URL_RULES, listed).collect()}
    assert got == {0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.example.com", "", None, "allow"),
                   3: ("x.example.com", "/en/a", "example.com/en/", "block"), 4: ("h", "", None, "allow"), 5: ("h", "", None, "allow"),
                   6: ("www.example.com", "/en/z.html", "www.example.com/en/", "allow"), 7: ("a.net", "/es/1/", "net/es/", "block"),
                   8: ("net", "/fr/", "net/fr/", "block"), 9: ("q.com", "//", "com/", "allow")}
    assert urlfilter.judge(d, URL_RULES, listed.limit(0)).where("listed").count() == 0
    assert urlfilter.judge(d.limit(0), URL_RULES, listed).count() == 0


def test_urls_without_scheme_are_told_apart(spark):
    urls = [(0, "www.a.com/x"), (1, "www.b.com/y"), (2, "www.a.com/x?utm_source=q#top"), (3, "www.a.com/x?b=2&a=1"), (4, "www.a.com/x?a=1&b=2"), (5, ""), (6, "http://"), (7, None)]
    d = spark.createDataFrame(urls, "page_id int, url string")
    listed = d.where("page_id in (0, 3)").select(urlfilter.canonical(F.col("url")).alias("canon"))
    got = {r.page_id: (r.host, r.path, r.verdict) for r in urlfilter.judge(d, URL_RULES, listed).collect()}
    assert got == {i: ("", "", "block" if i in (0, 2, 3, 4) else "allow") for i, _ in urls}


def test_bloom_has_no_false_negatives(spark):
    d = spark.range(3000).selectExpr("id", "concat('http://h', id % 2500, '.org/p') as url")
    listed = d.where("id % 3 = 0").select(urlfilter.canonical(F.col("url")).alias("canon"))
    want = {f"h{i % 2500}.org/p" for i in range(0, 3000, 3)}
    for r in urlfilter.listed_flag(d, listed).withColumn("c", urlfilter.canonical(F.col("url"))).collect():
        assert r.listed == (r.c in want)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = sorted(map(str, cur.fetchall()))
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want
