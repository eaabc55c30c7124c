"""The registered queries of the operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import (centroids, decontaminate, linedup, lm_bloom, merkle, mixing, pii, quality_mil, quality_rules, sharding, simhash,
                            toxicity, urlfilter)
from ticketlens.llm.common import documents, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DUCK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, {DUCK_WORDS} w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') g
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) c FROM wins) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) n FROM twice, (SELECT unnest(range(8)) k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) x, unnest(range(len(string_split(t, chr(10))))) k FROM d),
lines AS (SELECT doc_id, x, k, regexp_matches(x, '[^\x20\x09-\x0D]') worded,
                 NOT (regexp_matches(x, '{quality_rules.SYMBOL_RUNS}') OR regexp_matches(x, '{quality_rules.SHOUTING}')
                      OR regexp_matches(x, '{quality_rules.MENU}')
                      OR (length(x) <= {quality_rules.BOILERPLATE_CHARS} AND regexp_matches(x, '(?i){"|".join(quality_rules.BOILERPLATE)}'))) good
          FROM l),
by_doc AS (SELECT doc_id, count(*) FILTER (worded) n_lines, count(*) FILTER (NOT good) n_removed,
                  count(*) FILTER (worded) - count(DISTINCT x) FILTER (worded) n_dup_lines,
                  coalesce(string_agg(x, chr(10) ORDER BY k) FILTER (good), '') clean
           FROM lines GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, n_dup_lines, coalesce(cover.n, 0) n_repeat_words,
             n_lines, n_removed, length(t) - length(clean) lost_chars, length(t) chars, md5(clean) clean_md5
      FROM d JOIN by_doc USING (doc_id) LEFT JOIN cover USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_chars <= {quality_rules.MAX_LOSS} * chars AS kept, n_lines, n_removed, lost_chars, clean_md5
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
"""

MIX_SQL = f"""
WITH s AS (SELECT doc_id, source, len({DUCK_WORDS}) size, md5(coalesce(doc_id::VARCHAR, '') || ':0:' || md5(coalesce(text, ''))) code FROM documents),
src AS (SELECT source, sum(size)::BIGINT source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) rank FROM src),
v AS (SELECT *, ((rank - 1) % 3 + 1)::BIGINT w, 3 * source_size cap FROM r),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) capped,
             sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) rest,
             sum(source_size) OVER () budget FROM v),
lev AS (SELECT capped, rest FROM l WHERE cap * rest >= w * (budget - capped) ORDER BY cap / w, rank LIMIT 1),
t AS (SELECT source, rank, source_size, budget, least(cap::DOUBLE, w * (budget - lev.capped) / lev.rest) target FROM l LEFT JOIN lev ON true),
m AS (SELECT s.doc_id, s.size, s.code, t.rank, t.source_size, t.target, t.budget,
             sum(s.size) OVER (PARTITION BY t.rank ORDER BY code, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT upto
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (source_size * e + upto) / target f FROM m, (SELECT unnest([0, 1, 2]) e) WHERE size > 0 AND target > 0),
q AS (SELECT doc_id, size FROM (SELECT *, sum(size) OVER (ORDER BY f, rank, code, doc_id, size, e ROWS UNBOUNDED PRECEDING) total FROM c)
      WHERE total <= budget)
SELECT m.doc_id, m.size, m.source_size, m.target, coalesce(sum(q.size), 0)::BIGINT taken
FROM m LEFT JOIN q ON m.doc_id = q.doc_id GROUP BY m.doc_id, m.size, m.source_size, m.target
"""

URL_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path,
                  regexp_extract(split_part(url, '#', 1), '\?(.*)$', 1) query FROM pages),
a AS (SELECT page_id, list_sort(list(x)) args FROM (SELECT page_id, unnest(string_split(query, '&')) x FROM p)
      WHERE x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)') GROUP BY page_id),
c AS (SELECT p.*, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '(\.html?)?/*$', '')
             || CASE WHEN args IS NULL THEN '' ELSE '?' || array_to_string(args, '&') END canon FROM p LEFT JOIN a USING (page_id)),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN canon IN (SELECT canon FROM c WHERE page_id % 20 = 0 AND url IS NOT NULL) THEN 'block' ELSE 'allow' END verdict
FROM r
"""

CENTROID_SQL = f"""
WITH RECURSIVE q AS (
  SELECT row_number() OVER () i, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) v FROM embeddings
  WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
init AS (SELECT list(v ORDER BY code, v) cs FROM (
  SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) code, v FROM q ORDER BY code, v LIMIT {centroids.K})),
it AS (
  SELECT 0 r, cs FROM init
  UNION ALL
  SELECT r + 1, (
    WITH a AS (SELECT v, list_transform(cs, lambda c: list_sum(list_transform(list_zip(c, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) ds FROM q),
    n AS (SELECT v, list_position(ds, list_min(ds)) j FROM a),
    s AS (SELECT j, k, sum(v[k])::BIGINT s, count(*) n FROM n, (SELECT unnest(range(1, {centroids.DIMS + 1})) k) GROUP BY j, k),
    m AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY k) c FROM s GROUP BY j)
    SELECT list(coalesce(m.c, old.c) ORDER BY old.j) FROM (SELECT unnest(cs) c, unnest(range(1, len(cs) + 1)) j) old LEFT JOIN m ON m.j = old.j)
  FROM it WHERE r < {centroids.ROUNDS}),
a AS (SELECT vec_id, cs, list_transform(cs, lambda c: list_sum(list_transform(list_zip(c, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) ds
      FROM q, it WHERE r = {centroids.ROUNDS}),
f AS (SELECT vec_id, (list_position(ds, list_min(ds)) - 1)::INTEGER cluster, list_min(ds) distance, cs FROM a)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT cluster_inertia,
       (sum(distance) OVER ())::BIGINT inertia, sha256(array_to_string(cs[cluster + 1], ',')) centroid_sha256 FROM f
"""


def _duck_encoded(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"


def _duck_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_duck_encoded(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_duck_leaf("n_chars")} leaf, {_duck_leaf("(n_chars + 1)")} changed,
         doc_id IS NOT NULL AND n_chars IS NOT NULL AND xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
           list_reduce(list_prepend(xor(c, b), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1))))) % 7 = 0 hit
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 i, row_number() OVER () k FROM d),
up AS (
  SELECT 0 lev, lang, i, leaf h, count(*) OVER (PARTITION BY lang) total FROM r
  UNION ALL
  SELECT lev + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(total) + 1) // 2 FROM up WHERE total > 1 GROUP BY lev, lang, i // 2),
heads AS (SELECT lang, h subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 i FROM up WHERE total = 1),
top AS (
  SELECT 0 lev, i, subroot h, count(*) OVER () total FROM heads
  UNION ALL
  SELECT lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(total) + 1) // 2 FROM top WHERE total > 1 GROUP BY lev, i // 2),
low AS (SELECT k, r.i, l.lev, l.lang FROM r JOIN (SELECT DISTINCT lev, lang FROM up WHERE total > 1) l ON r.lang IS NOT DISTINCT FROM l.lang),
high AS (SELECT k, heads.i, l.lev FROM r JOIN heads ON r.lang IS NOT DISTINCT FROM heads.lang, (SELECT DISTINCT lev FROM top WHERE total > 1) l),
steps AS (
  SELECT k, low.lev, CASE WHEN (low.i >> low.lev) & 1 = 1 THEN 'R' ELSE 'L' END || coalesce(h, '') s
  FROM low LEFT JOIN up ON up.lang IS NOT DISTINCT FROM low.lang AND up.lev = low.lev AND up.i = xor(low.i >> low.lev, 1)
  UNION ALL
  SELECT k, 1000 + high.lev, CASE WHEN (high.i >> high.lev) & 1 = 1 THEN 'R' ELSE 'L' END || coalesce(h, '')
  FROM high LEFT JOIN top ON top.lev = high.lev AND top.i = xor(high.i >> high.lev, 1)),
paths AS (SELECT r.k, coalesce(list(s ORDER BY lev) FILTER (s IS NOT NULL), []) p FROM r LEFT JOIN steps ON r.k = steps.k GROUP BY r.k),
f AS (SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE total = 1) root, sha256(array_to_string(list_transform(p, lambda s: s[2:]), '')) proof_sha256,
             list_reduce(list_prepend(CASE WHEN hit THEN changed ELSE leaf END, p),
                         lambda h, s: sha256(CASE WHEN s[1] = 'R' THEN s[2:] || h ELSE h || s[2:] END)) folded_root
      FROM r JOIN paths ON r.k = paths.k JOIN heads ON r.lang IS NOT DISTINCT FROM heads.lang)
SELECT *, folded_root = root verified FROM f
"""


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@register("op1_quality_rules", QUALITY_SQL)
def op1(spark, sf_dir):
    d = quality_rules.clean(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "n_lines", "n_removed", "lost_chars", F.md5("clean_text").alias("clean_md5"))


@register("op2_toxicity")
def op2(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    labels = documents(spark, sf_dir, "labels").where(~out).select("doc_id", "toxic")
    model = toxicity.fit(d, labels)
    return (toxicity.scored(d, model).withColumn("held_out", out)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted")))


@register("op3_decontamination")
def op3(spark, sf_dir):
    d = decontaminate.contaminated(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "contaminated", "benchmark_items")


@register("op4_mixing", MIX_SQL)
def op4(spark, sf_dir):
    return mixing.taken_copies(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@register("op5_url_filter", URL_SQL)
def op5(spark, sf_dir):
    """The list is the canonical URLs of the pages whose id is divisible by 20."""
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where("page_id % 20 = 0").select(urlfilter.canonical(F.col("url")).alias("canon"))
    return urlfilter.judge(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


@register("op6_quality_classifier")
def op6(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"), 5, 0)
    labels = documents(spark, sf_dir, "labels").where(~out).select("doc_id", "quality")
    model = quality_mil.fit(d, labels)
    return (quality_mil.scored(d, model).withColumn("held_out", out)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted")))


@register("op7_pii")
def op7(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find(d, pii.fit(d))
    return pii.digest(found).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans",
                                    "n_added", F.md5("redacted").alias("redacted_md5"))


@register("op8_line_dedup")
def op8(spark, sf_dir):
    d = linedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", F.md5("clean_text").alias("clean_md5"))


@register("op9_simhash")
def op9(spark, sf_dir):
    d = simhash.near_duplicates(documents(spark, sf_dir))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op10_sharding")
def op10(spark, sf_dir):
    """Checksum and length stand for the text, which is not shuffled."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    slim = d.select("doc_id", F.octet_length(text_of()).cast("long").alias("bytes"),
                    F.crc32(text_of().cast("binary")).alias("text_crc32"))
    return sharding.deal(slim, [F.col("doc_id"), F.col("text_crc32"), F.col("bytes")]).select(
        "doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op11_lm_scoring")
def op11(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "text")
    return lm_bloom.judged(d, toxicity.held_out(F.col("doc_id"), 10, 0))


@register("op12_centroid_clustering", CENTROID_SQL)
def op12(spark, sf_dir):
    return centroids.clusters(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@register("op13_merkle_manifest", MERKLE_SQL)
def op13(spark, sf_dir):
    return merkle.verified(documents(spark, sf_dir))


@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
