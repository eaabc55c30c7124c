"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans; boosted trees score each from
the format of the span and its context; a threshold for each kind, calibrated on
the held-out candidates of all rows, selects the spans that are added to the base ones.

* Everything happens inside the row: spans are arrays of structs, the trained
  trees are written out as a column expression, and no text is exploded,
  shuffled or joined. Only the bounded training sample and counts of scores leave the scans.
* Labels are weak: a candidate counts as personal data if the strict rule of
  its kind holds (a base match, a named secret, eight address groups, a number written
  like a phone number beside such a cue); the trees
  see format and context only, so that they carry over to spans that fail the rule.
* All patterns are written so that matching is linear in the text: loops are
  possessive, and a match starts only where a run starts (or where the last one ended).
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import stored, text_of

LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # at least 14 digits with single separators, the whole run of them
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?+){13}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "number": r"(?<![0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9]){8,18}(?![0-9])",
    "secret": r"(?i)(?<![a-z])(?:token|key|secret|password|passwd)[\x20]{0,3}[=:][\x20]{0,3}[\x22\x27]?[a-z0-9_+/-]{8,}+",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{24,}+(?![A-Za-z0-9])",
    "mailbox": rf"(?<!{LOCAL}){LOCAL}++\x20?+(?:\[at\]|\(at\))\x20?+[A-Za-z0-9-]++[A-Za-z0-9.-]*+",
    "ipv6": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){4,7}(?![0-9A-Fa-f:])",
}
KINDS = [*BASE, *ADDED]
CONTEXT = 24
CUES = "(?i)(tel|phone|call|mobil|fax|card|visa|mail|contact|write|token|key|secret|passw|address|host|server)"
PHONE_CUES = "(?i)((?<![a-z])(?:tel|call|mobil|fax)|phone)"
# groups of two to five digits, the first of them maybe in brackets or after a trunk or country code
GROUPED = r"^(?:[0-9]{1,3}[\x20.-])?(?:\([0-9]{2,5}\)[\x20.-]?|[0-9]{2,5}[\x20.-])(?:[0-9]{2,5}[\x20.-])*[0-9]{2,5}$"
AREA_CODE = r"^(?:1[\x20.-])?\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$"  # a phone number without any cue

SAMPLE_CANDIDATES = 8000   # bound of the training sample, in candidates
SAMPLE_ROWS = 200_000      # about as many rows are searched for them
TREES, DEPTH, STEP = 8, 4, 0.3
PRECISION = 0.9            # that a threshold has to reach on held-out candidates
FALLBACK = 0.5             # threshold of a kind without any held-out candidate: the trees alone decide
SPANS = "array<struct<start:int,end:int,kind:string,text:string,before:string,after:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, s: Column) -> Column:
    """Whether a match of a base pattern counts."""
    n = F.length(_digits(s))
    parts = F.forall(F.split(s, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
                     & (F.coalesce(F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.concat(F.lit("0"), F.regexp_replace(p, "^0+", ""))).cast("int"), F.lit(0)) <= 255))
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", parts)
            .when(kind == "card", (n >= 14) & (n <= 19) & F.when((n >= 14) & (n <= 19), luhn(_digits(s))).otherwise(F.lit(False)))
            .when(kind == "phone", (n >= 10) & (n <= 15)).otherwise(F.lit(False)))


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Matches of ``pattern``, left to right, with positions in code points
    (end exclusive) and the text around them. The pieces between the matches
    give the positions."""
    found, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.struct(found.alias("m"), rest.alias("g"))
    empty = F.array().cast(SPANS)

    def locate(b):
        def step(s, i):
            start = s.pos + F.length(F.get(b.g, i))
            end = start + F.length(F.get(b.m, i))
            one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.get(b.m, i).alias("text"),
                           F.right(F.get(b.g, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(b.g, i + 1), F.lit(1)).alias("after"))
            return F.struct(end.alias("pos"), F.concat(s.out, F.array(one)).alias("out"))
        return F.when(F.size(b.m) > 0, F.aggregate(
            F.sequence(F.lit(0), F.size(b.m) - 1), F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda s: s.out)).otherwise(empty)
    return F.get(F.transform(F.array(both), locate), 0)


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``__base`` (valid base spans) and ``__cands`` (spans of the
    other generators that overlap no base span, and base matches that fail)."""
    t = F.col("__t")
    empty = F.array().cast(SPANS)
    need = {"email": t.contains("@"), "mailbox": t.contains("at)") | t.contains("at]"), "phone": t.contains("+"),
            "secret": t.contains("=") | t.contains(":"), "ipv6": t.contains(":")}
    d = df.withColumn("__t", text_of(text)).withColumn("__d", t.rlike("[0-9]"))
    names = []
    for kind, pattern in (BASE | ADDED).items():
        when = need.get(kind, F.lit(True)) & (F.lit(True) if kind in ("email", "mailbox", "secret") else F.col("__d"))
        d = d.withColumn(f"__{kind}", F.when(when, spans(t, kind, pattern)).otherwise(empty))
        names.append(f"__{kind}")
    ok = lambda x: valid(x.kind, x.text)
    d = d.withColumn("__all", F.concat(*[F.col(f"__{k}") for k in BASE])).withColumn("__base", F.filter("__all", ok))
    apart = lambda x: ~F.exists("__base", lambda b: (b.start < x.end) & (x.start < b.end))
    rest = F.concat(F.filter("__all", lambda x: ~ok(x)), *[F.col(f"__{k}") for k in ADDED])
    return d.withColumn("__cands", F.filter(rest, apart)).drop("__d", "__all", *names)


def features(x: Column) -> list[Column]:
    """Format and context of a span, as doubles."""
    s, d = x.text, _digits(x.text)
    letters = F.regexp_replace(s, "[^A-Za-z]", "")
    runs = F.transform(F.split(s, "[^0-9]+"), lambda r: F.length(r))
    out = [F.length(s), F.length(d), F.length(d) / F.greatest(F.length(s), F.lit(1)), F.length(letters),
           F.length(s) - F.length(d) - F.length(letters), F.array_max(runs), F.size(runs),
           F.size(F.array_distinct(F.split(s, ""))), s.startswith("+").cast("int"), s.rlike("[()]").cast("int"),
           s.rlike("[=:]").cast("int"), s.contains("@").cast("int"), x.before.rlike(CUES).cast("int"),
           x.before.rlike(r"[A-Za-z0-9]$").cast("int"), x.after.rlike("[A-Za-z0-9]").cast("int"),
           F.length(F.regexp_replace(x.before, "[^#*$%&|<>]", "")), x.before.rlike(PHONE_CUES).cast("int"),
           s.rlike(GROUPED).cast("int")]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in out]


N_FEATURES = 18


def _like_phone(x: Column) -> Column:
    """Whether a span without ``+`` is written like a phone number: 10 to 15
    digits, in groups or in one run, with a cue before it unless the format says enough."""
    plain = x.text.rlike("^[0-9]+$")
    return F.length(_digits(x.text)).between(10, 15) & (x.text.rlike(AREA_CODE) | (x.before.rlike(PHONE_CUES) & (plain | x.text.rlike(GROUPED))))


def weak_label(x: Column) -> Column:
    """1 if the strict rule of the span's kind holds."""
    strict = (valid(x.kind, x.text) | (x.kind == "secret") | ((x.kind == "ipv6") & (F.size(F.split(x.text, ":")) == 8))
              | ((x.kind == "hex") & (F.length(x.text).isin(32, 40, 64) | (F.length(x.text) > 64))) | ((x.kind == "mailbox") & x.text.contains("."))
              | ((x.kind == "number") & _like_phone(x)))
    return F.coalesce(strict, F.lit(False)).cast("int")


def _tree(node, x: Column) -> Column:
    """A fitted tree as an expression over the array of features ``x``."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(x, F.lit(int(split.featureIndex()))) <= float(split.threshold()), _tree(node.leftChild(), x)) \
        .otherwise(_tree(node.rightChild(), x))


class Model:
    """Boosted trees and a threshold for each kind. ``score`` and ``chosen`` are column expressions."""

    def __init__(self, trees=(), weights=(), thresholds=None):
        self.trees, self.weights, self.thresholds = list(trees), list(weights), dict(thresholds or {})

    def score(self, x: Column) -> Column:
        if not self.trees:
            return F.lit(0.0)
        f = F.array(*features(x))

        def margin(v):
            return reduce(lambda a, b: a + b, [w * _tree(t, v) for t, w in zip(self.trees, self.weights, strict=True)])
        return F.get(F.transform(F.array(f), lambda v: 1 / (1 + F.exp(-2 * margin(v)))), 0)

    def chosen(self, x: Column) -> Column:
        limit = F.lit(None).cast("double")
        for kind, value in self.thresholds.items():
            limit = F.when(x.kind == kind, F.lit(value)).otherwise(limit)
        return F.coalesce(self.score(x) >= limit, F.lit(False))


def calibrated(held: DataFrame, model: Model) -> dict[str, float]:
    """Thresholds from the candidates ``x`` of ``held``: of each kind the lowest score
    at or above which enough of them count (at least 0.5), none if there is no such
    score, ``FALLBACK`` if there is no candidate."""
    x = F.col("x")
    counts = held.select(x.kind.alias("kind"), weak_label(x).alias("label"), F.round(model.score(x), 2).alias("s")) \
        .groupBy("kind", "s").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))  # at most 101 rows a kind
    levels = sorted(counts.collect(), key=lambda r: -r.s)
    out = {kind: FALLBACK for kind in KINDS if all(r.kind != kind for r in levels)}
    for kind in KINDS:
        good = n = 0
        for r in (r for r in levels if r.kind == kind):
            good, n = good + r.good, n + r.n
            if good >= PRECISION * n:
                out[kind] = max(r.s - 0.005, 0.5)
    return out


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample: int = SAMPLE_CANDIDATES) -> Model:
    """Train on the candidates of about ``sample_rows`` rows, at most ``sample`` of
    them, both drawn by hash. A third of the candidates, by hash too, is held out
    of that; those of all rows give the thresholds.
    Without candidates of both labels the model adds nothing."""
    rows = df.count()
    share = min(1.0, sample_rows / max(1, rows))
    hashed = df.select(text, F.xxhash64(key, text).alias("__h"))
    drawn = hashed.where(F.pmod("__h", F.lit(1 << 20)) < int(share * (1 << 20)))

    def listed(d):
        d = candidates(d, text).select("__h", F.explode_outer(F.concat("__base", "__cands")).alias("x")).where(F.col("x.kind").isNotNull())
        return d.select("x", F.xxhash64("__h", "x.start", "x.kind").alias("o"))
    fold = F.pmod("o", F.lit(3))
    d = listed(drawn).where(fold > 0).orderBy("o").limit(sample)  # the sample bound, a parameter
    train = stored(d.select(F.col("x.kind").alias("kind"), weak_label(F.col("x")).alias("label"),
                            *[c.alias(f"f{i}") for i, c in enumerate(features(F.col("x")))]), "pii-sample")
    if train.select("label").distinct().count() < 2:
        return Model()
    names = [f"f{i}" for i in range(N_FEATURES)]
    # each kind and label weighs the same, so that rare ones shape the trees too
    groups = train.groupBy("kind", "label").count().collect()  # two rows a kind at most
    weight = F.lit(1.0)
    for r in groups:
        weight = F.when((F.col("kind") == r.kind) & (F.col("label") == r.label), sum(g["count"] for g in groups) / len(groups) / r["count"]).otherwise(weight)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(train).select("label", "features", weight.alias("weight"))
    fitted = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7).fit(data)
    trees = [t.rootNode() for t in fitted._java_obj.trees()]
    model = Model(trees, fitted.treeWeights)
    model.thresholds = calibrated(listed(hashed).where(fold == 0), model)
    return model


def _is(kind: str):
    return lambda x: x.kind == kind


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def _ordered(spans_: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    keyed = F.transform(spans_, lambda x: F.struct(x.start.alias("start"), F.element_at(rank, x.kind).alias("rank"), x.end.alias("end"), x.kind.alias("kind")))
    return F.array_sort(keyed)


def find(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``n_email, n_ip, n_card, n_phone`` (base spans), ``n_added``,
    ``base_spans`` and ``spans`` (arrays of start, rank, end, kind, in order) and
    ``redacted`` (the text with every span, overlapping ones merged, replaced by ``[PII]``).

    A null text is empty; repeated rows are searched each on its own; an empty
    table stays empty. Columns of these names are replaced, others pass through.
    """
    out = [f"n_{k}" for k in BASE] + ["n_added", "base_spans", "spans", "redacted"]
    d = candidates(df.drop(*out), text)
    d = d.withColumn("__more", F.filter("__cands", model.chosen))
    d = d.withColumn("base_spans", _ordered(F.col("__base"))) \
        .withColumn("spans", _ordered(F.concat("__base", "__more"))) \
        .withColumn("n_added", F.size("__more").cast("long"))
    for kind in BASE:
        d = d.withColumn(f"n_{kind}", F.size(F.filter("base_spans", _is(kind))).cast("long"))
    t = F.col("__t")

    def step(s, x):  # a span that starts where the last one ended gets a mark of its own
        gap = F.when(x.start >= s.pos, F.concat(F.substr(t, s.pos + 1, x.start - s.pos), F.lit("[PII]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(s.pos, x.end).alias("pos"), F.concat(s.out, gap).alias("out"))
    cut = F.aggregate("spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
                      lambda s: F.concat(s.out, F.substr(t, s.pos + 1, F.length(t))))
    d = d.withColumn("redacted", F.when(F.size("spans") > 0, cut).otherwise(t))
    return d.drop("__t", "__base", "__cands", "__more")


def digest(df: DataFrame) -> DataFrame:
    """``find``'s spans as ``base_sha256`` and ``spans`` (kind:start:end, comma-joined)."""
    return df.withColumn("base_sha256", F.sha2(_joined(F.col("base_spans")), 256)).withColumn("spans", _joined(F.col("spans")))
