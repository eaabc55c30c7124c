"""Merkle manifest of a dataset: a hash tree per language, a tree over the
languages, and a proof for every row.

Every row's leaf gets its rank in its language. The digits of the rank name the
row's place in the tree, so runs of siblings are groups that share all digits but
the last: the digits of a block of ``BLOCK`` leaves are grouped away one after
the other, each group nesting its children's structs in its own. All groupings of a block
need one shuffle, by language and block. The heads of blocks are ranked by
block number and rolled up in the same way until one head per language is left.

Proofs go the other way: the path above a block joins the block's nested struct in
one aggregate, a transform over the nested children writes every child's path and an
explode emits it, so no join meets rows with their siblings.

Scale: rows are narrow (digest and id, no text) after the first projection; ranks come from range
buckets with offsets; a block holds ``BLOCK`` digests at most, whatever a language holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import stored
from ticketlens.operators.joins import dimension_join

DIGIT_BITS = 4  # leaves of one group: 16, folded in 4 levels of two
DIGITS = 3      # digits of one block: 4,096 leaves


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(F.concat(*[encoded(c) for c in (doc_id, source, lang, n_chars, text)]))


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank`` (from 0, in ``group``, by ``order``, nulls first) and
    ``total``, the group's size. Ties are broken by a row number, so that equal
    rows spread over range buckets too.

    One shuffle by range; a bucket's offset in its group comes from a table
    with a row per bucket and group."""
    # deterministic on a stored table; only ties are decided by it
    rows = stored(df, name).withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    at = F.col("_at")
    placed = (rows.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in keys])
              .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
              .withColumn("_at", F.monotonically_increasing_id()).drop("_tie")
              .withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    placed = stored(placed, name + "-placed")
    parts = placed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_g")
    parts = parts.select(F.hash("_g").alias("_h"), "_g", "_p", F.sum("_n").over(every).alias("total"),
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    # null-safe on the group: the hash is never null, and a bucket seldom holds two groups of one hash
    found = dimension_join(placed.withColumn("_h", F.hash(group)).withColumn("_p", F.col("_part")), parts, ["_h", "_p"],
                           salt_source=F.col("_at"))
    return (found.where(F.col(group).eqNullSafe(F.col("_g")))
            .withColumn("rank", F.col("_at") + F.col("_shift")).select(*df.columns, "rank", "total"))


def _up(hashes: Column, whole: Column) -> Column:
    """The next level of a run of siblings; empty when ``whole`` and one is left."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int"))
    nodes = F.transform(pairs, lambda i: digest(F.concat(
        F.get(hashes, 2 * i), F.coalesce(F.get(hashes, 2 * i + 1), F.lit("")))))
    return F.when((F.size(hashes) == 0) | (whole & (F.size(hashes) <= 1)), F.array().cast("array<string>")).otherwise(nodes)


def _grouped(nodes: DataFrame, keys: list[str], digit: str, below: int, bits: int) -> DataFrame:
    """Groups ``digit`` away: a row per ``keys`` with the run's own digest, its
    levels and its children. ``below`` is the height of the children."""
    wide = F.ceil(F.col("total") / F.lit(float(1 << below))).cast("long")
    g = nodes.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), "hash", "kid"))).alias("kids"),
        F.max("total").alias("total"))
    g = g.withColumn("_whole", wide <= (1 << bits)).withColumn("l0", F.col("kids.hash"))
    for j in range(bits):
        g = g.withColumn(f"l{j + 1}", _up(F.col(f"l{j}"), F.col("_whole")))
    top = F.coalesce(*[F.get(f"l{j}", F.lit(0)) for j in range(bits, -1, -1)])
    kid = F.struct("kids", F.array(*[F.col(f"l{j}") for j in range(bits + 1)]).alias("levels"))
    return g.select(*keys, "total", top.alias("hash"), kid.alias("kid"))


def blocks_of(nodes: DataFrame, bits: int = DIGIT_BITS, digits: int = DIGITS) -> DataFrame:
    """Rolls ``nodes`` (``tree, rank, total, hash, kid``) up to ``tree, block,
    total, hash, kid``: one row per block, ``kid`` holding its nested children."""
    d = nodes.withColumn("block", F.shiftright("rank", bits * digits))
    names = [f"d{i}" for i in range(digits)]
    for i, name in enumerate(names):
        d = d.withColumn(name, F.shiftright("rank", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
    d = d.repartition("tree", "block")
    for i, name in enumerate(names):
        d = _grouped(d, ["tree", "block", *names[i + 1:]], name, bits * i, bits)
    return d.withColumn("total", F.ceil(F.col("total") / F.lit(float(1 << bits * digits))).cast("long"))


def _path(digit: Column, levels: Column, bits: int) -> Column:
    """The steps from a child to the head of its run: per level the sibling (null if
    the run has no other) and whether the child stands right of it."""
    steps = [F.when(F.size(levels[j + 1]) > 0, F.struct(
        F.get(levels[j], F.shiftright(digit, j).bitwiseXOR(F.lit(1))).alias("sibling"),
        (F.shiftright(digit, j).bitwiseAND(F.lit(1)) == 1).alias("right"))) for j in range(bits)]
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _paths(kid: Column, digits: int, bits: int) -> Column:
    """Every lowest child of a nested struct, with its path to the struct's head."""
    def own(k: Column) -> Column:
        return _path(k["digit"], kid["levels"], bits)

    if digits == 1:
        return F.transform(kid["kids"], lambda k: F.struct(k["kid"].alias("kid"), k["hash"].alias("hash"), own(k).alias("path")))
    return F.flatten(F.transform(kid["kids"], lambda k: F.transform(
        _paths(k["kid"], digits - 1, bits),
        lambda x: F.struct(x["kid"].alias("kid"), x["hash"].alias("hash"), F.concat(x["path"], own(k)).alias("path")))))


def proved(blocks: DataFrame, above: DataFrame, bits: int = DIGIT_BITS, digits: int = DIGITS) -> DataFrame:
    """``kid, hash, path, subroot, root`` for every lowest child of ``blocks``, where
    ``above`` holds ``tree, block, path, subroot, root`` of each block's head. Both meet in
    one aggregate by tree and block, in which each has one row."""
    some = blocks.select("tree", "block", "kid").unionByName(
        above.withColumnRenamed("path", "up"), allowMissingColumns=True)
    met = some.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("kid", "up", "subroot", "root")])
    out = met.select("tree", "up", "subroot", "root", F.explode(_paths(F.col("kid"), digits, bits)).alias("x"))
    return out.select("tree", F.col("x.kid").alias("kid"), F.col("x.hash").alias("hash"),
                      F.concat("x.path", "up").alias("path"), "subroot", "root")


def _forest(nodes: DataFrame, name: str, bits: int, digits: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the leaves up, and ``(tree, hash)`` of every tree's head."""
    tables = []
    while True:
        b = stored(blocks_of(nodes, bits, digits), f"{name}-{len(tables)}")
        tables.append(b)
        if (b.agg(F.max("total")).first()[0] or 0) <= 1:
            return tables, b.select("tree", "hash")
        nodes = b.select("tree", F.col("block").alias("rank"), "total", "hash", F.col("block").alias("kid"))


def manifest(leaves: DataFrame, tree: str, order: list[str], bits: int = DIGIT_BITS, digits: int = DIGITS) -> DataFrame:
    """Hash trees over ``leaves`` (a column ``leaf``, a grouping column ``tree``,
    ranked by ``order`` within it): its rows with ``path`` (array of sibling and
    side, from the leaf up to the root), ``subroot`` and ``root``.

    Null ids come first in their tree and a null tree before the others. Rows of
    equal order are ranked by their leaf; fully equal rows are interchangeable. A lone leaf
    is its tree's root, and a lone tree's root the root. No leaves give no rows."""
    held = leaves.select(F.col(tree).alias("tree"), F.struct(*leaves.columns).alias("kid"), F.col("leaf").alias("hash"),
                         *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))] + ["hash"]
    low, subroots = _forest(ranked(held, "tree", keys, "merkle").drop(*keys[:-1]), "merkle-blocks", bits, digits)
    tops = subroots.select(F.lit(0).alias("all"), F.struct(F.col("tree").alias("name")).alias("kid"), "hash", F.col("tree").alias("_o"))
    high, roots = _forest(ranked(tops, "all", ["_o"], "merkle-trees").drop("_o").withColumnRenamed("all", "tree"),
                          "merkle-tops", bits, digits)
    none = F.array().cast("array<struct<sibling:string,right:boolean>>")
    above = roots.select("tree", F.lit(0).cast("long").alias("block"), none.alias("path"),
                         F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    for b in reversed(high[1:]):
        above = stored(proved(b, above, bits, digits).select("tree", F.col("kid").alias("block"), "path", "subroot", "root"), "merkle-above")
    above = proved(high[0], above, bits, digits).select(F.col("kid.name").alias("tree"), F.lit(0).cast("long").alias("block"),
                                                        "path", F.col("hash").alias("subroot"), "root")
    above = stored(above, "merkle-above")
    for b in reversed(low[1:]):
        above = stored(proved(b, above, bits, digits).select("tree", F.col("kid").alias("block"), "path", "subroot", "root"), "merkle-above")
    return proved(low[0], above, bits, digits).select("kid.*", "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.when(
        s["right"], F.concat(F.coalesce(s["sibling"], F.lit("")), h)).otherwise(F.concat(h, F.coalesce(s["sibling"], F.lit(""))))))


def proof_digest(path: Column) -> Column:
    """The digest of the siblings from leaf to root."""
    return digest(F.concat_ws("", F.transform(path, lambda s: s["sibling"])))


def verified(documents: DataFrame, modulus: int = 7, bits: int = DIGIT_BITS, digits: int = DIGITS) -> DataFrame:
    """The manifest of ``documents`` (by language, ids ascending) and a test of
    every proof: ``doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified``. Where ``modulus`` divides the CRC-32 of the id, 1 is added to
    ``n_chars`` before the proof is folded, which must then fail; rows without an id or
    without ``n_chars`` are left as they are. Columns other than the five hashed ones are ignored."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == 0
    changed = F.when(hit & F.col("n_chars").isNotNull(),
                     leaf_of(own[0], own[1], own[2], own[3].cast("decimal(20,0)") + 1, own[4]))
    leaves = documents.select("lang", "doc_id", leaf_of(*own).alias("leaf"), changed.alias("changed"))
    m = manifest(leaves, "lang", ["doc_id"], bits, digits)
    m = m.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
