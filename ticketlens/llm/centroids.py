"""Centroid clustering (Lloyd's rounds) of integer vectors over subvector dictionaries.

Vectors are cut into blocks of dimensions. Each chunk of vectors keeps, per block, the
distinct subvectors that occur in it and every vector's code for its own: a lossless
dictionary, made once and written to the shared folder. A round computes the exact
squared distances of each dictionary entry to the centroids' subvectors once, and a vector's
distance is the sum of those of its codes. New centroids are sums of entries by how
often each code went to each cluster. All arithmetic is on integers.

Per chunk and block the encoder takes the widest block whose dictionary is at
most a quarter as long as the chunk, down to single dimensions, so that a
dictionary saves work whatever the values are.

Scale: a chunk is a row of bounded size, chunks are read by any number of
tasks, a round shuffles one row per chunk and cluster after partial sums, and only the
centroids (``k`` rows) pass through the driver. No row is tied to a cluster's task.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import stored

DIMS = 64
SCALE = 1024
K = 8
ROUNDS = 10
CHUNK_ROWS = 16_384
WIDTHS = (8, 4, 2, 1)   # dimensions of a block, widest first
LIMIT = 1 << 26         # a component beyond gives no distance in 64 bits


def kept_vector(embedding: Column, dims: int = DIMS, scale: int = SCALE) -> Column:
    """The scaled integer vector, or null for a vector that is left out: null, of another length,
    with a null or non-finite component, or one beyond ``LIMIT`` after scaling (whose
    squared distances need not fit in a long)."""
    x = F.transform(embedding, lambda v: F.floor(F.when(
        F.abs(v.cast("double")) * scale < LIMIT, v.cast("double") * scale)).cast("int"))
    return F.when((F.size(embedding) == dims) & F.forall(x, lambda v: v.isNotNull()), x)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors whose ids hash lowest, in that order (equal hashes by component).
    A top-k over the table; ``k`` rows come back. A null id hashes as an empty one."""
    code = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(code.alias("code"), "v").orderBy("code", "v").limit(k).collect()
    return [list(r["v"]) for r in rows]


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _codes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``block`` and every row's code."""
    if block.shape[1] == 1:
        words, codes = np.unique(block[:, 0], return_inverse=True)
        return words[:, None], codes
    key = np.ascontiguousarray(block).view(np.dtype((np.void, block.dtype.itemsize * block.shape[1]))).ravel()
    _, first, codes = np.unique(key, return_index=True, return_inverse=True)
    return block[first], codes


def _dictionary(block: np.ndarray, at: int, widths: tuple[int, ...]) -> dict[str, np.ndarray]:
    width = min(widths[0], block.shape[1])
    words, codes = _codes(block)
    rest = tuple(w for w in widths if w < width)
    if 4 * len(words) > len(block) and rest:
        out = {}
        for s in range(0, block.shape[1], rest[0]):
            out |= _dictionary(block[:, s:s + rest[0]], at + s, rest)
        return out
    kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
    return {f"w{at}": words.astype(np.int32), f"c{at}": codes.astype(kind)}


def encoded(vectors: DataFrame, chunk_rows: int = CHUNK_ROWS, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``(ids, chunk)``: the vectors of ``vectors`` (``id, v``) in chunks of at most ``chunk_rows``,
    each with its dictionaries and codes. Ids keep their order within a chunk."""
    def rows_of(parts: list[pd.DataFrame]) -> pd.DataFrame:
        d = pd.concat(parts) if len(parts) > 1 else parts[0]
        x = np.stack(d["v"].to_numpy()).astype(np.int32)
        arrays = {}
        for s in range(0, x.shape[1], widths[0]):
            arrays |= _dictionary(np.ascontiguousarray(x[:, s:s + widths[0]]), s, widths)
        return pd.DataFrame({"ids": [d["id"].to_list()], "chunk": [_pack(arrays)]})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for d in batches:
            while len(d):
                part = d.iloc[:chunk_rows - n]
                held.append(part)
                n += len(part)
                d = d.iloc[len(part):]
                if n == chunk_rows:
                    yield rows_of(held)
                    held, n = [], 0
        if n:
            yield rows_of(held)

    # ids as text: a null id stays one, and no id passes through a float
    text = vectors.select(F.col("id").cast("string").alias("id"), "v")
    return text.mapInPandas(chunks, "ids array<string>, chunk binary")


def _load(chunk: bytes) -> list[tuple[int, np.ndarray, np.ndarray]]:
    z = np.load(io.BytesIO(chunk))
    return [(int(n[1:]), z[n].astype(np.int64), z["c" + n[1:]]) for n in z.files if n[0] == "w"]


def _assigned(blocks: list, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and squared distance of every vector of a chunk."""
    total = np.zeros((len(blocks[0][2]), len(centroids)), dtype=np.int64)
    for at, words, codes in blocks:
        diff = words[:, None, :] - centroids[None, :, at:at + words.shape[1]]
        total += (diff * diff).sum(axis=2)[codes]  # one table of distances a block, looked up by code
    near = total.argmin(axis=1)
    return near, total[np.arange(len(near)), near]


def _round(chunks: DataFrame, centroids: np.ndarray) -> list:
    """Per cluster: its vectors, the sum of each component and of the distances."""
    k, dims = centroids.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for chunk in d["chunk"]:
                blocks = _load(chunk)
                near, dist = _assigned(blocks, centroids)
                sums = np.zeros((k, dims), dtype=np.int64)
                for at, words, codes in blocks:
                    often = np.bincount(near * len(words) + codes, minlength=k * len(words)).reshape(k, len(words))
                    sums[:, at:at + words.shape[1]] = often @ words
                inertia = np.zeros(k, dtype=np.int64)
                np.add.at(inertia, near, dist)
                yield pd.DataFrame({"cluster": np.arange(k), "n": np.bincount(near, minlength=k), "inertia": inertia,
                                    "sums": list(sums)})

    parts = chunks.select("chunk").mapInPandas(partial, "cluster int, n long, inertia long, sums array<long>")
    big = "decimal(38,0)"
    return parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum(F.col("inertia").cast(big)).alias("inertia"),
        F.array(*[F.sum(F.col("sums")[i].cast(big)) for i in range(dims)]).alias("sums")).collect()


def clusters(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
             dims: int = DIMS, scale: int = SCALE, salt: str = "3:", chunk_rows: int = CHUNK_ROWS,
             widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every kept vector.

    Centroids start as the ``k`` vectors of the lowest salted id hashes (all, if
    there are fewer). ``rounds`` times every vector goes to its nearest
    centroid (squared distance, ties to the smaller number), and every centroid with
    vectors becomes the floor of their componentwise mean; then vectors are assigned once
    more. Rows are told apart by nothing but their place, so repeated ids and vectors
    count as often as they occur and null ids pass through. Vectors left out
    (``kept_vector``) have no row; a table without any vector gives none. Other
    columns are ignored. An inertia beyond a long is null."""
    spark = df.sparkSession
    out_type = df.schema[key].dataType
    kept = df.select(F.col(key).alias("id"), kept_vector(F.col(vector), dims, scale).alias("v")).where("v IS NOT NULL")
    start = first_centroids(kept, k, salt)
    if not start:
        return spark.createDataFrame([], "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string") \
            .select(F.lit(None).cast(out_type).alias("vec_id"), "*")
    chunks = stored(encoded(kept, chunk_rows, widths), "subvectors")
    centroids = np.array(start, dtype=np.int64)
    for _ in range(rounds):
        for r in _round(chunks, centroids):
            if r["n"]:
                centroids[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    inertia = {r["cluster"]: int(r["inertia"]) for r in _round(chunks, centroids)}
    codes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for ids, chunk in zip(d["ids"], d["chunk"]):
                near, dist = _assigned(_load(chunk), centroids)
                yield pd.DataFrame({"vec_id": ids, "cluster": near, "distance": dist})

    def by_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    def long(v: int) -> int | None:
        return v if v < 1 << 63 else None

    rows = chunks.mapInPandas(final, "vec_id string, cluster int, distance long")
    return rows.select(F.col("vec_id").cast(out_type).alias("vec_id"), "cluster", "distance",
                       by_cluster([long(inertia.get(i, 0)) for i in range(len(codes))], "long").alias("cluster_inertia"),
                       F.lit(long(sum(inertia.values()))).cast("long").alias("inertia"),
                       by_cluster(codes, "string").alias("centroid_sha256"))
