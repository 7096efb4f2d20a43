"""Centroid clustering by bit planes and population counts (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.llm.common import cut

#: Components of a vector: one bit of each fills one 64-bit word.
WIDTH = 64
#: Bits of a component with its sign; squared distances of such vectors are below 2**63.
MOST_BITS = 28


def pack_planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of integer vectors (n, 64) in two's complement: (n, p) words, lowest plane first, the sign last."""
    bits = 1 + max((int(v).bit_length() for v in (values.max(initial=0), -values.min(initial=0) - 1)), default=0)
    if bits > MOST_BITS:
        raise ValueError(f"components of {bits} bits: squared distances need more than 64")
    planes = np.empty((len(values), bits), np.uint64)
    for b in range(bits):
        planes[:, b] = np.packbits((values >> b) & 1 == 1, axis=1, bitorder="little").view("<u8")[:, 0]
    return planes


def widen(planes: np.ndarray, bits: int) -> np.ndarray:
    """The same vectors with ``bits`` planes: the sign plane repeats."""
    return np.concatenate([planes, np.repeat(planes[:, -1:], bits - planes.shape[1], axis=1)], axis=1)


def weights(bits: int) -> list[int]:
    """What a bit of each plane counts."""
    return [*(1 << b for b in range(bits - 1)), -(1 << (bits - 1))]


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact dot products of vectors (n, p) with one vector (q,) in planes: weighted population counts of ANDs."""
    out = np.zeros(len(x), np.int64)
    for b, w in zip(y, weights(len(y)), strict=True):
        if b:
            part = np.zeros(len(x), np.int64)
            for a, v in enumerate(weights(x.shape[1])):
                part += np.bitwise_count(x[:, a] & b).astype(np.int64) * v
            out += part * w
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Squared lengths; planes meet in pairs once."""
    w = weights(x.shape[1])
    out = np.zeros(len(x), np.int64)
    for a in range(len(w)):
        for b in range(a, len(w)):
            out += np.bitwise_count(x[:, a] & x[:, b]).astype(np.int64) * (w[a] * w[b] * (1 + (a < b)))
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and squared distance of each vector in planes."""
    planes = pack_planes(centroids)
    length = (centroids.astype(np.int64) ** 2).sum(axis=1)
    own = norms(x)
    best, of = None, np.zeros(len(x), np.int32)
    for k, y in enumerate(planes):
        d = own - 2 * dots(x, y) + length[k]
        if best is None:
            best = d
        else:
            nearer = d < best
            best[nearer], of[nearer] = d[nearer], k
    return of, best


def component_sums(x: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of each of ``k`` clusters, and their sums by component: bits are counted plane by plane."""
    counts = np.bincount(of, minlength=k)
    sums = np.zeros((k, WIDTH), np.int64)
    chosen = (of == np.arange(k)[:, None]).astype(np.float32)  # sums of up to 2**24 ones are exact
    for a, w in enumerate(weights(x.shape[1])):
        bits = np.unpackbits(np.ascontiguousarray(x[:, a]).view(np.uint8).reshape(len(x), 8), axis=1, bitorder="little")
        sums += (chosen @ bits.astype(np.float32)).astype(np.int64) * w
    return counts, sums


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have 64 components that are all finite, and those rows' values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == WIDTH)
    values = column.take(pa.array(at)).flatten()
    x = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    whole = np.isfinite(x).all(axis=1)
    return at[whole], x[whole]


def planes_of(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, planes): vectors of 64 finite components, each as floor(scale * x), packed; all others are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _vectors(batch.column("vector"))
            if len(at):
                scaled = np.floor(x * scale)
                if np.abs(scaled).max() >= 2.0 ** (MOST_BITS - 1):
                    raise ValueError(f"components beyond {MOST_BITS} bits: squared distances need more than 64")
                planes = pack_planes(scaled.astype(np.int64))
                spare = np.cumprod((planes[:, :-1] == planes[:, -1:])[:, ::-1], axis=1).sum(axis=1)  # sign planes that only repeat
                packed = [r[: len(r) - n].tobytes() for r, n in zip(planes, spare, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(packed, pa.binary())], names=["id", "planes"])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("planes", T.BinaryType())]))


def _read(column: pa.Array) -> np.ndarray:
    """Planes of a batch; rows packed with fewer are widened."""
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) // 8
    words = np.frombuffer(b"".join(column.to_pylist()), "<u8")
    ends = np.cumsum(lengths)
    at = np.minimum(np.arange(lengths.max()), lengths[:, None] - 1) + (ends - lengths)[:, None]
    return words[at]


def _over(step: Callable[[np.ndarray], tuple], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of a task over its batches: a row for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for batch in batches:
            if batch.num_rows:
                n, s = step(_read(batch.column("planes")))
                counts += n
                sums += s
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def refine(planes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector goes to the nearest centroid, every centroid to the floor of its vectors' mean.

    A task sends a count and 64 sums for each centroid, whatever it has read.
    """
    k = len(centroids)

    def step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return component_sums(x, nearest(x, centroids)[0], k)

    parts = planes.select("planes").mapInArrow(_over(step, k), "cluster int, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("component", "part"))
    totals = totals.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = centroids.copy()
    for r in totals.collect():  # at most 64 rows for each centroid
        out[r["cluster"], r["component"]] = r["total"] // r["n"]
    return out


def first_centroids(planes: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose id has the least SHA-256 after the seed (``seed:id``), in that order."""
    named = planes.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256))
    rows = named.orderBy("h", "planes").limit(k).collect()
    out = np.zeros((len(rows), WIDTH), np.int64)
    for i, r in enumerate(rows):
        words = np.frombuffer(r["planes"], "<u8")
        bits = np.unpackbits(words.view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little").astype(np.int64)
        out[i] = np.array(weights(len(words))) @ bits
    return out


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """Exact k-means over integer vectors of 64 components.

    Only vectors with exactly 64 components, none null or non-finite, take part, as floor(scale * x). Returns id_col, cluster,
    distance (squared, to its centroid), cluster_inertia and inertia (sums of distances), centroid_sha256. Repeated rows and ids count each;
    of equal ids the vectors with the lesser planes come first as centroids; a null id hashes as the empty text. With fewer than ``k``
    vectors each is a centroid, and an empty table gives none. Other columns are not read. Components of over 28 bits raise, as
    distances wouldn't fit 64 bits, and so do sums that don't.
    """
    planes = cut(planes_of(df, id_col, vector_col, scale))
    centroids = first_centroids(planes, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = refine(planes, centroids)
        if np.array_equal(moved, centroids):
            break  # later rounds would change nothing
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of, distance = nearest(_read(batch.column("planes")), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(of), pa.array(distance)], names=["id", "cluster", "distance"])

    schema = T.StructType([planes.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = cut(planes.mapInArrow(assign, schema))
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    rows = [(j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    if any(total >= 1 << 63 for _, _, total, _ in rows):
        raise ValueError("the inertia doesn't fit 64 bits")
    about = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
