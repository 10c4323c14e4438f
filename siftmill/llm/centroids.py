"""Centroid clustering of integer vectors with zone maps along a Hilbert curve.

Vectors are laid out once: range-partitioned by their place on a Hilbert curve, cut into blocks of neighbours, each with the
least and the greatest value per dimension. A block's box bounds the distance of all of its vectors to a centroid from
below and above; centroids that lie farther than another one from every point of the box can't win there, and the rest are
compared exactly, a block at a time in numpy. Rounds read the blocks and return sums per centroid only.

Kept are vectors with exactly ``dims`` components, none null or non-finite; each component x becomes floor(scale * x). All
arithmetic is on integers, so results don't depend on how rows are dealt. Components of 2**26 or more after scaling are an error,
as squared distances would leave 64 bits. Repeated rows are vectors of their own; ties go to the centroid with the smaller number;
among equal start hashes (repeated ids; null ids come last) the smaller components come first. With fewer vectors than
centroids each vector starts one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of a block; bits per dimension of the curve's grid.
BLOCK_ROWS, GRID_BITS = 256, 3
LIMIT = 1 << 26

BLOCKS = "ids array<bigint>, vectors array<bigint>, low array<bigint>, high array<bigint>"
SUMS = "cluster int, n bigint, compared bigint, inertia bigint, sums array<bigint>"
ASSIGNED = "vec_id bigint, cluster int, distance bigint"


@dataclass
class Clusters:
    """Final centroids (k x dims), the inertia of each, the share of distances that was computed, and the assignment of vectors."""

    centroids: np.ndarray
    inertia: list[int]
    compared: float
    assigned: DataFrame


def kept_vectors(vectors: DataFrame, dims: int, scale: int, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as 64-bit integers."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return vectors.filter((F.size(column) == dims) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def hilbert(cells: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (rows x dims, 0 to 2**bits - 1) as rows of bytes in curve order."""
    axes = cells.astype(np.uint8).T.copy()
    dims = len(axes)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of the finer levels
        low = np.uint8(q - 1)
        for i in range(dims):
            turned = (axes[i] & q) != 0
            swap = np.where(turned, 0, (axes[0] ^ axes[i]) & low).astype(np.uint8)
            axes[0] ^= np.where(turned, low, swap)
            axes[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        axes[i] ^= axes[i - 1]
    flips = np.zeros(axes.shape[1], dtype=np.uint8)
    q = top
    while q > 1:
        flips ^= np.where((axes[dims - 1] & q) != 0, np.uint8(q - 1), np.uint8(0))
        q >>= 1
    axes ^= flips
    levels = [(axes >> np.uint8(b)) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(levels).T, axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _spread(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation per dimension (a row per task is summed)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares, most = 0, np.zeros(dims), np.zeros(dims), 0
        for batch in batches:
            v = _matrix(batch.column("v"), dims)
            if len(v):
                most = max(most, int(np.abs(v).max()))
                n, total, squares = n + len(v), total + v.sum(axis=0), squares + np.square(v.astype(float)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([most]), pa.array([total.tolist()]), pa.array([squares.tolist()])], names=["n", "most", "s", "q"])

    found = rows.select("v").mapInArrow(moments, "n bigint, most bigint, s array<double>, q array<double>")
    sums = found.agg(F.sum("n").alias("n"), F.max("most").alias("most"), *[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in "sq" for i in range(dims)]).first()
    if (sums["most"] or 0) >= LIMIT:
        raise ValueError(f"a scaled component of {sums['most']}: squared distances would leave 64 bits")
    n = max(1, sums["n"] or 0)
    mean = np.array([(sums[f"s{i}"] or 0) / n for i in range(dims)])
    return mean, np.sqrt(np.maximum(np.array([(sums[f"q{i}"] or 0) / n for i in range(dims)]) - mean**2, 0))


def zone_map(rows: DataFrame, dims: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of neighbours on the curve, written once: ids, vectors laid end to end, and the box around them.

    The grid spans two standard deviations either way of each dimension's mean, the widest dimensions first: they decide
    most of the order. Equal vectors are dealt on by id, so that a very common one spreads over partitions.
    """
    mean, deviation = _spread(rows, dims)
    order, cells = np.argsort(-deviation, kind="stable"), 1 << GRID_BITS
    step = np.maximum(deviation * 4 / cells, 1e-9)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dims)
            grid = np.clip(np.floor((v - mean) / step) + cells // 2, 0, cells - 1)[:, order]
            keys = hilbert(grid)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([k.tobytes() for k in keys], pa.binary())], names=["vec_id", "v", "place"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, parts, held
            if held >= block_rows or (last and held):
                own, v = pa.concat_arrays(ids), np.concatenate(parts)
                whole = held if last else held - held % block_rows
                starts = range(0, whole, block_rows)
                blocks = [v[a : min(a + block_rows, whole)] for a in starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own[a : min(a + block_rows, whole)].to_pylist() for a in starts], pa.list_(pa.int64())),
                        pa.array([b.ravel() for b in blocks], pa.list_(pa.int64())),
                        *(pa.array([f(b, axis=0) for b in blocks], pa.list_(pa.int64())) for f in (np.min, np.max)),
                    ],
                    names=["ids", "vectors", "low", "high"],
                )
                ids, parts, held = [own[whole:]], [v[whole:]], held - whole

        for batch in batches:
            ids.append(batch.column("vec_id"))
            parts.append(_matrix(batch.column("v"), dims))
            held += batch.num_rows
            yield from cut(False)
        yield from cut(True)

    placed = rows.mapInArrow(place, "vec_id bigint, v array<bigint>, place binary")
    keys = ["place", F.xxhash64("vec_id")]
    return written(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("vec_id", "v").mapInArrow(block, BLOCKS), "zone-map")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to a vector inside the box; never leaves a tie out.

    They are held against the centroid whose farthest corner is nearest: the difference of two squared distances is linear
    in the vector, so its greatest value over the box is reached, dimension by dimension, at one of the sides.
    """
    most = np.square(np.maximum(np.abs(centroids - low), np.abs(centroids - high))).sum(axis=1)
    best = centroids[most.argmin()]
    apart = centroids - best
    gain = 2 * np.where(apart > 0, apart * high, apart * low).sum(axis=1) + np.square(best).sum() - np.square(centroids).sum(axis=1)
    return np.flatnonzero(gain >= 0)


def nearest(vectors: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector of a block, and how many distances were computed."""
    among = candidates(low, high, centroids)
    distances = np.empty((len(among), len(vectors)), dtype=np.int64)
    for i, c in enumerate(among):
        d = vectors - centroids[c]
        distances[i] = np.einsum("ij,ij->i", d, d)
    best = distances.argmin(axis=0)
    return among[best].astype(np.int32), distances[best, np.arange(len(vectors))], distances.size


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, vectors, low, high in zip(*(batch.column(c) for c in ("ids", "vectors", "low", "high")), strict=True):
            v, low, high = (x.values.to_numpy(zero_copy_only=False) for x in (vectors, low, high))
            yield ids.values, v.reshape(-1, dims), low, high


def _round(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, int, list[int]]]:
    """Per non-empty centroid: its vectors, the distances computed, their sum, and the sum per dimension; k rows reach the driver."""
    dims = centroids.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        n, compared, inertia, total = np.zeros(k, np.int64), 0, np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, v, low, high in _blocks(batches, dims):
            cluster, distance, size = nearest(v, low, high, centroids)
            compared += size
            n += np.bincount(cluster, minlength=k)
            np.add.at(inertia, cluster, distance)
            for c in np.unique(cluster):
                total[c] += v[cluster == c].sum(axis=0)
        at = np.flatnonzero(n)
        shares = np.where(np.arange(len(at)) == 0, compared, 0)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(shares), pa.array(inertia[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], names=["cluster", "n", "compared", "inertia", "sums"])

    wide = "decimal(38,0)"  # sums of many tasks may leave 64 bits
    found = blocks.mapInArrow(sums, SUMS).groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("compared").alias("compared"), F.sum(F.col("inertia").cast(wide)).alias("inertia"),
        F.array(*[F.sum(F.get("sums", F.lit(i)).cast(wide)) for i in range(dims)]).alias("sums"),
    )
    return {r["cluster"]: (r["n"], r["compared"], int(r["inertia"]), [int(s) for s in r["sums"]]) for r in found.collect()}


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.withColumn("_hash", hashed).orderBy(F.col("_hash").asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, column: str = "embedding",
            block_rows: int = BLOCK_ROWS) -> Clusters | None:
    """Lloyd rounds over the zone map, then one more assignment; None where no vector is kept."""
    rows = kept_vectors(vectors, dims, scale, column)
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return None
    blocks = zone_map(rows, dims, block_rows)
    for _ in range(rounds):
        found = _round(blocks, centroids)
        centroids = np.array([[s // found[c][0] for s in found[c][3]] if c in found else old.tolist() for c, old in enumerate(centroids)], dtype=np.int64)
    last = _round(blocks, centroids)
    every = sum(f[0] for f in last.values()) * len(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, low, high in _blocks(batches, dims):
            own, distance, _ = nearest(v, low, high, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return Clusters(centroids, [last[c][2] if c in last else 0 for c in range(len(centroids))], sum(f[1] for f in last.values()) / every, blocks.mapInArrow(assign, ASSIGNED))


def centroid_sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def labelled(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance of every kept vector, with the inertia of its cluster and of all, and its centroid's digest."""
    found = cluster(vectors, **options)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    own = F.array(*[F.lit(x).cast("long") for x in found.inertia])
    digests = F.array(*[F.lit(centroid_sha256(c)) for c in found.centroids])
    return found.assigned.select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(found.inertia)).cast("long").alias("inertia"),
        F.get(digests, F.col("cluster")).alias("centroid_sha256"),
    )
