"""Exact k-means on integer vectors over Hilbert-ordered blocks with zone maps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncframe.llm.arrow import record_batch
from syncframe.llm.common import Workspace

#: Components up to this have squared distances that fit in a long, for up to 256 of them.
MOST = 1 << 26
#: Up to this, sums of 64 squared differences are exact in doubles.
EXACT = 1 << 21


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places of cells (n x d, ``bits`` bits each) on the Hilbert curve, as big-endian byte strings.

    Skilling's way: undo the excess turns from the top bit down, then Gray-code; the transposed index is interleaved."""
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(d):
            on = (x[i] & bit) != 0
            swapped = np.where(on, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swapped)
            x[i] ^= swapped
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)], axis=0)  # bits x d x n
    packed = np.packbits(planes.reshape(bits * d, -1).astype(np.uint8), axis=0).T
    return np.ascontiguousarray(packed)


def box_bounds(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of any point of a box to each centroid."""
    under, over = low - centroids, centroids - high
    near = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    return (near * near).sum(axis=1), (far * far).sum(axis=1)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact, as longs (points x centroids)."""
    if points.shape[1] <= 64 and max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _candidates(low: bytes, high: bytes, centroids: np.ndarray) -> np.ndarray:
    """The centroids, by number, that can be nearest to some vector in the box: their least distance is at most the smallest of
    the greatest, so ties stay in."""
    near, far = box_bounds(*(np.frombuffer(b, np.int32).astype(np.int64) for b in (low, high)), centroids)
    return np.flatnonzero(near <= far.min())


def _nearest(data: bytes, centroids: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's vectors, their clusters (ties: the smaller number) and squared distances."""
    points = np.frombuffer(data, np.int32).reshape(-1, centroids.shape[1]).astype(np.int64)
    all_ = distances(points, centroids[candidates])
    best = all_.argmin(axis=1)
    return points, candidates[best], all_[np.arange(len(points)), best]


def _scaled(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """(vec_id, q) of the vectors that are kept; ``q`` are the scaled components as longs."""
    x = F.col(vector_col)
    sound = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    q = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    small = F.forall(x, lambda v: F.abs(F.lit(float(scale)) * v.cast("double")) < float(MOST))
    said = F.concat(F.lit("a component is too large for distances in longs: vector "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return df.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.when(small, q).otherwise(F.raise_error(said).cast("array<bigint>")).alias("q"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dims)


def hilbert_blocks(vectors: DataFrame, work: Workspace, dims: int, bits: int = 4, block_rows: int = 512) -> DataFrame:
    """Vectors (vec_id, q) as blocks along the Hilbert curve: n, ids, data (32-bit integers), low, high (the box) and total.

    A component falls in one of 2^bits cells between two deviations below and above its mean.  Equal vectors may fill any
    share of the table: the layout by range goes on by id and hash, so they spread over parts and blocks."""
    schema = "n long, sums array<long>, squares array<double>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dims, np.int64), np.zeros(dims)
        for batch in batches:
            points = _matrix(batch.column(0), dims)
            n, sums, squares = n + len(points), sums + points.sum(axis=0), squares + (points.astype(np.float64) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.int64())), pa.array([squares.tolist()], pa.list_(pa.float64()))], names=["n", "sums", "squares"])

    parts = vectors.select("q").mapInArrow(measure, schema)
    each = parts.select("n", F.posexplode(F.arrays_zip("sums", "squares")).alias("at", "x"))
    found = each.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("x.sums").cast("double")).alias("s"), F.sum("x.squares").alias("s2")).orderBy("at").collect()
    mean = np.array([r.s / max(r.n, 1) for r in found])
    spread = np.sqrt(np.maximum(np.array([r.s2 / max(r.n, 1) for r in found]) - mean**2, 0)) * 2 + 0.5
    cells = 1 << bits

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1), dims)
            at = np.clip((points - mean + spread) * (cells / (2 * spread)), 0, cells - 1).astype(np.uint32)
            keys = hilbert_keys(at, bits)
            rows = points.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "key", "data"]
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    keyed = work.save(vectors.mapInArrow(place, f"vec_id {kind}, key binary, data binary"), "keyed", 4096, "8m")
    parts_n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = keyed.repartitionByRange(parts_n, "key", "vec_id", F.xxhash64("data")).sortWithinPartitions("key", "vec_id", "data").select("vec_id", "data")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        rows: list[bytes] = []

        def block(ids: pa.Array, rows: list[bytes]) -> pa.RecordBatch:
            data = b"".join(rows)
            points = np.frombuffer(data, np.int32).reshape(-1, dims)
            columns = [[len(rows)], [ids.to_pylist()], [data], [points.min(axis=0).tobytes()], [points.max(axis=0).tobytes()], [points.sum(axis=0, dtype=np.int64).tobytes()]]
            return record_batch(pa.schema([("n", pa.int64()), ("ids", pa.list_(ids.type)), *[(c, pa.binary()) for c in ("data", "low", "high", "total")]]), columns)

        for batch in batches:
            ids, rows = [*ids, batch.column(0)], rows + batch.column(1).to_pylist()
            while len(rows) >= block_rows:
                joined = pa.concat_arrays(ids)
                yield block(joined[:block_rows], rows[:block_rows])
                ids, rows = [joined[block_rows:]], rows[block_rows:]
        if rows:
            yield block(pa.concat_arrays(ids), rows)

    blocks = work.save(laid.mapInArrow(pack, f"n long, ids array<{kind}>, data binary, low binary, high binary, total binary"), "blocks", 4096, "8m")
    work.drop("keyed")
    return blocks


def _first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of smallest hash of seed and id, in that order; equal ids by their components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(mark.alias("mark"), "q").orderBy("mark", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    dims = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch in batches:
            for n, low, high, total, data in zip(*(batch.column(c) for c in ("n", "low", "high", "total", "data")), strict=True):
                candidates = _candidates(low.as_py(), high.as_py(), centroids)
                if len(candidates) == 1:  # the box alone decides
                    counts[candidates[0]] += n.as_py()
                    sums[candidates[0]] += np.frombuffer(total.as_py(), np.int64)
                    continue
                points, cluster, _ = _nearest(data.as_py(), centroids, candidates)
                counts += np.bincount(cluster, minlength=len(centroids))
                for c in candidates:
                    sums[c] += points[cluster == c].sum(axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    partial = blocks.select("n", "low", "high", "total", "data").mapInArrow(add, "cluster long, n long, sums array<long>")
    wide = partial.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at")
    moved = centroids.copy()
    for r in wide.agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect():  # k x dims rows
        moved[r.cluster, r.at] = int(r.s) // r.n
    return moved


def centroid_clusters(
    df: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: float = 1024.0, seed: str = "3",
    bits: int = 4, block_rows: int = 512,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of ``dims`` components, none null or not finite, are kept; a component x becomes floor(scale * x).  Centroids
    begin as the ``k`` vectors (or all, if fewer) of smallest SHA-256 of ``seed:id``; each round assigns every vector to the
    nearest (ties: the smaller number) and moves each centroid that has vectors to the floor of their mean.  All arithmetic
    is on integers, so the result is exact and does not follow the layout.

    Vectors lie in blocks along the Hilbert curve with a box of smallest and greatest components.  A round compares boxes with
    centroids first: a block whose box leaves one candidate adds its stored sum, others compare their vectors with their
    candidates only.  Tasks send a row of sums for each centroid; ``k * dims`` sums reach the driver.

    Repeated ids are rows of their own (equal ids tie by components), a null id counts as empty text in the hash and stays
    null.  A component beyond 2^26 after scaling is an error that names its vector: its squared distance would not fit in a
    long.  An empty table, or one without sound vectors, gives an empty result.  Other columns are ignored."""
    work, spark = Workspace(df.sparkSession), df.sparkSession
    vectors = _scaled(df, id_col, vector_col, dims, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = _first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    blocks = hilbert_blocks(vectors, work, dims, bits, block_rows)
    for _ in range(rounds):
        moved = _moved(blocks, centroids)
        if np.array_equal(moved, centroids):  # further rounds would change nothing
            break
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (low, high, data) in enumerate(zip(*(batch.column(c) for c in ("low", "high", "data")), strict=True)):
                _, cluster, distance = _nearest(data.as_py(), centroids, _candidates(low.as_py(), high.as_py(), centroids))
                ids = batch.column(0)[k].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    rows = work.save(blocks.select("ids", "low", "high", "data").mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "assigned", 4096, "8m")
    work.drop("blocks")
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = F.col("cluster") + 1
    return rows.select(
        "vec_id", "cluster", "distance", F.element_at(F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(marks))]), at).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), F.element_at(F.array(*[F.lit(m) for m in marks]), at).alias("centroid_sha256"),
    )
