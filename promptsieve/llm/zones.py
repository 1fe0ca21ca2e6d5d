"""Centroid clustering over Hilbert-ordered blocks with min/max boxes.

Vectors are turned into whole numbers once, projected to a few dimensions, ordered by their cell's place along a Hilbert
curve through these, and cut into blocks of neighbours. A block is one row of a table in the shared folder: the ids,
the components in as few bytes as they need, and the least and greatest value of each component.
A round reads blocks only. From a block's box follow the least and greatest distance that any of its vectors can have
to each centroid; centroids whose least distance exceeds another's greatest are out, and the block's
vectors are compared with the rest exactly. A task adds up counts and sums of its vectors, so a round
sends some numbers per task and centroid, and the driver holds centroids only.

Range partitions follow the curve and then the id, so a group of equal vectors is spread as well. All arithmetic is in
whole numbers: products go through floating point only while they are exact there.

Defined results: vectors that are null, of another length, or hold a null or a number that is not finite are left out; components
beyond +-2**27 after scaling count as that, so that a distance fits a long, and a sum of distances that does not
is the greatest long; a null id counts as an empty one in the choice of the first centroids, rows of equal
id are told apart by their vector; with fewer vectors than centroids each is one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptsieve.llm.common import written
from promptsieve.llm.packing import hilbert_keys

SCALE, LIMIT = 64, 1 << 27
DIMENSIONS, BITS = 8, 7  # of the curve
BLOCK = 64
EXACT = 1 << 21  # products of components up to this add up exactly in a double
WIDTHS = (np.dtype("<i1"), np.dtype("<i2"), np.dtype("<i4"))


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(64 x) of every component, as 64-bit integers within +-``LIMIT``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def kept(frame: DataFrame, key: str, vector: str, length: int) -> DataFrame:
    """(key, vector) of the usable vectors."""
    column = F.col(f"`{vector}`")
    kind = frame.select(column).schema[0].dataType.elementType
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        column = column.cast("array<double>")
    return frame.select(F.col(f"`{key}`").alias("key"), column.alias("vector")).filter(
        F.coalesce((F.size("vector") == length) & F.forall("vector", lambda x: F.coalesce(
            ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False)))


def first_centroids(vectors: DataFrame, count: int, length: int, seed: int) -> np.ndarray:
    """The vectors of least hash of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = vectors.withColumn("order", order).orderBy("order", "vector").limit(count).select("vector").collect()
    return whole(np.array([r.vector for r in rows], dtype=np.float64).reshape(len(rows), length))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, length)


def _keyed(length: int, seed: int):
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (length, DIMENSIONS))

    def apply(batches):
        for batch in batches:
            if not len(batch):
                continue
            cells = whole(_matrix(batch.column(1), length))
            norm = np.sqrt((cells.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
            # A projection's spread is the norm; three of them fill the curve's square.
            places = (cells @ signs / np.maximum(3 * norm, 1e-9) + 1) * (1 << (BITS - 1))
            keys = hilbert_keys(np.clip(places, 0, (1 << BITS) - 1).astype(np.int64), BITS)
            reach = np.abs(cells).max(axis=1, initial=0)
            kinds = np.where(reach < 1 << 7, 0, np.where(reach < 1 << 15, 1, 2))
            packed = [cells[i].astype(WIDTHS[k]).tobytes() for i, k in enumerate(kinds.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(packed, pa.binary())],
                                             names=["key", "curve", "cells"])

    return apply


def _unpacked(data: bytes, length: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, WIDTHS[{1: 0, 2: 1, 4: 2}[len(data) // (length * rows)]]).reshape(rows, length).astype(np.int64)


def _blocked(length: int, block: int):
    def apply(batches):
        for batch in batches:
            packed = batch.column(1).to_pylist()
            for at in range(0, len(packed), block):
                cells = np.stack([_unpacked(p, length, 1)[0] for p in packed[at:at + block]])
                low, high = cells.min(axis=0), cells.max(axis=0)
                reach = max(-int(low.min()), int(high.max()))
                kind = WIDTHS[0 if reach < 1 << 7 else 1 if reach < 1 << 15 else 2]
                keys = batch.column(0).slice(at, len(cells))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), pa.concat_arrays([keys])),
                     pa.array([len(cells)], pa.int32()), pa.array([cells.astype(kind).tobytes()], pa.binary()),
                     pa.array([low.astype("<i4").tobytes()], pa.binary()), pa.array([high.astype("<i4").tobytes()], pa.binary())],
                    names=["keys", "rows", "cells", "low", "high"])

    return apply


def blocks(vectors: DataFrame, length: int, block: int = BLOCK, seed: int = 20240229) -> DataFrame:
    """(keys, rows, cells, low, high), one row per block of neighbours along the curve."""
    kind = vectors.schema["key"].dataType
    keyed = vectors.mapInArrow(_keyed(length, seed), T.StructType([
        T.StructField("key", kind), T.StructField("curve", T.LongType()), T.StructField("cells", T.BinaryType())]))
    ordered = keyed.repartitionByRange("curve", "key").sortWithinPartitions("curve", "key").select("key", "cells")
    return written(ordered.mapInArrow(_blocked(length, block), T.StructType([
        T.StructField("keys", T.ArrayType(kind)), T.StructField("rows", T.IntegerType()), T.StructField("cells", T.BinaryType()),
        T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType())])), "zones-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to some vector of the box."""
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    across = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    least, greatest = (outside * outside).sum(axis=1), (across * across).sum(axis=1)
    return np.flatnonzero(least <= greatest.min())


def nearest(cells: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each vector; ties go to the smaller number."""
    numbers = candidates(low, high, centroids)
    chosen = centroids[numbers]
    reach = max(np.abs(low).max(), np.abs(high).max(), np.abs(chosen).max())
    if reach < EXACT:
        products = (cells.astype(np.float64) @ chosen.T.astype(np.float64)).astype(np.int64)
        distances = (cells * cells).sum(axis=1)[:, None] - 2 * products + (chosen * chosen).sum(axis=1)
    else:
        distances = np.stack([((cells - c) ** 2).sum(axis=1) for c in chosen], axis=1)
    best = distances.argmin(axis=1)
    return numbers[best], distances[np.arange(len(cells)), best]


def _read(batch: pa.RecordBatch, length: int):
    """The blocks of a batch with columns rows, cells, low, high."""
    for rows, cells, low, high in zip(*(batch.column(n).to_pylist() for n in ("rows", "cells", "low", "high"))):
        yield (_unpacked(cells, length, rows), np.frombuffer(low, "<i4").astype(np.int64), np.frombuffer(high, "<i4").astype(np.int64))


SUMS = "cluster int, n long, sums array<long>, high_part long, low_part long, pairs long"


def _summed(centroids: np.ndarray):
    """Counts, sums, distances and compared pairs of one task, by centroid."""
    count, length = centroids.shape

    def apply(batches):
        n, sums, parts, pairs = np.zeros(count, np.int64), np.zeros((count, length), np.int64), np.zeros((2, count), np.int64), 0
        for batch in batches:
            for cells, low, high in _read(batch, length):
                numbers, distances = nearest(cells, low, high, centroids)
                pairs += len(cells) * len(candidates(low, high, centroids))
                for c in np.unique(numbers).tolist():
                    mine = numbers == c
                    n[c] += mine.sum()
                    sums[c] += cells[mine].sum(axis=0)
                    parts[0, c] += (distances[mine] >> 32).sum()
                    parts[1, c] += (distances[mine] & 0xFFFFFFFF).sum()
        if n.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(count, dtype=np.int32)), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64())),
                 pa.array(parts[0]), pa.array(parts[1]), pa.array([pairs] + [0] * (count - 1), pa.int64())],
                names=["cluster", "n", "sums", "high_part", "low_part", "pairs"])

    return apply


def totals(table: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, sums, inertia, pairs) over all blocks: as many rows as centroids reach the driver."""
    partial = table.select("rows", "cells", "low", "high").mapInArrow(_summed(centroids), SUMS)
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]
    found = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *sums, F.sum("high_part").alias("high_part"),
                                           F.sum("low_part").alias("low_part"), F.sum("pairs").alias("pairs")).collect()
    return [(r.cluster, r.n, [r[f"s{i}"] for i in range(centroids.shape[1])], (r.high_part << 32) + r.low_part, r.pairs) for r in found]


def moved(centroids: np.ndarray, found: list) -> np.ndarray:
    """Each centroid that has vectors is replaced by floor(sum / count) of their components."""
    after = centroids.copy()
    for cluster, n, sums, _, _ in found:
        if n:
            after[cluster] = [s // n for s in sums]
    return after


def _assigned(centroids: np.ndarray, found: list):
    most = (1 << 63) - 1
    inertias = {c: i for c, _, _, i, _ in found}
    cluster_inertia = np.array([min(inertias.get(c, 0), most) for c in range(len(centroids))], np.int64)
    inertia = min(sum(inertias.values()), most)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def apply(batches):
        for batch in batches:
            for i, (cells, low, high) in enumerate(_read(batch, centroids.shape[1])):
                numbers, distances = nearest(cells, low, high, centroids)
                keys = batch.column(0).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(numbers.astype(np.int32)), pa.array(distances), pa.array(cluster_inertia[numbers]),
                     pa.array(np.full(len(keys), inertia, np.int64)), pa.array([digests[c] for c in numbers.tolist()])],
                    names=["key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return apply


def fitted(vectors: DataFrame, count: int, rounds: int, length: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """The table of blocks and the centroids after the rounds."""
    centroids, table = first_centroids(vectors, count, length, seed), blocks(vectors, length)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, totals(table, centroids))
    return table, centroids


def clusters(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", *, count: int = 16, rounds: int = 3,
             length: int = 64, seed: int = 1) -> DataFrame:
    """One row per usable vector: key, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``, after ``rounds`` rounds and a last assignment."""
    vectors = kept(frame, key, vector, length)
    table, centroids = fitted(vectors, count, rounds, length, seed)
    found = totals(table, centroids) if len(centroids) else []
    return table.mapInArrow(_assigned(centroids, found), T.StructType([
        T.StructField("key", vectors.schema["key"].dataType), T.StructField("cluster", T.IntegerType()),
        *(T.StructField(n, T.LongType()) for n in ("distance", "cluster_inertia", "inertia")),
        T.StructField("centroid_sha256", T.StringType())])).withColumnRenamed("key", key)


def oracle(rounds: int = 3) -> str:
    parts = ["""
with kept as (
    select vec_id, embedding as e from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
cells as (
    select vec_id, i, floor(64 * e[i]::double)::bigint as x from kept, range(1, 65) as t(i)),
first as (
    select vec_id, row_number() over (order by sha256('1:' || vec_id)) - 1 as cluster from kept
    qualify cluster < 16),
c0 as (select cluster, i, x from first join cells using (vec_id))"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} as materialized (
    select vec_id, cluster, distance from (
        select v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x))::bigint as distance
        from cells v join c{r} c using (i) group by all)
    qualify row_number() over (partition by vec_id order by distance, cluster) = 1)""")
        if r < rounds:
            parts.append(f"""
m{r} as (
    select cluster, i, sum(x)::bigint as s, count(*) as n from a{r} join cells using (vec_id) group by all),
c{r + 1} as materialized (
    select c.cluster, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x)::bigint as x
    from c{r} c left join m{r} using (cluster, i))""")
    return ",".join(parts) + f""",
digests as (
    select cluster, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by cluster)
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
       (sum(distance) over ())::bigint as inertia, centroid_sha256
from a{rounds} join digests using (cluster)
"""
