import hashlib
import math

import numpy as np
import pytest

from promptsieve.llm import zones


def plain(rows, count=16, rounds=3, length=64):
    """{id: (cluster, distance)}, centroids; in Python's whole numbers."""
    kept = [(i, [max(-zones.LIMIT, min(zones.LIMIT, math.floor(64 * float(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:count]]

    def assign():
        found = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            found.append((i, v, d.index(min(d)), min(d)))
        return found

    for _ in range(rounds):
        groups = {}
        for _, v, c, _ in assign():
            groups.setdefault(c, []).append(v)
        for c, vs in groups.items():
            centroids[c] = [sum(col) // len(vs) for col in zip(*vs)]
    return assign(), centroids


def check(frame, rows, **options):
    want, centroids = plain(rows, **options)
    got = zones.clusters(frame, **options).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == sorted(((i, c, d) for i, _, c, d in want), key=str)
    for r in got:
        assert r.cluster_inertia == min(sum(d for _, _, c, d in want if c == r.cluster), 2**63 - 1)
        assert r.inertia == min(sum(d for *_, d in want), 2**63 - 1)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_equals_plain_clustering(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(frame, [(r.vec_id, r.embedding) for r in frame.collect()])


def test_boxes_leave_out_only_what_cannot_win():
    rng = np.random.default_rng(5)
    left = 0
    for _ in range(300):
        centroids = rng.integers(-50, 50, (16, 6))
        cells = rng.integers(-50, 50, 6) + rng.integers(-8, 9, (30, 6))
        low, high = cells.min(axis=0), cells.max(axis=0)
        numbers, distances = zones.nearest(cells, low, high, centroids)
        full = ((cells[:, None] - centroids) ** 2).sum(axis=2)
        assert (numbers == full.argmin(axis=1)).all() and (distances == full.min(axis=1)).all()
        left += 16 - len(zones.candidates(low, high, centroids))
    assert left > 300 * 8


def test_neighbouring_blocks_compare_with_few(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 64))
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=64) / 20]) for i in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table, centroids = zones.fitted(zones.kept(frame, "vec_id", "embedding", 64), 16, 3, 64, 1)
    assert sum(pairs for *_, pairs in zones.totals(table, centroids)) < 0.7 * 16 * len(rows)


def test_odd_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [-0.013] * 64), (3, None), (4, [1.0] * 63), (5, [1.0] * 65), (6, [math.nan] * 64),
            (7, [math.inf] + [0.0] * 63), (8, [None] + [0.0] * 63), (9, []), (10, [3e38] * 64), (11, [-3e38] * 64), (12, [1e5] * 64),
            (None, [0.25] * 64), (1, [0.5] * 64), (1, [0.75] * 64), (13, [0.5] * 64), (14, [0.0] * 64)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame([(*r, 0, "k") for r in rows], "vec_id long, embedding array<float>, cluster int, key string")
    for count in (16, 3):
        check(frame, rows, count=count)
    assert zones.clusters(frame.filter("vec_id = 3")).count() == 0
    assert zones.clusters(frame.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    sound = [(str(i), v) for i, v in rows if i in (2, 12, 13, 14)]
    check(spark.createDataFrame(sound, "vec_id string, embedding array<double>").selectExpr(
        "vec_id", "cast(embedding as array<decimal(38, 18)>) as embedding"), sound)


@pytest.mark.parametrize("bits", [3, 7, 15])
def test_packed_components(bits):
    cells = np.array([[-(1 << bits) + 1, (1 << bits) - 1]])
    assert (zones._unpacked(cells.astype("<i4").tobytes(), 2, 1) == cells).all()
