"""Clustering against brute force in Python integers, bounds against true distances, odd rows."""

import hashlib
import math

import numpy as np

from lodestrata.llm import ptolemy_kmeans as pk


def brute(rows, clusters=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middles = [v for _, v in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((far(v, c), j) for j, c in enumerate(middles))
    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        for j in range(len(middles)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                middles[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *place(v)) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    each = [sum(d for _, d, j in found if j == c) for c in range(len(middles))]
    return sorted(((i, j, d, each[j], sum(each), digest[j]) for i, d, j in found), key=str)


def run(spark, rows, tmp_path, extra="cluster int"):
    spark.createDataFrame([(*r, 5) for r in rows], f"vec_id long, embedding array<float>, {extra}").write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, pk.op11_ptolemy_kmeans(spark, str(tmp_path)).collect()), key=str)


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_equals_brute_force_with_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(5, 64))
    rows = as_floats([(i, (middle[i % 5] + 0.3 * rng.normal(size=64)).tolist()) for i in range(150)])
    rows += rows[:4] + [(7, rows[20][1]), (None, rows[3][1]), (200, None), (201, []), (202, [0.0] * 63), (203, [0.0] * 65), (204, [0.0] * 64),
                        (205, [float("nan")] + [0.0] * 63), (206, [None] + [0.0] * 63), (207, [float("inf")] * 64), (208, [-3.5] * 64)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_ties_and_few_vectors(spark, tmp_path):
    rows = as_floats([(i, [float(i % 2)] * 64) for i in range(6)])
    got = run(spark, rows, tmp_path)
    assert got == brute(rows) and {r[2] for r in got} == {0}


def test_one_vector_many_times(spark, tmp_path):
    rows = as_floats([(i, [0.25] * 64) for i in range(300)] + [(1000 + i, [i / 7] * 64) for i in range(40)])
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_table_and_too_large(spark, tmp_path):
    assert run(spark, [(1, None)], tmp_path) == []
    found, centroids = pk.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<double>"))
    assert [r.vec_id for r in found.collect()] == [2] and centroids == [[1024] * 64]


def test_bounds_never_exceed_distances_and_prune():
    rng = np.random.default_rng(1)
    for size in (3, 1000, (1 << 27) - 1):
        vectors, pivots = rng.integers(-size, size, (400, 64)), rng.integers(-size, size, (6, 64))
        centroids = np.concatenate([pivots[:3], vectors[:4], rng.integers(-size, size, (3, 64))])
        to_pivots = np.sqrt(np.stack([pk._squares(vectors, p) for p in pivots], axis=1).astype(float))
        true = np.stack([pk._squares(vectors, c) for c in centroids], axis=1)
        bounds = pk.lower_bounds(to_pivots, pivots, centroids)
        assert all(int(b) <= int(t) for b, t in zip(np.floor(bounds).ravel(), true.ravel()))
        cluster, best, _ = pk.nearest(vectors, to_pivots, pivots, centroids)
        assert (cluster == true.argmin(axis=1)).all() and (best == true.min(axis=1)).all()
    # Vectors near the centroids: most others are ruled out by their bounds.
    middles = rng.integers(-1000, 1000, (8, 64))
    vectors = np.repeat(middles, 200, axis=0) + rng.integers(-20, 20, (1600, 64))
    to_pivots = np.sqrt(np.stack([pk._squares(vectors, p) for p in middles], axis=1).astype(float))
    assert pk.nearest(vectors, to_pivots, middles, middles)[2] < 1.2 * len(vectors)
