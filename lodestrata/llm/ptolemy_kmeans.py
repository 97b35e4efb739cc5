"""Centroid clustering in integers, with Ptolemaic lower bounds from cached pivot distances.

1. Vectors of exactly ``dims`` finite components become integers floor(scale * x). Those with the
   smallest SHA-256 of "seed:id" are the first centroids, and also the pivots. Integers
   and the distances to the pivots are written once; a round reads them and nothing else.
2. For pivots p, q, a vector x and a centroid c, Ptolemy's inequality gives
   d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q). Pairs are fixed: each pivot with the next
   one, in a ring. The products are rounded against the bound (``SLACK`` is more than the error of
   all steps together), so a bound is never above the true distance.
3. The centroid with the least bound is measured exactly, then each other one whose bound does
   not exceed that distance (equal ones too, since ties go to the smaller number). All measured
   distances are 64-bit integers, so the result does not depend on the bounds or on rounding.
4. A task adds up its vectors per cluster and gives dims x clusters sums at its end; these are added by one
   small aggregate and come to the driver: a number of rows that does not depend on the input.
   The new component is the exact floor of sum / count; a centroid without vectors stays.

No vector is shuffled and a hot cluster is no hot key. A lost task is read again from the
written table.

Defined cases: a null, short or long vector and one with null or non-finite components takes no
part; neither does one with an integer of 2^27 or more, whose squared distance could not be held
by a long; with fewer vectors than clusters there are fewer clusters; repeated rows are rows of their own;
equal ids are told apart by their integers when first centroids are chosen, null ids come last there; an empty table
gives an empty result; an inertia beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import discard, saved, table

DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Components of this size and more are left out: 64 (2^28)^2 is the last sum below 2^63.
MOST = 1 << 27
#: Relative error allowed for in a bound; a product of rounded roots has less than 2^-50.
SLACK = 2.0 ** -46

Centroids = list[list[int]]


def _components(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept rows, their finite doubles); a row is kept if it has ``dims`` finite components."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(right)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # nulls become NaN
    fine = np.isfinite(values).all(axis=1)
    return right[fine], values[fine]


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS,
             scale: int = SCALE) -> DataFrame:
    """vec_id and the integers ``v`` of the vectors that take part."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = _components(batch.column(1), dims)
            whole = np.floor(values * scale)
            small = (np.abs(whole) < MOST).all(axis=1)
            whole = whole[small].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32) * dims), pa.array(whole.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[small])), lists], names=["vec_id", "v"])

    chosen = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return chosen.mapInArrow(run, "vec_id long, v array<int>")


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> Centroids:
    """The vectors with the smallest hashes, in that order; a top-k, so no sort of all rows."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in whole.orderBy(digest.asc_nulls_last(), "v").limit(clusters).select("v").collect()]


def _squares(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = vectors - centroid
    return np.einsum("ij,ij->i", gap, gap)


def _matrix(column: pa.ListArray, dims: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def with_pivot_distances(whole: DataFrame, pivots: Centroids) -> DataFrame:
    """``whole`` with ``p``: the distance of each vector to each pivot, rounded to the nearest double."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.array(pivots, np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(1), points.shape[1], np.int64)
            near = np.sqrt(np.stack([_squares(vectors, p) for p in points], axis=1).astype(np.float64))
            offsets = np.arange(len(near) + 1, dtype=np.int32) * len(points)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "v", "p"])

    return whole.mapInArrow(run, "vec_id long, v array<int>, p array<double>")


def lower_bounds(to_pivots: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Bounds from below on the squared distance of each row to each centroid."""
    out = np.zeros((len(to_pivots), len(centroids)))
    from_centroids = np.sqrt(np.stack([_squares(centroids, p) for p in pivots], axis=1).astype(np.float64))
    for a in range(len(pivots)):
        b = (a + 1) % len(pivots)
        apart = float(np.sqrt(float(_squares(pivots[a:a + 1], pivots[b])[0])))
        if apart == 0 or len(pivots) == 2 and a == 1:
            continue
        x = to_pivots[:, a:a + 1] * from_centroids[None, :, b]
        y = to_pivots[:, b:b + 1] * from_centroids[None, :, a]
        np.maximum(out, (np.abs(x - y) - SLACK * (x + y)) / apart * (1 - SLACK), out=out)
    return out * out * (1 - SLACK)


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of every row, ties to the smaller number, and how many distances were measured."""
    bounds = lower_bounds(to_pivots, pivots, centroids)
    first = bounds.argmin(axis=1)
    best, cluster, measured = _squares(vectors, centroids[first]), first.copy(), len(vectors)
    for j, centroid in enumerate(centroids):
        # A bound equal to the best distance survives: it may be a tie that the smaller number wins.
        left = np.flatnonzero((bounds[:, j] <= best.astype(np.float64) * (1 + SLACK)) & (first != j))
        found = _squares(vectors[left], centroid)
        better = (found < best[left]) | ((found == best[left]) & (j < cluster[left]))
        best[left[better]], cluster[left[better]] = found[better], j
        measured += len(left)
    return cluster, best, measured


def _assigned(batches: Iterable[pa.RecordBatch], pivots: Centroids, centroids: Centroids):
    points, middles = np.array(pivots, np.int64), np.array(centroids, np.int64)
    for batch in batches:
        vectors = _matrix(batch.column(1), points.shape[1], np.int64)
        yield batch, vectors, *nearest(vectors, _matrix(batch.column(2), len(points), np.float64), points, middles)


def next_centroids(cached: DataFrame, pivots: Centroids, centroids: Centroids) -> Centroids:
    """One round: assign all vectors, then the floors of the means."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, vectors, cluster, _, _ in _assigned(batches, pivots, centroids):
            for j in range(k):
                mine = cluster == j
                sums[j] += vectors[mine].sum(axis=0)
                counts[j] += mine.sum()
        for j in np.flatnonzero(counts):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([int(j)] * dims, pa.int32()), "at": pa.array(range(dims), pa.int32()),
                                              "total": pa.array(sums[j]), "n": pa.array([int(counts[j])] * dims, pa.int64())})

    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
    new = [list(c) for c in centroids]
    for r in cached.mapInArrow(run, "cluster int, at int, total long, n long").groupBy("cluster", "at").agg(*exact).collect():
        new[r.cluster][r.at] = int(r.total) // int(r.n)
    return new


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS,
                    scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, Centroids]:
    """(vec_id, cluster, distance) of every vector after the last round, and the centroids."""
    whole = integers(vectors, vec_id, embedding, dims, scale)
    pivots = first_centroids(whole, clusters, seed)
    if not pivots:
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    cached = saved(with_pivot_distances(whole, pivots), "cached")
    centroids = pivots
    for _ in range(rounds):
        after = next_centroids(cached, pivots, centroids)
        if after == centroids:  # nothing will move any more
            break
        centroids = after

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance, _ in _assigned(batches, pivots, centroids):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])

    placed = saved(cached.mapInArrow(run, "vec_id long, cluster int, distance long"), "placed")
    discard(cached)
    return placed, centroids


def op11_ptolemy_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    # One row per cluster, of which there are CLUSTERS at most.
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = lambda n: n if n < 1 << 63 else None
    rows = [(j, held(sums.get(j, 0)), held(sum(sums.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
            for j, c in enumerate(centroids)]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                                   "centroid_sha256")


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> str:
    """The same by comparing every vector with every centroid."""
    parts = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x) AND abs(floor({scale} * x::DOUBLE)) < {MOST})) = {dims}),
spread AS MATERIALIZED (SELECT rid, unnest(v) AS val, unnest(range({dims})) AS pos FROM kept),
seeds AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS cluster FROM kept
  QUALIFY cluster < {clusters}),
c0 AS MATERIALIZED (SELECT cluster, unnest(v) AS val, unnest(range({dims})) AS pos FROM seeds)"""]
    assign = """a{i} AS MATERIALIZED (SELECT rid, min({{'d': d, 'cluster': cluster}}) AS m FROM (
  SELECT rid, cluster, sum((s.val - c.val) * (s.val - c.val))::BIGINT AS d FROM spread s JOIN c{i} c USING (pos) GROUP BY ALL) GROUP BY rid)"""
    for i in range(rounds):
        parts.append(assign.format(i=i))
        parts.append(f"""n{i} AS MATERIALIZED (SELECT m.cluster AS cluster, pos, sum(val) AS s, count(*) AS n FROM spread JOIN a{i} USING (rid) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, c.pos, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c.val) AS val
  FROM c{i} c LEFT JOIN n{i} n ON n.cluster = c.cluster AND n.pos = c.pos)""")
    parts.append(assign.format(i=rounds))
    return f"""WITH {", ".join(parts)},
digest AS (SELECT cluster, sha256(string_agg(val::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, m.cluster::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.cluster))::BIGINT AS cluster_inertia,
  (sum(m.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a{rounds} USING (rid) JOIN digest ON digest.cluster = m.cluster"""


ORACLE = _oracle()
