"""Approximate nearest neighbours: NN-descent graph, greedy graph search, exact scores at the end.

Graph. Equal vectors are one node. Every node starts with the nearest nodes of a few small
groups (random-hyperplane leaves, and one grouping by hash, which also connects what the
leaves keep apart). Then each round joins the neighbours of a node with each other: the
members of a node's list (forward and reverse neighbours) meet in one row, numpy compares
all of them, and every member gets the nearest few it met. An aggregate keeps the best
``degree`` of each node. Rounds are Spark joins: edges with vectors on the member, then
grouped by the common neighbour.

Search. All queries walk the graph together: each round opens the best ``beam`` nodes a
query has not opened yet, joins their neighbours, scores the new ones and keeps the best
``pool``. A query starts at its own node. At the end the pool is scored exactly, in double
precision on the original vectors, and copies of a vector are listed by vec_id.

Rounds end when fewer than ``FEW_NEWS`` of all list entries are new, the search when fewer than
``FEW_CHANGED`` of the queries have a new node among their best: both by what they find, not by a fixed number.

Nearness is the inner product. Base vectors are divided by a large norm and get one more
coordinate that makes them unit vectors; a query has 0 there. Inner products keep their
order, and near in the graph means near in angle. That norm is the ``GIANTS``-th largest, so that a
few outliers do not squeeze all others into one direction; the ``GIANTS`` nodes of the largest norms, a number
that does not grow with the table, are compared with every query and are where its walk starts, beside its own node.

Graph and search work on vectors of one byte per coordinate (the added one is kept whole, it would
spoil the scale of the others); the bytes that are shuffled per round are about
``2 * degree * (dimensions + 20)`` a node, so rounds grow linearly with the table.

Bounds: lists have at most ``degree`` forward and ``degree`` reverse neighbours (the nearest
ones), so a node that is near to very many others is in few rows; a group of the start holds
about ``LEAF`` nodes, a crowded leaf is cut by hash; equal vectors keep their ``top`` + 1
smallest vec_ids, which is all that any result can need. Recall is measured in the tests.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have
another length than most take no part, neither as query nor as candidate; rows with equal
vec_id are rows of their own; fewer than ``top`` candidates give all of them; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import ROW, discard, numbered, saved, table

TOP = 20
DEGREE = 32
#: Nearest members that a member is told about in one local join.
TOLD = 8
LEAF = 1024
TREES = 12
BEAM = 40
POOL = 200
FEW_NEWS = 0.01
FEW_CHANGED = 0.005
GIANTS = 256
SEED = 42


def valid_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, row number and the components as bytes (float64) of the rows that take part."""
    rows = numbered(vectors, "vec_id", "embedding").select("vec_id", ROW, F.col("embedding").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, packed = [], []
            for at, row in enumerate(batch.column(2)):
                if row.is_valid and row.values.null_count == 0 and len(row.values):
                    v = row.values.to_numpy()
                    if np.isfinite(v).all() and v.any():
                        keep.append(at)
                        packed.append((v + 0.0).tobytes())  # -0.0 and 0.0 are one value
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0).cast(pa.int64()), kept.column(1),
                                              pa.array(packed, pa.binary())], names=["vec_id", ROW, "raw"])

    found = saved(rows.mapInArrow(run, f"vec_id long, {ROW} long, raw binary"), "vectors")
    usual = found.groupBy(F.length("raw").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return found.filter(F.length("raw") == (usual[0]["n"] if usual else 0))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """A binary column of equally long rows as a matrix."""
    n = len(column)
    data = np.frombuffer(b"".join(column.to_pylist()), dtype)
    return data.reshape(n, -1) if n else data.reshape(0, 1)


def giants_of(nodes: DataFrame, most: int = GIANTS) -> list[tuple[int, np.ndarray]]:
    """(node, vector) of the ``most`` nodes of the largest norms, largest first; a top-n, bounded for any table."""
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                norm = np.linalg.norm(_matrix(batch.column(1), np.float64), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norm)], names=["node", "raw", "norm"])

    rows = nodes.select("node", "raw").mapInArrow(norms, "node long, raw binary, norm double")
    return [(r.node, np.frombuffer(r.raw, np.float64)) for r in rows.orderBy(F.desc("norm"), "node").limit(most).collect()]


def small_vectors(nodes: DataFrame, largest: float) -> DataFrame:
    """(node, small): unit vectors of one byte a coordinate, after the scale and the added coordinate as floats."""
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), np.float64) / largest
            # A vector above the norm is cut to a unit vector here; it is found as a giant.
            v /= np.maximum(1.0, np.linalg.norm(v, axis=1, keepdims=True))
            rest = np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(1, keepdims=True)))
            # Components of unit vectors are small: each row uses the whole range of a byte.
            scale = np.maximum(np.abs(v).max(1, keepdims=True), 1e-30)
            small = np.rint(v / scale * 127).astype(np.int8)
            head = np.hstack([scale / 127, rest]).astype(np.float32)
            packed = [h.tobytes() + r.tobytes() for h, r in zip(head, small)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "small"])

    return nodes.select("node", "raw").mapInArrow(shrink, "node long, small binary")


def _unpack(rows: list[bytes]) -> np.ndarray:
    """The vectors with the added coordinate as the last one."""
    data = np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), -1)
    head = np.ascontiguousarray(data[:, :8]).view(np.float32)
    return np.hstack([data[:, 8:].astype(np.float32) * head[:, :1], head[:, 1:]])


def _meet(told: int):
    """For every row of member lists (node, small, worst, fresh): what each member learns of the others.

    A pair is news if one of the two is fresh in this list and the score beats the worst
    neighbour the member has; of that every member is told the best ``told``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, lens, scores, others = [np.zeros(0, np.int64)], [], [np.zeros(0)], [np.zeros(0, np.int64)]
            for members, small, worst, fresh in zip(*batch.columns):
                ids, fresh = members.values.to_numpy(), fresh.values.to_numpy(zero_copy_only=False)
                if len(ids) < 2 or not fresh.any():
                    continue
                v = _unpack(small.as_py())
                s = v @ v.T
                s[~(fresh[:, None] | fresh[None, :])] = -np.inf
                s[s <= worst.values.to_numpy()[:, None]] = -np.inf
                np.fill_diagonal(s, -np.inf)
                k = min(told, len(ids) - 1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                found = np.take_along_axis(s, best, 1)
                news = found > -np.inf
                learned = news.any(1)
                who.append(ids[learned])
                lens.append(news.sum(1)[learned])
                scores.append(found[news])
                others.append(ids[best[news]])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lens or [np.zeros(0, int)]))]).astype(np.int32)
            near = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                [pa.array(np.concatenate(scores).astype(np.float32)), pa.array(np.concatenate(others))], names=["s", "w"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), near], names=["node", "news"])
    return run


_NEWS = "node long, news array<struct<s: float, w: long>>"


def _best(news: DataFrame, graph: DataFrame | None, degree: int) -> DataFrame:
    """(node, near): the nearest ``degree`` of what each node knew and was told, nearest first.

    What it did not know before is marked ``fresh``. The lists are short, see the bounds above.
    """
    told = F.sort_array(F.flatten(F.collect_list("news")), asc=False).alias("told")
    none = F.lit(None).cast("array<struct<s: float, w: long>>")
    if graph is None:
        both = news.groupBy("node").agg(told).withColumn("known", F.array().cast("array<struct<s: float, w: long>>"))
    else:
        known = F.transform("near", lambda e: F.struct(e["s"].alias("s"), e["w"].alias("w")))
        rows = news.withColumn("known", none).unionByName(graph.select("node", none.alias("news"), known.alias("known")))
        both = rows.groupBy("node").agg(told, F.flatten(F.collect_list("known")).alias("known"))
    before = F.transform("known", lambda e: e["w"])

    def is_news(e: Column, i: Column) -> Column:
        # Sorted: the same node stands next to itself.
        return ((i == 0) | (e["w"] != F.get("told", i - 1)["w"])) & ~F.array_contains(before, e["w"])

    def entry(fresh: bool):
        return lambda e: F.struct(e["s"].alias("s"), e["w"].alias("w"), F.lit(fresh).alias("fresh"))
    # The nearest news come first, so more than ``degree`` of them are never needed.
    lists = F.concat(F.transform(F.slice(F.filter("told", is_news), 1, degree), entry(True)), F.transform("known", entry(False)))
    return both.select("node", F.slice(F.sort_array(lists, asc=False), 1, degree).alias("near"))


def first_lists(small: DataFrame, n: int, degree: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """Neighbours inside leaves of random hyperplanes and inside groups by hash."""
    bits = min(30, max(0, int(np.ceil(np.log2(max(1.0, n / leaf))))))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unpack(batch.column(1).to_pylist())
            planes = np.random.default_rng(seed).standard_normal((v.shape[1], trees * bits)).astype(np.float32)
            signs = (v @ planes > 0).reshape(len(v), trees, bits)
            leaves = (signs * (1 << np.arange(bits))).sum(2)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(v), t)), pa.array(leaves[:, t].astype(np.int64))],
                    names=["node", "small", "tree", "leaf"])

    planted = small.mapInArrow(codes, "node long, small binary, tree long, leaf long")
    groups = max(1, n // leaf)
    hashed = small.select("node", "small", F.lit(-1).cast("long").alias("tree"),
                          F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(groups)).alias("leaf"))
    placed = saved(planted.unionByName(hashed), "leaves")
    crowd = placed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * leaf)).alias("parts"))
    cut = placed.join(crowd, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    rows = cut.groupBy("tree", "leaf", "part").agg(
        F.collect_list("node").alias("members"), F.collect_list("small").alias("small"),
        F.collect_list(F.lit(-2.0).cast("float")).alias("worst"), F.collect_list(F.lit(True)).alias("fresh"))
    news = rows.drop("tree", "leaf", "part").mapInArrow(_meet(degree), _NEWS)
    lists = saved(_best(news, None, degree), "graph")
    discard(placed)
    return lists


def kept_edges(graph: DataFrame, degree: int) -> DataFrame:
    """(u, v, fresh): v is a neighbour of u and u is among the nearest ``degree`` that name v."""
    edges = graph.select(F.col("node").alias("u"), F.explode("near").alias("e")).select(
        "u", F.col("e.w").alias("v"), "e.s", "e.fresh")
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))
    return edges.withColumn("r", rank).filter(F.col("r") <= degree).select("u", "v", "fresh")


def improve(graph: DataFrame, small: DataFrame, degree: int, told: int) -> DataFrame:
    """One round: the neighbours of each node meet, and every node keeps the nearest it knows."""
    sides = F.explode(F.array(F.struct(F.col("u").alias("centre"), F.col("v").alias("node"), "fresh"),
                              F.struct(F.col("v").alias("centre"), F.col("u").alias("node"), "fresh")))
    pairs = (kept_edges(graph, degree).select(sides.alias("p")).select("p.*")
             .groupBy("node", "centre").agg(F.max("fresh").alias("fresh")))
    worst = F.when(F.size("near") < degree, F.lit(-2.0)).otherwise(F.element_at("near", -1)["s"]).cast("float")
    known = small.join(graph.select("node", worst.alias("worst")), "node", "left").select(
        "node", "small", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    rows = (pairs.join(known, "node").groupBy("centre").agg(
        F.collect_list("node").alias("members"), F.collect_list("small").alias("small"),
        F.collect_list("worst").alias("worst"), F.collect_list("fresh").alias("fresh")))
    return saved(_best(rows.drop("centre").mapInArrow(_meet(told), _NEWS), graph, degree), "graph")


def build_graph(small: DataFrame, n: int, degree: int = DEGREE, few_news: float = FEW_NEWS, told: int = TOLD,
                trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """(node, near): the nearest ``degree`` nodes found, nearest first; rounds go on until few entries are new."""
    graph = first_lists(small, n, degree, trees, leaf, seed)
    while True:
        better = improve(graph, small, degree, told)
        discard(graph)
        graph = better
        fresh, entries = graph.agg(F.sum(F.size(F.filter("near", lambda e: e["fresh"]))), F.sum(F.size("near"))).first()
        if (fresh or 0) <= few_news * (entries or 0):
            return graph


def _score_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, node, small of q, small of node) to (q, node, s)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = _unpack(batch.column(2).to_pylist()), _unpack(batch.column(3).to_pylist())
        s = np.einsum("ij,ij->i", a[:, :-1], b[:, :-1])  # a query has 0 in the added coordinate
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.astype(np.float32))],
                                         names=["q", "node", "s"])


def _rank(by: list, order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def starts(of_query: DataFrame, giants: list[tuple[int, np.ndarray]], largest: float, beam: int) -> DataFrame:
    """(q, node, s): the best ``beam`` giants of every query."""
    ids = np.array([node for node, _ in giants], np.int64)
    matrix = np.array([v / largest for _, v in giants], np.float32).reshape(len(giants), -1 if giants else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            scores = _unpack(batch.column(1).to_pylist())[:, :-1] @ matrix.T
            k = min(beam, len(ids))
            best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            q = np.repeat(batch.column(0).to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[best].ravel()),
                                              pa.array(np.take_along_axis(scores, best, 1).ravel().astype(np.float32))], names=["q", "node", "s"])

    return of_query.mapInArrow(run, "q long, node long, s float").filter("q <> node")


def search(queries: DataFrame, graph: DataFrame, small: DataFrame, giants: list[tuple[int, np.ndarray]], largest: float,
           degree: int = DEGREE, beam: int = BEAM, pool: int = POOL, few_changed: float = FEW_CHANGED, top: int = TOP) -> DataFrame:
    """(q, node) of the ``pool`` nearest nodes that the walk of each query node ``q`` met."""
    edges = kept_edges(graph, degree)
    forward = graph.select("node", F.explode("near").alias("e")).select("node", F.col("e.w").alias("to"))
    both = forward.unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("to")))
    links = saved(both.groupBy("node").agg(F.collect_set("to").alias("to")), "links")
    of_query = saved(queries.join(small, F.col("q") == F.col("node")).select("q", F.col("small").alias("q_small")), "queries")
    own = of_query.select("q", F.col("q").alias("node"), F.lit(1e30).cast("float").alias("s"))
    state = saved(own.unionByName(starts(of_query, giants, largest, beam)).withColumn("open", F.lit(True)), "state")
    asked = of_query.count()
    while True:
        turn = _rank(["q", "open"], [F.desc("s"), F.col("node")])
        ranked = saved(state.select("q", "node", "s", "open").withColumn("turn", F.when(F.col("open"), turn)), "ranked")
        to_open = ranked.filter(F.col("turn") <= beam)
        met = (to_open.join(links, "node").select("q", F.explode("to").alias("node")).distinct()
               .join(ranked.select("q", "node"), ["q", "node"], "left_anti"))
        scored = (met.join(of_query, "q").join(small, "node").select("q", "node", "q_small", "small")
                  .mapInArrow(_score_small, "q long, node long, s float"))
        opened = F.col("open") & ~F.coalesce(F.col("turn") <= beam, F.lit(False))
        everything = ranked.select("q", "node", "s", opened.alias("open"), F.lit(False).alias("new")).unionByName(
            scored.withColumns({"open": F.lit(True), "new": F.lit(True)}))
        place = _rank(["q"], [F.desc("s"), F.col("node")])
        after = saved(everything.withColumn("place", place).filter(F.col("place") <= pool), "state")
        discard(ranked)
        discard(state)
        state = after
        # The query's own node is the first; it goes on while nodes come into the best ``top`` behind it.
        changed = state.filter(F.col("new") & (F.col("place") <= top + 1)).select("q").distinct().count()
        if changed <= few_changed * asked:
            return state.select("q", "node")


def _score_exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = _matrix(batch.column(2), np.float64), _matrix(batch.column(3), np.float64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", a, b))], names=["q", "node", "score"])


def nearest(vectors: DataFrame, is_query: Column | str, top: int = TOP, degree: int = DEGREE, few_news: float = FEW_NEWS,
            beam: int = BEAM, pool: int = POOL, few_changed: float = FEW_CHANGED, leaf: int = LEAF, giants: int = GIANTS,
            seed: int = SEED) -> DataFrame:
    """The ``top`` nearest rows of every query row: query_id, rank, vec_id, score."""
    rows = valid_rows(vectors)
    classes = rows.groupBy("raw").agg(F.min("vec_id").alias("__first")).select("raw")
    nodes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = saved(rows.join(nodes, "raw").select("vec_id", ROW, "node"), "named")
    large = giants_of(nodes, giants)
    largest = float(np.linalg.norm(large[-1][1])) if large else 1.0
    small = saved(small_vectors(nodes, largest), "small")
    n = nodes.count()
    graph = build_graph(small, n, degree, few_news, leaf=leaf, seed=seed)
    asked = saved(named.filter(is_query), "asked")
    met = search(asked.select(F.col("node").alias("q")).distinct(), graph, small, large, largest, degree, beam,
                 max(pool, top + 1), few_changed, top)
    of_query = nodes.select(F.col("node").alias("q"), F.col("raw").alias("q_raw"))
    scored = (met.join(of_query, "q").join(nodes, "node").select("q", "node", "q_raw", "raw")
              .mapInArrow(_score_exact, "q long, node long, score double"))
    # The top + 1 smallest vec_ids of a class are all that can be in a result without the query's own row.
    members = saved(named.withColumn("r", _rank(["node"], [F.col("vec_id").asc_nulls_last(), F.col(ROW)]))
                    .filter(F.col("r") <= top + 1).select("node", "vec_id", ROW), "members")
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col(ROW)]
    found = saved(scored.join(members, "node").withColumn("place", _rank(["q"], order))
                  .filter(F.col("place") <= top + 1)
                  .select("q", "score", F.col("vec_id").alias("vec_id"), F.col(ROW).alias("__member")), "found")
    hits = (asked.select(F.col("vec_id").alias("query_id"), F.col(ROW).alias("__query"), F.col("node").alias("q"))
            .join(found, "q").filter("__query <> __member"))
    last = [F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("__member")]
    return (hits.withColumn("rank", _rank(["__query"], last)).filter(F.col("rank") <= top)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
