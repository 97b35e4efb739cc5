"""SimHash near-duplicates: tiled exact comparison of all fingerprints.

A fingerprint has one bit per position of the hashes of a document's word shingles.
Distinct fingerprints are laid into tiles by the population counts of their four 16-bit
quarters. Two fingerprints that differ in r bits have population counts that differ by at
most r in total, so a tile is compared only with the tiles within that distance (41 of
83,521 at radius 2); all other tile pairs are skipped without losing a link. Inside a
pair of tiles numpy compares every fingerprint with every other: exclusive-or, then a bit
count. Large tiles are cut by hash into chunks of about ``CHUNK`` fingerprints, so that
the work of a crowded tile is spread over many tasks.

Of the links inside a batch only what connects is sent on (each fingerprint and the
smallest it hangs with), so a dense group does not give all its pairs. Components are
found by distributed star rounds. Documents with equal fingerprints are one class from the
start; texts are never shuffled, classes are reduced with map-side combine.

Defined cases: a null text counts as empty; documents without words have the zero
fingerprint and are linked like any other; null or repeated doc_ids are rows of their own
(component_id is the smallest doc_id that is not null); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ROW, fields_of, keep_rows, numbered, packed, saved, table
from lodestrata.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints of a chunk: 8 KiB each side of a comparison.
CHUNK = 1024
#: Comparisons made in one numpy step.
STEP = 1 << 21

QUARTERS = 4
WIDTH = 64 // QUARTERS


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the words of a text (UTF-8)."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    total = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for a in range(0, total, 65536):
        part = words[a:min(a + 65536, total) + shingle - 1]
        parts = zip(*(part[k:] for k in range(shingle)))
        hashes = np.fromiter((digest(b" ".join(p), seed) for p in parts), np.uint64, len(part) - shingle + 1)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, row number and fingerprint (as a signed long) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or b"", shingle, seed) for t in batch.column(2).cast(pa.binary())],
                             np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(found)],
                                             names=["doc_id", ROW, "fp"])
    return numbered(docs, "doc_id", "text").select("doc_id", ROW, "text").mapInArrow(
        run, f"doc_id long, {ROW} long, fp long")


def near_tiles(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts within the radius, one of each pair d and -d."""
    zero = (0,) * QUARTERS
    span = range(-radius, radius + 1)
    return [d for d in product(span, repeat=QUARTERS) if sum(map(abs, d)) <= radius and d >= zero]


def smallest_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node each one is connected with over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy().view(np.uint64), offsets


def compare_rows(left: pa.Array, right: pa.Array, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the two lists of every row: all pairs that differ in 1 to ``radius`` bits."""
    a, a_off = _list_column(left)
    b, b_off = _list_column(right)
    na, nb = np.diff(a_off), np.diff(b_off)
    work = na * nb
    found_a, found_b = [], []

    def test(x: np.ndarray, y: np.ndarray) -> None:
        differ = np.bitwise_count(x ^ y)
        hit = (differ <= radius) & (differ > 0)
        if hit.any():
            x, y = np.broadcast_arrays(x, y)
            found_a.append(x[hit])
            found_b.append(y[hit])

    small = np.flatnonzero(work < 1 << 14)
    cut = np.cumsum(work[small])
    begin = 0
    while begin < len(small):  # many short lists at once
        end = max(begin + 1, int(np.searchsorted(cut, (cut[begin - 1] if begin else 0) + STEP)))
        rows = small[begin:end]
        row = np.repeat(rows, work[rows])
        k = np.arange(len(row)) - np.repeat(np.cumsum(work[rows]) - work[rows], work[rows])
        test(a[a_off[row] + k // nb[row]], b[b_off[row] + k % nb[row]])
        begin = end
    for r in np.flatnonzero(work >= 1 << 14):
        x, y = a[a_off[r]:a_off[r + 1]], b[b_off[r]:b_off[r + 1]]
        rows = max(1, STEP // len(y))
        for at in range(0, len(x), rows):
            test(x[at:at + rows, None], y[None, :])
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(found_a or empty), np.concatenate(found_b or empty)


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within ``radius`` bits of each other."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", WIDTH * q).bitwiseAND((1 << WIDTH) - 1)) for q in range(QUARTERS)]
    tile = sum((c * (WIDTH + 1) ** q for q, c in enumerate(quarter)), F.lit(0))
    placed = fps.select("fp", tile.cast("int").alias("tile"))
    # At most 17^4 rows of two numbers, however many fingerprints there are.
    crowd = F.broadcast(placed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("chunks")))
    chunks = saved(placed.join(crowd, "tile")
                   .groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk"))
                   .agg(F.collect_list("fp").alias("fps")), "tiles")
    counts = [F.floor(F.col("tile") / F.lit((WIDTH + 1) ** q)) % (WIDTH + 1) for q in range(QUARTERS)]
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in near_tiles(radius)])
    moved = chunks.select("tile", "chunk", "fps", F.explode(steps).alias("d"))
    inside, key = F.lit(True), F.lit(0)
    for q, c in enumerate(counts):
        to = c + F.col("d")[q]
        inside, key = inside & to.between(0, WIDTH), key + to * (WIDTH + 1) ** q
    left = moved.filter(inside).select(key.cast("int").alias("to"), F.col("tile").alias("from"),
                                       F.col("chunk").alias("c"), F.col("fps").alias("left"))
    right = chunks.select(F.col("tile").alias("to"), "chunk", F.col("fps").alias("right"))
    pairs = left.join(right, "to").filter("from <> to OR c <= chunk").select("left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = compare_rows(batch.column(0), batch.column(1), radius)
            if not len(a):
                continue
            nodes, at = np.unique(np.concatenate([a, b]).view(np.int64), return_inverse=True)
            low = smallest_linked(len(nodes), at[:len(a)], at[len(a):])
            hangs = np.flatnonzero(low != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[hangs]), pa.array(nodes[low[hangs]])], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, row number, fingerprint, component_id, and whether it is the one that stays.

    The document with the smallest doc_id of a component stays (null last, then the first row).
    """
    rows = saved(fingerprints(docs, shingle, seed), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", ROW)).alias("first")
    classes = saved(rows.groupBy("fp").agg(first), "classes")
    groups = connected_components(links(classes.select("fp"), radius))
    named = saved(classes.join(groups, classes["fp"] == groups["node"], "left")
                  .select("fp", "first", F.coalesce("component", "fp").alias("component")), "named")
    best = saved(named.groupBy("component").agg(F.min("first").alias("best")), "best")
    best = saved(named.join(best, "component").select(F.col("fp").alias("key"), "best"), "best")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(best, rows["fp"] == best["key"]).select(
        "doc_id", ROW, hexed.alias("fingerprint"), F.col("best.doc_id").alias("component_id"),
        (F.col(ROW) == F.col(f"best.{ROW}")).alias("kept"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).drop(ROW)


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """The documents that ``simhash_groups`` keeps, with all their columns."""
    whole = packed(docs)
    return keep_rows(whole, simhash_groups(fields_of(whole, "doc_id", "text"), shingle, radius, seed).filter("kept"))
