"""Exact deduplication with two Bloom passes: only possibly repeated hashes are shuffled.

1. One scan turns every text into a narrow digest row (SHA-256 of the normalised text,
   its length, the row's place), kept in the shared folder. Texts are never shuffled.
2. First pass: every task sets the bits of its digests in a Bloom filter. A bit set twice
   is also set in a second filter. The filters of the tasks are cut into segments and
   merged segment by segment (``once or``, ``twice or``, ``once and once -> twice``), so
   no task and not the driver holds the filters of all tasks.
3. Second pass: a digest of which some bit is not in the second filter is unique for sure
   and goes straight to the result. Only the others are shuffled, as narrow rows, and
   compared exactly by the whole SHA-256.

The filter is at most ``MAX_BITS`` bits (32 MiB). With more documents than it was made
for, more unique rows are shuffled; the result is the same at any size.

A group of copies is reduced by a map-side combined aggregate (best row, count), and its
rows find the keeper by an equi join that AQE splits when one group is hot.

Defined cases: a null text counts as empty, all empty texts form one group; null or
repeated doc_ids are rows of their own (null sorts last; among rows with the same length
and doc_id the first one stays); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import BLANK, ROW, numbered, saved, table

#: Bits of a segment; the unit in which filters are merged.
SEGMENT = 1 << 16
#: Bound of the filter that is sent to the tasks: 2^28 bits are 32 MiB.
MAX_BITS = 1 << 28
BITS_PER_ROW = 16


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row number, SHA-256 (hex) of the text without blanks, code points of the text."""
    text = F.coalesce("text", F.lit(""))
    return numbered(docs, "doc_id", "text").select(
        "doc_id", ROW, F.sha2(F.regexp_replace(text, f"[{BLANK}]+", ""), 256).alias("text_sha256"),
        F.length(text).cast("long").alias("__len"))


def bits_for(rows: int, max_bits: int = MAX_BITS) -> int:
    """A power of two of about ``BITS_PER_ROW`` bits a row, a segment at least, ``max_bits`` at most."""
    return min(max(SEGMENT, 1 << max(1, rows * BITS_PER_ROW - 1).bit_length()), max_bits)


def _places(batch: pa.RecordBatch, mask: int) -> np.ndarray:
    """Two bit places per row, from the first and last eight bytes of the hash."""
    raw = batch.column(0).to_pylist()
    at = np.frombuffer(bytes.fromhex("".join(h[:16] + h[-16:] for h in raw)), np.uint64).reshape(-1, 2)
    return (at & np.uint64(mask)).astype(np.int64)


def _bit(places: np.ndarray) -> np.ndarray:
    return np.left_shift(np.uint8(1), (places & 7).astype(np.uint8))


def _is_set(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (packed[places >> 3] & _bit(places)) != 0


def repeated_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """First pass: rows (segment, twice) of the filter of places that were set more than once."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            for places in _places(batch, bits - 1).T:
                places, counts = np.unique(places, return_counts=True)
                again = places[(counts > 1) | _is_set(once, places)]
                np.bitwise_or.at(twice, again >> 3, _bit(again))
                np.bitwise_or.at(once, places >> 3, _bit(places))
        # Few bits of a task are set in a large filter: their places are sent, not the zeros between them.
        set_once = np.flatnonzero(np.unpackbits(once, bitorder="little"))
        cuts = np.flatnonzero(np.diff(set_once // SEGMENT)) + 1
        for part in np.split(set_once, cuts) if len(set_once) else []:
            yield pa.RecordBatch.from_pydict({
                "segment": [int(part[0] // SEGMENT)], "once": [(part % SEGMENT).astype(np.uint16).tobytes()],
                "twice": [(part[_is_set(twice, part)] % SEGMENT).astype(np.uint16).tobytes()]})

    def merge(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
        for batch in group:
            for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist()):
                a, b = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
                twice[a[once[a]]] = True
                twice[b] = True
                once[a] = True
        yield pa.RecordBatch.from_pydict({"segment": [key[0].as_py()],
                                          "twice": [np.packbits(twice, bitorder="little").tobytes()]})

    return (hashes.select("text_sha256").mapInArrow(local, "segment long, once binary, twice binary")
            .groupBy("segment").applyInArrow(merge, "segment long, twice binary"))


def exact_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and the row number).

    Of equal texts (blanks aside) the row with the most code points stays, then the one
    with the smallest doc_id.
    """
    spark = docs.sparkSession
    rows = saved(digests(docs))
    bits = bits_for(rows.count(), max_bits)
    # At most max_bits bits come to the driver and go out again, whatever the input.
    repeated = np.zeros(bits // 8, np.uint8)
    for segment, twice in repeated_filter(rows, bits).toLocalIterator():
        repeated[segment * SEGMENT // 8:(segment + 1) * SEGMENT // 8] = np.frombuffer(twice, np.uint8)
    sent = spark.sparkContext.broadcast(repeated.tobytes())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            maybe = _is_set(mask, _places(batch, bits - 1)).all(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)],
                                             names=[*batch.schema.names, "__maybe"])

    tested = saved(rows.select("text_sha256", "doc_id", ROW, "__len").mapInArrow(
        test, f"text_sha256 string, doc_id long, {ROW} long, __len long, __maybe boolean"))
    unique = tested.filter("NOT __maybe").select(
        "doc_id", ROW, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    maybe = tested.filter("__maybe").drop("__maybe")
    best = F.min(F.struct((-F.col("__len")).alias("l"), F.col("doc_id").isNull().alias("n"), "doc_id", ROW))
    # Written first: between two plain scans AQE can split the rows of a hot group.
    groups = saved(maybe.groupBy("text_sha256").agg(best.alias("__best"), F.count(F.lit(1)).alias("group_size"))
                   .select(F.col("text_sha256").alias("__key"), "__best", "group_size"), "groups")
    found = maybe.join(groups, maybe["text_sha256"] == groups["__key"]).select(
        "doc_id", ROW, F.col("__best.doc_id").alias("keep_id"), "group_size",
        (F.col(ROW) == F.col(f"__best.{ROW}")).alias("kept"), "text_sha256")
    return unique.unionByName(found)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop(ROW)


ORACLE = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM norm WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
