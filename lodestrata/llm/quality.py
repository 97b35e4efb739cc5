"""Quality classifier by importance resampling over hashed n-grams.

Two generative models are kept as bucket counts: the target (documents labelled good) and
the raw corpus (all documents). N-grams are words, pairs of words (a word twice in a row is
one pair of its own) and word shapes (letters, capitals, digits, other signs as they are).
The log importance weight of a document is the sum of log(target / raw) over its n-grams,
tempered to the strength of ``TEMPER`` n-grams: a long text would otherwise be decided by
the sum of very small differences between the models.

Documents are then drawn without replacement: Gumbel noise is added to the log weights and
the k largest stay, k being the number of documents whose weight is at least ``LEVEL``. So a
document that is much more likely in the raw corpus than in the target is rejected, and only
documents next to the level are left to chance.

All counts cover all documents; at most ``MAX_TARGET`` labelled documents (those with the
smallest hash of their id) make up the target model, a documented bound on the sample that
is fitted. The models are 20,000 buckets, whatever the corpus. The k-th largest key is found
by a distributed range sort of narrow rows.

Defined cases: a null or blank text has no n-grams and weight 0 (it stays); without any
good label both models are the same and nothing is rejected; noise depends on seed, doc_id
and text only, so repeated rows draw the same noise and are told apart by their row number;
null doc_ids are scored, but are no part of the target; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ROW, fields_of, keep_rows, numbered, packed, saved, table
from lodestrata.operators.running import global_rank

#: Buckets of words and pairs; as many again for shapes.
BUCKETS = 10_000
TEMPER = 50
LEVEL = -8.0
MAX_TARGET = 20_000
SEED = 42

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256))
_A, _B, _TWICE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0)


def features(text: bytes) -> np.ndarray:
    """Buckets of the n-grams of a text (UTF-8), with repeats."""
    words = text.split()
    n, size = len(words), np.uint64(BUCKETS)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    pairs = (h[:-1] * _A + h[1:] * _B) >> np.uint64(33)
    pairs[h[:-1] == h[1:]] = _TWICE
    shapes = np.fromiter(map(zlib.crc32, text.translate(_SHAPE).split()), np.uint64, n)
    return np.concatenate([h % size, pairs % size, shapes % size + size]).astype(np.int64)


def good_documents(labels: DataFrame, most: int = MAX_TARGET) -> DataFrame:
    """doc_ids of documents labelled good and not toxic; at most ``most``, by hash."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TARGET) -> np.ndarray:
    """log(target / raw) of every bucket, from one scan of all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
                found = features(text.as_py() or b"")
                np.add.at(raw, found, 1)
                if good.as_py():
                    np.add.at(target, found, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])],
                                         names=["bucket", "raw", "target"])

    # At most ``most`` ids, a parameter.
    good = F.broadcast(good_documents(labels, most).select(F.col("doc_id").alias("__id"), F.lit(True).alias("__good")))
    marked = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("__id"), "left").select("text", "__good")
    sums = (marked.mapInArrow(count, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw"), F.sum("target")))
    raw, target = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for bucket, r, t in sums.collect():  # at most 2 * BUCKETS rows
        raw[bucket], target[bucket] = r, t
    base = (raw + 1) / (raw.sum() + len(raw))
    # The prior of the target is the raw model, with the weight of one n-gram a bucket.
    return np.log((target + len(raw) * base) / (target.sum() + len(raw))) - np.log(base)


def log_weight(text: bytes, ratio: np.ndarray, temper: int = TEMPER) -> tuple[float, int]:
    found = features(text)
    n = len(found)
    return (float(ratio[found].sum()) * min(1.0, temper / n) if n else 0.0), n


def key_of(doc_id: int | None, text: bytes, weight: float, seed: int) -> tuple[float, float]:
    """Gumbel noise of a document and its key in the draw."""
    u = (zlib.crc32(text, zlib.crc32(f"{seed}/{doc_id}".encode())) + 0.5) / 2**32
    noise = -float(np.log(-np.log(u)))
    return noise, weight + noise


def score(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, row number, log_weight, n_ngrams, noise and key of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = (t.as_py() or b"" for t in batch.column(2).cast(pa.binary()))
            rows = []
            for doc_id, text in zip(ids, texts):
                weight, n = log_weight(text, ratio)
                rows.append((weight, n, *key_of(doc_id, text, weight, seed)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(columns[0], pa.float64()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())],
                names=["doc_id", ROW, "log_weight", "n_ngrams", "noise", "key"])

    return numbered(docs, "doc_id", "text").select("doc_id", ROW, "text").mapInArrow(
        run, f"doc_id long, {ROW} long, log_weight double, n_ngrams long, noise double, key double")


def resample(docs: DataFrame, labels: DataFrame, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, log_weight, n_ngrams, noise, rank in the draw, kept, and the row number."""
    rows = saved(score(docs, fit(docs, labels), seed), "weights")
    k = rows.filter(F.col("log_weight") >= level).count()
    ranked = global_rank(rows, [F.col("key").desc(), F.col("doc_id"), F.col(ROW)], "rank")
    return ranked.select("doc_id", "log_weight", "n_ngrams", "noise", "rank", (F.col("rank") <= k).alias("kept"), ROW)


def keep_good(docs: DataFrame, labels: DataFrame, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """The documents that ``resample`` keeps, with all their columns."""
    whole = packed(docs)
    return keep_rows(whole, resample(fields_of(whole, "doc_id", "text"), labels, level, seed).filter("kept"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop(ROW)
