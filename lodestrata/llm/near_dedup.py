"""Near-duplicate documents of the pipeline: SimHash links of op 5, and MinHash bands with exact Jaccard similarity.

1. A document is the set of its 64-bit hashes of ``SHINGLE`` neighbouring words (one hash of all its words
   where it has fewer). Documents with equal sets are one class from here on.
2. ``BANDS`` bands of ``ROWS`` minima each are hashed to keys. Two sets of similarity s share a key with
   probability 1 - (1 - s^6)^20: 0.998 at 0.8, 0.9999 at 0.85.
3. Pairs that share a key are verified exactly: sizes of intersection and union of the two sets. Only sets of
   classes that share a key with another are computed again from the texts; other texts are not shuffled.
4. Fingerprints of the same shingles (repeats included) that differ in at most ``RADIUS`` bits link their documents as
   in ``simhash_dedup``: all fingerprints are compared there in tiles. The bands find what lies further apart.
5. Groups connected by links of either kind keep the document of the smallest (doc_id, row).

A large group of near copies does not give all its pairs. First every class of a key is compared with the
smallest one there, and what this connects is one component. Then only classes outside of the component that a key has
most of are compared with the others there; pairs inside one component cannot change the result.

Defined cases: a null text counts as empty; documents without words are one class; null or repeated
doc_ids are rows of their own, null last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import ROW, fields_of, keep_rows, numbered, packed, saved
from lodestrata.llm.components import connected_components
from lodestrata.llm.simhash_dedup import RADIUS, fingerprint, links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
SEED = 42
#: Shingles whose minima are taken in one numpy step.
STEP = 1024
#: Slots of the filter for documents whose sets are computed again.
SLOTS = 1 << 20


def shingle_set(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (UTF-8)."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    total = len(words) - shingle + 1
    parts = zip(*(words[k:] for k in range(shingle)))
    return np.unique(np.fromiter((digest(b" ".join(p), seed) for p in parts), np.uint64, total))


def multipliers(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each minimum: an odd factor and a mask, as columns."""
    rng = np.random.default_rng(seed)
    draw = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64, endpoint=False)
    return draw[0] | np.uint64(1), draw[1]


def band_keys(hashes: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> list[int]:
    """One signed key per band; none for the empty set."""
    import xxhash
    if not len(hashes):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        mixed = hashes[None, at:at + STEP] ^ masks
        mixed *= factors
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, row number, fingerprint, hash and size of the shingle set, and band keys of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        factors, masks = multipliers(seed)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
            sets = [shingle_set(t, shingle, seed) for t in texts]
            prints = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(prints), pa.array(names), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([band_keys(s, factors, masks) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", ROW, "fp", "set", "n", "keys"])
    return numbered(docs, "doc_id", "text").select("doc_id", ROW, "text").mapInArrow(
        run, f"doc_id long, {ROW} long, fp long, set long, n long, keys array<long>")


def sets_of(wanted: DataFrame, docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(set, hashes) of the documents at the row numbers of ``wanted`` (set, row number)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", shingle, seed).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["set", "hashes"])
    slot = F.pmod(F.xxhash64(ROW), F.lit(SLOTS))
    # At most SLOTS rows, a bound that does not grow with the input; the join behind it is exact.
    slots = F.broadcast(wanted.select(slot.alias("slot")).distinct())
    some = numbered(docs, "text").withColumn("slot", slot).join(slots, "slot", "left_semi").drop("slot")
    return some.join(wanted, ROW).select("set", "text").mapInArrow(run, "set long, hashes array<long>")


def _sizes_allow(similarity: float) -> Column:
    return F.least("a_n", "b_n") >= F.lit(similarity - 1e-9) * F.greatest("a_n", "b_n")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets have at least the Jaccard similarity."""
    pairs = saved(pairs, "pairs")
    a = sets.select(F.col("set").alias("a"), F.col("hashes").alias("a_hashes"))
    b = sets.select(F.col("set").alias("b"), F.col("hashes").alias("b_hashes"))
    common = F.size(F.array_intersect("a_hashes", "b_hashes"))
    union = F.size("a_hashes") + F.size("b_hashes") - common
    return saved(pairs.join(a, "a").join(b, "b").filter(common >= F.lit(similarity) * union - 1e-9).select("a", "b"), "links")


def simhash_links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links of the classes (``set``) whose fingerprints (``fp``) differ in at most ``radius`` bits; connects, not all pairs."""
    prints = saved(rows.groupBy("fp").agg(F.min("set").alias("first")), "prints")
    equal = rows.select("fp", "set").distinct().join(prints, "fp").select(F.col("set").alias("a"), F.col("first").alias("b"))
    a, b = (prints.select(F.col("fp").alias(f"{x}_fp"), F.col("first").alias(x)) for x in "ab")
    apart = links(prints.select("fp"), radius).toDF("a_fp", "b_fp").join(a, "a_fp").join(b, "b_fp").select("a", "b")
    return saved(equal.unionByName(apart).filter("a <> b").distinct(), "alike")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, row number, component_id, and whether it is the one that stays."""
    docs = numbered(docs, "doc_id", "text")
    rows = saved(signatures(docs, shingle, seed), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", ROW)
    classes = saved(rows.groupBy("set").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    keyed = saved(classes.select("set", "n", F.explode("keys").alias("key")), "keyed")
    least = saved(keyed.groupBy("key").agg(F.min(F.struct("set", "n")).alias("hub"), F.count(F.lit(1)).alias("c"))
                  .filter("c > 1").select("key", "hub"), "least")
    shared = saved(keyed.join(least, "key"), "shared")
    wanted = saved(shared.select("set").distinct().join(classes, "set").select("set", f"first.{ROW}"), "wanted")
    sets = saved(sets_of(wanted, docs, shingle, seed), "sets")

    stars = shared.select(F.col("set").alias("a"), F.col("n").alias("a_n"), F.col("hub.set").alias("b"), F.col("hub.n").alias("b_n"))
    near = verified(stars.filter((F.col("a") != F.col("b")) & _sizes_allow(similarity)).select("a", "b").distinct(), sets, similarity)
    groups = saved(connected_components(near.unionByName(simhash_links(rows))), "groups")
    named = saved(shared.select("key", "set", "n").join(groups, F.col("set") == F.col("node"), "left")
                  .select("key", "set", "n", F.coalesce("component", "set").alias("component")), "named")
    most = saved(named.groupBy("key", "component").count()
                 .groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("most"), F.count(F.lit(1)).alias("parts"))
                 .filter("parts > 1").select("key", "most"), "most")
    marked = saved(named.join(most, "key").withColumn("inside", F.col("component") == F.col("most")).drop("most"), "marked")
    side = lambda x: [F.col("set").alias(x), F.col("n").alias(f"{x}_n"), F.col("component").alias(f"{x}_component")]
    left = marked.filter("NOT inside").select("key", *side("a"))
    right = marked.select("key", "inside", *side("b"))
    more = (left.join(right, "key").filter((F.col("a_component") != F.col("b_component")) & _sizes_allow(similarity)
                                           & (F.col("inside") | (F.col("a") < F.col("b"))))
            .select("a", "b").distinct())
    # What is connected already goes in as stars, so few rounds are left.
    known = groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = connected_components(known.unionByName(verified(more, sets, similarity)))
    labelled = saved(classes.select("set", "first").join(groups, F.col("set") == F.col("node"), "left")
                     .select("set", "first", F.coalesce("component", "set").alias("component")), "labelled")
    best = saved(labelled.groupBy("component").agg(F.min("first").alias("best")), "best")
    chosen = saved(labelled.join(best, "component").select(F.col("set").alias("key"), "best"), "chosen")
    return rows.select("doc_id", ROW, "set").join(chosen, F.col("set") == F.col("key")).select(
        "doc_id", ROW, F.col("best.doc_id").alias("component_id"), (F.col(ROW) == F.col(f"best.{ROW}")).alias("kept"))


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The documents that ``near_groups`` keeps, with all their columns."""
    whole = packed(docs)
    return keep_rows(whole, near_groups(fields_of(whole, "doc_id", "text"), similarity, shingle, seed).filter("kept"))
