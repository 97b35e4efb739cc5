"""Mixing sources to target weights: pivotal dependent rounding through a reduction tree.

Every document of a source has the same fractional number of copies r = target / size of
the source, at most 2: floor(r) copies for certain and a probability p for one more. The
pivotal method settles the probabilities two documents at a time: words are moved at
random from one to the other (keeping the expected copies of both) until one of them has
p = 0 or 1; the other goes on to the next pair. The number of words of a source therefore
never moves by more than the one document that is left over.

Tree: the rows of a source are dealt by hash into blocks of about ``BLOCK`` rows, one task
each; every block leaves one undecided row, the left-over rows of ``BLOCK`` blocks form a
block of the next level, and so on until a source has one left. A source that holds a
third of all rows is thus settled in as many tasks as any other rows. Large documents are
paired first, so what is left over tends to be a short one; the last of a source is
rounded to the nearer side.

Random numbers are drawn from a hash of the seed, level, source and block, and rows are
taken in the order (size, doc_id, row number), so reruns agree.

Defined cases: a null or blank text has size 0 and takes no words; a null source is a
source of its own, the last; repeated rows are rows of their own; an empty table gives an
empty result; extra columns are ignored. Sources without words have target 0.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import DOC, ROW, WORD_RE, fields_of, numbered, packed, saved, table
from lodestrata.operators.running import global_rank

#: Rows settled by one task of the tree.
BLOCK = 4096
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, row number, source and number of words of every document."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    return numbered(docs, "doc_id", "text", "source").select("doc_id", ROW, "source", words.alias("size"))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, n, target.

    Weights repeat over the sources in code point order, null last. The excess over
    ``most`` times a source's size is shared again by weight until no source is above:
    targets are min(most * size, level * weight) for the level at which they sum up. Each
    round is one aggregate over the table of sources; only two sums reach the driver.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = global_rank(by_source, [F.col("source").asc_nulls_last()], "__rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    ranked = saved(ranked.withColumn("__w", weight).withColumn("__cap", F.lit(most) * F.col("source_size")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    wanted, level, above = share * total, 0.0, -1
    while True:
        full = F.col("__cap") <= F.lit(level) * F.col("__w")
        capped, free, now = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("__cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("__w"))), F.lit(0.0)), F.count_if(full)).first()
        if now == above or not free:
            break
        above, level = now, (wanted - capped) / free
    return ranked.select("source", "source_size", "n",
                         F.least(F.col("__cap"), F.lit(level) * F.col("__w")).alias("target"))


def settle(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Pair the rows one after the other; returns p with 0 / 1 everywhere but (unless ``last``) at one row."""
    start, words = p, size.tolist()
    p = p.tolist()
    draws = rng.random(len(p)).tolist()
    held = -1
    for j in range(len(p)):
        if p[j] <= 0.0 or p[j] >= 1.0:
            continue
        if held < 0:
            held = j
            continue
        i, si, sj = held, words[held], words[j]
        up = min((1 - p[i]) * si, p[j] * sj)  # words that may move to i
        down = min(p[i] * si, (1 - p[j]) * sj)
        moved = up if draws[j] * (up + down) < down else -down
        p[i], p[j] = p[i] + moved / si, p[j] - moved / sj
        # The side that limited the move is integral now; rounding must not leave it a hair off.
        near_i, near_j = min(p[i], 1 - p[i]), min(p[j], 1 - p[j])
        for k, near, other in ((i, near_i, near_j), (j, near_j, near_i)):
            if near < 1e-12 or near <= other and near < 1e-9:
                p[k] = float(round(p[k]))
        open_rows = [k for k in (i, j) if 0.0 < p[k] < 1.0]
        held = open_rows[0] if open_rows else -1
    if last and held >= 0:
        side = float(p[held] >= 0.5)
        excess = (side - p[held]) * words[held]
        p[held] = side
        # Make up for the last rounding: settled rows that fit change sides, the largest first.
        for k in np.flatnonzero((start > 0) & (start < 1)).tolist():
            if k != held and 0 < words[k] <= abs(excess) and p[k] == float(excess > 0):
                p[k] = 1.0 - p[k]
                excess -= words[k] if excess > 0 else -words[k]
    return np.asarray(p)


def block_settler(seed: int, level: int):
    """Function that settles one block (a group of rows of one source) of one level of the tree."""
    def one_block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", ROW], ascending=[False, True, True], kind="stable")
        source, number = group["source"].iloc[0], int(group["block"].iloc[0])
        name = "" if source is None else f"={source}"
        rng = np.random.default_rng([seed, level, number, zlib.crc32(name.encode(errors="replace"))])
        return group.assign(p=settle(group["size"].to_numpy(float), group["p"].to_numpy(), rng,
                                     int(group["blocks"].iloc[0]) == 1))
    return one_block


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK,
        seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken and the row number."""
    rows = saved(sizes(docs))
    per_source = saved(targets(rows, weights, share, most))
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", ROW), F.lit(1 << 62))
    key = per_source.select(F.col("source").alias("__source"), "source_size", "n", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(ratio).cast("int")
    cut = (rows.join(key, rows["source"].eqNullSafe(key["__source"])).drop("__source")
           .withColumn("base", base)
           .withColumn("p", F.when(F.col("size") > 0, ratio - base).otherwise(F.lit(0.0)))
           .withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("long"))
           .withColumn("block", F.pmod(spread, F.col("blocks"))))
    columns = ["doc_id", ROW, "source", "size", "source_size", "target", "base", "p", "blocks", "block"]
    schema = (f"doc_id long, {ROW} long, source string, size long, source_size long, target double, base int, "
              "p double, blocks long, block long")
    cut = cut.select(*columns)
    most_blocks = per_source.agg(F.max(F.ceil(F.col("n") / F.lit(block)))).first()[0] or 1
    done, level = [], 0
    while True:
        settled = saved(cut.groupBy("source", "block").applyInPandas(block_settler(seed, level), schema))
        open_row = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(settled.filter(~open_row))
        if most_blocks <= 1:
            break
        most_blocks, level = -(-most_blocks // block), level + 1
        # Rows of the next level: ``block`` blocks meet in one; sources with one block are settled already.
        cut = (settled.filter(open_row).withColumn("blocks", F.ceil(F.col("blocks") / F.lit(block)).cast("long"))
               .withColumn("block", F.floor(F.col("block") / F.lit(block)).cast("long")).select(*columns))
    copies = F.col("base") + F.col("p").cast("int")
    return reduce(DataFrame.unionByName, done).select(
        "doc_id", "size", "source", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), ROW)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop(ROW)


def apply_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK,
              seed: int = 42) -> DataFrame:
    """The documents as often as ``mix`` takes them, with all their columns.

    A document without words counts for nothing in any target and is passed on once.
    """
    whole = packed(docs)
    taken = mix(fields_of(whole, "doc_id", "text", "source"), weights, share, most, block, seed)
    times = F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(1))
    taken = taken.select(F.col(ROW).alias("__taken"), times.alias("__times")).filter("__times > 0")
    return (whole.join(taken, F.col(ROW) == F.col("__taken"))
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(f"{DOC}.*"))
