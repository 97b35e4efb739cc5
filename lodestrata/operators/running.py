"""Ordered scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts a whole key into one
task. ``running`` cuts each key into blocks of the order column first: the
window runs inside a block, the block totals are carried over by a second,
tiny window, and one equi join on (key, block) puts the two together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import stable

# An integer sequence number is unique, so a block never holds more rows than this.
SEQ_BLOCK = 1_000_000

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}
_CARRY = {"sum": lambda local, before: F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0)),
          "min": F.least,
          "max": F.greatest}


def seq_block(col: str | Column, size: int = SEQ_BLOCK) -> Column:
    """Block number of an integer order column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(size)).cast("long")


def running(df: DataFrame, keys: list[str], order: list[Column], block: Column,
            measures: dict[str, tuple[str, Column]], include_current: bool = True) -> DataFrame:
    """Add running ``sum`` / ``min`` / ``max`` columns per key.

    ``block`` must not fall as ``order`` rises. ``measures`` maps the new
    column to ``(kind, input)``; with ``include_current=False`` the current
    row is left out.
    """
    cut = df.withColumn("_block", block)
    last = Window.currentRow if include_current else -1
    inside = (Window.partitionBy(*keys, "_block").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, last))
    local = cut.withColumns({f"_in_{n}": _AGG[kind](expr).over(inside)
                             for n, (kind, expr) in measures.items()})
    totals = cut.groupBy(*keys, "_block").agg(
        *[_AGG[kind](expr).alias(f"_tot_{n}") for n, (kind, expr) in measures.items()])
    earlier = (Window.partitionBy(*keys).orderBy("_block")
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_block").alias("_k_block"),
        *[_AGG[kind](f"_tot_{n}").over(earlier).alias(f"_before_{n}")
          for n, (kind, _) in measures.items()])
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    match.append(F.col("_block").eqNullSafe(F.col("_k_block")))
    joined = local.join(carried, reduce(lambda a, b: a & b, match), "left")
    out = {n: _CARRY[kind](F.col(f"_in_{n}"), F.col(f"_before_{n}"))
           for n, (kind, _) in measures.items()}
    return joined.select(*[F.col(c) for c in df.columns if c not in out],
                         *[c.alias(n) for n, c in out.items()])


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number all rows 1..n in ``order`` without bringing them into one task.

    ``order`` must be total (end it with a unique column): then equal leading
    values split over partitions too. Rows are range partitioned and sorted; the
    number inside a partition comes from the row's position, the number of rows
    in earlier partitions is added from a table with one row per partition.
    """
    placed = stable(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    placed = placed.withColumns({"_part": part, "_pos": F.col("_at") - F.shiftleft(part, 33)})
    sizes = placed.groupBy("_part").count()
    # One row per shuffle partition, so this window and the broadcast are bounded by it.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_off") + F.col("_pos") + 1)
            .drop("_at", "_part", "_pos", "_off"))


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Number rows 1..n inside each ``by`` group, also when one group holds most rows."""
    ranked = global_rank(df, [F.col(b) for b in by] + order, "_rank")
    if not by:
        return ranked.withColumnRenamed("_rank", name)
    first = ranked.groupBy(*by).agg(F.min("_rank").alias("_first"))
    renamed = first.select(*[F.col(b).alias(f"_k_{b}") for b in by], "_first")
    match = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by])
    return (ranked.join(renamed, match)
            .withColumn(name, F.col("_rank") - F.col("_first") + 1)
            .select(*df.columns, name))
