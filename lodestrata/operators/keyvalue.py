"""State of a key/value store as a query over its command log.

A log row is ``(seq, ts, op, key, field, value, ttl, amount)``: ``seq`` is a
unique integer, ``ttl`` is in seconds. No operator folds the commands of a key
one after the other, so a key that holds most of the log is spread out too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.running import SEQ_BLOCK, running, seq_block


def _expiry(ts, ttl):
    return F.when(ttl.isNotNull(), F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + ttl.cast("long") * 1_000_000))


def kv_state(log: DataFrame, at: str, block: int = SEQ_BLOCK) -> DataFrame:
    """Live string keys at a time: key, value, ttl (whole seconds left, null without one).

    The last SET / SETEX / DEL of a key decides its value. An EXPIRE or PERSIST
    after it acts only on a key that is still alive: the key has died if any
    command finds the expiry set by the command before it already past. That
    test looks at neighbours only, so it is done per (key, block of seq) and
    then between the blocks.
    """
    now = F.lit(at).cast("timestamp")
    seen = log.filter(F.col("ts").cast("timestamp") <= now)
    writes = seen.filter(F.col("op").isin("SET", "SETEX", "DEL"))
    base = (writes.groupBy("key").agg(F.max_by(F.struct("op", "value", "ts", "ttl", "seq"), F.col("seq")).alias("b"))
            .filter(F.col("b.op") != "DEL"))
    start = base.select("key", F.col("b.seq").alias("seq"), F.col("b.ts").cast("timestamp").alias("ts"),
                        _expiry(F.col("b.ts"), F.col("b.ttl")).alias("exp"), F.col("b.value").alias("value"))
    later = (seen.filter(F.col("op").isin("EXPIRE", "PERSIST"))
             .join(start.select("key", F.col("seq").alias("_from")), "key")
             .filter(F.col("seq") > F.col("_from"))
             .select("key", "seq", F.col("ts").cast("timestamp").alias("ts"),
                     F.when(F.col("op") == "EXPIRE", _expiry(F.col("ts"), F.col("ttl"))).alias("exp"),
                     F.lit(None).cast("string").alias("value")))
    line = start.unionByName(later).withColumn("_block", seq_block("seq", block))
    inside = Window.partitionBy("key", "_block").orderBy("seq")
    blocks = (line.withColumn("_died", F.lag("exp").over(inside) <= F.col("ts"))
              .groupBy("key", "_block").agg(
                  F.coalesce(F.bool_or("_died"), F.lit(False)).alias("_died"), F.min_by("ts", "seq").alias("_first"),
                  F.max_by("exp", "seq").alias("_exp"), F.max("value").alias("value")))
    between = Window.partitionBy("key").orderBy("_block")
    state = (blocks.withColumn("_died", F.col("_died") | F.coalesce(
                 F.lag("_exp").over(between) <= F.col("_first"), F.lit(False)))
             .groupBy("key").agg(F.bool_or("_died").alias("_died"), F.max_by("_exp", "_block").alias("_exp"),
                                 F.max("value").alias("value")))
    alive = ~F.col("_died") & (F.col("_exp").isNull() | (F.col("_exp") > now))
    left = F.floor((F.unix_micros("_exp") - F.unix_micros(now)) / 1_000_000).cast("long")
    return state.filter(alive).select("key", "value", left.alias("ttl"))


def hash_state(log: DataFrame) -> DataFrame:
    """Fields of every hash: rows (key, field, value)."""
    writes = log.filter(F.col("op").isin("HSET", "HDEL"))
    last = writes.groupBy("key", "field").agg(F.max_by(F.struct("op", "value"), F.col("seq")).alias("l"))
    return last.filter(F.col("l.op") == "HSET").select("key", "field", F.col("l.value").alias("value"))


def hash_maps(state: DataFrame, max_fields: int = 10_000) -> DataFrame:
    """Hashes as maps: (key, part, fields MAP). A hash with more fields comes in several parts."""
    sizes = state.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / max_fields).alias("_parts"))
    cut = state.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("field"), F.col("_parts")))
    return cut.groupBy("key", "part").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def list_state(log: DataFrame, block: int = SEQ_BLOCK) -> DataFrame:
    """Items of every list: rows (key, index, value, length).

    Pushes and pops move two ends on a line of positions. A pop on an empty
    list does nothing; it is one where the running push-minus-pop count falls
    below all earlier values. With those left out, the ends are running sums,
    and a position between the final ends holds the last value pushed there.
    """
    ops = log.filter(F.col("op").isin("LPUSH", "RPUSH", "LPOP", "RPOP")).select("key", "seq", "op", "value")
    cut = seq_block("seq", block)
    by_seq = [F.col("seq")]
    pop = F.col("op").isin("LPOP", "RPOP")
    level = running(ops, ["key"], by_seq, cut, {"_s": ("sum", F.when(pop, -1).otherwise(1))})
    lows = running(level, ["key"], by_seq, cut, {"_low": ("min", F.col("_s"))}, include_current=False)
    empty_pop = pop & (F.col("_s") < F.least(F.lit(0), F.coalesce("_low", F.lit(0))))
    real = lows.filter(~empty_pop).select("key", "seq", "op", "value")
    head = F.when(F.col("op") == "LPUSH", -1).when(F.col("op") == "LPOP", 1).otherwise(0)
    tail = F.when(F.col("op") == "RPUSH", 1).when(F.col("op") == "RPOP", -1).otherwise(0)
    ends = real.groupBy("key").agg(F.sum(head).alias("_head"), F.sum(tail).alias("_tail"))
    moved = running(real, ["key"], by_seq, cut, {"_h": ("sum", head), "_t": ("sum", tail)})
    placed = moved.filter(F.col("op").isin("LPUSH", "RPUSH")).withColumn(
        "_pos", F.when(F.col("op") == "LPUSH", F.col("_h")).otherwise(F.col("_t") - 1))
    cells = placed.groupBy("key", "_pos").agg(F.max_by("value", "seq").alias("value"))
    return (cells.join(ends, "key").filter((F.col("_pos") >= F.col("_head")) & (F.col("_pos") < F.col("_tail")))
            .select("key", (F.col("_pos") - F.col("_head")).alias("index"), "value",
                    (F.col("_tail") - F.col("_head")).alias("length")))


def list_range(state: DataFrame, start: int = 0, stop: int = -1) -> DataFrame:
    """Items between two indexes, both included; negative ones count from the end."""
    n = F.col("length")
    low = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    high = F.lit(stop) if stop >= 0 else n + stop
    return state.filter((F.col("index") >= low) & (F.col("index") <= high))


def _signed():
    return F.when(F.col("op").isin("DECRBY", "DECR"), -F.col("amount")).otherwise(F.col("amount"))


def counter_state(log: DataFrame) -> DataFrame:
    """Value of every counter."""
    return (log.filter(F.col("op").isin("INCRBY", "INCR", "DECRBY", "DECR"))
            .groupBy("key").agg(F.sum(_signed()).alias("value")))


def counter_series(log: DataFrame, block: int = SEQ_BLOCK) -> DataFrame:
    """Value of a counter after each of its commands."""
    ops = (log.filter(F.col("op").isin("INCRBY", "INCR", "DECRBY", "DECR"))
           .select("key", "seq", _signed().alias("delta")))
    return running(ops, ["key"], [F.col("seq")], seq_block("seq", block), {"value": ("sum", F.col("delta"))})


def kv_stats(state: DataFrame) -> DataFrame:
    """Live keys and bytes of keys and values."""
    return state.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(
        F.sum(F.octet_length("key") + F.octet_length("value")), F.lit(0)).alias("bytes"))
