"""Keyed list state: pieces of a text leave as soon as they are contiguous."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestrata.streaming.jobs import deltas

# Ship the state processor with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Contiguous(StatefulProcessor):
    """State of a key: the number of the next piece, and the pieces behind a gap.

    A piece that was there before is passed over, whichever batch it comes in. What is written is forgotten, so
    the state is as long as what waits for a gap. A gap that is still open ``patience`` after the last piece is skipped.
    """

    def __init__(self, keys: list[str], patience_ms: int):
        self.keys, self.patience_ms = keys, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._next = handle.getValueState("next", "next long")
        self._held = handle.getMapState("held", "seq long", "text string")

    def _run(self, key: tuple, at: int, new: dict[int, str]) -> tuple[int, list[dict]]:
        """Pieces from ``at`` on; the next number and the rows to write (none or one)."""
        first, texts, held = at, [], self._held.exists()
        while True:
            if at in new:
                texts.append(new.pop(at))
            elif held and self._held.containsKey((at,)):
                texts.append(self._held.getValue((at,))[0])
                self._held.removeKey((at,))
            else:
                break
            at += 1
        row = {**dict(zip(self.keys, key)), "first": first, "pieces": len(texts), "text": "".join(texts)}
        return at, [row] if texts else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self._next.get()[0] if self._next.exists() else 0
        new, last = {}, 0
        for chunk in rows:
            last = max(last, int(chunk["ts_ms"].max()))
            for seq, text in zip(chunk["seq"].tolist(), chunk["text"].tolist()):
                if seq >= at:
                    new.setdefault(int(seq), text)
        at, out = self._run(key, at, new)
        for seq, text in new.items():
            if not self._held.containsKey((seq,)):
                self._held.updateValue((seq,), (text,))
        self._next.update((at,))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if self._held.exists():
            self._handle.registerTimer(last + self.patience_ms)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out = self._next.get()[0] if self._next.exists() else 0, []
        for seq in sorted(k[0] for k in self._held.keys()):
            if seq >= at:
                at, found = self._run(key, seq, {})
                out += found
        self._next.update((at,))
        if out:
            yield pd.DataFrame(out)


def assemble_stream(events: DataFrame, keys: list[str], seq: str, ts: str, data: str = "data", late: str = "10 minutes",
                    patience_ms: int = 600_000) -> DataFrame:
    """Runs of pieces of each stream, numbered from 0, as they become contiguous: keys, first, pieces, text.

    ``events`` is a stream with an event time ``ts``; rows that are later than ``late`` are dropped by Spark. The
    runs of a key put together in the order of ``first`` are its text. Needs the RocksDB state store, see ``rocksdb_session``.
    """
    rows = deltas(events, [*keys, ts], seq, data).filter("seq IS NOT NULL").select(
        *keys, F.col(ts).alias("ts"), F.col("seq").cast("long").alias("seq"), "text", F.unix_millis(F.col(ts).cast("timestamp")).alias("ts_ms"))
    schema = StructType([*[rows.schema[k] for k in keys], StructField("first", LongType()), StructField("pieces", LongType()),
                         StructField("text", StringType())])
    return (rows.withWatermark("ts", late).groupBy(*keys)
            .transformWithStateInPandas(Contiguous(keys, patience_ms), schema, outputMode="Append", timeMode="EventTime"))


def joined_text(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The text of each stream from its runs: keys, text, pieces."""
    parts = F.array_sort(F.collect_list(F.struct("first", "text")))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.sum("pieces").alias("pieces"))


def rocksdb_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one whose streams keep state in RocksDB; the given one's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own
