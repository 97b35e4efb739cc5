"""Keyed state with expiry on a stream of commands."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Ship the state processor with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUT = "key string, seq long, value string, expires_us long, live boolean"


WRITES = ("SET", "SETEX", "DEL")
FIELDS = ["seq", "ts_us", "op", "value", "ttl"]


def fold(commands: list[list]) -> tuple[str | None, int | None, bool]:
    """Value, expiry and liveness of a key after its commands (in the order of ``FIELDS``, sorted by seq)."""
    value, expires, alive = None, None, False
    for _, ts_us, op, new, ttl in commands:
        if alive and expires is not None and expires <= ts_us:
            alive, expires = False, None
        if op in ("SET", "SETEX"):
            alive, value = True, new
            expires = ts_us + ttl * 1_000_000 if ttl is not None else None
        elif op == "DEL":
            alive, expires = False, None
        elif op == "EXPIRE" and alive:
            expires = ts_us + ttl * 1_000_000
        elif op == "PERSIST" and alive:
            expires = None
    return value, expires, alive


def since_last_write(commands: list[list]) -> list[list]:
    """The newest write and what follows it: all that can still matter, whatever comes late."""
    newest = max((c[0] for c in commands if c[2] in WRITES), default=-1)
    return sorted((c for c in commands if c[0] >= newest), key=lambda c: c[0])


class TtlState(StatefulProcessor):
    """Commands of one key since its newest write. Time is the commands' own, so a run repeats exactly.

    Commands are ordered by seq, not by arrival: a late one takes its place among those kept, and
    one from before the newest write is without effect. A dead key is kept until the
    watermark has passed its last command, so a late write cannot bring it back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._cell = handle.getValueState("commands", "commands string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = json.loads(self._cell.get()[0]) if self._cell.exists() else []
        for chunk in rows:
            columns = [[None if pd.isna(v) else v for v in chunk[f].tolist()] for f in FIELDS]
            new = [[int(q), int(t), op, v, None if ttl is None else int(ttl)] for q, t, op, v, ttl in zip(*columns)]
            kept = since_last_write(kept + new)
        value, expires, alive = fold(kept)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._cell.update((json.dumps(kept),))
        if not alive:
            self._handle.registerTimer(max(c[1] for c in kept) // 1000 + 1)
        elif expires is not None:
            self._handle.registerTimer(expires // 1000)
        yield self._row(key, kept[-1][0], value if alive else None, expires if alive else None, alive)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._cell.exists():
            kept = json.loads(self._cell.get()[0])
            self._cell.clear()
            if fold(kept)[2]:
                yield self._row(key, kept[-1][0], None, None, False)

    @staticmethod
    def _row(key, seq, value, expires, alive) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "seq": [seq], "value": [value],
                             "expires_us": pd.array([expires], dtype="Int64"), "live": [alive]})


def kv_stream(commands: DataFrame, late: str = "1 minute") -> DataFrame:
    """Changes of key state: key, seq, value, expires_us, live.

    ``commands`` is a stream with seq, ts (timestamp), op, key, value, ttl. The
    last row per key (by batch, in a batch dead after live) is the state; needs the
    RocksDB state store.
    """
    rows = commands.filter(F.col("op").isin("SET", "SETEX", "DEL", "EXPIRE", "PERSIST")).select(
        "key", "seq", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "op", "value", F.col("ttl").cast("long").alias("ttl"))
    return (rows.withWatermark("ts", late).groupBy("key")
            .transformWithStateInPandas(TtlState(), OUT, outputMode="Update", timeMode="EventTime"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
