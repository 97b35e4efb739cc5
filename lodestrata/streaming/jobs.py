"""Streams of server-sent events, request spans, checks and key/value commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import status_class
from lodestrata.session import scratch_path


def read_frames(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """Event-stream text, one row per frame (frames end with a blank line)."""
    reader = spark.readStream if streaming else spark.read
    return reader.option("lineSep", "\n\n").text(path)


def sse_events(frames: DataFrame, col: str = "value") -> DataFrame:
    """Events of frames: data, event, id, retry. The last line of a kind counts; no data, no event."""
    def last(name: str):
        lines = F.filter(F.split(F.col(col), "\n"), lambda x: x.startswith(f"{name}: "))
        return F.substring(F.try_element_at(lines, F.lit(-1)), F.lit(len(name) + 3), F.length(col))

    rest = [c for c in frames.columns if c != col]
    out = frames.select(*rest, last("data").alias("data"), last("event").alias("event"), last("id").alias("id"),
                        F.regexp_extract(last("retry"), "^\\s*([0-9]+)", 1).try_cast("int").alias("retry"))
    return out.filter(F.col("data").isNotNull() & (F.col("data") != ""))


def deltas(events: DataFrame, keys: list[str], seq: str, data: str = "data") -> DataFrame:
    """Text pieces of chat chunks; ``[DONE]`` and bad JSON are left out."""
    good = events.filter((F.col(data) != "[DONE]") & F.try_parse_json(data).isNotNull())
    text = F.get_json_object(data, "$.choices[0].delta.content")
    return good.select(*keys, F.col(seq).alias("seq"), F.coalesce(text, F.lit("")).alias("text"))


def assemble(events: DataFrame, keys: list[str], seq: str, data: str = "data", chunk: int = 100_000) -> DataFrame:
    """Text of each stream, its pieces in order: keys, chunk, text.

    A stream of any length comes in chunks of at most ``chunk`` sequence numbers;
    ordinary answers are one chunk. Works on batches and on streams.
    """
    pieces = deltas(events, keys, seq, data).withColumn("chunk", F.floor(F.col("seq") / chunk).cast("long"))
    # A set: a piece that is delivered twice counts once.
    got = pieces.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_set(F.struct("seq", "text"))).alias("_p"))
    return got.select(*keys, "chunk", F.array_join(F.transform("_p", lambda x: x["text"]), "").alias("text"),
                      F.size("_p").cast("long").alias("pieces"))


def spans(starts: DataFrame, ends: DataFrame, timeout: str = "10 minutes", late: str = "10 minutes",
          streaming: bool = True) -> DataFrame:
    """Requests paired with their end or error: start, end, outcome, duration in ms; open ones have no end.

    ``starts`` has request_id, ts; ``ends`` has request_id, ts, event. An end counts
    when it comes within ``timeout`` of the start. The time bound and the
    watermarks let a stream drop old state. A stream gives an open start once the watermark is
    past it by the timeout.
    """
    s = starts.select(F.col("request_id").alias("s_id"), F.col("ts").alias("start_ts"))
    e = ends.select(F.col("request_id").alias("e_id"), F.col("ts").alias("end_ts"), F.col("event").alias("outcome"))
    if streaming:
        s, e = s.withWatermark("start_ts", late), e.withWatermark("end_ts", late)
    on = ((F.col("s_id") == F.col("e_id")) & (F.col("end_ts") >= F.col("start_ts"))
          & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {timeout}")))
    ms = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000
    return s.join(e, on, "left_outer").select(F.col("s_id").alias("request_id"), "start_ts", "end_ts", "outcome",
                                              ms.alias("duration_ms"))


def replay(df: DataFrame, arrival: str, ts: str, after: str, name: str, mark: dict, batches: int = 4, rows: int = 1_000_000) -> DataFrame:
    """``df`` as a stream of several batches in the order of ``arrival``, closed by two marker batches.

    Each batch is one file of at most about ``rows`` rows. A marker is a row with the values of ``mark``
    whose ``ts`` lies ``after`` behind the last row; it moves the watermark past the end, so what waits for it
    (the unmatched rows of an outer join) is delivered. The reader drops the marker; it should not be told by a
    null, because filters on nulls are moved before the watermark. The files' times are set, so the store has to allow that.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    parts = max(batches, -(-df.count() // rows))
    df.repartitionByRange(parts, arrival).sortWithinPartitions(arrival).write.parquet(path)
    end = df.agg((F.max(ts) + F.expr(f"INTERVAL {after}")).alias("_end"))
    marker = end.select(*[(F.col("_end") if c == ts else F.lit(mark.get(c))).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def data_files() -> dict:
        found = {f.getPath().getName(): f.getPath() for f in fs.listStatus(folder)}
        return {n: p for n, p in found.items() if n.startswith("part-")}
    order = sorted(data_files().items())
    for _ in range(2):
        marker.coalesce(1).write.mode("append").parquet(path)
        known = {n for n, _ in order}
        order += [(n, p) for n, p in data_files().items() if n not in known]
    for place, (_, file) in enumerate(order):
        fs.setTimes(file, 1_600_000_000_000 + 1000 * place, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def status_stream(checks: DataFrame) -> DataFrame:
    """Running number of checks per provider and status class."""
    return checks.groupBy("provider", status_class("status_code").alias("status")).agg(F.count(F.lit(1)).alias("checks"))


def counter_stream(commands: DataFrame) -> DataFrame:
    """Running value of every counter."""
    ops = commands.filter(F.col("op").isin("INCRBY", "INCR", "DECRBY", "DECR"))
    signed = F.when(F.col("op").isin("DECRBY", "DECR"), -F.col("amount")).otherwise(F.col("amount"))
    return ops.groupBy("key").agg(F.sum(signed).alias("value"))


def run_available(stream: DataFrame, keys: list[str] | None, mode: str, name: str, tie: str | None = None,
                  reader: SparkSession | None = None) -> DataFrame:
    """Run a stream over the input that is there and give its result as a batch frame.

    Each micro-batch overwrites its own folder, so a batch that is run again
    after a failure leaves no double rows. With ``keys`` the newest row per key is kept; of
    two in one batch the one with the larger ``tie`` (an expression). No input gives no rows. The
    result belongs to the session ``reader``, if another than the stream's.
    """
    spark = reader or stream.sparkSession
    out, marks = scratch_path(spark, name), scratch_path(spark, name + "-marks")

    batches = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batches.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", marks)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(out) if batches else spark.createDataFrame([], schema)
    if keys is None:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", F.expr(tie or "0"))).alias("_r")).select(*keys, "_r.*")
