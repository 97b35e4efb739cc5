"""State operators against plain Python on random logs, with blocks small enough to matter."""

import datetime as dt
import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from lodestrata.operators import keyvalue as K
from lodestrata.operators import ordered as W
from lodestrata.operators.running import global_rank, rank_within, running, seq_block

START = dt.datetime(2024, 1, 1)


def hot_key(rng):
    """One key takes most of the commands."""
    return "hot" if rng.random() < 0.6 else rng.choice("abc")


def test_list_state_equals_a_deque(spark):
    rng = random.Random(7)
    want, rows = defaultdict(deque), []
    for seq in range(3000):
        key, op = hot_key(rng), rng.choice(["LPUSH", "RPUSH", "LPOP", "RPOP", "LPOP"])
        rows.append((seq, op, key, f"v{seq}"))
        q = want[key]
        if op == "LPUSH":
            q.appendleft(f"v{seq}")
        elif op == "RPUSH":
            q.append(f"v{seq}")
        elif q:
            q.popleft() if op == "LPOP" else q.pop()
    log = spark.createDataFrame(rows, "seq long, op string, key string, value string")
    got = defaultdict(dict)
    for r in K.list_state(log, block=100).collect():
        got[r["key"]][r["index"]] = r["value"]
        assert r["length"] == len(want[r["key"]])
    for key, q in want.items():
        assert [got[key][i] for i in sorted(got[key])] == list(q)


def test_list_range_ends(spark):
    log = spark.createDataFrame([(i, "RPUSH", "k", str(i)) for i in range(5)], "seq long, op string, key string, value string")
    state = K.list_state(log)
    for start, stop in ((0, -1), (1, 2), (-2, -1), (-10, 1), (3, 99), (4, 1)):
        got = sorted((r["index"], r["value"]) for r in K.list_range(state, start, stop).collect())
        low = start if start >= 0 else max(5 + start, 0)
        high = stop if stop >= 0 else 5 + stop
        assert [v for _, v in got] == [str(i) for i in range(5) if low <= i <= high]


def test_kv_state_equals_a_fold(spark):
    rng = random.Random(11)
    rows, cells = [], {}
    for seq in range(3000):
        ts = START + dt.timedelta(seconds=60 * seq)
        key = hot_key(rng)
        op = rng.choices(["SET", "SETEX", "DEL", "EXPIRE", "PERSIST"], [1, 1, 0.2, 3, 2])[0]
        ttl = rng.randint(60, 1200) if op in ("SETEX", "EXPIRE") else None
        rows.append((seq, ts, op, key, f"v{seq}", ttl))
        cell = cells.get(key)
        if cell and cell[1] is not None and cell[1] <= ts:
            cell = cells[key] = None
        until = ts + dt.timedelta(seconds=ttl) if ttl else None
        if op in ("SET", "SETEX"):
            cells[key] = (f"v{seq}", until)
        elif op == "DEL":
            cells[key] = None
        elif cell:
            cells[key] = (cell[0], until if op == "EXPIRE" else None)
    log = spark.createDataFrame(rows, "seq long, ts timestamp, op string, key string, value string, ttl long")
    at = START + dt.timedelta(seconds=60 * 3000)
    want = {k: c[0] for k, c in cells.items() if c and (c[1] is None or c[1] > at)}
    for block in (50, 1_000_000):
        got = {r["key"]: r["value"] for r in K.kv_state(log, str(at), block).collect()}
        assert got == want


def test_expire_on_a_dead_key_does_nothing(spark):
    t = [START + dt.timedelta(seconds=s) for s in (0, 100, 200)]
    log = spark.createDataFrame([(1, t[0], "SETEX", "k", "v", 50), (2, t[1], "EXPIRE", "k", None, 500), (3, t[2], "PERSIST", "k", None, None)],
                                "seq long, ts timestamp, op string, key string, value string, ttl long")
    assert K.kv_state(log, str(START + dt.timedelta(seconds=60))).count() == 0
    assert K.kv_state(log, str(START + dt.timedelta(seconds=210))).count() == 0
    assert K.kv_state(log, str(START + dt.timedelta(seconds=10))).first()["ttl"] == 40


def test_set_clears_an_old_ttl(spark):
    log = spark.createDataFrame([(1, START, "SETEX", "k", "a", 5), (2, START, "SET", "k", "b", None)],
                                "seq long, ts timestamp, op string, key string, value string, ttl long")
    row = K.kv_state(log, str(START + dt.timedelta(days=1))).first()
    assert (row["value"], row["ttl"]) == ("b", None)


def test_hash_maps_in_parts(spark):
    state = spark.createDataFrame([("h", f"f{i}", str(i)) for i in range(50)] + [("g", "x", "1")], "key string, field string, value string")
    rows = K.hash_maps(state, max_fields=10).collect()
    merged = {}
    for r in rows:
        if r["key"] == "h":
            merged.update(r["fields"])
    assert merged == {f"f{i}": str(i) for i in range(50)} and len(rows) > 2


def test_running_carries_over_blocks(spark):
    rng = random.Random(3)
    rows = [(hot_key(rng), i, rng.randint(-9, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    out = running(df, ["k"], [F.col("i")], seq_block("i", 17), {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))})
    got = {r["i"]: (r["s"], r["lo"], r["hi"]) for r in out.collect()}
    seen = defaultdict(list)
    for k, i, v in rows:
        seen[k].append(v)
        assert got[i] == (sum(seen[k]), min(seen[k]), max(seen[k]))


def test_ranks_are_gapless(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(hot_key(rng), rng.random(), i) for i in range(1000)], "k string, v double, i long")
    ranks = global_rank(df, [F.col("v"), F.col("i")]).orderBy("v").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 1001))
    by_key = defaultdict(list)
    for r in rank_within(df, ["k"], [F.col("v"), F.col("i")]).orderBy("v").collect():
        by_key[r["k"]].append(r["rank"])
    assert all(v == list(range(1, len(v) + 1)) for v in by_key.values())


def test_number_rows_width(spark):
    ids = [r["id"] for r in W.number_rows(spark.range(1001), ["id"], "VC", name="id2").select(F.col("id2").alias("id")).collect()]
    assert "VC-001" in ids and "VC-1001" in ids


def test_kv_stream_orders_by_seq_over_batches(spark, tmp_path):
    """A command that arrives in a later batch with a lower seq takes its place by seq."""
    from lodestrata.streaming import jobs, ttl
    schema = "seq long, ts timestamp, op string, key string, value string, ttl long"
    batches = [[(5, "SET", "a", "new", None), (9, "DEL", "b", None, None), (8, "EXPIRE", "c", None, 50_000)],
               [(2, "SET", "a", "old", None), (3, "SET", "b", "gone", None), (7, "SET", "c", "kept", None)],
               [(6, "EXPIRE", "a", None, 90_000)]]
    for n, rows in enumerate(batches):
        stamped = [(q, f"2024-01-01 00:00:{q:02d}", *rest) for q, *rest in rows]
        df = spark.createDataFrame(stamped, "seq long, ts string, op string, key string, value string, ttl long")
        df.withColumn("ts", df["ts"].cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "log"), mode="append")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ttl.ROCKSDB)
    try:
        def result(path):
            log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
            changes = ttl.kv_stream(log, late="1 day")
            return {r.key: (r.value, r.live) for r in jobs.run_available(changes, ["key"], "update", "kv", tie="NOT live").collect()}
        assert result(str(tmp_path / "log")) == {"a": ("new", True), "b": (None, False), "c": ("kept", True)}
        (tmp_path / "empty").mkdir()
        assert result(str(tmp_path / "empty")) == {}
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_kv_fold_is_the_same_in_any_order_of_arrival():
    import itertools

    from lodestrata.streaming.ttl import fold, since_last_write
    commands = [[1, 0, "SET", "x", None], [2, 1_000_000, "EXPIRE", None, 5], [3, 2_000_000, "SETEX", "y", 4],
                [4, 3_000_000, "PERSIST", None, None], [5, 9_000_000, "EXPIRE", None, 1]]
    want = fold(commands)
    for order in itertools.permutations(commands):
        kept = []
        for c in order:
            kept = since_last_write([*kept, c])
        assert fold(kept) == want
