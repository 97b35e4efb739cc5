"""Rejected input as rows, load results, contiguous pieces and spans over several batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestrata.operators import aggregates as A
from lodestrata.operators import joins as J
from lodestrata.operators import merge as M
from lodestrata.sources import files as SF
from lodestrata.streaming import jobs as X
from lodestrata.streaming import pieces as P

START = dt.datetime(2024, 1, 1)


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "good.py").write_text("x = 1\n")
    (tmp_path / "src" / "bad.py").write_bytes(b"\xc3(")
    (tmp_path / "src" / "large.py").write_text("y" * 100)
    (tmp_path / "src" / ".hidden.py").write_text("y" * 100)
    got = {r.path: (r.size, r.error) for r in SF.scan_errors(spark, str(tmp_path), max_bytes=50).collect()}
    assert got == {"src/bad.py": (2, "Not UTF-8"), "src/large.py": (100, "Larger than 50 bytes")}
    assert [r.path for r in SF.scan_tree(spark, str(tmp_path), max_bytes=50).collect()] == ["src/good.py"]
    plan = SF.scan_tree(spark, str(tmp_path), max_bytes=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan  # the other branch is not even planned


def test_property_files(spark, tmp_path):
    (tmp_path / "app.env").write_text("A=1\nB\n# c\n\n9=x\nA=2\n")
    (tmp_path / "bad.env").write_bytes(b"A=\xff")
    errors = {(r.file.split("/")[-1], r.line, r.text, r.error) for r in SF.property_errors(spark, str(tmp_path), "*.env").collect()}
    assert errors == {("app.env", 2, "B", "No value"), ("app.env", 5, "9=x", "Invalid key"), ("bad.env", None, None, "Not UTF-8")}
    result = SF.properties_summary(SF.read_properties(spark, str(tmp_path), "*.env"), SF.property_errors(spark, str(tmp_path), "*.env")).first()
    assert tuple(result) == (1, 1, 1, 2, 1)


def test_documents_that_do_not_parse(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, "{"), (3, ""), (4, None), (5, "[1]")], "id int, doc string")
    assert [tuple(r) for r in M.unparsed(df, ["id"], "doc").orderBy("id").collect()] == [(2, 1, "Failed to parse JSON"), (3, 0, "Empty document")]


def test_writes_with_override(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 3, "c"), (None, 4, "d"), (None, 5, "e")], "k string, n int, v string")
    got = {r.n: r.status for r in M.first_wins(df, ["k"], ["n"], override=True).collect()}
    assert got == {1: "SET", 2: "OVERWRITE", 3: "SET", 4: "SET", 5: "OVERWRITE"}


def test_several_aggregations_in_one_pass(spark):
    rows = [(i % 3 if i % 7 else None, ["x", "x", str(i % 2)] if i % 5 else None, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "n int, tags array<string>, v double")
    specs = [("terms", "n", "ns", 2), ("terms", "tags", "ts", 5), ("avg", "v", "mean", None)]
    out = A.aggregate(df, specs)
    got = sorted(map(tuple, out.collect()), key=str)
    want = [("mean", None, None, 24.5)]
    want += [("ns", str(r.key), r.doc_count, None) for r in A.terms_agg(df, "n", 2).collect()]
    want += [("ts", r.key, r.doc_count, None) for r in A.terms_agg(df, "tags", 5).collect()]
    assert got == sorted(want, key=str)
    assert [tuple(r) for r in A.aggregate(df.limit(0), specs).collect()] == [("mean", None, None, None)]
    assert [r.key for r in A.aggregate(spark.range(12).select("id"), [("terms", "id", "i", 11)]).orderBy("key").collect()].count("11") == 0


def test_defaults_of_each_layer(spark):
    items = spark.createDataFrame([(1, 0, ["a", "b"], "x", "string"), (1, 1, ["a"], "flat", "string"), (2, 0, ["n"], "m", "string")],
                                  "doc_id long, of_layer int, path array<string>, value string, vtype string")
    defaults = spark.createDataFrame([(["a", "b"], "d", "string"), (["a", "c"], "e", "string"), (["g"], "h", "string")],
                                     "path array<string>, value string, vtype string")
    got = {(r.doc_id, r.of_layer, ".".join(r.path), r.value, r.layer) for r in J.with_defaults(items, defaults, ("doc_id", "of_layer")).collect()}
    assert got == {(1, 0, "a.b", "x", 1), (1, 0, "a.c", "e", 0), (1, 0, "g", "h", 0), (1, 1, "a", "flat", 1), (1, 1, "g", "h", 0),
                   (2, 0, "n", "m", 1), (2, 0, "a.b", "d", 0), (2, 0, "a.c", "e", 0), (2, 0, "g", "h", 0)}


def chunk(text):
    return '{"choices":[{"delta":{"content":"' + text + '"}}]}'


def test_pieces_over_batches(spark):
    """Out of order, doubled over batches, and one key with a hole that is skipped in the end."""
    rng = random.Random(2)
    own = P.rocksdb_session(spark)
    rows = []
    for key, numbers in (("a", range(40)), ("b", [n for n in range(20) if n != 7])):
        for n in numbers:
            for copy in range(1 + (n % 3 == 0)):
                rows.append((key, n, START + dt.timedelta(minutes=n), float(n + rng.randint(0, 8) + 4 * copy), chunk(f"{key}{n} ")))
    df = own.createDataFrame(rows, "k string, n long, ts timestamp, arrival double, data string")
    stream = X.replay(df, "arrival", "ts", "2 hours", "test-pieces", {"k": "", "n": 0, "data": chunk("")}, batches=5)
    runs = X.run_available(P.assemble_stream(stream, ["k"], "n", "ts", late="30 minutes"), None, "append", "test-runs", reader=spark).cache()
    texts = {r.k: (r.text, r.pieces) for r in P.joined_text(runs.filter("k <> ''"), ["k"]).collect()}
    assert texts["a"] == ("".join(f"a{n} " for n in range(40)), 40)
    assert texts["b"] == ("".join(f"b{n} " for n in range(20) if n != 7), 19)
    assert runs.filter("k = 'a'").count() > 1 and runs.filter("k = 'b' AND first = 8").count() == 1


def test_spans_over_batches(spark):
    """Open starts come when the watermark has passed them; an end far too late is dropped."""
    minute = lambda m: START + dt.timedelta(minutes=m)
    starts = [(i, minute(10 * i), float(10 * i)) for i in range(12)]
    ends = [(i, minute(10 * i + 3), "request:end", 10 * i + (7.0 if i % 2 else 3.0)) for i in range(12) if i % 4]
    ends.append((8, minute(82), "request:error", 119.0))  # in time by its clock, but it arrives long after
    s = X.replay(spark.createDataFrame(starts, "request_id long, ts timestamp, arrival double"), "arrival", "ts", "1 hour", "test-s", {"request_id": -1}, batches=10)
    e = X.replay(spark.createDataFrame(ends, "request_id long, ts timestamp, event string, arrival double"), "arrival", "ts", "1 hour", "test-e",
                 {"request_id": -2}, batches=10)
    out = X.run_available(X.spans(s, e, "5 minutes", "5 minutes"), None, "append", "test-spans")
    got = {r.request_id: r.outcome for r in out.filter("request_id >= 0").collect()}
    assert got == {i: "request:end" if i % 4 else None for i in range(12)}


def test_running_counts_over_batches(spark):
    rows = [(i, f"p{i % 3}", 200 + 300 * (i % 2), "DECR" if i % 5 == 0 else "INCR", 1, START + dt.timedelta(minutes=i)) for i in range(90)]
    df = spark.createDataFrame(rows, "i long, provider string, status_code int, op string, amount long, ts timestamp")
    feed = lambda name: X.replay(df, "i", "ts", "1 hour", name, {"op": "none", "provider": "none", "status_code": 0}, batches=4)
    status = X.run_available(X.status_stream(feed("test-st").filter("provider <> 'none'")), ["provider", "status"], "update", "test-status")
    assert sorted(r.checks for r in status.collect()) == [15] * 6
    counters = X.run_available(X.counter_stream(feed("test-ct").withColumnRenamed("provider", "key")), ["key"], "update", "test-counters")
    assert {r.key: r.value for r in counters.collect()} == {f"p{k}": sum(-1 if i % 5 == 0 else 1 for i in range(90) if i % 3 == k) for k in range(3)}


def test_events_over_batches(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"{n}.txt").write_text(f"data: one {n}\nid: {n}\n\n: ping\n\ndata: old\ndata: two {n}\nevent: e\n\n")
    frames = spark.readStream.option("lineSep", "\n\n").option("maxFilesPerTrigger", 1).text(str(tmp_path))
    out = X.run_available(X.sse_events(frames), None, "append", "test-sse")
    assert {(r.data, r.event, r.id) for r in out.collect()} == {(f"one {n}", None, str(n)) for n in range(4)} | {(f"two {n}", "e", None) for n in range(4)}
