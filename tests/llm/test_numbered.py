"""Row numbers do not depend on how the files are split; frames of any kind and clashing columns."""

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import line_dedup, mixing, near_dedup, quality, simhash_dedup
from lodestrata.llm.common import DOC, ROW, fields_of, numbered, packed


def test_row_numbers_hold_between_scans(spark, tmp_path):
    path = str(tmp_path / "some docs")
    spark.range(4000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 50) AS text").repartition(5).write.option(
        "parquet.block.size", 4096).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("128m", "16k", "40k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append({r.doc_id: r[ROW] for r in numbered(spark.read.parquet(path), "doc_id", "text").select("doc_id", ROW).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found[0]) == len(set(found[0].values())) == 4000
    assert found[0] == found[1] == found[2]


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.range(60).selectExpr("id AS doc_id", "concat('text of ', id % 50) AS text", "'s' AS source").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("make", [
    lambda d: d.unionByName(d), lambda d: d.join(d.select("doc_id", F.col("text").alias("other")), "doc_id"),
    lambda d: d.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("source").alias("source")),
    lambda d: d.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), lambda d: d.orderBy("doc_id").limit(20),
    lambda d: d.filter("doc_id % 2 = 0")])
def test_frames_of_any_kind(scan, make):
    docs = make(scan)
    once = numbered(docs, "doc_id", "text")
    first, second = ({(r[ROW], r.doc_id) for r in once.collect()} for _ in range(2))
    assert first == second and len({r for r, _ in first}) == docs.count()
    assert {(r[ROW], r.doc_id) for r in numbered(once, "doc_id").collect()} == first
    whole = packed(docs)
    assert {(r[ROW], r.doc_id) for r in fields_of(whole, "doc_id").collect()} == {(r[ROW], r.doc_id) for r in whole.select(ROW, f"{DOC}.doc_id").collect()}


CLASHES = ["__row", "__kept", "__key", "__drop", "__taken", "__times", "__copy", "__text", "__doc", "kept", "set", "size", "line_no", "slot"]


def test_clashing_columns(spark, tmp_path):
    rows = [(i, f"some words of a line {i % 4}\nthe same long line in all of the documents here", "s", 10) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    for name in CLASHES:
        df = df.withColumn(name, F.col("doc_id"))
    df.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    for out in (quality.keep_good(docs, labels), line_dedup.drop_repeated_lines(docs), near_dedup.keep_one_of_each(docs),
                simhash_dedup.keep_one_of_each(docs), mixing.apply_mix(docs)):
        found = out.collect()
        assert out.columns == docs.columns and found
        assert all(r[name] == r.doc_id for r in found for name in CLASHES)


def test_stages_on_frames_that_are_no_scan(spark):
    rows = [(i // 2, f"alpha beta gamma delta epsilon {i % 5}", "s") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = near_dedup.keep_one_of_each(docs).collect()
    assert sorted(r.text[-1] for r in kept) == ["0", "1", "2", "3", "4"]
    assert line_dedup.drop_repeated_lines(docs.unionByName(docs)).count() == 20


def test_remaining_lines(spark):
    df = spark.createDataFrame([("a\nb\nc\nd", [0, 2]), ("a\nb", [1]), ("a", [0]), ("a\nb\nc", [0, 1, 2]), ("a\n\nb\n", [])], "t string, d array<int>")
    got = [r[0] for r in df.select(F.array_join(line_dedup.remaining(F.split("t", "\n"), F.col("d")), "\n")).collect()]
    assert got == ["b\nd", "a", "", "", "a\n\nb\n"]
