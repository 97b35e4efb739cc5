"""The stored index against the scan over texts, and pages at any depth against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import index as IX
from lodestrata.operators import select as P

WORDS = ["alpha", "beta", "Gamma", "delta", "eps1lon", "zeta", "common"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, [1, 2, 3, 1, 0.2, 0.1, 30], k=rng.randint(0, 30))), rng.choice(["gamma src", "other", "", None]), i % 7)
            for i in range(600)] + [(700, None, None, 1)]
    return spark.createDataFrame(rows, "id long, body string, title string, extra int").cache()


@pytest.mark.parametrize("query", ["zeta gamma", "common", "EPS1LON; zeta", "missing", "", "beta missing gamma zeta"])
def test_scores_equal_the_scan(spark, texts, tmp_path, query):
    path = IX.build_index(texts, "id", ["body", "title"], ["extra"], str(tmp_path / "ix"), block_rows=16)
    got = IX.search_indexed(spark, path, query, ["body", "title"], 12, "i")
    shown = lambda df: [(r["_id"], r["_index"], round(r["_score"], 5), r["total"]) for r in df.collect()]
    want = shown(P.search(texts, query, ["body", "title"], 12, "id", "i")) if query else []
    assert shown(got) == want
    assert all("/ix/" in f for f in got.inputFiles())
    hits = {r.id for r in IX.match_indexed(spark, path, query, "body").collect()}
    assert hits == ({r.id for r in P.match(texts, "body", query).collect()} if query else set())


def test_words_are_counted_in_their_rows(spark, tmp_path):
    rows = [(1, "b a b, A", "x"), (1, "b", "x"), (2, "", None), (3, None, "x x"), (None, "a", "x"), (None, "a c", "x")]
    docs = spark.createDataFrame(rows, "id long, body string, title string")
    counted = IX.counted_words(docs, "id", ["body", "title"])
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id or 0, r.field, r.term, r.tf, r.length) for r in counted.collect()) == sorted([
        (1, "body", "a", 2, 4), (1, "body", "b", 2, 4), (1, "body", "b", 1, 1), (0, "body", "a", 1, 1), (0, "body", "a", 1, 2),
        (0, "body", "c", 1, 2), (1, "title", "x", 1, 1), (1, "title", "x", 1, 1), (3, "title", "x", 2, 2),
        (0, "title", "x", 1, 1), (0, "title", "x", 1, 1)])
    path = IX.build_index(docs, "id", ["body", "title"], [], str(tmp_path / "ix"))
    # Rows that share an id, or have none, are one row to the index.
    postings = {(r.field, r.term): dict(zip(r.ids, r.tfs)) for r in spark.read.parquet(f"{path}/postings").withColumn(
        "ids", F.transform("ids", lambda i: F.coalesce(i, F.lit(0)))).groupBy("field", "term").agg(
        F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("tfs")).alias("tfs")).collect()}
    assert postings == {("body", "a"): {0: 2, 1: 2}, ("body", "b"): {1: 3}, ("body", "c"): {0: 1}, ("title", "x"): {0: 2, 1: 2, 3: 2}}


def test_blocks_below_the_bound_are_not_opened(spark, texts, tmp_path):
    path = IX.build_index(texts, "id", ["body"], [], str(tmp_path / "ix"), block_rows=16)
    plan = IX.search_indexed(spark, path, "zeta", ["body"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan
    assert spark.read.parquet(f"{path}/postings").groupBy("field", "term", "block").count().filter("count > 1").isEmpty()


def test_empty_index(spark, texts, tmp_path):
    path = IX.build_index(texts.limit(0), "id", ["body"], ["extra"], str(tmp_path / "ix"))
    assert IX.search_indexed(spark, path, "alpha", ["body"], 5).count() == 0
    assert IX.match_indexed(spark, path, "alpha", "body").count() == 0


@pytest.mark.parametrize("order", [["a", "b", "id"], ["-a", "b", "-id"], ["b", "-a", "id"], ["-b", "id"]])
def test_pages_equal_a_sort(spark, monkeypatch, order):
    rng = random.Random(3)
    monkeypatch.setattr(P, "BOUNDS", 7)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 3]), rng.choice([None, "x", "", "y"]) if rng.random() < 0.3 else f"s{rng.randint(0, 400)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a int, b string").cache()
    want = [r.id for r in df.orderBy(*P._sorting(order)).collect()]
    for skip in (0, 5, 1499, 2990, 3000, 9000):
        found, before, total = P.order_range(df, order, skip, 20, most=100)
        assert total == 3000 and (skip >= 3000 or found.count() <= 2000)
        page = found.orderBy(*P._sorting(order)).offset(max(0, skip - before)).limit(20)
        assert [r.id for r in page.collect()] == want[skip:skip + 20]


def test_pages_of_equal_rows(spark):
    df = spark.range(500).select(F.lit(1).alias("a"), F.lit("x").alias("b"))
    found, before, total = P.order_range(df, ["a", "b"], 300, 10, most=50)
    assert found.offset(300 - before).limit(10).count() == 10 and total == 500
    assert P.page_offset(df.limit(0), ["a"], 0, 10).count() == 0
    assert P.paginate(df, ["a", "b"], 2, 30).first()["total_pages"] == 17
