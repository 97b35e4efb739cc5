"""Plans and tasks stay bounded where Spark's estimates, or the number of files or splits, would mislead them."""

import re

from pyspark.sql import functions as F

from lodestrata.functions import template as T
from lodestrata.operators import aggregates as A
from lodestrata.operators import joins as J
from lodestrata.operators import merge as M
from lodestrata.plans import flows, layered
from lodestrata.sources import files as SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scopes_from_texts_are_not_broadcast(spark):
    # One small row for Spark's estimate, a thousand scopes in it.
    scopes = spark.range(1).select(F.lit("a.py").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("start_line")).select(
        "path", "start_line", (F.col("start_line") + 1).alias("end_line"), F.lit("class").alias("node_type"),
        F.concat(F.lit("c"), "start_line").alias("name"))
    points = spark.createDataFrame([("a.py", 5), ("b.py", 5)], "path string, line int")
    for found in (J.breadcrumbs(points, scopes, cell=8), J.nearest_scope(points, scopes)):
        assert "Broadcast" not in plan_of(found)
    assert {(r.path, r.trail) for r in J.breadcrumbs(points, scopes, cell=8).collect()} == {("a.py", "c4 > c5"), ("b.py", "")}
    assert {(r.path, r.scope_name) for r in J.nearest_scope(points, scopes).collect()} == {("a.py", "c5"), ("b.py", None)}


def test_many_small_files_are_written_and_listed_by_the_cores(spark, tmp_path):
    rows = spark.range(1, 101).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "CAST(1 AS INT) AS s_nationkey", "0.0D AS s_acctbal")
    rows.union(rows.filter("s_suppkey <= 4")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    sc, folder = spark.sparkContext, flows.property_files(spark, str(tmp_path))
    before = spark.conf.get(SF.LISTING)
    sc.setJobGroup("listing", "listing")
    try:
        errors = SF.property_errors(spark, folder, "*.txt")
        stages = [s for j in sc.statusTracker().getJobIdsForGroup("listing") for s in sc.statusTracker().getJobInfo(j).stageIds]
        assert 0 < sum(sc.statusTracker().getStageInfo(s).numTasks for s in stages) <= SF.LISTING_TASKS * sc.defaultParallelism
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(SF.LISTING) == before
    found = errors.collect()
    # A key that comes twice has one file with both rows' lines, so no line number twice.
    assert len(found) == 2 * 84 + 20 and len({r.file for r in found}) == 100
    assert len({(r.file, r.line) for r in found}) == len(found)
    assert len({re.search(r"part-(\d+)", r.file).group(1) for r in found}) > 1


def test_tables_of_one_split_are_dealt_to_the_cores(spark, tmp_path):
    rows = spark.range(1, 41).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(1 AS INT) AS p_size")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert layered.layers(spark, str(tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_contexts_from_texts_are_not_broadcast(spark):
    context = spark.createDataFrame([(1, '{"a":"x"}')], "doc_id long, context string")
    base = spark.createDataFrame([(1, ["k"], "v", "string")], "doc_id long, path array<string>, value string, vtype string")
    over = spark.createDataFrame([(1, ["n"], "{{a}}", "string")], "doc_id long, path array<string>, value string, vtype string")
    out = M.overlay(base, over, context)
    assert re.search(r"Join LeftOuter, .*strategy=merge", out._jdf.queryExecution().optimizedPlan().toString())
    assert sorted((r.path[0], r.value) for r in out.collect()) == [("k", "v"), ("n", "x")]


def test_counts_from_texts_are_not_broadcast(spark):
    # One small row for Spark's estimate, a thousand items in it.
    items = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("i")).select(
        F.concat(F.lit("f"), F.col("i") % 10).alias("path"), F.when(F.col("i") % 2 == 0, "classes").otherwise("constants").alias("kind"))
    items = items.unionByName(spark.createDataFrame([(None, "classes"), ("f1", None), ("f1", "other"), ("none", "other")], "path string, kind string"))
    files = spark.createDataFrame([("f1",), ("f1",), ("f2",), ("none",), (None,)], "path string")
    out = A.file_summary(files, items)
    assert "Broadcast" not in plan_of(out)
    assert sorted((str(r.path), r.summary) for r in out.collect()) == [
        ("None", {}), ("f1", {"constants": 100}), ("f1", {"constants": 100}), ("f2", {"classes": 100}), ("none", {})]


def test_matches_are_read_without_a_look_up_per_character(spark):
    # Signs used as marks in the text itself, a line end at a match, an empty group, pieces beyond FEW_PIECES.
    text = "a\u0001=1\nb=\u0002\n\u2028c=3" + "\nd=4" * 200
    spans = T.match_spans(F.col("text"), "([a-z])=(\\d?)\n?", 2, "\n\u2028")
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(spans.alias("m"))
    assert "translate" not in plan_of(df)
    rows = [r.m for r in df.collect()]
    clean = text.translate({1: None, 2: None})
    wanted = [([m.group(), m.group(1), m.group(2)], 1 + len(re.findall("[\n\u2028]", clean[:m.start()])), m.start())
              for m in re.finditer("([a-z])=(\\d?)\n?", clean)]
    assert [(x.f, x.line, x.at) for x in rows[0]] == wanted and len(wanted) == 203
    assert rows[1] is None and rows[2] == []
