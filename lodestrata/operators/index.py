"""A stored inverted index: searches read the postings of their terms, never the texts.

The index is a folder with three tables.

``postings``  one row per (field, term, block of rows): ids, term frequencies and field lengths as
arrays, and the best impact of the block. Written in buckets of the term (folders), sorted by term
inside, so a query's filter reads the buckets and row groups of its terms only.
``fields``    rows with text and the mean number of tokens per field.
``rows``      the stored columns by id.

A block is the rows whose id hashes to it, about ``BLOCK_ROWS`` of them, and the same for all terms and
fields. So a posting list of a word that every row has is many rows, and the block maxima bound the score of
every row of a block. A search first looks at the maxima alone: the size-th largest single impact is a
score that ``size`` rows reach, and blocks whose sum of maxima stays below cannot hold a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.select import BM25_B, BM25_K1, query_terms, tokens
from lodestrata.session import scratch_path

BLOCK_ROWS = 4096
BUCKETS = 32
#: Tasks that write a bucket, at most.
PARTS = 16


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _saturation(tf: Column, length: Column, mean: Column) -> Column:
    """The part of BM25 that depends on the row."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def _run_starts(sorted_array: str, n: Column, same) -> Column:
    """Places (from 0) in a sorted array at which a new value starts; null where there are none."""
    before = lambda i: F.get(sorted_array, i - 1)
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~same(F.get(sorted_array, i), before(i))))


def _run_length(starts: str, at: Column, i: Column, n: Column) -> Column:
    return F.coalesce(F.get(starts, i + 1), n) - at


def counted_words(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, field, length, term, tf of every row: words are sorted and counted in the row, nothing is shuffled."""
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.sort_array(tokens(f)).alias("t")) for f in fields]))
    words = df.select(F.col(id_col).alias("id"), texts.alias("x")).select("id", "x.field", "x.t", F.size("x.t").alias("length"))
    starts = words.withColumn("starts", _run_starts("t", F.col("length"), lambda a, b: a == b))
    counts = F.transform("starts", lambda at, i: F.struct(
        F.get("t", at).alias("term"), _run_length("starts", at, i, F.col("length")).alias("tf")))
    return starts.select("id", "field", "length", F.inline(counts))


def _one_per_id(rows: DataFrame) -> DataFrame:
    """Postings ``p`` sorted by id, with those of an id that comes in several rows put together."""
    n = F.size("p")
    starts = rows.withColumn("starts", F.when(F.size(F.array_distinct("p.id")) < n, _run_starts(
        "p", n, lambda a, b: a["id"].eqNullSafe(b["id"]))))
    merged = F.transform("starts", lambda at, i: F.struct(
        F.get("p", at)["id"].alias("id"),
        F.aggregate(F.slice("p", at + 1, _run_length("starts", at, i, n)), F.lit(0), lambda s, x: s + x["tf"]).alias("tf"),
        F.get("p", at)["length"].alias("length")))
    return starts.withColumn("p", F.coalesce(merged, "p")).drop("starts")


def build_index(df: DataFrame, id_col: str, fields: list[str], stored: list[str], path: str | None = None,
                block_rows: int = BLOCK_ROWS) -> str:
    """Write the index of ``fields`` below ``path`` (default: the shared folder); gives the path.

    Only words are shuffled, once, counted per row before: they go straight to the task that writes their
    bucket. ``id_col`` names each row once; rows that share an id are one row to the index.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "index")
    df.select(F.col(id_col).alias("id"), *[c for c in stored if c != "id"]).write.parquet(f"{path}/rows")
    blocks = max(1, -(-spark.read.parquet(f"{path}/rows").count() // block_rows))
    sizes = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(tokens(f)).alias("n")) for f in fields])).alias("x"))
    (sizes.select("x.*").groupBy("field").agg(F.count_if(F.col("n") > 0).alias("n"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean"))
     .coalesce(1).write.parquet(f"{path}/fields"))
    rows = counted_words(df, id_col, fields).withColumns({
        "block": F.pmod(F.xxhash64("id"), F.lit(blocks)), "bucket": _bucket(F.col("term"))}).withColumn("part", F.pmod("block", F.lit(PARTS)))
    posting = F.sort_array(F.collect_list(F.struct("id", "tf", "length")))
    lists = _one_per_id(rows.repartition("bucket", "part").groupBy("bucket", "part", "term", "field", "block").agg(posting.alias("p")))
    # One row per field.
    means = F.broadcast(spark.read.parquet(f"{path}/fields").select("field", "mean"))
    best = F.array_max(F.transform("p", lambda x: _saturation(x["tf"], x["length"], F.col("mean"))))
    (lists.join(means, "field").select(
        "field", "term", "block", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"),
        best.alias("best"), "bucket")
     .sortWithinPartitions("bucket", "term", "field", "block").write.partitionBy("bucket").parquet(f"{path}/postings"))
    return path


def _postings(spark: SparkSession, path: str, terms: list[str], fields: list[str] | None) -> DataFrame:
    """The rows of the query's terms; the filters are partition and row-group filters of the scan."""
    buckets = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(F.array(*[_bucket(F.lit(t)) for t in terms])))).collect()]
    kind = spark.read.parquet(f"{path}/rows").schema["id"].dataType.simpleString()
    schema = f"field string, term string, block long, ids array<{kind}>, tfs array<int>, lengths array<int>, best double, bucket int"
    found = spark.read.schema(schema).parquet(f"{path}/postings").filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))
    return found.filter(F.col("field").isin(*fields)) if fields else found


def match_indexed(spark: SparkSession, path: str, text: str, field: str) -> DataFrame:
    """Stored columns of the rows whose field holds any word of the text."""
    terms = query_terms(text)
    rows = spark.read.parquet(f"{path}/rows")
    if not terms:
        return rows.limit(0)
    hits = _postings(spark, path, terms, [field]).select(F.explode("ids").alias("id")).distinct()
    return rows.join(hits, "id", "left_semi")


def search_indexed(spark: SparkSession, path: str, text: str, fields: list[str], size: int, index: str | None = None) -> DataFrame:
    """Ranked search as ``select.search`` gives it: _id, _index, _score, total, _source (the stored columns)."""
    terms, rows = query_terms(text), spark.read.parquet(f"{path}/rows")
    source = F.struct(*[c for c in rows.columns if c != "id"]).alias("_source")
    shape = rows.select(F.col("id").alias("_id"), F.lit(index).alias("_index"), F.lit(0.0).alias("_score"), F.lit(0).cast("long").alias("total"), source)
    if not terms or size < 1:
        return shape.limit(0)
    found = _postings(spark, path, terms, fields)
    # At most one row per term and field of the query.
    weights = (found.groupBy("field", "term").agg(F.sum(F.size("ids")).alias("d"))
               .join(F.broadcast(spark.read.parquet(f"{path}/fields")), "field")
               .select("field", "term", "mean", F.log(F.lit(1.0) + (F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5)).alias("idf")))
    weighted = found.join(F.broadcast(weights), ["field", "term"])
    # Bounds from the block maxima, without the lists.
    impact = F.col("idf") * F.col("best")
    bounds = (weighted.groupBy("block", "field").agg(F.sum(impact).alias("most"), F.max(impact).alias("reached"))
              .groupBy("block").agg(F.max("most").alias("most"), F.max("reached").alias("reached")))
    top = bounds.orderBy(F.desc("reached")).limit(size).agg(F.count(F.lit(1)).alias("n"), F.min("reached").alias("least"))
    floor = F.when(F.col("n") == size, F.col("least") - 1e-6).otherwise(F.lit(-1.0))
    open_blocks = bounds.filter(F.col("most") >= top.select(floor).scalar()).select("block")
    hit = F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("h")
    scored = (weighted.join(open_blocks, "block").select("field", "idf", "mean", hit)
              .groupBy(F.col("h.ids").alias("id"), "field")
              .agg(F.sum(F.col("idf") * _saturation(F.col("h.tfs"), F.col("h.lengths"), F.col("mean"))).alias("s"))
              .groupBy("id").agg(F.round(F.max("s"), 6).alias("_score")))
    best = scored.orderBy(F.desc("_score"), F.asc("id")).limit(size)
    # A block's lists are bounded by its rows; a row of several lists counts once.
    total = (found.groupBy("block").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("n"))
             .agg(F.coalesce(F.sum("n"), F.lit(0))).scalar())
    return (rows.join(F.broadcast(best), "id").orderBy(F.desc("_score"), F.asc("id"))
            .select(F.col("id").alias("_id"), F.lit(index).alias("_index"), "_score", total.alias("total"), source))
