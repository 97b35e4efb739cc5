"""Property files, source trees, reports."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import EXTENSIONS, base_name, language_of
from lodestrata.operators.paths import ignored
from lodestrata.operators.sized import small
from lodestrata.sources.payloads import PROPERTY_LINE, property_entries

# Fixed value: files above this size are not scanned.
MAX_FILE_BYTES = 10 * 1024 * 1024
#: Listing tasks per core; changes the work, not the result.
LISTING_TASKS = 4
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks a core. Spark's default is up to 10,000, one per folder where they are many small ones."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), LISTING_TASKS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def _property_files(spark: SparkSession, location: str, pattern: str) -> DataFrame:
    """file, text (null where it is not UTF-8)."""
    with _listing(spark):
        texts = spark.read.option("pathGlobFilter", pattern).text(location, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("file"), F.try_validate_utf8("value").alias("text"))


def read_properties(spark: SparkSession, location: str, pattern: str = "*.env*") -> DataFrame:
    """Variables of all property files: file, line_ord, key, value; files sort by path.

    Spark lists no file whose name starts with a dot or an underscore, so ``.env`` itself needs another name (``app.env``).
    A key set twice in one file keeps its last value; what cannot be read is in :func:`property_errors`.
    """
    rows = _property_files(spark, location, pattern).select("file", F.posexplode(property_entries("text")).alias("line_ord", "e"))
    return (rows.select("file", "line_ord", "e.key", "e.value").groupBy("file", "key")
            .agg(F.max_by(F.struct("line_ord", "value"), F.col("line_ord")).alias("r"))
            .select("file", "r.line_ord", "key", "r.value"))


def property_errors(spark: SparkSession, location: str, pattern: str = "*.env*") -> DataFrame:
    """What property files hold that is no variable: file, line (null: the whole file), text, error."""
    bad = F.filter(F.transform(F.split("text", "\r?\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))),
                   lambda x: ~x["text"].rlike(PROPERTY_LINE) & ~x["text"].rlike("^\\s*(#|$)"))
    error = F.when(F.col("x.text").contains("="), "Invalid key").otherwise("No value")
    whole = F.array(F.struct(F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text")))
    rows = _property_files(spark, location, pattern).select("file", F.col("text").isNull().alias("unread"), F.explode(F.coalesce(bad, whole)).alias("x"))
    return rows.select("file", "x.line", "x.text", F.when(F.col("unread"), "Not UTF-8").otherwise(error).alias("error"))


def properties_summary(variables: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The load result, one row: files with variables, variables, distinct keys, and bad lines and unreadable files."""
    columns = ["file", "key", "line", "error"]
    none = F.lit(None).cast("string")
    rows = variables.select("file", "key", F.lit(None).cast("int").alias("line"), none.alias("error"))
    if errors is not None:
        rows = rows.unionByName(errors.select("file", none.alias("key"), "line", "error"))
    good, bad = F.col("key").isNotNull(), F.col("error").isNotNull()
    return rows.select(*columns).agg(
        F.countDistinct(F.when(good, F.col("file"))).alias("files"), F.count_if(good).alias("variables"), F.countDistinct("key").alias("keys"),
        F.count_if(bad & F.col("line").isNotNull()).alias("bad_lines"), F.count_if(bad & F.col("line").isNull()).alias("unread_files"))


def scan_all(spark: SparkSession, root: str, languages: tuple[str, ...] = ("python", "javascript", "typescript"),
             ignore: list[str] = (), gitignore: list[str] = (), max_bytes: int = MAX_FILE_BYTES,
             extra_names: tuple[str, ...] = ()) -> DataFrame:
    """Source files below a folder: path (relative), language, size, content, error.

    Name patterns, size and path tests are all on file metadata, so they are applied to the file listing: a
    file that is left out is never opened, and neither is one that is too large, which gives a row with an
    error and no content. So does a file that is not UTF-8. ``extra_names`` lets manifests through (``package.json``).
    """
    extensions = [e for lang in languages for e in EXTENSIONS[lang]]
    names = [f"*.{e}" for e in extensions] + list(extra_names)
    with _listing(spark):
        raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "{" + ",".join(names) + "}").load(root))
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    relative = F.regexp_replace(full, "^.*?" + _quoted(base) + "/", "")
    kept = raw.filter(~base_name(relative).startswith(".") & ~ignored(relative, list(ignore), list(gitignore)))
    fits = F.col("_metadata.file_size") <= max_bytes
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = kept.filter(fits).select(relative.alias("path"), language_of(relative).alias("language"), F.col("length").alias("size"),
                                    text.alias("content")).withColumn("error", F.when(F.col("content").isNull(), "Not UTF-8"))
    large = kept.filter(~fits).select(relative.alias("path"), language_of(relative).alias("language"), F.col("_metadata.file_size").alias("size"),
                                      F.lit(None).cast("string").alias("content"), F.lit(f"Larger than {max_bytes} bytes").alias("error"))
    return read.unionByName(large)


def scan_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files of :func:`scan_all` that could be read: path, language, size, content."""
    return scan_all(spark, root, **options).filter("error IS NULL").drop("error")


def scan_errors(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files of :func:`scan_all` that could not: path, language, size, error."""
    return scan_all(spark, root, **options).filter("error IS NOT NULL").drop("content")


def _quoted(text: str) -> str:
    import re
    return re.escape(text)


def report_rows(df: DataFrame, grouped: bool = True, section: str = "section", rows_per_part: int = 10_000) -> DataFrame:
    """Report rows as JSON text: one row per record, or one document per section part.

    A section of any size comes in parts of about ``rows_per_part`` records, cut
    by a hash of the row, so no task holds a whole section.
    """
    body = F.struct(*[c for c in df.columns if c != section])
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    if not grouped:
        return df.select(F.to_json(F.struct(*df.columns)).alias("record"))
    sizes = df.groupBy(section).agg(F.ceil(F.count(F.lit(1)) / rows_per_part).alias("_parts"))
    return (df.join(small(sizes), section).withColumn("part", F.pmod(F.xxhash64(*hashed), F.col("_parts")))
            .groupBy(section, "part").agg(F.array_sort(F.collect_list(body)).alias("files"))
            .select(section, "part", F.size("files").alias("records"), F.to_json(F.struct("files")).alias("document")))


def write_report(df: DataFrame, path: str, grouped: bool = True, **options) -> None:
    """Write a report as JSON lines, one folder per section when grouped."""
    rows = report_rows(df, grouped, **options)
    if grouped:
        rows.write.mode("overwrite").partitionBy(options.get("section", "section")).json(path)
    else:
        rows.write.mode("overwrite").text(path)
