"""Data-URI payloads, paged API envelopes, keyed JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.merge import _flat

# The URI form and the MIME type of each readable format.
DATA_URI = "^data:([^;]+);base64,([\\s\\S]+)$"
FORMATS = {"application/json": "json", "text/x-properties": "properties", "text/plain": "properties"}
PROPERTY_LINE = "^\\s*(?:export\\s+)?([A-Za-z_][A-Za-z0-9_.]*)\\s*=\\s*(.*?)\\s*$"


def property_entries(text: str | Column) -> Column:
    """``KEY=value`` lines of a text as ARRAY<STRUCT<key,value>>; quotes and comments removed."""
    c = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.split(c, "\r?\n"), lambda x: x.rlike(PROPERTY_LINE) & ~x.rlike("^\\s*#"))
    return F.transform(lines, lambda x: F.struct(
        F.regexp_extract(x, PROPERTY_LINE, 1).alias("key"), _unquote(F.regexp_extract(x, PROPERTY_LINE, 2)).alias("value")))


def _unquote(value: Column) -> Column:
    quoted = "^(['\"])(.*)\\1(?:\\s+#.*)?$"
    return F.when(value.rlike(quoted), F.regexp_extract(value, quoted, 2)).otherwise(
        F.rtrim(F.regexp_replace(value, "(^|\\s+)#.*$", "")))


def payload_entries(col: str | Column) -> Column:
    """STRUCT<mime,format,content,entries,error> of a ``data:<mime>;base64,<body>`` column.

    JSON is flattened to key/value entries, properties are read line by line;
    anything else gives an error, never a failed job.
    """
    c = F.col(col) if isinstance(col, str) else col
    mime = F.nullif(F.regexp_extract(c, DATA_URI, 1), F.lit(""))
    raw = F.try_to_binary(F.regexp_extract(c, DATA_URI, 2), F.lit("base64"))
    content = F.try_validate_utf8(raw.cast("string"))
    kind = F.lit(None).cast("string")
    for name, fmt in FORMATS.items():
        kind = F.when(mime == name, fmt).otherwise(kind)
    bad_json = (kind == "json") & F.try_parse_json(content).isNull()
    error = (F.when(mime.isNull(), "Invalid base64 data URI format")
             .when(content.isNull(), "Failed to decode base64")
             .when(kind.isNull(), F.concat(F.lit("Unsupported MIME type: "), mime))
             .when(bad_json, "Failed to parse JSON"))
    entries = F.when(kind == "json", _flat(F.when(kind == "json", content), F.lit(""))).when(
        kind == "properties", property_entries(content))
    return F.struct(mime.alias("mime"), kind.alias("format"), F.when(error.isNull(), content).alias("content"),
                    F.when(error.isNull(), entries).alias("entries"), error.alias("error"))


def decode_payloads(df: DataFrame, col: str) -> DataFrame:
    """Add mime, format, content, entries and error of a payload column."""
    return df.withColumn("_p", payload_entries(col)).select(*df.columns, "_p.*")


def unwrap_results(df: DataFrame, json_col: str, items_path: str, total_path: str, item_schema: str) -> DataFrame:
    """One row per item inside an API envelope, with ``total``; no items gives one row of nulls."""
    keep = [c for c in df.columns if c != json_col]
    items = F.from_json(F.coalesce(F.get_json_object(json_col, items_path), F.lit("[]")), f"array<struct<{item_schema}>>")
    total = F.coalesce(F.get_json_object(json_col, total_path).try_cast("long"), F.lit(0).cast("long"))
    return df.select(*keep, total.alias("total"), items.alias("_items")).select(*keep, "total", F.inline_outer("_items"))


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, whole_files: bool = True) -> DataFrame:
    """``{id: record}`` documents to one row per id: key and the record's fields.

    With ``whole_files=False`` every line is a document of its own, so a large
    input splits across tasks.
    """
    text = spark.read.text(path, wholetext=whole_files)
    return explode_keyed(text, "value", value_schema)


def explode_keyed(df: DataFrame, json_col: str, value_schema: str) -> DataFrame:
    docs = df.select(F.from_json(json_col, f"map<string,struct<{value_schema}>>").alias("_m"))
    return docs.select(F.explode("_m").alias("key", "_v")).select("key", "_v.*")
