"""Layer merges, overlays, upserts and patches over rows.

A document layer is a set of leaf rows ``(doc_id, layer, path ARRAY<STRING>,
value STRING, vtype STRING)``. ``vtype`` is ``null``, ``bool``, ``number``,
``string``, ``list`` (the whole list is one value) or ``map`` (an empty map).
"""

from __future__ import annotations

import json
import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.template import render_expr

# Ship the small helpers below with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF = T.ArrayType(T.StructType().add("path", T.ArrayType(T.StringType())).add("value", "string").add("vtype", "string"))
ENTRY = T.ArrayType(T.StructType().add("key", "string").add("value", "string"))


# --- last and first write --------------------------------------------------------

def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key. An aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(*key, "_r.*").select(*df.columns))


def first_wins(df: DataFrame, key: list[str], order: list[str], override: bool = False) -> DataFrame:
    """Every write with its status: the first per key is ``SET``, later ones ``SKIP``, with ``override`` ``OVERWRITE``.

    Without ``override`` the value that holds is that of ``SET``; with it, that of :func:`last_wins`.
    """
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    named = first.select(*[F.col(k).alias(f"_k_{k}") for k in key], "_first")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key])
    return (df.join(named, on).withColumn(
        "status", F.when(F.struct(*order) == F.col("_first"), "SET").otherwise("OVERWRITE" if override else "SKIP"))
        .select(*df.columns, "status"))


def union_precedence(low: DataFrame, high: DataFrame, key: list[str]) -> DataFrame:
    """Union of two key sets; on a shared key the row of ``high`` stays.

    Rows of one side with one key have no order of their own: the largest as JSON text stays.
    """
    tie = F.to_json(F.struct(*low.columns))
    both = low.withColumn("_ord", F.lit(0)).unionByName(high.withColumn("_ord", F.lit(1))).withColumn("_tie", tie)
    return last_wins(both, key, ["_ord", "_tie"]).drop("_ord", "_tie")


# --- leaf rows ---------------------------------------------------------------------

@F.pandas_udf(LEAF)
def _leaves(docs: pd.Series) -> pd.Series:
    def text(value):
        if isinstance(value, bool):
            return "true" if value else "false", "bool"
        if value is None:
            return None, "null"
        if isinstance(value, (int, float)):
            return json.dumps(value), "number"
        if isinstance(value, str):
            return value, "string"
        return json.dumps(value, ensure_ascii=False, separators=(",", ":")), "list"

    def walk(node, path, out):
        if isinstance(node, dict) and node:
            for k, v in node.items():
                walk(v, path + [k], out)
        elif isinstance(node, dict):
            out.append({"path": path, "value": "{}", "vtype": "map"})
        else:
            value, kind = text(node)
            out.append({"path": path, "value": value, "vtype": kind})
        return out

    def one(doc):
        try:
            return walk(json.loads(doc), [], []) if doc is not None else []
        except ValueError:
            return []

    return docs.map(one)


def leaf_rows(df: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """Leaf rows of a JSON column, any depth; a list is one leaf, bad JSON gives no row."""
    return df.select(*keys, F.inline(_leaves(F.col(json_col))))


def unparsed(df: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """Documents that ``leaf_rows`` and ``flatten_keys`` cannot read: keys, size in characters, error."""
    c = F.col(json_col)
    error = F.when(F.trim(c) == "", "Empty document").otherwise("Failed to parse JSON")
    return df.filter(c.isNotNull() & F.try_parse_json(c).isNull()).select(*keys, F.length(c).alias("size"), error.alias("error"))


def _nodes(layers: DataFrame) -> DataFrame:
    """One row per document position: its last own write, its last scalar write, the last write below it.

    Every leaf is sent to itself and to each position above it, so one shuffle
    with map-side combining gives all three.
    """
    own = F.size("_at") == F.size("path")
    sent = layers.select("*", F.posexplode("path").alias("_i", "_")).withColumn(
        "_at", F.slice("path", F.lit(1), F.col("_i") + 1))
    return (sent.groupBy("doc_id", F.col("_at").alias("path"))
            .agg(F.max_by(F.when(own, F.struct("value", "vtype")), F.when(own, F.col("layer"))).alias("_last"),
                 F.max(F.when(own, F.col("layer"))).alias("layer"),
                 F.max(F.when(own & (F.col("vtype") != "map"), F.col("layer"))).alias("_scalar"),
                 F.max(F.when(~own, F.col("layer"))).alias("_below")))


def deep_merge(layers: DataFrame) -> DataFrame:
    """Deep merge of ordered layers, kept as leaf rows with the layer each came from.

    Maps merge, scalars and lists replace. A later scalar hides an earlier
    subtree, a later map hides an earlier scalar; every leaf is tested against
    all later layers. A later empty map over a map changes nothing.
    """
    nodes = _nodes(layers)
    leaves = nodes.filter(F.col("layer").isNotNull())
    # A position that is a value in one layer and a map in another: the only places where layers clash.
    clash = (nodes.filter(F.col("_scalar").isNotNull() & F.col("_below").isNotNull())
             .select("doc_id", F.col("path").alias("_at"), F.col("_scalar").alias("_hides")))
    hidden = (leaves.select("doc_id", "path", "layer", F.posexplode("path").alias("_i", "_"))
              .filter(F.col("_i") > 0).withColumn("_at", F.slice("path", F.lit(1), F.col("_i")))
              .join(clash, ["doc_id", "_at"]).filter(F.col("_hides") > F.col("layer"))
              .select("doc_id", "path").distinct())
    map_leaf = F.col("_last.vtype") == "map"
    # A value stays unless a later layer has a map there. An empty map over a map shows only
    # where a scalar in between wiped out everything that was below it.
    stays = (F.col("_below").isNull() | (~map_leaf & (F.col("_below") <= F.col("layer")))
             | (map_leaf & (F.col("_below") < F.col("_scalar"))))
    return (leaves.filter(stays).join(hidden, ["doc_id", "path"], "left_anti")
            .select("doc_id", "path", "_last.value", "_last.vtype", "layer"))


def merge_history(layers: DataFrame) -> DataFrame:
    """Per final value: the layer that set it, and the earlier values it hid at its path.

    A layer holds a path once, so the list is at most as long as there are layers.
    """
    final = deep_merge(layers)
    writes = layers.groupBy("doc_id", "path").agg(
        F.array_sort(F.collect_set(F.struct("layer", "value"))).alias("w"))
    return final.join(writes, ["doc_id", "path"]).select(
        "doc_id", "path", "value", "layer",
        F.filter("w", lambda x: x["layer"] < F.col("layer")).alias("hidden"))


def select_layers(requested: DataFrame, existing: DataFrame, env: str) -> DataFrame:
    """File for each requested layer: ``name.{env}.ext`` if it exists, else ``name.ext``, else an error.

    ``requested`` has ord, file (may hold ``{APP_ENV}``); ``existing`` has file.
    """
    env = env.lower()
    plain = F.replace("file", F.lit("{APP_ENV}"), F.lit(env))
    stem = F.regexp_extract(plain, "^(.*?)(\\.[^./]*)?$", 1)
    ext = F.regexp_extract(plain, "^(.*?)(\\.[^./]*)?$", 2)
    asked = requested.select("ord", "file", plain.alias("_plain"),
                             F.concat(stem, F.lit(f".{env}"), ext).alias("_special"))
    have = existing.select(F.col("file").alias("_have")).distinct()
    hit = (asked.join(have.withColumnRenamed("_have", "_h1"), F.col("_special") == F.col("_h1"), "left")
           .join(have.withColumnRenamed("_have", "_h2"), F.col("_plain") == F.col("_h2"), "left"))
    return hit.select("ord", "file", F.coalesce("_h1", "_h2").alias("resolved"),
                      F.when(F.col("_h1").isNull() & F.col("_h2").isNull(), F.concat(
                          F.lit("Config file not found: "), "_plain")).alias("error"))


# Meta keys that never reach the result.
META_KEYS = ("overwrite_from_env", "fallbacks_from_env", "overwrite_from_context")


def overlay(base: DataFrame, over: DataFrame, context: DataFrame,
            meta_keys: tuple[str, ...] = META_KEYS) -> DataFrame:
    """Resolve templates in the overlay, merge it over the base, drop meta keys.

    ``base`` and ``over`` are leaf rows (doc_id, path, value, vtype); ``context``
    has doc_id and context (JSON text).
    """
    # Contexts are made of texts, which Spark takes for a few bytes: they are shuffled, not broadcast.
    filled = over.join(context.select("doc_id", "context").hint("merge"), "doc_id", "left").select(
        "doc_id", F.lit(1).alias("layer"), "path",
        F.when(F.col("vtype") == "string", render_expr("value", "context")).otherwise(F.col("value")).alias("value"),
        "vtype")
    merged = deep_merge(base.select("doc_id", F.lit(0).alias("layer"), "path", "value", "vtype").unionByName(filled))
    return merged.filter(~F.col("path")[0].isin(*meta_keys))


def merge_records(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Record merge by key: id of ``a``, header of ``b``, metadata merged, payload of ``b`` unless null.

    Columns besides the key: version, created_at, metadata (MAP), payload.
    """
    left, right = a.alias("a"), b.alias("b")
    joined = left.join(right, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    there = F.col(f"b.{key}").isNotNull()
    return joined.select(
        F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key),
        F.when(there, F.col("b.version")).otherwise(F.col("a.version")).alias("version"),
        F.when(there, F.col("b.created_at")).otherwise(F.col("a.created_at")).alias("created_at"),
        merge_maps(F.col("a.metadata"), F.col("b.metadata")).alias("metadata"),
        F.coalesce(F.col("b.payload"), F.col("a.payload")).alias("payload"))


def merge_maps(a: str | Column, b: str | Column) -> Column:
    """Merge of two map columns, the right side wins; null counts as empty."""
    left = F.col(a) if isinstance(a, str) else a
    right = F.col(b) if isinstance(b, str) else b
    none = F.from_json(F.lit("{}"), "map<string,string>")
    left, right = F.coalesce(left, none), F.coalesce(right, none)
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


@F.pandas_udf(ENTRY)
def _flat(docs: pd.Series, prefixes: pd.Series) -> pd.Series:
    def text(value):
        return ("true" if value else "false") if isinstance(value, bool) else (
            value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":")))

    def walk(node, name, out):
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, f"{name}_{k}" if name else k, out)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                if v is not None and isinstance(v, list):
                    out.append((f"{name}_{i}".upper(), text(v)))
                else:
                    walk(v, f"{name}_{i}", out)
        elif node is not None:
            out.append((name.upper(), text(node)))
        return out

    def one(doc, prefix):
        try:
            found = walk(json.loads(doc), prefix or "", []) if doc is not None else []
        except ValueError:
            return []
        return [{"key": k, "value": v} for k, v in dict(found).items()]

    return pd.Series([one(d, p) for d, p in zip(docs, prefixes)])


def flatten_keys(df: DataFrame, json_col: str, prefix: str | Column = "", keys: list[str] = ()) -> DataFrame:
    """Nested JSON to ``UPPER_SNAKE`` keys: list items by index, nulls dropped, last duplicate kept."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return df.select(*keys, F.inline(_flat(F.col(json_col), p)))


# --- mutation ---------------------------------------------------------------------

def _by_id(base: DataFrame, changes: DataFrame, id_col: str, how: str) -> DataFrame:
    return base.alias("o").join(changes.alias("n"), F.col(f"o.{id_col}") == F.col(f"n.{id_col}"), how)


def upsert(df: DataFrame, changes: DataFrame, id_col: str) -> DataFrame:
    """Put documents by id. ``result`` is ``created``, ``updated``, or null for rows left alone."""
    new, old = F.col(f"n.{id_col}").isNotNull(), F.col(f"o.{id_col}").isNotNull()
    cols = [F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in df.columns]
    return _by_id(df, changes, id_col, "full_outer").select(
        *cols, F.when(new & old, "updated").when(new, "created").alias("result"))


def patch(df: DataFrame, changes: DataFrame, id_col: str, now: str, stamp: str = "updated_at") -> DataFrame:
    """Change only the fields that are given (not null); set the time of the rows that were named."""
    given = [c for c in changes.columns if c != id_col]
    named = F.col(f"n.{id_col}").isNotNull()
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in given else F.col(f"o.{c}").alias(c)
            for c in df.columns if c != stamp]
    old = F.col(f"o.{stamp}") if stamp in df.columns else F.lit(None).cast("timestamp_ntz")
    return _by_id(df, changes, id_col, "left").select(
        *cols, F.when(named, F.lit(now).cast("timestamp_ntz")).otherwise(old).alias(stamp))


def delete_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not to be deleted."""
    return df.join(ids.select(id_col), id_col, "left_anti")


def not_found(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Ids that were to be deleted but are not there."""
    return ids.select(id_col).distinct().join(df.select(id_col), id_col, "left_anti")
