"""Queries of the selection, search, aggregate and key/value operators."""

from pyspark.sql import functions as F

from lodestrata.operators import aggregates as A
from lodestrata.operators import index as IX
from lodestrata.operators import keyvalue as K
from lodestrata.operators import ordered as W
from lodestrata.operators import select as P
from lodestrata.operators.merge import first_wins, last_wins
from lodestrata.plans.base import ORACLES, query, spread, table, view
from lodestrata.sources import tables as S

NOW = "2024-01-20 00:00:00"


@query("search_report", """
WITH hits AS (SELECT * FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY)
SELECT * FROM (SELECT 'top_types' AS agg, event_type AS key, count(*) AS doc_count, CAST(NULL AS DOUBLE) AS value
               FROM hits GROUP BY event_type ORDER BY doc_count DESC, key LIMIT 10)
UNION ALL SELECT 'avg_value', NULL, NULL, round(avg(value), 6) FROM hits""")
def search_report(spark, sf):
    """Boolean filter, then a terms and an avg aggregation: the flagship."""
    hits = P.bool_query(table(spark, sf, "events"), must=[F.col("event_type") != "error"],
                        filters=[P.date_from("ts", "now-7d", NOW)])
    out = A.aggregate(hits, [("terms", "event_type", "top_types", 10), ("avg", "value", "avg_value", None)])
    return out.withColumn("value", F.round("value", 6))


@query("s3_run_sql", """SELECT event_type, count(*) AS n, (SELECT count(DISTINCT event_type) FROM events WHERE value > 20) AS row_count
FROM events WHERE value > 20 GROUP BY event_type""")
def s3(spark, sf):
    return S.run_sql(spark, "SELECT event_type, count(*) AS n FROM {events} WHERE value > :low GROUP BY event_type",
                     {"low": 20}, count=True, events=table(spark, sf, "events"))


LISTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("s4_list_tables", "\nUNION ALL ".join(
    f"SELECT 'listed_{t}' AS name, true AS is_temporary, count(*) AS row_count FROM {t}" for t in LISTED))
def s4(spark, sf):
    tables = {f"listed_{t}": table(spark, sf, t) for t in LISTED}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    listed = S.list_tables(spark).filter(F.col("name").isin(*tables)).select("name", "is_temporary").distinct()
    counts = S.table_profile({n: d.select(d.columns[0]) for n, d in tables.items()}).select(F.col("table_name").alias("name"), "row_count")
    return listed.join(counts, "name")


@query("s5_table_profile", """
SELECT 'nation' AS table_name, count(*) AS row_count, CAST(sum(strlen(CAST(to_json(t) AS VARCHAR))) AS BIGINT) AS bytes,
       3 AS field_count, 'n_nationkey, n_name, n_regionkey' AS sample_fields FROM nation t
UNION ALL SELECT 'conversations', count(*), CAST(sum(strlen(CAST(to_json(t) AS VARCHAR))) AS BIGINT), 4, 'conv_id, turn, role, text' FROM conversations t
UNION ALL SELECT 'documents', count(*), CAST(sum(strlen(CAST(to_json(t) AS VARCHAR))) AS BIGINT), 5, 'doc_id, text, lang, source, n_chars' FROM documents t""")
def s5(spark, sf):
    return S.table_profile({n: table(spark, sf, n) for n in ("nation", "conversations", "documents")})


@query("p1_select_fields", """SELECT e.event_id AS "EventID", e.event_type AS "Kind", coalesce(c.c_name, 'Unassigned') AS "Owner"
FROM events e LEFT JOIN customer c ON e.user_id * 20 = c.c_custkey AND c.c_mktsegment <> 'MACHINERY'""")
def p1(spark, sf):
    owners = table(spark, sf, "customer").filter("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey"), F.struct(F.col("c_name").alias("name")).alias("owner"))
    e = table(spark, sf, "events")
    joined = e.join(owners, e["user_id"] * 20 == owners["c_custkey"], "left")
    return P.select_fields(joined, "EventID, Kind, Owner", {"Owner": "Unassigned"},
                           {"EventID": "event_id", "Kind": "event_type", "Owner": "owner.name"})


@query("p2_term", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def p2(spark, sf):
    return P.term(table(spark, sf, "orders"), "o_orderstatus", "F").select("o_orderkey", "o_orderpriority")


@query("p3_date_range", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-19 00:00:00'")
def p3(spark, sf):
    return P.date_range(table(spark, sf, "events"), "ts", "now-1d", NOW).select("event_id", "user_id")


@query("p4_bool_query", """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1-%'
AND o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY""")
def p4(spark, sf):
    return P.bool_query(table(spark, sf, "orders"), must=[F.col("o_orderstatus") == "O"],
                        filters=[F.col("o_orderpriority").startswith("1-"),
                                 P.date_from("o_orderdate", "now-30d", "1998-01-01 00:00:00")]).select("o_orderkey")


@query("p5_match", """SELECT doc_id, lang FROM documents
WHERE list_has_any(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), ['nicht', 'threea', 'eau'])""")
def p5(spark, sf):
    return P.match(spread(table(spark, sf, "documents")), "text", "Nicht, threea eau").select("doc_id", "lang")


@query("p6_search", """
WITH t AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS tok,
                  list_filter(string_split_regex(lower(source), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS stok FROM documents),
f AS (SELECT doc_id, lang, len(tok) AS dl, len(stok) AS sdl,
             len(list_filter(tok, lambda x: x = 'threea')) AS a, len(list_filter(tok, lambda x: x = 'nicht')) AS b,
             len(list_filter(tok, lambda x: x = 'src7')) AS c, len(list_filter(stok, lambda x: x = 'threea')) AS sa,
             len(list_filter(stok, lambda x: x = 'nicht')) AS sb, len(list_filter(stok, lambda x: x = 'src7')) AS sc FROM t),
s AS (SELECT count(*) FILTER (a + b + c + sa + sb + sc > 0) AS total, count(*) FILTER (dl > 0) AS n,
             avg(dl) FILTER (dl > 0) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db,
             count(*) FILTER (c > 0) AS dc, count(*) FILTER (sdl > 0) AS sn, avg(sdl) FILTER (sdl > 0) AS sav,
             count(*) FILTER (sc > 0) AS sdc FROM f),
g AS (SELECT f.*, s.*,
   CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)) ELSE 0 END
 + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)) ELSE 0 END
 + CASE WHEN c > 0 THEN ln(1 + (n - dc + 0.5) / (dc + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / av)) ELSE 0 END AS s1,
   CASE WHEN sc > 0 THEN ln(1 + (sn - sdc + 0.5) / (sdc + 0.5)) * sc * 2.2 / (sc + 1.2 * (0.25 + 0.75 * sdl / sav)) ELSE 0 END AS s2
 FROM f, s)
SELECT doc_id AS _id, 'docs' AS _index, round(greatest(s1, s2), 6) AS _score, total, lang FROM g
WHERE a + b + c + sa + sb + sc > 0 ORDER BY _score DESC, _id LIMIT 20""")
def p6(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    hits = P.search(docs, "Threea nicht SRC7", ["text", "source"], 20, "doc_id", "docs")
    return hits.select("_id", "_index", "_score", "total", F.col("_source.lang").alias("lang"))


def indexed(spark, sf):
    return IX.build_index(table(spark, sf, "documents"), "doc_id", ["text", "source"], ["lang", "source"])


@query("p5_match_indexed", ORACLES["p5_match"])
def p5_indexed(spark, sf):
    hits = IX.match_indexed(spark, indexed(spark, sf), "Nicht, threea eau", "text")
    return hits.select(F.col("id").alias("doc_id"), "lang")


@query("p6_search_indexed", ORACLES["p6_search"])
def p6_indexed(spark, sf):
    hits = IX.search_indexed(spark, indexed(spark, sf), "Threea nicht SRC7", ["text", "source"], 20, "docs")
    return hits.select("_id", "_index", "_score", "total", F.col("_source.lang").alias("lang"))


@query("p9_page_descending", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber DESC, l_partkey, l_suppkey OFFSET 41000 LIMIT 300")
def p9_descending(spark, sf):
    order = ["-l_shipdate", "l_orderkey", "-l_linenumber", "l_partkey", "l_suppkey"]
    return P.page_offset(table(spark, sf, "lineitem"), order, 41000, 300).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("p7_match_all", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def p7(spark, sf):
    return P.match_all(table(spark, sf, "part"), 25, [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", "p_name")


@query("p8_get_by_id", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (3, 77, 400, 999999999)")
def p8(spark, sf):
    return P.get_by_id(table(spark, sf, "orders"), "o_orderkey", 3, 77, 400, 999999999).select("o_orderkey", "o_totalprice")


@query("p9_page_offset", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 200 LIMIT 100")
def p9(spark, sf):
    return P.page_offset(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], 200, 100).select("o_orderkey", "o_custkey")


@query("p9_page_offset_deep", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey OFFSET 30000 LIMIT 500")
def p9_deep(spark, sf):
    cols = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return P.page_offset(table(spark, sf, "lineitem").select(*cols), cols, 30000, 500)


@query("p10_paginate", """SELECT c_custkey, 3 AS page, 20 AS page_size, (SELECT count(*) FROM customer) AS total,
CAST(ceil((SELECT count(*) FROM customer) / 20.0) AS BIGINT) AS total_pages FROM customer ORDER BY c_acctbal, c_custkey OFFSET 40 LIMIT 20""")
def p10(spark, sf):
    return P.paginate(table(spark, sf, "customer"), ["c_acctbal", "c_custkey"], 3, 20).select(
        "c_custkey", "page", "page_size", "total", "total_pages")


@query("p11_latest", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def p11(spark, sf):
    return P.latest(table(spark, sf, "orders"), "o_orderdate", 10, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("p12_match_keys", "SELECT DISTINCT p_name AS key FROM part WHERE p_name GLOB '*e?[a-n]*' ORDER BY key LIMIT 100")
def p12(spark, sf):
    return P.match_keys(table(spark, sf, "part").select(F.col("p_name").alias("key")), "key", "*e?[a-n]*")


@query("a1_terms_agg", "SELECT p_brand AS key, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a1(spark, sf):
    return A.terms_agg(table(spark, sf, "part"), "p_brand", 10)


@query("a1_terms_agg_array", """SELECT w AS key, count(*) AS doc_count FROM
(SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS w FROM documents)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def a1_array(spark, sf):
    docs = spread(table(spark, sf, "documents").select("text")).select(P.tokens("text").alias("words"))
    return A.terms_agg(docs, "words", 15)


@query("a2_avg_agg", "SELECT round(avg(o_totalprice), 4) AS value FROM orders")
def a2(spark, sf):
    return A.avg_agg(table(spark, sf, "orders"), "o_totalprice").select(F.round("value", 4).alias("value"))


@query("a3_aggregate", """
SELECT * FROM (SELECT 'brands' AS agg, p_brand AS key, count(*) AS doc_count, CAST(NULL AS DOUBLE) AS value FROM part GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'types', p_type, count(*), CAST(NULL AS DOUBLE) FROM part GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT 'avg_price', NULL, NULL, round(avg(p_retailprice), 4) FROM part""")
def a3(spark, sf):
    return A.aggregate(table(spark, sf, "part"), [("terms", "p_brand", "brands", 5), ("terms", "p_type", "types", 10),
                                                  ("avg", "p_retailprice", "avg_price", None)]).withColumn("value", F.round("value", 4))


@query("a12_distinct_first_seen", "SELECT props, min(event_id) AS first_seen FROM events GROUP BY props")
def a12(spark, sf):
    return A.distinct_first_seen(table(spark, sf, "events"), "props", "event_id")


STATUS = """CASE WHEN status_code BETWEEN 200 AND 299 THEN 'connected' WHEN status_code IN (401, 403) THEN 'unauthorized'
WHEN status_code BETWEEN 400 AND 499 THEN 'client_error' WHEN status_code >= 500 THEN 'server_error' ELSE 'error' END"""


@query("a14_status_summary", f"""SELECT provider, {STATUS} AS status, count(*) AS checks,
round(avg(latency_ms), 2) AS avg_latency_ms, round(max(latency_ms), 2) AS max_latency_ms,
round(quantile_disc(latency_ms, 0.5), 2) AS p50_latency_ms FROM <<checks>> GROUP BY 1, 2""")
def a14(spark, sf):
    return A.status_summary(view(spark, sf, "checks"))


@query("w1_last_wins", """SELECT user_id, event_type, event_id, props FROM
(SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def w1(spark, sf):
    return last_wins(table(spark, sf, "events").select("user_id", "event_type", "event_id", "props"), ["user_id", "event_type"], ["event_id"])


@query("w2_first_wins", """SELECT user_id, event_type, event_id, CASE WHEN row_number() OVER
(PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'SET' ELSE 'SKIP' END AS status FROM events""")
def w2(spark, sf):
    return first_wins(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("w2_override", """SELECT user_id, event_type, event_id, CASE WHEN row_number() OVER w = 1 THEN 'SET' ELSE 'OVERWRITE' END AS status,
last_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS holds
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)""")
def w2_override(spark, sf):
    writes, key = table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"]
    last = last_wins(writes, key, ["event_id"]).withColumnRenamed("event_id", "holds")
    return first_wins(writes, key, ["event_id"], override=True).join(last, key)


@query("w3_number_rows", """SELECT o_custkey, o_orderkey, 'FR-' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS id
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)""")
def w3(spark, sf):
    return W.number_rows(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"),
                         ["o_orderdate", "o_orderkey"], "FR", by=["o_custkey"]).select("o_custkey", "o_orderkey", "id")


@query("w3_number_rows_project", """SELECT event_id, 'VC-' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS id
FROM (SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS r FROM events)""")
def w3_all(spark, sf):
    return W.number_rows(table(spark, sf, "events").select("value", "event_id"), ["value", "event_id"], "VC").select("event_id", "id")


@query("w9_counter_series", """SELECT key, seq, CASE WHEN op = 'DECRBY' THEN -amount ELSE amount END AS delta,
CAST(sum(CASE WHEN op = 'DECRBY' THEN -amount ELSE amount END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value
FROM <<counter_log>>""")
def w9(spark, sf):
    return K.counter_series(view(spark, sf, "counter_log"))


KV_FOLD = """WITH RECURSIVE log AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn
    FROM <<string_log>> WHERE ts <= {at}),
st AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS TIMESTAMP) AS exp, false AS alive
  FROM (SELECT DISTINCT key FROM log)
  UNION ALL
  SELECT key, rn, value, exp, alive FROM (
    SELECT l.key AS key, l.rn AS rn,
      CASE WHEN l.op IN ('SET', 'SETEX') THEN l.value ELSE s.value END AS value,
      CASE WHEN l.op IN ('SET', 'SETEX') THEN CASE WHEN l.ttl IS NULL THEN NULL ELSE l.ts + to_seconds(l.ttl) END
           WHEN l.op = 'EXPIRE' AND s.alive AND (s.exp IS NULL OR s.exp > l.ts) THEN l.ts + to_seconds(l.ttl)
           WHEN l.op = 'PERSIST' AND s.alive AND (s.exp IS NULL OR s.exp > l.ts) THEN NULL ELSE s.exp END AS exp,
      CASE WHEN l.op IN ('SET', 'SETEX') THEN true WHEN l.op = 'DEL' THEN false
           ELSE s.alive AND (s.exp IS NULL OR s.exp > l.ts) END AS alive
    FROM st s JOIN log l ON s.key = l.key AND l.rn = s.rn + 1)),
fin AS (SELECT key, max_by(value, rn) AS value, arg_max_null(exp, rn) AS exp, max_by(alive, rn) AS alive FROM st GROUP BY key)
SELECT key, value, CAST(floor((epoch_us(exp) - epoch_us({at})) / 1000000) AS BIGINT) AS ttl FROM fin
WHERE alive AND (exp IS NULL OR exp > {at})"""


@query("k1_kv_state", KV_FOLD.replace("{at}", "TIMESTAMP '2024-01-20 00:00:00'"))
def k1(spark, sf):
    return K.kv_state(view(spark, sf, "string_log"), NOW)


HASH = """SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY seq DESC) AS r
FROM <<hash_log>>) WHERE r = 1 AND op = 'HSET'"""


@query("k2_hash_state", HASH)
def k2(spark, sf):
    return K.hash_state(view(spark, sf, "hash_log"))


@query("k2_hash_maps", f"""SELECT key, CAST(0 AS BIGINT) AS part, count(*) AS n_fields,
string_agg(field || '=' || value, ',' ORDER BY field) AS body FROM ({HASH}) GROUP BY key""")
def k2_maps(spark, sf):
    maps = K.hash_maps(K.hash_state(view(spark, sf, "hash_log")))
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return maps.select("key", "part", F.size("fields").cast("long").alias("n_fields"), F.array_join(pairs, ",").alias("body"))


LIST_FOLD = """WITH RECURSIVE log AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM <<list_log>>),
st AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS items FROM (SELECT DISTINCT key FROM log)
  UNION ALL
  SELECT l.key, l.rn, CASE l.op WHEN 'LPUSH' THEN list_concat([l.value], s.items) WHEN 'RPUSH' THEN list_concat(s.items, [l.value])
       WHEN 'LPOP' THEN s.items[2:] ELSE s.items[:-2] END
  FROM st s JOIN log l ON s.key = l.key AND l.rn = s.rn + 1),
fin AS (SELECT key, max_by(items, rn) AS items FROM st GROUP BY key),
rows_ AS (SELECT key, CAST(unnest(range(len(items))) AS BIGINT) AS index, unnest(items) AS value, CAST(len(items) AS BIGINT) AS length FROM fin)
"""


@query("k3_list_state", LIST_FOLD + "SELECT key, index, value, length FROM rows_")
def k3(spark, sf):
    return K.list_state(view(spark, sf, "list_log"))


@query("k3_list_range", LIST_FOLD + "SELECT key, index, value, length FROM rows_ WHERE index >= greatest(length - 3, 0) AND index <= length - 2")
def k3_range(spark, sf):
    return K.list_range(K.list_state(view(spark, sf, "list_log")), -3, -2)


@query("k4_counter_state", "SELECT key, CAST(sum(CASE WHEN op = 'DECRBY' THEN -amount ELSE amount END) AS BIGINT) AS value FROM <<counter_log>> GROUP BY key")
def k4(spark, sf):
    return K.counter_state(view(spark, sf, "counter_log"))


@query("k5_kv_stats", KV_FOLD.replace("{at}", "TIMESTAMP '2024-01-20 00:00:00'").replace(
    "SELECT key, value, CAST(floor", "SELECT count(*) AS keys, CAST(coalesce(sum(strlen(key) + strlen(value)), 0) AS BIGINT) AS bytes FROM (SELECT key, value, CAST(floor") + ")")
def k5(spark, sf):
    return K.kv_stats(K.kv_state(view(spark, sf, "string_log"), NOW))
