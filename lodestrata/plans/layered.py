"""Queries of the lookup, precedence, merge and mutation operators."""

from pyspark.sql import functions as F

from lodestrata.operators import joins as J
from lodestrata.operators import merge as M
from lodestrata.operators import ordered as W
from lodestrata.operators.registry import PayloadParsers, ValueFunctions, default_parser, with_computed
from lodestrata.plans.base import query, spread, table, view

NOW = "2024-02-01 00:00:00"

SPECS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS configured,
'V_' || CAST(c_custkey % 50 AS STRING) AS n1, 'V_' || CAST(c_custkey % 7 AS STRING) AS n2, 'W' AS n3 FROM customer"""


@query("j5_resolve_chain", f"""WITH s AS ({SPECS}), v AS (SELECT * FROM <<variables>>),
r AS (SELECT s.*, a.value AS v1, b.value AS v2 FROM s LEFT JOIN v a ON n1 = a.key LEFT JOIN v b ON n2 = b.key)
SELECT id, coalesce(configured, v1, v2) AS value,
 CASE WHEN configured IS NOT NULL THEN 'config' WHEN v1 IS NOT NULL THEN n1 WHEN v2 IS NOT NULL THEN n2 END AS source,
 CASE WHEN configured IS NOT NULL THEN '' WHEN v1 IS NOT NULL THEN n1 WHEN v2 IS NOT NULL THEN n1 || ',' || n2
      ELSE n1 || ',' || n2 || ',' || n3 END AS tried FROM r""")
def j5(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    specs = c.select(k.alias("id"), F.when(k % 4 == 0, F.col("c_name")).alias("configured"),
                     F.array(F.concat(F.lit("V_"), k % 50), F.concat(F.lit("V_"), k % 7), F.lit("W")).alias("names"))
    out = J.resolve_chain(specs, view(spark, sf, "variables"))
    return out.select("id", "value", "source", F.array_join("tried", ",").alias("tried"))


@query("j6_resolve_precedence", """SELECT id, coalesce(username, password, email, token) AS value,
CASE WHEN username IS NOT NULL THEN 'argument' WHEN password IS NOT NULL THEN 'env' WHEN email IS NOT NULL THEN 'config'
WHEN token IS NOT NULL THEN 'default' ELSE 'none' END AS source FROM <<credentials>>""")
def j6(spark, sf):
    c = view(spark, sf, "credentials")
    out = J.resolve_precedence(c, [("argument", F.col("username")), ("env", F.col("password")),
                                   ("config", F.col("email")), ("default", F.col("token"))], none_label="none")
    return out.select("id", "value", "source")


@query("j6_resolve_proxy", """WITH p AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CASE WHEN s_suppkey % 5 = 0 THEN s_name END END AS override,
  CASE s_suppkey % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN 'http://p:1' END AS setting,
  CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'https://e' END AS env_https, CASE WHEN s_suppkey % 7 < 3 THEN 'http://e' END AS env_http, 'http://g' AS global_proxy FROM supplier)
SELECT id, CASE WHEN override <> '' THEN override WHEN setting = 'false' THEN NULL WHEN setting IS NULL THEN global_proxy
  WHEN setting = 'true' THEN CASE WHEN env_https <> '' THEN env_https ELSE nullif(env_http, '') END ELSE setting END AS proxy_url,
 CASE WHEN override <> '' THEN 'env_overwrite' WHEN setting = 'false' THEN 'disabled' WHEN setting IS NULL THEN 'global_fallback'
  WHEN setting = 'true' THEN 'env_proxy' ELSE 'provider_direct' END AS source,
 CASE WHEN coalesce(override, '') = '' AND setting = 'true' THEN CASE WHEN env_https <> '' THEN 'HTTPS_PROXY' WHEN env_http <> '' THEN 'HTTP_PROXY' END END AS env_var_used FROM p""")
def j6_proxy(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS id", "CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CASE WHEN s_suppkey % 5 = 0 THEN s_name END END AS override",
        "CASE s_suppkey % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN 'http://p:1' END AS setting",
        "CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'https://e' END AS env_https",
        "CASE WHEN s_suppkey % 7 < 3 THEN 'http://e' END AS env_http", "'http://g' AS global_proxy")
    return J.resolve_proxy(rows).select("id", "proxy_url", "source", "env_var_used")


# The rule of a deep merge, leaf by leaf, straight from its definition.
MERGED = """WITH l AS (SELECT * FROM <<layers_text>>),
kept AS (SELECT * FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.doc_id = a.doc_id AND b.layer > a.layer AND (
   b.path = a.path OR (starts_with(a.path, b.path || '.') AND b.vtype <> 'map') OR starts_with(b.path, a.path || '.')))
   AND NOT (a.vtype = 'map' AND EXISTS (SELECT 1 FROM l b WHERE b.doc_id = a.doc_id AND b.layer > a.layer AND starts_with(b.path, a.path || '.')))),
merged AS (SELECT * FROM kept a WHERE a.vtype <> 'map' OR NOT EXISTS (SELECT 1 FROM kept b WHERE b.doc_id = a.doc_id AND starts_with(b.path, a.path || '.')))
"""


def layers(spark, sf):
    """The rows of the ``layers_text`` view from one scan of the parts."""
    leaves = [("true", 0, "name", "p_name", "string"), ("true", 0, "brand", "p_brand", "string"),
              ("true", 0, "meta.type", "p_type", "string"), ("true", 0, "meta.dim.size", "CAST(p_size AS STRING)", "number"),
              ("p_partkey % 3 = 0", 1, "meta", "'flat'", "string"), ("p_partkey % 3 = 1", 1, "meta.type", "'X' || p_type", "string"),
              ("p_partkey % 5 = 0", 1, "tags", "'{}'", "map"), ("p_partkey % 4 = 0", 1, "list", "'[1,2]'", "list"),
              ("p_partkey % 2 = 0", 2, "meta.extra", "p_brand", "string"), ("p_partkey % 7 = 0", 2, "name.first", "p_name", "string"),
              ("p_partkey % 11 = 0", 2, "brand", "CAST(NULL AS STRING)", "null"), ("p_partkey % 8 = 0", 2, "list", "'[3]'", "list"),
              ("p_partkey % 13 = 0", 2, "meta", "'{}'", "map"), ("p_partkey % 10 = 0", 2, "tags.top", "p_type", "string")]
    rows = F.array_compact(F.array(*[F.when(F.expr(test), F.struct(
        F.lit(layer).alias("layer"), F.array(*[F.lit(x) for x in path.split(".")]).alias("path"),
        F.expr(value).alias("value"), F.lit(kind).alias("vtype"))) for test, layer, path, value, kind in leaves]))
    return spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), F.inline(rows))


@query("m1_deep_merge", MERGED + "SELECT doc_id, path, value, vtype, layer FROM merged")
def m1(spark, sf):
    return M.deep_merge(layers(spark, sf)).withColumn("path", F.array_join("path", "."))


@query("m11_merge_history", MERGED + """SELECT doc_id, path, value, layer,
coalesce((SELECT string_agg(b.layer || ':' || coalesce(b.value, '-'), ',' ORDER BY b.layer) FROM l b
 WHERE b.doc_id = merged.doc_id AND b.path = merged.path AND b.layer < merged.layer), '') AS hidden FROM merged""")
def m11(spark, sf):
    out = M.merge_history(layers(spark, sf))
    shown = F.transform("hidden", lambda x: F.concat(x["layer"].cast("string"), F.lit(":"), F.coalesce(x["value"], F.lit("-"))))
    return out.select("doc_id", F.array_join("path", ".").alias("path"), "value", "layer", F.array_join(shown, ",").alias("hidden"))


# Every layer of every document is an item of its own.
ITEMS = """SELECT doc_id || '/' || layer AS doc_id, 1 AS layer, path, value, vtype FROM <<layers_text>>
UNION ALL SELECT DISTINCT doc_id || '/' || l.layer, 0, CASE WHEN r_regionkey = 0 THEN 'meta.type' WHEN r_regionkey = 1 THEN 'name' ELSE 'global.' || r_name END,
 r_name, 'string' FROM <<layers_text>> l, region"""


@query("j7_with_defaults", MERGED.replace("SELECT * FROM <<layers_text>>", ITEMS) + """SELECT CAST(split_part(doc_id, '/', 1) AS BIGINT) AS doc_id,
CAST(split_part(doc_id, '/', 2) AS INT) AS of_layer, path, value, vtype, layer FROM merged""")
def j7(spark, sf):
    k = F.col("r_regionkey")
    defaults = table(spark, sf, "region").select(
        F.split(F.when(k == 0, "meta.type").when(k == 1, "name").otherwise(F.concat(F.lit("global."), "r_name")), "\\.").alias("path"),
        F.col("r_name").alias("value"), F.lit("string").alias("vtype"))
    items = layers(spark, sf).withColumnRenamed("layer", "of_layer")
    return J.with_defaults(items, defaults, ("doc_id", "of_layer")).withColumn("path", F.array_join("path", "."))


@query("j8_allowed", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j8(spark, sf):
    allow = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return J.allowed(table(spark, sf, "customer"), allow, "c_nationkey").select("c_custkey", "c_name")


@query("j8_not_allowed", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j8_not(spark, sf):
    allow = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return J.not_allowed(table(spark, sf, "customer"), allow, "c_nationkey").select("c_custkey", "c_name")


@query("j9_missing_fields", """WITH rules(type, field, pos) AS (VALUES ('basic', 'username', 1), ('basic', 'password', 2),
 ('basic_email_token', 'email', 1), ('basic_email_token', 'token', 2), ('bearer', 'token', 1), ('custom', 'token', 1), ('custom', 'header_name', 2),
 ('edgegrid', 'client_token', 1), ('edgegrid', 'client_secret', 2), ('edgegrid', 'access_token', 3), ('edgegrid', 'base_url', 4)),
c AS (SELECT * FROM <<credentials>>),
have AS (SELECT id, 'username' AS field FROM c WHERE username <> '' UNION ALL SELECT id, 'password' FROM c WHERE password <> ''
 UNION ALL SELECT id, 'email' FROM c WHERE email <> '' UNION ALL SELECT id, 'token' FROM c WHERE token <> ''),
m AS (SELECT c.id, string_agg(r.field, ',' ORDER BY r.pos) AS missing FROM c JOIN rules r ON c.type = r.type
 WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.id = c.id AND h.field = r.field) GROUP BY c.id)
SELECT c.id, c.type, coalesce(m.missing, '') AS missing FROM c LEFT JOIN m ON c.id = m.id""")
def j9(spark, sf):
    out = J.missing_fields(view(spark, sf, "credentials"))
    return out.select("id", "type", F.array_join("missing", ",").alias("missing"))


PROBES = """SELECT s_nationkey AS provider, CASE s_suppkey % 5 WHEN 0 THEN 'verify-full' WHEN 1 THEN 'verify-ca' WHEN 2 THEN 'require'
WHEN 3 THEN 'prefer' ELSE 'disable' END AS option, s_acctbal > 4000 AS success FROM supplier"""


@query("j12_recommend", f"""WITH p AS ({PROBES}), r AS (SELECT *, CASE option WHEN 'verify-full' THEN 1 WHEN 'verify-ca' THEN 2 WHEN 'require' THEN 3
WHEN 'prefer' THEN 4 ELSE 5 END AS pos FROM p)
SELECT provider, arg_min(option, pos) FILTER (success) AS recommended, count(*) FILTER (success) AS successful, count(*) AS tried FROM r GROUP BY provider""")
def j12(spark, sf):
    probes = spark.sql(PROBES.replace("FROM supplier", "FROM {s}"), s=table(spark, sf, "supplier"))
    return J.recommend(probes, ["verify-full", "verify-ca", "require", "prefer", "disable"], ["provider"])


SPANS = "WITH s AS (SELECT path, start, stop, min(fold_id) AS id, count(*) AS folds FROM <<folds>> GROUP BY path, start, stop)"


@query("j11_overlapping", SPANS + """ SELECT a.path, a.id AS outer_id, a.folds AS outer_folds, b.id AS inner_id, b.folds AS inner_folds FROM s a JOIN s b ON a.path = b.path
AND (a.start < b.start OR (a.start = b.start AND a.stop > b.stop)) AND a.start < b.stop AND a.stop > b.start
UNION ALL SELECT path, id, folds, id, folds FROM s WHERE folds > 1 AND start < stop""")
def j11(spark, sf):
    return J.overlapping(folds(spark, sf))


@query("j11_contained", SPANS + """ SELECT a.path, a.id AS outer_id, a.folds AS outer_folds, b.id AS inner_id, b.folds AS inner_folds FROM s a JOIN s b ON a.path = b.path
AND a.id <> b.id AND a.start <= b.start AND a.stop >= b.stop
UNION ALL SELECT path, id, folds, id, folds FROM s WHERE folds > 1""")
def j11_contained(spark, sf):
    return J.contained(folds(spark, sf))


@query("j11_fold_classes", "SELECT path, fold_id, min(fold_id) OVER (PARTITION BY path, start, stop) AS id FROM <<folds>>")
def j11_fold_classes(spark, sf):
    return J.fold_classes(folds(spark, sf))


def folds(spark, sf):
    return view(spark, sf, "folds").withColumnRenamed("stop", "end")


OUTER = """WITH f AS (SELECT * FROM <<folds>>),
top AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.path = a.path AND b.fold_id <> a.fold_id AND b.start <= a.start AND b.stop >= a.stop
 AND NOT (b.start = a.start AND b.stop = a.stop AND b.fold_id > a.fold_id)))
"""


@query("w5_outermost", OUTER + "SELECT path, fold_id, start, stop FROM top")
def w5(spark, sf):
    return W.outermost(folds(spark, sf)).select("path", "fold_id", "start", F.col("end").alias("stop"))


@query("w6_render_folded", OUTER + """, act AS (SELECT *, lag(stop, 1, 0) OVER (PARTITION BY path ORDER BY start) AS prev,
  '/* ' || preview || CASE WHEN line_count > 1 THEN ' (' || line_count || ' lines) */' ELSE ' */' END AS mark
  FROM top WHERE fold_type IN ('block', 'import', 'literal', 'comment', 'array', 'object')),
x AS (SELECT * FROM <<fold_files>>),
parts AS (SELECT act.path, string_agg(substring(x.content, CAST(prev + 1 AS BIGINT), CAST(start - prev AS BIGINT)) || mark, '' ORDER BY start) AS head, max(stop) AS tail, count(*) AS n
  FROM act JOIN x ON act.path = x.path GROUP BY act.path)
SELECT x.path, coalesce(head || substring(x.content, CAST(tail + 1 AS BIGINT)), x.content) AS rendered, CAST(coalesce(n, 0) AS INT) AS fold_count FROM x LEFT JOIN parts ON x.path = parts.path""")
def w6(spark, sf):
    return W.render_folded(view(spark, sf, "fold_files").select("path", "content"), folds(spark, sf)).select("path", "rendered", "fold_count")


@query("m2_select_layers", """WITH req AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 4 = 0 THEN 'c' || p_partkey || '.{APP_ENV}.yaml' ELSE 'c' || p_partkey || '.yaml' END AS file FROM part),
ex AS (SELECT 'c' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.dev.yaml' ELSE '.yaml' END AS file FROM part WHERE p_partkey % 5 <> 0
 UNION SELECT 'c' || p_partkey || '.yaml' FROM part WHERE p_partkey % 6 = 0),
r AS (SELECT ord, file, replace(file, '{APP_ENV}', 'dev') AS plain, regexp_replace(replace(file, '{APP_ENV}', 'dev'), '\\.yaml$', '.dev.yaml') AS special FROM req)
SELECT ord, r.file, coalesce(a.file, b.file) AS resolved, CASE WHEN a.file IS NULL AND b.file IS NULL THEN 'Config file not found: ' || plain END AS error
FROM r LEFT JOIN ex a ON a.file = special LEFT JOIN ex b ON b.file = plain""")
def m2(spark, sf):
    p = table(spark, sf, "part")
    req = p.selectExpr("p_partkey AS ord", "CASE WHEN p_partkey % 4 = 0 THEN 'c' || p_partkey || '.{APP_ENV}.yaml' ELSE 'c' || p_partkey || '.yaml' END AS file")
    ex = p.filter("p_partkey % 5 <> 0").selectExpr("'c' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.dev.yaml' ELSE '.yaml' END AS file").union(
        p.filter("p_partkey % 6 = 0").selectExpr("'c' || p_partkey || '.yaml'"))
    return M.select_layers(req, ex, "DEV")


@query("m3_overlay", """SELECT c_custkey AS doc_id, 'name' AS path, c_name AS value, 0 AS layer FROM customer
UNION ALL SELECT c_custkey, 'greet', 'Hi ' || c_name || '!', 1 FROM customer
UNION ALL SELECT c_custkey, 'seg.now', c_mktsegment, 1 FROM customer
UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR), 1 FROM customer""")
def m3(spark, sf):
    c = view(spark, sf, "contexts", parallel=True).withColumn("doc_id", F.col("c_custkey"))

    def leaf(path, value, kind="string"):
        return F.struct(F.array(*[F.lit(x) for x in path.split(".")]).alias("path"), value.alias("value"), F.lit(kind).alias("vtype"))

    base = c.select("doc_id", F.inline(F.array(leaf("name", F.col("c_name")), leaf("seg", F.lit("old")),
                                               leaf("overwrite_from_env.name", F.lit("NAME")))))
    over = c.select("doc_id", F.inline(F.array(leaf("greet", F.lit("Hi {{user.name}}!")), leaf("seg.now", F.lit("$.seg")),
                                               leaf("nation", F.col("c_nationkey").cast("string"), "number"))))
    out = M.overlay(base, over, c.select("doc_id", "context"))
    return out.select("doc_id", F.array_join("path", ".").alias("path"), "value", "layer")


@query("m4_merge_records", """WITH a AS (SELECT s_suppkey AS id, '1.' || s_nationkey AS version, s_name AS payload FROM supplier),
b AS (SELECT c_custkey AS id, '2.' || c_nationkey AS version, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS payload FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, coalesce(b.version, a.version) AS version, CASE WHEN b.id IS NULL THEN 'ta' ELSE 'tb' END AS created_at,
 coalesce(b.payload, a.payload) AS payload,
 CASE WHEN a.id IS NULL THEN 'k=B,z=2' WHEN b.id IS NULL THEN 'a=1,k=A' ELSE 'a=1,k=B,z=2' END AS metadata
FROM a FULL JOIN b ON a.id = b.id""")
def m4(spark, sf):
    a = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "'1.' || s_nationkey AS version", "'ta' AS created_at",
                                                "map('a', '1', 'k', 'A') AS metadata", "s_name AS payload")
    b = table(spark, sf, "customer").filter("c_custkey % 2 = 0").selectExpr(
        "c_custkey AS id", "'2.' || c_nationkey AS version", "'tb' AS created_at", "map('k', 'B', 'z', '2') AS metadata",
        "CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS payload")
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return M.merge_records(a, b, "id").withColumn("metadata", F.array_join(pairs, ","))


@query("m5_flatten_keys", """SELECT p_partkey AS id, k AS key, v AS value FROM (
SELECT p_partkey, unnest(['APP_DB_HOST', 'APP_DB_PORTS_0', 'APP_DB_PORTS_1', 'APP_CAMELKEY', 'APP_LIST_0_X', 'APP_ON']) AS k,
 unnest([p_name, '1', CAST(p_size AS VARCHAR), p_brand, p_type, 'true']) AS v FROM part)""")
def m5(spark, sf):
    docs = table(spark, sf, "part").selectExpr("p_partkey AS id", """'{"db":{"host":"' || p_name || '","ports":[1,' || p_size ||
        '],"none":null},"camelKey":"' || p_brand || '","list":[{"x":"' || p_type || '"},null],"on":true}' AS doc""")
    return M.flatten_keys(docs, "doc", "app", ["id"])


@query("m5_leaf_rows", """SELECT p_partkey AS id, k AS path, v AS value, t AS vtype FROM (
SELECT p_partkey, unnest(['db.host', 'db.ports', 'db.none', 'empty']) AS k, unnest([p_name, '[1,' || p_size || ']', NULL, '{}']) AS v,
 unnest(['string', 'list', 'null', 'map']) AS t FROM part)""")
def m5_leaves(spark, sf):
    docs = table(spark, sf, "part").selectExpr("p_partkey AS id", """'{"db":{"host":"' || p_name || '","ports":[1,' || p_size ||
        '],"none":null},"empty":{}}' AS doc""")
    return M.leaf_rows(docs, ["id"], "doc").withColumn("path", F.array_join("path", "."))


@query("m5_unparsed", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN length(p_name) + 4 ELSE 1 END AS size,
CASE WHEN p_partkey % 3 = 1 THEN 'Failed to parse JSON' ELSE 'Empty document' END AS error FROM part WHERE p_partkey % 3 <> 0""")
def m5_unparsed(spark, sf):
    docs = table(spark, sf, "part").selectExpr("p_partkey AS id", """CASE p_partkey % 3 WHEN 0 THEN '{"name":"' || p_name || '"}' WHEN 1 THEN '{"' || p_name || '":' ELSE ' ' END AS doc""")
    return M.unparsed(docs, ["id"], "doc")


CHANGES = "SELECT o_custkey AS c_custkey, max(o_orderpriority) AS c_name FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey UNION ALL SELECT -s_suppkey - 1, s_name FROM supplier"


def changes(spark, sf):
    c = table(spark, sf, "orders").filter("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_name"))
    return c.unionByName(table(spark, sf, "supplier").selectExpr("-s_suppkey - 1 AS c_custkey", "s_name AS c_name"))


@query("m6_upsert", f"""WITH n AS ({CHANGES}) SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name,
CASE WHEN n.c_custkey IS NULL THEN NULL WHEN c.c_custkey IS NULL THEN 'created' ELSE 'updated' END AS result
FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey""")
def m6(spark, sf):
    return M.upsert(table(spark, sf, "customer").select("c_custkey", "c_name"), changes(spark, sf), "c_custkey")


@query("m7_patch", f"""WITH n AS ({CHANGES}) SELECT c.c_custkey, CASE WHEN c.c_custkey % 2 = 0 THEN c.c_name ELSE coalesce(n.c_name, c.c_name) END AS c_name, c.c_mktsegment,
CASE WHEN n.c_custkey IS NOT NULL THEN '2024-02-01' END AS updated_at FROM customer c LEFT JOIN n ON c.c_custkey = n.c_custkey""")
def m7(spark, sf):
    ch = changes(spark, sf).withColumn("c_name", F.when(F.col("c_custkey") % 2 != 0, F.col("c_name")))
    out = M.patch(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ch, "c_custkey", NOW)
    return out.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd"))


@query("m8_delete_ids", f"WITH n AS ({CHANGES}) SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def m8(spark, sf):
    return M.delete_ids(table(spark, sf, "customer").select("c_custkey", "c_name"), changes(spark, sf), "c_custkey")


@query("m8_not_found", f"WITH n AS ({CHANGES}) SELECT DISTINCT c_custkey FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def m8_missing(spark, sf):
    return M.not_found(table(spark, sf, "customer"), changes(spark, sf), "c_custkey")


@query("m9_union_precedence", f"""WITH n AS ({CHANGES}) SELECT c_custkey, c_name FROM n
UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""")
def m9(spark, sf):
    return M.union_precedence(table(spark, sf, "customer").select("c_custkey", "c_name"), changes(spark, sf), ["c_custkey"])


@query("m10_merge_maps", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'accept=json,auth=' || c_name ELSE 'accept=' || c_mktsegment || ',auth=' || c_name || ',host=h' END AS headers,
CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 3 END AS n FROM customer""")
def m10(spark, sf):
    c = table(spark, sf, "customer").selectExpr(
        "c_custkey", "map('accept', 'json', 'auth', c_name) AS a",
        "CASE WHEN c_custkey % 2 <> 0 THEN map('accept', c_mktsegment, 'host', 'h') END AS b")
    merged = c.select("c_custkey", M.merge_maps("a", "b").alias("m"))
    pairs = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return merged.select("c_custkey", F.array_join(pairs, ",").alias("headers"), F.size("m").alias("n"))


@query("u1_value_functions", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'build-7' WHEN 1 THEN upper(event_type) WHEN 2 THEN 'req:' || props ELSE 'plain' END AS value FROM events""")
def u1(spark, sf):
    fns = ValueFunctions()
    fns.register_startup("build")(lambda ctx: f"build-{ctx['n']}")
    fns.register_startup("kind")(lambda ctx: "shadowed")
    fns.register_request("kind")(lambda request: F.upper(request["event_type"]))
    fns.register_request("props")(lambda request: F.concat(F.lit("req:"), request["props"]))
    e = table(spark, sf, "events").selectExpr(
        "event_id", "struct(event_type, props) AS request",
        "CASE event_id % 4 WHEN 0 THEN '{{fn:build}}' WHEN 1 THEN ' {{fn:kind}} ' WHEN 2 THEN '{{fn:props}}' ELSE 'plain' END AS value")
    return fns.apply(e, "value", "request", {"n": 7}).select("event_id", "value")


@query("u2_with_computed", "SELECT o_orderkey, round(o_totalprice * 0.1, 4) AS tax, round(o_totalprice + o_totalprice * 0.1, 4) AS gross, round((o_totalprice + o_totalprice * 0.1) / 2, 4) AS half FROM orders")
def u2(spark, sf):
    out = with_computed(table(spark, sf, "orders"), {
        "half_raw": (["gross_raw"], lambda g: g / 2),
        "gross_raw": (["o_totalprice", "tax_raw"], lambda p, t: p + t),
        "tax_raw": (["o_totalprice"], lambda p: p * 0.1)})
    return out.select("o_orderkey", F.round("tax_raw", 4).alias("tax"), F.round("gross_raw", 4).alias("gross"), F.round("half_raw", 4).alias("half"))


@query("u3_payload_parsers", """SELECT c_custkey AS scope, 'DB' AS key, 'uri' AS value, CAST(NULL AS VARCHAR) AS error FROM customer
UNION ALL SELECT c_custkey, 'DB_HOST', 'kept', NULL FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'DB_HOST', c_name, NULL FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 2
UNION ALL SELECT c_custkey, 'DB_SEG', c_mktsegment, NULL FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'DB', NULL, 'Unsupported MIME type: text/x-yaml' FROM customer WHERE c_custkey % 3 = 2""")
def u3(spark, sf):
    parsers = PayloadParsers()
    parsers.register_parser("DB")(default_parser)
    c = spread(table(spark, sf, "customer"))
    body = F.expr("""CASE c_custkey % 3 WHEN 0 THEN 'data:application/json;base64,' || base64(encode('{"host":"' || c_name || '","seg":"' || c_mktsegment || '"}', 'utf-8'))
        WHEN 1 THEN 'data:text/plain;base64,' || base64(encode('# x\nexport HOST="' || c_name || '" # c\nNOPE\n', 'utf-8')) ELSE 'data:text/x-yaml;base64,YTogMQ==' END""")
    variables = c.select(F.col("c_custkey").alias("scope"), F.lit("DB").alias("key"), body.alias("value")).unionByName(
        c.filter("c_custkey % 5 = 0").selectExpr("c_custkey AS scope", "'DB_HOST' AS key", "'kept' AS value"))
    out = parsers.parse(variables)
    return out.withColumn("value", F.when(F.col("value").startswith("data:"), "uri").otherwise(F.col("value")))
