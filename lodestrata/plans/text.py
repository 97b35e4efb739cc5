"""Queries of the column expressions and the templates."""

from pyspark.sql import functions as F

from lodestrata.functions import template as T
from lodestrata.functions import text as X
from lodestrata.operators import paths as PA
from lodestrata.plans.base import query, spread, table, view
from lodestrata.plans.relational import STATUS

PATHS = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'pkg/node_modules/' WHEN 2 THEN 'tests/unit/' WHEN 3 THEN 'a/models/'
WHEN 4 THEN 'build/out/' ELSE 'common/lib/' END || CASE WHEN p_partkey % 10 = 9 THEN '.' ELSE '' END || replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '_test_' WHEN 1 THEN '_service_' ELSE 'api' END)
|| CASE p_partkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.TSX' WHEN 3 THEN '.cjs' WHEN 4 THEN '.rs' WHEN 5 THEN '.pyc' ELSE '' END AS path FROM """
PATHS_SQL = PATHS + "part"


def paths(spark, sf):
    return spark.sql(PATHS + "{p}", p=table(spark, sf, "part"))


@query("t1_render", """SELECT c_custkey, 'Hi ' || c_name || ' ' || c_name || ' from nowhere ' || c_mktsegment || ' {{gone}} {{raw ' || c_mktsegment || ' {{ref}} '
|| CAST(c_nationkey AS VARCHAR) || 'true ' || c_mktsegment AS rendered FROM customer""")
def t1(spark, sf):
    c = view(spark, sf, "contexts", parallel=True)
    return T.render(c, "template", "context").select("c_custkey", "rendered")


# Offsets follow from the fixed parts of the template and the length of the name.
@query("t2_placeholders", """WITH t AS (SELECT c_custkey, template AS s, length('Hi ' || c_name || ' ') AS a FROM <<contexts>>),
p AS (SELECT c_custkey, s, unnest(['{{ user.name }}', '{{city|"nowhere"}}', '{{empty|""}}', '{{gone}}', '{{raw $.seg {{ref}}', '{{nation}}', '{{flag}}', '{{ ref }}', '$.user.tags[0]', '$.seg']) AS raw,
 unnest(['user.name', 'city', 'empty', 'gone', 'raw $.seg {{ref', 'nation', 'flag', 'ref', 'user.tags[0]', 'seg']) AS path,
 unnest([NULL, 'nowhere', '', NULL, NULL, NULL, NULL, NULL, NULL, NULL]) AS "default",
 unnest(['MUSTACHE', 'MUSTACHE', 'MUSTACHE', 'MUSTACHE', 'MUSTACHE', 'MUSTACHE', 'MUSTACHE', 'MUSTACHE', 'DOT_PATH', 'DOT_PATH']) AS syntax FROM t)
SELECT c_custkey, raw, path, "default" AS default_, CAST(strpos(s, raw) - 1 AS INT) AS start_, CAST(strpos(s, raw) - 1 + length(raw) AS INT) AS end_, syntax FROM p""")
def t2(spark, sf):
    c = view(spark, sf, "contexts", parallel=True).select("c_custkey", "template")
    return T.placeholders(c, "template").select("c_custkey", "raw", "path", F.col("default").alias("default_"),
                                                F.col("start").alias("start_"), F.col("end").alias("end_"), "syntax")


@query("t3_resolve_path", """SELECT c_custkey, c_name AS dotted, c_mktsegment AS indexed, 'x' AS digit, c_mktsegment AS quoted, CAST(NULL AS VARCHAR) AS missing,
'["' || c_mktsegment || '","x"]' AS list, 'true' AS flag FROM customer""")
def t3(spark, sf):
    c = view(spark, sf, "contexts")
    return c.select("c_custkey", T.resolve_path("context", "user.name").alias("dotted"),
                    T.resolve_path("context", "user.tags[0]").alias("indexed"),
                    T.resolve_path("context", "user.tags.1").alias("digit"),
                    T.resolve_path("context", "['seg']").alias("quoted"),
                    T.resolve_path("context", "user.none.x").alias("missing"),
                    T.resolve_path("context", "user.tags").alias("list"),
                    T.resolve_path("context", "flag").alias("flag"))


def _key(sep: str, fn: str) -> str:
    one = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(s), '([a-z])([A-Z])', '\\1_\\2', 'g'), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
    return f"replace({fn}({one}), '_', '{sep}')"


@query("t4_key_name", f"WITH d AS (SELECT doc_id, text AS s FROM documents) SELECT doc_id, {_key('_', 'upper')} AS up, {_key('_', 'lower')} AS snake, {_key('-', 'lower')} AS kebab FROM d")
def t4(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", X.key_name("text", "upper").alias("up"), X.key_name("text", "snake").alias("snake"),
                    X.key_name("text", "kebab").alias("kebab"))


def _phrase(fn: str) -> str:
    return f"trim(regexp_replace({fn}(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9$\\s]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')), '\\s+', ' ', 'g'))"


@query("t5_word_case", f"SELECT doc_id, {_phrase('upper')} AS up, {_phrase('lower')} AS low FROM documents")
def t5(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.upper_case("text").alias("up"), X.lower_case("text").alias("low"))


@query("t6_to_text", """SELECT event_id, coalesce(CASE WHEN user_id % 3 <> 0 THEN event_type END, '') AS a, CASE WHEN value > 20 THEN 'true' ELSE 'false' END AS b,
'["' || event_type || '",' || CASE WHEN user_id % 2 = 0 THEN 'null' ELSE '"x"' END || ']' AS c, '{"k":"' || event_type || '"}' AS d, CAST(user_id AS VARCHAR) AS e FROM events""")
def t6(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN user_id % 3 <> 0 THEN event_type END AS a", "value > 20 AS b",
        "array(event_type, CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'x' END) AS c", "map('k', event_type) AS d", "user_id AS e")
    return e.select("event_id", *[X.to_text(e, c).alias(c) for c in "abcde"])


@query("t7_typed_reads", """WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN 'off' WHEN 3 THEN NULL WHEN 4 THEN '1'
 WHEN 5 THEN CAST(user_id AS VARCHAR) WHEN 6 THEN ' 12.5 ' ELSE event_type END AS s FROM events)
SELECT event_id, coalesce(lower(s) IN ('true', '1', 'yes', 'on'), true) AS b, coalesce(CASE WHEN regexp_matches(trim(s), '^[+-]?[0-9]+$') THEN CAST(trim(s) AS BIGINT) END, -1) AS i,
coalesce(TRY_CAST(trim(s) AS DOUBLE), 0.5) AS f FROM t""")
def t7(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "event_id", """CASE event_id % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN 'off' WHEN 3 THEN NULL WHEN 4 THEN '1'
        WHEN 5 THEN CAST(user_id AS STRING) WHEN 6 THEN ' 12.5 ' ELSE event_type END AS s""")
    return e.select("event_id", X.to_bool("s", True).alias("b"), X.to_int("s", -1).alias("i"), X.to_float("s", 0.5).alias("f"))


SECRETS = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'api_key' WHEN 1 THEN 'Name' WHEN 2 THEN 'userAuthority' WHEN 3 THEN 'note' ELSE 'DB_PASSWORD' END AS key,
CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Bearer ' || o_orderpriority WHEN 2 THEN 'eyJ' || o_orderstatus WHEN 3 THEN 'sk-' || CAST(o_custkey AS STRING) ELSE o_orderpriority || o_orderpriority || o_orderpriority END AS value FROM """


def secrets(spark, sf):
    return spark.sql(SECRETS + "{o}", o=table(spark, sf, "orders"))


@query("t8_redact", f"""WITH t AS ({SECRETS} orders) SELECT id, CASE WHEN value <> '' AND (regexp_matches(key, '(?i)KEY|SECRET|PASSWORD|TOKEN|CREDENTIAL|AUTH|PRIVATE')
OR regexp_matches(value, '^(sk-|pk-|Bearer |Basic |eyJ)')) THEN '[REDACTED]' ELSE value END AS value FROM t""")
def t8(spark, sf):
    return secrets(spark, sf).select("id", X.redact("key", "value").alias("value"))


@query("t9_masks", f"""WITH t AS ({SECRETS} orders) SELECT id, CASE WHEN value = '' THEN '<empty>' WHEN length(value) <= 10 THEN repeat('*', length(value)) ELSE left(value, 10) || repeat('*', length(value) - 10) END AS tail,
CASE WHEN value = '' THEN NULL WHEN length(value) <= 20 THEN '****' ELSE left(value, 20) || '...' END AS preview,
CASE WHEN length(value) <= 20 THEN '****' ELSE left(value, 20) || '...' END || '|' || value AS headers FROM t""")
def t9(spark, sf):
    t = secrets(spark, sf).withColumn("m", F.create_map(F.lit("X-API-Key"), "value", F.lit("accept"), "value"))
    m = X.mask_map("m")
    return t.select("id", X.mask_tail("value").alias("tail"), X.mask_preview("value").alias("preview"),
                    F.concat(m["X-API-Key"], F.lit("|"), m["accept"]).alias("headers"))


@query("t10_truncate", """SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '... (truncated)' ELSE text END AS preview,
CASE WHEN length(trim(split_part(text, chr(10), 1))) > 120 THEN left(trim(split_part(text, chr(10), 1)), 117) || '...' ELSE trim(split_part(text, chr(10), 1)) END AS scope FROM documents""")
def t10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate("text").alias("preview"), X.scope_preview("text").alias("scope"))


@query("t11_find_sensitive", f"""WITH t AS ({SECRETS} orders), v AS (
SELECT 'auth_note' AS column_name, true AS sensitive_key, count(*) FILTER (regexp_matches(value, '^(sk-|pk-|Bearer |Basic |eyJ)')) AS sensitive_values, count(value) AS "values" FROM t
UNION ALL SELECT 'label', false, count(*) FILTER (regexp_matches(key || value, '^(sk-|pk-|Bearer |Basic |eyJ)')), count(key || value) FROM t
UNION ALL SELECT 'body', false, count(*) FILTER (regexp_matches(value, '^(sk-|pk-|Bearer |Basic |eyJ)')), count(value) FROM t)
SELECT column_name, sensitive_key, sensitive_values, "values", CASE WHEN sensitive_key THEN "values" ELSE sensitive_values END AS redacted FROM v""")
def t11(spark, sf):
    t = secrets(spark, sf).selectExpr("id", "value AS auth_note", "key || value AS label", "value AS body")
    return X.find_sensitive(t)


@query("t12_status_class", f"SELECT event_id, {STATUS} AS status FROM <<checks>>")
def t12(spark, sf):
    return view(spark, sf, "checks").select("event_id", X.status_class("status_code").alias("status"))


@query("t13_error_class", """SELECT event_id, CASE WHEN lower(message) LIKE '%getaddrinfo%' OR lower(message) LIKE '%enotfound%' THEN 'DNS_ERROR'
WHEN lower(message) LIKE '%econnrefused%' THEN 'CONNECTION_REFUSED' WHEN lower(message) LIKE '%timeout%' OR lower(message) LIKE '%etimedout%' THEN 'CONNECTION_TIMEOUT'
WHEN lower(message) LIKE '%certificate%' OR lower(message) LIKE '%ssl%' OR lower(message) LIKE '%pkix%' THEN 'SSL_ERROR'
WHEN status_code = 401 THEN 'AUTH_ERROR' ELSE 'ERROR' END AS class FROM <<checks>>""")
def t13(spark, sf):
    return view(spark, sf, "checks").select("event_id", X.error_class("message", "status_code").alias("class"))


LANG = "CASE WHEN regexp_matches(lower(path), '[^/]\\.pyi?$') THEN 'python' WHEN regexp_matches(lower(path), '[^/]\\.[cm]?jsx?$') THEN 'javascript' WHEN regexp_matches(lower(path), '[^/]\\.[cm]?tsx?$') THEN 'typescript' END"


@query("t14_language_of", f"WITH t AS ({PATHS_SQL}) SELECT id, {LANG} AS language FROM t")
def t14(spark, sf):
    return paths(spark, sf).select("id", X.language_of("path").alias("language"))


@query("t15_file_role", f"""WITH t AS ({PATHS_SQL}), n AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS n FROM t)
SELECT id, CASE WHEN n LIKE '%test%' OR n LIKE '%spec%' OR path LIKE 'tests/%' THEN 'test' WHEN n LIKE '%model%' OR n LIKE '%schema%' OR n LIKE '%entity%' OR path LIKE '%/models/%' THEN 'model'
WHEN n LIKE '%controller%' OR n LIKE '%route%' OR n LIKE '%api%' THEN 'controller' WHEN n LIKE '%service%' OR n LIKE '%manager%' THEN 'service'
WHEN n LIKE '%util%' OR n LIKE '%helper%' OR path LIKE 'common/%' THEN 'utility' WHEN n LIKE '%config%' OR n LIKE '%setting%' THEN 'config' ELSE 'unknown' END AS role FROM n""")
def t15(spark, sf):
    return paths(spark, sf).select("id", X.file_role("path").alias("role"))


CONDS = """SELECT event_id, event_type AS fn, CASE event_id % 8 WHEN 0 THEN '"' || event_type || '" not in data' WHEN 1 THEN event_type || ' is None' WHEN 2 THEN 'len(' || event_type || ') < 3'
WHEN 3 THEN 'x > ' || CAST(user_id AS STRING) WHEN 4 THEN 'not isinstance(x, int)' WHEN 5 THEN 'len(x)' WHEN 6 THEN '0 < x > 3' ELSE event_type END AS cond FROM """


@query("t16_rules", f"""WITH t AS ({CONDS} events) SELECT event_id, CASE WHEN cond LIKE '%not in%' THEN 'Required field check' WHEN cond LIKE '%is None%' THEN 'Null check'
WHEN cond LIKE '%<%' OR cond LIKE '%>%' THEN 'Range/boundary validation' WHEN cond LIKE '%len(%' THEN 'Length validation' WHEN cond LIKE '%isinstance%' THEN 'Type validation' ELSE 'Validation' END || ' in ' || fn AS title,
CASE event_id % 8 WHEN 0 THEN 'Field ''' || fn || ''' is required' WHEN 1 THEN 'Value must not be null' WHEN 2 THEN 'Value must meet minimum threshold' WHEN 3 THEN 'Value must not exceed maximum threshold'
WHEN 4 THEN 'Value must be of correct type' WHEN 5 THEN 'Value must meet length requirements' ELSE 'Condition: ' || cond END AS rule FROM t""")
def t16(spark, sf):
    t = spark.sql(CONDS + "{e}", e=table(spark, sf, "events"))
    return t.select("event_id", X.rule_title("cond", "fn").alias("title"), X.rule_text("cond").alias("rule"))


@query("t16_script_rules", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Value must not be null/undefined' WHEN 1 THEN 'Value must be of type string' WHEN 2 THEN 'Required field validation'
WHEN 3 THEN 'Existence check' WHEN 4 THEN 'Content type restriction' ELSE 'Validation constraint' END AS rule FROM events""")
def t16_js(spark, sf):
    t = table(spark, sf, "events").selectExpr(
        "event_id", "CASE event_id % 6 WHEN 0 THEN event_type || ' === undefined' WHEN 1 THEN 'typeof ' || event_type || ' !== \"string\"' ELSE '!' || event_type END AS cond",
        "CASE event_id % 6 WHEN 2 THEN event_type || ' is Required' WHEN 3 THEN event_type || ' not found' WHEN 4 THEN event_type || ' cannot be empty' ELSE event_type END AS msg")
    return t.select("event_id", X.script_rule_text("cond", "msg").alias("rule"))


@query("t17_first_line_short_path", """SELECT page_id, trim(split_part(html, '>', 2)) AS second, CASE WHEN len(string_split(url, '/')) > 3 THEN array_to_string(string_split(url, '/')[-3:], '/') ELSE url END AS short FROM pages""")
def t17(spark, sf):
    p = table(spark, sf, "pages").withColumn("doc", F.replace(F.regexp_replace("html", "^[^>]*>", ""), F.lit(">"), F.lit("\n")))
    return p.select("page_id", X.first_line("doc").alias("second"), X.short_path("url").alias("short"))


@query("t18_build_url", """SELECT c_custkey, 'https://h/api/users/' || replace(c_name, '#', '%23') || '/' || replace(c_mktsegment, ' ', '%20') || '%2Ba%40x.io%20%2A~' AS url FROM customer""")
def t18(spark, sf):
    c = table(spark, sf, "customer").withColumn("mail", F.concat("c_mktsegment", F.lit("+a@x.io *~")))
    return c.select("c_custkey", X.build_url(F.lit("https://h/api//"), F.lit("/users/:username/:email"), "c_name", "mail").alias("url"))


@query("t19_parse_conn_url", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'rediss' ELSE 'redis' END AS scheme, 'h' || s_nationkey || '.io' AS host,
CASE WHEN s_suppkey % 3 <> 0 THEN CAST(6000 + s_nationkey AS INT) END AS port, CASE WHEN s_suppkey % 4 <> 0 THEN 'u' || s_suppkey END AS "user", CAST(s_suppkey % 16 AS VARCHAR) AS database,
CASE WHEN s_suppkey % 5 = 0 THEN 'ssl_cert_reqs=none' END AS query, s_suppkey % 2 = 0 AS tls FROM supplier""")
def t19(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey", """CASE WHEN s_suppkey % 2 = 0 THEN 'rediss' ELSE 'redis' END || '://' || CASE WHEN s_suppkey % 4 <> 0 THEN 'u' || s_suppkey || ':pw@' ELSE '' END
        || 'h' || s_nationkey || '.io' || CASE WHEN s_suppkey % 3 <> 0 THEN ':' || (6000 + s_nationkey) ELSE '' END || '/' || (s_suppkey % 16) || CASE WHEN s_suppkey % 5 = 0 THEN '?ssl_cert_reqs=none' ELSE '' END AS url""")
    return s.select("s_suppkey", X.parse_conn_url("url").alias("p")).select("s_suppkey", "p.*")


@query("t20_validate_records", """SELECT event_id, array_to_string(list_filter([
 CASE WHEN event_id % 7 = 0 THEN 'Missing required key: payload' END, CASE WHEN event_id % 5 = 0 THEN 'Missing required header key: version' END,
 CASE WHEN event_id % 3 = 0 THEN 'Invalid UUID format' END, CASE WHEN event_id % 4 = 0 THEN 'Invalid created_at' END], lambda x: x IS NOT NULL), ';') AS errors,
 event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 <> 0 AND event_id % 4 <> 0 AS valid FROM events""")
def t20(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "event_id", """struct(CASE WHEN event_id % 3 = 0 THEN 'nope' ELSE '0b5f1c2e-8c1d-4e7a-9b1a-' || lpad(CAST(event_id AS STRING), 12, '0') END AS id,
        CASE WHEN event_id % 5 <> 0 THEN '1.0' END AS version, CASE WHEN event_id % 4 = 0 THEN 'yesterday' ELSE CAST(ts AS STRING) END AS created_at) AS header""",
        "event_type AS metadata", "CASE WHEN event_id % 7 <> 0 THEN props END AS payload")
    return X.validate_records(e).select("event_id", F.array_join("errors", ";").alias("errors"), "valid")


@query("p13_drop_ignored", f"""WITH t AS ({PATHS_SQL}) SELECT id, path FROM t WHERE NOT regexp_matches(path, '(^|/)(node_modules|build)/') AND path NOT LIKE '%.pyc'
AND NOT (path LIKE 'common/%' AND path NOT LIKE '%.py') AND NOT (regexp_matches(path, '(^|/)[^/]*ring[^/]*$') AND NOT regexp_matches(path, '^src/[^/]*\\.js$')) AND path NOT LIKE 'tests/%'""")
def p13(spark, sf):
    rules = ["# comment", "", "common/*", "!common/lib/*.py", "*ring*", "!src/*.js", "tests/"]
    # The user glob repeats the folder rule, so that the later rules of the list stay visible.
    return PA.drop_ignored(paths(spark, sf), "path", ["tests/**"], rules)


@query("p14_keep_languages", f"WITH t AS ({PATHS_SQL}) SELECT id, path FROM t WHERE {LANG} IN ('javascript', 'typescript')")
def p14(spark, sf):
    return PA.keep_languages(paths(spark, sf), ["node"])


@query("p15_drop_tests", f"WITH t AS ({PATHS_SQL}) SELECT id, path FROM t WHERE path NOT LIKE 'tests/%' AND NOT regexp_matches(path, '(^|/)\\.[^/]*$')")
def p15(spark, sf):
    return PA.drop_tests(paths(spark, sf))


@query("p17_filter_folds", """SELECT path, fold_id FROM <<folds>> WHERE (fold_type IN ('block', 'class') AND line_count >= 4) OR (fold_type IN ('import', 'array') AND line_count >= 2)""")
def p17(spark, sf):
    return PA.filter_folds(view(spark, sf, "folds"), ("block", "class", "import", "array", "literal")).select("path", "fold_id")
