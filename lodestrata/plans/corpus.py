"""Queries over code text: extraction, scopes, folds, imports, manifests, reports.

The code files are built from the part and customer rows, so the SQL twins can
say what must come out without reading the text.
"""

from pyspark.sql import functions as F

from lodestrata.operators import aggregates as A
from lodestrata.operators import extract as E
from lodestrata.operators import joins as J
from lodestrata.operators import ordered as W
from lodestrata.operators import paths as PA
from lodestrata.operators.registry import Extractors
from lodestrata.plans.base import VIEWS, query, view
from lodestrata.session import written


def files(spark, sf):
    return view(spark, sf, "code_files", parallel=True)


def _union(source: str, columns: list[str], rows: list[tuple]) -> str:
    return "\nUNION ALL ".join(
        "SELECT path, language, " + ", ".join(f"{v} AS {c}" for c, v in zip(columns, row)) + f" FROM <<{source}>>"
        for row in rows)


# What the files hold, line by line. ``off`` is the number of lines put before the text, ``n`` the row's key.
VIEWS["x_imports"] = _union("py_files", ["line", "kind", "module", "items", "is_default", "alias"], [
    ("off + 2", "'import'", "'os'", "''", "false", "NULL"),
    ("off + 2", "'import'", "'sys'", "''", "false", "'system'"),
    ("off + 3", "'import'", "'lib_' || (n % 9) || '.core'", "''", "false", "NULL"),
    ("off + 5", "'from'", "'.local_' || (n % 4)", "'alpha,beta'", "false", "'b2'"),
    ("off + 6", "'from'", "'pkg_' || (n % 50)", "'gamma,delta'", "false", "NULL"),
]) + "\nUNION ALL " + _union("js_files", ["line", "kind", "module", "items", "is_default", "alias"], [
    ("off + 1", "'import'", "'react'", "'React,useState,useMemo'", "true", "NULL"),
    ("off + 2", "'import'", "'./util_' || (n % 5)", "'*'", "false", "'util'"),
    ("off + 3", "'side_effect'", "'side-effects'", "''", "false", "NULL"),
    ("off + 4", "'require'", "'fs'", "'readFile,join'", "false", "NULL"),
    ("off + 5", "'require'", "'lib-' || (n % 9)", "''", "true", "'ext'"),
    ("off + 6", "'reexport'", "'@scope/pkg' || (n % 3)", "'helper'", "false", "NULL"),
    ("off + 31", "'dynamic'", "'lazy-' || (n % 4)", "''", "true", "NULL")])

VIEWS["x_scopes"] = _union("py_files", ["node_type", "name", "start_line", "end_line", "depth", "preview"], [
    ("'class'", "'Item' || n", "off + 15", "off + 27", "0", "'class Item' || n || '(BaseModel, ABC):'"),
    ("'method'", "'get_instance'", "off + 20", "off + 23", "1", "'def get_instance(self, a: int, b=(' || regexp_extract(content, 'b=[(](\\d+)', 1) || ', 1), *args):'"),
    ("'if'", "NULL", "off + 21", "off + 22", "2", "'if a < ' || regexp_extract(content, 'a < (\\d+)', 1) || ':'"),
    ("'async method'", "'save_json'", "off + 25", "off + 27", "1", "'async def save_json(self):'"),
    ("'for'", "NULL", "off + 26", "off + 27", "2", "'for x in self.items:'"),
    ("'class'", "'Bad' || n || 'Error'", "off + 29", "off + 30", "0", "'class Bad' || n || 'Error(ValueError):'"),
    ("'function'", "'run_' || n", "off + 32", "off + 36", "0", "'def run_' || n || '(x: str, y: dict[str, int] = None) -> int:'"),
    ("'if'", "NULL", "off + 33", "off + 35", "1", "'if x is None:'"),
    ("'function'", "'_hidden_' || n", "off + 38", "off + 39", "0", "'def _hidden_' || n || '():'"),
]) + "\nUNION ALL " + _union("js_files", ["node_type", "name", "start_line", "end_line", "depth", "preview"], [
    ("'class'", "'View' || n", "off + 9", "off + 24", "0", "'export class View' || n || ' extends Base.Widget {'"),
    ("'constructor'", "'constructor'", "off + 12", "off + 14", "1", "'constructor(a) {'"),
    ("'method'", "'getInstance'", "off + 15", "off + 17", "1", "'static getInstance() {'"),
    ("'method'", "'loadData'", "off + 18", "off + 23", "1", "'async loadData(id, opts = {}) {'"),
    ("'if'", "NULL", "off + 19", "off + 21", "2", "'if (id === undefined) {'"),
    ("'class'", "'My' || n || 'Error'", "off + 25", "off + 26", "0", "'class My' || n || 'Error extends Error {'"),
    ("'function'", "'run' || n", "off + 27", "off + 29", "0", "'export function run' || n || '(x, ...rest) {'"),
    ("'arrow fn'", "'arrow' || n", "off + 30", "off + 32", "0", "'const arrow' || n || ' = async (p, [q], { r }) => {'")])

_CLASS_COLS = ["name", "line", "bases", "decorators", "patterns"]
VIEWS["x_classes"] = _union("py_files", _CLASS_COLS, [
    ("'Item' || n", "off + 15", "'BaseModel,ABC'", "'dataclass'", "'dataclass,singleton,abstract'"),
    ("'Bad' || n || 'Error'", "off + 29", "'ValueError'", "''", "''"),
]) + "\nUNION ALL " + _union("js_files", _CLASS_COLS, [
    ("'View' || n", "off + 9", "'Base.Widget'", "''", "'singleton'"),
    ("'My' || n || 'Error'", "off + 25", "'Error'", "''", "''")])

_FN_COLS = ["name", "line", "is_async", "params", "return_type", "decorators"]
VIEWS["x_functions"] = _union("py_files", _FN_COLS, [
    ("'get_instance'", "off + 20", "false", "'a:int:-:t|b:-:(' || regexp_extract(content, 'b=[(](\\d+)', 1) || ', 1):f|*args:-:-:f'", "NULL", "'app.get'"),
    ("'save_json'", "off + 25", "true", "''", "NULL", "''"),
    ("'run_' || n", "off + 32", "false", "'x:str:-:t|y:dict[str, int]:None:f'", "'int'", "''"),
    ("'_hidden_' || n", "off + 38", "false", "''", "NULL", "''"),
]) + "\nUNION ALL " + _union("js_files", _FN_COLS, [
    ("'run' || n", "off + 27", "false", "'x:-:-:t|...rest:-:-:f'", "NULL", "''"),
    ("'arrow' || n", "off + 30", "true", "'p:-:-:t|[...]:-:-:t|{...}:-:-:t'", "NULL", "''")])

_MEMBER_COLS = ["owner", "kind", "name", "line", "is_async", "is_static", "type", "default_"]
VIEWS["x_members"] = _union("py_files", _MEMBER_COLS, [
    ("'Item' || n", "'field'", "'size'", "off + 16", "false", "false", "'int'", "regexp_extract(content, 'a < (\\d+)', 1)"),
    ("'Item' || n", "'field'", "'_instance'", "off + 17", "false", "true", "NULL", "'None'"),
    ("'Item' || n", "'method'", "'get_instance'", "off + 20", "false", "false", "NULL", "NULL"),
    ("'Item' || n", "'method'", "'save_json'", "off + 25", "true", "false", "NULL", "NULL"),
]) + "\nUNION ALL " + _union("js_files", _MEMBER_COLS, [
    ("'View' || n", "'field'", "'instance'", "off + 10", "false", "true", "NULL", "'null'"),
    ("'View' || n", "'field'", "'count'", "off + 11", "false", "false", "'number'", "CAST(n AS STRING)"),
    ("'View' || n", "'method'", "'getInstance'", "off + 15", "false", "true", "NULL", "NULL"),
    ("'View' || n", "'method'", "'loadData'", "off + 18", "true", "false", "NULL", "NULL")])

VIEWS["x_guards"] = _union("py_files", ["line", "function", "condition", "error", "message"], [
    ("off + 21", "'get_instance'", "'a < ' || regexp_extract(content, 'a < (\\d+)', 1)", "'ValueError'", "'too small ' || regexp_extract(content, 'a < (\\d+)', 1)"),
    ("off + 33", "'run_' || n", "'x is None'", "'RuntimeError'", "'none'"),
]) + "\nUNION ALL " + _union("js_files", ["line", "function", "condition", "error", "message"], [
    ("off + 19", "'loadData'", "'id === undefined'", "'TypeError'", "'id is required'")])

STDLIB_HIT = "module IN ('os', 'sys', 'fs') OR module LIKE 'node:%'"
VIEWS["x_internal"] = """SELECT DISTINCT unnest([name, replace(name, '-', '_')]) AS name FROM (
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'app-' ELSE 'pkg-' END || s_suppkey AS name FROM supplier)"""
VIEWS["x_external"] = """SELECT 'react' AS name UNION SELECT 'core' UNION SELECT 'local' UNION SELECT 'pytest'
UNION SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'lib-' ELSE 'lib_' END || (s_suppkey % 9) FROM supplier"""
VIEWS["x_classified"] = f"""SELECT i.*, split_part(split_part(module, '/', 1), '.', 1) AS base,
CASE WHEN module LIKE '.%' THEN 'local' WHEN {STDLIB_HIT} THEN 'stdlib'
 WHEN split_part(split_part(module, '/', 1), '.', 1) IN (SELECT name FROM <<x_internal>>) OR replace(split_part(split_part(module, '/', 1), '.', 1), '-', '_') IN (SELECT name FROM <<x_internal>>) THEN 'internal'
 WHEN split_part(split_part(module, '/', 1), '.', 1) IN (SELECT name FROM <<x_external>>) THEN 'external'
 WHEN module LIKE '@%' AND module NOT LIKE '@internal%' THEN 'external' ELSE 'unknown' END AS import_type FROM <<x_imports>> i"""


def text(col):
    return F.array_join(col, ",").alias(col)


@query("e1_js_imports", "SELECT * FROM <<x_imports>> WHERE language <> 'python'")
def e1(spark, sf):
    return E.js_imports(files(spark, sf)).withColumn("items", text("items"))


@query("e2_py_imports", "SELECT * FROM <<x_imports>> WHERE language = 'python'")
def e2(spark, sf):
    return E.py_imports(files(spark, sf)).withColumn("items", text("items"))


@query("e3_classes", "SELECT path, language, name, line, bases, decorators FROM <<x_classes>>")
def e3(spark, sf):
    return E.classes(files(spark, sf)).withColumns({"bases": text("bases"), "decorators": text("decorators")})


@query("e4_functions", "SELECT path, language, name, line, is_async, return_type, decorators FROM <<x_functions>>")
def e4(spark, sf):
    return E.functions(files(spark, sf)).withColumn("decorators", text("decorators")).drop("params_text", "indent")


def scopes(spark, sf):
    return W.outline(files(spark, sf))


@query("w8_outline", "SELECT path, language, node_type, name, start_line, end_line, end_line - start_line + 1 AS line_count, depth, preview FROM <<x_scopes>>")
def w8(spark, sf):
    return scopes(spark, sf).drop("parent_type", "indent")


@query("e5_members", "SELECT path, owner, kind, name, line, is_async, is_static, type, default_ FROM <<x_members>>")
def e5(spark, sf):
    out = E.members(files(spark, sf), scopes(spark, sf))
    return out.withColumnRenamed("default", "default_").drop("params_text", "decorators")


@query("e6_constants", """SELECT path, language, 'MAX_' || regexp_extract(content, 'a < (\\d+)', 1) AS name, 'int' AS type, regexp_extract(content, 'a < (\\d+)', 1) AS value, off + 11 AS line FROM <<py_files>>
UNION ALL SELECT path, language, '__all__', NULL, '["Item' || n || '", "run_' || n || '"]', off + 12 FROM <<py_files>>
UNION ALL SELECT path, language, 'LIMIT_' || (n % 10), NULL, CAST(n AS VARCHAR), off + 8 FROM <<js_files>>""")
def e6(spark, sf):
    return E.constants(files(spark, sf))


@query("e7_exports", """SELECT path, language, unnest(['Item' || n, 'run_' || n]) AS name, off + 12 AS line FROM <<py_files>>
UNION ALL SELECT path, language, 'helper', off + 6 FROM <<js_files>> UNION ALL SELECT path, language, 'LIMIT_' || (n % 10), off + 8 FROM <<js_files>>
UNION ALL SELECT path, language, 'View' || n, off + 9 FROM <<js_files>> UNION ALL SELECT path, language, 'run' || n, off + 27 FROM <<js_files>>
UNION ALL SELECT path, language, unnest(['arrow' || n, 'LIMIT_' || (n % 10)]), off + 33 FROM <<js_files>>""")
def e7(spark, sf):
    return E.exports(files(spark, sf))


@query("e8_error_classes", "SELECT path, language, name, bases AS base, line FROM <<x_classes>> WHERE name LIKE '%Error'")
def e8(spark, sf):
    return E.error_classes(files(spark, sf))


@query("e9_guards", "SELECT * FROM <<x_guards>>")
def e9(spark, sf):
    return E.guards(files(spark, sf))


@query("e10_params", """WITH p AS (SELECT path, name AS function, line, unnest(string_split(params, '|')) AS p, unnest(range(len(string_split(params, '|')))) AS pos FROM <<x_functions>> WHERE params <> '')
SELECT path, function, line, CAST(pos AS INT) AS pos, split_part(p, ':', 1) AS name, nullif(split_part(p, ':', 2), '-') AS type, nullif(split_part(p, ':', 3), '-') AS default_,
split_part(p, ':', 4) = 't' AS required, p LIKE '*%' OR p LIKE '...%' AS rest FROM p""")
def e10(spark, sf):
    return E.params(E.functions(files(spark, sf), plain_params=False)).withColumnRenamed("default", "default_")


def patterned(spark, sf):
    f = files(spark, sf)
    return E.class_patterns(E.classes(f), E.members(f, scopes(spark, sf)))


@query("e11_class_patterns", "SELECT path, name, line, patterns FROM <<x_classes>>")
def e11(spark, sf):
    return patterned(spark, sf).select("path", "name", "line", text("patterns"))


@query("e12_data_models", """SELECT path, name, line, CAST(1 AS BIGINT) AS fields, language = 'python' AS is_dataclass, language = 'python' AS is_abstract FROM <<x_classes>> WHERE name LIKE 'Item%' OR name LIKE 'View%'""")
def e12(spark, sf):
    f = E.read_once(files(spark, sf), *E.CLASS_CODE, *E.MEMBER_CODE)
    return E.data_models(E.classes(f), E.members(f, W.outline(f)))


@query("e13_routes", "SELECT path, name, line FROM <<x_functions>> WHERE name = 'get_instance'")
def e13(spark, sf):
    return E.routes(E.functions(files(spark, sf))).select("path", "name", "line")


def formatted(spark, sf):
    return view(spark, sf, "formatted_files", parallel=True)


def _formatted(columns: list[str], py: list[tuple], js: list[tuple]) -> str:
    return _union("formatted_py", columns, py) + ("\nUNION ALL " + _union("formatted_js", columns, js) if js else "")


@query("w8_outline_formatted", _formatted(["node_type", "name", "start_line", "end_line", "depth", "parent_type", "preview"], [
    ("'class'", "'Item' || n", "8", "32", "0", "NULL", "'class Item' || n || '('"),
    ("'async method'", "'load'", "15", "32", "1", "'class'", "'async def load('"),
    ("'if'", "NULL", "21", "28", "2", "'async method'", "'if ('"),
    ("'elif'", "NULL", "29", "29", "2", "'async method'", "'elif key: raise KeyError'"),
    ("'function'", "'last'", "34", "34", "0", "NULL", "'def last(): return 1'"),
], [
    ("'class'", "'View' || n", "3", "23", "0", "NULL", "'export class View' || n"),
    ("'method'", "'load'", "6", "22", "1", "'class'", "'async load('"),
    ("'if'", "NULL", "11", "18", "2", "'method'", "'if ('"),
    ("'function'", "'last' || n", "24", "24", "0", "NULL", "'function last' || n || '(a, [b]) { return 1 }'")]))
def w8_formatted(spark, sf):
    return W.outline(formatted(spark, sf)).drop("indent", "line_count")


@query("e2_py_imports_formatted", "SELECT path, language, 5 AS line, 'os' AS module FROM <<formatted_py>>")
def e2_formatted(spark, sf):
    return E.py_imports(formatted(spark, sf)).select("path", "language", "line", "module")


@query("e4_functions_formatted", _formatted(["name", "line", "is_async", "params_text", "return_type", "decorators", "indent"], [
    ("'load'", "15", "true", "chr(10) || '        self,' || chr(10) || '        key: str = \"a,b:(c\",' || chr(10) || '        depth=' || "
     "repeat('(', 30) || size || ',' || repeat(')', 30) || ',' || chr(10) || '    '", "'dict[str, int]'", "'cached'", "4"),
    ("'last'", "34", "false", "''", "NULL", "''", "0"),
], [("'last' || n", "24", "false", "'a, [b]'", "NULL", "''", "0")]))
def e4_formatted(spark, sf):
    return E.functions(formatted(spark, sf)).withColumn("decorators", text("decorators"))


@query("e5_members_formatted", "SELECT * EXCLUDE (language) FROM (" + _formatted(["owner", "kind", "name", "line", "is_async", "type", "default_", "decorators"], [
    ("'Item' || n", "'field'", "'size'", "12", "false", "'int'", "CAST(size AS VARCHAR)", "''"),
    ("'Item' || n", "'method'", "'load'", "15", "true", "'dict[str, int]'", "NULL", "'cached'"),
], [("'View' || n", "'method'", "'load'", "6", "true", "NULL", "NULL", "''")]) + ")")
def e5_formatted(spark, sf):
    f = formatted(spark, sf)
    out = E.members(f, W.outline(f)).withColumnRenamed("default", "default_").withColumn("decorators", text("decorators"))
    return out.drop("params_text", "is_static")


@query("e9_guards_formatted", _formatted(["line", "function", "condition", "error", "message"], [
    ("21", "'load'", "'key is None and depth'", "'ValueError'", "'no key ' || size"),
    ("29", "'load'", "'key'", "'KeyError'", "NULL"),
], [("11", "'load'", "'id === undefined'", "'TypeError'", "'id ' || n"), ("18", "'load'", "'opts'", "'RangeError'", "'opts'")]))
def e9_formatted(spark, sf):
    return E.guards(formatted(spark, sf))


@query("e10_params_formatted", """SELECT path, 'load' AS function, 15 AS line, unnest([0, 1]) AS pos, unnest(['key', 'depth']) AS name, unnest(['str', NULL]) AS type,
unnest(['"a,b:(c"', repeat('(', 30) || size || ',' || repeat(')', 30)]) AS default_, false AS required, false AS rest FROM <<formatted_py>>
UNION ALL SELECT path, 'last' || n, 24, unnest([0, 1]), unnest(['a', '[...]']), NULL, NULL, true, false FROM <<formatted_js>>""")
def e10_formatted(spark, sf):
    return E.params(E.functions(formatted(spark, sf), plain_params=False)).withColumnRenamed("default", "default_")


def manifests(spark, sf):
    return E.manifests(view(spark, sf, "manifest_files"))


@query("e14_manifests", """SELECT 'packages_mjs/app-' || s_suppkey || '/package.json' AS path, s_suppkey AS manifest_ord, 'javascript' AS language, 'app-' || s_suppkey AS name, '1.' || s_nationkey || '.0' AS version, NULL AS description,
'react=^' || (s_suppkey % 4) || '.0:false:false,core=workspace:*:false:true,lib-' || (s_suppkey % 9) || '=~' || s_suppkey || ':true:false' AS deps FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'packages_py/pkg-' || s_suppkey || '/pyproject.toml', s_suppkey, 'python', 'pkg-' || s_suppkey, '2.' || s_nationkey, s_name,
'lib_' || (s_suppkey % 9) || '=^' || s_suppkey || ':false:false,local={path = "../x"}:false:true,pytest=' || (s_suppkey % 6) || ':true:false' FROM supplier WHERE s_suppkey % 2 = 1""")
def e14(spark, sf):
    shown = F.transform("deps", lambda d: F.concat(d["name"], F.lit("="), d["version"], F.lit(":"), d["is_dev"].cast("string"),
                                                  F.lit(":"), d["is_workspace"].cast("string")))
    return manifests(spark, sf).withColumn("deps", F.array_join(shown, ","))


@query("j3_internal_packages", "SELECT name FROM <<x_internal>>")
def j3(spark, sf):
    return J.internal_packages(manifests(spark, sf))


def dependencies(spark, sf):
    return manifests(spark, sf).select("manifest_ord", F.col("path").alias("manifest"), F.inline("deps"))


@query("j4_external_dependencies", """WITH d AS (
SELECT s_suppkey AS o, 'react' AS name, '^' || (s_suppkey % 4) || '.0' AS version, false AS dev FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'lib-' || (s_suppkey % 9), '~' || s_suppkey, true FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'lib_' || (s_suppkey % 9), '^' || s_suppkey, false FROM supplier WHERE s_suppkey % 2 = 1
UNION ALL SELECT s_suppkey, 'pytest', CAST(s_suppkey % 6 AS VARCHAR), true FROM supplier WHERE s_suppkey % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dev, CASE WHEN dev THEN o ELSE -o END) AS r FROM d)
SELECT name, version, dev AS is_dev, CASE WHEN o % 2 = 0 THEN 'packages_mjs/app-' || o || '/package.json' ELSE 'packages_py/pkg-' || o || '/pyproject.toml' END AS manifest,
CASE WHEN o % 2 = 0 THEN 'nodejs' ELSE 'python' END AS section FROM r WHERE r = 1""")
def j4(spark, sf):
    return J.external_dependencies(dependencies(spark, sf), by_section=True)


def classified(spark, sf):
    return J.classify_by(E.imports(files(spark, sf)), J.package_names(manifests(spark, sf)))


@query("j1_classify_imports", "SELECT path, line, module, import_type FROM <<x_classified>>")
def j1(spark, sf):
    return classified(spark, sf).select("path", "line", "module", "import_type")


@query("j2_assign_package", """WITH m AS (SELECT s_suppkey AS o, CASE WHEN s_suppkey % 2 = 0 THEN 'packages_mjs/app-' ELSE 'packages_py/pkg-' END || s_suppkey AS dir, CASE WHEN s_suppkey % 2 = 0 THEN 'app-' ELSE 'pkg-' END || s_suppkey AS name FROM supplier)
SELECT f.path, arg_min(m.name, m.o) AS package FROM <<code_files>> f LEFT JOIN m ON starts_with(f.path, m.dir) GROUP BY f.path""")
def j2(spark, sf):
    return J.assign_package(files(spark, sf).select("path"), manifests(spark, sf))


@query("p18_unknown_only", "SELECT path, line, module FROM <<x_classified>> WHERE import_type = 'unknown'")
def p18(spark, sf):
    return PA.unknown_only(classified(spark, sf)).select("path", "line", "module")


@query("p18_unknown_stats", "SELECT CAST(0 AS BIGINT) AS total_files, count(*) AS total_imports, CAST(0 AS BIGINT) AS external_imports, CAST(0 AS BIGINT) AS internal_imports, CAST(0 AS BIGINT) AS local_imports, CAST(0 AS BIGINT) AS stdlib_imports, count(*) AS unknown_imports FROM <<x_classified>> WHERE import_type = 'unknown'")
def p18_stats(spark, sf):
    return PA.unknown_stats(classified(spark, sf))


@query("p18_deps_only", """SELECT DISTINCT name, count(*) AS n, count(*) FILTER (is_dev) AS dev FROM (
SELECT 'react' AS name, false AS is_dev FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'core', false FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'lib-' || (s_suppkey % 9), true FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'lib_' || (s_suppkey % 9), false FROM supplier WHERE s_suppkey % 2 = 1
UNION ALL SELECT 'local', false FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT 'pytest', true FROM supplier WHERE s_suppkey % 2 = 1) GROUP BY name""")
def p18_deps(spark, sf):
    return PA.deps_only(dependencies(spark, sf)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_dev").alias("dev"))


_TYPES = ("external", "internal", "local", "stdlib", "unknown")
_BY_TYPE = ", ".join(f"count(*) FILTER (import_type = '{t}') AS {t}_imports" for t in _TYPES)


@query("a4_import_stats", f"""SELECT * FROM (SELECT count(*) AS total_files, count(*) FILTER (language = 'python') AS python_files, count(*) FILTER (language = 'javascript') AS javascript_files,
count(*) FILTER (language = 'typescript') AS typescript_files FROM <<code_files>>), (SELECT count(*) AS total_imports, {_BY_TYPE} FROM <<x_classified>>)""")
def a4(spark, sf):
    return A.import_stats(files(spark, sf), classified(spark, sf))


@query("a5_import_stats_by_language", f"""WITH i AS (SELECT CASE WHEN language = 'python' THEN 'python' ELSE 'nodejs' END AS section, import_type FROM <<x_classified>>),
f AS (SELECT CASE WHEN language = 'python' THEN 'python' ELSE 'nodejs' END AS section, count(*) AS total_files FROM <<code_files>> GROUP BY 1)
SELECT f.section, CAST(total_files AS BIGINT) AS total_files, count(*) AS total_imports, {_BY_TYPE} FROM f JOIN i ON f.section = i.section GROUP BY 1, 2
UNION ALL SELECT 'total', (SELECT CAST(sum(total_files) AS BIGINT) FROM f), count(*), {_BY_TYPE} FROM i""")
def a5(spark, sf):
    return A.import_stats_by_language(files(spark, sf), classified(spark, sf))


def file_rows(spark, sf):
    lines = F.size(F.split(F.rtrim("content", F.lit("\n")), "\n"))
    return files(spark, sf).select("path", "language", lines.alias("line_count"), F.lit(False).alias("has_error"))


@query("a6_outline_stats", """WITH f AS (SELECT language, 39 + off AS l, 9 AS n FROM <<py_files>> UNION ALL SELECT language, 33 + off, 8 FROM <<js_files>>)
SELECT count(*) AS total_files, CAST(sum(l) AS BIGINT) AS total_lines, CAST(sum(n) AS BIGINT) AS total_nodes, CAST(0 AS BIGINT) AS files_with_errors, count(*) FILTER (language = 'python') AS python_files,
count(*) FILTER (language = 'javascript') AS javascript_files, count(*) FILTER (language = 'typescript') AS typescript_files FROM f""")
def a6(spark, sf):
    return A.outline_stats(file_rows(spark, sf), scopes(spark, sf))


@query("a6_outline_stats_sections", """WITH f AS (SELECT 'python' AS section, 39 + off AS l, 9 AS n FROM <<py_files>> UNION ALL SELECT 'nodejs', 33 + off, 8 FROM <<js_files>>)
SELECT section, count(*) AS total_files, CAST(sum(l) AS BIGINT) AS total_lines, CAST(sum(n) AS BIGINT) AS total_nodes, CAST(0 AS BIGINT) AS files_with_errors FROM f GROUP BY section""")
def a6_sections(spark, sf):
    return A.outline_stats(file_rows(spark, sf), scopes(spark, sf), by_section=True)


_FOLDS = ", ".join(f"count(*) FILTER (fold_type = '{t}') AS {t}_folds" for t in PA.FOLD_TYPES)


@query("a7_fold_stats", f"""SELECT * FROM (SELECT count(*) AS total_files, CAST(sum(line_count) AS BIGINT) AS total_lines FROM <<fold_files>>),
(SELECT count(*) AS total_folds, CAST(sum(line_count) AS BIGINT) AS foldable_lines, {_FOLDS} FROM <<folds>>)""")
def a7(spark, sf):
    return A.fold_stats(view(spark, sf, "fold_files"), view(spark, sf, "folds"))


@query("a7_fold_stats_sections", f"""WITH f AS (SELECT CASE WHEN language = 'python' THEN 'python' ELSE 'nodejs' END AS section, count(*) AS total_files, CAST(sum(line_count) AS BIGINT) AS total_lines FROM <<fold_files>> GROUP BY 1),
d AS (SELECT CASE WHEN language = 'python' THEN 'python' ELSE 'nodejs' END AS section, count(*) AS total_folds, CAST(sum(line_count) AS BIGINT) AS foldable_lines, {_FOLDS} FROM <<folds>> GROUP BY 1)
SELECT * FROM f JOIN d USING (section)""")
def a7_sections(spark, sf):
    return A.fold_stats(view(spark, sf, "fold_files"), view(spark, sf, "folds"), by_section=True)


def items(spark, sf):
    """Definitions by kind; methods do not count as functions."""
    return E.definitions(files(spark, sf)).filter("kind <> 'functions' OR indent = 0").select("path", "kind")


@query("a8_corpus_stats", """SELECT count(DISTINCT regexp_extract(path, '^[^/]*/[^/]*')) AS packages_analyzed, count(*) AS files_analyzed, count(*) FILTER (language = 'python') AS python_files,
count(*) FILTER (language = 'javascript') AS javascript_files, count(*) FILTER (language = 'typescript') AS typescript_files, count(*) AS classes_found, 2 * count(*) AS functions_found, count(*) AS exceptions_found FROM <<code_files>>""")
def a8(spark, sf):
    f = files(spark, sf).withColumn("package", F.regexp_extract("path", "^[^/]*/[^/]*", 0))
    return A.corpus_stats(f, items(spark, sf))


@query("a9_file_summary", """SELECT path, 'classes=1,constants=2,exceptions=1,functions=2' AS summary FROM <<py_files>> UNION ALL SELECT path, 'classes=1,constants=1,exceptions=1,functions=2' FROM <<js_files>>""")
def a9(spark, sf):
    out = A.file_summary(files(spark, sf).select("path"), items(spark, sf))
    pairs = F.array_sort(F.transform(F.map_entries("summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return out.withColumn("summary", F.array_join(pairs, ","))


@query("a10_group_by_pattern", """SELECT path, name, CASE WHEN patterns = '' THEN 'classes' ELSE unnest(string_split(patterns, ',')) || '_classes' END AS section FROM <<x_classes>>""")
def a10(spark, sf):
    return A.group_by_pattern(patterned(spark, sf))


def methods(f, m):
    m = m.filter("kind = 'method'").withColumn(
        "language", F.when(F.col("path").endswith(".py"), "python").otherwise("javascript")).withColumnRenamed("type", "return_type")
    fn = E.functions(f).filter("indent = 0").withColumn("owner", F.lit(None).cast("string"))
    cols = ["path", "language", "owner", "name", "params_text", "return_type", "is_async", "line"]
    return m.select(*cols).unionByName(fn.select(*cols)).withColumn("params", E.param_array("params_text", "language"))


@query("a11_api_surface", """SELECT path, 'Item' || n AS owner, 'get_instance' AS name, off + 20 AS line, 'def get_instance(a: int, b, *args)' AS signature FROM <<py_files>>
UNION ALL SELECT path, 'Item' || n, 'save_json', off + 25, 'async def save_json()' FROM <<py_files>>
UNION ALL SELECT path, NULL, 'run_' || n, off + 32, 'def run_' || n || '(x: str, y: dict[str, int]) -> int' FROM <<py_files>>
UNION ALL SELECT path, 'View' || n, 'getInstance', off + 15, 'def getInstance()' FROM <<js_files>>
UNION ALL SELECT path, 'View' || n, 'loadData', off + 18, 'async def loadData(id, opts)' FROM <<js_files>>
UNION ALL SELECT path, NULL, 'run' || n, off + 27, 'def run' || n || '(x, ...rest)' FROM <<js_files>>
UNION ALL SELECT path, NULL, 'arrow' || n, off + 30, 'async def arrow' || n || '(p, [...], {...})' FROM <<js_files>>""")
def a11(spark, sf):
    f = files(spark, sf)
    return A.api_surface(methods(f, E.members(f, scopes(spark, sf))))


@query("a11_api_counts", """WITH m AS (SELECT 'Item' || n AS section, 2 AS k FROM <<py_files>> UNION ALL SELECT '(functions)', 1 FROM <<py_files>> UNION ALL SELECT 'View' || n, 2 FROM <<js_files>> UNION ALL SELECT '(functions)', 2 FROM <<js_files>>)
SELECT section, CAST(sum(k) AS BIGINT) AS methods FROM m GROUP BY section UNION ALL SELECT '*', CAST(sum(k) AS BIGINT) FROM m""")
def a11_counts(spark, sf):
    f = files(spark, sf)
    return A.api_counts(methods(f, E.members(f, scopes(spark, sf))))


@query("a13_capabilities", """SELECT (SELECT count(*) FROM <<code_files>>) AS models, true AS has_dataclass, true AS has_abstract,
(SELECT string_agg(name, ', ' ORDER BY path) FROM (SELECT path, name FROM <<x_classes>> WHERE name LIKE 'Item%' OR name LIKE 'View%' ORDER BY path, name LIMIT 3)) AS model_names,
(SELECT 3 * count(*) FROM <<py_files>>) + (SELECT 4 * count(*) FROM <<js_files>>) AS public_methods, (SELECT count(*) FROM <<x_guards>>) AS rules, (SELECT count(*) FROM <<code_files>>) AS exceptions,
(SELECT string_agg(name, ', ' ORDER BY path) FROM (SELECT path, name FROM <<x_classes>> WHERE name LIKE '%Error' ORDER BY path, name LIMIT 2)) AS exception_names,
true AS json_serialization, true AS file_persistence, true AS has_guards""")
def a13(spark, sf):
    # The texts, the members and the models feed several facts: gone through once, kept in the shared folder.
    f = E.read_once(files(spark, sf), *dict.fromkeys((*E.CLASS_CODE, *E.FUNCTION_CODE, *E.MEMBER_CODE)), with_guards=True)
    m = written(E.members(f, W.outline(f)), "members")
    models = written(E.data_models(E.classes(f), m), "models").withColumn("ord", F.col("path"))
    return A.capabilities(models, methods(f, m), E.guards(f), E.error_classes(f).withColumn("ord", F.col("path")))


def points(spark, sf):
    n = F.regexp_extract("path", "_(\\d+)\\.", 1).cast("long")
    return files(spark, sf).select("path", (n % 41 + 1).cast("int").alias("line"))


POINTS = "SELECT path, CAST(n % 41 + 1 AS INT) AS line FROM (SELECT path, n FROM <<py_files>> UNION ALL SELECT path, n FROM <<js_files>>)"


@query("j10_breadcrumbs", f"""WITH p AS ({POINTS}), s AS (SELECT * FROM <<x_scopes>>)
SELECT p.path, p.line, coalesce(string_agg(coalesce(s.name, s.node_type), ' > ' ORDER BY s.start_line), '') AS trail, CAST(count(s.path) AS INT) AS trail_depth
FROM p LEFT JOIN s ON p.path = s.path AND p.line BETWEEN s.start_line AND s.end_line GROUP BY p.path, p.line""")
def j10(spark, sf):
    return J.breadcrumbs(points(spark, sf), scopes(spark, sf), cell=8)


@query("w7_nearest_scope", f"""WITH p AS ({POINTS}), s AS (SELECT * FROM <<x_scopes>> WHERE name IS NOT NULL AND node_type <> 'arrow fn')
SELECT p.path, p.line, arg_max(s.name, s.start_line) AS scope_name FROM p LEFT JOIN s ON p.path = s.path AND p.line BETWEEN s.start_line AND s.end_line GROUP BY p.path, p.line""")
def w7(spark, sf):
    return J.nearest_scope(points(spark, sf), scopes(spark, sf)).select("path", "line", "scope_name")


@query("p16_filter_scopes", "SELECT path, node_type, name, depth FROM <<x_scopes>> WHERE depth BETWEEN 1 AND 2 AND node_type IN ('method', 'async method', 'constructor')")
def p16(spark, sf):
    return PA.filter_scopes(scopes(spark, sf), named=True, min_depth=1, max_depth=2, no_control_flow=True).select("path", "node_type", "name", "depth")


@query("w4_import_blocks", """SELECT path, off + 2 AS start_line, off + 9 AS end_line, CAST(4 AS BIGINT) AS import_count FROM <<py_files>> UNION ALL SELECT path, off + 1, off + 3, CAST(3 AS BIGINT) FROM <<js_files>>""")
def w4(spark, sf):
    return W.import_blocks(files(spark, sf))


@query("u4_extractors", "SELECT path, line, module FROM <<x_imports>>")
def u4(spark, sf):
    registry = Extractors()
    registry.register_extractor("python")(E.py_imports)
    registry.register_extractor("javascript", "typescript")(E.js_imports)
    return registry.extract(files(spark, sf)).select("path", "line", "module")
