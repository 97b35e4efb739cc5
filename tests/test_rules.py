"""Rules taken one by one: literal in, literal out."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import template as T
from lodestrata.functions import text as X
from lodestrata.operators import extract as E
from lodestrata.operators import joins as J
from lodestrata.operators import merge as M
from lodestrata.operators import ordered as W
from lodestrata.operators import paths as PA
from lodestrata.operators import select as P
from lodestrata.operators.registry import CircularDependencyError, ValueFunctions, with_computed
from lodestrata.sources import tables as S
from lodestrata.sources.files import scan_tree


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(fn(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, case, want", [
    ("Cat-Dog", "lower", "cat_dog"), ("Cat--Dog", "lower", "cat_dog"), ("API Key", "upper", "API_KEY"),
    ("camelCaseName", "snake", "camel_case_name"), ("camelCase", "kebab", "camel-case"), ("__x__", "snake", "x")])
def test_key_name(spark, text, case, want):
    assert one(spark, text, lambda c: X.key_name(c, case)) == want


def test_word_case(spark):
    assert one(spark, "$catDog", X.upper_case) == "$CAT DOG"
    assert one(spark, "$catDog", X.lower_case) == "$cat dog"


@pytest.mark.parametrize("code, want", [(200, "connected"), (302, "error"), (401, "unauthorized"), (403, "unauthorized"),
                                        (404, "client_error"), (500, "server_error"), (100, "error")])
def test_status_class(spark, code, want):
    assert spark.range(1).select(X.status_class(F.lit(code)).alias("r")).first()["r"] == want


def test_file_role_is_a_substring_test(spark):
    assert one(spark, "src/latest.py", X.file_role) == "test"
    assert one(spark, "src/user_model.py", X.file_role) == "model"


def test_rule_order(spark):
    assert one(spark, "len(x) < 3", lambda c: X.rule_title(c, F.lit("f"))) == "Range/boundary validation in f"
    assert one(spark, "'k' not in d", X.rule_text) == "Field 'k' is required"


CONTEXT = '{"user":{"name":"Ann","age":3,"on":true,"tags":["a","b"],"d":{"x":1}},"hop":"$.user.name","e":""}'


@pytest.mark.parametrize("template, want", [
    ("Hello {{user.name}}", "Hello Ann"), ("{{ user.name }}!", "Ann!"), ("{{gone|\"dflt\"}}", "dflt"), ("{{gone|\"\"}}|", "|"),
    ("{{gone}}", "{{gone}}"), ("$.user.tags[1] $.gone", "b $.gone"), ("{{user.tags[0]}}{{user.tags.1}}", "ab"),
    ("{{user.on}} {{user.age}}", "true 3"), ("{{hop}}", "Ann"), ("\\{{x}", "{{x}"), ("\\$.5", "$.5"), ("", ""), ("{{e}}x", "x"),
    ("{{user.d}}", '{"x":1}'), ("{{user['name']}}", "Ann")])
def test_render(spark, template, want):
    df = spark.createDataFrame([(template, CONTEXT)], "t string, c string")
    assert T.render(df, "t", "c").first()["rendered"] == want


def test_private_segments_are_refused(spark):
    df = spark.createDataFrame([("{{user._secret}}", CONTEXT)], "t string, c string")
    with pytest.raises(Exception, match="Unsafe path segment"):
        T.render(df, "t", "c").collect()
    assert T.render(df, "t", "c", on_unsafe="null").first()["rendered"] == "{{user._secret}}"


def merged(spark, *layers):
    df = spark.createDataFrame([(1, i, doc) for i, doc in enumerate(layers)], "doc_id long, layer int, j string")
    rows = M.deep_merge(M.leaf_rows(df, ["doc_id", "layer"], "j")).collect()
    return {".".join(r["path"]): r["value"] for r in rows}


@pytest.mark.parametrize("layers, want", [
    (['{"a":{"x":1}}', '{"a":5}', '{"a":{"y":2}}'], {"a.y": "2"}),
    (['{"a":{"x":1}}', '{"a":{}}'], {"a.x": "1"}),
    (['{"a":{"x":1}}', '{"a":5}', '{"a":{}}'], {"a": "{}"}),
    (['{"a":{}}', '{"a":{"x":1}}'], {"a.x": "1"}),
    (['{"a":{"b":{"c":1}}}', '{"a":{"b":7}}', '{"a":{}}'], {"a.b": "7"}),
    (['{"a":{"b":{"c":1}}}', '{"a":null}'], {"a": None}),
    (['{"l":[1,2]}', '{"l":[3]}'], {"l": "[3]"}),
    (['{"a":1}', '{"a":{"b":{}}}'], {"a.b": "{}"}),
    (['{"a":{"b":{}}}', '{"a":{}}'], {"a.b": "{}"})])
def test_deep_merge(spark, layers, want):
    assert merged(spark, *layers) == want


def test_flatten_keys(spark):
    df = spark.createDataFrame([('{"db":{"host":"h","n":null},"l":[1,{"x":2}],"ok":true}',)], "j string")
    got = {r["key"]: r["value"] for r in M.flatten_keys(df, "j", "p").collect()}
    assert got == {"P_DB_HOST": "h", "P_L_0": "1", "P_L_1_X": "2", "P_OK": "true"}


def test_empty_string_counts_in_a_chain(spark):
    specs = spark.createDataFrame([(1, None, ["A", "B"]), (2, "set", ["A"]), (3, None, ["X", "Y"])], "id long, configured string, names array<string>")
    values = spark.createDataFrame([("A", ""), ("B", "b")], "key string, value string")
    got = {r["id"]: (r["value"], r["source"], r["tried"]) for r in J.resolve_chain(specs, values).collect()}
    assert got == {1: ("", "A", ["A"]), 2: ("set", "config", []), 3: (None, None, ["X", "Y"])}


@pytest.mark.parametrize("module, language, want", [
    ("os.path", "python", "stdlib"), (".x", "python", "local"), ("my_pkg.a", "python", "internal"), ("my-pkg", "javascript", "internal"),
    ("react", "javascript", "external"), ("@scope/x", "typescript", "external"), ("@internal/x", "typescript", "internal"),
    ("node:fs", "javascript", "stdlib"), ("node:fs", "python", "unknown"), ("fs/promises", "javascript", "stdlib"), ("zzz", "python", "unknown"),
    ("tomllib", "python", "unknown"), ("distutils.core", "python", "stdlib")])
def test_classify(spark, module, language, want):
    imports = spark.createDataFrame([(module, language)], "module string, language string")
    internal = spark.createDataFrame([("my-pkg",), ("my_pkg",)], "name string")
    external = spark.createDataFrame([("react",)], "name string")
    assert J.classify_imports(imports, internal, external).first()["import_type"] == want


def test_package_prefix_has_no_separator(spark):
    files = spark.createDataFrame([("/a/pkg2/x.py",), ("/b/y.py",)], "path string")
    manifests = spark.createDataFrame([(2, "pkg2", "/a/pkg2/package.json"), (1, "pkg", "/a/pkg/package.json")], "manifest_ord int, name string, path string")
    assert {r["path"]: r["package"] for r in J.assign_package(files, manifests).collect()} == {"/a/pkg2/x.py": "pkg", "/b/y.py": None}


def test_globs():
    import re
    assert re.match(P.glob_regex("user:*:[0-9]?"), "user:a:1x") and not re.match(P.glob_regex("user:*"), "xuser:1")
    assert re.match(PA.path_glob_regex("**/node_modules/**"), "a/node_modules/b") and re.match(PA.path_glob_regex("**/*.pyc"), "x.pyc")
    assert not re.match(PA.path_glob_regex("src/*.py"), "src/a/b.py")


def test_computed_cycle_is_named(spark):
    df = spark.range(1)
    with pytest.raises(CircularDependencyError, match="a -> b -> a"):
        with_computed(df, {"a": (["b"], lambda b: b), "b": (["a"], lambda a: a)})


def test_unknown_function_stops(spark):
    df = spark.createDataFrame([("{{fn:nope}}", "r")], "v string, r string")
    with pytest.raises(Exception, match="No resolver registered"):
        ValueFunctions().apply(df, "v", "r").collect()


CODE = """import os
from a import (
    b,  # note
    c as d,
)

class A(Base):
    x: int = 1

    @property
    def f(self, *args, key: dict[str, int] = {"a": 1}):
        if key is None:
            raise ValueError('bad key')

        return 1


def g():
    pass
"""


def code(spark, text=CODE, language="python"):
    return spark.createDataFrame([("m.py" if language == "python" else "m.js", language, text)], "path string, language string, content string")


def test_python_extraction(spark):
    f = code(spark)
    imports = [(r["line"], r["module"], r["items"], r["alias"]) for r in E.imports(f).orderBy("line").collect()]
    assert imports == [(1, "os", [], None), (2, "a", ["b", "c"], "d")]
    scopes = {(r["node_type"], r["name"]): (r["start_line"], r["end_line"], r["depth"]) for r in W.outline(f).collect()}
    assert scopes == {("class", "A"): (7, 15, 0), ("method", "f"): (11, 15, 1), ("if", None): (12, 13, 2), ("function", "g"): (18, 19, 0)}
    params = [(r["name"], r["type"], r["default"], r["required"]) for r in E.params(E.functions(f).filter("name = 'f'")).orderBy("pos").collect()]
    assert params == [("*args", None, None, False), ("key", "dict[str, int]", '{"a": 1}', False)]
    guard = E.guards(f).first()
    assert (guard["line"], guard["function"], guard["condition"], guard["message"]) == (12, "f", "key is None", "bad key")
    block = W.import_blocks(f).first()
    assert (block["start_line"], block["end_line"], block["import_count"]) == (1, 5, 2)


def test_route_words_are_substrings(spark):
    f = code(spark, "@target\ndef a():\n    pass\n\n@x.other\ndef b():\n    pass\n")
    assert [r["name"] for r in E.routes(E.functions(f)).collect()] == ["a"]


def test_disabled_outer_fold_still_hides_inner(spark):
    files = spark.createDataFrame([("f", "0123456789")], "path string, content string")
    folds = spark.createDataFrame([("f", 1, 1, 8, "class", 3, "outer"), ("f", 2, 2, 5, "block", 2, "inner"), ("f", 3, 9, 10, "array", 1, "x")],
                                  "path string, fold_id long, start long, end long, fold_type string, line_count long, preview string")
    assert W.render_folded(files, folds).first()["rendered"] == "012345678/* x */"
    assert W.render_folded(files, folds, ("class", "array")).first()["rendered"] == "0/* outer (3 lines) */8/* x */"


def test_scan_tree(spark, tmp_path):
    for name, text in {"a/x.py": "import os\n", "a/node_modules/y.js": "", "a/.hidden.py": "", "b/big.ts": "x" * 200, "b/z.ts": "let a;", "b/n.txt": ""}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {(r["path"], r["language"], r["content"]) for r in scan_tree(spark, str(tmp_path), max_bytes=100).collect()}
    assert got == {("a/x.py", "python", "import os\n"), ("b/z.ts", "typescript", "let a;")}


def test_manifest_of_requirements(spark):
    df = spark.createDataFrame([("svc/requirements.txt", "# c\nfastapi[all]>=0.1  # why\nuvicorn\n-r other.txt\n")], "path string, content string")
    assert [(d["name"], d["version"]) for d in E.manifests(df).first()["deps"]] == [("fastapi", ">=0.1"), ("uvicorn", "")]


def test_jdbc_options():
    conf = S.JdbcConf("h", "db", user="u", password="p", ssl_mode="require")
    plain = S.jdbc_options(conf, "public.items")
    assert plain["url"] == "jdbc:postgresql://h:5432/db?sslmode=require" and plain["dbtable"] == "public.items"
    part = S.jdbc_options(conf, "SELECT * FROM t", ("id", 0, 100, 4))
    assert part["dbtable"] == "(SELECT * FROM t) q" and part["numPartitions"] == "4" and "query" not in part


def test_list_tables(spark):
    spark.range(1).createOrReplaceTempView("listed_here")
    assert ("listed_here", True) in {(r["name"], r["is_temporary"]) for r in S.list_tables(spark).collect()}


def test_relative_dates(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 12:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert P.date_range(df, "t", "now-1d", "2024-01-02 06:00:00").count() == 1
    assert P.date_range(df, "t", "2024-01-01", "2024-01-02 06:00:00").count() == 2


def test_equal_folds_are_pairs(spark):
    from lodestrata.operators import joins
    folds = spark.createDataFrame([("f", 1, 0, 9), ("f", 2, 0, 9), ("f", 3, 2, 4), ("f", 4, 5, 5), ("f", 5, 5, 5)],
                                  "path string, fold_id long, start long, end long")
    pairs = lambda df: sorted((r.outer_id, r.outer_folds, r.inner_id, r.inner_folds) for r in df.collect())
    assert pairs(joins.overlapping(folds)) == [(1, 2, 1, 2), (1, 2, 3, 1), (1, 2, 4, 2)]
    assert pairs(joins.contained(folds)) == [(1, 2, 1, 2), (1, 2, 3, 1), (1, 2, 4, 2), (4, 2, 4, 2)]
    assert {(r.fold_id, r.id) for r in joins.fold_classes(folds).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)}
