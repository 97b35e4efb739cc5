"""Code matches are found in the lexical pass, once for several operators, and members stay where the join dealt them."""

import random
import re

from pyspark.sql import functions as F

from lodestrata.operators import extract as E
from lodestrata.operators import joins as J
from lodestrata.operators import lexical as L
from lodestrata.operators import ordered as W
from lodestrata.plans import corpus

SCHEMA = "path string, language string, content string"
PY = ("# note\n@dataclass\nclass Item(Base, ABC):\n    size: int = 3\n    _x = None\n\n    @app.get('/a,b')\n    async def load(self, a: str = ')') -> int:\n"
      "        if a:\n            raise ValueError('bad')\n        return 1\n\nclass BadError(ValueError):\n    pass\n\ndef save_json(x, y=(1, 2)):\n    return 0\n")
JS = ("export class View extends Base.Widget {\n  static instance = null;\n  n: number = 1;\n  async load(a, b = {}) {\n    if (a) {\n      throw new TypeError('no');\n    }\n  }\n}\n"
      "class MyError extends Error {\n}\nconst go = async (p, [q]) => {\n};\nexport function run(x) { return x; }\n")
FILES = [("a.py", "python", PY), ("b.js", "javascript", JS), ("b.js", "javascript", JS), ("c.ts", "typescript", JS), ("d.rs", "rust", JS),
         ("e.py", None, PY), ("f.py", "python", None), ("g.py", "python", ""), (None, "python", PY)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_matches_of_the_pass_are_those_of_sparks_regex(spark):
    rng = random.Random(5)
    signs = ["\n", "\r", "\r\n", "\r\x01\n", "\x85", "\u2028", "\x01", "  ", "\t", "é", "x = 1", "  y: T = 2", "class A(B):", "def f(a, b=(1)):", "  def m(self) -> int:", "@d",
             "  go(a) {", "  static n = 1;", "}", "const K = 1;", "const f = async (a) => {", "function g(x) {", "class C extends D.E {", "if (a) {", "'", "(", ")"]
    texts = [(str(i), ("python", "javascript")[i % 2], "".join(rng.choice(signs) for _ in range(rng.randint(1, 25)))) for i in range(600)]
    files = spark.createDataFrame(texts + FILES, SCHEMA).repartition(4)
    found = L.matched(files, E.CODE)
    assert "regexp_replace" not in plan_of(E.members(files, W.outline(files)))
    shielded = spark.createDataFrame([(p, lang, None if t is None else L.shield(lang, t)[0]) for p, lang, t in texts + FILES], SCHEMA)
    hits = 0
    for name, (family, pattern, groups) in E.CODE.items():
        langs = ("python",) if family == "python" else ("javascript", "typescript")
        want = shielded.filter(F.col("language").isin(*langs)).select("path", F.inline(E.matches(pattern, groups))).drop("start", "raw")
        got = found.select("path", F.inline(name))
        assert rows_of(got) == rows_of(want), name
        hits += want.count()
    assert hits > 500


def test_simple_stretches_are_stepped_over():
    # Strings and brackets that shield nothing, next to ones that do, and depths at which stepping must stop.
    for text in ("a = f('x', (1, [2]), \"y\")\nb = ('a:b', {1: (2)})\n", "x = (((((1)))))\n", "(" * 13 + "(((1)))" + ")" * 13, "f('a'''b)''')", 'g(""")""", "")\n'):
        hidden = L.shield("python", text)[0]
        assert hidden.translate(L._BACK) == text
    assert L.shield("python", "f((((1))))")[0] == "f((((1))))"
    assert L.shield("python", "(" * 14 + "(((1)))" + ")" * 14)[0].count("(") == 16
    assert L.shield("javascript", "x({a: 1}, '/*', /[(]/);\nvar y = { b, c };\n")[1] == []
    assert [b[1:] for b in L.shield("javascript", "f(a; b); { g('}'); }\n")[1]] == [[9, 19]]


def test_operators_read_the_columns_of_one_pass(spark):
    files = spark.createDataFrame(FILES, SCHEMA).repartition(3)
    once = E.read_once(files, *dict.fromkeys((*E.CLASS_CODE, *E.FUNCTION_CODE, *E.MEMBER_CODE)), with_guards=True)
    for of in (E.classes, E.functions, E.guards, E.error_classes, W.outline, lambda f: E.members(f, W.outline(f)),
               lambda f: E.data_models(E.classes(f), E.members(f, W.outline(f)))):
        df = of(once)
        assert "MapInArrow" not in plan_of(df) and "Broadcast" not in plan_of(df)
        assert rows_of(df) == rows_of(of(files)) and df.count() > 1


def tables(spark, folder):
    spark.range(1, 41).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(id % 7 AS INT) AS p_size").write.parquet(f"{folder}/part.parquet")
    spark.range(1, 31).selectExpr("id AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "0.0D AS c_acctbal", "'s' AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_data_models_go_through_the_texts_once(spark, tmp_path):
    out = corpus.e12(spark, tables(spark, tmp_path))
    assert "MapInArrow" not in plan_of(out)
    rows = out.collect()
    assert len(rows) == 70 and {r.fields for r in rows} == {1} and sum(r.is_dataclass for r in rows) == 40


def test_capabilities_go_through_the_texts_once(spark, tmp_path):
    out = corpus.a13(spark, tables(spark, tmp_path))
    assert "MapInArrow" not in plan_of(out)
    row = out.collect()[0].asDict()
    assert row == {"models": 70, "has_dataclass": True, "has_abstract": True, "model_names": row["model_names"], "public_methods": 40 * 3 + 30 * 4,
                   "rules": 40 * 2 + 30, "exceptions": 70, "exception_names": row["exception_names"], "json_serialization": True,
                   "file_persistence": True, "has_guards": True}
    assert re.fullmatch(r"View\d+, View\d+, View\d+", row["model_names"]) and re.fullmatch(r"My\d+Error, My\d+Error", row["exception_names"])


def test_members_and_nearest_scopes_are_shuffled_once(spark):
    files = spark.createDataFrame(FILES, SCHEMA).repartition(3)
    scopes = W.outline(files)
    points = spark.createDataFrame([("a.py", 9), ("a.py", 9), ("b.js", 5), ("b.js", 1), ("x", 1), (None, 1)], "path string, line int")
    # Points and scopes are dealt to the join, and its pairs stay there.
    for df in (E.members(files, scopes), J.nearest_scope(points, scopes)):
        assert len(re.findall(r"Exchange hashpartitioning\(", plan_of(df).split("== Initial Plan ==")[0])) == 2
    assert sorted((str(r.path), r.line, r.scope_name) for r in J.nearest_scope(points, scopes).collect()) == [
        ("None", 1, None), ("a.py", 9, "load"), ("b.js", 1, "View"), ("b.js", 5, "load"), ("x", 1, None)]
    assert sorted((r.path, r.owner, r.name, r.line) for r in E.members(files, scopes).filter("path <> 'c.ts'").collect()) == [
        ("a.py", "Item", "_x", 5), ("a.py", "Item", "load", 8), ("a.py", "Item", "size", 4),
        ("b.js", "View", "instance", 2), ("b.js", "View", "load", 4), ("b.js", "View", "n", 3)]
