"""The lexical pass: what is shielded, scopes over several lines, guards, awkward and broken text."""

import random

import pytest

from lodestrata.operators import extract as E
from lodestrata.operators import lexical as L
from lodestrata.operators import ordered as W


def back(text):
    return text.translate(L._BACK)


def scopes(text, language="python"):
    code, blocks = L.shield(language, text)
    found = (L.outline_python(code) if language == "python" else L.outline_script(code, blocks))[0]
    return [(s["node_type"], s["name"], s["start_line"], s["end_line"], s["depth"]) for s in found]


def guards(text, language="python"):
    code, blocks = L.shield(language, text)
    found = (L.outline_python(code) if language == "python" else L.outline_script(code, blocks))[1]
    return [(g["line"], g["function"], g["condition"], g["error"], g["message"]) for g in found]


@pytest.mark.parametrize("language", ["python", "javascript"])
def test_length_stays_and_text_comes_back(language):
    rng = random.Random(3)
    signs = ["a", " ", "\n", "(", ")", "[", "]", "{", "}", '"', "'", "`", "${", "/", "\\", ":", ";", ",", "if", "def f", "class X", '"""', "=>", "é"]
    for _ in range(500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        code, blocks = L.shield(language, text)
        assert len(code) == len(text)
        if language == "python":
            assert back(code) == text
            L.outline_python(code)
        else:
            L.outline_script(code, blocks)


def test_python_strings_and_comments_hold_no_code():
    text = 's = """\nclass No:\n    def no():\n"""\n# class No:\nx = "def no(:"\nclass Yes: pass\n'
    assert scopes(text) == [("class", "Yes", 7, 7, 0)]


def test_python_scopes_end_with_their_last_code_line():
    text = "if a:\n    x\n\n    # note\n# margin\n    y\n\n\nelse:\n\tz\nwhile (b and\n  c):\n    d = [\n1]\n"
    assert scopes(text) == [("if", None, 1, 6, 0), ("else", None, 9, 10, 0), ("while", None, 11, 14, 0)]


def test_unclosed_bracket_ends_at_the_next_definition():
    assert scopes("def a(x:\n    y\ndef b():\n    z\n")[-1] == ("function", "b", 3, 4, 0)


def test_raise_anywhere_in_the_statement():
    text = ("def f(a):\n    if a:\n        log(a)\n        for x in a:\n            raise E1('one')\n    elif b:\n        pass\n    else:\n"
            "        raise mod.E2(f'two {a}') from None\n    if c: pass\n    raise E3\nif d: raise\n")
    assert guards(text) == [(2, "f", "a", "mod.E2", "two {a}"), (6, "f", "b", "mod.E2", "two {a}"), (12, "anonymous", "d", None, None)]


def test_throw_directly_in_the_branch():
    text = ("function f(a) {\n  if (a) {\n    { throw new E1('one'); }\n  }\n  if (b) { for (;;) { throw new E2('no'); } }\n"
            "  if (c(d(e))) throw e2\n  else if (g) { if (h) { throw new E3(`t ${x}`) } }\n}\n")
    assert guards(text, "javascript") == [(2, "f", "a", "E1", "one"), (6, "f", "c(d(e))", "e2", None), (7, "f", "h", "E3", "t ${x}")]


def test_script_blocks():
    text = ("const o = {\n  go() {\n    return {a: 1};\n  },\n  n: function named(x) { },\n};\nexport default async function main(a, {b} = {})\n{\n"
            "  switch (a) {\n    case 1: {\n      while (b) { b() }\n    }\n  }\n  const re = /[}\"']/g;\n}\nclass A extends B { x() { } }\n")
    assert scopes(text, "javascript") == [
        ("method", "go", 2, 4, 0), ("async function", "main", 7, 15, 0), ("switch", None, 9, 13, 1), ("while", None, 11, 11, 2),
        ("class", "A", 16, 16, 0), ("method", "x", 16, 16, 1)]


def test_any_bracket_depth(spark):
    deep = "(" * 60 + "1" + ")" * 60
    text = f"def f(a={deep}, b: str = ',)') -> int:\n    return 1\n\ndef g(x): return {deep}\n"
    df = spark.createDataFrame([("m.py", "python", text), ("n.py", "python", None), ("e.js", "javascript", "")], "path string, language string, content string")
    funcs = [(r.name, r.params_text) for r in E.functions(df).orderBy("line").collect()]
    assert funcs == [("f", f"a={deep}, b: str = ',)'"), ("g", "x")]
    params = [(r.name, r.default) for r in E.params(E.functions(df, plain_params=False)).orderBy("line", "pos").collect()]
    assert params == [("a", deep), ("b", "',)'"), ("x", None)]
    assert [(r.name, r.end_line) for r in W.outline(df).orderBy("start_line").collect()] == [("f", 2), ("g", 4)]


def test_long_files_are_linear(spark):
    text = "\n".join(f"def f{i}(a,\n    b):\n    if a:\n        raise E('{i}')" for i in range(20000))
    df = spark.createDataFrame([("m.py", "python", text)], "path string, language string, content string")
    assert W.outline(df).count() == 40000 and E.guards(df).count() == 20000
