"""Table functions over code text: one input row per file, one output row per match.

Input columns are path, language, content. Matching stays inside the row:
each pattern runs once over the whole text, the matches of all patterns of the
file's language are put together, then exploded. So the text is scanned once
and never shuffled. Definitions are looked for in the shielded text of ``lexical``, where
strings and comments hold no code, a header is one line and brackets of any depth are followed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.template import match_spans, without
from lodestrata.operators.joins import nearest_scope
from lodestrata.operators.lexical import LINE_ENDS, matched, nested, plain, read
from lodestrata.session import written


def _nested(opening: str, closing: str, depth: int = 24) -> str:
    """Text with balanced brackets, ``depth`` levels deep.

    Possessive loops over whole runs of plain characters: the matcher neither backtracks nor
    recurses per character, so a signature may be of any length.
    """
    plain = f"[^{opening}{closing}]"
    inner = f"{plain}*+"
    for _ in range(depth):
        inner = f"(?:{plain}++|[{opening}]{inner}[{closing}])*+"
    return inner


_ROUND = _nested("(", ")")

# Text forms of imports, definitions, exports and guards.
JS_IMPORT = ("import\\s+(?:type\\s+)?(?:(\\w+)\\s*,\\s*)?(?:\\{([^}]*)\\}|(\\w+)|\\*\\s+as\\s+(\\w+))"
             "\\s+from\\s+['\"]([^'\"]+)['\"]")
JS_SIDE_EFFECT = "import\\s+['\"]([^'\"]+)['\"]"
JS_REQUIRE = "(?:(?:const|let|var)\\s+(?:\\{([^}]*)\\}|(\\w+))\\s*=\\s*)?\\brequire\\(\\s*['\"]([^'\"]+)['\"]\\s*\\)"
JS_DYNAMIC = "\\bimport\\(\\s*['\"]([^'\"]+)['\"]\\s*\\)"
JS_REEXPORT = "export\\s+(?:\\{([^}]*)\\}|(\\*)(?:\\s+as\\s+\\w+)?)\\s+from\\s+['\"]([^'\"]+)['\"]"
# Docstrings and comments are matched as well, so that what stands in them is passed over; their groups are empty.
PY_SKIP = "(?s:\"\"\".*?\"\"\"|'''.*?''')|#[^\\n]*|"
PY_IMPORT = PY_SKIP + "(?m:^|;)[ \\t]*import[ \\t]+([^\\n#;]+)"
PY_FROM = PY_SKIP + "(?m:^|;)[ \\t]*from[ \\t]+(\\.*[\\w.]*)[ \\t]+import[ \\t]+(?:\\(([^)]*)\\)|([^\\n#;(]+))"
# Patterns that begin with optional words look at the first letter before they try these at every place.
JS_CLASS = "(?=[edc])(?:export\\s+)?(?:default\\s+)?class\\s+(\\w+)(?:\\s+extends\\s+(\\w+(?:\\.\\w+)*))?[^{}\\n]*\\{"
PY_CLASS = "(?m)^((?:[ \\t]*@[^\\n]*\\n)*)([ \\t]*)class[ \\t]+(\\w+)[ \\t]*(?:\\(([^)]*)\\))?[ \\t]*:"
JS_FUNCTION = "(?=[edaf])(?:export\\s+)?(?:default\\s+)?(async\\s+)?function\\s+(\\w+)\\s*\\((" + _ROUND + ")\\)"
JS_ARROW = "(?=[ec])(?:export\\s+)?const\\s+(\\w+)\\s*=\\s*(async\\s+)?\\((" + _ROUND + ")\\)\\s*(?::[^=\\n]+)?=>"
PY_DEF = ("(?m)^((?:[ \\t]*@[^\\n]*\\n)*)([ \\t]*)(async[ \\t]+)?def[ \\t]+(\\w+)[ \\t]*"
          "\\((" + _ROUND + ")\\)[ \\t]*(?:->[ \\t]*([^:\\n]+))?:")
JS_METHOD = ("(?m)^[ \\t]+((?:(?:async|static|public|private|protected|get|set)[ \\t]+)*)(\\w+)[ \\t]*"
             "\\((" + _ROUND + ")\\)[^;{}\\n]*\\{")
JS_FIELD = ("(?m)^[ \\t]+((?:(?:static|public|private|protected|readonly)[ \\t]+)*)(#?\\w+)[ \\t]*"
            "(?::[ \\t]*([^=;\\n]+))?(?:=[ \\t]*([^;\\n]+))?;[ \\t]*$")
PY_FIELD = "(?m)^[ \\t]+()([A-Za-z_]\\w*)[ \\t]*(?::[ \\t]*([^=\\n]+?))?[ \\t]*(?:=(?!=)[ \\t]*([^\\n]+))?$"
JS_CONSTANT = "(?=[ec])(?:export\\s+)?const\\s+([A-Z][A-Z0-9_]*)\\s*(?::\\s*([^=]+?))?\\s*=\\s*([^;\\n]+)"
PY_CONSTANT = "(?m)^([A-Za-z_]\\w*)[ \\t]*(?::[ \\t]*([^=\\n]+?))?[ \\t]*=(?!=)[ \\t]*([^\\n]+)$"
JS_EXPORT_LIST = "export\\s+\\{([^}]+)\\}"
JS_EXPORT_DECL = "export\\s+(?:default\\s+)?(?:async\\s+)?(?:const|let|var|function|class)\\s+(\\w+)"
PY_ALL = "(?m)^__all__[ \\t]*=[ \\t]*[\\[(]([^\\])]*)[\\])]"
NOT_METHODS = ("if", "for", "while", "switch", "catch", "function", "return", "constructor", "with", "else", "do")
# Bases and name endings of entity classes, words of route decorators, patterns.
ENTITY_BASES = ("BaseModel", "Model", "Entity", "ABC", "TypedDict")
ENTITY_SUFFIXES = ("Model", "Entity", "Data", "DTO", "Schema")
ROUTE_WORDS = ("get", "post", "put", "delete", "patch", "route", "api", "app")
INSTANCE_FIELDS = ("_instance", "instance", "_singleton")
INSTANCE_GETTERS = ("get_instance", "getInstance", "instance")


# Patterns over shielded text by name: language family, pattern, groups.
CODE = {
    "py_class": ("python", PY_CLASS, ["decor", "indent", "name", "base_list"]),
    "py_def": ("python", PY_DEF, ["decor", "indent", "async", "name", "params_text", "return_type"]),
    "py_field": ("python", PY_FIELD, ["words", "name", "type", "default"]),
    "py_constant": ("python", PY_CONSTANT, ["name", "type", "value"]),
    "js_class": ("script", JS_CLASS, ["name", "base"]),
    "js_function": ("script", JS_FUNCTION, ["async", "name", "params_text"]),
    "js_arrow": ("script", JS_ARROW, ["name", "async", "params_text"]),
    "js_method": ("script", JS_METHOD, ["words", "name", "params_text"]),
    "js_field": ("script", JS_FIELD, ["words", "name", "type", "default"]),
    "js_constant": ("script", JS_CONSTANT, ["name", "type", "value"]),
}
CLASS_CODE = ("py_class", "js_class")
FUNCTION_CODE = ("py_def", "js_function", "js_arrow")
MEMBER_CODE = ("py_def", "py_field", "js_method", "js_field")


def matches(pattern: str, groups: list[str], content: str = "content") -> Column:
    """All matches of a pattern in the row's text: ARRAY<STRUCT<line,start,raw,groups...>>; empty groups are null."""
    return F.transform(match_spans(F.col(content), pattern, len(groups), LINE_ENDS), lambda m: F.struct(
        m["line"].alias("line"), m["at"].alias("start"), m["f"][0].alias("raw"),
        *[F.nullif(m["f"][i + 1], F.lit("")).alias(g) for i, g in enumerate(groups)]))


def _each(pattern: str, groups: list[str], shape, where=None) -> Column:
    """Output structs of one pattern: ``shape`` turns a match into a struct."""
    hits = matches(pattern, groups)
    return F.transform(F.filter(hits, where) if where is not None else hits, shape)


def _many(pattern: str, groups: list[str], shape, where=None) -> Column:
    """Output structs of one pattern whose ``shape`` gives an array per match."""
    return F.flatten(_each(pattern, groups, shape, where))


def _extract(files: DataFrame, python: list[Column], script: list[Column]) -> DataFrame:
    """One pass over the files: the structs of the file's language family, exploded."""
    rows = F.when(F.col("language") == "python", F.concat(*python)) if python else None
    if script:
        is_script = F.col("language").isin("javascript", "typescript")
        rows = F.when(is_script, F.concat(*script)) if rows is None else rows.when(is_script, F.concat(*script))
    return files.select("path", "language", F.inline(rows))


def _in_code(files: DataFrame, python: list[tuple], script: list[tuple]) -> DataFrame:
    """The same from the shielded text: (name in ``CODE``, shape) or (name, shape, where) of each pattern.

    The pass that shields the text finds the matches, so the text stays there.
    """
    def shaped(name: str, shape, where=None) -> Column:
        return F.transform(F.filter(name, where) if where is not None else F.col(name), shape)

    rows = F.when(F.col("language") == "python", F.concat(*[shaped(*p) for p in python])).when(
        F.col("language").isin("javascript", "typescript"), F.concat(*[shaped(*p) for p in script]))
    return matched(files, {p[0]: CODE[p[0]] for p in (*python, *script)}).select("path", "language", F.inline(rows))


def read_once(files: DataFrame, *names: str, with_guards: bool = False) -> DataFrame:
    """The files as the lexical pass leaves them: scopes, the matches of the named patterns of ``CODE``, and guards if asked for.

    For reports that need several of :func:`classes`, :func:`functions`, :func:`members`, :func:`guards` and the outline: given this instead
    of the files, they read the columns, and no text is gone through again. The table is written once to the shared folder.
    """
    return written(read(files, {n: CODE[n] for n in names}, with_scopes=True, with_guards=with_guards), "code")


def _none_array() -> Column:
    return F.array().cast("array<string>")


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _names(c: Column, alias_mark: str = "\\s+as\\s+|\\s*:\\s*") -> Column:
    parts = F.transform(F.split(c, ","), lambda n: F.trim(F.split(
        F.regexp_replace(F.trim(F.regexp_replace(n, "#[^\\n]*|\\s+", " ")), "^type ", ""), alias_mark)[0]))
    return F.coalesce(F.filter(parts, lambda n: n != ""), _none_array())


def _import(m: Column, kind: str, module: Column, items: Column, is_default: Column, alias: Column | None = None) -> Column:
    return F.struct(m["line"].alias("line"), F.lit(kind).alias("kind"), module.alias("module"), items.alias("items"),
                    is_default.alias("is_default"), (_no_text() if alias is None else alias).alias("alias"))


def _js_import_rows() -> list[Column]:
    def esm(m):
        default = F.coalesce(m["first"], m["single"])
        items = F.concat(F.array_compact(F.array(default)), _names(m["named"]),
                         F.when(m["space"].isNotNull(), F.array(F.lit("*"))).otherwise(_none_array()))
        return _import(m, "import", m["module"], items, default.isNotNull(), m["space"])

    return [
        _each(JS_IMPORT, ["first", "named", "single", "space", "module"], esm),
        _each(JS_SIDE_EFFECT, ["module"], lambda m: _import(m, "side_effect", m["module"], _none_array(), F.lit(False))),
        _each(JS_REQUIRE, ["named", "single", "module"], lambda m: _import(
            m, "require", m["module"], _names(m["named"]), m["named"].isNull(), m["single"])),
        _each(JS_DYNAMIC, ["module"], lambda m: _import(m, "dynamic", m["module"], _none_array(), F.lit(True))),
        _each(JS_REEXPORT, ["named", "star", "module"], lambda m: _import(
            m, "reexport", m["module"], _names(m["named"]), F.lit(False)))]


def _py_import_rows() -> list[Column]:
    def plain(m):
        def one(name):
            text = F.regexp_replace(F.trim(name), "\\s+", " ")
            return _import(m, "import", F.split_part(text, F.lit(" as "), F.lit(1)), _none_array(), F.lit(False),
                           F.nullif(F.split_part(text, F.lit(" as "), F.lit(2)), F.lit("")))
        return F.transform(F.split(m["list"], ","), one)

    def from_(m):
        text = F.coalesce(m["wrapped"], m["listed"])
        items = _names(text, "\\s+as\\s+")
        aliases = F.filter(F.transform(F.split(text, ","), lambda n: F.regexp_extract(n, "\\s+as\\s+(\\w+)", 1)), lambda a: a != "")
        return _import(m, "from", m["module"], items, F.array_contains(items, "*"), F.try_element_at(aliases, F.lit(-1)))

    return [_many(PY_IMPORT, ["list"], plain, lambda m: m["list"].isNotNull()),
            _each(PY_FROM, ["module", "wrapped", "listed"], from_, lambda m: m["module"].isNotNull())]


def js_imports(files: DataFrame) -> DataFrame:
    """Imports of script files: path, language, line, kind, module, items, is_default, alias."""
    return _extract(files, [], _js_import_rows())


def py_imports(files: DataFrame) -> DataFrame:
    """Imports of Python files, in the columns of :func:`js_imports`; ``import a, b`` gives two rows."""
    return _extract(files, _py_import_rows(), [])


def imports(files: DataFrame) -> DataFrame:
    """Imports of all files, in one pass."""
    return _extract(files, _py_import_rows(), _js_import_rows())


def _lines_in(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.length(text) - F.length(without(text, "\n"))


def _decorators(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("@([\\w.]+)"), F.lit(1)), _none_array())


def classes(files: DataFrame) -> DataFrame:
    """Classes: path, language, name, line, bases, decorators."""
    def py(m):
        bases = F.filter(F.transform(F.split(m["base_list"], ","), lambda b: F.trim(b)), lambda b: (b != "") & ~b.contains("="))
        return F.struct(m["name"].alias("name"), (m["line"] + _lines_in(m["decor"])).alias("line"),
                        F.coalesce(bases, _none_array()).alias("bases"), _decorators(m["decor"]).alias("decorators"))

    def js(m):
        return F.struct(m["name"].alias("name"), m["line"].alias("line"), F.array_compact(F.array(m["base"])).alias("bases"),
                        _none_array().alias("decorators"))

    found = _in_code(files, [("py_class", py)], [("js_class", js)])
    return found.withColumn("bases", F.transform("bases", plain))


def functions(files: DataFrame, plain_params: bool = True) -> DataFrame:
    """Functions and arrow functions (in Python also methods, see ``indent``).

    Columns: path, language, name, line, is_async, params_text, return_type, decorators, indent. For
    ``params`` the text is best left shielded, so that strings and deep brackets cannot mislead it.
    """
    def row(m, line, returns, decorators, indent):
        return F.struct(m["name"].alias("name"), line.alias("line"), m["async"].isNotNull().alias("is_async"),
                        F.coalesce(m["params_text"], F.lit("")).alias("params_text"), returns.alias("return_type"),
                        decorators.alias("decorators"), indent.alias("indent"))

    def py(m):
        return row(m, m["line"] + _lines_in(m["decor"]), F.trim(m["return_type"]), _decorators(m["decor"]),
                   F.length(F.coalesce(m["indent"], F.lit(""))))

    def js(m):
        return row(m, m["line"], _no_text(), _none_array(), F.lit(0))

    found = _in_code(files, [("py_def", py)], [("js_function", js), ("js_arrow", js)])
    return found.withColumns({c: plain(c) for c in (["params_text"] if plain_params else []) + ["return_type"]})


def members(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """Methods and fields of classes: path, owner, kind, name, line, is_async, is_static, type, default, params_text, decorators.

    A member belongs to the class whose lines hold it directly.
    """
    def row(kind, m, line, is_async, is_static, type_, default, params_text, decorators):
        return F.struct(F.lit(kind).alias("kind"), m["name"].alias("name"), line.alias("line"), is_async.alias("is_async"),
                        is_static.alias("is_static"), type_.alias("type"), default.alias("default"),
                        params_text.alias("params_text"), decorators.alias("decorators"))

    def py_method(m):
        decorators = _decorators(m["decor"])
        return row("method", m, m["line"] + _lines_in(m["decor"]), m["async"].isNotNull(),
                   F.exists(decorators, lambda d: d.isin("staticmethod", "classmethod")), F.trim(m["return_type"]), _no_text(),
                   F.coalesce(m["params_text"], F.lit("")), decorators)

    def js_method(m):
        words = F.coalesce(m["words"], F.lit(""))
        return row("method", m, m["line"], words.contains("async"), words.contains("static"), _no_text(), _no_text(),
                   F.coalesce(m["params_text"], F.lit("")), _none_array())

    def field(static):
        return lambda m: row("field", m, m["line"], F.lit(False), static(m), F.trim(m["type"]), F.trim(m["default"]),
                             _no_text(), _none_array())

    def is_field(m):
        return ~m["name"].isin("async", "static", "get", "set", "return", "pass", "break", "continue")

    rows = _in_code(
        files,
        [("py_def", py_method, lambda m: m["indent"].isNotNull()),
         ("py_field", field(lambda m: m["type"].isNull()),
          lambda m: is_field(m) & (m["type"].isNotNull() | m["default"].isNotNull()))],
        [("js_method", js_method, lambda m: ~m["name"].isin(*NOT_METHODS)),
         ("js_field", field(lambda m: F.coalesce(m["words"], F.lit("")).contains("static")), is_field)])
    # The scope around a method header is the method itself, so look one scope further out.
    outer = scopes.filter(F.col("node_type").isin("class", "function", "method", "async function", "async method",
                                                  "arrow fn", "constructor"))
    rows = rows.withColumns({c: plain(c) for c in ("type", "default", "params_text")})
    held = nearest_scope_above(rows.drop("language"), outer)
    return held.filter(F.col("scope_type") == "class").select(
        "path", F.col("scope_name").alias("owner"), "kind", "name", "line", "is_async", "is_static", "type",
        "default", "params_text", "decorators")


def nearest_scope_above(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """Innermost of the given scopes that holds a point and starts on an earlier line, for points in any."""
    later = scopes.withColumns({"start_line": F.col("start_line") + 1,
                                "node_type": F.when(F.col("node_type") == "class", "class").otherwise("function")})
    return nearest_scope(points, later.filter(F.col("start_line") <= F.col("end_line")), how="inner")


def _is_constant(m) -> Column:
    return m["name"].rlike("^[^a-z]*[A-Z][^a-z]*$") | m["name"].startswith("_") | m["type"].isNotNull()


def constants(files: DataFrame) -> DataFrame:
    """Constants: path, language, name, type, value, line."""
    def row(m):
        return F.struct(m["name"].alias("name"), F.trim(m["type"]).alias("type"), F.trim(m["value"]).alias("value"),
                        m["line"].alias("line"))

    return _extract(files, [_each(PY_CONSTANT, ["name", "type", "value"], row, _is_constant)],
                    [_each(JS_CONSTANT, ["name", "type", "value"], row)])


def definitions(files: DataFrame) -> DataFrame:
    """Classes, exceptions, functions (also methods, see ``indent``) and constants in one pass: path, language, kind, name, line, indent, bases.

    An exception is what :func:`error_classes` calls one, the other classes are classes.
    """
    def row(kind, m, line, indent, bases=None):
        return F.struct(F.lit(kind).alias("kind"), m["name"].alias("name"), line.alias("line"), indent.alias("indent"),
                        (_none_array() if bases is None else bases).alias("bases"))

    def indent_of(m):
        return F.length(F.coalesce(m["indent"], F.lit("")))

    def py_class(m):
        bases = F.filter(F.transform(F.split(m["base_list"], ","), lambda b: F.trim(b)), lambda b: (b != "") & ~b.contains("="))
        return row("classes", m, m["line"] + _lines_in(m["decor"]), indent_of(m), F.coalesce(bases, _none_array()))

    def py_def(m):
        return row("functions", m, m["line"] + _lines_in(m["decor"]), indent_of(m))

    def plain_row(kind):
        return lambda m: row(kind, m, m["line"], F.lit(0))

    found = _in_code(
        files,
        [("py_class", py_class), ("py_def", py_def), ("py_constant", plain_row("constants"), _is_constant)],
        [("js_class", lambda m: row("classes", m, m["line"], F.lit(0), F.array_compact(F.array(m["base"])))),
         ("js_function", plain_row("functions")), ("js_arrow", plain_row("functions")), ("js_constant", plain_row("constants"))])
    bases = F.transform("bases", plain)
    error = (F.col("kind") == "classes") & _is_error("language", "name", bases)
    return found.withColumns({"kind": F.when(error, "exceptions").otherwise(F.col("kind")), "bases": bases})


def exports(files: DataFrame) -> DataFrame:
    """Exported names: path, language, name, line."""
    def named(m, names):
        return F.transform(names, lambda n: F.struct(n.alias("name"), m["line"].alias("line")))

    quoted = F.lit("['\"]([^'\"]+)['\"]")
    return _extract(
        files, [_many(PY_ALL, ["names"], lambda m: named(m, F.coalesce(F.regexp_extract_all(m["names"], quoted, F.lit(1)), _none_array())))],
        [_many(JS_EXPORT_LIST, ["names"], lambda m: named(m, _names(m["names"]))),
         _each(JS_EXPORT_DECL, ["name"], lambda m: F.struct(m["name"].alias("name"), m["line"].alias("line")))])


def _is_error(language: str, name: str, bases: Column) -> Column:
    python = F.exists(bases, lambda b: b.contains("Exception") | b.contains("Error"))
    script = F.col(name).contains("Error") & F.coalesce(F.try_element_at(bases, F.lit(1)), F.lit("")).rlike("^(Error|[A-Z]\\w*Error)$")
    return F.when(F.col(language) == "python", python).otherwise(script)


def error_classes(files: DataFrame) -> DataFrame:
    """Error classes: path, language, name, base, line."""
    return classes(files).filter(_is_error("language", "name", F.col("bases"))).select(
        "path", "language", "name", F.try_element_at("bases", F.lit(1)).alias("base"), "line")


def guards(files: DataFrame) -> DataFrame:
    """Guard clauses: path, language, line, function, condition, error, message.

    In Python an ``if`` (``elif``) with a raise anywhere in its statement, in scripts one with a throw
    directly in its branch. Of several raises the last one with a text counts.
    """
    return nested(files, "guards").select("path", "language", F.inline("guards"))


# A parameter: no comma outside of brackets.
TOP_LEVEL_ITEM = "(?:[^,()\\[\\]{}]++|[(\\[{]" + _nested("(\\[{", ")\\]}") + "[)\\]}])++"


def param_array(text: str | Column, language: str | Column) -> Column:
    """Parameters as ARRAY<STRUCT<name,type,default,required>> from the text between the brackets."""
    t = F.col(text) if isinstance(text, str) else text
    python = (F.col(language) if isinstance(language, str) else language) == "python"
    items = F.filter(F.transform(F.regexp_extract_all(t, F.lit(TOP_LEVEL_ITEM), F.lit(0)), lambda p: F.trim(
        F.regexp_replace(p, "\\s+", " "))), lambda p: (p != "") & ~(python & p.isin("self", "cls", "*", "/")))

    def one(p: Column) -> Column:
        left = F.trim(F.regexp_extract(p, "^([^=]*)", 1))
        default = F.nullif(F.trim(F.regexp_extract(p, "^[^=]*=(?!>)(.*)$", 1)), F.lit(""))
        name = F.trim(F.split_part(left, F.lit(":"), F.lit(1)))
        kind = F.nullif(F.trim(F.regexp_extract(left, "^[^:]*:(.*)$", 1)), F.lit(""))
        script_special = ~python & (p.startswith("{") | p.startswith("["))
        rest = p.startswith("*") | p.startswith("...")
        none = F.lit(None).cast("string")
        return F.struct(
            F.when(script_special & p.startswith("{"), "{...}").when(script_special, "[...]").otherwise(name).alias("name"),
            F.when(script_special | (~python & rest), none).otherwise(kind).alias("type"),
            F.when(script_special | rest, none).otherwise(default).alias("default"),
            (script_special | (~rest & default.isNull())).alias("required"))

    return F.transform(items, one)


def params(funcs: DataFrame) -> DataFrame:
    """One row per parameter: path, function, line, pos, name, type, default, required, rest.

    ``funcs`` are those of :func:`functions`, best with shielded params.
    """
    rows = funcs.select("path", F.col("name").alias("function"), "line",
                        F.posexplode(param_array(F.translate("params_text", LINE_ENDS[1], " "), "language")).alias("pos", "p"))
    name = F.col("p.name")
    return rows.select("path", "function", "line", "pos", *[plain(f"p.{c}").alias(c) for c in ("name", "type", "default")], "p.required",
                       (name.startswith("*") | name.startswith("...")).alias("rest"))


def class_patterns(class_rows: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Add ``patterns`` to classes: dataclass, singleton, abstract, factory, builder, serialization."""
    method, field = F.col("kind") == "method", F.col("kind") == "field"
    n = F.col("name")
    flags = member_rows.groupBy("path", F.col("owner").alias("_owner")).agg(
        F.bool_or(field & n.isin(*INSTANCE_FIELDS)).alias("inst"),
        F.bool_or(method & n.isin(*INSTANCE_GETTERS, "__new__")).alias("getter"),
        F.bool_or(method & (n == "getInstance") & F.col("is_static")).alias("static_getter"),
        F.bool_or(method & F.col("is_static") & n.startswith("create")).alias("factory"),
        F.bool_or(method & (n == "build")).alias("builder"),
        F.bool_or(method & n.isin("toJSON", "fromJSON")).alias("json"),
        F.bool_or(F.array_contains("decorators", "abstractmethod")).alias("abstract"))
    joined = class_rows.join(flags.withColumnRenamed("path", "_path"),
                             (F.col("path") == F.col("_path")) & (n == F.col("_owner")), "left")

    def flag(label: str, test: Column) -> Column:
        return F.when(test, F.lit(label))

    abstract_base = F.exists("bases", lambda b: b.contains("ABC") | b.contains("Abstract"))
    found = F.array_compact(F.array(
        flag("dataclass", F.array_contains("decorators", "dataclass")),
        flag("singleton", (F.col("inst") & F.col("getter")) | F.col("static_getter")),
        flag("abstract", abstract_base | F.coalesce("abstract", F.lit(False))),
        flag("factory", F.col("factory")), flag("builder", F.col("builder")),
        flag("serialization", F.col("json"))))
    return joined.select(*class_rows.columns, found.alias("patterns"))


def data_models(class_rows: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Classes that hold data, with their number of typed fields. Both sides come from texts and are never broadcast by a size estimate."""
    typed = (member_rows.filter((F.col("kind") == "field") & F.col("type").isNotNull())
             .groupBy(F.col("path").alias("_path"), F.col("owner").alias("_owner")).agg(F.count(F.lit(1)).alias("fields")))
    joined = class_rows.join(typed.hint("merge"), (F.col("path") == F.col("_path")) & (F.col("name") == F.col("_owner")), "left")
    n = F.coalesce("fields", F.lit(0))
    ends = reduce(lambda a, b: a | b, [F.col("name").endswith(s) for s in ENTITY_SUFFIXES])
    is_dataclass = F.array_contains("decorators", "dataclass")
    entity = F.arrays_overlap("bases", F.array(*[F.lit(b) for b in ENTITY_BASES]))
    return joined.filter(is_dataclass | (n > 0) | entity | ends).select(
        "path", "name", "line", n.alias("fields"), is_dataclass.alias("is_dataclass"),
        F.exists("bases", lambda b: b.contains("ABC")).alias("is_abstract"))


def routes(funcs: DataFrame) -> DataFrame:
    """Functions with a decorator that contains a route word anywhere (``@target`` counts: ``get``)."""
    hit = F.exists("decorators", lambda d: reduce(lambda a, b: a | b, [F.lower(d).contains(w) for w in ROUTE_WORDS]))
    return funcs.filter(~F.col("name").startswith("_") & hit)


# --- manifests --------------------------------------------------------------------

def manifests(files: DataFrame) -> DataFrame:
    """Name, version, description and dependencies of manifest files, in one pass.

    Reads ``package.json``, ``pyproject.toml`` and ``requirements.txt``. Keeps the
    columns of ``files`` but the content, and adds language, name, version,
    description, deps ARRAY<STRUCT<name,version,is_dev,is_workspace>>.
    """
    base = F.substring_index("path", "/", -1)
    keep = [c for c in files.columns if c not in ("content", "language")]
    read = (F.when(base == "package.json", _package_json())
            .when(base == "pyproject.toml", _pyproject())
            .when(base == "requirements.txt", _requirements()))
    known = files.filter(base.isin("package.json", "pyproject.toml", "requirements.txt"))
    return known.select(*keep, F.when(base == "package.json", "javascript").otherwise("python").alias("language"),
                        read.alias("_m")).select(*keep, "language", "_m.*")


def _manifest(name: Column, version: Column, description: Column, deps: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"), description.alias("description"), deps.alias("deps"))


def _is_workspace(version: Column) -> Column:
    return version.rlike("^(workspace:|file:|link:)") | version.rlike("^\\{.*\\bpath\\s*=")


def _dep(name: Column, version: Column, is_dev: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"), is_dev.alias("is_dev"),
                    _is_workspace(version).alias("is_workspace"))


def _package_json() -> Column:
    doc = F.from_json("content", "name string, version string, description string, "
                                 "dependencies map<string,string>, devDependencies map<string,string>")

    def deps(col: str, dev: bool) -> Column:
        return F.coalesce(F.transform(F.map_entries(doc[col]), lambda e: _dep(e["key"], e["value"], F.lit(dev))),
                          F.array().cast("array<struct<name:string,version:string,is_dev:boolean,is_workspace:boolean>>"))

    return _manifest(doc["name"], doc["version"], doc["description"],
                     F.concat(deps("dependencies", False), deps("devDependencies", True)))


def _pyproject() -> Column:
    sections = F.split("content", "(?m)^(?=[ \\t]*\\[[^\\]\\n]+\\][ \\t]*$)")

    def head(s: Column) -> Column:
        return F.regexp_extract(s, "^[ \\t]*(\\[[^\\]\\n]+\\])", 1)

    project = F.array_join(F.filter(sections, lambda s: head(s).isin("[project]", "[tool.poetry]")), "\n")

    def clean(c: Column) -> Column:
        return F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")

    def field(name: str) -> Column:
        return F.nullif(clean(F.regexp_extract(project, f"(?m)^[ \\t]*{name}[ \\t]*=[ \\t]*(.*?)[ \\t]*$", 1)), F.lit(""))

    def entries(s: Column) -> Column:
        lines = F.filter(F.split(s, "\n"), lambda x: x.rlike("^[ \\t]*[^#\\[\\s][^=]*="))
        dev = F.lower(head(s)).contains("dev")
        return F.transform(lines, lambda x: _dep(clean(F.regexp_extract(x, "^([^=]*)=", 1)),
                                                 clean(F.regexp_extract(x, "^[^=]*=(.*)$", 1)), dev))

    dep_sections = F.filter(sections, lambda s: F.lower(head(s)).contains("dependencies"))
    return _manifest(field("name"), field("version"), field("description"), F.flatten(F.transform(dep_sections, entries)))


def _requirements() -> Column:
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))),
                     lambda x: x.rlike("^[A-Za-z0-9]"))
    deps = F.transform(lines, lambda x: _dep(F.regexp_extract(x, "^([A-Za-z0-9._-]+)", 1),
                                             F.trim(F.regexp_replace(x, "^[A-Za-z0-9._-]+(\\[[^\\]]*\\])?", "")), F.lit(False)))
    folder = F.regexp_extract("path", "([^/]+)/[^/]*$", 1)
    return _manifest(F.nullif(folder, F.lit("")), _no_text(), _no_text(), deps)


def dependencies(manifest_rows: DataFrame) -> DataFrame:
    """One row per dependency: manifest, name, version, is_dev, is_workspace."""
    return manifest_rows.select(F.col("path").alias("manifest"), F.inline("deps"))
