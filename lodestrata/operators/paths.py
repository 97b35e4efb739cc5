"""Filters over paths, scopes and folds, and result views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import base_name, language_of

# Directories and files that a scan leaves out by default.
DEFAULT_IGNORES = (
    "**/node_modules/**", "**/.venv/**", "**/venv/**", "**/__pycache__/**", "**/dist/**",
    "**/build/**", "**/.git/**", "**/target/**", "**/*.pyc", "**/*.pyo", "**/.DS_Store",
    "**/__SPECS__/**", "**/__STAGE__/**")
TEST_DIRS = ("test", "tests", "__tests__")
CONTROL_FLOW = ("if", "elif", "else", "for", "while", "try", "except", "finally")
NAMED_SCOPES = ("class", "function", "method", "async function", "async method", "constructor",
                "getter", "setter", "interface", "enum", "namespace")
# Fold kinds and the kinds folded by default.
FOLD_TYPES = ("block", "import", "arglist", "chain", "literal", "comment", "doc", "class", "array", "object")
DEFAULT_FOLDS = ("block", "import", "literal", "comment", "array", "object")


def path_glob_regex(pattern: str) -> str:
    """Anchored regex of a path glob: ``**`` crosses folders, ``*`` and ``?`` do not."""
    import re
    out = re.escape(pattern)
    out = out.replace("\\*\\*/", "(?:.*/)?").replace("/\\*\\*", "/.*").replace("\\*\\*", ".*")
    out = out.replace("\\*", "[^/]*").replace("\\?", "[^/]")
    return f"^{out}$"


def gitignore_rule(line: str) -> tuple[str, bool] | None:
    """Regex of one ignore-file line and whether it re-includes (``!``); None for blanks and comments."""
    rule = line.rstrip()
    if not rule or rule.startswith("#"):
        return None
    keep = rule.startswith("!")
    rule = rule[1:] if keep else rule
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    body = path_glob_regex(rule.lstrip("/"))[1:-1]
    head = "^" if anchored else "^(?:.*/)?"
    tail = "/.*$" if folder else "(?:/.*)?$"
    return head + body + tail, keep


def ignored(path: str | Column, patterns: list[str] = (), gitignore: list[str] = (),
            include_deps: bool = False) -> Column:
    """Predicate: the path is left out by a default glob, a user glob, or the ignore rules.

    The pattern lists are constants of the query, so they are part of the
    filter; among the ignore rules the last one that fits decides.
    """
    p = F.col(path) if isinstance(path, str) else path
    globs = [*(() if include_deps else DEFAULT_IGNORES), *patterns]
    by_glob = [p.rlike(path_glob_regex(g)) for g in globs]
    verdict = F.lit(False)
    for rule in filter(None, map(gitignore_rule, gitignore)):
        regex, keep = rule
        verdict = F.when(p.rlike(regex), F.lit(not keep)).otherwise(verdict)
    return reduce(lambda a, b: a | b, by_glob, verdict)


def drop_ignored(df: DataFrame, path: str, patterns: list[str] = (), gitignore: list[str] = (),
                 include_deps: bool = False) -> DataFrame:
    """Rows whose path is not ignored."""
    return df.filter(~ignored(path, patterns, gitignore, include_deps))


def keep_languages(df: DataFrame, languages: list[str], path: str = "path") -> DataFrame:
    """Rows in one of the languages; ``node`` stands for javascript and typescript."""
    wanted = [x for lang in languages for x in (("javascript", "typescript") if lang == "node" else (lang,))]
    return df.filter(language_of(path).isin(*wanted))


def drop_tests(df: DataFrame, path: str = "path") -> DataFrame:
    """Rows outside test folders whose file name is not hidden."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    in_tests = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in TEST_DIRS]))
    return df.filter(~in_tests & ~base_name(path).startswith("."))


def filter_scopes(df: DataFrame, named: bool = False, min_depth: int | None = None,
                  max_depth: int | None = None, no_control_flow: bool = False) -> DataFrame:
    """Scopes by kind and depth."""
    out = df
    if named:
        out = out.filter(F.col("node_type").isin(*NAMED_SCOPES))
    if min_depth is not None:
        out = out.filter(F.col("depth") >= min_depth)
    if max_depth is not None:
        out = out.filter(F.col("depth") <= max_depth)
    if no_control_flow:
        out = out.filter(~F.col("node_type").isin(*CONTROL_FLOW))
    return out


def filter_folds(df: DataFrame, types: tuple[str, ...] = FOLD_TYPES, min_lines: int = 4) -> DataFrame:
    """Folds of the enabled kinds that are long enough for their kind."""
    lines, kind = F.col("line_count"), F.col("fold_type")
    long_enough = (F.when(kind.isin("block", "class"), lines >= min_lines)
                   .when(kind.isin("import", "literal", "array", "object"), lines >= 2)
                   .otherwise(F.lit(True)))
    return df.filter(kind.isin(*types) & long_enough)


def unknown_only(imports: DataFrame) -> DataFrame:
    """Only unresolved imports; files without any have no row, so they drop out."""
    return imports.filter(F.col("import_type") == "unknown")


def unknown_stats(imports: DataFrame) -> DataFrame:
    """Counters of the unknown view: only the unknown count is left."""
    n = F.count_if(F.col("import_type") == "unknown")
    zero = F.lit(0).cast("long")
    return imports.agg(zero.alias("total_files"), n.alias("total_imports"), zero.alias("external_imports"),
                       zero.alias("internal_imports"), zero.alias("local_imports"),
                       zero.alias("stdlib_imports"), n.alias("unknown_imports"))


def deps_only(deps: DataFrame) -> DataFrame:
    """Only the dependency columns of a scan."""
    return deps.select("name", "version", "is_dev", "is_workspace", "manifest")
