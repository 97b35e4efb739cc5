"""Placeholders in text: find them, look their paths up in JSON, put the values in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two placeholder forms and their escapes.
MUSTACHE = "\\{\\{([^}|]+)(?:\\|(\"[^\"]*\"))?\\}\\}"
DOT_PATH = "\\$\\.([a-zA-Z_]\\w*(?:\\.\\w+|\\[\\d+\\]|\\[\"[^\"]+\"\\]|\\['[^ ']+'\\])*)"
ESCAPED_DOT = "\\\\\\$\\."
ESCAPED_MUSTACHE = "\\\\\\{\\{"
PLAIN_PATH = "^[a-zA-Z][a-zA-Z0-9]*(?:\\.[a-zA-Z][a-zA-Z0-9]*)*$"
FUNCTION_REF = "^\\{\\{fn:([a-zA-Z_][a-zA-Z0-9_]*)\\}\\}$"

_MARK, _SEP = "\u0001", "\u0002"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def without(text: Column, signs: str) -> Column:
    """The text without the given signs: a byte search for each, where ``translate`` looks every character up."""
    for sign in signs:
        text = F.replace(text, F.lit(sign), F.lit(""))
    return text


def match_pieces(text: Column, pattern: str, groups: int) -> Column:
    """Split text at the matches of ``pattern``: text, match, text, match, ..., text.

    Each match piece holds the whole match and its groups, parted by a control
    character. One regex pass, in the row, no shuffle.
    """
    clean = without(text, _MARK + _SEP)
    fields = _SEP.join(f"${i}" for i in range(groups + 1))
    return F.split(F.regexp_replace(clean, pattern, f"{_MARK}{fields}{_MARK}"), _MARK)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


#: Pieces up to which positions are summed in one go; changes the work, not the result.
FEW_PIECES = 128


def match_spans(text: Column, pattern: str, groups: int, line_ends: str = "\n") -> Column:
    """The matches of ``pattern``: ARRAY<STRUCT<f,line,at>>, f being the whole match and its groups.

    Positions are running sums over the pieces. Where there are many, they are taken in blocks of
    about the root of the number of pieces (block totals first, then inside each block), so no
    long array is copied for every match. ``line_ends`` are the signs that end a line.
    """
    pieces = F.transform(match_pieces(text, pattern, groups), lambda p, i: let(F.when(i % 2 == 1, F.split(p, _SEP)).otherwise(F.array(p)), lambda f: F.struct(
        (i % 2 == 1).alias("hit"), f.alias("f"), F.length(f[0]).alias("size"),
        (F.length(f[0]) - F.length(without(f[0], line_ends))).alias("lines"))))

    def walk(items: Column, line: Column, at: Column, kind: str, keep, entry) -> Column:
        return F.aggregate(
            items, F.struct(line.alias("line"), at.alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda acc, x: F.struct(
                (acc["line"] + x["lines"]).alias("line"), (acc["at"] + x["size"]).alias("at"),
                F.when(keep(x), F.concat(acc["out"], F.array(entry(acc, x)))).otherwise(acc["out"]).alias("out")))["out"]

    def total(block: Column, field: str) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, x: n + x[field])

    def in_blocks(all_pieces: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(all_pieces))).cast("int"), F.lit(1))
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_pieces) - 1) / step).cast("int"))
        return let(F.transform(numbers, lambda b: F.slice(all_pieces, b * step + 1, step)), with_blocks)

    def with_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.struct(total(b, "lines").alias("lines"), total(b, "size").alias("size")))
        starts = walk(totals, F.lit(1), F.lit(0), "struct<line:int,at:int>", lambda x: F.lit(True),
                      lambda acc, x: F.struct(acc["line"].alias("line"), acc["at"].alias("at")))
        return let(starts, lambda begin: F.flatten(F.zip_with(blocks, begin, lambda block, s: hits(block, s["line"], s["at"]))))

    def hits(items: Column, line: Column, at: Column) -> Column:
        return walk(items, line, at, "struct<f:array<string>,line:int,at:int>", lambda x: x["hit"],
                    lambda acc, x: F.struct(x["f"].alias("f"), acc["line"].alias("line"), acc["at"].alias("at")))

    return let(pieces, lambda p: F.when(F.size(p) <= FEW_PIECES, hits(p, F.lit(1), F.lit(0))).otherwise(in_blocks(p)))


def placeholders(df: DataFrame, col: str) -> DataFrame:
    """One row per placeholder: raw, path, default, start, end, syntax, in reading order."""
    def found(pattern: str, groups: int, syntax: str) -> Column:
        default = (lambda f: F.when(f[2] != "", F.substring(f[2], F.lit(2), F.length(f[2]) - 2))) if groups > 1 else \
            (lambda f: F.lit(None).cast("string"))
        return F.transform(match_spans(F.col(col), pattern, groups), lambda m: F.struct(
            m["f"][0].alias("raw"), F.trim(m["f"][1]).alias("path"), default(m["f"]).alias("default"),
            m["at"].alias("start"), (m["at"] + F.length(m["f"][0])).alias("end"), F.lit(syntax).alias("syntax")))

    both = F.concat(found(MUSTACHE, 2, "MUSTACHE"), found(DOT_PATH, 1, "DOT_PATH"))
    return df.select(*df.columns, F.inline(both))


def path_segments(path: Column) -> Column:
    """Segments of a dotted / bracketed path."""
    return F.regexp_extract_all(path, F.lit("\\[\"([^\"]*)\"\\]|\\['([^']*)'\\]|\\[([^\\]]*)\\]|([^.\\[\\]]+)"), F.lit(0))


def _bare(segment: Column) -> Column:
    return F.regexp_replace(segment, "^\\[[\"']?|[\"']?\\]$", "")


def resolve_path(json: str | Column, path: str | Column, on_unsafe: str = "error") -> Column:
    """Value at a path in a JSON column; a missing one gives null.

    A segment that starts with ``_`` is refused: ``error`` stops the query,
    ``null`` hides the value.
    """
    doc = _c(json)
    p = F.lit(path) if isinstance(path, str) else path
    segments = F.transform(path_segments(p), _bare)
    as_key = F.concat(F.lit("$"), F.array_join(
        F.transform(segments, lambda s: F.concat(F.lit("['"), s, F.lit("']"))), ""))
    as_index = F.concat(F.lit("$"), F.array_join(F.transform(segments, lambda s: F.when(
        s.rlike("^[0-9]+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(
        F.concat(F.lit("['"), s, F.lit("']")))), ""))
    value = F.coalesce(F.call_function("get_json_object", doc, as_index), F.call_function("get_json_object", doc, as_key))
    unsafe = F.exists(segments, lambda s: s.startswith("_"))
    refusal = (F.raise_error(F.concat(F.lit("Unsafe path segment in: "), p)).cast("string")
               if on_unsafe == "error" else F.lit(None).cast("string"))
    # The plain dotted form needs no taking apart; it is tried first.
    plain = p.rlike(PLAIN_PATH)
    return (F.when(plain, F.call_function("get_json_object", doc, F.concat(F.lit("$."), p)))
            .when(unsafe, refusal).otherwise(value))


def _substitute(text: Column, doc: Column, pattern: str, has_default: bool,
                on_unsafe: str) -> Column:
    pieces = match_pieces(text, pattern, 2 if has_default else 1)

    def put(piece: Column, i: Column) -> Column:
        f = F.split(piece, _SEP)
        path = F.trim(f[1])
        value = resolve_path(doc, path, on_unsafe)
        fallback = (F.when(f[2] != "", F.substring(f[2], F.lit(2), F.length(f[2]) - 2)).otherwise(f[0])
                    if has_default else f[0])
        return F.when(i % 2 == 1, F.coalesce(value, fallback)).otherwise(piece)

    return F.array_join(F.transform(pieces, put), "")


def render_expr(template: str | Column, context: str | Column, on_unsafe: str = "error") -> Column:
    """Fill ``{{path}}``, ``{{path|"default"}}`` and ``$.path`` from a JSON context.

    The mustache form goes first; what it inserts is read again for ``$.``
    paths. A path that is not found keeps its text, escapes are restored.
    """
    doc = _c(context)
    out = _substitute(F.coalesce(_c(template), F.lit("")), doc, MUSTACHE, True, on_unsafe)
    out = _substitute(out, doc, DOT_PATH, False, on_unsafe)
    out = F.regexp_replace(out, ESCAPED_DOT, "\\$.")
    return F.regexp_replace(out, ESCAPED_MUSTACHE, "{{")


def render(df: DataFrame, template: str, context: str, name: str = "rendered",
           on_unsafe: str = "error") -> DataFrame:
    """Add the rendered text of a template column against a JSON context column."""
    return df.withColumn(name, render_expr(template, context, on_unsafe))
