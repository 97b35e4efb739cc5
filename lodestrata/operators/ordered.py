"""Operators that depend on the order of rows: numbering, runs, nesting, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import lexical
from lodestrata.operators.paths import DEFAULT_FOLDS
from lodestrata.operators.running import rank_within, running

LINE_BLOCK = 10_000


def number_rows(df: DataFrame, order: list[str], prefix: str, by: list[str] = (), name: str = "id",
                width: int = 3) -> DataFrame:
    """Running identifiers such as ``VC-001`` in an explicit order, per group of ``by``."""
    ranked = rank_within(df, list(by), [F.col(o) for o in order], "_n")
    digits = F.col("_n").cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return ranked.withColumn(name, F.concat(F.lit(f"{prefix}-"), padded)).drop("_n")


def code_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line: path, language, line (from 1), text."""
    return files.select("path", "language", *keep, F.posexplode(F.split("content", "\n")).alias("_i", "text")).select(
        "path", "language", *keep, (F.col("_i") + 1).alias("line"), F.rtrim("text", F.lit("\r")).alias("text"))


def import_blocks(files: DataFrame) -> DataFrame:
    """Runs of two or more import statements: path, start_line, end_line, import_count.

    Blank lines and comments may lie between them; an import over several lines is one statement. Found in the
    file's row, so no text is shuffled.
    """
    return lexical.import_blocks(files).select("path", F.inline("runs"))


def outermost(folds: DataFrame, block: int = LINE_BLOCK) -> DataFrame:
    """Folds that lie in no other fold of their file; of equal ones the smallest id stays."""
    order = [F.col("start"), F.desc("end"), F.col("fold_id")]
    seen = running(folds, ["path"], order, F.floor(F.col("start") / block).cast("long"),
                   {"_reach": ("max", F.col("end"))}, include_current=False)
    return seen.filter(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


def fold_placeholder(preview: str | Column, line_count: str | Column) -> Column:
    """``/* preview (n lines) */``, without the count for a single line."""
    p = F.coalesce(F.col(preview) if isinstance(preview, str) else preview, F.lit("..."))
    n = F.col(line_count) if isinstance(line_count, str) else line_count
    return F.when(n > 1, F.concat(F.lit("/* "), p, F.lit(" ("), n.cast("string"), F.lit(" lines) */"))).otherwise(
        F.concat(F.lit("/* "), p, F.lit(" */")))


def render_folded(files: DataFrame, folds: DataFrame, types: tuple[str, ...] = DEFAULT_FOLDS) -> DataFrame:
    """File text with each outermost fold of the given kinds replaced by its placeholder.

    Nesting is settled before the kind filter, so a fold of another kind still
    hides those inside it. ``start`` and ``end`` are character offsets, end
    excluded. Outermost folds with text do not share a start, so the list of a
    file is no longer than its content cell.
    """
    active = outermost(folds).filter(F.col("fold_type").isin(*types))
    per_file = active.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(
        "start", "end", fold_placeholder("preview", "line_count").alias("mark")))).alias("_f"))
    joined = files.join(per_file, "path", "left")
    walked = F.aggregate(
        F.coalesce("_f", F.array().cast("array<struct<start:bigint,end:bigint,mark:string>>")),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        # Parts are gathered and joined once; the text so far is not copied for every fold.
        lambda acc, f: F.when(f["start"].cast("long") >= acc["at"], F.struct(
            f["end"].cast("long").alias("at"),
            F.concat(acc["out"], F.array(F.substring(F.col("content"), (acc["at"] + 1).cast("int"),
                                                     (f["start"] - acc["at"]).cast("int")), f["mark"])).alias("out"))).otherwise(acc),
        lambda acc: F.concat(F.array_join(acc["out"], ""),
                             F.substring(F.col("content"), (acc["at"] + 1).cast("int"), F.length("content"))))
    return joined.select(*files.columns, walked.alias("rendered"), F.coalesce(F.size("_f"), F.lit(0)).alias("fold_count"))


def outline(files: DataFrame) -> DataFrame:
    """Scopes of each file: path, language, node_type, name, start_line, end_line, line_count, depth, parent_type, preview, indent.

    Found in one pass per file with a stack (see ``lexical``), so nothing is shuffled. A header may
    run over several lines; what stands in strings and comments is no code. A Python scope ends with its last
    code line, a script's with its closing brace.
    """
    rows = lexical.nested(files, "scopes").select("path", "language", F.inline("scopes"))
    return rows.select("path", "language", "node_type", "name", "start_line", "end_line",
                       (F.col("end_line") - F.col("start_line") + 1).alias("line_count"), "depth", "parent_type", "preview", "indent")
