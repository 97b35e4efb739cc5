"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import scratch_path

# The six ASCII blanks of the contracts: \x20 and \x09 to \x0D.
BLANK = r"\x20\x09-\x0D"
WORD_RE = f"[^{BLANK}]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Name of the row number the operators carry; see ``numbered``. No input column may have it unless it is that number.
ROW = "__lodestrata_row"
#: Input files up to which a file's place is looked up in the plan; with more, rows are numbered in a table.
FEW_FILES = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, _UPPER, _LOWER)


def _is_plain_scan(df: DataFrame) -> bool:
    """Whether the frame is filters and projections of one scan of files, so that the place in a file names a row."""
    plan = df._jdf.queryExecution().analyzed().toString()
    nodes = {found.group(1) for line in plan.splitlines() if (found := re.match(r"[\s:+-]*(\w+)", line))}
    return nodes <= {"Project", "Filter", "SubqueryAlias", "Relation", "LogicalRelation"} and plan.count("Relation") == 1


def numbered(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` (default: all) of ``df`` with a row number; rows are told apart by it even where a doc_id is null or occurs twice.

    A frame that has the number keeps it. For a plain scan of not too many files it is the place of the row in its
    Parquet file and the place of the file among the sorted inputs: the same in every scan and rerun,
    however the files are split, and without a job. Any other frame (a join, a union, very many files) is
    written once with its numbers. Whoever needs the numbers twice calls this once and goes on from there.
    """
    keep = list(columns or [c for c in df.columns if c != ROW])
    if ROW in df.columns:
        return df.select(*keep, ROW)
    paths = sorted(df.inputFiles()) if _is_plain_scan(df) else []
    if not 0 < len(paths) <= FEW_FILES:
        return saved(df.select(*keep).withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    # One row per input file, FEW_FILES at most.
    files = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit("\n".join(paths)), "\n")).alias("__file", "__path"))
    # The same file is file:/x in one place and file:///x in the other.
    plain = lambda path: F.regexp_replace(path, "^([^:/]+):/+", "$1:/")
    placed = df.select(*keep, F.col("_metadata.file_path").alias("__in"), F.col("_metadata.row_index").alias("__at"))
    number = F.shiftleft(F.col("__file").cast("long"), 40).bitwiseOR(F.col("__at"))
    known = F.when(F.col("__file").isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("unknown input file "), "__in")).cast("long"))
    return placed.join(F.broadcast(files), plain("__in") == plain("__path"), "left").select(*keep, known.alias(ROW))


#: Name of the column that holds a whole document while helper columns stand beside it.
DOC = "__lodestrata_doc"


def packed(docs: DataFrame) -> DataFrame:
    """The row number and the whole document as one struct, so that no column of it can clash with a helper's."""
    return numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(DOC), *([ROW] if ROW in docs.columns else [])))


def fields_of(packed_docs: DataFrame, *columns: str) -> DataFrame:
    """Columns of the packed documents with the row number."""
    return packed_docs.select(*[F.col(DOC).getField(c).alias(c) for c in columns], ROW)


def keep_rows(packed_docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose row number is in ``rows``, with all their columns."""
    kept = rows.select(F.col(ROW).alias("__kept"))
    return packed_docs.join(kept, F.col(ROW) == F.col("__kept"), "left_semi").select(f"{DOC}.*")


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once, as Parquet, in the shared folder of ``spark.checkpoint.dir``, and read again.

    Cuts the lineage: a lost executor cannot change or repeat what was decided. The table
    stays until ``discard`` or until the folder is cleaned with the job.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._saved_at = path
    return found


def discard(df: DataFrame) -> None:
    """Remove a ``saved`` table that nothing reads any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
