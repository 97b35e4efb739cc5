"""Projection, filters, lookups, paging, and text search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A range of the order is divided until it holds at most this many rows; boundaries per division.
RANGE_ROWS = 50_000
BOUNDS = 48
TOKEN_SPLIT = "[^\\p{L}\\p{N}]+"
# BM25 parameters.
BM25_K1, BM25_B = 1.2, 0.75


def select_fields(df: DataFrame, fields: str, defaults: dict[str, str] | None = None,
                  paths: dict[str, str] | None = None) -> DataFrame:
    """Project a comma list of fields; ``paths`` gives a nested source, ``defaults`` the value for null."""
    defaults, paths = defaults or {}, paths or {}
    out = []
    for name in (f.strip() for f in fields.split(",") if f.strip()):
        col = F.col(paths.get(name, name))
        if name in defaults:
            col = F.coalesce(col, F.lit(defaults[name]))
        out.append(col.alias(name))
    return df.select(*out)


def term(df: DataFrame, field: str, value) -> DataFrame:
    """Rows whose field equals the value."""
    return df.filter(F.col(field) == F.lit(value))


def date_range(df: DataFrame, field: str, gte: str, now: str) -> DataFrame:
    """Rows at or after a date; ``now-1d`` forms count from the given ``now``."""
    return df.filter(date_from(field, gte, now))


def date_from(field: str, gte: str, now: str) -> Column:
    """Predicate of :func:`date_range`. The bound is a constant, so it reaches the scan."""
    units = {"d": "DAY", "h": "HOUR", "m": "MINUTE", "s": "SECOND", "w": "WEEK", "M": "MONTH", "y": "YEAR"}
    if not gte.startswith("now"):
        return F.col(field) >= F.lit(gte).cast("timestamp_ntz")
    bound = F.lit(now).cast("timestamp_ntz")
    shift = gte[3:]
    if shift:
        sign, amount, unit = shift[0], int(shift[1:-1]), units[shift[-1]]
        step = F.expr(f"INTERVAL {amount} {unit}")
        bound = bound - step if sign == "-" else bound + step
    return F.col(field) >= bound


def bool_query(df: DataFrame, must: list[Column] = (), filters: list[Column] = ()) -> DataFrame:
    """Rows that meet every clause; scores, if wanted, come from ``search`` on ``must``."""
    clauses = [*must, *filters]
    return df.filter(reduce(lambda a, b: a & b, clauses)) if clauses else df


def tokens(col: str | Column) -> Column:
    """Lower-case word tokens of a text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: t != "")


def query_terms(text: str) -> list[str]:
    """Distinct tokens of a query text, by the same rule as :func:`tokens`."""
    import regex
    return list(dict.fromkeys(t for t in regex.split(TOKEN_SPLIT, text.lower()) if t))


def matches(field: str, text: str) -> Column:
    """Predicate: any query token is among the field's tokens."""
    return F.arrays_overlap(tokens(field), F.array(*[F.lit(t) for t in query_terms(text)]))


def match(df: DataFrame, field: str, text: str) -> DataFrame:
    """Rows where any query token is present in the field."""
    return df.filter(matches(field, text))


def search(df: DataFrame, text: str, fields: list[str], size: int, id_col: str,
           index: str | None = None) -> DataFrame:
    """Ranked search: BM25 per field, best field per row, best ``size`` rows.

    Term frequencies of the few query terms are counted in the row, so the
    corpus is never exploded or shuffled: one aggregate gives the corpus
    statistics, one top-n gives the hits. ``total`` is the number of all hits.
    """
    terms = query_terms(text)

    def count_terms(rows: DataFrame) -> DataFrame:
        for f in fields:
            rows = rows.withColumn(f"_tok_{f}", tokens(f))
        return rows.withColumns({
            **{f"_dl_{f}": F.size(f"_tok_{f}") for f in fields},
            **{f"_tf_{f}": F.array(*[F.size(F.filter(f"_tok_{f}", _equals(q))) for q in terms]) for f in fields}
        }).drop(*[f"_tok_{f}" for f in fields])

    counted = count_terms(df)
    # A row without the term's letters cannot hold it: most rows are not taken apart a second time.
    possible = reduce(lambda a, b: a | b, [F.lower(f).contains(q) for f in fields for q in terms])
    hit = reduce(lambda a, b: a | b, [F.exists(f"_tf_{f}", lambda n: n > 0) for f in fields])
    stats = counted.agg(
        F.struct(
            F.count_if(hit).alias("total"),
            *[F.count_if(F.col(f"_dl_{f}") > 0).alias(f"n_{f}") for f in fields],
            *[F.avg(F.when(F.col(f"_dl_{f}") > 0, F.col(f"_dl_{f}"))).alias(f"avg_{f}") for f in fields],
            *[F.count_if(F.col(f"_tf_{f}")[i] > 0).alias(f"df_{f}_{i}")
              for f in fields for i in range(len(terms))]).alias("s")).scalar()
    # Hits sort first and the rest is cut after the top-n: as a filter below it, the
    # hit test would be moved under the projection and take every text apart again.
    scored = count_terms(df.filter(possible)).withColumns({"_s": stats, "_hit": hit})
    per_field = []
    for f in fields:
        parts = []
        for i in range(len(terms)):
            n, d = F.col(f"_s.n_{f}"), F.col(f"_s.df_{f}_{i}")
            idf = F.log(F.lit(1.0) + (n - d + 0.5) / (d + 0.5))
            tf = F.col(f"_tf_{f}")[i]
            norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col(f"_dl_{f}") / F.col(f"_s.avg_{f}"))
            parts.append(F.when(tf > 0, idf * tf * (BM25_K1 + 1) / (tf + norm)).otherwise(F.lit(0.0)))
        per_field.append(reduce(lambda a, b: a + b, parts))
    score = F.greatest(*per_field) if len(per_field) > 1 else per_field[0]
    return (scored.withColumn("_score", F.round(score, 6))
            .orderBy(F.desc("_hit"), F.desc("_score"), F.asc(id_col)).limit(size).filter("_hit")
            .select(F.col(id_col).alias("_id"), F.lit(index).alias("_index"), "_score",
                    F.col("_s.total").alias("total"),
                    F.struct(*[c for c in df.columns if c != id_col]).alias("_source")))


def _equals(term_text: str):
    return lambda t: t == F.lit(term_text)


def match_all(df: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """First ``size`` rows in a given order."""
    return df.orderBy(*order).limit(size)


def get_by_id(df: DataFrame, id_col: str, *values) -> DataFrame:
    """Rows with one of the ids; unknown ids give no row."""
    return df.filter(F.col(id_col).isin(*values)) if len(values) != 1 else df.filter(F.col(id_col) == values[0])


def _after(order: list[str], boundary: tuple) -> Column:
    """Whether a row comes at or after the boundary in the order (``-name``: descending; nulls as Spark sorts them)."""
    test = F.lit(True)
    for name, value in reversed(list(zip(order, boundary))):
        col, known = F.col(name.lstrip("-")), F.lit(value)
        if name.startswith("-"):
            later = F.lit(False) if value is None else col.isNull() | (col < known)
        else:
            later = col.isNotNull() if value is None else F.coalesce(col > known, F.lit(False))
        test = later | (col.eqNullSafe(known) & test)
    return test


def _sorting(order: list[str]) -> list[Column]:
    return [F.desc(name[1:]) if name.startswith("-") else F.asc(name) for name in order]


def order_range(df: DataFrame, order: list[str], skip: int, limit: int, most: int = RANGE_ROWS) -> tuple[DataFrame, int, int]:
    """The range of the order that holds a page: its rows, the rows before it, and the number of all rows.

    A histogram: ``BOUNDS`` rows with the smallest hashes are the boundaries, one pass counts the rows between them, and
    only the ranges that meet the page are gone on with, until they hold ``most`` rows. Each round is one
    scan of the order columns with a filter on the range; the driver sees boundaries and counts.
    """
    keys = [name.lstrip("-") for name in order]
    rows, before, inside = df, 0, None
    total = size = df.count()
    while size > max(most, 2 * limit):
        sample = rows.select(*keys).orderBy(F.xxhash64(*keys)).limit(BOUNDS).distinct().orderBy(*_sorting(order)).collect()
        bounds = [tuple(r) for r in sample]
        place = reduce(lambda a, b: a + b, [_after(order, b).cast("int") for b in bounds])
        counts = {r["p"]: r["count"] for r in rows.groupBy(place.alias("p")).count().collect()}
        ends, at = [], before
        for p in range(len(bounds) + 1):
            ends.append((p, at, at + counts.get(p, 0)))
            at = ends[-1][2]
        met = [p for p, a, b in ends if a < skip + limit and b > skip]
        if not met:
            return df.limit(0), before, total
        low, high = met[0], met[-1]
        if ends[high][2] - ends[low][1] == size:
            break  # equal rows, or a page as long as the range
        before, size = ends[low][1], ends[high][2] - ends[low][1]
        tests = ([_after(order, bounds[low - 1])] if low else []) + ([~_after(order, bounds[high])] if high < len(bounds) else [])
        inside = reduce(lambda a, b: a & b, tests, inside if inside is not None else F.lit(True))
        rows = df.filter(inside)
    return rows, before, total


def page_offset(df: DataFrame, order: list[str], skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` in an order that must be total (``-name`` sorts descending).

    A page at any depth is a top-n of the one range that holds it; nothing is sorted as a whole or written.
    """
    rows, before, _ = order_range(df, order, skip, limit)
    return rows.orderBy(*_sorting(order)).offset(max(0, skip - before)).limit(limit)


def paginate(df: DataFrame, order: list[str], page: int, page_size: int) -> DataFrame:
    """One numbered page with ``total`` and ``total_pages`` on every row."""
    skip = (page - 1) * page_size
    rows, before, total = order_range(df, order, skip, page_size)
    return rows.orderBy(*_sorting(order)).offset(max(0, skip - before)).limit(page_size).withColumns({
        "page": F.lit(page), "page_size": F.lit(page_size), "total": F.lit(total).cast("long"),
        "total_pages": F.lit(-(-total // page_size)).cast("long")})


def latest(df: DataFrame, order_col: str, n: int, tie: str) -> DataFrame:
    """The ``n`` newest rows; ``tie`` orders rows of the same date."""
    return df.orderBy(F.desc(order_col), F.asc(tie)).limit(n)


def glob_regex(pattern: str) -> str:
    """Anchored regex of a key glob: ``*``, ``?``, ``[...]`` and ``\\`` escapes."""
    import re
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += "[\\s\\S]*"
        elif ch == "?":
            out += "[\\s\\S]"
        elif ch == "[" and "]" in pattern[i + 1:]:
            end = pattern.index("]", i + 1)
            out += "[" + pattern[i + 1:end].replace("\\", "\\\\") + "]"
            i = end
        elif ch == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(ch)
        i += 1
    return f"^{out}$"


def match_keys(df: DataFrame, key: str, pattern: str = "*", limit: int = 100) -> DataFrame:
    """Keys that fit a glob, the first ``limit`` in key order."""
    return df.filter(F.col(key).rlike(glob_regex(pattern))).select(key).distinct().orderBy(key).limit(limit)
