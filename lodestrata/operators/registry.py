"""User functions: template value functions, computed columns, payload parsers, extractors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.template import FUNCTION_REF
from lodestrata.operators.merge import first_wins, last_wins
from lodestrata.sources.payloads import payload_entries


class ValueFunctions:
    """Named functions for ``{{fn:name}}`` values.

    A startup function gets the startup context and gives one value for the
    whole job. A request function gets the request column and gives a Column.
    The request function wins when both have the name.
    """

    def __init__(self) -> None:
        self._startup: dict[str, Callable] = {}
        self._request: dict[str, Callable[[Column], Column]] = {}

    def register_startup(self, name: str):
        def put(fn):
            self._startup[name] = fn
            return fn
        return put

    def register_request(self, name: str):
        def put(fn):
            self._request[name] = fn
            return fn
        return put

    def apply(self, df: DataFrame, col: str, request: str, context: dict | None = None) -> DataFrame:
        """Replace each ``{{fn:name}}`` value of a column; an unknown name stops the job."""
        ref = F.regexp_extract(F.trim(F.col(col)), FUNCTION_REF, 1)
        out = F.when(ref == "", F.col(col))
        for name, fn in self._request.items():
            out = out.when(ref == name, fn(F.col(request)).cast("string"))
        for name, fn in self._startup.items():
            if name not in self._request:
                out = out.when(ref == name, F.lit(fn(context or {})).cast("string"))
        unknown = F.raise_error(F.concat(F.lit("No resolver registered for '"), ref, F.lit("'"))).cast("string")
        return df.withColumn(col, F.when(F.col(col).isNull(), F.col(col)).otherwise(out.otherwise(unknown)))


class CircularDependencyError(ValueError):
    pass


def with_computed(df: DataFrame, defs: dict[str, tuple[list[str], Callable[..., Column]]]) -> DataFrame:
    """Add computed columns; a definition names the columns it needs and is computed once.

    Definitions are put in levels by need; a cycle is found before any job runs.
    """
    done: set[str] = set(df.columns)
    left = dict(defs)

    def chain(name: str, seen: list[str]) -> list[str]:
        if name in seen:
            return seen[seen.index(name):] + [name]
        for need in left[name][0]:
            if need in left:
                found = chain(need, seen + [name])
                if found:
                    return found
        return []

    out = df
    while left:
        ready = [n for n, (needs, _) in left.items() if all(x in done for x in needs)]
        if not ready:
            for name in left:
                cycle = chain(name, [])
                if cycle:
                    raise CircularDependencyError(" -> ".join(cycle))
            missing = {x for needs, _ in left.values() for x in needs if x not in done and x not in left}
            raise KeyError(f"Computed value needs undefined columns: {sorted(missing)}")
        out = out.withColumns({n: left[n][1](*[F.col(x) for x in left[n][0]]) for n in ready})
        done.update(ready)
        for n in ready:
            del left[n]
    return out


class PayloadParsers:
    """Parsers per variable prefix; a parser turns the payload column into ARRAY<STRUCT<key,value>>."""

    def __init__(self) -> None:
        self._parsers: dict[str, Callable[[Column], Column]] = {}

    def register_parser(self, prefix: str):
        def put(fn: Callable[[Column], Column]):
            self._parsers[prefix] = fn
            return fn
        return put

    def parse(self, variables: DataFrame, override: bool = False) -> DataFrame:
        """Variables (scope, key, value) plus the flattened payload keys, with ``error`` rows kept.

        Without ``override`` a key that is there already stays.
        """
        found = []
        for prefix, parser in self._parsers.items():
            rows = variables.filter(F.col("key") == prefix)
            found.append(parser_rows(rows, prefix, parser))
        base = variables.select("scope", "key", "value", F.lit(None).cast("string").alias("error"), F.lit(0).alias("_o"))
        parsed = reduce(DataFrame.unionByName, found) if found else base.limit(0)
        bad = parsed.filter(F.col("error").isNotNull()).drop("_o")
        good = base.unionByName(parsed.filter(F.col("error").isNull()))
        if override:
            kept = last_wins(good, ["scope", "key"], ["_o"])
        else:
            kept = first_wins(good, ["scope", "key"], ["_o"]).filter(F.col("status") == "SET").drop("status")
        return kept.drop("_o").unionByName(bad)


def parser_rows(rows: DataFrame, prefix: str, parser: Callable[[Column], Column]) -> DataFrame:
    parsed = rows.select("scope", parser(F.col("value")).alias("_p"))
    flat = parsed.select("scope", F.explode_outer("_p.entries").alias("e"), F.col("_p.error").alias("error"))
    key = F.upper(F.concat(F.lit(prefix + "_"), F.col("e.key")))
    return flat.select("scope", F.coalesce(key, F.lit(prefix)).alias("key"), F.col("e.value").alias("value"),
                       "error", F.lit(1).alias("_o"))


def default_parser(col: Column) -> Column:
    """Parser for data-URI payloads in JSON or properties form."""
    return payload_entries(col)


class Extractors:
    """Extractors per language, run over the files of that language and put together."""

    def __init__(self) -> None:
        self._by_language: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register_extractor(self, *languages: str):
        def put(fn: Callable[[DataFrame], DataFrame]):
            for language in languages:
                self._by_language[language] = fn
            return fn
        return put

    def extract(self, files: DataFrame) -> DataFrame:
        parts = [fn(files.filter(F.col("language") == language)) for language, fn in self._by_language.items()]
        return reduce(DataFrame.unionByName, parts)
