"""Column expressions over keys, values, codes, paths and URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Key names and value prefixes that mark a secret.
SENSITIVE_KEYS = ("KEY", "SECRET", "PASSWORD", "TOKEN", "CREDENTIAL", "AUTH", "PRIVATE")
SENSITIVE_PREFIXES = ("sk-", "pk-", "Bearer ", "Basic ", "eyJ")
# Headers whose value is masked, truthy words, redaction text.
SENSITIVE_HEADERS = ("authorization", "x-api-key", "api-key", "token", "secret")
TRUE_WORDS = ("true", "1", "yes", "on")
REDACTED = "[REDACTED]"
# File extensions per language.
EXTENSIONS = {
    "python": ("py", "pyi"),
    "javascript": ("js", "mjs", "cjs", "jsx"),
    "typescript": ("ts", "tsx", "mts", "cts"),
}
UUID_PATTERN = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- keys and phrases -------------------------------------------------------

def key_name(col: str | Column, case: str = "snake") -> Column:
    """Normalise a key: camelCase split, other characters to ``_``, collapsed and trimmed."""
    out = F.regexp_replace(F.trim(_c(col)), "([a-z])([A-Z])", "$1_$2")
    out = F.regexp_replace(out, "[^a-zA-Z0-9_]", "_")
    out = F.regexp_replace(out, "_+", "_")
    out = F.regexp_replace(out, "^_|_$", "")
    if case == "upper":
        return F.upper(out)
    if case == "kebab":
        return F.translate(F.lower(out), "_", "-")
    return F.lower(out)


def clean_columns(df: DataFrame, case: str = "snake") -> DataFrame:
    """Rename every column by the rules of :func:`key_name`."""
    one = df.sparkSession.range(1).select(
        *[key_name(F.lit(c), case).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return df.toDF(*one.first())


def _phrase(col: str | Column) -> Column:
    out = F.regexp_replace(_c(col), "[^a-zA-Z0-9$\\s]", " ")
    return F.regexp_replace(out, "([a-z])([A-Z])", "$1 $2")


def upper_case(col: str | Column) -> Column:
    """Phrase in upper case; only letters, digits, ``$`` and single blanks stay."""
    return F.trim(F.regexp_replace(F.upper(_phrase(col)), "\\s+", " "))


def lower_case(col: str | Column) -> Column:
    """Phrase in lower case; only letters, digits, ``$`` and single blanks stay."""
    return F.trim(F.regexp_replace(F.lower(_phrase(col)), "\\s+", " "))


# --- typed reads ------------------------------------------------------------

def to_text(df: DataFrame, name: str) -> Column:
    """Text of a column by its type: null is '', collections become JSON."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        return F.coalesce(F.to_json(name), F.lit(""))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def to_bool(col: str | Column, default: bool = False) -> Column:
    """True for true / 1 / yes / on in any case; null takes the default."""
    return F.coalesce(F.lower(_c(col)).isin(*TRUE_WORDS), F.lit(default))


def to_int(col: str | Column, default: int = 0) -> Column:
    """Whole number; a value that is none (also ``1.5``) takes the default."""
    text = F.trim(_c(col).cast("string"))
    whole = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))
    return F.coalesce(whole, F.lit(default).cast("long"))


def to_float(col: str | Column, default: float = 0.0) -> Column:
    """Number; a bad value takes the default."""
    return F.coalesce(F.trim(_c(col).cast("string")).try_cast("double"), F.lit(default))


# --- masking ----------------------------------------------------------------

def is_sensitive_key(key: str | Column) -> Column:
    return _c(key).rlike("(?i)" + "|".join(SENSITIVE_KEYS))


def is_sensitive_value(value: str | Column) -> Column:
    return reduce(lambda a, b: a | b, [_c(value).startswith(p) for p in SENSITIVE_PREFIXES])


def redact(key: str | Column, value: str | Column) -> Column:
    """The value, or ``[REDACTED]`` when the key or the value marks a secret; '' stays ''."""
    v = _c(value)
    secret = is_sensitive_key(key) | is_sensitive_value(v)
    return F.when((v != "") & secret, F.lit(REDACTED)).otherwise(v)


def mask_tail(col: str | Column, visible: int = 10) -> Column:
    """First characters, then one ``*`` for each that is hidden."""
    c = _c(col)
    n = F.length(c)
    return (F.when(c.isNull() | (c == ""), F.lit("<empty>"))
            .when(n <= visible, F.repeat(F.lit("*"), n))
            .otherwise(F.concat(F.substring(c, 1, visible), F.repeat(F.lit("*"), n - visible))))


def mask_preview(col: str | Column, visible: int = 20) -> Column:
    """First characters and ``...``; a short value becomes ``****``, an empty one null."""
    c = _c(col)
    return (F.when(c == "", F.lit(None).cast("string"))
            .when(F.length(c) <= visible, F.lit("****"))
            .otherwise(F.concat(F.substring(c, 1, visible), F.lit("..."))))


def mask_map(col: str | Column, keys: tuple[str, ...] = SENSITIVE_HEADERS) -> Column:
    """Mask the values of the listed keys (any case) in a map column."""
    return F.transform_values(_c(col), lambda k, v: F.when(
        F.lower(k).isin(*keys),
        F.when(F.length(v) <= 20, F.lit("****")).otherwise(
            F.concat(F.substring(v, 1, 20), F.lit("...")))).otherwise(v))


def truncate(col: str | Column, n: int = 500, tail: str = "... (truncated)", total: bool = False) -> Column:
    """Cut long text and mark the cut; with ``total`` the mark counts towards ``n``."""
    c = _c(col)
    keep = n - len(tail) if total else n
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, keep), F.lit(tail))).otherwise(c)


def scope_preview(col: str | Column, n: int = 120) -> Column:
    """Trimmed first line, cut to ``n`` characters with ``...``."""
    return truncate(F.trim(F.split_part(_c(col), F.lit("\n"), F.lit(1))), n, "...", total=True)


# --- classes of codes, messages, names ---------------------------------------

def status_class(code: str | Column) -> Column:
    """Class of an HTTP status; 3xx and anything below 200 is ``error``."""
    c = _c(code)
    return (F.when((c >= 200) & (c < 300), "connected")
            .when(c.isin(401, 403), "unauthorized")
            .when((c >= 400) & (c < 500), "client_error")
            .when(c >= 500, "server_error")
            .otherwise("error"))


def error_class(message: str | Column, code: str | Column | None = None) -> Column:
    """Class of a connection error message; the first matching row decides."""
    m = F.lower(_c(message))

    def has(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [m.contains(w) for w in words])

    out = (F.when(has("getaddrinfo", "enotfound"), "DNS_ERROR")
           .when(has("econnrefused"), "CONNECTION_REFUSED")
           .when(has("timeout", "etimedout"), "CONNECTION_TIMEOUT")
           .when(has("certificate", "ssl", "pkix"), "SSL_ERROR"))
    if code is not None:
        out = out.when(_c(code) == 401, "AUTH_ERROR")
    return out.otherwise("ERROR")


def extension_of(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(_c(path), "[^/]\\.([A-Za-z0-9_]+)$", 1))


def language_of(path: str | Column) -> Column:
    """Language by file extension; null when unknown."""
    ext = extension_of(path)
    out = F.lit(None).cast("string")
    for language, names in EXTENSIONS.items():
        out = F.when(ext.isin(*names), language).otherwise(out)
    return out


def base_name(path: str | Column) -> Column:
    return F.substring_index(_c(path), "/", -1)


def file_role(path: str | Column) -> Column:
    """Role by name and folder. The tests are substring tests, in this order."""
    name = F.lower(base_name(path))
    parts = F.split(_c(path), "/")

    def named(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [name.contains(w) for w in words])

    return (F.when(named("test", "spec") | F.array_contains(parts, "tests"), "test")
            .when(named("model", "schema", "entity") | F.array_contains(parts, "models"), "model")
            .when(named("controller", "route", "api") | F.array_contains(parts, "view"), "controller")
            .when(named("service", "manager"), "service")
            .when(named("util", "helper") | F.array_contains(parts, "common"), "utility")
            .when(named("config", "setting"), "config")
            .otherwise("unknown"))


def rule_title(condition: str | Column, function: str | Column) -> Column:
    """Title of a guard condition by ordered text tests."""
    c = _c(condition)
    kind = (F.when(c.contains("not in"), "Required field check")
            .when(c.contains("is None") | c.contains("== None"), "Null check")
            .when(c.contains("<") | c.contains(">"), "Range/boundary validation")
            .when(c.contains("len("), "Length validation")
            .when(c.contains("isinstance"), "Type validation")
            .otherwise("Validation"))
    return F.concat(kind, F.lit(" in "), _c(function))


def rule_text(condition: str | Column) -> Column:
    """Business reading of a guard condition."""
    c = _c(condition)
    pieces = F.split(c, "not in")
    field = F.regexp_replace(F.trim(pieces[0]), "^[\"']+|[\"']+$", "")
    low, high = c.contains("<"), c.contains(">")
    return (F.when(F.size(pieces) == 2, F.concat(F.lit("Field '"), field, F.lit("' is required")))
            .when(c.contains("is None") | c.contains("== None"), "Value must not be null")
            .when(low & ~high, "Value must meet minimum threshold")
            .when(high & ~low, "Value must not exceed maximum threshold")
            .when(c.contains("len("), "Value must meet length requirements")
            .when(c.contains("isinstance"), "Value must be of correct type")
            .otherwise(F.concat(F.lit("Condition: "), c)))


def script_rule_text(condition: str | Column, message: str | Column) -> Column:
    """Business reading of a script (JS / TS) guard and its message."""
    c, m = F.lower(_c(condition)), F.lower(_c(message))
    kind = F.regexp_extract(c, "typeof\\s+\\w+\\s*[!=]==?\\s*['\"](\\w+)['\"]", 1)
    nullish = reduce(lambda a, b: a | b, [c.contains(w) for w in (
        "=== undefined", "=== null", "== null", "== undefined")])
    return (F.when(nullish, "Value must not be null/undefined")
            .when(kind != "", F.concat(F.lit("Value must be of type "), kind))
            .when(m.contains("required") | m.contains("missing"), "Required field validation")
            .when(m.contains("not found") | m.contains("not defined"), "Existence check")
            .when(m.contains("cannot be"), "Content type restriction")
            .otherwise("Validation constraint"))


def first_line(col: str | Column) -> Column:
    """First line of a docstring, trimmed."""
    return F.trim(F.split_part(_c(col), F.lit("\n"), F.lit(1)))


def short_path(col: str | Column) -> Column:
    """Last three parts of a path."""
    parts = F.split(F.translate(_c(col), "\\", "/"), "/")
    return F.when(F.size(parts) > 3, F.array_join(F.slice(parts, -3, 3), "/")).otherwise(_c(col))


# --- URLs and records ---------------------------------------------------------

def percent_encode(col: str | Column) -> Column:
    """RFC 3986 percent encoding with no safe characters beyond the unreserved ones."""
    out = F.regexp_replace(F.url_encode(_c(col)), "\\+", "%20")
    return F.regexp_replace(F.regexp_replace(out, "\\*", "%2A"), "%7E", "~")


def build_url(base: str | Column, endpoint: str | Column,
              username: str | Column | None = None, email: str | Column | None = None) -> Column:
    """Join base and endpoint with one slash; put encoded values for ``:username`` etc."""
    path = _c(endpoint)
    for mark, value in ((":username", username), (":email", email), (":user", username)):
        if value is not None:
            v = F.when(_c(value) != "", percent_encode(value))
            path = F.coalesce(F.replace(path, F.lit(mark), v), path)
    return F.concat(F.rtrim(_c(base), F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/")))


def parse_conn_url(col: str | Column) -> Column:
    """Split a connection URL into scheme, host, port, user, database, query; TLS by scheme."""
    c = _c(col)

    def part(name: str) -> Column:
        return F.try_parse_url(c, F.lit(name))

    user_info = part("USERINFO")
    authority = part("AUTHORITY")
    scheme = F.lower(part("PROTOCOL"))
    return F.struct(
        scheme.alias("scheme"),
        part("HOST").alias("host"),
        F.nullif(F.regexp_extract(authority, ":([0-9]+)$", 1), F.lit("")).try_cast("int").alias("port"),
        F.nullif(F.split_part(user_info, F.lit(":"), F.lit(1)), F.lit("")).alias("user"),
        F.nullif(F.ltrim(part("PATH"), F.lit("/")), F.lit("")).alias("database"),
        part("QUERY").alias("query"),
        scheme.isin("rediss", "https", "postgresqls", "mysqls").alias("tls"))


def record_errors(header: str | Column, present: dict[str, Column]) -> Column:
    """Problems of one record: missing parts, missing header keys, bad id, bad time.

    ``header`` is a struct with text fields id, version and created_at;
    ``present`` says per part (header, metadata, payload) whether it is there.
    """
    h = _c(header)
    problems = [F.when(~there, F.lit(f"Missing required key: {name}")) for name, there in present.items()]
    for name in ("id", "version", "created_at"):
        problems.append(F.when(h[name].isNull(), F.lit(f"Missing required header key: {name}")))
    problems.append(F.when(~h["id"].rlike(UUID_PATTERN), F.lit("Invalid UUID format")))
    problems.append(F.when(h["created_at"].isNotNull() & F.try_to_timestamp(h["created_at"]).isNull(),
                           F.lit("Invalid created_at")))
    return F.array_compact(F.array(*problems))


def validate_records(df: DataFrame, header: str = "header",
                     parts: tuple[str, ...] = ("header", "metadata", "payload")) -> DataFrame:
    """Add ``errors`` (list of text) and ``valid``."""
    errors = record_errors(header, {p: F.col(p).isNotNull() for p in parts})
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def find_sensitive(df: DataFrame) -> DataFrame:
    """Per text column: rows whose name or value marks a secret, and how many values do."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    counts = df.agg(*[F.count_if(is_sensitive_value(n)).alias(f"v{i}") for i, n in enumerate(names)],
                    *[F.count(n).alias(f"n{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"),
                              is_sensitive_key(F.lit(n)).alias("sensitive_key"),
                              F.col(f"v{i}").alias("sensitive_values"),
                              F.col(f"n{i}").alias("values")) for i, n in enumerate(names)])
    return counts.select(F.inline(rows)).withColumn(
        "redacted", F.when(F.col("sensitive_key"), F.col("values")).otherwise(F.col("sensitive_values")))
