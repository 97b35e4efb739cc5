"""Secret scan with DataFrame functions: candidate strings, features, a random forest against false positives.

Candidates are values of any signs (8 or more) behind an assignment to a key word, with or without blanks
and quotes, and runs of key characters (16 or more). Each has features of five kinds:

* length, shares of digits, capitals and small letters, share of distinct characters;
* character transitions: how often the kind of character changes, and the mean log
  probability of its letter pairs under a model of the corpus's own words;
* dictionary coverage: share of characters in letter runs that are frequent words;
* path: whether it stands in a path, URL, host or e-mail address;
* neighbouring words: a key word before it, an assignment, quotes.

The forest (``pyspark.ml``, trees grown and applied in the JVM) is trained from labelled
findings: those given, or else those that plain rules can decide. Rules cannot decide a
hex string in running text, say; the forest judges all candidates, and its probability
is the score.

Words are counted over all documents; letter pairs and dictionary come from these counts.
Bounds, all parameters: the dictionary keeps the ``MAX_WORDS`` most frequent words, and at most ``MAX_PER_CLASS``
findings of each label train the forest. Candidates are taken from whole texts of all documents.

Defined cases: a null text has no candidates; with fewer than ``MIN_PER_CLASS`` findings of a
label there is no forest and the score is 1 where a rule says secret, else 0; repeated rows have their own candidates; candidates that
overlap do not occur (they are taken left to right); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ROW, numbered, saved, table

KEY_WORDS = r"(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
KEY_RUN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}"
#: A value of 8 or more behind a key word, optional quote, blanks, sign, blanks and quote. Up to 32 blanks: look-behinds are bounded.
#: The first look-arounds only leave out places early. A next URL parameter and a closing comma or semicolon do not belong to it.
ASSIGNED_VALUE = (r"""(?<=[=:>\s"'])(?=[^\s"']{8})(?<=[=:>][ \t]{0,32}["']?)"""
                  r"""(?<=(?i:passw(?:or)?d|pwd|secret|token|key)["']?[ \t]{0,32}(?:[=:]|[=:]=|=>)[ \t]{0,32}["']?)"""
                  r"""(?:(?!&[\w.\-]+=|[,;](?:[\s"']|$))[^\s"']){8,}+""")
CANDIDATE = f"{ASSIGNED_VALUE}|{KEY_RUN}"
KNOWN_FORMS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}|sk-[A-Za-z0-9\-_]{20,})$"

BEFORE, AFTER = 60, 30
MAX_WORDS = 20_000
MAX_PER_CLASS = 5_000
MIN_PER_CLASS = 20
TREES, DEPTH, SEED = 30, 7, 42
THRESHOLD = 0.5

FEATURES = ("length", "digits", "capitals", "smalls", "distinct", "changes", "pair_logp", "coverage", "in_path",
            "has_slash", "key_word", "assigned", "quoted", "at_sign")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, row number, nth candidate of the row, its start, the string, and the text before and behind it."""
    rows = numbered(docs, "doc_id", "text").select(
        "doc_id", ROW, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), "text").filter("size(found) > 0")
    rows = rows.withColumn("between", F.split("text", CANDIDATE))
    exploded = rows.select("doc_id", ROW, "found", "between", F.posexplode("found").alias("nth", "secret"))
    lengths = lambda column: F.aggregate(F.transform(column, F.length), F.lit(0), lambda a, x: a + x)
    start = lengths(F.slice("between", 1, F.col("nth") + 1)) + lengths(F.slice("found", 1, F.col("nth")))
    return exploded.select(
        "doc_id", ROW, "nth", start.cast("long").alias("start"), "secret",
        F.right(F.get("between", F.col("nth")), F.lit(BEFORE)).alias("before"),
        F.left(F.get("between", F.col("nth") + 1), F.lit(AFTER)).alias("after"))


def words_of(docs: DataFrame) -> DataFrame:
    """(word, count) of the lower-case words of all documents, combined before the shuffle."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0)))
    return docs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def _pairs(word: Column) -> Column:
    """Two-character pieces of a string."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))


def pair_model(words: DataFrame) -> DataFrame:
    """(pair, logp): log probability of a letter after a letter; plain a-z pairs, so at most 676 rows."""
    pairs = (words.select("count", F.explode(_pairs(F.col("word"))).alias("pair"))
             .filter(F.col("pair").rlike("^[a-z]{2}$")).groupBy("pair").agg(F.sum("count").alias("n")))
    first = pairs.groupBy(F.left("pair", F.lit(1)).alias("first")).agg(F.sum("n").alias("total"))
    return (pairs.join(F.broadcast(first), F.left("pair", F.lit(1)) == F.col("first"))
            .select("pair", F.log((F.col("n") + 1) / (F.col("total") + 26)).alias("logp")))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with all columns of ``FEATURES``."""
    secret, length = F.col("secret"), F.length("secret")
    count = lambda pattern: F.regexp_count(secret, F.lit(pattern))
    changes = count("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")
    plain = found.withColumns({
        "length": length.cast("double"), "digits": count("[0-9]") / length, "capitals": count("[A-Z]") / length,
        "smalls": count("[a-z]") / length, "distinct": F.size(F.array_distinct(F.split(secret, ""))) / length,
        "changes": changes / length,
        "in_path": (F.col("before").rlike(r"(?:://|[/\\.@])\S*$") | F.col("after").rlike(r"^(?:[/\\@]|\.\w)")).cast("double"),
        "has_slash": secret.contains("/").cast("double"),
        "key_word": F.col("before").rlike(rf"(?i){KEY_WORDS}\W*$").cast("double"),
        "assigned": F.col("before").rlike(r"""(?:[=:]|=>)\s*["']?$""").cast("double"),
        "quoted": (F.col("before").rlike("""["']$""") & F.col("after").rlike("""^["']""")).cast("double"),
        "at_sign": (F.col("before").endswith("@") | F.col("after").startswith("@")).cast("double"),
    })
    key = [ROW, "nth"]
    # Letter pairs: at most 676 rows are joined by broadcast; a pair that is no letter pair counts as unlikely.
    pairs = (plain.select(*key, F.explode(_pairs(F.lower(secret))).alias("pair"))
             .join(F.broadcast(pair_model(words)), "pair", "left")
             .groupBy(*key).agg(F.avg(F.coalesce("logp", F.lit(-8.0))).alias("pair_logp")))
    # At most MAX_WORDS words, a parameter.
    dictionary = F.broadcast(words.filter(F.length("word") >= 3).orderBy(F.desc("count"), "word").limit(MAX_WORDS).select("word"))
    runs = F.regexp_extract_all(secret, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))
    covered = (plain.select(*key, F.explode(F.transform(runs, F.lower)).alias("word")).join(dictionary, "word", "left_semi")
               .groupBy(*key).agg(F.sum(F.length("word")).alias("covered")))
    return (plain.join(pairs, key, "left").join(covered, key, "left")
            .withColumn("coverage", F.coalesce(F.col("covered"), F.lit(0)) / length)
            .withColumn("pair_logp", F.coalesce("pair_logp", F.lit(-8.0))).drop("covered"))


def rule_label() -> Column:
    """1.0 for a secret, 0.0 for a false positive, null where plain rules cannot tell."""
    mixed = F.col("secret").rlike("[0-9]") & F.col("secret").rlike("[A-Za-z]")
    return (F.when(F.col("secret").rlike(KNOWN_FORMS), 1.0)
            .when((F.col("in_path") == 1) | (F.col("at_sign") == 1), 0.0)
            .when((F.col("key_word") == 1) & (F.col("assigned") == 1) & mixed, 1.0)
            .when(F.col("secret").rlike(r"^[A-Za-z\-_]+$") & (F.col("assigned") == 0), 0.0)
            .when(F.col("secret").rlike(r"^[0-9\-+_]+$"), 0.0))


def sample_findings(labelled: DataFrame, most: int = MAX_PER_CLASS) -> DataFrame:
    """At most ``most`` findings of each label, by hash of the string and its place."""
    order = [F.xxhash64("secret", "start"), F.col("secret"), F.col("start")]
    sides = [labelled.filter(F.col("label") == v).orderBy(*order).limit(most) for v in (0.0, 1.0)]
    return saved(sides[0].unionByName(sides[1]).select("label", *FEATURES), "findings")


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """One row per candidate: doc_id, start, length, secret, features, score and is_secret.

    ``findings`` may hold labelled findings (secret, start, before, after, label).
    """
    words = saved(words_of(docs), "words")
    rows = saved(features(saved(candidates(docs), "found"), words).withColumn("label", rule_label()), "candidates")
    if findings is None:
        labelled = rows.filter("label IS NOT NULL")
    else:
        given = numbered(findings, "secret", "start", "before", "after", "label").withColumn("nth", F.lit(0))
        labelled = features(given, words)
    training = sample_findings(labelled)
    sides = training.groupBy("label").count().filter(F.col("count") >= MIN_PER_CLASS).count()
    if sides == 2:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=2)
        model = forest.fit(assemble.transform(training.coalesce(1)).select("features", "label"))
        model.setProbabilityCol("probability")
        scored = model.transform(assemble.transform(rows.drop("label")))
        scored = scored.withColumn("score", F.round(vector_to_array("probability")[1], 6))
    else:
        scored = rows.withColumn("score", F.coalesce("label", F.lit(0.0)))
    return scored.select("doc_id", "start", F.col("length").cast("long").alias("length"), "secret",
                         *[c for c in FEATURES if c != "length"], "score", (F.col("score") >= threshold).alias("is_secret"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
