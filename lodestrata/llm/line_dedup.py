"""Fuzzy line deduplication with DataFrame functions only.

1. Texts are cut into lines; a line is normalised (lower case, blanks at its ends cut) and
   hashed. In the line's row its pairs of neighbouring words give the 64-bit SimHash: the 64 counters
   are eight sums of packed 7-bit lanes.
2. Lines with equal normalised text are one class from here on (map-side combined), so a
   line that occurs a million times is one row. Texts are not shuffled.
3. The fingerprint is cut into four blocks of 16 bits. Two fingerprints that differ in at most 3
   bits agree in a whole block (pigeonhole), so classes are joined on (block, value) and a pair
   goes on if at most ``MOST_BITS`` bits differ. That finds every pair within 3 bits and
   those up to ``MOST_BITS`` that have one block in common: changes that are few against the
   length of a line. In shorter lines one word moves more bits than that, so the words are blocks too:
   a line is cut into four quarters of its words, and classes are joined on all quarters but one, in lines of ``PAIRED``
   words and more on any two quarters. Words that change in place in one quarter (two in
   longer lines) leave a key as it was; every class of a key is compared with the key's smallest.
4. Pairs are verified by edit similarity: 1 - Levenshtein distance / longer length, at least
   ``SIMILARITY``, in characters, or in words where a line is longer than ``LONG_CHARS``.
5. Connected groups keep one occurrence, that of the smallest (doc_id, row, line number).

Large groups of similar lines are not compared pair by pair. First every class is compared
with its neighbour in the order of the fingerprint in each of its four buckets, a linear number
of pairs, and what this connects becomes one component. Then, in a bucket that a component dominates, only
the classes outside of it are compared with the bucket's rows; pairs inside one component
cannot change the result and are skipped. There are 262,144 buckets at most, so the table
of dominating components is small enough to broadcast at any size.

Defined cases: a line without letters and digits (blank, rules, "***") is never compared
and always stays, with null group columns; a null text has no lines; null doc_ids sort
last; repeated rows are rows of their own, the first one keeps its lines; an empty table gives an empty
result; extra columns are ignored. A document that loses all its lines stays, with an empty
text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import DOC, ROW, discard, fields_of, numbered, packed, saved, table
from lodestrata.llm.components import connected_components

SIMILARITY = 0.8
MOST_BITS = 12
LONG_CHARS = 1000
BLOCKS = 4
BLOCK_BITS = 16
#: A component is skipped in buckets where it has at least this many classes; changes the work, not the result.
DOMINANT = 32

#: Words from which two equal quarters are a key; in shorter lines it takes three.
PAIRED = 16
#: Keys of quarters of a line.
QUARTER_KEYS = [f"k{i}" for i in range(6)]

#: Slots of the filters for documents and lines whose texts are compared.
SLOTS = 1 << 20
#: Edits looked for before the whole band of the limit is.
NARROW = 32

#: A sum has eight lanes of a byte. Up to 127 pairs of words are in one sum, so a lane keeps its top bit free.
LANES = 0x0101010101010101
LOW_LANES = 0x0001010101010101
SEGMENT = 127


def units(text: Column) -> Column:
    """Lines of a text; joined by line ends they are the text again."""
    return F.split(text, "\n")


def remaining(lines: Column, drop: Column) -> Column:
    """The lines whose place is not in the sorted list ``drop``: the stretches between the dropped ones, put together."""
    starts = F.concat(F.array(F.lit(-1)), drop)
    ends = F.concat(drop, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def normalise(line: Column) -> Column:
    return F.btrim(F.lower(line), F.lit(" \t\r"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row number, line number and normalised text of every line that has letters or digits."""
    exploded = numbered(docs, "doc_id", "text").select("doc_id", ROW, F.posexplode(units(F.col("text"))).alias("line_no", "line"))
    return exploded.select("doc_id", ROW, "line_no", normalise(F.col("line")).alias("norm")).filter(F.col("norm").rlike(r"[\p{L}\p{N}]"))


def _or(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x.bitwiseOR(y), columns)


def _bit(b: int) -> Column:
    return F.lit(1 << b if b < 63 else -(1 << 63))


def _majority_of_lanes(n: Column, sums: Column) -> Column:
    """Bits set in more than half of ``n``, from a struct of eight sums; bit k + 8 j is lane j of sum k.

    Adding 127 - n div 2 to every lane sets its top bit where the count is above n div 2. The
    last lane is compared by itself, because its top bit would be the sign.
    """
    add = (F.lit(SEGMENT) - F.shiftright(n, 1)) * F.lit(LOW_LANES)
    found = []
    for k in range(8):
        low = sums[f"s{k}"].bitwiseAND((1 << 56) - 1) + add
        found.append(F.shiftleft(F.shiftrightunsigned(low.bitwiseAND(LOW_LANES << 7), 7), k))
        found.append(F.when(F.shiftrightunsigned(sums[f"s{k}"], 56) * 2 > n, _bit(k + 56)).otherwise(F.lit(0)))
    return _or(found)


def quarters(words: Column) -> list[Column]:
    """Hashes of the four quarters of the words of a line; null where a quarter has no word."""
    n = F.size(words)
    cuts = [F.floor(n * F.lit(j) / F.lit(4)).cast("int") for j in range(5)]
    return [F.when(cuts[j + 1] > cuts[j], F.xxhash64(F.slice(words, cuts[j] + 1, cuts[j + 1] - cuts[j]))) for j in range(4)]


def quarter_keys(n: Column, quarter: list[Column]) -> list[Column]:
    """Hashes of the words of a line of ``n`` words without one of its quarters, or of two quarters; null where there is no such key.

    In lines of at most four words a quarter is a word or nothing, and the hash of all words is a key as well, so a
    word more or less is found too.
    """
    without = [F.when((n > 1) & (n < PAIRED) & quarter[j].isNotNull(), F.xxhash64(*[q for i, q in enumerate(quarter) if i != j])) for j in range(4)]
    short = [*without, F.when(n < 5, F.xxhash64(*quarter)), F.lit(None).cast("long")]
    pairs = [F.xxhash64(F.lit(i), F.lit(j), quarter[i], quarter[j]) for i in range(4) for j in range(i)]
    return [F.when(n >= PAIRED, p).otherwise(s).alias(k) for p, s, k in zip(pairs, short, QUARTER_KEYS)]


def fingerprinted(lines: DataFrame) -> DataFrame:
    """doc_id, row number, line_no, h (hash of the normalised text), chars, keys of quarters and SimHash ``sim`` of every line.

    The features are pairs of neighbouring words (the last word by itself), counted in the line's row, so nothing
    is multiplied or shuffled. Up to ``SEGMENT`` of them are counted in eight sums of packed lanes; a line of more has
    several such segments, summed lane by lane.
    """
    line, of_line = ["doc_id", ROW, "line_no", "h", "chars"], ["doc_id", ROW, "line_no", "h", "chars", *QUARTER_KEYS]
    # Words and quarters are columns of their own: written into the keys, a line would be split again in every use.
    split = lines.select("doc_id", ROW, "line_no", F.xxhash64("norm").alias("h"), F.length("norm").alias("chars"), F.split("norm", " ").alias("words"))
    cut = split.select(*line, "words", *[q.alias(f"q{j}") for j, q in enumerate(quarters(F.col("words")))])
    following = F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))
    hashed = cut.select(*line, *quarter_keys(F.size("words"), [F.col(f"q{j}") for j in range(4)]),
                        F.zip_with("words", following, lambda a, b: F.xxhash64(a, b)).alias("pairs"))

    def lane_sum(segment: Column, k: int) -> Column:
        return F.aggregate(segment, F.lit(0).cast("long"), lambda s, x: s + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(LANES)))

    def count(b: int) -> Column:
        return F.aggregate("segments", F.lit(0).cast("long"), lambda c, s: c + F.shiftrightunsigned(s[f"s{b % 8}"], b - b % 8).bitwiseAND(255))

    starts = F.sequence(F.lit(1), F.size("pairs"), F.lit(SEGMENT))
    n = F.size("pairs").cast("long")
    summed = hashed.select(*of_line, n.alias("n"), F.transform(starts, lambda at: F.struct(
        *[lane_sum(F.slice("pairs", at, SEGMENT), k).alias(f"s{k}") for k in range(8)])).alias("segments"))
    long = _or([F.when(count(b) * 2 > F.col("n"), _bit(b)).otherwise(F.lit(0)) for b in range(64)])
    return summed.select(*of_line, F.when(F.col("n") <= SEGMENT, _majority_of_lanes(F.col("n"), F.col("segments")[0])).otherwise(long).alias("sim"))


def _block(q: int) -> Column:
    return F.shiftrightunsigned("sim", BLOCK_BITS * q).bitwiseAND((1 << BLOCK_BITS) - 1)


def _may_be_near(similarity: float) -> Column:
    """At most ``MOST_BITS`` bits differ, and the lengths allow the similarity (where characters count)."""
    shorter, longer = F.least("a_chars", "b_chars"), F.greatest("a_chars", "b_chars")
    lengths = (shorter >= F.lit(similarity - 1e-9) * longer) | (longer > LONG_CHARS)
    return (F.bit_count(F.col("a_sim").bitwiseXOR(F.col("b_sim"))) <= MOST_BITS) & lengths


def chain_pairs(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Each class with the next one of its bucket in the order of the fingerprint: at most four pairs a class.

    Members of a large family of similar lines stand next to each other there. Buckets are cut by four
    more bits, so that one family is several tasks; what this parts is left to ``block_pairs``.
    """
    around = [F.shiftleft("sim", 64 - BLOCK_BITS * q).bitwiseOR(F.shiftrightunsigned("sim", BLOCK_BITS * q)) if q else F.col("sim")
              for q in range(BLOCKS)]  # block q in the lowest bits
    turns = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), a.alias("t")) for q, a in enumerate(around)]))
    rows = classes.select("h", "sim", "chars", turns.alias("k")).select(
        F.col("h").alias("a"), F.col("sim").alias("a_sim"), F.col("chars").alias("a_chars"),
        F.col("k.t").bitwiseAND((1 << BLOCK_BITS + 4) - 1).bitwiseOR(F.shiftleft("k.q", BLOCK_BITS + 4)).alias("key"), "k.t")
    order = Window.partitionBy("key").orderBy("t", "a")
    return (rows.select("a", "a_sim", "a_chars", *[F.lag(f"a{c}").over(order).alias(f"b{c}") for c in ("", "_sim", "_chars")])
            .filter(F.col("b").isNotNull() & _may_be_near(similarity)).select("a", "b").distinct())


def quarter_pairs(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Each class with the smallest one that has a key of quarters in common: at most six pairs a class."""
    keyed = classes.select("h", "chars", F.explode(F.array(*QUARTER_KEYS)).alias("key")).filter(F.col("key").isNotNull())
    # Numbers only, so the keys are combined by hash and not by sorting.
    hubs = keyed.groupBy("key").agg(F.min("h").alias("hub"), F.max("h").alias("last"), F.min_by("chars", "h").alias("hub_chars")).filter("hub <> last")
    shorter, longer = F.least("chars", "hub_chars"), F.greatest("chars", "hub_chars")
    lengths = (shorter >= F.lit(similarity - 1e-9) * longer) | (longer > LONG_CHARS)
    return saved(keyed.join(hubs.drop("last"), "key").filter(lengths & (F.col("h") != F.col("hub")))
                 .select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b")).distinct(), "quarters")


def block_pairs(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of classes of different components that share a block and may be near."""
    key = F.explode(F.array(*[_block(q).bitwiseOR(F.lit(q << BLOCK_BITS)).cast("int") for q in range(BLOCKS)]))
    rows = classes.select("h", "sim", "chars", "component", key.alias("key"))
    crowd = rows.groupBy("key", "component").count().filter(F.col("count") >= DOMINANT)
    # One row per bucket at most, of which there are BLOCKS * 2^BLOCK_BITS.
    major = F.broadcast(saved(crowd.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("major")), "major"))
    marked = rows.join(major, "key", "left").withColumn("inside", F.coalesce(F.col("component") == F.col("major"), F.lit(False)))

    def side(name: str) -> list[Column]:
        return [F.col("h").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("sim", "chars", "component")]]

    left = marked.filter("NOT inside").select("key", *side("a"))
    right = marked.select("key", "inside", *side("b"))
    return (left.join(right, "key")
            .filter(_may_be_near(similarity) & (F.col("a_component") != F.col("b_component"))
                    & (F.col("inside") | (F.col("a") < F.col("b"))))
            .select("a", "b").distinct())


def _word_codes(norm: Column) -> Column:
    """A text with one character per word: the word's hash as a code point below the surrogates."""
    code = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xD7FF)) + 1), 4, "0")
    return F.decode(F.unhex(F.array_join(F.transform(F.split(norm, " "), code), "")), "UTF-16BE")


def similar(a: Column, b: Column, similarity: float = SIMILARITY, a_codes: Column | None = None, b_codes: Column | None = None,
            longest: Column | None = None) -> Column:
    """Whether the edit similarity of two normalised lines is at least ``similarity``.

    Texts of one character per word (``_word_codes``) and the length of the longest word may be given. A word changed, put in
    or taken out costs at most its length and a blank, so few changes of words prove the similarity in characters
    without comparing these (one word is allowed for in case two have one code).
    """
    a_codes = _word_codes(a) if a_codes is None else a_codes
    b_codes = _word_codes(b) if b_codes is None else b_codes

    def within(x: Column, y: Column, most: Column) -> Column:
        return F.call_function("levenshtein", x, y, most) >= 0

    def limit_of(x: Column, y: Column) -> Column:
        return F.floor(F.greatest(F.length(x), F.length(y)) * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")

    def near(x: Column, y: Column) -> Column:
        limit = limit_of(x, y)
        # Most near lines are very near: a narrow band first, the whole band only where that fails.
        few = F.least(limit, F.lit(NARROW))
        return within(x, y, few) | ((limit > NARROW) & within(x, y, limit))
    long = F.greatest(F.length(a), F.length(b)) > LONG_CHARS
    by_words = F.lit(False)
    if longest is not None:
        words = F.floor(limit_of(a, b) / (longest + 1)).cast("int") - 1
        by_words = (words >= 0) & within(a_codes, b_codes, words)
    return F.when(long, near(a_codes, b_codes)).otherwise(by_words | near(a, b))


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, norm) of the lines at the places (row number, line_no, h) of ``wanted``.

    Two filters of at most ``SLOTS`` rows each, a bound that does not grow with the input, are broadcast:
    the first leaves out documents before they are cut into lines, the second leaves out lines
    before they are shuffled. The join behind them is exact.
    """
    row_slot = F.pmod(F.xxhash64(ROW), F.lit(SLOTS))
    place_slot = F.pmod(F.xxhash64(ROW, "line_no"), F.lit(SLOTS))
    rows = F.broadcast(wanted.select(row_slot.alias("slot")).distinct())
    places = F.broadcast(wanted.select(place_slot.alias("slot")).distinct())
    some = numbered(docs, "text").withColumn("slot", row_slot).join(rows, "slot", "left_semi")
    lines = some.select(ROW, F.posexplode(units(F.col("text"))).alias("line_no", "line")).withColumn("slot", place_slot)
    found = lines.join(places, "slot", "left_semi").drop("slot").join(wanted, [ROW, "line_no"])
    texts = found.select("h", normalise(F.col("line")).alias("norm"))
    return texts.select("h", "norm", _word_codes(F.col("norm")).alias("codes"), F.array_max(F.transform(F.split("norm", " "), F.length)).alias("longest"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of classes whose texts are similar; only texts of classes in a pair are read out. Saved pairs are removed."""
    pairs = pairs if hasattr(pairs, "_saved_at") else saved(pairs, "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    wanted = saved(classes.join(named, "h", "left_semi").select("h", f"first.{ROW}", "first.line_no"), "wanted")
    texts = saved(texts_of(wanted, docs), "texts")
    sides = [texts.select(F.col("h").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("norm", "codes", "longest")]) for x in "ab"]
    near = similar(F.col("a_norm"), F.col("b_norm"), similarity, F.col("a_codes"), F.col("b_codes"), F.greatest("a_longest", "b_longest"))
    links = saved(pairs.join(sides[0], "a").join(sides[1], "b").filter(near).select("a", "b"), "links")
    for read in (pairs, wanted, texts):
        discard(read)
    return links


def line_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per line with letters or digits: doc_id, row number, line_no, the group's kept line, and kept."""
    docs = numbered(docs, "doc_id", "text")
    lines = saved(fingerprinted(lines_of(docs)), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", ROW, "line_no")
    classes = saved(lines.groupBy("h").agg(F.first("sim").alias("sim"), F.first("chars").alias("chars"), F.min(place).alias("first"),
                                           F.count(F.lit(1)).alias("count"), *[F.first(k).alias(k) for k in QUARTER_KEYS]), "classes")
    quarters = quarter_pairs(classes, similarity)
    first_pairs = saved(chain_pairs(classes, similarity).unionByName(quarters).distinct(), "pairs")
    discard(quarters)
    near = verified(first_pairs, classes, docs, similarity)
    groups = connected_components(near)
    named = saved(classes.select("h", "sim", "chars").join(groups, F.col("h") == F.col("node"), "left")
                  .select("h", "sim", "chars", F.coalesce("component", "h").alias("component")), "named")
    more = verified(block_pairs(named, similarity), classes, docs, similarity)
    discard(named)
    # What is connected already goes in as stars, so few rounds are left.
    known = groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = connected_components(known.unionByName(more))
    labelled = saved(classes.select("h", "first", "count").join(groups, F.col("h") == F.col("node"), "left")
                     .select("h", "first", "count", F.coalesce("component", "h").alias("component")), "labelled")
    best = saved(labelled.groupBy("component").agg(F.min("first").alias("best"), F.sum("count").alias("group_size")), "best")
    chosen = saved(labelled.join(best, "component").select(F.col("h").alias("key"), "best", "group_size"), "chosen")
    is_best = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"best.{c}") for c in (ROW, "line_no")])
    return lines.join(chosen, F.col("h") == F.col("key")).select(
        "doc_id", ROW, "line_no", F.col("best.doc_id").alias("keep_doc_id"), F.col("best.line_no").alias("keep_line_no"),
        "group_size", is_best.alias("kept"))


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the lines that ``line_groups`` does not keep; all columns and rows stay.

    ``n_chars``, where there is one, is the length of the new text.
    """
    whole = packed(docs)
    dropped = (line_groups(fields_of(whole, "doc_id", "text"), similarity).filter("NOT kept").groupBy(F.col(ROW).alias("__key"))
               .agg(F.array_sort(F.collect_list("line_no")).alias("__drop")))
    joined = whole.join(dropped, F.col(ROW) == F.col("__key"), "left")
    doc, drop = F.col(DOC), F.col("__drop")
    text = F.when(drop.isNull(), doc["text"]).otherwise(F.array_join(remaining(units(doc["text"]), drop), "\n"))
    out = joined.withColumn("__text", text)
    columns = []
    for c in docs.columns:
        if c == "n_chars":
            columns.append(F.when(drop.isNull(), doc[c]).otherwise(F.length("__text")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("__text").alias(c) if c == "text" else doc[c].alias(c))
    return out.select(*columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_groups(table(spark, sf_dir, "documents")).drop(ROW)
