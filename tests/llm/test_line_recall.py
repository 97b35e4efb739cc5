"""Recall of the fuzzy lines by length and number of changes, and work in proportion to the lines."""

import os
import random

import pytest

from lodestrata.llm import line_dedup
from lodestrata.llm.common import ROW

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def typo(rng, word):
    at = rng.randrange(len(word))
    return word[:at] + rng.choice([c for c in LETTERS if c != word[at]]) + word[at + 1:]


def linked(spark, tmp_path, words, changes, pairs=120, seed=1):
    rng = random.Random(seed * 1000 + words * 10 + changes)
    rows = []
    for n in range(pairs):
        line = ["".join(rng.choices(LETTERS, k=rng.randint(4, 9))) for _ in range(words)]
        other = list(line)
        for at in rng.sample(range(words), changes):
            other[at] = typo(rng, other[at])
        rows += [(2 * n, " ".join(line)), (2 * n + 1, " ".join(other))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d")
    keep = {r.doc_id: r.keep_doc_id for r in line_dedup.line_groups(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert all(keep[i] // 2 == i // 2 for i in keep)
    return sum(keep[2 * n] == keep[2 * n + 1] for n in range(pairs)) / pairs


@pytest.mark.parametrize("words,changes,least", [(3, 1, 1.0), (5, 1, 1.0), (10, 1, 1.0), (20, 1, 1.0), (50, 1, 1.0), (20, 2, 1.0), (50, 2, 1.0)])
def test_changed_words_are_found(spark, tmp_path, words, changes, least):
    assert linked(spark, tmp_path, words, changes) >= least


def test_pairs_grow_with_the_lines(spark, tmp_path):
    """Two-word lines share words all the time; each class meets its keys' smallest ones only."""
    rng = random.Random(4)
    counts = []
    for n in (1000, 4000):
        words = ["".join(rng.choices(LETTERS, k=6)) for _ in range(int(n ** 0.5))]
        texts = [" ".join(rng.choices(words, k=2)) for _ in range(n)]
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/{n}")
        lines = line_dedup.fingerprinted(line_dedup.lines_of(spark.read.parquet(f"{tmp_path}/{n}"))).drop(ROW).dropDuplicates(["h"])
        counts.append((line_dedup.quarter_pairs(lines).count(), lines.count()))
    assert all(pairs <= 6 * classes for pairs, classes in counts)


def test_word_bound_never_accepts_what_is_not_similar(spark):
    from pyspark.sql import functions as F
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        line = ["".join(rng.choices(LETTERS, k=rng.randint(1, 12))) for _ in range(rng.randint(1, 30))]
        other = [w for w in line if rng.random() > 0.1] or ["x"]
        other = [w if rng.random() > 0.15 else "".join(rng.choices(LETTERS, k=rng.randint(1, 12))) for w in other]
        rows.append((" ".join(line), " ".join(other)))
    df = spark.createDataFrame(rows, "a string, b string")
    codes = [line_dedup._word_codes(F.col(c)) for c in "ab"]
    longest = F.array_max(F.transform(F.split(F.concat_ws(" ", "a", "b"), " "), F.length))
    wrong = df.filter(line_dedup.similar(F.col("a"), F.col("b")) != line_dedup.similar(F.col("a"), F.col("b"), 0.8, *codes, longest))
    assert wrong.count() == 0


def test_lines_are_fingerprinted_in_their_rows(spark, tmp_path):
    # Lines of one, 127, 128 and 300 words: one sum of lanes, and several.
    rng = random.Random(7)
    lines = [" ".join("".join(rng.choices(LETTERS, k=3)) for _ in range(n)) for n in (1, 2, 127, 128, 254, 255, 300)]
    spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    found = line_dedup.fingerprinted(line_dedup.lines_of(spark.read.parquet(f"{tmp_path}/d")))
    # No row per word, nothing put together again, no table on the way.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Union" not in plan and plan.count("Generate") == 2  # files and lines
    pairs = spark.createDataFrame([(i, a, b) for i, t in enumerate(lines) for w in [t.split()] for a, b in zip(w, [*w[1:], None])],
                                  "line_no int, a string, b string")
    want = {}
    for r in pairs.selectExpr("line_no", "xxhash64(a, b) AS x").collect():
        want.setdefault(r.line_no, []).append(r.x)
    majority = {i: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in xs) > len(xs)) for i, xs in want.items()}
    assert {r.line_no: r.sim % (1 << 64) for r in found.collect()} == majority


def test_key_tables_are_removed(spark, tmp_path):
    rows = [(i, " ".join(f"w{i % 9}{j}" for j in range(6))) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    made = []
    before, line_dedup.saved = line_dedup.saved, lambda df, name="table": made.append(before(df, name)) or made[-1]
    try:
        assert line_dedup.line_groups(spark.read.parquet(f"{tmp_path}/d")).count() == 30
    finally:
        line_dedup.saved = before
    left = [t._saved_at.rsplit("/", 1)[1].split("-")[0] for t in made if os.path.exists(t._saved_at.removeprefix("file:"))]
    assert not {"parts", "keyed", "quarters", "pairs", "named"} & set(left) and {"lines", "classes"} <= set(left)


def test_a_line_is_split_once(spark, tmp_path):
    """Six keys of quarters and the pairs of words all read one list of words."""
    spark.createDataFrame([(0, "one two three four five")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    found = line_dedup.fingerprinted(line_dedup.lines_of(spark.read.parquet(f"{tmp_path}/d")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Once into lines, once into words, once the path of the input file.
    assert plan.count("split(") <= 3
