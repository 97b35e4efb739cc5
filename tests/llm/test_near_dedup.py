"""The pipeline's near-duplicate stage against brute force over shingle sets."""

import random

import corpus_pipeline
from lodestrata.llm import near_dedup


def test_stage_links_all_documents_of_similarity_0_8(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " ", "one two", "One  two"]
    for n, changes in [(200, 1), (200, 4), (500, 5), (500, 10), (2000, 40), (300, 60)]:
        for _ in range(12):
            base = rng.choices(words, k=n)
            copy = list(base)
            for k in rng.sample(range(n), changes):
                copy[k] = "changed"
            texts += [" ".join(base), " ".join(copy)]
    base = rng.choices(words, k=400)  # a family larger than any pair
    texts += [" ".join("x" if i == k else w for i, w in enumerate(base)) for k in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = 0
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in near_dedup.near_groups(docs).collect()}
    assert links > 800 and len(got) == len(texts)
    wrong = [i for i in got if got[i].component_id != find(i)]
    assert not wrong, wrong
    stay = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert stay.columns == docs.columns
    assert {r.doc_id for r in stay.collect()} == {i for i in range(len(texts)) if find(i) == i}
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_stage_links_what_simhash_links(spark):
    # Repeats decide the fingerprint, not the set: a third of the shingles in common, but no bit that differs.
    cycle = "a b c d e f g " * 60
    texts = [cycle + "one two three", "other words stand in this text", cycle + "four five six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    assert {r.doc_id for r in near_dedup.keep_one_of_each(docs).collect()} == {0, 1}
