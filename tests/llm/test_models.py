"""Neighbour graph, secret forest, resampling, mixing and the pipeline against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mixing, nn_descent, quality, secret_scan
from lodestrata.llm.common import ROW

IS_QUERY = "vec_id % 20 = 0"


def brute(ids, vectors, top=20):
    """Nearest rows of every query row by inner product; ties to the smaller id."""
    ok = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    x = np.array([np.float32(vectors[i]) for i in ok], float)
    out = {}
    for a, i in enumerate(ok):
        if ids[i] % 20 == 0:
            s = x @ x[a]
            order = sorted((b for b in range(len(ok)) if b != a), key=lambda b: (-s[b], ids[ok[b]]))[:top]
            out[ids[i]] = [(ids[ok[b]], s[b]) for b in order]
    return out


@pytest.mark.parametrize("n, scale", [(600, False), (400, True)])
def test_nearest_recall(spark, tmp_path, n, scale):
    rng = np.random.default_rng(4)
    vectors = [[float(c) for c in v * (1 + (i % 7 if scale else 0))] for i, v in enumerate(rng.standard_normal((n, 8)).astype(np.float32))]
    vectors[100:160] = [vectors[100]] * 60  # equal vectors, in order of their ids
    vectors[:6] = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [1.0] * 5]
    rows = [(i, v, 0, "clash") for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string").repartition(3).write.parquet(str(tmp_path / "v"))
    table = spark.read.parquet(str(tmp_path / "v"))
    got = {}
    for r in nn_descent.nearest(table, IS_QUERY).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(list(range(n)), vectors)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        exact = dict(want[q])
        hits += sum(v in exact for _, v, _ in found)
        assert all(abs(exact[v] - s) < 1e-9 for _, v, s in found if v in exact)
    assert hits >= 0.95 * 20 * len(want)
    # Equal vectors come in the order of their ids, the query's own row left out.
    assert [v for _, v, _ in got[140]] == [v for v, _ in want[140]]


def test_nearest_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (0, [1.0, 0.0])], schema).coalesce(1)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nn_descent.nearest(few, IS_QUERY).collect())
    assert got == sorted([(0, 1, 0, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0)] * 2)
    assert nn_descent.nearest(few.limit(0), IS_QUERY).count() == 0
    assert nn_descent.nearest(few.limit(1), IS_QUERY).count() == 0


def test_secret_scan(spark):
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    keys, texts = set(), []
    for i in range(240):
        words = [rng.choice(["harbour", "timetable", "of", "the", "winter", "internationalisation", "misunderstandings"]) for _ in range(60)]
        if i % 3 == 0:
            key = hexes(40)
            words.insert(20, f'token = "{key}"')
            keys.add(key)
        if i % 4 == 0:
            key = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
            words.insert(30, key)
            keys.add(key)
        if i % 5 == 0:
            words.insert(5, f"card {rng.randint(10**15, 10**16 - 1)} mail someone.with.long.name{i}@example-of-hosts.com")
            words.insert(9, f"https://example.com/files/{hexes(32)}/list")
        texts.append(" ".join(words))
    texts += [None, "", "x" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit(5))
    got = secret_scan.scan_secrets(docs).collect()
    assert {r.secret for r in got if r.is_secret} == keys
    for r in got:
        assert texts[r.doc_id][r.start:r.start + r.length] == r.secret and 0 <= r.score <= 1
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0
    plain = secret_scan.scan_secrets(docs.filter("doc_id = 0")).collect()  # too few findings: the rules decide
    assert [r.is_secret for r in plain if r.secret in keys] == [True] * sum(r.secret in keys for r in plain)


def test_secret_scan_from_given_findings(spark):
    findings = [("q" * 16 + "7" * k, 0, "note ", " end", 1.0) for k in range(1, 30)] + [("z" * 18, 0, "note ", " end", 0.0)] * 30
    given = spark.createDataFrame(findings, "secret string, start long, before string, after string, label double").coalesce(1)
    docs = spark.createDataFrame([(1, "note qqqqqqqqqqqqqqqq777777777 end zzzzzzzzzzzzzzzzzz end")], "doc_id long, text string")
    got = {r.secret[0]: r.is_secret for r in secret_scan.scan_secrets(docs, given).collect()}
    assert got == {"q": True, "z": False}


def test_quality_keeps_good_documents(spark, tmp_path):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter", "sun") for b in ("ne", "ring", "ly", "tion", "ed", "s")]
    rows, labels = [], []
    for i in range(500):
        text = " ".join(rng.choices(words, k=rng.randint(30, 200)))
        bad = i % 6 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 12 else " ".join(w + rng.choice(["###", "%%%"]) for w in text.split())
        rows.append((i, text, "s", None))
        if i % 3 != 1:
            labels.append((i, int(not bad), 0))
    rows += [(None, "", "s", None), (7, None, "s", None), (8, rows[8][1], "s", None), (9, "mi" * 50_000, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, kept boolean").coalesce(2)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    label_table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.resample(docs, label_table).collect()
    assert len(got) == len(rows) and sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.n_ngrams > 80 and r.kept == (r.doc_id % 6 == 0)]
    assert len(wrong) <= 2
    assert all(r.kept and r.log_weight == 0 for r in got if r.n_ngrams == 0)
    assert [tuple(r) for r in quality.resample(docs, label_table).orderBy("rank").collect()] == sorted(map(tuple, got), key=lambda r: r[4])
    kept = quality.keep_good(docs, label_table)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert all(r.kept for r in quality.resample(docs, label_table.limit(0)).collect())
    assert quality.resample(docs.limit(0), label_table).count() == 0


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing the excess again until no source is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full


@pytest.mark.parametrize("block", [7, 4096])
def test_mix(spark, tmp_path, block):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 20, 70])), rng.choice(["a", "a", "a", "b", "é", "Z", None, "tiny"]), "x") for i in range(700)]
    rows = [r if r[2] != "tiny" or r[0] % 40 == 0 else (*r[:2], "a", "x") for r in rows]
    rows += [(None, "p q", "b", "x"), (3, rows[3][1], rows[3][2], "x"), (701, None, "only null", "x"), (702, "\x0b \t", "blank", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, target string").coalesce(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = mixing.mix(docs, block=block).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 35.5, s  # half the longest document at most
    again = mixing.mix(docs, block=block)
    assert {(r[ROW], r.copies) for r in again.collect()} == {(r[ROW], r.copies) for r in got}
    mixed = mixing.apply_mix(docs, block=block)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies if r.size else 1 for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_settle_keeps_words_and_expectation():
    sizes = np.sort(np.random.default_rng(1).integers(1, 200, 40))[::-1].astype(float)
    p, total = np.full(40, 0.3), np.zeros(40)
    for seed in range(3000):
        out = mixing.settle(sizes, p, np.random.default_rng(seed), last=False)
        held = (out > 0) & (out < 1)
        assert held.sum() <= 1 and abs((out * sizes).sum() - (p * sizes).sum()) < 1e-6
        total += out
    assert np.abs(total / 3000 - 0.3).max() < 0.05


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi") for b in ("ne", "ring", "da") for c in ("s", "ty", "ro", "m")]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(12, 30)))
    rows, labels = [], []
    for i in range(120):
        text = "\n".join([line(), "all rights to this boilerplate line", line()])
        if i % 10 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split() * 2)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(i % 10 != 0), 0))
    rows += [(200 + i, rows[1][1], "en", "src0", len(rows[1][1])) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    states = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, states[-1], str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        states.append(spark.read.parquet(str(tmp_path / f"out{k}")))
    good, lines, unique, mixed, packed = states[1:]
    assert {r.doc_id for r in good.collect()} == {r[0] for r in rows if r[0] % 10 or r[0] >= 200}
    texts = [r.text for r in lines.collect()]
    assert len(texts) == good.count() and sum("boilerplate" in t for t in texts) == 1
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    assert unique.count() == len({r.text for r in unique.collect()})
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in unique.collect()}
    assert all(s.columns == docs.columns for s in states[1:-1])
    assert packed.agg(F.sum("length")).first()[0] > 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == packed.columns and whole.count() == packed.count()
