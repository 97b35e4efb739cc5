"""Quality classifier, secret scan and the whole pipeline against plain versions; pipeline with odd rows."""

import math
import random
import re
import zlib

import pytest

import corpus_pipeline
from lodestrata.llm import packing, quality, secret_scan

MASK = (1 << 64) - 1
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def plain_features(text):
    words = (text or "").encode().split()
    shape = lambda w: bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in w)
    h = [zlib.crc32(w) for w in words]
    pairs = [0 if a == b else ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & MASK) >> 33 for a, b in zip(h, h[1:])]
    return [x % 10_000 for x in h] + [x % 10_000 for x in pairs] + [zlib.crc32(shape(w)) % 10_000 + 10_000 for w in words]


def plain_resample(docs, labels, seed=42):
    """(doc_id, n, weight, key) in the order of the draw, and how many stay."""
    good = {d for d, q, t in labels if d is not None and q == 1 and not t}
    raw, target = [0] * 20_000, [0] * 20_000
    for d, text in docs:
        for f in plain_features(text):
            raw[f] += 1
            target[f] += d in good
    base = [(r + 1) / (sum(raw) + 20_000) for r in raw]
    total = sum(target) + 20_000
    ratio = [math.log((t + 20_000 * b) / total) - math.log(b) for t, b in zip(target, base)]
    rows = []
    for place, (d, text) in enumerate(docs):
        found = plain_features(text)
        weight = sum(ratio[f] for f in found) * min(1.0, 50 / len(found)) if found else 0.0
        u = (zlib.crc32((text or "").encode(), zlib.crc32(f"{seed}/{d}".encode())) + 0.5) / 2**32
        rows.append((d, len(found), weight, weight - math.log(-math.log(u)), place))
    k = sum(w >= -8 for _, _, w, _, _ in rows)
    return sorted(rows, key=lambda r: -r[3]), k


def sample_docs(rng):
    words = ["".join(rng.choices(LETTERS, k=rng.randint(2, 8))) for _ in range(80)]
    good = [" ".join(rng.choices(words, k=rng.randint(5, 3000))) for _ in range(60)]
    bad = [" ".join("#%d!" % rng.randint(0, 9) for _ in range(rng.randint(400, 900))) for _ in range(15)]
    texts = good + bad + [None, "", "  \n", "Ärger über über ÄÖ", good[0]]
    return [(i, t) for i, t in enumerate(texts)]


def test_importance_resampling(spark, tmp_path):
    docs = sample_docs(random.Random(6))
    labels = [(i, int(i < 60), 0) for i in range(0, 75, 2)] + [(1, 1, 1), (None, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    out = quality.resample(spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in out.collect()}
    rows, k = plain_resample(docs, labels)
    assert len(got) == len(docs) and sum(r.kept for r in got.values()) == k < len(docs)
    for rank, (d, n, weight, key, _) in enumerate(rows, 1):
        r = got[d]
        assert (r.n_ngrams, r.rank, r.kept) == (n, rank, rank <= k)
        assert abs(r.log_weight - weight) < 1e-9 and abs(r.log_weight + r.noise - key) < 1e-9
    assert not any(r.kept for d, r in got.items() if 60 <= d < 75)


def planted(rng, n):
    """Texts with one candidate each that no plain rule decides, and whether it is a secret."""
    rows = []
    for i in range(n):
        if i % 2:
            secret, label = "".join(rng.choices(LETTERS + LETTERS.upper() + "0123456789", k=rng.randint(20, 40))), 1.0
        else:
            words = rng.choices(["internal", "request", "handler", "process", "default", "session", "value", "manager", "update"], k=3)
            secret, label = "".join(w.capitalize() for w in words) + str(rng.randint(1, 99)), 0.0
        rows.append((i, f"the request handler has {secret} as default value for the session manager", secret, label))
    return rows


def test_forest_on_held_out_findings(spark, tmp_path):
    rows = planted(random.Random(3), 400)
    spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    known = {s: label for i, _, s, label in rows if i % 4 < 2}
    found = secret_scan.candidates(docs)
    labelled = found.join(spark.createDataFrame(list(known.items()), "secret string, label double"), "secret").select(
        "secret", "start", "before", "after", "label")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs, labelled).collect()}
    held_out = [(i, label) for i, _, s, label in rows if s not in known]
    right = sum(got[i].is_secret == bool(label) for i, label in held_out) / len(held_out)
    ruled = {r.doc_id: r.label for r in secret_scan.features(found, secret_scan.words_of(docs)).withColumn(
        "label", secret_scan.rule_label()).select("doc_id", "label").collect()}
    by_rule = sum((ruled[i] or 0.0) == label for i, label in held_out) / len(held_out)
    assert len(held_out) > 150 and right > 0.95 and right > by_rule


def test_secret_features(spark, tmp_path):
    texts = ['token = "aB3dE6gH9jK2mN5pQ8"', "see https://x.org/a/0123456789abcdef0123 now", "plain words only here", "KeyHandlerRequestX1 key=abcd1234",
             None, "", "aaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaa"]
    spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, texts[0])], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    words = {}
    for t in [*texts, texts[0], texts[0]]:
        for w in re.findall(r"[^\W\d_]{2,}", (t or "").lower()):
            words[w] = words.get(w, 0) + 1
    pairs, first = {}, {}
    for w, n in words.items():
        for p in (w[i:i + 2] for i in range(len(w) - 1)):
            if re.fullmatch("[a-z]{2}", p):
                pairs[p] = pairs.get(p, 0) + n
                first[p[0]] = first.get(p[0], 0) + n
    rows = secret_scan.scan_secrets(docs).collect()
    assert sum(r.doc_id in (0, None) for r in rows) == 3 and {r.doc_id for r in rows} == {0, 1, 3, 6, None}
    for r in rows:
        s = r.secret
        text = texts[r.doc_id or 0]
        assert text[r.start:r.start + r.length] == s
        assert r.digits == pytest.approx(len(re.findall("[0-9]", s)) / len(s)) and r.distinct == pytest.approx(len(set(s)) / len(s))
        both = [s.lower()[i:i + 2] for i in range(len(s) - 1)]
        assert r.pair_logp == pytest.approx(sum(math.log((pairs[p] + 1) / (first[p[0]] + 26)) if p in pairs else -8.0 for p in both) / len(both))
        runs = [w.lower() for w in re.findall("[A-Z]?[a-z]{2,}|[A-Z]{3,}", s)]
        assert r.coverage == pytest.approx(sum(len(w) for w in runs if w in words and len(w) > 2) / len(s))
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def grouped(items, near):
    """Connected groups of items, each in order."""
    groups = []
    for x in items:
        met = [g for g in groups if any(near(x, y) for y in g)]
        groups = [g for g in groups if g not in met] + [sorted([x, *(y for g in met for y in g)])]
    return groups


def tables(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(LETTERS, k=rng.randint(3, 8)))
    vocabulary = [word() for _ in range(300)]
    lines = [" ".join(rng.choices(vocabulary, k=14)) for _ in range(90)]
    texts = ["\n".join(rng.sample(lines[:40] if i < 20 else lines[40:], 3)) for i in range(34)]
    long = " ".join(rng.choices(vocabulary, k=120))
    texts += [f"{long} {word()}", f"{long} {word()}", "\n".join(["#!# 1 ?? 2"] * 5)]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i < 36), 0) for i in range(37)]
    tables(spark, tmp_path, docs, labels)

    rows, k = plain_resample([(d[0], d[1]) for d in docs], labels)
    good = sorted(r[0] for r in rows[:k])
    # Line dedup: the first place of each group of similar lines stays.
    places = [(d, n, x.lower().strip()) for d in good for n, x in enumerate(texts[d].split("\n")) if re.search(r"[^\W_]", x)]
    similar = lambda a, b: a[2] == b[2] or edits(a[2], b[2]) <= 0.2 * max(len(a[2]), len(b[2]))
    stay = {g[0][:2] for g in grouped(places, similar)}
    seen = {p[:2] for p in places}
    cleaned = {d: "\n".join(x for n, x in enumerate(texts[d].split("\n")) if (d, n) in stay or (d, n) not in seen) for d in good}
    # Near duplicates by exact similarity of five-word shingles.
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = {d: shingles(t) for d, t in cleaned.items()}
    close = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = {g[0] for g in grouped(sorted(cleaned), close)}

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = packing.Encoder(packing.default_tokenizer())
    size = {d: len(tokens.encode(cleaned[d])) // 4 + 1 for d in kept}
    assert {p.doc_id for p in pieces} <= kept and all(p.doc_tokens == size[p.doc_id] for p in pieces)
    # Every copy is whole: the pieces of a document cover it as often as it was taken, at most twice.
    for d in {p.doc_id for p in pieces}:
        covered = [0] * size[d]
        for p in pieces:
            if p.doc_id == d:
                for at in range(p.start, p.start + p.length):
                    covered[at] += 1
        assert set(covered) in ({1}, {2})
    words = {d: len(t.split()) for d, t in cleaned.items() if d in kept}
    assert sum(words[d] for d in {p.doc_id for p in pieces}) <= sum(words.values())


def test_pipeline_with_odd_rows(spark, tmp_path):
    text = "some words of a good document that is long enough to be kept by all of the stages"
    docs = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, f"{text} and more of it", "en", None, 1),
            (4, "x " * 3000, "en", "b", 6000), (5, "\n\n***\n", "en", "b", 6)]
    tables(spark, tmp_path, docs, [(1, 1, 0), (None, None, None), (9, 0, 1)])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # The second row of document 1 lost its only line: it is the one document without words that stays.
    assert {p.doc_id for p in pieces} == {1, 4, 5, None} and all(p.length > 0 for p in pieces)


def test_pipeline_of_nothing(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
