"""Duplicates, lines and components against brute force, with odd rows."""

import hashlib
import random
import re

import pytest

from lodestrata.llm import exact_dedup, line_dedup, simhash_dedup
from lodestrata.llm.components import connected_components

SCHEMA = "doc_id long, text string, kept boolean, component string"


def frame(spark, tmp_path, texts, ids=None):
    rows = [(i, t, None, "clash") for i, t in zip(ids or range(len(texts)), texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(99, i) for i in range(80)],
    [(random.Random(7).randint(0, 50), random.Random(i).randint(0, 300)) for i in range(150)]])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.component for r in got} == roots(nodes, [e for e in edges if e[0] != e[1]]) and len(got) == len(nodes)


@pytest.mark.parametrize("max_bits", [exact_dedup.SEGMENT, exact_dedup.MAX_BITS])
def test_exact_dedup(spark, tmp_path, max_bits):
    texts = ["a b", "ab", " a\tb ", None, "", " ", "x" * 200_000, " a b", "é", "é"] + ["hot text"] * 60 + [f"t {i}" for i in range(100)]
    ids = [*range(len(texts) - 3), None, 3, 3]  # a null and a repeated id
    docs = frame(spark, tmp_path, texts, ids)
    got = exact_dedup.exact_dedup(docs, max_bits).collect()
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}
    assert len(got) == len(texts)
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(want)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_simhash_groups(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choices(words, k=4000))
    texts = [None, "", "one", "One", "one two", "one two three four", base] + [
        base.replace(f"w{i} ", f"v{i} ", 1) for i in range(40)] + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(200)]
    ids = [*range(len(texts) - 1), None]
    docs = frame(spark, tmp_path, texts, ids)
    got = simhash_dedup.simhash_groups(docs).collect()
    fps = {i: simhash_dedup.fingerprint((t or "").encode()) for i, t in zip(ids, texts)}
    known = [i for i in ids if i is not None]
    links = [(a, b) for a in known for b in known if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2]
    want = roots(known, links)
    assert len(links) > 40
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    assert len(got) == len(texts)
    assert simhash_dedup.simhash_groups(docs.limit(0)).count() == 0
    stay = simhash_dedup.keep_one_of_each(docs)
    assert stay.columns == docs.columns and stay.count() == sum(r.kept for r in got)


def test_fingerprint_by_the_letter():
    import xxhash
    for text in ["", "a", "A b", "a b c", "a b c d e a b c", "Ä  x\x0by z z z z"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert simhash_dedup.fingerprint(text.encode()) == want


def test_tiles_lose_no_link(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:200]] + [0, 2**64 - 1, 1, 2**64 - 2]
    signed = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    edges = simhash_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, chunk=8).collect()
    want = roots(signed, [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 2])
    assert roots(signed, [(r.a, r.b) for r in edges]) == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_groups(spark, tmp_path):
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("ka", "to", "mi", "re") for b in ("lon", "sa", "wek") for c in ("t", "ri", "da", "pol")]
    line = lambda n: " ".join(rng.choices(words, k=n))
    base = line(60)
    near = [" ".join(w if i != k else "other" for i, w in enumerate(base.split())) for k in range(0, 60, 5)]
    long = line(400)
    texts = [None, "", "***\n---\n", f"{base}\nlast", f"{base.upper()}\r\n\n{line(8)}", *near, f"x\n{long}\n", f"{long} more\nx",
             *[f"{line(12)}\nboilerplate of this site\n{line(30)}" for _ in range(30)]]
    docs = frame(spark, tmp_path, texts)
    got = line_dedup.line_groups(docs).collect()
    lines = {(d, n): x.lower().strip(" \t\r") for d, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))}
    lines = {k: x for k, x in lines.items() if re.search(r"[^\W_]", x)}
    assert {(r.doc_id, r.line_no) for r in got} == set(lines)
    group = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in got}
    # Equal lines are one group, each group keeps one line, its first, and groups hold together by edit similarity.
    members = {}
    for place, keep in group.items():
        members.setdefault(keep, []).append(place)
    for a in lines:
        for b in lines:
            if lines[a] == lines[b]:
                assert group[a] == group[b]
    for keep, places in members.items():
        assert keep == min(places)
        texts_of = {lines[p] for p in places}
        seen, todo = {lines[keep]}, [lines[keep]]
        while todo:
            x = todo.pop()
            for y in texts_of - seen:
                cut = (lambda s: s.split()) if max(len(x), len(y)) > line_dedup.LONG_CHARS else (lambda s: s)
                if edit_distance(cut(x), cut(y)) <= 0.2 * max(len(cut(x)), len(cut(y))):
                    seen.add(y)
                    todo.append(y)
        assert seen == texts_of
    assert sum(r.kept for r in got) == len(members)
    # Lines with one of 60 words changed are found: the base, its upper case form and the near ones.
    home = group[(3, 0)]
    assert sum(g == home for g in group.values()) >= 0.8 * (2 + len(near))
    assert group[(4, 0)] == home and group[(len(near) + 5, 1)] == group[(len(near) + 6, 0)]
    cleaned = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    dropped = {(r.doc_id, r.line_no) for r in got if not r.kept}
    for d, t in enumerate(texts):
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in dropped)
        assert cleaned[d] == want
    assert line_dedup.line_groups(docs.limit(0)).count() == 0
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns


def test_line_fingerprints(spark, tmp_path):
    """The packed sums give the same bits as counting one by one, also beyond one segment."""
    from pyspark.sql import functions as F
    texts = ["one", "a b", "w " * 127 + "z", "w x " * 200, " ".join(f"v{i}" for i in range(1000))]
    docs = frame(spark, tmp_path, texts)
    got = {r.doc_id: r.sim for r in line_dedup.fingerprinted(line_dedup.lines_of(docs)).collect()}
    for i, t in enumerate(texts):
        w = t.strip().split(" ")
        pairs = spark.createDataFrame([(a, b) for a, b in zip(w, [*w[1:], None])], "a string, b string")
        hashes = [r.x for r in pairs.select(F.xxhash64("a", "b").alias("x")).collect()]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i] % 2**64 == want


def test_a_dense_family_of_lines_is_one_group(spark, tmp_path):
    base = [f"word{i}" for i in range(80)]
    texts = [" ".join(["edit%d" % k if i == k % 80 else w for i, w in enumerate(base)]) for k in range(150)]
    docs = frame(spark, tmp_path, texts)
    got = line_dedup.line_groups(docs).collect()
    sizes = {}
    for r in got:
        sizes[(r.keep_doc_id, r.keep_line_no)] = sizes.get((r.keep_doc_id, r.keep_line_no), 0) + 1
    assert max(sizes.values()) >= 140
