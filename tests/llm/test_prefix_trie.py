"""The trie against a brute-force one, contraction on awkward shapes, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lodestrata.llm import prefix_trie as pt


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0, role, text), role, text))
    for found in turns.values():
        found.sort(key=lambda r: r[0])
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -((-c) % 5))
        built[c] = [r[1:] for r in turns.get(base, [])[:h] + turns[c][h:]]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = own + sum(saved[k] for k in children[node])
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node],
                    saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, n_convs string")
    return sorted(map(tuple, pt.prefix_trie(df).collect()), key=str)


def test_random_conversations(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", rng.choice("abcé"))
            for c in rng.sample(range(-30, 60), 70) for t in range(rng.randint(1, 12))]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "u", "no id"), (1, None, None, None), (1, None, "u", "b"), (1, 3, "u", ""), (1, 3, "u", ""), (1, 3, "a", "x"), (2, 1, "u", "é" * 5000),
            (3, 1, "u", "é" * 5000), (5, 1, "u", "p"), (6, 1, "u", "p"), (7, 1, "", "p"), (-7, 1, "u", "p"), (-5, -1, "u", "p"), (40, 0, "u", "p")]
    assert run(spark, rows) == brute(rows)


def test_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 7)
    monkeypatch.setattr(pt, "PIECE", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(3)]
    rows += [(77, t, "user", f"same {t % 2}") for t in range(300)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, [(None, 1, "u", "x")]) == []


@pytest.mark.parametrize("shape", ["chain", "star", "caterpillar", "random", "one"])
def test_contraction(spark, shape):
    rng, n = random.Random(4), 200
    above = {"chain": lambda i: i - 1, "star": lambda i: 0, "caterpillar": lambda i: i - 2 if i % 2 and i > 1 else i - 1,
             "random": lambda i: rng.randrange(i), "one": None}[shape]
    parent = {0: None} if shape == "one" else {0: None, **{i: above(i) for i in range(1, n)}}
    kids = defaultdict(int)
    for p in parent.values():
        kids[p] += p is not None
    rows = [(i, 0, p, None if p is None else 0, kids[i], int(kids[i] == 0), i + 1) for i, p in parent.items()]
    df = spark.createDataFrame(rows, "c long, d long, pc long, pd long, kids long, n_leaves long, saved_tokens long")
    want = {i: [int(kids[i] == 0), i + 1] for i in parent}
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            for k in (0, 1):
                want[parent[i]][k] += want[i][k]
    got = {r.c: [r.n_leaves, r.saved_tokens] for r in pt.subtree_totals(df).collect()}
    assert got == want
