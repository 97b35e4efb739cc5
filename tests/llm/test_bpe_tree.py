"""Tree encoding against the encoder library, with forced small leaves, odd characters and odd rows."""

import hashlib
import random

import pytest
import tiktoken

from lodestrata.llm import bpe_tree

RANKS, PATTERN = bpe_tree.read_ranks(bpe_tree.default_ranks()), bpe_tree.default_pattern()
ODD = ["a", "b", " ", "  ", "'", "'re", "'ll", "l", "e", "\n", "1", "é", "日本", "࢏", "\U00011de0", "!", "\t", "x" * 40,
       "ab" * 30, " ", "　", "'s", "I'll", "\x1c", "\x85", "퟿", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe_tree.TreeEncoder(RANKS, PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 3, 5, 8, 4096])
def test_any_cut_gives_the_library_ids(encoder, library, leaf):
    rng, encoder.leaf = random.Random(leaf), leaf
    for _ in range(800):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))
        ids = encoder.encode(text).tolist()
        assert ids == library.encode_ordinary(text), text
        assert encoder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30001, "ab" * 20000, " " * 30000 + "x", "é" * 20001, "'" * 9999, "aaab" * 9000, "日" * 9000])
def test_long_pieces(encoder, library, text):
    encoder.leaf = 4096
    assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_join_is_associative(encoder):
    rng = random.Random(7)
    for _ in range(300):
        a, b, c = (bytes(rng.choice(b"aabeinrst") for _ in range(rng.randint(1, 12))) for _ in range(3))
        x, y, z = (encoder.merge(p) for p in (a, b, c))
        assert encoder.join(encoder.join(x, y), z) == encoder.join(x, encoder.join(y, z)) == encoder.merge(a + b + c)


def test_class_with_brackets_is_spelt_out():
    put = bpe_tree.Matcher.put
    assert put(r" ?[^\s\p{L}]+|\p{L}+", r"\p{L}", {"a", "b"}) == " ?[^\\s\\U00000061-\\U00000062]+|[\\U00000061-\\U00000062]+"


def test_small_ranks_of_any_order(library):
    ranks = {bytes([b]): 255 - b for b in range(256)} | {b"ab": 300, b"bc": 256, b"abc": 270, b"aa": 500, b"cab": 259}
    own, tree = tiktoken.Encoding("s", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe_tree.TreeEncoder(ranks, PATTERN, 3)
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
        assert tree.encode(text).tolist() == own.encode_ordinary(text)


def test_rows_of_all_kinds(spark, library, tmp_path):
    texts = [None, "", "plain text", "plain text", "word " * 30000, "a" * 5000, "\n\n  x", "<|endoftext|>", "日本 ࢏'re"]
    rows = [(i if i != 3 else 2, t, 7, "clash") for i, t in enumerate(texts)] + [(None, "no id", 7, "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, decoded string").write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe_tree.op12_bpe_tree(spark, str(tmp_path)).collect()

    def plain(doc, text):
        ids = library.encode_ordinary(text or "")
        digest = lambda data: hashlib.sha256(data).hexdigest()
        return doc, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=order) == sorted((plain(r[0], r[1]) for r in rows), key=order)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([("k", "some text", [1])], "name string, body string, list array<int>")
    out = bpe_tree.encode_texts(df, "body")
    assert out.columns == ["name", "list", "ids"] and out.first().ids == list(bpe_tree.tree_encoder(
        bpe_tree.default_ranks(), PATTERN).encode("some text"))
    assert bpe_tree.decode_ids(bpe_tree.encode_texts(df.limit(0), "body")).count() == 0
    assert bpe_tree.decode_ids(out).first().decoded == b"some text"


def test_whole_small_table(spark, library):
    got = {r.doc_id: r.n_tokens for r in bpe_tree.op12_bpe_tree(spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: len(library.encode_ordinary(r.text or "")) for r in texts}
