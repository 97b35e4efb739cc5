"""URL filter, licence scan and packing against plain versions, with odd rows."""

from array import array

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import license_scan, packing, url_filter


def plain_match(glob: str, text: str) -> bool:
    """Wildcard match by dynamic programming; ``*`` stays inside the host (before the bar) or the path."""
    states = {0}
    for i, c in enumerate(glob):
        if c == "*":
            states = {j for s in states for j in range(s, len(text) + 1) if "|" not in text[s:j] or "|" not in glob[i:]}
        else:
            states = {s + 1 for s in states if s < len(text) and (text[s] == c or c == "?" and text[s] != "|")}
    return len(text) in states


@pytest.mark.parametrize("globs", [[("*.a.com", "/x*")], [("*", "*/ads/*"), ("a?c", "/")] * 9, [("*b*b*", "*"), ("", "*")]])
def test_automaton_equals_plain_wildcards(globs):
    hosts = ["", "a.com", ".a.com", "x.a.com", "abc", "bb", "abab", "a" * 70 + "b" + "b", "ads"]
    paths = ["", "/", "/x", "/xy/ads/z", "/ads/", "//ads//b", "b"]
    texts = [(h, p) for h in hosts for p in paths]
    found = url_filter.simulate(url_filter.compile_globs(globs), [h.encode() + b"\xff" + p.encode() for h, p in texts])
    for row, (h, p) in zip(found, texts):
        assert [bool(x) for x in row] == [plain_match(f"{gh}|{gp}", f"{h}|{p}") for gh, gp in globs], (h, p)


def test_urls_of_all_kinds(spark):
    rows = [(1, "http://www.example.com/en/1?q", "x"), (2, None, "x"), (3, "no mark", "x"), (4, "HTTP://EXAMPLE.COM", "x"),
            (5, "https://a.b.example.com/en/", "x"), (6, "http://x.net/es/#f", "x"), (7, "http://xnet/es/", "x"),
            (None, "http://x.net/es/", "x"), (8, "ftp://Ä.COM/" + "a/" * 5000, "x"), (9, "http://com/", "x"), (9, "http://com/", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = {(r.page_id, r.host, r.path[:6], r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got == {(1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "", "", None, "allow"),
                   (3, "", "", None, "allow"), (4, "example.com", "", None, "allow"),
                   (5, "a.b.example.com", "/en/", "example.com/en/", "block"), (6, "x.net", "/es/", "net/es/", "block"),
                   (7, "xnet", "/es/", None, "allow"), (None, "x.net", "/es/", "net/es/", "block"),
                   (8, "Ä.com", "/a/a/a", "com/", "allow"), (9, "com", "/", "com/", "allow")}
    assert url_filter.judge_urls(df).count() == len(rows)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def plain_places(text):
    import re
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hits = [(i, lab) for p, lab in license_scan.BASE_PHRASES.items() for i in range(len(words))
            if words[i:i + len(p.split())] == p.split()]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({lab for _, lab in hits}))


def test_license_words_and_places(spark):
    texts = [None, "", "MIT License", "mit-license; MIT\nlicense mit mit license", "amit license", "general public license MIT licenses",
             "The Apache  License, GNU General Public License é mit license", "x " * 30000 + "mit license" + " y" * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_places(text), text
        assert 0 <= r.score <= 1 and (r.score == 0) == (r.labels == "")
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, ok, labels", [
    ("MIT", True, {"mit"}), ("GPL-2.0-only", False, {"gpl"}), ("MIT OR GPL-3.0", True, {"mit", "gpl"}),
    ("(MIT and GPL-3.0)", False, {"mit", "gpl"}), ("GPL-2.0 WITH Classpath-exception-2.0 */", True, {"gpl"}),
    ("MIT or (Apache-2.0 and GPL-2.0) or BSD-3-Clause # x", True, {"mit", "apache", "gpl", "bsd"}),
    ("GPL-2.0 and (MIT or GPL-3.0)", False, {"mit", "gpl"}), ("MIT and", True, {"mit"})])
def test_expressions(text, ok, labels):
    assert license_scan.evaluate(license_scan.to_postfix(text)) == (ok, labels)


@pytest.mark.parametrize("text", ["", "and", "(", ")", "or MIT", "(MIT", "MIT)"])
def test_broken_expressions(text):
    postfix = license_scan.to_postfix(text)
    assert postfix in ([], ["MIT"])


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder(packing.default_tokenizer())
    texts = ["", " ", "a", " a ", "a  b", "a\tb c\n d", "don't stop 12a1 b'll <|endoftext|> x", "ñ é — 日本 語。", "a  b c d",
             "x" * 5000, "a \x1c b", "tab\t\ttab  two   three"]
    for text in texts:
        want = array("I", encoder.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        assert encoder.encode(text) == want, text


def test_packing_round_trip(spark, tmp_path):
    import zlib
    texts = [None, "", "word " * 3000, "one", "one", "é" * 700] + [f"text number {i} " * (i % 97) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string").repartition(2)
    docs.write.parquet(str(tmp_path / "docs"))
    rows = packing.pack(spark.read.parquet(str(tmp_path / "docs"))).collect()
    encoder = packing.Encoder(packing.default_tokenizer())
    ids = {i: encoder.encode(t or "") + bytes(4) for i, t in enumerate(texts)}
    taken = {i: bytearray(len(v) // 4) for i, v in ids.items()}
    windows: dict[int, list] = {}
    for r in rows:
        piece = ids[r.doc_id][4 * r.start:4 * (r.start + r.length)]
        assert r.length > 0 and len(piece) == 4 * r.length and zlib.crc32(piece) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id]) // 4
        for k in range(r.start, r.start + r.length):
            taken[r.doc_id][k] += 1
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(set(t) == {1} for t in taken.values())
    padding = 0
    for pieces in windows.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= packing.WIDTH
        padding += 0 if end & (end - 1) == 0 else packing.WIDTH - end
    assert padding == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_level_choice_is_the_least_sum_of_squares():
    import random
    rng, packer = random.Random(1), packing.Packer(width=16)
    for _ in range(400):
        n = rng.randint(1, 15)
        counts = packer.levels.copy()
        level = packer.level_for(n)

        def total(h):
            after = counts.copy()
            if h:
                after[h] -= 1
            if h + n < 16:
                after[h + n] += 1
            return (after ** 2).sum()
        possible = [h for h in range(17 - n) if h == 0 or counts[h]]
        assert level in possible and total(level) == min(map(total, possible))
        list(packer.put(0, bytes(4 * n)))
