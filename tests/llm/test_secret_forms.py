"""Secret scan: words of all documents count; assigned values of all forms are candidates."""

from lodestrata.llm import secret_scan


def test_words_are_counted_over_all_documents(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('common ', if(id % 100 = 7, 'ruhig', 'Calm')) AS text")
    got = {r.word: r["count"] for r in secret_scan.words_of(docs).collect()}
    assert got == {"common": 5000, "calm": 4950, "ruhig": 50}


def test_assigned_values_of_all_forms(spark):
    texts = {"password = hunter2abc": "hunter2abc", "password: hunter2abc": "hunter2abc", '{"password": "abc123xyz"}': "abc123xyz",
             "password=P@ss.w0rd#2024!long": "P@ss.w0rd#2024!long", "token :  'a1b2c3d4e5', x": "a1b2c3d4e5", "pwd=abc12345; x": "abc12345",
             "secret => qwerty12!": "qwerty12!", "GET /x?token=abcdefgh12345678&user=someone": "abcdefgh12345678",
             "API_KEY=abcdefghijklmnop1234!x": "abcdefghijklmnop1234!x"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secret_scan.scan_secrets(docs).collect()
    assert sorted((r.doc_id, r.secret) for r in got) == list(enumerate(texts.values()))
    assert all(list(texts)[r.doc_id][r.start:r.start + r.length] == r.secret for r in got)
    assert {r.doc_id for r in got if r.is_secret} >= set(range(7))
    long = spark.createDataFrame([(1, "password=" + "aB3$&" * 30_000 + ", x")], "doc_id long, text string")
    assert [r.secret for r in secret_scan.candidates(long).collect()] == ["aB3$&" * 30_000]
