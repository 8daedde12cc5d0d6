"""The lexical queries index whole documents with the full analyser."""

import hashlib

from conftest import SF

from lectern.functions import text as tx
from lectern.plans import registry

registry.load()
ODD = ["The state-of-the-art of A/B", "Straße école", "数据库 ok数据 库x v1.2.3-数据库", " ".join(f"w{i}" for i in range(5000)), "", "the of"]


def write(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "state-of-the-art"), (1, "数据库"), (2, "w4095 w4096")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_lexeme_index_holds_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert any(len(r.text) >= 4000 for r in docs)
    want = {r.doc_id: tx.lexemes_of(r.text, tx.MAX_DOCUMENT_LEXEMES) for r in docs}
    want = {i: (len(x), hashlib.sha256(" ".join(x).encode()).hexdigest()) for i, x in want.items() if x}
    assert {r.chunk_id: (r.n, r.lexical_hash) for r in registry.QUERIES["lexeme_index"](spark, SF).collect()} == want


def test_joined_words_ideographs_and_the_limit(spark, tmp_path):
    write(spark, tmp_path, ODD)
    rows = {r.chunk_id: (r.n, r.lexical_hash) for r in registry.QUERIES["lexeme_index"](spark, str(tmp_path)).collect()}
    want = {i: tx.lexemes_of(t, tx.MAX_DOCUMENT_LEXEMES) for i, t in enumerate(ODD)}
    assert rows == {i: (len(x), hashlib.sha256(" ".join(x).encode()).hexdigest()) for i, x in want.items() if x}
    assert rows[3][0] == 4096
    hits = {(r.query_id, r.chunk_id): r.matched for r in registry.QUERIES["lexical_topk"](spark, str(tmp_path)).collect()}
    assert hits == {(0, 0): 3, (1, 2): 2, (2, 3): 1}


def test_sql_says_the_same_of_odd_texts(spark, tmp_path):
    import duckdb

    write(spark, tmp_path, ODD)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = {r.chunk_id: (r.n, r.lexical_hash) for r in registry.QUERIES["lexeme_index"](spark, str(tmp_path)).collect()}
    assert {i: (n, h) for i, n, h in c.execute(registry.ORACLES["lexeme_index"]).fetchall()} == rows


def test_a_word_is_analysed_once_a_text(monkeypatch):
    from lectern.functions import text

    seen, real = [], text._emitted
    monkeypatch.setattr(text, "_emitted", lambda word: seen.append(word) or real(word))
    assert text.lexemes_of("é a-b x a-b é the a-b", 4096) == ["é", "a_b", "b", "x"]
    assert seen.count("a-b") == 1
    seen.clear()
    assert text.lexemes_of("Größe é Größe the é", 4096) == ["grösse", "é"] and not seen
    assert text.lexemes_of("Größe é x", 2) == ["grösse", "é"]
