import math
import random

from lectern.llm import language_id
from lectern.llm.shared import held_out

SF = "/root/testdata/sf0.01"


def brute_code_length(text: bytes, train: list[bytes], every: list[bytes] | None = None) -> float:
    """PPM by the book, with dictionaries: escape method C with exclusion, contexts of three to no bytes.

    ``every`` are the training texts of all languages, whose bytes have symbols of their own."""
    counts: dict[bytes, dict[int, int]] = {}
    for t in train:
        data = b"\n\n\n" + t
        for i in range(3, len(data)):
            for order in range(4):
                counts.setdefault(data[i - order : i], {}).setdefault(data[i], 0)
                counts[data[i - order : i]][data[i]] += 1
    symbols = sorted(set(b"\n" + b"".join(every or train)))
    n = len(symbols) + 1  # and one for all other bytes

    def p(symbol: int | None, context: bytes) -> float:
        seen = counts.get(context, {})
        # lower orders count only what the order-3 model has counted, so every context's counts are sums of grams
        shorter = (lambda s: p(s, context[1:])) if context else (lambda s: 1 / n)
        if not seen:
            return shorter(symbol)
        total, kinds = sum(seen.values()), len(seen)
        if symbol in seen:
            return seen[symbol] / (total + kinds)
        left = 1 - sum(shorter(s) for s in seen)
        return kinds / (total + kinds) * shorter(symbol) / max(left, 1e-12)

    data = b"\n\n\n" + text
    bits = 0.0
    for i in range(3, len(data)):
        known = data[i] in symbols
        bits -= math.log2(p(data[i] if known else None, data[i - 3 : i]))
        if not known:
            bits += math.log2(256 - len(symbols))
    return bits


def test_code_lengths_against_ppm_by_the_book(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CONTEXT_COUNT", 1)
    train = {"aa": ["abracadabra abra", "cadabra"], "bb": ["banana bandana", "nab a ban"]}
    rows = [(i, t, lang) for lang, texts in train.items() for i, t in enumerate(texts)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]
    every = [t.encode() for texts in train.values() for t in texts]
    compared = 0
    for text in (b"abra", b"banana", b"a ban", b"nabracad", b"drab", b"", b"zebra"):
        for k, lang in enumerate(model.languages):
            compared += 1
            assert abs(model.code_lengths(text)[k] - brute_code_length(text, [t.encode() for t in train[lang]], every)) < 1e-3
    assert compared == 14


def test_rare_languages_and_many_copies(spark):
    """More than 64 languages can all be predicted; repeated rows and null texts don't use up a language's rows."""
    letters = random.Random(1)
    words = ["".join(letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(80)]
    rows = [(i, w, f"l{i:02}") for i, w in enumerate(words)] + [(500, "same text", "zz")] * 3000 + [(501, None, "zz")] * 500 + [(502 + i, f"other text {i}", "zz") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, rows_per_language=6)
    assert len(model.languages) == 81
    assert language_id.score_texts(model, words)[0] == [f"l{i:02}" for i in range(80)]
    known = df.where("text is not null")
    drawn = language_id._drawn(known, 6).where("lang = 'zz'").collect()
    assert sorted(r.text for r in drawn) == sorted(["same text"] + [f"other text {i}" for i in range(5)])
    assert language_id._drawn(known, 2).where("lang = 'zz'").count() == 2


def test_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([(1, "same words", "bb"), (2, "same words", "aa")], "doc_id long, text string, lang string")
    assert language_id.score_texts(language_id.fit(df), ["same"]) == (["aa"], [0.5])


def test_single_language_equals_the_book(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CONTEXT_COUNT", 1)
    texts = ["the cat\nsat on the mat", "a cat and a hat", "that is that"]
    model = language_id.fit(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    for text in (b"the hat", b"cat cat", b"zebra!", b"", "café".encode()):
        assert abs(model.code_lengths(text)[0] - brute_code_length(text, [t.encode() for t in texts])) < 1e-2


def test_long_texts_in_pieces(spark, monkeypatch):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"), rows_per_language=20)
    text = b"the one and only " * 500
    whole = model.code_lengths(text)
    monkeypatch.setattr(language_id, "PIECE", 1000)
    assert abs(model.code_lengths(text) - whole).max() < 1e-2


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(language_id.training_rows(docs))
    rows = language_id.predict(docs, model).where(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.lang_score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "12 !?", None, 1), (4, "hello world", "en", 1), (4, "hello world", "en", 1), (None, "x" * 100000, "de", 1)], "doc_id long, text string, lang string, judged int")
    rows = language_id.predict(docs, language_id.fit(docs)).collect()
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 3)] == ["und"] * 3 and len(rows) == 6
    assert all(r.lang_score == 0 for r in rows if r.lang_pred == "und")
    empty = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), language_id.fit(docs)).count() == 0
