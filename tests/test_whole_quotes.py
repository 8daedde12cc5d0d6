"""Quotes of any number and length are found, as by brute force."""

import pytest

from lectern.plans import documents, registry

TEXTS = ["one two  three\nfour five six seven", "phone twofold one two  three\nfour fivefold six", "a b", "", "one one one one one one one one"]
QUOTES = [
    "one", "ne tw", "a b", "one two  three", "one two  three\nfour five", "e two  three\nfour five s", " twofold one two  three\nfour fi", "one two  three\nfour five six seven",
    "one two three four five six", "one one one one one one", "ne one one one one one o", "zzz", "one two  three\nfour five six seven",
]


def brute():
    return sorted((i, d, t.find(q), t.find(q) + len(q)) for i, q in enumerate(QUOTES) for d, t in enumerate(TEXTS) if q in t)


@pytest.mark.parametrize("most", [10_000, 0])
def test_short_and_cut_quotes(spark, most):
    asks = spark.createDataFrame(list(enumerate(QUOTES)), "item_id long, quote string")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert sorted(map(tuple, documents._quotes_found(asks, docs, most).collect())) == brute()


def test_short_quotes_by_the_query(spark, tmp_path):
    spark.createDataFrame(list(enumerate(QUOTES)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, registry.QUERIES["exact_quotes"](spark, str(tmp_path)).collect())) == brute()


def test_more_quotes_than_are_broadcast(spark, tmp_path):
    n = 10_050
    quote = [" ".join(f"w{i}x{k}" for k in range(7)) for i in range(n)]
    spark.createDataFrame(list(enumerate(quote)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [". ".join(quote[i : i + 50]) for i in range(0, n, 50)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["exact_quotes"](spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.doc_id) for r in got) == [(i, i // 50) for i in range(n)]
