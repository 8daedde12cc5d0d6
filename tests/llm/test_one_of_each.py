"""Which row of a group of near copies stays."""

from lectern.llm import jaccard_join

A = " ".join(f"alpha{i}" for i in range(40))
B = " ".join(f"beta{i}" for i in range(40))
C = " ".join(f"gamma{i}" for i in range(40))


def kept(spark, rows, schema="doc_id long, text string"):
    found = jaccard_join.one_of_each(spark.createDataFrame(rows, schema).repartition(3), words=5, percent=80).collect()
    return sorted(map(tuple, found), key=str)


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    assert kept(spark, [(1, A), (5, A), (5, B)]) == [(1, A), (5, B)]
    assert kept(spark, [(5, A), (5, B)]) == [(5, A), (5, B)]
    near = A + " more"
    [(i, text)] = kept(spark, [(5, A), (5, near)])
    assert i == 5 and text in (A, near)
    assert kept(spark, [(5, A), (5, near)]) == kept(spark, [(5, near), (5, A)])


def test_rows_without_an_id_come_last(spark):
    assert kept(spark, [(None, A), (9, A), (None, B), (None, B)]) == [(9, A), (None, B)]


def test_equal_rows_leave_one_and_empty_texts_stay(spark):
    rows = [(7, C, "y"), (7, C, "x"), (8, C, "a"), (3, None, "n"), (3, None, "n"), (4, "", "e"), (6, " \\n", "e")]
    assert kept(spark, rows, "doc_id long, text string, own string") == sorted([(7, C, "x"), *rows[3:]], key=str)


def test_chains_long_texts_and_empty_tables(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [(10 + k, " ".join(words[k : k + 45])) for k in range(6)]  # each near to the next, the ends are not
    long = " ".join(f"v{i % 5000}" for i in range(200_000))
    assert kept(spark, [*chain, (50, long), (49, long + " end")]) == sorted([chain[0], (49, long + " end")], key=str)
    assert kept(spark, []) == []
