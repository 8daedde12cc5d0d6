"""Run-length cuts against a token list, and exact round trips."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import fill_in_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet=" \n\tab<PSM>é \U0001f600", max_size=30), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from(["token", "character"]), st.data())
def test_offsets_are_those_of_a_token_list(texts, unit, data):
    runs = fim.Runs(texts, unit)
    lists = [TOKEN.findall(t) if unit == "token" else list(t) for t in texts]
    assert runs.units().tolist() == [len(x) for x in lists]
    cuts = np.array([data.draw(st.integers(0, len(x))) for x in lists], dtype=np.int64)
    assert runs.offset(cuts).tolist() == [len("".join(x[:c])) for x, c in zip(lists, cuts)]


def brute(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return "plain", text, len(units), None, None
    if h4 % 100 < 80:
        return "spm", f"<S>{s}<P>{p}<M>{m}", len(units), len(p), len(m)
    return "psm", f"<P>{p}<S>{s}<M>{m}", len(units), len(p), len(m)


def test_transform_against_brute_force(spark):
    texts = ["", None, " ", "one", "a b  c\nd ", "\t x", "<P> in text", "half <", "P> <S", "é ü \U0001f600 z", "w " * 50_000, "same text", "same text"]
    rows = [(i * 13 + j, t, "mine", 7) for i in range(30) for j, t in enumerate(texts)] + [(None, "of no id", "mine", 7), (5, "again", "mine", 7), (5, "again", "mine", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim string, fim_units int").repartition(7)
    done = fim.transform(docs)
    assert done.columns == ["doc_id", "text", "fim", *fim.ADDED]
    found = done.withColumn("back", fim.restored(done.fim_text, done.fim_form)).collect()
    assert len(found) == len(rows) and {r.fim_form for r in found} == {"plain", "spm", "psm"}
    for r in found:
        assert (r.fim_form, r.fim_text, r.fim_units, r.fim_prefix_chars, r.fim_middle_chars) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.fim == "mine"


def test_character_units_and_rates(spark):
    docs = spark.createDataFrame([(i, f"text {i} of some length") for i in range(200)], "doc_id long, text string")
    done = fim.transform(docs, rate=100, spm_rate=0, unit="character").collect()
    assert {r.fim_form for r in done} == {"psm"} and all(r.fim_units == len(r.text) for r in done)
    assert {r.fim_form for r in fim.transform(docs, rate=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fim.transform(docs, unit="line")


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
