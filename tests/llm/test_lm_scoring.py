"""Scores against a plain context tree and a plain word count."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import lm_scoring as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Plain:
    """The tree as the docstring has it, by dictionaries."""

    def __init__(self, texts, order):
        self.order, self.follow = order, defaultdict(Counter)
        for t in texts:
            data = self.spelled(t)
            for i in range(order, len(data)):
                for o in range(order + 1):
                    self.follow[bytes(data[i - o : i])][data[i]] += 1

    def spelled(self, text):
        return b"\xfe" * self.order + lower(text).encode() + b"\xff"

    def p(self, context, byte):
        """Exclusion by the book: bytes seen in a longer context are scaled out of the shorter one's shares."""
        seen = self.follow.get(context)
        below = (lambda b: self.p(context[1:], b)) if context else (lambda b: 1 / 256)
        if not seen:
            return below(byte)
        n, q = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (n + q)
        return q / (n + q) * below(byte) / (1 - sum(below(b) for b in seen))

    def score(self, text):
        data = self.spelled(text)
        return sum(math.log10(self.p(bytes(data[i - self.order : i]), data[i])) for i in range(self.order, len(data)))


def plain_words(learn):
    count = Counter(w for t in learn for w in WORD.findall(lower(t)))
    n, v, ends = sum(count.values()) + len(learn), len(count) + bool(learn), len(learn)

    def score(text):
        own = [count[w] for w in WORD.findall(lower(text))] + [ends]
        return len(own), sum(c > 0 for c in own), n, sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in own)

    return score


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


ROWS = [(i, t) for i, t in enumerate(
    ["the cat sat", "The Cat sat on\tthe mat", "", None, " ", "\n\x0b x", "été Ünder \U0001f600", "aaaa aaaa aaaa", "the", "b" * 3000, "the cat sat", "the cat sat", "zq zq", "a" * 40 + " end"]
    + [f"word{i % 7} of text {i}" for i in range(40)]
)] + [(None, "no id"), (3, "again"), (3, "again")]


@pytest.mark.parametrize(("order", "blocks"), [(4, 1), (4, 7), (2, 3), (6, 2)])
def test_against_brute_force(spark, order, blocks):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in ROWS], "doc_id long, text string, share string, block double").repartition(3)
    learn = [t or "" for i, t in ROWS if not held(i)]
    model, words = Plain(learn, order), plain_words(learn)
    found = lm.score(docs, lm.learned(F.col("doc_id")), order=order, least_blocks=blocks).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *(round(x, 6) for x in r[1:]))
    expected = sorted(((i, *words(t), model.score(t)) for i, t in ROWS), key=key)
    assert len(found) == len(expected)
    for mine, theirs in zip(sorted(map(tuple, found), key=key), expected):
        assert mine[:4] == theirs[:4]
        assert mine[4:] == pytest.approx(theirs[4:], rel=1e-9)


def test_shares_add_to_one():
    model = Plain(["the cat sat", "a cat", "x"], 3)
    for context in (b"", b"t", b"at", b"cat", b"zzz", b"\xfe\xfe\xfe"):
        assert sum(model.p(context, b) for b in range(256)) == pytest.approx(1)


def test_levels_numbered_by_sorting_and_in_pieces(monkeypatch):
    texts = [b"abracadabra", b"", b"abc" * 50, b"ca"]
    expected = lm.Strings(texts, 3)
    ids, every, first = expected.number(2)
    monkeypatch.setattr(lm, "DENSE", 0)
    monkeypatch.setattr(lm, "PIECE", 7)
    other = lm.Strings(texts, 3)
    ids2, every2, first2 = other.number(2)
    assert (ids == ids2).all() and other.offset == expected.offset
    for a, b in zip(every[1:] + first[1:], every2[1:] + first2[1:]):
        assert (a == b).all()
    assert sum(first[4]) == len(b"abracadabra") + 2  # a string for each byte and end mark of the two texts
    assert sum(every[4]) == sum(len(t) + 1 for t in texts)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in lm.score(docs, F.lit(False)).collect()}
    assert found[1].score == pytest.approx(-3 * math.log10(256)) and found[2].score == pytest.approx(-math.log10(256))
    assert (found[1].n_tokens, found[1].n_known, found[1].train_tokens) == (2, 0, 0) and found[1].base_score == pytest.approx(0)
    assert lm.score(docs.limit(0), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        lm.score(docs, F.lit(True), order=7)


def test_held_out_text_is_shorter_than_under_words_of_equal_shares(spark):
    """On the given table the tree predicts unseen documents far better than equal shares do, and better than its order-1 form."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bits = {}
    for order in (1, 4):
        done = lm.score(docs, lm.learned(F.col("doc_id")), order=order).join(docs, "doc_id").where(~lm.learned(F.col("doc_id")))
        total, size = done.agg(F.sum("score"), F.sum(F.octet_length("text") + 1)).first()
        bits[order] = -total / math.log10(2) / size
    assert bits[4] < bits[1] < 5 and np.isfinite(bits[4])
