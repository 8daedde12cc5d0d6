import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lectern.llm import gumbel_pieces, packing

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_supersteps_equal_sequential_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
    record, opened = packing.supersteps(Counter(lengths), capacity)
    assert opened == best_fit_decreasing(lengths, capacity)
    placed, ranks = {}, Counter()
    for length, start, count, first, offset in record.tolist():
        for k in range(count):
            ranks[length, start + k] += 1
            placed.setdefault(first + k, []).append((offset, length))
    assert all(n == 1 for n in ranks.values()) and len(ranks) == len(lengths)
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_pack_whole_table(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a <|endoftext|> b"), (-4, "x"), (-4, "x"), (None, " " * 5000 + "y")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    out = packing.pack(rows, BPE).toPandas()
    slow = Tokenizer.from_file(BPE)
    pieces = {}
    for r in rows.collect():
        ids = slow.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = sorted({0, *range(first, len(ids) + 1, 1024)} if first else {*range(0, len(ids) + 1, 1024)})
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            if b > a:
                pieces[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] = pieces.get((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())), 0) + 1
    got = Counter((None if np.isnan(d) else int(d), int(p), int(s), int(n), int(c)) for d, p, s, n, c in zip(out["doc_id"], out["piece"], out["start"], out["length"], out["ids_crc32"]))
    assert got == pieces
    filled = out.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 1024
    assert len(filled) == best_fit_decreasing(out["length"].tolist(), 1024)
    by = out.sort_values(["sequence_id", "offset"])
    assert (by["offset"] == by.groupby("sequence_id")["length"].cumsum() - by["length"]).all()


def test_pack_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rank string")
    assert packing.pack(empty, BPE).count() == 0
    two = packing.pack(spark.createDataFrame([(1, "hello", 1), (2, None, 2)], "doc_id long, text string, base int"), BPE, with_ids=True).collect()
    assert {tuple(r.ids) for r in two} == {(31373, 2), (2,)}


@pytest.fixture(scope="module")
def lattices():
    return gumbel_pieces.Lattices(gumbel_pieces.Vocabulary(PIECES))


def segmentations(lattices, text):
    unit = "▁" + text.replace(" ", "▁")
    edges = [lattices._pieces(unit, i) for i in range(len(unit))]
    out = {}

    def go(i, ids, w):
        if i == len(unit):
            out[tuple(ids)] = w
        else:
            for j, piece, x in edges[i]:
                go(j, [*ids, piece], w * x)

    go(0, [], 1.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_all_segmentations_in_the_end(lattices):
    every = segmentations(lattices, "these")
    [samples] = gumbel_pieces.sample_texts(lattices, [1], ["these"], 1000, 5)
    assert {tuple(s[0].tolist()) for s in samples} == set(every)
    assert len(samples) == len(every)
    assert all(a[2] >= b[2] for a, b in zip(samples, samples[1:]))
    assert all(abs(np.exp(s[1]) - every[tuple(s[0].tolist())]) < 1e-9 for s in samples)
    assert samples[-1][3] == 1.0


@pytest.mark.parametrize("text", ["these", "to be"])
def test_first_two_samples_follow_the_law(lattices, text):
    n = 12000
    every = segmentations(lattices, text)
    drawn = gumbel_pieces.sample_texts(lattices, list(range(n)), [text] * n, 2, 9)
    one = Counter(tuple(s[0][0].tolist()) for s in drawn)
    two = Counter(tuple(s[1][0].tolist()) for s in drawn)
    for path in sorted(every, key=every.get)[-4:]:
        second = sum(q * every[path] / (1 - q) for other, q in every.items() if other != path)
        for found, p in ((one[path] / n, every[path]), (two[path] / n, second)):
            assert abs(found - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4
    assert abs(np.mean([s[0][2] for s in drawn]) - 0.5772) < 0.05  # the largest value is a standard Gumbel variable


def test_samples_do_not_depend_on_the_batch(lattices):
    texts = ["a few words here", "and  some\nmore", "Größe 中 \U0001f600", "x"]
    together = gumbel_pieces.sample_texts(lattices, [1, 2, 3, 4], texts, 3, 1)
    for k, t in enumerate(texts):
        [alone] = gumbel_pieces.sample_texts(gumbel_pieces.Lattices(lattices.vocabulary), [k + 1], [t], 3, 1)
        assert [s[0].tolist() for s in alone] == [s[0].tolist() for s in together[k]]
        assert all(lattices.vocabulary.decode(s[0].tolist()) == t for s in alone)
        assert len({tuple(s[0].tolist()) for s in alone}) == len(alone)


def test_sample_pieces_query_form(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "   "), (-4, "ab" * 30000), (-5, "x"), (-5, "x")], "doc_id long, text string")
    rows = docs.unionByName(extra)
    out = gumbel_pieces.sample_pieces(rows, PIECES, k=3)
    decoded = gumbel_pieces.decode_pieces(out, PIECES).collect()
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert {r.doc_id for r in decoded} == {k for k, t in texts.items() if t is not None}
    for r in decoded:
        assert r.text == texts[r.doc_id]
        assert r.n_bytes == len(r.text.encode()) and r.n_pieces == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        assert r.log_prob <= 0 and 0 <= r.inclusion <= 1
    assert sum(r.doc_id == -5 for r in decoded) == 2 * len({tuple(r.ids) for r in decoded if r.doc_id == -5})
    assert gumbel_pieces.sample_pieces(rows.limit(0), PIECES).count() == 0


def test_units_of_many_rare_characters_and_rows_without_a_key(lattices):
    text = "\U0001f600\U0001f601\U0001f602" * 7 + " ok \U0001f600\U0001f601\U0001f602"
    [samples] = gumbel_pieces.sample_texts(lattices, [3], [text], 2, 1)
    assert all(lattices.vocabulary.decode(s[0].tolist()) == text for s in samples)
    [alone] = gumbel_pieces.sample_texts(gumbel_pieces.Lattices(lattices.vocabulary), [3], [text], 2, 1)
    assert [(s[0].tolist(), s[1:]) for s in alone] == [(s[0].tolist(), s[1:]) for s in samples]
    keys = [gumbel_pieces.hash_key(k) for k in (None, -1, 0, 2**63 - 1)]
    drawn = gumbel_pieces.sample_texts(lattices, keys, ["a longer text of some words"] * 4, 1, 1)
    assert len({s[0][2] for s in drawn}) == 4


def test_decoded_text_takes_the_place_of_a_clashing_column(spark):
    rows = spark.createDataFrame([([31, 32], 7)], "ids array<int>, TEXT int")
    assert gumbel_pieces.decode_pieces(rows, PIECES).columns == ["ids", "text"]


def test_units_are_cut_and_found_for_all_texts_at_once():
    rng = np.random.default_rng(3)
    texts = ["", " ", "a", "▁ b▁", "x \n", "é  中 y ", "\U0001f600" * 30 + " end", *("".join(rng.choice(list("ab ▁\n中"), 12)) for _ in range(200))]
    units, counts = gumbel_pieces.units_of(texts)
    want = [re.findall("▁*[^▁]+|▁+$", "▁" + t.replace(" ", "▁")) for t in texts]
    assert counts.tolist() == [len(x) for x in want]
    assert [u.replace(" ", "▁") for u in units.to_pylist()] == [u for x in want for u in x]
    own, distinct = gumbel_pieces.Lattices(gumbel_pieces.Vocabulary(PIECES)), units.unique()
    first = own.states_of(distinct)
    size = len(own)
    assert own.states_of(distinct).tolist() == first.tolist() and len(own) == size  # known units add nothing
    assert own.states_of(distinct.slice(5, 9)).tolist() == first[5:14].tolist()
    assert gumbel_pieces.units_of([])[1].tolist() == []
