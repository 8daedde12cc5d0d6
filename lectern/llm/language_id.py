"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of variable order (up to three bytes) holds frozen counts. A byte's
probability comes from the longest context of the tree that the text is in; a byte unseen there escapes to the next
shorter context (escape method C, with exclusion of the bytes already ruled out), down to a uniform order -1. The
code length of a text under a language is the sum of -log2 of these probabilities: exact, not an estimate, as no count
changes while scoring. The language with the shortest code wins.

With frozen counts a tree is a finite automaton. Each worker compiles it once from the counts of four-byte grams: tables
that give the longest known context after any three bytes, and the cost of each next byte there; scoring is then a few
array lookups a byte and language. Tables hold only contexts that the language has, so a model grows with the number of
languages, by some megabytes each, and no language, byte or context of fewer than three bytes is left out. Order three
keeps an automaton at that size; its held-out accuracy leaves a higher order nothing to gain.

Defined results: null text, or text without a letter, gives ``und`` and score 0; empty training data give ``und`` for
every row; ties go to the alphabetically first language. Rows are independent, so repeated rows get equal results; among
training rows they count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import chunks, fresh, held_out, small_batches

UNDETERMINED = "und"
#: Labelled rows used to fit, at most, for each language: the bound of the training sample.
ROWS_PER_LANGUAGE = 400
#: A context of three bytes is in a language's tree if it makes up this share of its sample and has so many occurrences.
CONTEXT_SHARE, CONTEXT_COUNT = 1 / 20_000, 4
#: Bytes scored at a time; longer texts go in pieces that carry the context over.
PIECE = 1 << 18
_LETTER = regex.compile(r"\p{L}")


@dataclass
class _Automaton:
    """A language's compiled tree. Rows of ``cost`` are contexts: none, one byte, seen pairs, kept triples."""

    pair: np.ndarray  # first two symbols -> number of the pair, 0 if no kept triple starts with it
    triple: np.ndarray  # (number of the pair, third symbol) -> row of the triple, or 0
    double: np.ndarray  # last two symbols -> row of the pair, or of the last symbol
    cost: np.ndarray  # (row, next symbol) -> bits


class PpmModel:
    """Counts of four-byte grams of each language, compiled where the model is first used."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(grams)
        self.grams = [grams[lang] for lang in self.languages]
        self._ready: tuple[np.ndarray, list[_Automaton]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}  # only the counts travel

    def compiled(self) -> tuple[np.ndarray, list[_Automaton]]:
        """byte -> symbol, and the automata. Bytes of no language share the last symbol."""
        if self._ready is None:
            seen = np.zeros(256, dtype=bool)
            seen[10] = True  # what stands before a text
            for gram, _ in self.grams:
                seen[(gram & 255).astype(np.int64)] = True
            own = np.flatnonzero(seen)
            symbol = np.full(256, len(own), dtype=np.int32)
            symbol[own] = np.arange(len(own))
            self._ready = symbol, [_compiled(symbol, len(own) + 1, *g) for g in self.grams]
        return self._ready

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of ``data`` under each language."""
        return self.batch_code_lengths([data])[0]

    def batch_code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language. Short texts are scored together, long ones in pieces."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if size + len(t) > PIECE and held:
                self._score(held, [texts[k] for k in held], out)
                held, size = [], 0
            if len(t) > PIECE:
                for at in range(0, len(t), PIECE):
                    self._score([i], [t[max(0, at - 3) : at + PIECE]], out, skip=min(at, 3))
            elif t:
                held.append(i)
                size += len(t)
        if held:
            self._score(held, [texts[k] for k in held], out)
        return out

    def _score(self, rows: list[int], texts: list[bytes], out: np.ndarray, skip: int = 0) -> None:
        symbol, automata = self.compiled()
        n = int(symbol.max()) + 1
        pad = b"\n\n\n"  # before the first byte of each text
        sym = symbol[np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8)]
        first, last = sym[:-3] * n + sym[1:-2], sym[1:-2] * n + sym[2:-1]
        ends = np.cumsum([len(t) + 3 for t in texts]) - 3
        starts = np.concatenate([[0], ends[:-1] + 3])
        for k, a in enumerate(automata):
            row = np.maximum(a.triple[a.pair[first] * n + sym[2:-1]], a.double[last])  # triples come after pairs
            run = np.concatenate([[0.0], np.cumsum(a.cost[row * n + sym[3:]], dtype=np.float64)])
            out[rows, k] += run[ends] - run[starts + skip]


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): four-byte grams of the sample's texts, counted on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per: dict[str, list[bytes]] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                per.setdefault(lang, []).append(b"\n\n\n" + text.encode())
            for lang, texts in per.items():
                data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
                if len(data) > 3:
                    own = np.ones(len(data), dtype=bool)  # what stands before a text follows no byte
                    own[(np.cumsum([0] + [len(t) for t in texts[:-1]])[:, None] + np.arange(3)).ravel()] = False
                    every = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
                    gram, n = np.unique(every[own[3:]], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(gram), "gram": gram.astype(np.int64), "n": n.astype(np.int64)})

    return sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Rows of probabilities of a context's next symbol, from its counts and the shorter context's probabilities."""
    if len(counts) > 1024:  # in parts, for memory
        return np.concatenate([_blend(counts[a : a + 1024], shorter[a : a + 1024]) for a in range(0, len(counts), 1024)])
    total = counts.sum(axis=1, keepdims=True)
    kinds = (counts > 0).sum(axis=1, keepdims=True)
    left = np.maximum(1 - np.where(counts > 0, shorter, 0).sum(axis=1, keepdims=True), 1e-12)
    full = kinds == counts.shape[1]
    escape = np.where(full, 0, kinds / np.maximum(total + kinds, 1))
    p = np.where(counts > 0, counts / np.maximum(np.where(full, total, total + kinds), 1), escape * shorter / left)
    return np.where(total > 0, p, shorter)


def _compiled(symbol: np.ndarray, n: int, gram: np.ndarray, count: np.ndarray) -> _Automaton:
    """A language's automaton over ``n`` symbols, from its grams' counts."""
    a, b, c, d = (symbol[((gram >> s) & 255).astype(np.int64)].astype(np.int64) for s in (24, 16, 8, 0))
    weight = count.astype(np.float64)

    def next_counts(context: np.ndarray, contexts: int, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(context * n + d[of], weights=weight[of], minlength=contexts * n).reshape(contexts, n)

    pairs, at_pair = np.unique(b * n + c, return_inverse=True)
    triples, at_triple = np.unique((a * n + b) * n + c, return_inverse=True)
    often = np.bincount(at_triple, weights=weight, minlength=len(triples))
    kept = np.flatnonzero(often >= max(CONTEXT_COUNT, CONTEXT_SHARE * weight.sum()))
    place = np.full(len(triples), -1)
    place[kept] = np.arange(len(kept))
    inside = np.flatnonzero(place[at_triple] >= 0)
    triples = triples[kept]

    order1 = next_counts(c, n)
    p0 = _blend(order1.sum(axis=0, keepdims=True), np.full((1, n), 1 / n))
    p1 = _blend(order1, np.repeat(p0, n, axis=0))
    p2 = _blend(next_counts(at_pair, len(pairs)), p1[pairs % n])
    p3 = _blend(next_counts(place[at_triple[inside]], len(kept), inside), p2[np.searchsorted(pairs, triples % (n * n))])
    bits = -np.log2(np.maximum(np.concatenate([p0, p1, p2, p3]), 1e-30))
    bits[:, n - 1] += np.log2(max(1, 256 - (n - 1)))  # which of the bytes that share the last symbol

    double = np.tile(1 + np.arange(n, dtype=np.int32), n)
    double[pairs] = 1 + n + np.arange(len(pairs))
    heads, at_head = np.unique(triples // n, return_inverse=True)
    pair = np.zeros(n * n, dtype=np.int32)
    pair[heads] = 1 + np.arange(len(heads))
    triple = np.zeros((len(heads) + 1) * n, dtype=np.int32)
    triple[(1 + at_head) * n + triples % n] = 1 + n + len(pairs) + np.arange(len(triples))
    return _Automaton(pair, triple, double, bits.astype(np.float32).reshape(-1))


#: The range of a draw, xxhash64's values.
_LOWEST, _RANGE = -(1 << 63), 1 << 64


def _drawn(rows: DataFrame, per_language: int) -> DataFrame:
    """(text, lang): the ``per_language`` distinct rows of each language with the smallest hashes of id and text.

    A sketch of each language's number of distinct rows bounds the hashes from above such that some more rows than wanted
    stay; the exact bounds come from these few, so no language's rows meet in one task, however many they are.
    """
    drawn = rows.select("text", "lang", F.xxhash64("doc_id", "text", F.lit(17)).alias("draw"))

    def up_to(edges: dict[str, int]) -> DataFrame:
        of = F.create_map(*[F.lit(x) for pair in edges.items() for x in pair])
        return drawn.where(F.col("draw") <= of[F.col("lang")])

    distinct = drawn.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n"))
    counts = {r["lang"]: r["n"] for r in distinct.collect()}  # one row a language
    if not counts:
        return drawn.select("text", "lang")
    some = 1.2 * (per_language + 8 * per_language**0.5 + 20)
    loose = up_to({lang: min(_LOWEST + int(some / n * _RANGE), -_LOWEST - 1) for lang, n in counts.items()})
    draws: dict[str, list[int]] = {}
    for r in loose.select("lang", "draw").distinct().collect():  # about ``some`` rows a language
        draws.setdefault(r["lang"], []).append(r["draw"])
    exact = up_to({lang: sorted(found)[:per_language][-1] for lang, found in draws.items()})
    return exact.dropDuplicates(["lang", "draw"]).select("text", "lang")


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> PpmModel:
    """Fits on ``labelled`` (doc_id, text, lang): at most ``rows_per_language`` distinct rows of each language, drawn by a hash."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    table = _counts(_drawn(rows, rows_per_language)).toArrow()  # bounded by the sample
    grams: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    if table.num_rows:
        names = table["lang"].combine_chunks().dictionary_encode()
        code, gram, count = names.indices.to_numpy(), table["gram"].to_numpy().astype(np.uint32), table["n"].to_numpy()
        for k, lang in enumerate(names.dictionary.to_pylist()):
            grams[lang] = (gram[code == k], count[code == k])
    return PpmModel(grams)


def score_texts(model: PpmModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and the posterior probability (equal priors) of each text."""
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if t is not None and model.languages and _LETTER.search(t)]
    bits = model.batch_code_lengths([texts[i].encode() for i in rows])
    if rows:
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        for i, b, s in zip(rows, best, share):
            names[i], scores[i] = model.languages[b], float(s)
    return names, scores


def predict(docs: DataFrame, model: PpmModel, text: str = "text", out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the language and its score added (in place of columns of those names)."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # the counts of a bounded sample

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = shared.value
        for texts in batches:
            names, scores = [], []
            for part in chunks(texts.to_pylist(), 512):
                a, b = score_texts(ready, part)
                names += a
                scores += b
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "lang_score"])

    judge = F.arrow_udf(score, "lang_pred string, lang_score double")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in [o.lower() for o in out]]
    name = fresh(docs, "judged")
    judged = docs.select(*kept, judge(F.col(f"`{text}`")).alias(name))
    return judged.select(*kept, F.col(f"{name}.lang_pred").alias(out[0]), F.col(f"{name}.lang_score").alias(out[1]))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: those that are not held out."""
    return docs.where(~held_out(F.col("doc_id")))


def accepted(lang: Column, score: Column, at_least: float = 0.5) -> Column:
    """A document stays if a language was found, with some certainty."""
    return (lang != UNDETERMINED) & (score >= at_least)
