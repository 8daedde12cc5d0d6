"""Language-model scores of documents: prediction by partial matching over bytes, beside a plain model of words.

**Model.** A context tree of byte strings of up to ``ORDER`` bytes holds the counts of what follows them in all training
texts. The probability of a byte comes from the longest context in which it was seen, ``c / (n + q)`` with its count, the
context's count and the number of different bytes seen there (escape estimation C). A byte that was not seen in a context
escapes from it, with ``q / (n + q)``; bytes seen there are excluded below, where the shorter context's shares are scaled up
by the mass that the excluded ones had. Below the empty context all 256 symbols are alike. The counts stay as learned while
scoring ("pretrained"), so the shares of all symbols add to one after any context, and a document's score is the sum of
the log10 probabilities of the bytes of its text, A-Z lower-cased, and of an end mark.

**On Spark.** The tree has no bound and is nowhere gathered: it is a table of strings (up to ``ORDER`` + 1 bytes in a long),
summed over all training texts, with two numbers each: the share of its last byte after the others, and the factor for
escaping from it as a context. Documents are dealt into blocks of some megabytes by a hash. A block numbers its distinct
strings and words once, level by level (a string is its predecessor's number and one more byte); these numbers are the rows that
are summed, that fetch their part of the tree by a join, and that come back to the block, where a score is a few array
lookups a byte. So what is shuffled follows the distinct strings of blocks, not bytes; no word or string has more rows
than there are blocks, whatever its frequency or that of a document's copies.

Defined results: null text counts as empty, and an empty text has its end mark alone. Ids without a value are training rows.
Without training texts every symbol has 1/256, and the word model has N = V = 0. Repeated rows are scored alike and each counts as a
training text. Texts are never cut: a block holds at least one whole text. Results do not depend on the blocks.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import persisted, small_batches

#: Longest context in bytes; a string with its next byte and its length must fit a long, so 6 at most.
ORDER = 4
#: Bytes of text in a block, about, and the least number of blocks.
BLOCK, LEAST_BLOCKS = 1 << 24, 24
#: Bytes that occur in no UTF-8 text: what stands before a text, and its end.
START, END = 0xFE, 0xFF
#: Largest table that numbers strings directly; larger levels are numbered by sorting.
DENSE = 1 << 25
#: Places that are numbered at a time: few enough for a processor's cache.
PIECE = 1 << 16
#: A packed string holds its length above its bytes.
LENGTH_AT = 56

_PARTS = "block int, at int, token string, gram long, n long"
_SCORES = "n_tokens long, n_known long, base_score double, score double"


def learned(doc_id: Column, folds: int = 5, held: int = 1) -> Column:
    """Whether a row is learned from: crc32 of the id's text, modulo ``folds``, is not ``held``."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) != held, F.lit(True))


class Strings:
    """All byte strings of up to ``order`` + 1 bytes in some texts, numbered level by level.

    Level 0 is the empty string; the strings of a level are in the order of (number of all but the last byte, last byte),
    so numbers depend only on which strings there are. ``offset`` numbers all levels through, from 0 for the empty string.
    """

    def __init__(self, texts: list[bytes], order: int):
        self.order = order
        pad, end = bytes([START]) * order, bytes([END])
        # pads on both sides of every text, so that the strings there are don't depend on the order of texts
        data = np.frombuffer(b"".join(pad + t + end for t in texts) + pad, dtype=np.uint8)
        self.ends = np.cumsum([len(t) + order + 1 for t in texts])
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.byte = np.flatnonzero(np.bincount(data, minlength=256)).astype(np.int64)  # of each symbol
        self.width = len(self.byte)
        symbol = np.zeros(256, dtype=np.uint8)
        symbol[self.byte] = np.arange(self.width)
        self.symbols = symbol[data]
        self.keys: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
        self.offset = [0]

    def number(self, learn: int | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Numbers all levels. Returns the number of the longest string that begins at each place, and each level's counts: in all texts, and in the first ``learn``.

        What begins in one text and ends in the next is numbered too, but counts nowhere. Without ``learn`` nothing is counted.
        """
        ids, every, first = np.zeros(len(self.symbols), dtype=np.int32), [np.zeros(1)], [np.zeros(1)]
        cut = int(self.ends[learn - 1]) if learn else 0
        for level in range(1, self.order + 2):
            places = len(ids) - level + 1  # where a string of this level can begin

            def pieces():
                for a in range(0, places, PIECE):
                    b = min(a + PIECE, places)
                    yield a, b, ids[a:b].astype(np.int64) * self.width + self.symbols[a + level - 1 : b + level - 1]

            size = len(self.keys[-1]) * self.width
            if size <= DENSE:
                there = np.zeros(size, dtype=bool)
                for _, _, key in pieces():
                    there[key] = True
                keys = np.flatnonzero(there)
                place = np.zeros(size, dtype=np.int32)
                place[keys] = np.arange(len(keys), dtype=np.int32)
            else:
                keys, place = np.zeros(0, dtype=np.int64), None
                for _, _, key in pieces():
                    keys = np.union1d(keys, key)
            low, high = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
            for a, b, key in pieces():
                ids[a:b] = own = place[key] if place is not None else np.searchsorted(keys, key)
                if learn is None:
                    continue
                within = max(0, min(b, cut - level + 1) - a)  # places whose string ends in a text to learn from
                high += np.bincount(own, minlength=len(keys))
                if within:
                    low += np.bincount(own[:within], minlength=len(keys))
            for back in range(1, level if learn is not None else 1):  # strings over a text's end
                over = self.ends - back
                np.subtract.at(high, ids[over], 1)
                np.subtract.at(low, ids[over[over < cut - level + 1]], 1)
            self.offset.append(self.offset[-1] + len(self.keys[-1]))
            self.keys.append(keys)
            every.append(high)
            first.append(low)
        return ids, every, first

    def packed(self, level: int, shorter: np.ndarray) -> np.ndarray:
        """The strings of a level as numbers: length, then bytes. ``shorter``: those of the level before."""
        key = self.keys[level]
        spelled = shorter[key // self.width] & ((1 << LENGTH_AT) - 1)
        return (level << LENGTH_AT) | (spelled << 8) | self.byte[key % self.width]

    def last(self, level: int) -> np.ndarray:
        return self.byte[self.keys[level] % self.width]

    def costs(self, share: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """log10 of the probability of each longest string's last byte after the others. Both arrays are by ``offset``, NaN where the tree has nothing."""
        top = self.order + 1
        shorter = [np.zeros(0, dtype=np.int64), np.zeros(len(self.keys[1]), dtype=np.int64)]  # each string without its first byte
        for level in range(2, top + 1):
            key = self.keys[level]
            shorter.append(np.searchsorted(self.keys[level - 1], shorter[-1][key // self.width] * self.width + key % self.width))
        out = np.zeros(len(self.keys[top]))
        left = whole = np.arange(len(out))  # those that have escaped so far, and what is looked up of them
        for level in range(top, 0, -1):  # contexts from the longest to the empty one
            p = share[self.offset[level] + whole]
            gone = np.isnan(p)
            out[left[~gone]] += p[~gone]
            left, whole = left[gone], whole[gone]
            out[left] += np.nan_to_num(factor[self.offset[level - 1] + self.keys[level][whole] // self.width])
            whole = shorter[level][whole]
        out[left] -= np.log10(256)
        return out


def _texts(table: pa.Table) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass").lower() for t in table["text"].to_pylist()]  # of bytes, lower() changes A-Z alone


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts in their order, the number of each word of each text, and how many each text has."""
    number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    found, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        own = t.split()
        sizes[i] = len(own)
        found.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
    names = pa.array(list(number), pa.binary())
    order = pc.sort_indices(names)
    place = np.empty(len(names), dtype=np.int32)
    place[order.to_numpy()] = np.arange(len(names), dtype=np.int32)
    return names.take(order), place[np.concatenate([np.zeros(0, dtype=np.int32), *found])], sizes


_PARTS_ARROW = pa.schema([("block", pa.int32()), ("at", pa.int32()), ("token", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _parts(order: int):
    """What a block asks for: its distinct words and byte strings, with their counts in texts to learn from."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("learn", "descending")])
        texts, learn = _texts(table), int(np.count_nonzero(table["learn"].to_numpy()))
        del table
        out = []

        def add(at: np.ndarray, token: pa.Array | None, gram: np.ndarray | None, n: np.ndarray) -> None:
            columns = [pa.array(np.full(len(at), key[0].as_py()), pa.int32()), pa.array(at, pa.int32())]
            columns += [pa.nulls(len(at), pa.string()) if token is None else token, pa.nulls(len(at), pa.int64()) if gram is None else pa.array(gram, pa.int64())]
            out.append(pa.table([*columns, pa.array(n, pa.int64())], schema=_PARTS_ARROW))

        names, number, sizes = _words(texts)
        add(np.arange(len(names)), names.cast(pa.string()), None, np.bincount(number[: sizes[:learn].sum()], minlength=len(names)))
        del names, number

        strings = Strings(texts, order)
        _, every, first = strings.number(learn)
        packed = np.zeros(1, dtype=np.int64)
        add(np.zeros(1, dtype=np.int64), None, packed, np.zeros(1, dtype=np.int64))
        for level in range(1, order + 2):
            packed = strings.packed(level, packed)
            used = np.flatnonzero(every[level])
            real = strings.last(level)[used] != START  # what stands before a text is context only
            add(strings.offset[level] + used, None, packed[used], np.where(real, first[level][used], 0))
        return pa.concat_tables(out)

    return count


def _scored(order: int, tokens: int, kinds: int, ends: int):
    """Scores of a block's documents from its words' counts and its part of the tree."""

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        texts, at = _texts(docs), found["at"].to_numpy()
        is_word = found["c"].is_valid().to_numpy()
        names, number, sizes = _words(texts)
        count = np.zeros(len(names), dtype=np.int64)
        count[at[is_word]] = found["c"].filter(found["c"].is_valid()).to_numpy()
        bottom = np.log10(tokens + 0.5 * (kinds + 1))
        weight, end = np.log10(count + 0.5) - bottom, np.log10(ends + 0.5) - bottom
        known, base = np.full(len(texts), int(ends > 0)), np.full(len(texts), end)
        begin = np.cumsum(sizes) - sizes
        for i in np.flatnonzero(sizes).tolist():
            own = number[begin[i] : begin[i] + sizes[i]]
            known[i] += np.count_nonzero(count[own])
            base[i] += weight[own].sum()
        del names, number

        strings = Strings(texts, order)
        ids, _, _ = strings.number()
        share, factor = (np.full(strings.offset[-1] + len(strings.keys[-1]), np.nan) for _ in range(2))
        for name, into in (("share", share), ("factor", factor)):
            into[at[~is_word]] = found[name].to_numpy()[~is_word]
        cost = strings.costs(share, factor)
        score = [float(cost[ids[b : e - order]].sum()) for b, e in zip(strings.begins, strings.ends)]
        return pa.table([docs["doc_id"], pa.array(sizes + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return score


def _shorter(gram: str, first: bool) -> Column:
    """A packed string without its last byte, or without its first."""
    n = F.shiftright(gram, LENGTH_AT) - 1
    if first:
        rest = F.col(gram).bitwiseAND(F.expr(f"shiftleft(1L, cast(8 * (shiftright({gram}, {LENGTH_AT}) - 1) as int)) - 1"))
    else:
        rest = F.shiftright(F.col(gram).bitwiseAND(F.lit((1 << LENGTH_AT) - 1)), 8)
    return F.shiftleft(n, LENGTH_AT).bitwiseOR(rest)


def tree(counts: DataFrame) -> DataFrame:
    """(gram, share, factor) of all strings and contexts, as log10, from ``counts`` (gram, c) of packed strings.

    ``share``: of the last byte after the others. ``factor``: what escaping from the string as a context multiplies by,
    that is the escape's share over what the shorter context leaves when the bytes seen here are excluded from it.
    """
    own = counts.select("gram", "c", _shorter("gram", first=False).alias("context"), F.when(F.shiftright("gram", LENGTH_AT) > 1, _shorter("gram", first=True)).alias("suffix"))
    shorter = counts.select(F.col("gram").alias("suffix"), F.col("c").alias("below"))
    contexts = own.join(shorter, "suffix", "left").groupBy("context").agg(F.sum("c").alias("n"), F.count("*").alias("q"), F.sum("below").alias("m"))
    contexts = persisted(contexts, "lm-contexts")
    lower = contexts.select(F.col("context").alias("suffix"), (F.col("n") + F.col("q")).alias("all"))
    based = contexts.withColumn("suffix", F.when(F.col("context") > 0, _shorter("context", first=True))).join(lower, "suffix", "left")
    n, q, m, every = F.col("n"), F.col("q"), F.col("m"), F.col("all")
    free = F.when(F.col("context") > 0, (every - m) / every).otherwise(F.greatest(F.lit(256) - q, F.lit(1)) / 256)
    factors = based.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("share"), F.log10(q / (n + q) / free).alias("factor"))
    shares = own.join(contexts.select("context", (n + q).alias("whole")), "context").select("gram", F.log10(F.col("c") / F.col("whole")).alias("share"), F.lit(None).cast("double").alias("factor"))
    return shares.unionByName(factors).groupBy("gram").agg(F.max("share").alias("share"), F.max("factor").alias("factor"))


def score(docs: DataFrame, learn: Column, order: int = ORDER, block: int = BLOCK, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text), where rows with ``learn`` are learned from.

    ``base_score`` is the word model's: log10((c + 0.5) / (N + 0.5 (V + 1))) over the words and one end, with the counts
    of all training texts.
    """
    if not 1 <= order <= 6:
        raise ValueError("contexts have one to six bytes")
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    size, ends = rows.agg(F.sum(F.octet_length("text")), F.count_if("learn")).first()
    blocks = max(least_blocks, -(-(size or 0) // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    parts = persisted(dealt.groupBy("block").applyInArrow(_parts(order), _PARTS), "lm-parts")
    words, strings = parts.where("token is not null"), parts.where("gram is not null")
    word_counts = persisted(words.groupBy("token").agg(F.sum("n").alias("c")).where("c > 0"), "lm-words")
    tokens, kinds = word_counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    grown = persisted(tree(persisted(strings.groupBy("gram").agg(F.sum("n").alias("c")).where("c > 0"), "lm-strings")), "lm-tree")

    none = F.lit(None).cast("double")
    of_words = words.join(word_counts, "token").select("block", "at", "c", none.alias("share"), none.alias("factor"))
    of_strings = strings.join(grown, "gram").select("block", "at", F.lit(None).cast("long").alias("c"), "share", "factor")
    found = of_words.unionByName(of_strings)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_scored(order, tokens + ends, kinds + (ends > 0), ends), f"doc_id {kind}, {_SCORES}")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(tokens + ends).cast("long").alias("train_tokens"), "base_score", "score")
