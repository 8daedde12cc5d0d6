"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie with two roots, one for the start of a word and one for its continuation. Where a
longest match breaks off, a failure link leads to the node of what is left after the pieces that greedy matching would
have cut off, and the number of those pieces is stored with the link. A word is then counted in one pass over its
characters: follow children, and on a break add the stored count and follow the link; no piece is ever built.

Words are the runs of letters, marks and digits of a text, and every other character that isn't white space alone; a
word that can't be matched to its end is one unknown token. Counts of words are remembered by each worker (a bounded
number), so frequent words are looked up.

Defined results: null, empty and blank texts have no words and tokens; rows are independent.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.shared import small_batches

_BASIC = regex.compile(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")
#: Words remembered by a worker.
_CACHE = 1 << 19
_SHIFT = 40


class LongestMatch:
    """The automaton of a vocabulary: pieces that may start a word, and pieces that may go on within one."""

    START, WITHIN = 0, 1

    def __init__(self, starts: Iterable[str], withins: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((self.START, starts), (self.WITHIN, withins)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    at = self.next[at][c]
                if at > 1:
                    whole[at] = True
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        todo = deque((self.START, self.WITHIN))
        while todo:  # parents before children, so a parent's link is known
            u = todo.popleft()
            for c, v in self.next[u].items():
                todo.append(v)
                if whole[v]:  # cut off as it is; go on within the word
                    self.fail[v], self.popped[v] = self.WITHIN, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], n

    def count(self, word: str) -> int:
        """Pieces of a word, or 0 if it can't be matched to its end."""
        following, fail, popped = self.next, self.fail, self.popped
        u = n = 0
        for c in word:
            v = following[u].get(c)
            while v is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 0
                v = following[u].get(c)
            u = v
        while u != self.WITHIN:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 0
        return n


def pieces_of(model_file: str) -> tuple[list[str], list[str]]:
    """The pieces of a SentencePiece file as word starts (those with the space mark) and continuations."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    every = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [p[1:] for p in every if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]], [p for p in every if "▁" not in p]


class _Counts(dict):
    """Of a chunk without white space: tokens, unknown words and words, packed in one number."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, chunk: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        tokens = unknown = 0
        words = _BASIC.findall(chunk.decode())
        for word in words:
            n = self.automaton.count(word)
            tokens += n or 1
            unknown += not n
        value = tokens | unknown << _SHIFT | len(words) << 2 * _SHIFT
        if len(chunk) < 100:
            self[chunk] = value
        return value


_ready: dict[str, _Counts] = {}


def count_text(text: str | None, model_file: str) -> tuple[int, int, int]:
    """(words, tokens, unknown words) of a text."""
    if model_file not in _ready:
        _ready[model_file] = _Counts(LongestMatch(*pieces_of(model_file)))
    total = sum(map(_ready[model_file].__getitem__, text.encode().split())) if text else 0
    mask = (1 << _SHIFT) - 1
    return total >> 2 * _SHIFT, total & mask, total >> _SHIFT & mask


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """A row a row of ``docs`` (doc_id, text): doc_id, n_words, n_tokens, n_unknown. ``model_file``: the vocabulary's path."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count_text(t.as_py(), model_file) for t in batch["text"]]
            columns = list(zip(*found)) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")
