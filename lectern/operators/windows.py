"""Windows of long texts for models with bounded input: by tokens, of tables under their header, and by UTF-8 bytes.

Windows are offsets into the text, in characters. The text is never changed, so windows joined without what they share
give it back, and what a model reads is a substring of the chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of a sequence, of a query, of context and of headings, what windows share, and bytes of an input.
SEQUENCE, QUERY_MOST, CONTEXT_MOST, HEADINGS_MOST, OVERLAP, MAX_BYTES = 512, 96, 32, 32, 64, 2048
#: Tokens that a pair of texts costs besides, and that stand behind context and headings.
SPECIAL, BEHIND_PREFIX = 4, 2

_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"[。！？；.!?;\n]+")
# The line under a table's header, and further header lines, of years and units only.
_RULE = re.compile(r"\s*\|?(?:\s*:?-{3,}:?\s*\|)*\s*:?-{3,}:?\s*\|?\s*")
_YEAR = re.compile(r"(?:19|20)\d{2}(?:年|\s*\(\d+\))?")
_UNIT = re.compile(r"(?:years? ended|months? ended|in (?:millions|thousands)|单位[：:]|年[度末]|截至)", re.IGNORECASE)

_WINDOW = "array<struct<start: int, end: int, tokens: int, header: int>>"


def body_room(query_tokens: Column, context_tokens: Column, heading_tokens: Column) -> Column:
    """Tokens left for a window beside its query, document context and headings."""
    prefix = F.lit(0)
    for n, most in ((context_tokens, CONTEXT_MOST), (heading_tokens, HEADINGS_MOST)):
        prefix += F.when(n > 0, F.least(n, F.lit(most)) + BEHIND_PREFIX).otherwise(0)
    return F.lit(SEQUENCE - SPECIAL) - F.least(query_tokens, F.lit(QUERY_MOST)) - prefix


def spans(n: int, marks: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows (first token, after the last) of ``n`` tokens: at most ``size``, ending at the last mark in their second half, and
    sharing ``overlap`` with the one before. What fits is taken whole, and the last window is filled up from before."""
    out, at = [], 0
    while n - at > size:
        reach = at + size
        k = int(np.searchsorted(marks, reach, side="right")) - 1
        end = int(marks[k]) if k >= 0 and marks[k] >= at + max(1, size // 2) else reach
        out.append((at, end))
        back = end - overlap
        at = max(at + 1, n - size if n - back <= size else back)
    return [*out, (at, n)] if n else []


def _header(text: str) -> int:
    """Characters of a table's header with its line break: 0 without one, or where a second table begins."""
    lines = text.split("\n")
    rules = [i for i in range(1, len(lines)) if "|" in lines[i - 1] and _RULE.fullmatch(lines[i])]
    if not rules or any(_RULE.fullmatch(line) for line in lines[rules[0] + 1 :]):
        return 0
    last = rules[0] + 1
    while last < len(lines) and _goes_on(lines[last]):
        last += 1
    return min(len(text), sum(len(line) + 1 for line in lines[:last]))


def _goes_on(line: str) -> bool:
    cells = [c.strip() for c in line.strip("|").split("|")]
    return line.startswith("|") and not cells[0] and all(not c or _YEAR.fullmatch(c) or _UNIT.search(c) for c in cells[1:])


def windows_of(text: str, size: int, table: bool, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, header) of a text's windows; those of a table also have the first ``header`` characters before them."""
    starts = np.array([m.start() for m in _TOKEN.finditer(text)], dtype=np.int64)
    ends = np.append(starts, len(text))  # where the next token begins
    header = _header(text) if table else 0
    above = int(np.searchsorted(starts, header))
    if above == len(starts) or above > size // 2 or size - above < 1:
        header = above = 0
    if header:
        breaks = [m.end() for m in re.finditer("\n", text)]
    else:
        breaks = [m.end() for m in _SENTENCE.finditer(text)]
    marks = np.unique(np.searchsorted(starts, breaks)) - above
    room = size - above
    found = spans(len(starts) - above, marks[marks > 0], room, min(overlap, room - 1))
    return [(int(ends[above + a]) if a or header else 0, int(ends[above + b]), b - a, header) for a, b in found]


def _windows(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, sizes, tables in batches:
        rows = [None if t is None or not s or s < 1 else windows_of(t, s, bool(b)) for t, s, b in zip(texts.to_pylist(), sizes.to_pylist(), tables.to_pylist())]
        told = [None if r is None else [dict(zip(("start", "end", "tokens", "header"), w)) for w in r] for r in rows]
        yield pa.array(told, pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "tokens", "header")])))


def rerank_windows(text: Column, room: Column, table: Column) -> Column:
    """Windows of a text of ``room`` tokens each (C15); null for null texts and where there is no room."""
    return F.arrow_udf(_windows, _WINDOW)(text, room.cast("int"), table)


def window_text(text: Column, window: Column) -> Column:
    """What a model reads of a window: a table's header and the window."""
    body = F.substring(text, window["start"] + 1, window["end"] - window["start"])
    return F.concat(F.substring(text, F.lit(1), window["header"]), body)


def byte_cuts(text: str, most: int = MAX_BYTES) -> list[tuple[int, int]]:
    """(start, end) in characters of pieces of at most ``most`` bytes in UTF-8; a longer character goes alone."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return [(0, 0)]
    first = np.flatnonzero((data & 0xC0) != 0x80)  # of each character, in bytes
    after = np.append(first[1:], len(data))
    out, at = [], 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(after, first[at] + most, side="right")))
        out.append((at, end))
        at = end
    return out


def _byte_windows(most: int):
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            told = [None if t is None else [{"start": a, "end": b} for a, b in byte_cuts(t, most)] for t in texts.to_pylist()]
            yield pa.array(told, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(cut, "array<struct<start: int, end: int>>")


def byte_windows(text: Column, most: int = MAX_BYTES) -> Column:
    """Pieces of a text of at most ``most`` bytes (C16): cut between characters, and together the text. An empty text is one piece."""
    return _byte_windows(most)(text)
