"""Fill-in-the-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of one character class (blank or word), each with its start and the number of units
that end before it. A cut after ``c`` units is found by binary search for the run that holds the ``c``-th unit; where in
the run it lies follows from arithmetic on the run's start and count alone. No token list is ever built, whatever a unit is:

* ``token``: a word with the blanks before it, or the blanks after the last word. A word run ends one unit, a blank run
  none, but the last run always ends one.
* ``character``: every code point, so a run ends as many units as it is long.

The cuts come from the id: four 32-bit numbers ``h1`` to ``h4`` are the first groups of sha256(``seed:id``). The prefix ends
after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, the middle after the larger. ``h3`` decides whether a text is
transformed, ``h4`` between the two orders:

    psm: <P>prefix<S>suffix<M>middle      spm: <S>suffix<P>prefix<M>middle      plain: the text

A marker can't begin inside a part and end inside the next marker (no marker's end is another's beginning), and texts
that hold one stay plain, so the first occurrence of each marker in an output is the one that was put there:
``restored`` gives the exact text back.

Defined results: null text counts as empty; empty texts and texts with a marker stay plain, with null parts; a null id is
hashed as the seed and the colon alone. Repeated rows get equal results. Texts of any length are encoded whole, some at a
time, so memory follows the longest text; added columns replace those of the same names, and other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import fresh, let, small_batches

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What the operator adds.
ADDED = ("fim_form", "fim_text", "fim_units", "fim_prefix_chars", "fim_middle_chars")
#: Code points that are encoded at a time; a longer text goes alone.
PIECE = 1 << 20

_CUTS = "n long, first long, second long"


class Runs:
    """The class runs of several texts laid end to end; a text begins a run of its own."""

    def __init__(self, texts: list[str], unit: str = "token"):
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(size) - size  # of each text
        blank = (code == 32) | ((code >= 9) & (code <= 13))
        edge = np.ones(len(code), dtype=bool)
        edge[1:] = blank[1:] != blank[:-1]
        edge[self.begin[size > 0]] = True
        self.start = np.flatnonzero(edge)  # of each run, in code points
        self.length = np.diff(np.append(self.start, len(code)))
        self.first = np.searchsorted(self.start, self.begin)  # run of each text; of an empty one, the next text's
        self.after = np.searchsorted(self.start, self.begin + size)
        self.one = unit == "token"
        if self.one:
            ends = (~blank[self.start]).astype(np.int64)
            ends[self.after[size > 0] - 1] = 1
        else:
            ends = self.length
        self.before = np.concatenate([[0], np.cumsum(ends)])  # units that end before each run

    def units(self) -> np.ndarray:
        return self.before[self.after] - self.before[self.first]

    def offset(self, cut: np.ndarray) -> np.ndarray:
        """Code points of each text before the end of its ``cut``-th unit, 0 for a cut of 0."""
        if not len(self.start):
            return np.zeros_like(cut)
        wanted = self.before[self.first] + cut
        run = np.searchsorted(self.before, wanted, side="left") - 1  # the run in which that unit ends
        run = np.where(cut > 0, run, 0)
        inside = self.length[run] if self.one else wanted - self.before[run]
        return np.where(cut > 0, self.start[run] + inside - self.begin, 0)


def _cut(texts: list[str], h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units, and the code points before the first and the second cut, of each text."""
    runs = Runs(texts, unit)
    n = runs.units()
    a, b = h1 % (n + 1), h2 % (n + 1)
    return n, runs.offset(np.minimum(a, b)), runs.offset(np.maximum(a, b))


def _cutter(unit: str):
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, h1, h2 in batches:
            texts, one, two = text.to_pylist(), h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
            found, at = [], 0
            while at < len(texts):
                size, to = len(texts[at]), at + 1
                while to < len(texts) and size + len(texts[to]) <= PIECE:
                    size += len(texts[to])
                    to += 1
                found.append(_cut(texts[at:to], one[at:to], two[at:to], unit))
                at = to
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 3
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "second"])

    return F.arrow_udf(cut, _CUTS)


def number(digest: Column, group: int) -> Column:
    """The ``group``-th (from 1) eight hexadecimal digits of ``digest``, as an unsigned number."""
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, unit: str = "token", text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``docs`` with the columns of ``ADDED``: ``rate`` % of the texts are transformed, ``spm_rate`` % of these with the suffix first."""
    if unit not in ("token", "character"):
        raise ValueError("a unit is a token or a character")
    small_batches(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    name, whole, digest = fresh(docs, "fim"), fresh(docs, "fim_whole"), fresh(docs, "fim_digest")
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    hashed = docs.withColumn(whole, F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(digest, seeded)
    cut = hashed.withColumn(name, _cutter(unit)(F.col(whole), number(F.col(digest), 1), number(F.col(digest), 2)))

    t, h = F.col(whole), F.col(digest)
    plain = (t == "") | (number(h, 3) % 100 >= rate)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain |= t.contains(marker)
    form = F.when(plain, "plain").when(number(h, 4) % 100 < spm_rate, "spm").otherwise("psm")
    first, second = F.col(f"{name}.first"), F.col(f"{name}.second")
    prefix = F.substring(t, F.lit(1), first.cast("int"))
    middle = F.substring(t, (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring(t, (second + 1).cast("int"), F.length(t))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return cut.select(
        *kept,
        form.alias("fim_form"),
        F.when(form == "plain", t).when(form == "spm", spm).otherwise(psm).alias("fim_text"),
        F.col(f"{name}.n").alias("fim_units"),
        F.when(form != "plain", first).alias("fim_prefix_chars"),
        F.when(form != "plain", second - first).alias("fim_middle_chars"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of, from it and its form alone."""

    def between(a: str, b: str | None) -> Column:
        def body(at: Column) -> Column:  # (start, end), where end is the place of the next marker
            return F.substring(output, at[0], at[1] - at[0])

        start = F.locate(a, output) + len(a)
        end = F.locate(b, output) if b else F.length(output) + 1
        return let(F.array(start, end), body)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
