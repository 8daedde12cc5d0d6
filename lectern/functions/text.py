"""Text normalisation, lexemes, terms, sentences, labels and spans."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words without meaning, in two languages.
STOPWORDS = (
    "a", "an", "and", "are", "be", "by", "for", "in", "is", "of", "on", "or", "the", "to",
    "与", "和", "在", "是", "的", "了", "或", "及",
)
# Lexemes of a document and of a query, at most.
MAX_DOCUMENT_LEXEMES, MAX_QUERY_LEXEMES = 4096, 64
# Legal endings of entity names.
ENTITY_SUFFIXES = ("基金会", "有限公司", "公司", "组织", "项目", "平台", "服务")

CJK = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"


@F.pandas_udf(T.StringType())
def nfc_casefold(texts: pd.Series) -> pd.Series:
    """NFC, then full case folding, which lower() is not."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


@F.pandas_udf(T.StringType())
def surface(texts: pd.Series) -> pd.Series:
    """NFKC, case-folded, letters and digits only."""
    return texts.map(lambda t: None if t is None else _surface(t))


def _surface(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum())


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """Plain line ends, NFC, white space stripped at both ends (S3)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")).strip())


# What joins words to one, and ideographs.
_JOIN = re.compile(r"[-./:]+")
_IDEOGRAPHS = re.compile("[㐀-鿿豈-﫿]+")
_WORD = re.compile(rf"\w+(?:{_JOIN.pattern}\w+)*|{_IDEOGRAPHS.pattern}")
_STOP = frozenset(STOPWORDS)


def _emitted(word: str) -> Iterator[str]:
    """The lexemes of one word, in order: a joined one whole and in parts, or itself if it isn't ideographs throughout, and
    the bigrams of its ideographs where they stand."""
    runs = [(m.start(), m[0]) for m in _IDEOGRAPHS.finditer(word)]
    own = [p for p in _JOIN.split(word) if p]
    if len(own) > 1:
        yield "_".join(own)
        yield from own
    elif not runs or runs[0] != (0, word):
        if runs and runs[0][0] == 0:  # ideographs at the same place come first
            yield from _bigrams(runs.pop(0)[1])
        yield word
    for _, run in runs:
        yield from _bigrams(run)


def _bigrams(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(len(run) - 1)] or [run]


def lexemes_of(text: str, limit: int) -> list[str]:
    """Distinct lexemes of a text in order of first occurrence, at most ``limit``."""
    folded = unicodedata.normalize("NFC", text).casefold()
    words = dict.fromkeys(_WORD.findall(folded))  # what a word emits again is no news
    if not _IDEOGRAPHS.search(folded) and all(map(str.isalnum, words)):  # each word is its own and only lexeme
        return list(islice((w for w in words if w not in _STOP), limit))
    distinct = dict.fromkeys(x for w in words for x in _emitted(w) if x not in _STOP)
    return list(islice(distinct, limit))


def _analysed(limit: int):
    def analysed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else lexemes_of(t, limit) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(analysed, T.ArrayType(T.StringType())).asNondeterministic()  # else a filter on the result, moved below it, runs it twice


_DOCUMENT, _QUERY = _analysed(MAX_DOCUMENT_LEXEMES), _analysed(MAX_QUERY_LEXEMES)


def _ascii_lexemes(text: Column, limit: int) -> Column:
    """The same lexemes for ASCII texts, where folding is lower case and nothing is an ideograph: no Python."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\w+(?:[-./:]+\w+)*"), F.lit(0))
    parts = F.transform(words, lambda w: F.when(w.rlike("[-./:]"), F.concat(F.array(F.regexp_replace(w, "[-./:]+", "_")), F.split(w, "[-./:]+"))).otherwise(F.array(w)))
    told = F.filter(F.flatten(parts), lambda x: ~x.isin(*STOPWORDS))
    return F.slice(F.array_distinct(told), 1, limit)


def _lexemes(text: Column, limit: int, analysed) -> Column:
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, _ascii_lexemes(text, limit)).otherwise(analysed(F.when(~plain, text)))


def lexemes(text: Column) -> Column:
    """Lexemes of documents."""
    return _lexemes(text, MAX_DOCUMENT_LEXEMES, _DOCUMENT)


def query_lexemes(text: Column) -> Column:
    return _lexemes(text, MAX_QUERY_LEXEMES, _QUERY)


def or_query(values: Column) -> Column:
    """The lexemes of an OR query, quoted and joined; null if there are none or one is unsafe."""
    safe = F.forall(values, lambda v: v.rlike(r"^[\p{L}\p{N}_]+$")) & (F.size(values) <= MAX_QUERY_LEXEMES)
    return F.when((F.size(values) > 0) & safe, F.array_join(F.transform(F.array_distinct(values), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), " | "))


def terms(text: Column) -> Column:
    """Scoring terms: ASCII words and single ideographs, in lower case, without words that mean nothing."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z_]+|[\x{3400}-\x{9fff}]"), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.lower(t)), lambda t: ~t.isin(*STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two term lists' sets; 0 if one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def sentences(text: Column) -> Column:
    """Pieces that end after sentence marks or line ends; together they are the text."""
    return F.filter(F.split(text, r"(?<=[。！？；.!?;\n])(?![。！？；.!?;\n])"), lambda s: s != "")


def records(text: Column) -> Column:
    """Parts between blank lines."""
    return F.filter(F.split(text, r"\n[ \t]*\n+"), lambda s: F.btrim(s) != "")


def heading_like(line: Column, tokens: Column) -> Column:
    """Short, and without a sentence's end."""
    return (F.length(line) <= 160) & (tokens <= 24) & (F.btrim(line) != "") & ~F.btrim(line).rlike(r"[.。!！?？;；:：,，]$")


def figure_labels(text: Column) -> Column:
    """Sorted identities of the figures that a text names."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:fig(?:ure)?[.\s]*|图\s*)([0-9]+(?:[A-Za-z]|[.\-][0-9A-Za-z]+)?)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("figure:"), F.lower(x)))))


def question(text: Column) -> Column:
    """White space collapsed; list numbers, quotes around and stops at the end removed."""
    flat = F.btrim(F.regexp_replace(text, r"\s+", " "))
    bare = F.regexp_replace(flat, r"^(?:[0-9]+[.)、]|[-*•])\s+", "")
    bare = F.btrim(bare, F.lit(" \"'“”‘’"))
    return F.btrim(F.rtrim(bare, F.lit("。.;；")))


def span_of(quote: Column, text: Column) -> Column:
    """(start, end) of an exact quote, from 0; null if the text doesn't hold it."""
    at = F.instr(text, quote)
    return F.when((F.length(quote) > 0) & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end")))


def compact_row(row: Column) -> Column:
    """A Markdown table row with cells stripped and alignment marks kept short."""
    cells = F.transform(F.split(F.btrim(F.btrim(row), F.lit("|")), r"\|"), lambda c: F.regexp_replace(F.regexp_replace(F.btrim(c), r"\s+", " "), "-{3,}", "---"))
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def folded_spaces(text: Column) -> Column:
    """For comparing: white space collapsed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def word_overlap(wanted: Column, found: Column) -> Column:
    """The share of wanted words that are found; a match from 0.6 on."""
    split = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.when(F.size(split(wanted)) > 0, F.size(F.array_intersect(split(wanted), split(found))) / F.size(split(wanted))).otherwise(0.0)


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


#: Ways to write an entity: a pattern, and what is made of all that it finds in the name.
_WRITINGS = (
    (re.compile(r"(?s)^(.+)$"), list),
    (re.compile(r"([A-Za-z0-9])[A-Za-z0-9]*"), lambda initials: ["".join(initials)] if len(initials) > 1 else []),
    (re.compile(r"[（(]([^）)]+)[）)]"), list),
    *((re.compile(rf"(?s)^(.+){ending}$"), list) for ending in ENTITY_SUFFIXES),
)


@F.pandas_udf(T.ArrayType(T.StringType()))
def surface_variants(names: pd.Series) -> pd.Series:
    """Surfaces of two characters or more of a name, its acronym, aliases in brackets, and itself without a legal ending."""

    def of(name: str) -> list[str]:
        surfaces = (_surface(w) for pattern, made in _WRITINGS for w in made(pattern.findall(name)))
        return list(dict.fromkeys(x for x in surfaces if len(x) > 1))

    return names.map(of, na_action="ignore")


def bounded_section(label: str, text: Column, most_tokens: int) -> Column:
    """A labelled section cut after so many tokens, null if the text is blank."""
    from lectern.sources.tables import TOKEN

    head = F.regexp_extract(text, rf"(?s)^(?:\s*(?:{TOKEN})){{0,{most_tokens}}}", 0)
    return F.when(F.btrim(F.coalesce(text, F.lit(""))) != "", F.concat(F.lit(label + ": "), F.btrim(head)))


def composite(sections: list[tuple[str, Column, int]]) -> Column:
    """The text to embed: the sections that aren't blank, a line each (S14). ``sections``: (label, text, most tokens)."""
    return F.concat_ws("\n", *[bounded_section(*s) for s in sections])
