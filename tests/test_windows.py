"""Windows against a plain loop, and that they give the text back."""

import random

import numpy as np
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import windows
from lectern.plans import registry

registry.load()


def plain(n, marks, size, overlap):
    out, start = [], 0
    while n:
        target = min(n, start + size)
        end = max([m for m in marks if start + max(1, size // 2) <= m <= target], default=target) if target < n else target
        out.append((start, end))
        if end >= n:
            return out
        start = max(start + 1, n - size if n - (end - overlap) <= size else end - overlap)
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 80), st.sets(st.integers(1, 80)), st.integers(1, 20), st.data())
def test_spans_against_a_plain_loop(n, marks, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    assert windows.spans(n, np.array(sorted(marks)), size, overlap) == plain(n, marks, size, overlap)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n|-é漢\U0001f600", max_size=120), st.integers(1, 12), st.booleans())
def test_windows_cover_the_text(text, size, table):
    found = windows.windows_of(text, size, table, 3)
    covered = found[0][3] if found else 0
    for start, end, tokens, header in found:
        assert start <= covered and end > start and header == found[0][3]
        assert tokens + len(windows._TOKEN.findall(text[:header])) <= size
        covered = max(covered, end)
    assert not found or covered == len(text)
    pieces = [text[a:b] for a, b in windows.byte_cuts(text, size)]
    assert "".join(pieces) == text and all(len(p.encode()) <= size or len(p) == 1 for p in pieces)
    assert all(len((p + q[:1]).encode()) > size for p, q in zip(pieces, pieces[1:]))  # no cut comes early


def test_tables_repeat_their_header():
    head = "| a | b |\n| --- | --- |\n"
    rows = [f"| r{i} | {i} |" for i in range(12)]
    found = windows.windows_of(head + "\n".join(rows), 30, True, 0)
    assert len(found) > 2 and all(w[3] == len(head) for w in found)
    text = head + "\n".join(rows)
    assert all(text[b - 1] == "\n" for _, b, _, _ in found[:-1])  # cut between rows; the last is filled up from before
    years = "| a | b |\n| --- | --- |\n| | 2023 |\n| x | 1 |\n"
    assert windows._header(years) == years.index("| x")
    assert windows._header(head + rows[0] + "\n" + head) == 0  # a second table has names of its own
    assert windows._header("no | table\n") == 0


def test_queries_over_whole_documents(spark):
    found = registry.QUERIES["rerank_windows"](spark, SF)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, t in docs.items() if t and windows._TOKEN.search(t)}
    for i in random.Random(1).sample(sorted(by), 60):
        text, rows = docs[i], sorted(by[i], key=lambda r: r.window)
        asked = text.split("\n")[0]
        size = 512 - 4 - 3 - min(96, len(windows._TOKEN.findall(asked)))
        want = windows.windows_of(text, size, "|" in text)
        assert [(r.start, r.end, r.tokens, r.header) for r in rows] == want
    assert spark.range(1).select(windows.body_room(F.lit(200), F.lit(0), F.lit(50))).first()[0] == 512 - 4 - 96 - 34
