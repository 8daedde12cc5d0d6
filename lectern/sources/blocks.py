"""HTML, Markdown and plain text as typed blocks in reading order (SRC9, C19, S32)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_SKIP = {"script", "style", "nav", "footer", "head", "noscript", "template"}
_BLOCK = {"p", "div", "article", "section", "main", "ul", "ol", "table", "tr", "br", "blockquote", "header", "aside", "body", "html", "pre"}
_CONTENT, _VOID = {"body", "main", "article"}, {"br", "img", "hr", "input", "link", "meta", "source", "wbr", "col", "area", "base", "embed", "track"}
_HEADING = re.compile(r"h([1-6])$")


class _Blocks(HTMLParser):
    """Folds inline tags into the block around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, str, str | None]] = []
        self.kind, self.depth, self.held = "text", 0, []
        self.open: list[str] = []  # elements that are open; one that encloses another's end ends with it
        self.row: list[str] = []
        self.image: str | None = None

    @property
    def skip(self) -> bool:
        return any(tag in _SKIP for tag in self.open)

    def close_block(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.rows.append((self.kind, self.depth, text, None))
        self.held, self.kind, self.depth = [], "text", 0

    def handle_starttag(self, tag, attrs):
        if tag in _CONTENT:  # what holds a page's content ends an unclosed part that is skipped
            self.open = [t for t in self.open if t not in _SKIP]
        if tag in _SKIP:
            self.close_block()
        if tag not in _VOID:
            self.open.append(tag)
        if self.skip:
            return
        if m := _HEADING.match(tag):
            self.close_block()
            self.kind, self.depth = "heading", int(m[1])
        elif tag == "li":
            self.close_block()
            self.kind = "list_item"
        elif tag in ("td", "th"):
            self.row.append("".join(self.held).strip()) if self.kind == "cell" else self.close_block()
            self.kind, self.held = "cell", []
        elif tag == "img":
            source = dict(attrs).get("src")
            self.rows.append(("image", 0, dict(attrs).get("alt") or "", source))
        elif tag in _BLOCK:
            self.close_block()
            self.row = [] if tag == "tr" else self.row

    def handle_endtag(self, tag):
        skipped = self.skip
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        if skipped:
            self.held = []
        elif tag in ("td", "th"):
            self.row.append(" ".join("".join(self.held).split()))
            self.held, self.kind = [], "text"
        elif tag == "tr":
            if self.row:
                self.rows.append(("table_row", 0, " | ".join(self.row), None))
            self.row, self.held, self.kind = [], [], "text"
        elif tag in _BLOCK or tag == "li" or _HEADING.match(tag):
            self.close_block()

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def html_rows(html: str | None) -> list[tuple[str, int, str, str | None]]:
    """(kind, heading depth, text, image source) of a page's blocks."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.rows


_MD_IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)|<img\b[^>]*?\bsrc=[\"']([^\"']+)[\"'][^>]*>", re.I)


def markdown_rows(text: str | None) -> list[tuple[str, int, str, str | None]]:
    """The same for Markdown: headings, tables, lists, paragraphs and image references, fences kept whole."""
    rows: list[tuple[str, int, str, str | None]] = []
    held: list[str] = []
    fence = False

    def flush() -> None:
        if body := " ".join(" ".join(held).split()):
            rows.append(("text", 0, body, None))
        held.clear()

    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.lstrip().startswith("```"):
            fence = not fence
            flush()
        elif fence:
            held.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            flush()
            rows.append(("heading", len(m[1]), m[2], None))
        elif line.lstrip().startswith("|"):
            flush()
            if not re.fullmatch(r"[\s|:\-]+", line):
                rows.append(("table_row", 0, " | ".join(c.strip() for c in line.strip().strip("|").split("|")), None))
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            flush()
            rows.append(("list_item", 0, m[1].strip(), None))
        elif not line.strip():
            flush()
        else:
            for m in _MD_IMAGE.finditer(line):
                rows.append(("image", 0, m[1] or "", m[2] or m[3]))
            held.append(_MD_IMAGE.sub("", line))
    flush()
    return rows


def blocks(pages: DataFrame, key: str = "page_id", body: str = "html", kind: str = "html") -> DataFrame:
    """(key, ordinal, kind, depth, text, image) of each page's blocks in reading order."""
    reader = {"html": html_rows, "markdown": markdown_rows}[kind]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, i, *row) for k, text in zip(frame[key], frame[body]) for i, row in enumerate(reader(text))]
            yield pd.DataFrame(out, columns=[key, "ordinal", "kind", "depth", "text", "image"])

    return pages.select(key, body).mapInPandas(read, f"{key} long, ordinal long, kind string, depth long, text string, image string")
