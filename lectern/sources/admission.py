"""Admitting files: media types, strict decoding, CSV bounds, archives and workbooks (SRC3 to SRC8)."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions, media types and bounds.
MEDIA_TYPES = {
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".mdz": "application/vnd.markdown-bundle+zip",
    ".html": "text/html",
    ".csv": "text/csv",
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
DELIMITERS = ",;\t|:"
#: Of several delimiters in a first line, the first of these.
_PREFERRED = (",", "\t", ";", ":", "|")
#: What stands for the delimiter while counting, and the longest field.
_MARK, MAX_FIELD = "\x1f", 131_072
MAX_LINES, MAX_COLUMNS, MAX_CELLS = 200_000, 1_024, 200_000


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def media_type(path: Column) -> Column:
    """The media type of an admitted extension, else null (SRC3)."""
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.try_element_at(kinds, extension(path))


def decoded(content: Column) -> Column:
    """Strict UTF-8 without its mark and with plain line ends; null if the bytes are no UTF-8 (SRC4)."""
    text = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")
    return F.regexp_replace(text, "\r\n?", "\n")


def admitted(found: DataFrame) -> DataFrame:
    """``found`` (path, length, content) with media_type, text (of text files) and reject: null or the first rule that fails."""
    texts = F.col("media_type").startswith("text/")
    rows = found.withColumn("media_type", media_type(F.col("path"))).withColumn("text", F.when(texts, decoded(F.col("content"))))
    return rows.withColumn(
        "reject",
        F.when(F.col("media_type").isNull(), "unsupported_type")
        .when(F.col("length") == 0, "empty_file")
        .when(texts & F.col("text").isNull(), "invalid_utf8")
        .when(texts & (F.size(F.split("text", "\n")) > MAX_LINES), "too_many_lines"),
    )


def csv_shape(text: Column | str) -> Column:
    """A struct of the delimiter that the first line suggests, and rows, columns, cells and reject under it (SRC5, S31), without Python.

    The delimiter is the first of comma, tab, semicolon, colon and bar that the first line has outside quotes, else a comma.
    Quoted fields are folded to one letter each; a field that still begins with a quote has no end, or goes on after it.
    """
    text = F.replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(_MARK), F.lit(" "))
    head = F.regexp_replace(F.substring_index(text, "\n", 1), '"[^"]*+"', "")
    delimiter = F.coalesce(*[F.when(F.instr(head, d) > 0, d) for d in _PREFERRED], F.lit(","))

    def counted(x: Column) -> Column:
        d, body = x["delimiter"], x["text"]
        spaced = F.length(F.replace(x["head"], F.concat(d, F.lit(" ")), F.lit(""))) + 2 * (F.length(x["head"]) - F.length(F.replace(x["head"], d, F.lit("")))) == F.length(x["head"])
        marked = F.replace(body, d, F.lit(_MARK))
        marked = F.when(spaced, F.regexp_replace(marked, f"{_MARK} +", _MARK)).otherwise(marked)
        single = F.regexp_replace(marked, f'(?<![{_MARK}\n])(?<!^)""', "..")  # doubled quotes within a field
        quoted = f'(^|[{_MARK}\n])("[^"]*+")(?=[{_MARK}\n]|\\z)'
        folded = F.regexp_replace(single, quoted, "$1q")
        lines = F.split(folded, "\n")
        lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
        width = F.transform(lines, lambda line: F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(_MARK), F.lit(""))) + 1))
        columns = F.coalesce(F.array_max(width), F.lit(0))
        cells = F.aggregate(width, F.lit(0), lambda s, w: s + w)
        long = F.exists(F.split(folded, f"[{_MARK}\n]"), lambda f: F.length(f) > MAX_FIELD) | F.exists(F.regexp_extract_all(single, F.lit(quoted), F.lit(2)), lambda f: F.length(f) > MAX_FIELD + 2)
        broken = folded.rlike(f'(^|[{_MARK}\n])"') | long
        reject = F.when(broken, "csv_structure").when(columns > MAX_COLUMNS, "too_many_columns").when(cells > MAX_CELLS, "too_many_cells")
        return F.struct(
            d.alias("delimiter"), F.size(lines).cast("long").alias("rows"), columns.cast("long").alias("columns"), cells.cast("long").alias("cells"), reject.alias("reject")
        )

    return F.get(F.transform(F.array(F.struct(delimiter.alias("delimiter"), text.alias("text"), head.alias("head"))), counted), F.lit(0))


def _safe(name: str) -> bool:
    return bool(name) and not name.startswith(("/", "\\")) and "\\" not in name and ":" not in name and ".." not in posixpath.normpath(name).split("/")


def bundle_entries(found: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """(path, entry, text, reject) of the Markdown files in zip bundles; entries with unsafe paths are rejected (SRC8)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for info in archive.infolist():
                            if info.is_dir():
                                continue
                            if not _safe(info.filename):
                                out.append((path, info.filename, None, "unsafe_path"))
                            elif info.file_size > most_bytes:
                                out.append((path, info.filename, None, "too_large"))
                            elif info.filename.endswith(".md"):
                                out.append((path, info.filename, archive.read(info).decode("utf-8-sig", errors="strict"), None))
                except (zipfile.BadZipFile, UnicodeDecodeError):
                    out.append((path, None, None, "unreadable_bundle"))
            yield pd.DataFrame(out, columns=["path", "entry", "text", "reject"])

    return found.select("path", "content").mapInPandas(read, "path string, entry string, text string, reject string")


def workbook_sheets(found: DataFrame) -> DataFrame:
    """(path, sheet, cells, images, reject) of workbooks, read as a stream of XML (SRC6, SRC7)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        names = archive.namelist()
                        images = sum(n.startswith("xl/media/") for n in names)
                        labels = [e.get("name") for _, e in ElementTree.iterparse(archive.open("xl/workbook.xml")) if e.tag.endswith("}sheet") or e.tag == "sheet"]
                        sheets = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
                        for label, name in zip(labels, sheets):
                            cells = 0
                            for _, e in ElementTree.iterparse(archive.open(name)):
                                cells += e.tag.endswith("}c") or e.tag == "c"
                                e.clear()
                            out.append((path, label, cells, images, "too_many_cells" if cells > MAX_CELLS else None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    out.append((path, None, 0, 0, "unreadable_workbook"))
            yield pd.DataFrame(out, columns=["path", "sheet", "cells", "images", "reject"])

    return found.select("path", "content").mapInPandas(read, "path string, sheet string, cells long, images long, reject string")
