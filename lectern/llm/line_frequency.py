"""Cross-document line frequency: removes lines that many documents of a host share, and rejects depleted documents.

Spark expressions only. Lines are normalised (lower case, white space collapsed and trimmed, digits as 0) and hashed to
64 bits, once a text: each text's hashes and words by line are written to the shared folder and read again by all later
steps. For each host the distinct documents of a line are counted. A line above the limit is removed from every document
of its host; a document that keeps too small a share of its words is rejected.

Two exchanges of a few numbers a line do the counting: one to find distinct (host, line, document), one for partial
counts, so a line that a third of all documents hold is a row a task. The frequent lines, being of known size in the
shared folder, are broadcast while they are few and joined by a splittable sort-merge join else.

Defined results: null text has no words and lines and is rejected, as is empty text; a null host is a host of its own;
rows that repeat an id are one document for the counts and are judged by their own text each; rows without an id are
one document for each different text; a text of any length is one row, whose lines are handled as arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import BLANK, let, persisted

#: A line in more than this many distinct documents of a host is boilerplate.
MOST_DOCS = 20
#: A document is depleted if it keeps less than this share (percent) of its words.
LEAST_KEPT = 50
#: Words of a window, for repeats within a document.
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
_TRIM = " \t\n\u000b\f\r"


def _words(text: Column) -> Column:
    """The words of a text; none if it is blank."""
    trimmed = F.btrim(text, F.lit(_TRIM))
    return F.when(F.length(trimmed) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, BLANK + "+"))


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text, blank ones included."""
    lowered = F.translate(F.lower(text), "123456789", "000000000")
    return F.split(F.regexp_replace(F.regexp_replace(lowered, r"[\x20\x09\x0B-\x0D]+", " "), r" ?\n ?", "\n"), "\n")


def _hash(line: Column) -> Column:
    """The hash of a normalised line; none for a blank one."""
    trimmed = F.btrim(line)
    return F.when(trimmed != "", F.xxhash64(trimmed))


def line_hashes(text: Column) -> Column:
    """The hashes of a text's lines, in order."""
    return F.transform(normal_lines(text), _hash)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of the text that occurs twice or more."""

    def of_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))), of_windows)

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)
        )

    def of_sorted(pairs: Column) -> Column:
        same = F.filter(
            pairs, lambda x, i: (F.get(pairs, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(pairs, i + 1)["h"].eqNullSafe(x["h"]))
        )
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def covered(places: Column) -> Column:
        # each window adds its words up to the next one's start; the last adds all
        steps = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def base_statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    body = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(_TRIM))) > 0)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    return let(_words(body), of_words)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])


def frequent_lines(lines: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, h, n_docs) of lines in more than ``most_docs`` distinct documents of a host, from (host, doc, hashes)."""
    each = lines.select("host", "doc", F.explode(F.array_distinct("hashes")).alias("h")).where("h is not null")
    return each.distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > most_docs)


def clean(docs: DataFrame, host: str = "source", most_docs: int = MOST_DOCS, least_kept: int = LEAST_KEPT) -> DataFrame:
    """A row a row of ``docs`` (doc_id, text, host): base statistics, base_failed, the words of removed lines, the text
    without them (``text_kept``), and ``kept``."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`")), F.lit(""))).alias("host"), F.xxhash64("text").alias("of"))
    # a document is its id; without one, its text
    doc = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit("id"), F.col("doc_id"))).otherwise(F.col("of"))
    lines = persisted(rows.where("text is not null").select("doc_id", "host", "of", doc.alias("doc"), line_hashes(F.col("text")).alias("hashes")), "line-hashes")
    frequent = persisted(frequent_lines(lines, most_docs).select("host", "h"), "frequent-lines")
    removed = (
        lines.select("doc_id", "host", "of", F.explode(F.array_distinct("hashes")).alias("h")).join(frequent, ["host", "h"])
        .groupBy("doc_id", "host", "of").agg(F.collect_set("h").alias("gone"))  # lines of one text
        .select(F.col("doc_id").alias("id_"), F.col("host").alias("host_"), F.col("of").alias("of_"), "gone")
    )
    stats = rows.select("doc_id", "host", "text", "of", base_statistics(F.col("text")).alias("s"))
    both = stats.join(removed, F.expr("doc_id <=> id_ and host <=> host_ and of <=> of_"), "left")

    def cleaned(normal: Column) -> Column:
        """Words in all lines and in removed ones, and the text of the others."""
        gone = F.transform(normal, lambda x: F.coalesce(F.array_contains(F.col("gone"), _hash(x)), F.lit(False)))

        def summed(hit: Column) -> Column:
            words = F.transform(normal, lambda x: F.when(F.btrim(x) == "", 0).otherwise(F.length(F.btrim(x)) - F.length(F.replace(F.btrim(x), F.lit(" "), F.lit(""))) + 1).cast("long"))
            total = lambda per: F.aggregate(per, F.lit(0).cast("long"), lambda a, x: a + x)
            kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.get(hit, i))
            return let(words, lambda w: F.struct(total(w).alias("all_w"), total(F.zip_with(w, hit, lambda n, h: F.when(h, n).otherwise(0))).alias("gone_w"), F.array_join(kept, "\n").alias("text")))

        return let(gone, summed)

    # only texts with a line to remove are normalised again
    both = both.withColumn("left_", F.when(F.col("gone").isNotNull(), let(normal_lines(F.col("text")), cleaned)))
    failed = base_failed(F.col("s"))
    return both.select(
        "doc_id", "s.*", failed.alias("base_failed"),
        F.coalesce(F.expr("s.n_words * left_.gone_w div left_.all_w"), F.lit(0)).alias("removed_words"),
        (~failed & F.coalesce(F.expr(f"100 * (left_.all_w - left_.gone_w) >= {least_kept} * left_.all_w"), F.lit(True))).alias("kept"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.col("left_.text")).alias("text_kept"),
    )
