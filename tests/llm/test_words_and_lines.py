"""Line frequency, quality rules and token counts against brute force, with edge cases."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

from lectern.llm import line_frequency, quality_rules_ensemble, token_counts
from lectern.llm.shared import held_out

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, h string, gone string")


def brute_base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def normal(line):
    return re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")


def test_line_frequency_against_brute_force(spark):
    rng = random.Random(3)
    shared = ["Common  line 1 here", "common line 7 here\t", "another shared footer of this host"]
    rows = []
    for i in range(60):
        own = [" ".join(rng.choice(["a", "bb", "ccc", "#d", "e|e"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        text = "\n".join(own + rng.sample(shared, rng.randint(0, 3)))
        rows.append((i, text, rng.choice(["x", "y", None]), 1, "clash", "clash"))
    rows += [(60, None, "x", 1, "", ""), (61, "", "x", 1, "", ""), (62, " \t\n\x0b ", None, 1, "", ""), (None, rows[0][1], "x", 1, "", "")]
    rows += [rows[3], rows[3]]  # repeated rows
    rows += [(100 + i, rows[5][1], rows[5][2], 1, "", "") for i in range(30)]  # copies are documents of their own
    rows += [(150, "one line of some words here\n" * 3000 + shared[0], "x", 1, "", "")]
    loop = "one two three four five six seven eight nine"
    rows += [(200, f"{loop} {loop} {loop}", "z", 1, "", ""), (201, "w " * 30, "z", 1, "", "")]
    got = {}
    for r in line_frequency.clean(docs_of(spark, rows), most_docs=8).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = {}
    for doc_id, text, host, *_ in rows:
        for line in {normal(x) for x in (text or "").split("\n")} - {""}:
            texts.setdefault((host, line), set()).add((doc_id, doc_id is None and text))
    frequent = {k for k, v in texts.items() if len(v) > 8}
    assert frequent
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text, host, *_ in rows:
        r = got[doc_id][0]
        n, chars, symbols, dup, rep = brute_base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), doc_id
        failed = n < 20 or 100 * rep > 30 * n
        assert r.base_failed == failed
        lines = [normal(x) for x in (text or "").split("\n") if normal(x)]
        every = sum(len(x.split(" ")) for x in lines)
        gone = sum(len(x.split(" ")) for x in lines if (host, x) in frequent)
        assert r.kept == (not failed and 100 * (every - gone) >= 50 * every)
        kept = None if text is None else "\n".join(x for x in text.split("\n") if (host, normal(x)) not in frequent)
        assert r.text_kept == kept
    assert line_frequency.clean(docs_of(spark, [])).count() == 0


def test_line_frequency_is_native(spark):
    plan = line_frequency.clean(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_word_piece_counts_against_greedy_matching(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    starts, withins = map(set, token_counts.pieces_of(model))

    def greedy(word):
        n = i = 0
        pool = starts
        while i < len(word):
            j = next((j for j in range(min(len(word), i + 40), i, -1) if word[i:j] in pool), 0)
            if not j:
                return 0
            n, i, pool = n + 1, j, withins
        return n

    def brute(text):
        words = token_counts._BASIC.findall(text or "")
        counts = [greedy(w) for w in words]
        return len(words), sum(n or 1 for n in counts), sum(not n for n in counts)

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 7 = 0")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "\U0001f600 x\U0001f600y 中文 don't!!"), (-5, "ab" * 20000), (-5, "ab")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    got = sorted((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.count_tokens(rows, model).collect())
    assert got == sorted((r.doc_id, *brute(r.text)) for r in rows.collect())


def test_automaton_pops_several_pieces_at_once():
    a = token_counts.LongestMatch(["a", "abcdx", "z"], ["b", "c", "cdy", "d", "x"])
    assert a.count("abcdx") == 1
    assert a.count("abcd") == 4  # a ##b ##c ##d
    assert a.count("abcdy") == 3  # a ##b ##cdy
    assert a.count("abq") == 0
    assert a.count("zz") == 0


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    model = quality_rules_ensemble.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    assert model.rules
    scored = quality_rules_ensemble.score(docs.withColumn("stats_of_text", F.lit(1)), model)
    rows = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("quality_score", "quality").collect()
    assert sum((r.quality_score >= 0.7) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    # the compiled column scores as the rules outside Spark do
    stats = docs.limit(200).select("doc_id", quality_rules_ensemble.statistics(F.col("text")).alias("s")).select("doc_id", "s.*").toPandas().sort_values("doc_id")
    expected = model.decide(stats[list(quality_rules_ensemble.STATISTICS)].to_numpy())
    found = {r.doc_id: r.quality_score for r in scored.collect()}
    assert np.allclose([found[d] for d in stats["doc_id"]], expected, atol=1e-9)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, None), (None, 1)]])
def test_quality_edges(spark, labels):
    docs = spark.createDataFrame([(1, "a b c", 0.5), (2, None, 0.1), (3, "", None), (1, "a b c", 0.5), (None, "x" * 100000, 1.0)], "doc_id long, text string, quality_score double")
    model = quality_rules_ensemble.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = quality_rules_ensemble.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality_rules_ensemble.score(docs.limit(0), model).count() == 0
