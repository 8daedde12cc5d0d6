"""One query for each operator of this folder, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    centroid_clustering,
    curve_search,
    fill_in_middle,
    gumbel_pieces,
    jaccard_join,
    language_id,
    line_frequency,
    lm_scoring,
    packing,
    pii_pseudonyms,
    quality_rules_ensemble,
    token_counts,
    url_filter,
)
from lectern.llm.shared import held_out

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: For the queries on synthetic tables where the session names no key: known to all, so it hides nothing.
PUBLIC_KEY = "public key of the registered queries"

#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_frequency.clean(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", F.md5("text_kept").alias("kept_md5"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.training_rows(docs))
    judged = language_id.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel_pieces.sample_pieces(_table(spark, sf_dir, "documents"), PIECES, ids=False)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), PIECES)


def op6_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_search.search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_rules_ensemble.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = quality_rules_ensemble.score(docs.select("doc_id", "text"), model)
    passes = (F.col("quality_score") >= quality_rules_ensemble.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), passes.alias("predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_sets(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = pii_pseudonyms.session_key(spark) or PUBLIC_KEY
    done = pii_pseudonyms.replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), key)

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return done.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_values"), *map(count, pii_pseudonyms.KINDS))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm_rate=80)
    text, form = F.col("fim_text"), F.col("fim_form")
    return done.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        form.alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2(text.cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(text, form).cast("binary"), 256).alias("restored_sha256"),
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)


def _cluster_sql(rounds: int = 3) -> str:
    """All rounds written out: every vector is compared with every centroid."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        d{r} AS MATERIALIZED (SELECT vec_id, c, sum((v - m) * (v - m))::BIGINT AS d FROM x JOIN c{r} USING (i) GROUP BY vec_id, c),
        a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM d{r}) WHERE r = 1)""")
        if r < rounds:
            steps.append(f"""
        s{r} AS (SELECT c, i, sum(v) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY c, i),
        c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, m)::BIGINT AS m FROM c{r} LEFT JOIN s{r} USING (c, i))""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 64)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        ),
        x AS MATERIALIZED (SELECT vec_id, unnest(v) AS v, unnest(range(64)) AS i FROM kept),
        c0 AS MATERIALIZED (SELECT c, unnest(v) AS m, unnest(range(64)) AS i FROM (
            SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS c FROM kept) WHERE c < 16),{','.join(steps)},
        whole AS (SELECT c, sum(d) AS w, count(*) AS n FROM a{rounds} GROUP BY c),
        named AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, w::BIGINT AS cluster_inertia, (SELECT sum(w) FROM whole)::BIGINT AS inertia, h AS centroid_sha256, n::BIGINT AS centroid_size
        FROM a{rounds} JOIN whole USING (c) JOIN named USING (c)
    """


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = lm_scoring.learned(F.col("doc_id"))
    scored = lm_scoring.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), learned)
    return scored.select("doc_id", (~learned).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_frequency, op2_language_id, op3_gumbel_pieces, op4_best_fit_packing, op5_token_counts,
        op6_curve_search, op7_url_filter, op8_quality_classifier, op9_jaccard_join, op10_pii_pseudonyms,
        op11_fill_in_middle, op12_centroid_clusters, op13_lm_scores,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"

#: DuckDB SQL for the queries that SQL can express. The others hold trained models, a tokenizer, keyed hashes or noise.
ORACLES: dict[str, str] = {
    "op1_line_frequency": rf"""
        WITH d AS (
            SELECT doc_id, source, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
        ), base AS (
            SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
            FROM d
        ), windows AS (
            SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS g
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
        ), repeats AS (
            SELECT doc_id, sum(step) AS n_repeat_words
            FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM twice) GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, source, unnest(raw) AS raw, unnest(normal) AS line, unnest(range(len(raw))) AS i FROM (
                SELECT doc_id, source, string_split(t, chr(10)) AS raw, list_transform(string_split(
                    regexp_replace(translate(lower(t), '123456789', '000000000'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')) AS normal
                FROM d WHERE text IS NOT NULL)
        ), full_lines AS (
            SELECT *, CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, ' ', '')) + 1 END AS w FROM lines
        ), frequent AS (
            SELECT source, line FROM (SELECT DISTINCT source, line, doc_id FROM full_lines WHERE line <> '') GROUP BY source, line HAVING count(*) > {line_frequency.MOST_DOCS}
        ), removed AS (
            SELECT l.doc_id, sum(l.w) AS all_w, coalesce(sum(l.w) FILTER (f.line IS NOT NULL), 0) AS gone_w,
                md5(coalesce(string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (f.line IS NULL), '')) AS kept_md5
            FROM full_lines l LEFT JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY l.doc_id
        ), joined AS (
            SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, all_w, gone_w, kept_md5
            FROM base b LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < {line_frequency.LEAST_WORDS} OR 100 * n_repeat_words > {line_frequency.MOST_REPEATED} * n_words AS base_failed,
            NOT (n_words < {line_frequency.LEAST_WORDS} OR 100 * n_repeat_words > {line_frequency.MOST_REPEATED} * n_words)
                AND coalesce(100 * (all_w - gone_w) >= {line_frequency.LEAST_KEPT} * all_w, true) AS kept,
            coalesce((n_words * gone_w) // nullif(all_w, 0), 0)::BIGINT AS removed_words, kept_md5
        FROM joined
    """,
    "op6_curve_search": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda x, y: x + y) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
    """,
    "op7_url_filter": """
        WITH parts AS (
            SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), named AS (
            SELECT page_id, translate(regexp_replace(rest, '(?s)[/?#].*', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_replace(regexp_replace(rest, '(?s)[?#].*', ''), '^[^/]*', '') AS path
            FROM parts
        ), ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
            FROM named
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
    """,
    "op9_jaccard_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
        ), n AS (
            SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id
        ), links AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)
        ), reach AS (
            SELECT doc_id, doc_id AS root FROM w UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.root = links.a
        )
        SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(root) AS component_id FROM n JOIN reach ON n.doc_id = reach.doc_id GROUP BY 1, 2
    """,
    "op12_centroid_clusters": _cluster_sql(),
    "op11_fill_in_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), h AS (
            SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
            FROM t
        ), cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE
                WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
        ), parts AS (
            SELECT *, coalesce(array_to_string(units[1 : a], ''), '') AS p, coalesce(array_to_string(units[a + 1 : b], ''), '') AS m, coalesce(array_to_string(units[b + 1 : n], ''), '') AS s FROM cut
        )
        SELECT doc_id, n::BIGINT AS n, form,
            CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM parts
    """,
}
