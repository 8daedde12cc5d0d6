"""From raw documents to packed training sequences: five stages, each a function of (spark, docs, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import jaccard_join, language_id, packing, pii_pseudonyms, quality_rules_ensemble
from lectern.llm.queries import PUBLIC_KEY
from lectern.llm.shared import fresh, held_out, persisted


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found stay. Null texts and texts without a letter have none and go, so an empty
    table or one without a labelled row to learn from gives none; repeated rows are judged alike and all stay."""
    model = language_id.fit(language_id.training_rows(docs))
    lang, score = fresh(docs, "lang_found"), fresh(docs, "lang_certainty")
    judged = language_id.predict(docs, model, out=(lang, score))
    return judged.where(language_id.accepted(F.col(lang), F.col(score))).select(*_columns(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be of quality stay; it learns from labels of this stage's documents.
    Null texts count as empty; without labels of both kinds all get the smoothed share of label 1, so all stay or all go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_rules_ensemble.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    score = fresh(docs, "quality_found")
    scored = quality_rules_ensemble.score(docs, model, out=score)
    return scored.where(F.col(score) >= quality_rules_ensemble.THRESHOLD).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by Jaccard similarity 0.8 or more on shingles of five words, the one of the
    smallest id stays. Texts without words, and rows without an id, link with nothing that goes; of rows that share an id
    one stays."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; ``n_chars`` follows the text. All rows stay, null and empty texts as they are. The
    session's key is used; without one, the queries' public key, which suits synthetic tables only."""
    key = pii_pseudonyms.session_key(spark) or PUBLIC_KEY
    done = pii_pseudonyms.replace_pii(docs, key, kinds=fresh(docs, "kinds_found"))
    return done.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the training sequences. A null or empty text is the end token alone; repeated rows
    are packed repeatedly."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", replace_personal_data),
    ("best-fit packing", pack_sequences),
]

#: The stages hold trained models and a tokenizer, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
