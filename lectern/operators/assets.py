"""Relations of chunks and assets (J19): which picture, table or page image a chunk of text goes with, and why.

No pair of a chunk and an asset is looked at unless they share something: an item, a caption, a parent, a figure's label or a
page. Each of these is an equi-join on what is shared within a document, and the first rule of a pair wins.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (relation, provenance, confidence in millionths) in the order of the rules.
RULES = (
    ("ocr_of", "page_ocr", 1_000_000),
    ("table_of", "table_identity", 1_000_000),
    ("caption_of", "caption_ref", 1_000_000),
    ("inline_figure", "item_ref", 1_000_000),
    ("inline_figure", "parent_ref", 1_000_000),
    ("explicit_figure_reference", "author_reference", 1_000_000),
    ("spatial_neighbor", "surface_neighbour", 500_000),
    ("same_page", "surface_co_location", 250_000),
)
_OCR, _TABLE, _CAPTION, _ITEM, _PARENT, _NAMED, _NEXT, _PAGE = range(len(RULES))


def related(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc_id, chunk, asset, relation_type, provenance, confidence_micros, figure_label, ordinal): a row a related pair.

    ``chunks``: doc_id, chunk, refs, positions (of the refs in reading order), surfaces (pages), labels (of figures that the text
    names). ``assets``: doc_id, asset, kind, ref, parent, captions (refs), position, surfaces, labels. A page image goes with
    text on its page; an asset without a ref has no other relation. ``ordinal`` counts a document's relations by chunk
    and asset.
    """
    told = assets.withColumn("own", F.array_min("labels"))
    items = told.where("kind <> 'page_image' and ref is not null")
    by_ref = chunks.select("doc_id", "chunk", F.explode(F.array_distinct("refs")).alias("ref"))

    def met(of: DataFrame, rule: int | Column, *on: str, label: str = "own") -> DataFrame:
        number = F.lit(rule) if isinstance(rule, int) else rule
        return of.select("doc_id", "chunk", "asset", number.cast("int").alias("rule"), F.col(label).alias("figure_label"))

    same_item = by_ref.join(items.select("doc_id", "asset", "kind", "ref", "own"), ["doc_id", "ref"])
    captioned = by_ref.join(items.select("doc_id", "asset", "own", F.explode(F.array_distinct("captions")).alias("ref")), ["doc_id", "ref"])
    parented = by_ref.join(items.select("doc_id", "asset", "own", F.col("parent").alias("ref")), ["doc_id", "ref"])
    named = chunks.select("doc_id", "chunk", F.explode(F.array_distinct("labels")).alias("label")).join(
        items.select("doc_id", "asset", F.explode(F.array_distinct("labels")).alias("label")), ["doc_id", "label"]
    )
    ends = [F.array_min("positions").alias("first"), F.array_max("positions").alias("last")]
    on_page = chunks.select("doc_id", "chunk", *ends, F.explode(F.array_distinct("surfaces")).alias("surface")).join(
        told.select("doc_id", "asset", "kind", "ref", "position", F.explode(F.array_distinct("surfaces")).alias("surface")), ["doc_id", "surface"]
    )
    image = F.col("kind") == "page_image"
    beside = F.coalesce((F.col("position") == F.col("first") - 1) | (F.col("position") == F.col("last") + 1), F.lit(False))
    on_page = on_page.where(image | F.col("ref").isNotNull()).withColumn("own", F.lit(None).cast("string"))
    found = [
        met(same_item, F.when(F.col("kind") == "table_image", _TABLE).otherwise(_ITEM)), met(captioned, _CAPTION), met(parented, _PARENT),
        met(named, _NAMED, label="label"), met(on_page, F.when(image, _OCR).when(beside, _NEXT).otherwise(_PAGE)),
    ]
    first = functools.reduce(DataFrame.unionByName, found).groupBy("doc_id", "chunk", "asset").agg(F.min(F.struct("rule", "figure_label")).alias("x"))
    rules = F.array(*[F.struct(F.lit(a).alias("relation_type"), F.lit(b).alias("provenance"), F.lit(c).alias("confidence_micros")) for a, b, c in RULES])
    rows = first.select("doc_id", "chunk", "asset", F.get(rules, F.col("x.rule")).alias("r"), F.col("x.figure_label").alias("figure_label"))
    order = Window.partitionBy("doc_id").orderBy("chunk", "asset")
    return rows.select("doc_id", "chunk", "asset", "r.*", "figure_label", (F.row_number().over(order) - 1).alias("ordinal"))


def beyond_limits(relations: DataFrame, per_chunk: int, per_document: int) -> DataFrame:
    """(doc_id, limit_name): documents that have more relations, of one chunk or in all, than may be stored."""
    chunks = relations.groupBy("doc_id", "chunk").agg(F.count("*").alias("n"))
    whole = chunks.groupBy("doc_id").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    over = F.when(F.col("most") > per_chunk, "max_relations_per_chunk").when(F.col("n") > per_document, "max_relations")
    return whole.select("doc_id", over.alias("limit_name")).where("limit_name is not null")
