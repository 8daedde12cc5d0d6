"""Chunking, text functions, HTML blocks and boundaries over documents, pages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import values as vl
from lectern.operators import assets, chunking, scope, selection, windows
from lectern.plans.registry import CHUNKS, TERMS, query
from lectern.sources import blocks as bl
from lectern.sources.steps import stored
from lectern.sources.tables import TOKEN, chunk_id, line_chunks, table, token_count, values

_SMOOTH = """
    d AS (SELECT label AS doc_id, vec_id AS unit, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM embeddings),
    r AS (SELECT doc_id, unit, CASE WHEN u IS NOT NULL THEN round_even(greatest(0.0, least(2.0, 1 - list_reduce(list_transform(range(1, 65), lambda i: v[i] * u[i]), lambda x, y: x + y))) * 1000000, 0)::BIGINT END AS distance FROM d),
    n AS (SELECT *, lag(distance) OVER w AS a, lead(distance) OVER w AS b FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY unit)),
    s AS (SELECT doc_id, unit, distance, CASE WHEN distance IS NOT NULL THEN (2 * (2 * distance + coalesce(a, 0) + coalesce(b, 0)) + 2 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT) // (2 * (2 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT)) END AS smooth FROM n)"""


def _smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label, by id, stand for the units of a document."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("unit"), "embedding")
    return chunking.smoothed(chunking.adjacent_distances(rows)).select("doc_id", "unit", "distance", "smooth")


@query(f"WITH {_SMOOTH} SELECT doc_id, unit, distance, smooth FROM s")
def smoothed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of neighbouring units in integers, smoothed."""
    return _smoothed(spark, sf_dir)


@query(
    f"""WITH {_SMOOTH}, l AS (SELECT doc_id, list_sort(list(smooth)) AS v FROM s WHERE smooth IS NOT NULL GROUP BY 1),
    m AS (SELECT doc_id, v, (2 * (v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) + 2) // 4 AS middle FROM l),
    a AS (SELECT *, list_sort(list_transform(v, lambda x: abs(x - middle))) AS w FROM m)
    SELECT doc_id, len(v)::INTEGER AS n, middle, (2 * (w[(len(v) - 1) // 2 + 1] + w[len(v) // 2 + 1]) + 2) // 4 AS mad, middle + (2 * (w[(len(v) - 1) // 2 + 1] + w[len(v) // 2 + 1]) + 2) // 4 AS threshold FROM a"""
)
def mad_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6, AG16."""
    return chunking.thresholds(_smoothed(spark, sf_dir))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN.replace(chr(92) + 's', chr(92) + 's')}'))::BIGINT AS tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared token counter over whole documents."""
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


@query(f"WITH c AS ({CHUNKS}) SELECT doc_id * 1000000 + ordinal AS chunk_id, sha256('v1:' || doc_id || ':' || ordinal || ':' || sha256(content)) AS chunk_key FROM c")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys derived from profile, document, ordinal and content hash."""
    c = line_chunks(table(spark, sf_dir, "documents"))
    return c.select(chunk_id(F.col("doc_id"), F.col("ordinal")).alias("chunk_id"), vl.sha("v1", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"), F.sha2("content", 256)).alias("chunk_key"))


@query(f"WITH c AS ({CHUNKS}) SELECT doc_id, sha256('units' || chr(10) || string_agg(sha256(content) || chr(10), '' ORDER BY sha256(content))) AS plan_hash FROM c GROUP BY 1")
def plan_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over a document's units."""
    c = line_chunks(table(spark, sf_dir, "documents"))
    return c.groupBy("doc_id").agg(vl.list_hash("units", F.collect_list(F.sha2("content", 256))).alias("plan_hash"))


@query(
    f"""WITH c AS ({CHUNKS}), r AS (SELECT doc_id, ordinal, CASE WHEN lag(ordinal) OVER w IS NULL THEN NULL WHEN lag(ordinal // 12) OVER w <> ordinal // 12 THEN 'surface'
        WHEN contains(content, '|') OR lag(contains(content, '|')) OVER w THEN 'table' WHEN length(content) < 20 THEN 'section' END AS reason FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))
    SELECT * FROM r"""
)
def boundary_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: lines as blocks: twelve a surface, pipes make tables, short ones headings."""
    kind = F.when(F.instr("content", "|") > 0, "table").when(F.length("content") < 20, "heading").otherwise("text")
    c = line_chunks(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", F.expr("ordinal div 12").alias("surface"), kind.alias("kind"), F.lit("s").alias("section"))
    return chunking.boundary_reasons(c).select("doc_id", "ordinal", "reason")


@query(
    f"""WITH c AS ({CHUNKS}), k AS (SELECT doc_id, ordinal, content, CASE WHEN length(content) < 40 THEN (CASE WHEN length(content) < 15 THEN 1 ELSE 2 END) END AS depth FROM c),
    o AS (SELECT *, max(CASE WHEN depth = 1 THEN ordinal END) OVER w AS o1, max(CASE WHEN depth = 2 THEN ordinal END) OVER w AS o2 FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))
    SELECT o.doc_id, o.ordinal, concat_ws(' > ', a.content, CASE WHEN o2 > coalesce(o1, -1) THEN b.content END) AS section FROM o LEFT JOIN c a ON a.doc_id = o.doc_id AND a.ordinal = o1 LEFT JOIN c b ON b.doc_id = o.doc_id AND b.ordinal = o2"""
)
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines as headings of two depths; each line's headings above."""
    depth = F.when(F.length("content") < 15, 1).when(F.length("content") < 40, 2)
    c = line_chunks(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", F.col("content").alias("text"), depth.alias("depth"), F.when(depth.isNotNull(), "heading").otherwise("text").alias("kind"))
    return chunking.section_paths(c, deepest=2).select("doc_id", "ordinal", "section")


@query(
    """SELECT item_id, doc_id, (strpos(d.text, b.text) - 1)::INTEGER AS start, (strpos(d.text, b.text) - 1 + length(b.text))::INTEGER AS end_ FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0"""
)
def exact_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as quotes, found by four whole words and then checked exactly."""
    asks = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return _quotes_found(asks, table(spark, sf_dir, "documents").select("doc_id", "text"))


def _quotes_found(asks: DataFrame, docs: DataFrame, most: int = 10_000) -> DataFrame:
    """(item_id, doc_id, start, end_) of all quotes in all texts; up to ``most`` quotes are broadcast, more are shuffled."""
    # windows of four words meet the quotes' second to fifth words by an equi-join; a quote may start and end in the middle
    # of a word, so a word counts only with white space on both sides. Quotes without such words are looked for in each text
    key = F.btrim(F.regexp_replace(F.regexp_extract("quote", r"^\s*\S+\s+((?:\S+\s+){4})", 1), r"\s+", " "))
    asks = asks.withColumn("key", key)
    long, short = asks.where("key <> ''"), asks.where("key = ''").drop("key")
    n = asks.agg(F.count_if(F.col("key") != "").alias("long"), F.count_if(F.col("key") == "").alias("short")).first()
    words = docs.withColumn("w", F.split("text", r"\s+")).where(F.size("w") >= 4)
    windows = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))))
    if n["long"] <= most:
        met = words.select("doc_id", "text", windows.alias("key")).join(F.broadcast(long), "key")
    else:
        pairs = words.select("doc_id", windows.alias("key")).join(long.drop("quote"), "key").select("doc_id", "item_id").distinct()
        met = pairs.join(docs, "doc_id").join(long, "item_id")
    met = met.select("item_id", "doc_id", "quote", "text")
    if n["short"]:
        met = met.unionByName(docs.crossJoin(F.broadcast(short) if n["short"] <= most else short).select("item_id", "doc_id", "quote", "text"))
    hit = met.withColumn("at", tx.span_of(F.col("quote"), F.col("text"))).where("at is not null")
    return hit.select("item_id", "doc_id", F.col("at.start").alias("start"), F.col("at.end").alias("end_"))


@query(
    """SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS flat, len(list_filter(string_split_regex(text, '\\n[ \\t]*\\n+'), lambda x: trim(x, ' ') <> ''))::INTEGER AS records FROM benchmark"""
)
def text_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space collapsed, and records between blank lines."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.btrim(F.regexp_replace("text", r"\s+", " ")).alias("flat"), F.size(tx.records(F.col("text"))).alias("records"))


@query(
    r"""WITH d AS (SELECT doc_id, 'See Fig. ' || (doc_id % 7) || ' and Figure ' || (doc_id % 5) || 'A; fig ' || (doc_id % 7) || ' ' || text AS a, ' ' || (doc_id % 9) || ') “' || string_split(text, chr(10))[1] || '”。' AS b FROM documents),
    q AS (SELECT doc_id, a, trim(regexp_replace(regexp_replace(b, '\s+', ' ', 'g'), '^ +', '')) AS flat FROM d)
    SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(a, '(?i)(?:fig(?:ure)?[.\s]*|图\s*)([0-9]+(?:[A-Za-z]|[.\-][0-9A-Za-z]+)?)', 1), lambda x: 'figure:' || lower(x)))) AS labels,
        trim(rtrim(trim(regexp_replace(flat, '^(?:[0-9]+[.)、]|[-*•])\s+', ''), ' "''“”‘’'), '。.;；')) AS question FROM q"""
)
def labels_and_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures named before whole texts, and first lines as numbered and quoted questions."""
    d, n = table(spark, sf_dir, "documents"), lambda m: (F.col("doc_id") % m).cast("string")
    named = F.concat(F.lit("See Fig. "), n(7), F.lit(" and Figure "), n(5), F.lit("A; fig "), n(7), F.lit(" "), F.col("text"))
    asked = F.concat(F.lit(" "), n(9), F.lit(") “"), F.substring_index("text", "\n", 1), F.lit("”。"))
    return d.select("doc_id", tx.figure_labels(named).alias("labels"), tx.question(asked).alias("question"))


@query(
    f"""WITH t AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN [] ELSE ({TERMS.format('text')})[1:64] END AS l FROM benchmark)
    SELECT item_id, CASE WHEN len(l) > 0 THEN array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), ' | ') END AS q FROM t"""
)
def or_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passages' terms as OR queries, null where there are none."""
    found = F.when(F.col("item_id") % 5 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.slice(tx.terms(F.col("text")), 1, 64))
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(tx.or_query(found), "'", "").alias("q"))


@query(
    """WITH j AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events)
    SELECT event_id, CASE WHEN k IS NULL THEN '{"e":"1"}' ELSE '{}' END AS without_k, k IS NOT NULL AS has_k, CASE WHEN k IS NULL THEN '{"e":"1","b":"3"}' ELSE '{"k":"' || k || '","b":"3"}' END AS merged,
        coalesce(k = (event_id % 100)::VARCHAR, false) AS contains_k FROM j"""
)
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S33, S34, AG6: keys of events' properties dropped, objects merged, containment."""
    e = table(spark, sf_dir, "events")
    j = F.when(F.col("event_id") % 3 == 0, '{"e":"1"}').otherwise(F.col("props"))
    part = F.concat(F.lit('{"k":"'), (F.col("event_id") % 100).cast("string"), F.lit('"}'))
    return e.select("event_id", vl.without_key(j, "k").alias("without_k"), vl.has_key(j, "k").alias("has_k"), vl.merged(j, F.lit('{"b":"3"}')).alias("merged"), vl.contains(j, part).alias("contains_k"))


@query(
    r"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 10 AS m FROM orders)
    SELECT k AS order_id, CASE m WHEN 1 THEN c || ' / 0' WHEN 2 THEN 'x + ' || c WHEN 3 THEN c || ' +' WHEN 4 THEN '' WHEN 5 THEN c || ' ** 2' WHEN 6 THEN '0x1F / ' || c ELSE c || ' * (' || (k % 9) || ' - 4) + ' || (k % 7) || ' / 4' END AS expression,
        CASE WHEN m NOT BETWEEN 1 AND 6 THEN regexp_replace(regexp_replace((c * (k % 9 - 4) + (k % 7)::DECIMAL(18, 2) / 4)::DECIMAL(18, 2)::VARCHAR, '0+$', ''), '\.$', '') END AS value,
        CASE m WHEN 1 THEN CASE c WHEN 0 THEN 'numeric_limit' ELSE 'division_by_zero' END WHEN 2 THEN 'unsupported_ast' WHEN 3 THEN 'syntax' WHEN 4 THEN 'expression_empty' WHEN 5 THEN 'unsupported_ast' WHEN 6 THEN 'syntax' END AS reject FROM o"""
)
def decimal_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression of each order in exact decimal arithmetic, with reject reasons."""
    k, c, m = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_orderkey") % 10
    sound = F.concat(c, F.lit(" * ("), (k % 9).cast("string"), F.lit(" - 4) + "), (k % 7).cast("string"), F.lit(" / 4"))
    expression = (
        F.when(m == 1, F.concat(c, F.lit(" / 0"))).when(m == 2, F.concat(F.lit("x + "), c)).when(m == 3, F.concat(c, F.lit(" +"))).when(m == 4, "")
        .when(m == 5, F.concat(c, F.lit(" ** 2"))).when(m == 6, F.concat(F.lit("0x1F / "), c)).otherwise(sound)
    )
    rows = table(spark, sf_dir, "orders").select(k.alias("order_id"), expression.alias("expression"))
    return rows.select("order_id", "expression", vl.calculated(F.col("expression")).alias("c")).select("order_id", "expression", "c.value", "c.reject")


@query("""SELECT event_id, least(30 * pow(2, event_id % 12), 3600)::BIGINT AS delay, (2 * floor(value)::BIGINT + 7) // 14 AS ratio FROM events""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay before each event's next attempt, and its value's rounded ratio."""
    return table(spark, sf_dir, "events").select(
        "event_id", vl.backoff_seconds(F.col("event_id") % 12 + 1, 30, 3600).alias("delay"), vl.half_up_ratio(F.floor("value").cast("long"), F.lit(7)).alias("ratio")
    )


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9, C19: typed blocks of every page."""
    return bl.blocks(table(spark, sf_dir, "pages"))


@query()
def semantic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every document."""
    return chunking.units(table(spark, sf_dir, "documents"))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every document chunked; how few terms neighbours share is their distance, units with pipes
    are tables, and short ones head sections."""
    u = chunking.units(table(spark, sf_dir, "documents"))
    kind = F.when(F.instr("text", "|") > 0, "table").when(F.length("text") < 20, "heading").otherwise("text")
    marked = stored(u.withColumns({"ordinal": F.col("unit"), "surface": F.lit(0), "kind": kind, "section": F.lit("")}), "units")
    rows = chunking.boundary_reasons(marked).withColumn("terms", F.array_distinct(tx.terms(F.col("text"))))
    rows = chunking.smoothed(chunking.term_distances(rows))
    # a unit's page, its heading's number and its own reference, for what chunks have in common
    heading = F.count_if(F.col("kind") == "heading").over(Window.partitionBy("doc_id").orderBy("unit"))
    page, name = F.expr("unit div 12"), F.concat(F.lit("u"), F.col("unit").cast("string"))
    about = marked.select("doc_id", "unit", F.array(name).alias("refs"), page.alias("first_page"), page.alias("last_page"), F.array(F.lit("document"), heading.cast("string")).alias("path"))
    return chunking.assembled(stored(chunking.semantic_chunks(rows), "chunks"), about)


@query(
    f"""WITH c AS ({CHUNKS}), u AS (SELECT doc_id, ordinal // 8 AS chunk, ordinal, ordinal // 2 AS page, ['d', 's' || (ordinal // 20), 'p' || (ordinal // 5)] AS path FROM c WHERE ordinal % 8 NOT IN (3, 4, 5)),
    e AS (SELECT doc_id, ordinal // 8 AS chunk, min(ordinal) AS first_unit, max(ordinal) AS last_unit FROM c GROUP BY 1, 2),
    r AS (SELECT doc_id, chunk, 'line' || ordinal AS ref, ordinal * 2 AS o FROM u UNION ALL SELECT doc_id, chunk, 'block' || (ordinal // 3), ordinal * 2 + 1 FROM u),
    f AS (SELECT doc_id, chunk, ref, min(o) AS o FROM r GROUP BY 1, 2, 3),
    i AS (SELECT *, page - dense_rank() OVER (PARTITION BY doc_id, chunk ORDER BY page) AS island FROM (SELECT DISTINCT doc_id, chunk, page FROM u)),
    g AS (SELECT doc_id, chunk, min(page) AS a, max(page) AS z FROM i GROUP BY doc_id, chunk, island)
    SELECT doc_id, chunk, first_unit, last_unit, refs, pages, hierarchy FROM e
    LEFT JOIN (SELECT doc_id, chunk, list(ref ORDER BY o) AS refs FROM f GROUP BY 1, 2) USING (doc_id, chunk)
    LEFT JOIN (SELECT doc_id, chunk, string_agg(a || '-' || z, ',' ORDER BY a) AS pages FROM g GROUP BY 1, 2) USING (doc_id, chunk)
    LEFT JOIN (SELECT doc_id, chunk, CASE WHEN count(DISTINCT path) = 1 THEN min(path) WHEN count(DISTINCT path[2]) = 1 THEN min(path)[1:2] ELSE min(path)[1:1] END AS hierarchy FROM u GROUP BY 1, 2) USING (doc_id, chunk)"""
)
def chunk_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of eight lines with their lines' references, page ranges and common headings; three of eight lines have none."""
    c = line_chunks(table(spark, sf_dir, "documents"))
    n, text = F.col("ordinal"), lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    chunks = c.groupBy("doc_id", F.expr("ordinal div 8").alias("chunk")).agg(F.min("ordinal").alias("first_unit"), F.max("ordinal").alias("last_unit"))
    units = c.where(~(n % 8).isin(3, 4, 5)).select(
        "doc_id", n.alias("unit"), F.array(text("line", n), text("block", F.expr("ordinal div 3"))).alias("refs"), F.expr("ordinal div 2").alias("first_page"), F.expr("ordinal div 2").alias("last_page"),
        F.array(F.lit("d"), text("s", F.expr("ordinal div 20")), text("p", F.expr("ordinal div 5"))).alias("path"),
    )
    done = chunking.assembled(chunks, units)
    pages = F.array_join(F.transform("pages", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return done.select("doc_id", "chunk", "first_unit", "last_unit", "refs", pages.alias("pages"), "hierarchy")


@query()
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page folded into chunks under their headings."""
    b = bl.blocks(table(spark, sf_dir, "pages")).withColumnRenamed("page_id", "doc_id")
    kind = F.when(F.col("kind") == "heading", "heading").when(F.col("kind") == "table_row", "table").otherwise("text")
    return chunking.structural_chunks(chunking.section_paths(b.withColumn("kind", kind)))


@query()
def table_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' lines with pipes as tables, in parts with a repeated header."""
    c = line_chunks(table(spark, sf_dir, "documents")).where(F.instr("content", "|") > 0).select("doc_id", "ordinal", tx.compact_row(F.col("content")).alias("row"))
    t = c.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "row"))), lambda x: x["row"]), "\n").alias("text"))
    return chunking.structural_chunks(t.select("doc_id", F.lit(0).alias("ordinal"), F.lit("table").alias("kind"), F.lit("").alias("section"), "text"))


@query(
    f"""WITH c AS ({CHUNKS}) SELECT doc_id, min(ordinal // 10)::BIGINT AS first_page, max(ordinal // 10)::BIGINT AS last_page, CASE WHEN count(*) = 1 THEN min(ordinal) END AS bbox FROM c GROUP BY 1"""
)
def source_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a document's chunks; a box only of single ones."""
    c = line_chunks(table(spark, sf_dir, "documents")).select("doc_id", F.expr("ordinal div 10").alias("page"), F.col("ordinal").alias("bbox"))
    return chunking.located(c, "doc_id")


@query(
    f"""WITH c AS ({CHUNKS}), b AS (SELECT doc_id, ordinal * 2 AS position, 'c' || ordinal AS key, 0 AS o FROM c UNION ALL SELECT doc_id, ordinal * 3, 'a' || ordinal, 1 FROM c WHERE ordinal < 3)
    SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY position, o, key) - 1 AS ordinal, CASE o WHEN 0 THEN 'chunk:' ELSE 'figure:' END || key AS group_key FROM b"""
)
def evidence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and assets in reading order."""
    c = line_chunks(table(spark, sf_dir, "documents"))
    one = c.select("doc_id", (F.col("ordinal") * 2).alias("position"), F.concat(F.lit("c"), F.col("ordinal").cast("string")).alias("key"))
    two = c.where("ordinal < 3").select("doc_id", (F.col("ordinal") * 3).alias("position"), F.concat(F.lit("a"), F.col("ordinal").cast("string")).alias("key"))
    return chunking.evidence_units(one, two).select("doc_id", "key", F.col("ordinal").cast("long").alias("ordinal"), "group_key")


@query(
    f"""WITH c AS ({CHUNKS}), a AS (SELECT doc_id, ordinal, ordinal // 20 AS page, contains(content, '|') AS t FROM c)
    SELECT x.doc_id AS doc_id, x.ordinal AS anchor, y.ordinal AS ordinal FROM a x JOIN a y ON x.doc_id = y.doc_id AND abs(x.ordinal - y.ordinal) = 1 WHERE y.t AND abs(x.page - y.page) <= 1 AND x.ordinal // 7 = y.ordinal // 7"""
)
def table_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF9, J7, R11: tables beside a chunk, under the same heading and at most a page away."""
    kind = F.when(F.instr("content", "|") > 0, "table").otherwise("text")
    c = line_chunks(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", kind.alias("kind"), F.expr("ordinal div 20").alias("page"), F.array(F.expr("ordinal div 7").cast("string")).alias("path"), F.lit("pdf").alias("surface"))
    near = scope.neighbours(c.select("doc_id", "ordinal"), c)
    anchor = c.select("doc_id", F.col("ordinal").alias("anchor"), *[F.col(x).alias(f"a_{x}") for x in ("kind", "page", "path", "surface")])
    both = near.join(anchor, ["doc_id", "anchor"])
    fits = scope.table_neighbour(*[F.col(x) for x in ("a_kind", "kind", "a_path", "path", "a_page", "page", "a_surface", "surface")])
    return both.where(fits).select("doc_id", "anchor", "ordinal")


@query(
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'same_group' WHEN p_brand = 'Brand#11' OR p_type LIKE '%STEEL%' THEN 'named' WHEN p_retailprice > 1500 THEN 'near' END AS relation FROM part"""
)
def relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that holds."""
    p = table(spark, sf_dir, "part")
    rules = [("same_group", F.col("p_size") < 10), ("named", (F.col("p_brand") == "Brand#11") | F.col("p_type").like("%STEEL%")), ("near", F.col("p_retailprice") > 1500)]
    return p.select("p_partkey", scope.first_matching_rule(p, rules).alias("relation"))


_ASSETS_SQL = f"""
    c AS ({CHUNKS}),
    ch AS (SELECT doc_id, ordinal AS chunk, ['t' || ordinal] AS refs, [ordinal * 2] AS positions, CASE WHEN ordinal % 10 = 9 THEN [ordinal // 10, ordinal // 10 + 1] ELSE [ordinal // 10] END AS surfaces,
        CASE WHEN length(content) % 4 = 0 THEN ['figure:' || (length(content) % 9), 'figure:' || (ordinal % 5)] ELSE [] END AS labels FROM c),
    a AS (SELECT doc_id, ordinal // 7 AS asset, CASE ordinal // 7 % 4 WHEN 0 THEN 'page_image' WHEN 1 THEN 'table_image' ELSE 'picture' END AS kind,
        CASE WHEN ordinal % 3 = 0 THEN 't' || ordinal WHEN ordinal % 3 = 1 THEN 'p' || ordinal END AS ref, CASE WHEN ordinal % 2 = 0 THEN 't' || (ordinal // 5 * 5) END AS parent,
        CASE WHEN ordinal % 5 = 0 THEN ['t' || (ordinal + 1)] ELSE [] END AS captions, ordinal * 2 + 1 AS position, [ordinal // 10] AS surfaces,
        CASE WHEN length(content) % 3 = 0 THEN ['figure:' || (length(content) % 9)] ELSE [] END AS labels FROM c WHERE ordinal % 7 = 0)"""


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as chunks on pages of ten, and every seventh line's asset, of three kinds, some with a ref, parent, caption or label."""
    c = line_chunks(table(spark, sf_dir, "documents"))
    n, long, none = F.col("ordinal"), F.length("content"), F.expr("cast(array() as array<string>)")
    item = lambda x: F.concat(F.lit("t"), x.cast("string"))
    figure = lambda x: F.concat(F.lit("figure:"), x.cast("string"))
    page, third = F.expr("ordinal div 10"), n % 3
    chunks = c.select(
        "doc_id", n.alias("chunk"), F.array(item(n)).alias("refs"), F.array(n * 2).alias("positions"), F.when(n % 10 == 9, F.array(page, page + 1)).otherwise(F.array(page)).alias("surfaces"),
        F.when(long % 4 == 0, F.array(figure(long % 9), figure(n % 5))).otherwise(none).alias("labels"),
    )
    number = F.expr("ordinal div 7")
    assets_ = c.where(n % 7 == 0).select(
        "doc_id", number.alias("asset"), F.when(number % 4 == 0, "page_image").when(number % 4 == 1, "table_image").otherwise("picture").alias("kind"),
        F.when(third == 0, item(n)).when(third == 1, F.concat(F.lit("p"), n.cast("string"))).alias("ref"), F.when(n % 2 == 0, item(F.expr("ordinal div 5 * 5"))).alias("parent"),
        F.when(n % 5 == 0, F.array(item(n + 1))).otherwise(none).alias("captions"), (n * 2 + 1).alias("position"), F.array(page).alias("surfaces"),
        F.when(long % 3 == 0, F.array(figure(long % 9))).otherwise(none).alias("labels"),
    )
    return chunks, assets_


@query(
    f"""WITH {_ASSETS_SQL}, p AS (
        SELECT doc_id, chunk, asset, list_min(a.labels) AS own, list_min(list_intersect(ch.labels, a.labels)) AS shared, CASE
            WHEN kind = 'page_image' THEN CASE WHEN list_has_any(ch.surfaces, a.surfaces) THEN 0 END
            WHEN ref IS NULL THEN NULL
            WHEN kind = 'table_image' AND list_contains(refs, ref) THEN 1 WHEN list_has_any(refs, captions) THEN 2 WHEN list_contains(refs, ref) THEN 3
            WHEN parent IS NOT NULL AND list_contains(refs, parent) THEN 4 WHEN list_has_any(ch.labels, a.labels) THEN 5
            WHEN NOT list_has_any(ch.surfaces, a.surfaces) THEN NULL
            WHEN position IN (list_min(positions) - 1, list_max(positions) + 1) THEN 6 ELSE 7 END AS rule
        FROM ch JOIN a USING (doc_id))
    SELECT doc_id, chunk, asset, ['ocr_of', 'table_of', 'caption_of', 'inline_figure', 'inline_figure', 'explicit_figure_reference', 'spatial_neighbor', 'same_page'][rule + 1] AS relation_type,
        ['page_ocr', 'table_identity', 'caption_ref', 'item_ref', 'parent_ref', 'author_reference', 'surface_neighbour', 'surface_co_location'][rule + 1] AS provenance,
        CASE rule WHEN 6 THEN 500000 WHEN 7 THEN 250000 ELSE 1000000 END AS confidence_micros, CASE WHEN rule BETWEEN 1 AND 4 THEN own WHEN rule = 5 THEN shared END AS figure_label,
        (row_number() OVER (PARTITION BY doc_id ORDER BY chunk, asset) - 1)::INTEGER AS ordinal
    FROM p WHERE rule IS NOT NULL"""
)
def chunk_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of chunks and assets by the first of eight rules."""
    return assets.related(*_placed(spark, sf_dir))


@query()
def composite_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's labelled sections, cut to 40 and 20 tokens."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.composite([("Text", F.col("text"), 40), ("Source", F.col("source"), 20)]).alias("text"))


@query()
def fair_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each source's documents taken in turn under 96,000 characters a language."""
    d = table(spark, sf_dir, "documents")
    lang = F.pmod(F.crc32("lang"), F.lit(1000))
    units = d.select(lang.alias("query_id"), F.pmod(F.crc32("source"), F.lit(100_000)).alias("group_id"), F.col("doc_id").alias("unit"), F.col("doc_id").alias("chunk_id"), F.length("text").cast("long").alias("chars"), F.lit(False).alias("sent"))
    return selection.fair_shares(units.where("chars is not null"))


@query()
def rerank_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every document beside its first line as the query; those with bars are tables."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.instr("text", "|").cast("boolean").alias("is_table"), F.substring_index("text", "\n", 1).alias("asked"))
    room = windows.body_room(token_count(F.col("asked")), F.lit(0), F.lit(1))
    cut = d.select("doc_id", "text", F.posexplode(windows.rerank_windows(F.col("text"), room, F.col("is_table"))).alias("window", "w"))
    return cut.select("doc_id", "window", "w.start", "w.end", "w.tokens", "w.header", F.md5(windows.window_text(F.col("text"), F.col("w"))).alias("text_md5"))


@query(
    """WITH w AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE length(text) > 0)
    SELECT doc_id, sum(strlen(c))::BIGINT AS bytes, md5(string_agg(c, '' ORDER BY i)) AS text_md5, true AS fits FROM w GROUP BY 1"""
)
def byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2,048 bytes, joined again."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    pieces = F.transform(windows.byte_windows(F.col("text")), lambda w: F.substring(F.col("text"), w["start"] + 1, w["end"] - w["start"]))
    cut = d.select("doc_id", pieces.alias("pieces"))
    sizes = F.transform("pieces", lambda p: F.octet_length(p))
    return cut.select("doc_id", F.aggregate(sizes, F.lit(0), lambda s, x: s + x).cast("long").alias("bytes"), F.md5(F.array_join("pieces", "")).alias("text_md5"), (F.array_max(sizes) <= windows.MAX_BYTES).alias("fits"))
