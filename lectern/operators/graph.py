"""Paths of one to three hops over typed relations: grounding, enumeration, ranking, and the chunks that support them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import values as vl
from lectern.operators.scope import best_row
from lectern.sources.steps import stored

# Bounds of a search.
MAX_HOPS, MAX_SEEDS, MAX_PATHS = 3, 8, 20
# What questions about chains of relations say.
CHAIN_MARKERS = ("最终", "通过", "经由", "间接", "依赖链", "关系链", "起源于", "through", "ultimately", "originated")
RELATION_MARKERS = (
    "托管", "支持", "负责", "依赖", "建立在", "采用", "许可证", "仓库", "文档", "属于",
    "host", "support", "depend", "built on", "license", "repository", "documentation", "belong",
)


def grounded(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity, place): entities one of whose surface variants is in the normalised query (G1), by its place.

    ``queries``: (query_id, surface); ``entities``: (entity, variants). Variants of two characters or more.
    """
    known = entities.select("entity", F.explode("variants").alias("variant")).where(F.length("variant") >= 2)
    # variants meet queries by their first two characters, so this is an equi-join and not a scan of all pairs
    grams = queries.select("query_id", "surface", F.explode(F.sequence(F.lit(1), F.length("surface") - 1)).alias("place")).where(F.length("surface") >= 2)
    met = grams.withColumn("head", F.expr("substring(surface, place, 2)")).join(known.withColumn("head", F.substring("variant", 1, 2)), "head")
    hit = met.where(F.expr("substring(surface, place, length(variant)) = variant"))
    return hit.groupBy("query_id", "entity").agg(F.min("place").alias("place"))


def merged_edges(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists of edges (edge_id, source, target, rank): the first list wins, then ranks anew (SO2, G2)."""
    both = first.withColumn("lane", F.lit(0)).unionByName(second.withColumn("lane", F.lit(1)))
    one = best_row(both, ["query_id", "edge_id"], "lane", "rank")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("lane", "rank", "edge_id"))).drop("lane")


# Seeds that are centres, and how far a centre reaches.
MAX_CENTRES, REACH = 3, 3


def distances(centres: DataFrame, edges: DataFrame, reach: int) -> DataFrame:
    """(query_id, seed, node, distance): nodes up to ``reach`` steps from each centre, each once, at its least distance.

    A breadth-first search: each step joins the last frontier with the edges of its nodes and leaves out what was visited, so
    work follows nodes and not paths. Frontiers are stored, so no step runs twice.
    """
    steps = doubled(edges).select(F.col("from_node").alias("node"), "to_node")
    visited = stored(centres.select("query_id", "seed", F.col("seed").alias("node"), F.lit(0).alias("distance")).distinct(), "frontier-0")
    frontier = visited
    for n in range(1, reach + 1):
        met = frontier.select("query_id", "seed", "node").join(steps, "node").select("query_id", "seed", F.col("to_node").alias("node")).distinct()
        new = met.join(visited.select("query_id", "seed", "node"), ["query_id", "seed", "node"], "left_anti")
        frontier = stored(new.select("query_id", "seed", "node", F.lit(n).alias("distance")), f"frontier-{n}")
        visited = visited.unionByName(frontier)
    return visited


def centred_edges(seeds: DataFrame, edges: DataFrame, limit: int, reach: int = REACH) -> DataFrame:
    """(query_id, edge_id, source, target, rank): edges near a query's first three seeds.

    ``seeds``: query_id, seed, place. Each centre gives its ``limit`` nearest edges, by the distance of the nearer end, then
    their own rank; of several centres the first one's list wins, and ``limit`` edges stay.
    """
    centres = seeds.where(F.col("place") <= MAX_CENTRES)
    near = distances(centres, edges, reach - 1)
    ends = edges.select("edge_id", "source", "target", "rank", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    met = near.join(ends, "node").groupBy("query_id", "seed", "edge_id", "source", "target", "rank").agg(F.min("distance").alias("distance"))
    nth = F.row_number().over(Window.partitionBy("query_id", "seed").orderBy("distance", "rank", "edge_id"))
    some = met.withColumn("nth", nth).where(F.col("nth") <= limit).join(centres.select("query_id", "seed", "place"), ["query_id", "seed"])
    one = best_row(some, ["query_id", "edge_id"], "place", "nth")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "nth")))
    return ranked.where(F.col("rank") <= limit).select("query_id", "edge_id", "source", "target", "rank")


def doubled(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, self-loops dropped (J17): from_node, to_node, edge_id, rank, reversed."""
    rows = edges.where("source <> target")
    out = rows.select(F.col("source").alias("from_node"), F.col("target").alias("to_node"), "edge_id", "rank", F.lit(0).alias("reversed"))
    return out.unionByName(rows.select(F.col("target").alias("from_node"), F.col("source").alias("to_node"), "edge_id", "rank", F.lit(1).alias("reversed")))


def paths(seeds: DataFrame, edges: DataFrame, limit: int | None = None, hops: int = MAX_HOPS) -> DataFrame:
    """Simple undirected paths from seeds (query_id, entry) (G3): no node and no edge twice.

    One equi-join a hop. With ``limit``, each seed keeps its first max(16 * limit, 64) paths in depth-first order, which
    is the order of the arrays of edge ranks, a path before its extensions.
    """
    step = doubled(edges)
    now = seeds.select("query_id", "entry", F.col("entry").alias("node"), F.array("entry").alias("nodes"), F.expr("cast(array() as array<string>)").alias("edges"), F.expr("cast(array() as array<long>)").alias("ranks"), F.lit(0).alias("reversals"))
    out = None
    for _ in range(hops):
        grown = now.join(step.withColumnRenamed("from_node", "node"), "node").where(~F.array_contains("nodes", F.col("to_node")) & ~F.array_contains("edges", F.col("edge_id").cast("string")))
        now = grown.select(
            "query_id", "entry", F.col("to_node").alias("node"), F.array_append("nodes", F.col("to_node")).alias("nodes"),
            F.array_append("edges", F.col("edge_id").cast("string")).alias("edges"), F.array_append("ranks", F.col("rank").cast("long")).alias("ranks"),
            (F.col("reversals") + F.col("reversed")).alias("reversals"),
        )
        out = now if out is None else out.unionByName(now)
    found = out.withColumn("hops", F.size("edges")).withColumn("path_id", vl.sha(F.col("entry").cast("string"), F.array_join("edges", ":"))).drop("node")
    if limit is not None:
        order = Window.partitionBy("query_id", "entry").orderBy("ranks", "edges")
        found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(16 * limit, 64)).drop("nth")
    return found


def chain_question(query: Column) -> Column:
    """A marker of chains, or two markers of relations."""
    folded = F.lower(query)
    count = lambda words: sum((F.instr(folded, w) > 0).cast("int") for w in words)
    return (count(CHAIN_MARKERS) > 0) | (count(RELATION_MARKERS) >= 2)


def ranked_paths(found: DataFrame, k: int = MAX_PATHS) -> DataFrame:
    """The ``k`` paths shown for a query (G4): one for each seed first, then other first edges, then the rest.

    ``found`` also has ``seed`` (the entry was grounded), ``seed_place``, ``chain`` (long paths first) and ``explicit`` (the
    question names a chain itself). A seed's place goes to its first path by the full key for explicit chains, else to its
    cheapest direct fact. ``seed_place`` counts the seeds that were found from 1, also those without a path: only the first
    eight have places. Entries that aren't grounded have places only where the query has no grounded one.
    """
    query = Window.partitionBy("query_id")
    depth = F.when(F.col("chain"), -F.col("hops")).otherwise(F.col("hops"))
    keyed = found.withColumn("k", F.struct(F.when(F.col("seed"), 0).otherwise(1).alias("a"), depth.alias("b"), F.array_max("ranks").alias("c"), F.aggregate("ranks", F.lit(0).cast("long"), lambda s, x: s + x).alias("d"), F.col("reversals").alias("e"), F.col("path_id").alias("f")))
    cheapest = F.struct(F.col("hops"), F.col("k.c"), F.col("k.d"), F.col("path_id"))
    entry = Window.partitionBy("query_id", "entry")
    first = F.row_number().over(entry.orderBy(F.when(F.col("explicit"), F.col("k")), F.when(~F.col("explicit"), cheapest))) == 1
    rows = keyed.withColumns({"grounded_": F.max("seed").over(query), "first_": first, "entry_k_": F.min("k").over(entry)})
    places = F.when(F.col("grounded_"), F.struct(F.col("seed_place").cast("long").alias("p"), F.lit(None).cast(keyed.schema["k"].dataType).alias("k"))).otherwise(
        F.struct(F.lit(0).cast("long").alias("p"), F.col("entry_k_").alias("k"))
    )
    rows = rows.withColumn("place_", places)
    bounded = ~F.col("grounded_") | (F.col("seed") & (F.col("seed_place") <= MAX_SEEDS))
    rows = rows.withColumn("reserved", F.col("first_") & bounded)
    nth = F.row_number().over(Window.partitionBy("query_id", F.element_at("edges", 1), "reserved").orderBy("k"))
    rows = rows.withColumn("tier", F.when(F.col("reserved"), 0).when(nth == 1, 1).otherwise(2))
    order = query.orderBy("tier", F.when(F.col("tier") == 0, F.col("place_")), "k")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("k", "reserved", "grounded_", "first_", "entry_k_", "place_")


def best_supports(supports: DataFrame, key: str = "edge_id") -> DataFrame:
    """(key, chunk_id): the best chunk of each edge, or of each key that edges share.

    ``supports``: key, chunk_id, mentions (endpoints named), holds_fact, overlap, ordinal.
    """
    return supports.groupBy(key).agg(F.max_by("chunk_id", F.struct("mentions", "holds_fact", "overlap", -F.col("ordinal"), -F.col("chunk_id"))).alias("chunk_id"))


def hydrated(found: DataFrame, best: DataFrame, most: int = MAX_PATHS) -> DataFrame:
    """Paths with their best chunk a hop (G6, J18), ``most`` a query by ``rank``; a path is dropped if a hop has no chunk.

    ``best``: edge_id (string), chunk_id, an edge once, as of ``best_supports``.
    """
    hops = found.select("query_id", "path_id", "rank", F.size("edges").alias("hops"), F.posexplode("edges").alias("hop", "edge_id"))
    met = hops.join(best, "edge_id").groupBy("query_id", "path_id", "rank", "hops").agg(F.transform(F.sort_array(F.collect_list(F.struct("hop", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))
    whole = met.where(F.size("chunks") == F.col("hops"))
    return whole.withColumn("n_", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("n_") <= most).drop("n_")


def adjacent_edges(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Edges with an end among ``nodes`` (node), in order."""
    one = edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").select(*edges.columns)
    two = edges.join(nodes.select(F.col("node").alias("target")), "target", "left_semi").select(*edges.columns)
    return one.unionByName(two).distinct().orderBy("rank", "edge_id").limit(most)


def hop_histogram(found: DataFrame) -> DataFrame:
    """One row: paths of one, two and three hops (AG13)."""
    return found.agg(*[F.count_if(F.col("hops") == n).alias(f"hops_{n}") for n in (1, 2, 3)])


def build_gates(edges: DataFrame, types: DataFrame, aliases: DataFrame, episodes: DataFrame, expected_episodes: int) -> DataFrame:
    """(gate, violations) of a graph build (G7, G8): self-loops, unknown types, aliases without an edge, episode count."""
    rows = edges.where("source = target").agg(F.lit("self_loop").alias("gate"), F.count("*").alias("violations"))
    rows = rows.unionByName(edges.join(types.select("type"), "type", "left_anti").agg(F.lit("unknown_type"), F.count("*")).toDF("gate", "violations"))
    ends = edges.select(F.col("source").alias("entity")).unionByName(edges.select(F.col("target").alias("entity"))).distinct()
    rows = rows.unionByName(aliases.select("entity").join(ends, "entity", "left_anti").agg(F.lit("alias_unconnected"), F.count("*")).toDF("gate", "violations"))
    return rows.unionByName(episodes.agg(F.lit("episode_count"), F.abs(F.count("*") - F.lit(expected_episodes))).toDF("gate", "violations"))
