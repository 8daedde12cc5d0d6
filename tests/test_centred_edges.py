"""Edges near seeds against a plain breadth-first search."""

import random
from collections import deque

from lectern.operators import graph


def plain(seeds, edges, limit, reach):
    out = []
    for q in sorted({s[0] for s in seeds}):
        merged = []
        for _, seed, place in sorted((s for s in seeds if s[0] == q), key=lambda s: s[2]):
            if place > 3:
                continue
            apart, todo = {seed: 0}, deque([seed])
            while todo:
                n = todo.popleft()
                for _, a, b, _ in edges:
                    for x, y in ((a, b), (b, a)):
                        if x == n and y not in apart and apart[n] + 1 < reach:
                            apart[y] = apart[n] + 1
                            todo.append(y)
            met = sorted((min(apart[x] for x in (a, b) if x in apart), rank, i) for i, a, b, rank in edges if a in apart or b in apart)
            merged += [i for _, _, i in met[:limit] if i not in merged]
        out += [(q, i, n + 1) for n, i in enumerate(merged[:limit])]
    return out


def test_against_a_plain_search(spark):
    rng = random.Random(9)
    nodes = [f"n{i}" for i in range(30)]
    edges = [(i, rng.choice(nodes), rng.choice(nodes), rng.randint(1, 9)) for i in range(45)]
    edges += [(100 + i, "hub", n, 5) for i, n in enumerate(nodes[:12])]
    seeds = [(q, s, place) for q in range(4) for place, s in enumerate(rng.sample([*nodes, "hub", "nowhere"], 5), 1)]
    e = spark.createDataFrame(edges, "edge_id long, source string, target string, rank long").repartition(3)
    s = spark.createDataFrame(seeds, "query_id long, seed string, place int")
    for limit, reach in ((7, 3), (50, 2)):
        found = sorted((r.query_id, r.edge_id, r.rank) for r in graph.centred_edges(s, e, limit, reach).collect())
        assert found == sorted(plain(seeds, edges, limit, reach))


def test_the_first_list_wins(spark):
    one = spark.createDataFrame([(1, 5, "a", "b", 1), (1, 6, "b", "c", 2)], "query_id long, edge_id long, source string, target string, rank long")
    two = spark.createDataFrame([(1, 6, "b", "c", 1), (1, 7, "c", "d", 2)], one.schema)
    assert [(r.edge_id, r.rank) for r in graph.merged_edges(one, two).orderBy("rank").collect()] == [(5, 1), (6, 2), (7, 3)]
