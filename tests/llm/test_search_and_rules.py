import random

import numpy as np
import pytest

from lectern.llm import curve_search, url_filter

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (2, 1), (4, 2)])
def test_hilbert_curve_visits_neighbouring_cells(dimensions, bits):
    side = 1 << bits
    cells = np.array(np.meshgrid(*[np.arange(side)] * dimensions)).reshape(dimensions, -1).T
    keys = curve_search.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(side**dimensions))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted(((-float(np.cumsum(np.array(v) * np.array(w))[-1]), i) for i, w in rows if i != q))
        best = {}
        for s, i in scored:
            best.setdefault(i, s)
        out[q] = [(i, -s) for i, s in sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]]
    return out


def test_recall_on_vectors_with_structure(spark, monkeypatch):
    monkeypatch.setattr(curve_search, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    vectors = np.repeat(centres, 50, axis=0) + 0.2 * rng.standard_normal((2000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = curve_search.search(df, lambda i: i % 20 == 0, k=20).collect()
    score = vectors @ vectors.T
    hits = 0
    for q in range(0, 2000, 20):
        order = np.lexsort((np.arange(2000), -score[q]))
        hits += len(set(order[order != q][:20].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert hits / (100 * 20) >= 0.9
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert all([x.rank for x in sorted(v, key=lambda x: (-x.score, x.vec_id))] == list(range(1, 21)) for v in by.values())


def test_copies_and_vectors_that_take_no_part(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(i, same) for i in range(100)] + [(200, [0.5, 0.5, 0.0]), (300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 0.0]), (303, [float("nan"), 1.0, 0.0]), (304, [float("inf"), 0.0, 0.0]), (305, [1.0]), (306, []), (None, same), (40, same)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, v string, point int")
    found = curve_search.search(df, lambda i: i % 20 == 0, k=20)
    expected = brute([r for r in rows[:101]], [(i, v) for i, v in rows[:101] if i % 20 == 0], 20)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == expected
    assert curve_search.search(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = curve_search.search(df.where("vec_id in (100, 200, 20)"), lambda i: i % 20 == 0, k=20).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(20, 200), (200, 20)]


def brute_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_rules_against_brute_force(spark):
    rng = random.Random(8)
    labels, paths = ["a", "b", "net", "org", "x"], ["/", "/a", "/a/", "/a/b/", "/b", "/ab"]
    rules = {}
    for _ in range(60):
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 3)))
        rules[host, rng.choice(paths)] = rng.choice(["block", "allow"])
    rows = []
    for i in range(1500):
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
        url = f"http://{host.upper() if i % 5 == 0 else host}" + "".join(rng.choice(paths) for _ in range(rng.randint(0, 2))) + rng.choice(["", "?q=/a", "#/b"])
        rows.append((i, url))
    rows += [(5000, None), (5001, ""), (5002, "no scheme"), (5003, "http://"), (5004, "http:///a"), (5005, "://NET/a?x"), (5006, "http://net\n/a"), (None, "http://a/"), (7, rows[7][1])]
    rows += [(6000 + i, "http://hot.net/a/" + str(i)) for i in range(500)]  # one host holds much of all
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    listed = spark.createDataFrame([(v, h, p) for (h, p), v in rules.items()], "verdict string, host string, path string")
    got = url_filter.judge(df, listed).collect()
    assert len(got) == len(rows)
    found = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in got}
    for page, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        assert found[page, host, path] == brute_rule(host, path, [(h, p, v) for (h, p), v in rules.items()]), url


def test_rule_edges(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filter.judge(pages, none).collect()] == [(None, "allow")]
    twice = spark.createDataFrame([("allow", "a", "/"), ("block", "A", "/"), (None, "a", "/b")], "verdict string, host string, path string")
    assert [(r.rule, r.verdict) for r in url_filter.judge(pages, twice).collect()] == [("a/", "block")]
    assert url_filter.judge(pages.limit(0), twice).count() == 0
