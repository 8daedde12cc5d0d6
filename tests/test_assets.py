"""Relations by joins against looking at every pair."""

import random

from lectern.operators import assets


def rule(c, a):
    refs, surfaces = set(c["refs"]), set(c["surfaces"]) & set(a["surfaces"])
    if a["kind"] == "page_image":
        return ("ocr_of", None) if surfaces else None
    if a["ref"] is None:
        return None
    own = min(a["labels"], default=None)
    if a["kind"] == "table_image" and a["ref"] in refs:
        return "table_of", own
    if refs & set(a["captions"]):
        return "caption_of", own
    if a["ref"] in refs or a["parent"] in refs:
        return "inline_figure", own
    if shared := set(c["labels"]) & set(a["labels"]):
        return "explicit_figure_reference", min(shared)
    if not surfaces:
        return None
    if c["positions"] and a["position"] in (min(c["positions"]) - 1, max(c["positions"]) + 1):
        return "spatial_neighbor", None
    return "same_page", None


def test_against_every_pair(spark):
    rng = random.Random(8)
    some = lambda of, k: [rng.choice(of) for _ in range(rng.randint(0, k))]
    refs, labels = [f"r{i}" for i in range(12)], [f"figure:{i}" for i in range(6)]
    chunks = [{"doc_id": d, "chunk": i, "refs": some(refs, 3), "positions": some(range(12), 2), "surfaces": some(range(4), 2), "labels": some(labels, 2)} for d in range(6) for i in range(12)]
    made = [
        {"doc_id": d, "asset": i, "kind": rng.choice(["page_image", "table_image", "picture"]), "ref": rng.choice([*refs, None]), "parent": rng.choice([*refs, None]), "captions": some(refs, 2),
         "position": rng.choice([*range(12), None]), "surfaces": some(range(4), 2), "labels": some(labels, 2)}
        for d in range(6) for i in range(8)
    ]
    schema = "doc_id long, chunk long, refs array<string>, positions array<int>, surfaces array<int>, labels array<string>"
    kinds = "doc_id long, asset long, kind string, ref string, parent string, captions array<string>, position int, surfaces array<int>, labels array<string>"
    found = assets.related(spark.createDataFrame(chunks, schema), spark.createDataFrame(made, kinds))
    got = {(r.doc_id, r.chunk, r.asset): (r.relation_type, r.figure_label) for r in found.collect()}
    want = {(c["doc_id"], c["chunk"], a["asset"]): x for c in chunks for a in made if c["doc_id"] == a["doc_id"] and (x := rule(c, a))}
    assert got == want and {x[0] for x in want.values()} == {r[0] for r in assets.RULES}
    over = {r.doc_id: r.limit_name for r in assets.beyond_limits(found, 4, 10_000).collect()}
    most = {d: max(sum(1 for k in want if k[:2] == (d, c)) for c in range(12)) for d in range(6)}
    assert over == {d: "max_relations_per_chunk" for d, n in most.items() if n > 4}
