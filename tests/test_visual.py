"""Pictures beside evidence against a plain loop."""

import random

import pytest

from lectern.operators import visual

FAR = 2**31


def priority(weight, text, cross):
    return weight + (1_000_000 // (60 + text) if text else 0) + (1_000_000 // (60 + cross) if cross else 0) + (250_000 if text is not None and cross is not None else 0)


def plain(evidence, visuals, most):
    out = []
    for q in sorted({e["query_id"] for e in evidence}):
        rows = []
        for e in sorted((e for e in evidence if e["query_id"] == q), key=lambda e: e["rank"]):
            for v in sorted((v for v in visuals if v["query_id"] == q and v["rank"] == e["rank"]), key=lambda v: v["nth"]):
                strong, explicit = v["relation_type"] in visual.STRONG, v["relation_type"] == "explicit_figure_reference"
                text, cross = v["text_rank"] or e["text_rank"], v["cross_rank"]
                why, weight = ("selected_explicit_reference", 4_000_000) if explicit else ("selected_dual_lane", 3_250_000) if cross is not None else ("selected_strong_relation", 3_000_000)
                bar = "rejected_parent_not_admitted" if not e["usable"] else None if strong else "rejected_weak_relation"
                rows.append((v, (e["version"], v["group_key"]), bar, bar is None and (explicit or cross is not None or e["rank"] == 1), why, priority(weight, text, cross), text, cross, (e["rank"], v["nth"])))
            if e["modality"] in ("image", "table") and e["asset_id"] is not None:
                dual = e["text_rank"] is not None and e["cross_rank"] is not None
                group = (e["version"], e["group_key"] or str(e["unit"]))
                rows.append((e, group, None if e["usable"] else "rejected_low_similarity", e["usable"], "selected_dual_lane" if dual else "selected_image_only", priority(2_000_000 if dual else 1_000_000, e["text_rank"], e["cross_rank"]), e["text_rank"], e["cross_rank"], (e["rank"], 99)))
        picks, marks = {}, set()
        for v, group, _, competes, why, p, text, cross, at in sorted(rows, key=lambda r: (-r[5], r[6] or FAR, r[7] or FAR, r[0]["unit"], r[0]["asset_id"], r[8])):
            own = {("asset", v["asset_id"]), ("file", v["checksum"]), ("group", group)}
            if competes and not own & marks and len(picks) < 4:
                marks |= own
                picks[v["asset_id"]] = (len(picks), v["unit"], why, p)
        met = set()
        for position, (v, _, bar, *_rest) in enumerate(rows, 1):
            pick = picks.get(v["asset_id"])
            why = bar or ("rejected_duplicate" if pick is None or v["asset_id"] in met else "rejected_visual_budget" if pick[0] >= most else pick[2])
            met.add(v["asset_id"])
            out.append((q, position, v["asset_id"], pick[1] if why.startswith("selected") else v["unit"], why, pick[3] if pick else 0))
    return out


def test_against_a_plain_loop(spark):
    rng = random.Random(11)
    some = lambda *of: rng.choice(of)
    evidence, visuals = [], []
    for q in range(25):
        for rank in range(1, 7):
            evidence.append({"query_id": q, "rank": rank, "unit": 100 * q + rank, "version": rng.randint(1, 3), "modality": some("text", "image", "table"), "asset_id": some(None, 1, 2, 3, 4, 5, 6, 7, 8), "checksum": f"c{rng.randint(1, 9)}", "group_key": some(None, "g1", "g2", "g3"), "text_rank": some(None, rank), "cross_rank": some(None, 1, 2, 3), "usable": rng.random() < 0.8})
            for nth in range(rng.randint(0, 3)):
                visuals.append({"query_id": q, "rank": rank, "nth": nth, "unit": rng.randint(5000, 9000), "asset_id": rng.randint(1, 12), "checksum": f"c{rng.randint(1, 12)}", "relation_type": some(*visual.STRONG, "spatial_neighbor", "same_page"), "group_key": f"g{rng.randint(1, 6)}", "text_rank": some(None, 0, 4), "cross_rank": some(None, None, 2)})
    e = spark.createDataFrame(evidence, "query_id long, rank int, unit long, version long, modality string, asset_id long, checksum string, group_key string, text_rank int, cross_rank int, usable boolean")
    v = spark.createDataFrame(visuals, "query_id long, rank int, nth int, unit long, asset_id long, checksum string, relation_type string, group_key string, text_rank int, cross_rank int")
    want = plain(evidence, visuals, 2)
    assert sorted(map(tuple, visual.visual_decisions(visual.visual_rows(e, v), 2).collect())) == sorted(want)
    assert len({w[4] for w in want}) == 9  # all reasons occur
    with pytest.raises(ValueError):
        visual.visual_decisions(visual.visual_rows(e, v), 5)
