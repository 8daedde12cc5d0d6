"""The quality classifier learns from 8,000 rows, and each tree from all of them."""

import numpy as np

from lectern.llm import quality_rules_ensemble as quality


def test_trees_grow_on_all_rows_at_every_size(monkeypatch):
    grown, tree = [], quality._tree

    def spy(x, *args):
        grown.append(len(x))
        return tree(x, *args)

    monkeypatch.setattr(quality, "_tree", spy)
    rng = np.random.default_rng(4)
    for n in (400, 1400):
        x = rng.normal(size=(n, len(quality.STATISTICS)))
        quality.fit_rows(x, (x[:, 0] + x[:, 1] > 0).astype(float))
        assert {g for g in grown if g >= n // 2} >= {n} and max(grown) == n
        assert sum(g == n for g in grown) >= quality.TREES
        grown.clear()
    assert quality.SAMPLE_ROWS == 8000
