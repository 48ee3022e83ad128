"""Small sets that share nothing do not meet, and pairs are not left for a second comparison without need."""

import numpy as np
from test_jaccard import by_force, joined, random_rows

from palaver.llm import jaccard


def test_small_sets_without_common_shingles_do_not_meet():
    """Deletion segments with one shingle or none are alike in all sets of a class."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in rng.integers(4, 64, 4000)]
    stats = {}
    for s in sets:
        c = jaccard.band(len(s))
        stats[c] = stats.get(c, (0, 0))[0] + 1, stats.get(c, (0, 0))[1] + len(s)
    plan = jaccard.allocate({c: (n, total / n) for c, (n, total) in stats.items()}, 1.0)
    sketch = np.ones(1 << jaccard.SKETCH_BITS, np.uint32)
    _, n = np.unique(np.concatenate([np.unique(jaccard.signatures(s, sketch, plan)) for s in sets]), return_counts=True)
    assert n.max() <= 10, n.max()


def test_all_pairs_are_handed_on_at_once(spark, monkeypatch):
    calls, compared = [], jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda *a: calls.append(a[-1]) or compared(*a))
    monkeypatch.setattr(jaccard, "MOST_OF_COMPONENTS", 0)
    monkeypatch.setattr(jaccard.links, "__defaults__", (jaccard.PERCENT, 0))
    rows = random_rows(5, 150)
    assert joined(spark, rows) == by_force(rows)[0] and len(calls) == 1
