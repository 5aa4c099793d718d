"""Anchors of op3 are spread evenly over the ranges of their keys."""

import numpy as np

from evalspark.llm import exchange as X
from evalspark.llm import suffix_dedup as S


def test_anchors_fill_all_shards_alike():
    r = np.random.default_rng(5)
    texts = [r.integers(97, 123, 4000, dtype=np.uint8).tobytes() for _ in range(100)]
    a = S.Anchors(texts)
    shard, first = X._bounds(np.sort(a.key), 64)
    n = np.diff(np.append(first, len(a.key)))
    assert len(shard) == 64 and n.max() < 1.5 * len(a.key) / 64      # by the bits they are chosen by: a third in the first shard
    # every string of LENGTH bytes still holds an anchor, and equal ones at equal places
    gaps = [np.diff(np.concatenate([[a.offs[i]], a.at[(a.at >= a.offs[i]) & (a.at < a.offs[i + 1])]])) for i in range(len(texts))]
    assert max(g.max() for g in gaps) <= S.LENGTH - S.GRAM + 1
    one, two = S.Anchors([texts[0]]), S.Anchors([b"xyz" * 30 + texts[0]])
    inside = one.at[(one.at >= S.LENGTH) & (one.at < 3900)]
    assert np.isin(inside + 90, two.at).all()
