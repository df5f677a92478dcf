"""Windows of op9, without Spark."""

import sys

import numpy as np
import pyarrow as pa

from lumenveil.llm import decontaminate


def test_op9_candidates_are_counted_together():
    """Candidates whose surroundings may hold enough of an item's words, against a plain count; no Python call for each of them."""
    rng, config = np.random.default_rng(2), decontaminate.Retrieval()
    vocab = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocab, n))) for k, n in enumerate([12, 20, 40, 59, 8, 30, 6])]
    index = decontaminate.Index(items, np.zeros(0, np.uint64), rng.standard_normal((config.buckets, config.rank)).astype(np.float32), config)
    text = " ".join(rng.choice([*vocab, *[f"other{i}" for i in range(120)]], 3000))
    (h,) = decontaminate.hashes(pa.array([text]))
    first = np.tile(np.arange(-5, 2990, 3), len(items))
    item = np.repeat(np.arange(len(items)), len(first) // len(items))
    length = rng.choice([8, 20, 36, 56], len(first))
    want = []
    for i, (k, f, n) in enumerate(zip(item.tolist(), first.tolist(), length.tolist(), strict=True)):
        own = set(index.hashes[k].tolist())
        near = [x for x in h[max(0, max(0, f) - n // 2) : max(0, f) + len(index.hashes[k]) + n].tolist() if x in own]
        if near and len(set(near)) + len(index.hashes[k]) - len(own) >= index.least(k) and len(near) >= index.least(k):
            want.append(i)
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        got = index.holding(h, item, first, length)
    finally:
        sys.setprofile(None)
    got = set(got.tolist())
    assert 50 < len(want) < len(first) and got >= set(want)
    # What goes beyond it holds enough distinct words if repeated ones of the item are taken to be there.
    assert len(got) <= 1.25 * len(want) and len(calls) < 100, (len(got), len(want), len(calls))
    assert len(index.holding(h[:0], item[:0], first[:0], length[:0])) == 0
