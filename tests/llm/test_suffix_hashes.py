"""Hashes of tiles that share their anchor."""

import numpy as np

from tastewright.llm import suffixes


def test_bodies_of_one_anchor_differ():
    """400,000 different strings around one anchor: 32 bits would take about 19 pairs for equal."""
    rng = np.random.default_rng(4)
    tried = rng.integers(0, 256, 1 << 20, np.uint8)
    least = int(suffixes._grams(tried)[: len(tried) - 24].argmin())
    n = 400_000
    data = rng.integers(0, 256, (n, suffixes.SPAN), np.uint8)
    data[:, 17:33] = tried[least : least + suffixes.GRAM]
    tiles = suffixes.Tiles(np.r_[data.ravel(), np.zeros(64, np.uint8)], np.arange(n + 1) * suffixes.SPAN, np.arange(n), np.ones(n, bool))
    assert len(tiles.anchor) == n and all(np.unique(x, return_counts=True)[1].max() > 0.99 * n for x in tiles.entries.leading)
    assert len(tiles.entries.body) == n and not tiles.entries.later.any()


def test_leading_words_are_the_anchor_bytes():
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog again and again, until it is dark" * 3, np.uint8)
    padded = np.r_[data, np.zeros(64, np.uint8)]
    tiles = suffixes.Tiles(padded, np.array([0, len(data)]), np.array([5]), np.array([True]))
    order = np.lexsort(tiles.entries.leading[::-1])
    assert (order == np.arange(len(order))).all()  # sent in byte order
    own = {bytes(data[a : a + 16]) for a in tiles.anchor}
    words = zip(*(x.tolist() for x in tiles.entries.leading))
    assert {a.to_bytes(8, "big") + b.to_bytes(8, "big") for a, b in words} == own


def test_multikey_order_is_the_lexical_order():
    rng = np.random.default_rng(3)
    for kinds in (2, 5, 1 << 40):
        words = [rng.integers(0, kinds, 3000, np.int64).astype(t) for t in (np.uint64, np.uint64, np.int64)]
        assert (suffixes.multikey_order(*words) == np.lexsort(words[::-1])).all()
    assert len(suffixes.multikey_order(np.zeros(0, np.uint64), np.zeros(0, np.uint64))) == 0
