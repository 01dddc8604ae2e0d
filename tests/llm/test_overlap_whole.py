"""Problem 4: many distances at once, prefixes around the exact length, hot shingles and buckets."""

import random

import numpy as np
import pytest

from folioscope.llm import overlap
from tests.llm.test_llm import lev


def test_many_distances():
    rng = random.Random(9)
    pairs, limits = [], []
    for _ in range(900):
        a, b = ("".join(rng.choice("abcdé\U0001f600") for _ in range(rng.choice((0, 1, 3, 40, 63, 64, 65, 90, 128, 129, 150)) + rng.randint(0, 2))) for _ in range(2))
        if rng.random() < 0.5 and a:
            b = list(a)
            for _ in range(rng.randint(0, 9)):
                b.insert(rng.randrange(len(b) + 1), "x") if rng.random() < 0.5 else b.pop(rng.randrange(len(b))) if b else None
            b = "".join(b)
        pairs.append((a, b))
        limits.append(rng.randint(0, 60))
    assert overlap.edit_distances(pairs, limits) == [min(lev(a, b), k + 1) for (a, b), k in zip(pairs, limits)]
    assert overlap.edit_distances([], []) == []


@pytest.mark.parametrize("length", [20, 24, 25, 399, 402, 403, 404, 500, 1000])
def test_prefixes_do_not_overlap(length):
    rng = np.random.default_rng(length)
    k = length // overlap.SHARE + 1
    chosen = overlap.prefixes(rng.integers(1, 99, (7, length - overlap.Q + 1)).astype(np.float32), k)
    assert (chosen.sum(1) == k).all()
    for row in chosen:
        assert np.diff(np.nonzero(row)[0]).min() >= overlap.Q


def test_layout_splits_hot_shingles():
    counts = np.zeros((2, 1 << overlap.SHINGLE_BITS), np.int64)
    counts[:, :5000] = 40
    counts[:, 7] = 1_000_000, 250_000
    counts[0, 6000] = 99
    layout = overlap.Layout(counts, 40, 100_000)
    assert layout.parts[:, 7].tolist() == [10, 3] and layout.parts[:, 8].tolist() == [1, 1] and not layout.live[6000]
    texts = np.arange(500, dtype=np.uint64)
    seen = [set(), set()]
    for side in (0, 1):
        at, unit = layout.units(np.full(500, 7), texts, side)
        assert len(at) == 500 * layout.parts[1 - side, 7]
        for a, u in zip(at.tolist(), unit.tolist()):
            seen[side].add((a, u))
    for t in range(0, 500, 37):
        mine = {u for a, u in seen[0] if a == t}
        for e in range(0, 500, 41):
            assert len(mine & {u for a, u in seen[1] if a == e}) == 1
    hot = layout.bucket[layout.first[7] : layout.first[8]]
    assert len(set(hot.tolist())) == 30


def test_texts_around_the_exact_length(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("aeioustrnlmp ") for _ in range(n))
    lines = []
    for i, n in enumerate((20, 21, 250, 395, 400, 403, 404, 410, 900, 3000)):
        t = word(n)
        near = list(t)
        for _ in range(n // 5):
            near[rng.randrange(len(near))] = "z"
        lines += [(2 * i, 1, "train", t, "s"), (2 * i + 1, 1, "val", "".join(near), "s")]
    df = spark.createDataFrame(lines, "line_id bigint, manifest_id bigint, split string, text string, source string")
    manifest = spark.createDataFrame([(1, {"train": 9, "val": 1})], "manifest_id bigint, splits map<string,int>")
    for buckets, part in ((None, overlap.PART_POSTINGS), (7, 2)):
        got = {(r.train_id, r.eval_id) for r in overlap.find_overlaps(df, manifest, buckets, part).collect()}
        assert got == {(2 * i, 2 * i + 1) for i in range(10)}
