"""Problem 4: blocks of texts meet without a shuffle of copies, and find what brute force finds."""

import random

import numpy as np
import pytest

from folioscope.llm import overlap
from tests.llm.test_llm import lev

MANIFEST = "manifest_id bigint, splits map<string,int>"
LINES = "line_id bigint, manifest_id bigint, split string, text string, source string"


def shuffled(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm, gateway = sc._jvm, sc._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def lines(n, seed, share=0.2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioustrnlmpã⁊") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    out = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(3, 12)))
        if out and rng.random() < share:
            t = list(rng.choice(out)[3])
            for _ in range(rng.randint(0, max(1, len(t) // 4))):
                p = rng.randrange(len(t) + 1)
                t[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "\U0001f600"])
            t = "".join(t)
        out.append((i, 1, rng.choice(["train", "train", "train", "val"]), t, "s"))
    return out


def test_shuffle_does_not_grow_with_blocks(spark):
    own = lines(6000, 1, share=0)
    size = sum(len(t.encode()) for *_, t, _ in own)
    df, manifest = spark.createDataFrame(own, LINES).repartition(4).cache(), spark.createDataFrame([(1, {"train": 9, "val": 1})], MANIFEST)
    df.count()
    for buckets in (12, 60):
        before = shuffled(spark)
        overlap.find_overlaps(df, manifest, buckets).count()
        assert shuffled(spark) - before < 4 * size
    df.unpersist()


@pytest.mark.parametrize("block", [700, 5000])
def test_blocks_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "BLOCK_POSTINGS", block)
    own = lines(260, block)
    own += [(i + 1000, *r) for i, *r in own[:40]] + own[:25]
    df, manifest = spark.createDataFrame(own, LINES).repartition(3), spark.createDataFrame([(1, {"train": 9, "val": 1})], MANIFEST)
    want = {(e[0], t[0], d) for e in own if e[2] == "val" and len(e[3]) >= 20 for t in own if t[2] == "train" and len(t[3]) >= 20 and abs(len(e[3]) - len(t[3])) <= max(len(e[3]), len(t[3])) // 5 for d in [lev(e[3], t[3])] if d <= max(len(e[3]), len(t[3])) // 5}
    got = [(r.eval_id, r.train_id, r.distance) for r in overlap.find_overlaps(df, manifest).collect()]
    assert len(want) > 10 and sorted(got) == sorted(want)


def test_keys_that_do_not_fit_are_sorted_too():
    rng = np.random.default_rng(5)
    for top in (1000, 1 << 62):
        key = rng.integers(0, top, 5000)
        ordered, order = overlap._ordered(key)
        assert (ordered == np.sort(key)).all() and (key[order] == ordered).all()


def test_signature_bounds_hold():
    rng = random.Random(3)
    for n in (20, 60, 300, 2000):
        a = "".join(rng.choice("aeioust ") for _ in range(n))
        b = list(a)
        for _ in range(n // 5):
            b[rng.randrange(n)] = rng.choice("aeioust ")
        d = overlap.edit_distance(a, "".join(b), n)
        x, y = (overlap.code_points([t]) for t in (a, "".join(b)))
        for q in (2, 3):
            s, t = (overlap.signatures(z, q) for z in (x, y))
            assert overlap.lost_runs(s, t)[0] <= q * d and overlap.lost_runs(s, t)[0] == np.bitwise_count(s & ~t).sum()
            assert overlap.lost_runs(s[:, :4] | s[:, 4:], t[:, :4] | t[:, 4:])[0] <= q * d
