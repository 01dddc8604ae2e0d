"""Problem 2: numbers that two terms share, many ranges, dictionaries larger than a block."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import terms

WORDS = [a + b + c for a in "bcdf" for b in "aeio" for c in "lmnrst"]


def lines(spark):
    rows = [(i, " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 7)) + " li") for i in range(300)]
    want = Counter(w for _, t in rows for w in t.split()), Counter(w for _, t in rows for w in set(t.split()))
    return spark.createDataFrame(rows, "line_id bigint, text string"), want


@pytest.mark.parametrize("block,size", [(200_000, 2_000_000), (20, 2_000_000), (20, 25)])
def test_ranges_and_blocks(spark, monkeypatch, block, size):
    monkeypatch.setattr(terms, "BLOCK_TERMS", block)
    monkeypatch.setattr(terms, "RANGE_TERMS", size)
    df, (occ, pres) = lines(spark)
    got = terms.term_frequencies(df, "line_id", "text").collect()
    assert {r.term: (r.n_occurrences, r.n_records) for r in got} == {w: (occ[w], pres[w]) for w in occ}
    assert len({r.term_id for r in got}) == len(got) and all(r.n_total == 300 for r in got)


def test_shared_numbers_take_the_next_seed(spark, monkeypatch):
    """Under the first seed all terms of one length have one number; the result is that of the second."""
    df, (occ, pres) = lines(spark)
    true, seeds = terms._summed, []

    def summed(records, seed):
        seeds.append(seed)
        out, total = true(records, seed)
        return (out.withColumn("shared", F.col("shared") | (F.lit(seed) == 0)), total)

    monkeypatch.setattr(terms, "_summed", summed)
    got = terms.term_frequencies(df, "line_id", "text").collect()
    assert seeds == [0, 1] and {r.term: r.n_occurrences for r in got} == dict(occ)


def test_shared_numbers_are_seen():
    import numpy as np
    import pyarrow as pa

    batch = terms._packed(0, 2, np.array([3, 5, 5], np.uint64), np.array([1, 2, 4]), np.array([1, 1, 1]), pa.array(["a", "b", "c"]))
    more = terms._packed(0, 2, np.array([3, 9], np.uint64), np.array([10, 7]), np.array([5, 6]), pa.array(["a", "é"]))
    out = pa.Table.from_batches(terms._sum_ranges(iter([batch, more]))).to_pylist()
    assert [(r["term"], r["occ"], r["pres"], r["shared"]) for r in out] == [("a", 11, 6, False), ("b", 6, 2, True), ("é", 7, 6, False)]
    cut = list(terms._cut_ranges(iter([batch]), 4))
    assert sum(b.column(2)[0].as_py() for b in cut) == 3
