"""Transcription quality over tables of (reference, hypothesis) pairs."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.editdist import char_error_rate, token_distance, word_error_rate
from folioscope.functions.text import tokens


def pair_distances(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """`pairs` with its edit distances and sizes: d_chars, n_chars, d_words, n_words. Null texts count as empty."""
    r, h = F.coalesce(F.col(ref), F.lit("")), F.coalesce(F.col(hyp), F.lit(""))
    a, b = tokens(r), tokens(h)
    return pairs.withColumns({"d_chars": F.levenshtein(r, h).cast("bigint"), "n_chars": F.length(r).cast("bigint"), "d_words": token_distance(a, b).cast("bigint"), "n_words": F.size(a).cast("bigint")})


def line_error_rates(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """`pairs` with cer and wer of each."""
    return pairs.withColumns({"cer": char_error_rate(F.col(ref), F.col(hyp)), "wer": word_error_rate(F.col(ref), F.col(hyp))})


def _ratio(d: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(d.cast("double"), n.cast("double")), F.lit(0.0))


def corpus_metrics(pairs: DataFrame, by: list[str] | None = None, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Micro-averaged cer and wer, and n_lines, n_chars, n_words, over all pairs or by group.

    A sum of sizes of 0 gives rate 0; without pairs and groups there is one row of zeros.
    """
    d = pair_distances(pairs, ref, hyp)
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = d.groupBy(*(by or [])).agg(_ratio(F.sum("d_chars"), F.sum("n_chars")).alias("cer"), _ratio(F.sum("d_words"), F.sum("n_words")).alias("wer"), F.count(F.lit(1)).alias("n_lines"), s("n_chars").alias("n_chars"), s("n_words").alias("n_words"))
    return out


def worst_predictions(pairs: DataFrame, n: int, order: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """The `n` pairs of the highest character error rate; ties in the order of the columns `order`."""
    return pairs.withColumn("cer", char_error_rate(F.col(ref), F.col(hyp))).orderBy(F.desc("cer"), *order).limit(n)


#: Cumulative probabilities of a Poisson count of mean 1 (fixed values).
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
#: Modulus and multipliers of the draws (fixed values).
MODULUS, FACTORS = 2147483647, (48271, 69621, 16807)


def draws(key: Column, rep: Column) -> Column:
    """How often the pair with the integer `key` is drawn in a replicate: a Poisson count of mean 1 from integer arithmetic."""
    m, (a, b, c) = F.lit(MODULUS).cast("bigint"), FACTORS
    h = (F.pmod(key, m) * a + rep * b + 11) % m
    h = h * c % m
    h = h.bitwiseXOR(F.shiftright(h, 15)) * a % m
    u = h.cast("double") / MODULUS
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def draw_table(key: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """`draws` of each key in each replicate."""
    a, b, c = FACTORS
    h = (np.mod(key, MODULUS)[:, None] * a + reps[None, :] * b + 11) % MODULUS
    h = h * c % MODULUS
    h = (h ^ (h >> 15)) * a % MODULUS
    return np.searchsorted(np.array(POISSON), h.astype(np.float64) / MODULUS, "right")


def bootstrap_ci(distances: DataFrame, key: Column, n_bootstrap: int = 1000, alpha: float = 0.05) -> DataFrame:
    """Percentile intervals of micro-averaged cer and wer: n_bootstrap, alpha, cer_lo, cer_hi, wer_lo, wer_hi.

    `distances` has the columns of `pair_distances`: each distance is computed once, resamples add integers.
    A resample draws every pair a Poisson number of times, as resampling with replacement does for
    many pairs; so no pair has to know the others. A task adds up an array of sums for all replicates and passes on one
    row for each. The draws are a function of `key`, the same in any engine; a null key is 0. No pairs give no rows.
    """
    sizes = ("d_chars", "n_chars", "d_words", "n_words")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, sums = np.arange(n_bootstrap, dtype=np.int64), np.zeros((n_bootstrap, len(sizes)), np.int64)
        seen = False
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(sizes) + 1)]
            for at in range(0, batch.num_rows, 1024):
                k, *values = (c[at : at + 1024] for c in columns)
                sums += draw_table(k, reps).T @ np.stack(values, 1)
            seen = seen or batch.num_rows > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(reps), *map(pa.array, sums.T.copy())], ["rep", *sizes])

    pairs = distances.select(F.coalesce(key.cast("bigint"), F.lit(0)).alias("k"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sizes])
    parts = pairs.mapInArrow(add, "rep bigint, " + ", ".join(f"{c} bigint" for c in sizes))
    return _interval(parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in sizes]), n_bootstrap, alpha)


def _interval(sums: DataFrame, n_bootstrap: int, alpha: float) -> DataFrame:
    rates = sums.select(_ratio(F.col("d_chars"), F.col("n_chars")).alias("cer"), _ratio(F.col("d_words"), F.col("n_words")).alias("wer"))
    lo, hi = int(alpha / 2 * n_bootstrap), int((1 - alpha / 2) * n_bootstrap) - 1
    both = rates.agg(F.sort_array(F.collect_list("cer")).alias("c"), F.sort_array(F.collect_list("wer")).alias("w")).where("size(c) > 0")  # n_bootstrap numbers
    ends = [F.get(c, F.lit(k)).alias(n) for c, k, n in (("c", lo, "cer_lo"), ("c", hi, "cer_hi"), ("w", lo, "wer_lo"), ("w", hi, "wer_hi"))]
    return both.select(F.lit(n_bootstrap).alias("n_bootstrap"), F.lit(alpha).alias("alpha"), *ends)


def bootstrap_ci_drawn(distances: DataFrame, order: list[str], n_bootstrap: int = 1000, alpha: float = 0.05, seed: int = 13) -> DataFrame:
    """The interval with ranks drawn by Python's generator, for parity with single-machine tools.

    The draws are sequential and made on the driver, n_bootstrap times the number of pairs: for at most
    `DRAWN_PAIRS` pairs, else an error; use `bootstrap_ci` there. Ranks follow `order`.
    """
    spark: SparkSession = distances.sparkSession
    rows = distances.select(*order, "d_chars", "n_chars", "d_words", "n_words").orderBy(*order).limit(DRAWN_PAIRS + 1).collect()
    if len(rows) > DRAWN_PAIRS:
        raise ValueError(f"over {DRAWN_PAIRS} pairs; use bootstrap_ci")
    rng, n = random.Random(seed), len(rows)
    sums = []
    for rep in range(n_bootstrap if n else 0):
        drawn = [rows[rng.randint(0, n - 1)] for _ in range(n)]
        sums.append((rep, *(sum(r[c] for r in drawn) for c in ("d_chars", "n_chars", "d_words", "n_words"))))
    return _interval(spark.createDataFrame(sums, "rep bigint, d_chars bigint, n_chars bigint, d_words bigint, n_words bigint"), n_bootstrap, alpha)


#: Pairs for which draws may be made on the driver.
DRAWN_PAIRS = 100_000
