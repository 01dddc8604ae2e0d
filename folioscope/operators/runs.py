"""Pages, runs and their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import normalize_for_cer, residual_abbreviations

REVIEW_THRESHOLD = 0.70


def mean_confidence(confidences: Column) -> Column:
    """Mean of glyph confidences, rounded to four places; 0 if there are none."""
    c = F.filter(confidences, lambda x: x.isNotNull())
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.round(F.try_divide(total, F.size(c)), 4), F.lit(0.0))


def needs_review(mean: Column, threshold: float = REVIEW_THRESHOLD) -> Column:
    """Whether a rounded mean confidence lies below the threshold."""
    return F.round(mean, 4) < threshold


def _cer(hyp: Column, ref: Column) -> Column:
    return F.coalesce(F.try_divide(F.levenshtein(hyp, ref).cast("double"), F.length(ref).cast("double")), F.lit(0.0))


def evaluate_pages(pages: DataFrame, normalize=normalize_for_cer) -> DataFrame:
    """Scores of pages with `lines` (array of text, mean_confidence, needs_review) and `truth` (array of texts).

    n_lines, n_review, mean_confidence, n_abbreviations, and three rates on the texts of the whole page:
    cer_raw of all lines, cer_reviewed of the lines that need no review, cer_normalized of those, both
    sides normalised. An empty truth gives 0.
    """
    join = lambda a: F.array_join(a, " ")
    texts = F.transform("lines", lambda x: F.coalesce(x["text"], F.lit("")))
    sure = F.transform(F.filter("lines", lambda x: ~F.coalesce(x["needs_review"], F.lit(False))), lambda x: F.coalesce(x["text"], F.lit("")))
    base = pages.withColumns({"raw_text": join(texts), "sure_text": join(sure), "true_text": join(F.coalesce(F.col("truth"), F.array()))})
    n = F.size("lines")
    conf = F.aggregate(F.transform("lines", lambda x: F.coalesce(x["mean_confidence"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    out = base.withColumns(
        {
            "n_lines": n.cast("bigint"),
            "n_review": F.size(F.filter("lines", lambda x: F.coalesce(x["needs_review"], F.lit(False)))).cast("bigint"),
            "mean_confidence": F.when(n > 0, conf / n).otherwise(F.lit(0.0)),
            "n_abbreviations": residual_abbreviations(F.col("raw_text")),
            "cer_raw": _cer(F.col("raw_text"), F.col("true_text")),
            "cer_reviewed": _cer(F.col("sure_text"), F.col("true_text")),
            "cer_normalized": _cer(normalize(F.col("sure_text")), normalize(F.col("true_text"))),
        }
    )
    return out.drop("lines", "truth", "raw_text", "sure_text", "true_text")


def evaluate_contracts(pages: DataFrame, digits: int = 4, normalize=normalize_for_cer) -> DataFrame:
    """Scores of pages with `contract` (of which the lines count) and `truth` (array of texts), rounded to `digits` places.

    As `evaluate_pages`, with n_lines_kept, the lines that need no review, and n_lines_gt. A null contract, that of a page
    that is no XML, has no lines; a null truth has none.
    """
    lines = F.coalesce(F.col("contract.lines"), F.array().cast(pages.schema["contract"].dataType["lines"].dataType))
    truth = F.coalesce(F.col("truth"), F.array().cast("array<string>"))
    placed = pages.withColumns({"lines": lines, "truth": truth, "n_lines_gt": F.size(truth).cast("bigint")}).drop("contract")
    scored = evaluate_pages(placed, normalize).withColumn("n_lines_kept", F.col("n_lines") - F.col("n_review"))
    # Sums of decimals come out a little beside ties; nine places set them right.
    return scored.withColumns({c: F.round(F.round(c, 9), digits) for c in ("mean_confidence", "cer_raw", "cer_reviewed", "cer_normalized")})


def aggregate_pages(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unweighted means of page values, sums of counts, review rate of all lines; 0 lines give a null rate."""
    means = [F.avg(c).alias(c) for c in ("mean_confidence", "cer_raw", "cer_reviewed", "cer_normalized")]
    sums = [F.sum(c).alias(c) for c in ("n_lines", "n_review", "n_abbreviations")]
    out = pages.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_pages"), *sums, F.try_divide(F.sum("n_review").cast("double"), F.sum("n_lines").cast("double")).alias("needs_review_rate"), *means)
    return out.where("n_pages > 0")


def review_rates(lines: DataFrame, by: list[str], threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Per group: lines, flagged ones, those under the threshold, and those where flag and confidence disagree."""
    low = needs_review(F.col("mean_confidence"), threshold)
    flag = F.col("needs_review")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return lines.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lines"), count(flag).alias("n_flagged"), count(low).alias("n_low"), count(low != flag).alias("n_disagree"), F.avg("mean_confidence").alias("mean_confidence"))


def latest_runs(runs: DataFrame, n: int = 100) -> DataFrame:
    """The `n` last created runs; ties by id, repeated rows once."""
    return runs.distinct().orderBy(F.desc_nulls_last("created_at"), F.desc("run_id")).limit(n)


def lines_of_run(lines: DataFrame, run_id: int) -> DataFrame:
    """Lines of a run, each once, in order."""
    return lines.where(F.col("run_id") == run_id).distinct().orderBy("line_index")


def unpivot_rates(runs: DataFrame) -> DataFrame:
    """(run_id, manuscript, measure, cer): one row for each of the two rates that is known."""
    return runs.distinct().unpivot(["run_id", "manuscript"], ["cer_raw", "cer_normalized"], "measure", "cer").where("cer is not null")


def normalization_gain(runs: DataFrame) -> DataFrame:
    """(run_id, manuscript, gain): what normalising took off the error rate; null where a rate is null or 0."""
    gain = F.when((F.col("cer_raw") != 0) & (F.col("cer_normalized") != 0), F.col("cer_raw") - F.col("cer_normalized"))
    return runs.distinct().select("run_id", "manuscript", gain.alias("gain"))


def target_progress(runs: DataFrame, target: float = 0.08) -> DataFrame:
    """(run_id, reached, progress): whether the normalised rate meets the target, and how far it got, 0 to 1."""
    c = F.col("cer_normalized")
    return runs.distinct().where(c.isNotNull()).select("run_id", (c <= target).alias("reached"), F.when(c <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(target) / c))).alias("progress"))


def append_run(runs_path: str, lines_path: str, run: DataFrame, lines: DataFrame) -> int:
    """Append one run and its lines to parquet tables and return the new id, one more than the largest of either table.

    The lines go first: a run is visible only when all its lines are, and lines of a run that failed keep their
    id to themselves. One writer at a time.
    """
    spark, last = run.sparkSession, 0
    for path in (runs_path, lines_path):
        try:
            last = max(last, spark.read.parquet(path).agg(F.max("run_id")).first()[0] or 0)
        except Exception as e:  # the table does not exist yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    new = F.lit(last + 1).cast("bigint")
    lines.withColumn("run_id", new).write.mode("append").parquet(lines_path)
    run.withColumn("run_id", new).withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")).write.mode("append").parquet(runs_path)
    return last + 1
