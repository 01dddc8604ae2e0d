"""Training curves: logs, best epoch, early stopping, anchoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import strip_ansi

#: Form of a report line of the trainer (fixed value).
REPORT = r"Accuracy report \((\d+)\)\s+([\d.]+)(?:\s+(\d+)\s+(\d+))?"


#: Form of a progress line of the trainer, terminal sequences taken out (fixed value).
PROGRESS = r"stage\s+(\d+)/(?:\d+|∞).*?val_accuracy:\s*([\d.]+).*?val_word_accuracy:\s*([\d.]+).*?early_stopping:\s*\d+/\d+\s*([\d.]+)"


def parse_log(logs: DataFrame, text: str = "value", by: list[str] | None = None) -> DataFrame:
    """(by, epoch, accuracy, cer, chars, errors) of every report line in texts that may hold many; `by` are columns to keep."""
    parts = [F.regexp_extract_all(F.col(text), F.lit(REPORT), F.lit(i)) for i in range(1, 5)]
    rows = logs.select(*(by or []), F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "eacr")])).alias("x"))
    return rows.select(*(by or []), F.col("x.e").cast("int").alias("epoch"), F.col("x.a").cast("double").alias("accuracy"), F.round(1 - F.col("x.a").cast("double"), 4).alias("cer"), F.expr("try_cast(nullif(x.c, '') as bigint)").alias("chars"), F.expr("try_cast(nullif(x.r, '') as bigint)").alias("errors"))


def parse_stage_log(lines: DataFrame, text: str = "value", order: str = "line_no", by: list[str] | None = None) -> DataFrame:
    """(by, epoch, accuracy, cer, word_accuracy, wer, best_val_metric) of progress lines; of several lines of an epoch the last counts.

    The rates are one less the accuracies, rounded to six places. Lines of another form, and nulls, give no row.
    """
    plain = strip_ansi(F.col(text))
    part = lambda i: F.regexp_extract(plain, PROGRESS, i)
    kept = lines.where(F.col(text).contains("stage ") & F.col(text).contains("val_accuracy:"))
    rows = kept.select(*(by or []), order, part(1).alias("e"), *[part(i).try_cast("double").alias(n) for i, n in ((2, "accuracy"), (3, "word_accuracy"), (4, "best_val_metric"))]).where("e <> ''")
    last = rows.groupBy(*(by or []), F.col("e").cast("int").alias("epoch")).agg(F.max_by(F.struct("accuracy", "word_accuracy", "best_val_metric"), order).alias("x"))
    rate = lambda c: F.round(1 - F.col(c), 6)
    return last.select(*(by or []), "epoch", "x.accuracy", rate("x.accuracy").alias("cer"), "x.word_accuracy", rate("x.word_accuracy").alias("wer"), "x.best_val_metric")


def best_epoch(metrics: DataFrame, metric: str, lowest: bool = False, by: list[str] | None = None) -> DataFrame:
    """(epoch, value) of the best value, or of each curve of `by`; the first epoch on ties."""
    pick = F.min_by("epoch", F.struct(metric, "epoch")) if lowest else F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch")))
    value = F.min(metric) if lowest else F.max(metric)
    return metrics.where(F.col(metric).isNotNull()).groupBy(*(by or [])).agg(pick.alias("epoch"), value.alias("value"))


def early_stopping(metrics: DataFrame, patience: int, by: list[str] | None = None) -> DataFrame:
    """(best_epoch, best_cer, stop_epoch, stalled) of a curve (epoch, cer), or of each curve of `by`.

    An epoch improves if its cer is less than all before; a null cer never does. stop_epoch is the first
    with `patience` epochs in a row without improvement; the scan goes on after it, so the best may be later.
    stalled: all epochs that do not improve. No epochs give one row of nulls (no row for a group). A curve is as long as its training ran.
    """
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    inf = F.coalesce(F.col("cer"), F.lit(float("inf")))
    seen = metrics.withColumn("c", inf).withColumn("m", F.coalesce(F.min("c").over(w.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("inf"))))
    step = seen.withColumn("better", (F.col("c") < F.col("m")).cast("int"))
    island = step.withColumn("island", F.sum("better").over(w.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)))
    wi = Window.partitionBy(*by, "island").orderBy("epoch")
    stall = island.withColumn("stall", F.row_number().over(wi) - F.when(F.col("island") > 0, 1).otherwise(0))
    stopped = F.min(F.when(F.col("stall") >= patience, F.col("epoch")))
    found = stall.groupBy(*by) if by else stall
    better = F.col("better") == 1
    return found.agg(
        F.min_by(F.when(better, F.col("epoch")), F.when(better, F.struct("c", "epoch"))).alias("best_epoch"),
        F.min(F.when(better, F.col("c"))).alias("best_cer"),
        stopped.alias("stop_epoch"),
        F.array_sort(F.collect_list(F.when(~better, F.col("epoch")))).alias("stalled"),
    )


def anchor_curve(metrics: DataFrame, true_best: float, true_best_words: float | None = None, digits: int | None = None) -> DataFrame:
    """Curve (accuracy, and word_accuracy if given `true_best_words`) shifted so that its best values are the true ones.

    The rates cer and wer are one less the shifted accuracies; all four are rounded to `digits` places if given. An empty curve stays empty.
    """
    wanted = {"accuracy": ("cer", true_best)} | ({} if true_best_words is None else {"word_accuracy": ("wer", true_best_words)})
    best = metrics.agg(*[F.max(c).alias(f"__{c}") for c in wanted])
    out = metrics.join(F.broadcast(best))  # one row
    placed = lambda c: c if digits is None else F.round(c, digits)
    for c, (rate, true) in wanted.items():
        out = out.withColumn(c, placed(F.col(c) + (F.lit(true) - F.col(f"__{c}")))).withColumn(rate, placed(1 - F.col(c))).drop(f"__{c}")
    return out


def half_width(low: Column, high: Column) -> Column:
    """Half the width of an interval."""
    return (high - low) / 2
