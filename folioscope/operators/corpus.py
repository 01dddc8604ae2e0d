"""Filtering, numbering and profiling a corpus of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import strip, tokens
from folioscope.session import cut


def filter_corpus(lines: DataFrame, language: str | None = None, century: int | None = None) -> DataFrame:
    """Lines of a language and century with a text that is not blank, stripped, and an image that is not empty.

    The equalities and the null tests reach the scan; only img, text and key columns are read if only they are used.
    """
    kept = lines.where(F.col("text").isNotNull() & F.col("im.bytes").isNotNull())
    if language is not None:
        kept = kept.where(F.col("language") == language)
    if century is not None:
        kept = kept.where(F.col("century") == century)
    return kept.withColumn("text", strip(F.col("text"))).where((F.col("text") != "") & (F.length("im.bytes") > 0))


#: How the images that can be read begin: PNG, JPEG, TIFF of either order, GIF, BMP (fixed values).
IMAGE_STARTS = ("89504E470D0A1A0A", "FFD8FF", "49492A00", "4D4D002A", "474946383961", "474946383761", "424D")


def usable_image(image: Column) -> Column:
    """Whether bytes begin as an image of a known form does; null for null."""
    found = F.lit(False)
    for start in IMAGE_STARTS:
        found = found | F.startswith(image, F.unhex(F.lit(start)))
    return found


def extract_lines(lines: DataFrame, splits: list[str], order: list[str], language: str | None = None, century: int | None = None, max_per_split: int | None = None) -> DataFrame:
    """The usable lines of a corpus, numbered through the splits: columns of `lines`, line_idx, stem.

    As `filter_corpus`, but lines whose image is of no known form are left out too, before the cap and the numbers. Only keys are
    sorted and numbered; the lines, images with them, are joined back by the columns `order`, which must be a key.
    """
    kept = filter_corpus(lines, language, century).where(usable_image(F.col("im.bytes")))
    numbered = number_lines(kept.select("split", *order).distinct(), splits, order, max_per_split)
    return kept.drop("line_idx", "stem").join(numbered, ["split", *order])


def number_rows(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """`df` with consecutive numbers from 0 in the order of the columns `order` (they should be a key).

    Not a window over everything: rows are range-partitioned and sorted, a count per partition goes to the
    driver, and a row's number is its partition's offset plus its place there.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    counts = placed.groupBy(F.spark_partition_id().alias("p")).count().collect()  # one row a partition
    offsets, total = {}, 0
    for r in sorted(counts):
        offsets[r.p] = total
        total += r["count"]
    # The place in a partition is the low part of the monotonic id.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    offset = df.sparkSession.createDataFrame(list(offsets.items()), "__p int, __o bigint")  # a row a partition
    numbered = placed.withColumns({"__p": F.spark_partition_id(), "__k": place}).join(F.broadcast(offset), "__p")
    return numbered.withColumn(name, F.col("__o") + F.col("__k")).drop("__p", "__k", "__o")


def stem(number: Column) -> Column:
    """`line_` and the number in at least six digits."""
    return F.format_string("line_%06d", number)


def number_lines(lines: DataFrame, splits: list[str], order: list[str], max_per_split: int | None = None) -> DataFrame:
    """Lines numbered through the splits in the given order, at most `max_per_split` of each; line_idx, stem."""
    position = F.array_position(F.array(*map(F.lit, splits)), F.col("split"))
    kept = lines.withColumn("split_ord", position.cast("int")).where("split_ord > 0")
    if max_per_split is not None:
        kept = cap_per_group(kept, ["split"], order, max_per_split)
    numbered = number_rows(kept, ["split_ord", *order], "line_idx")
    return numbered.drop("split_ord").withColumn("stem", stem(F.col("line_idx")))


def cap_per_group(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first `n` rows of each group; Spark prunes each task's rows to n a group before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def split_manifest(lines: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row: `splits`, a map of counts by split, and `total`."""
    counts = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n")).where("split is not null")
    entries = F.array_sort(F.collect_list(F.struct("split", "n")))
    return counts.agg(F.map_from_entries(entries).alias("splits"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total")).withColumns(extra or {})


def split_totals(lines: DataFrame) -> DataFrame:
    """(split, n, is_total): counts by split and, marked, of all."""
    return lines.rollup("split").agg(F.count(F.lit(1)).alias("n"), F.grouping("split").cast("int").alias("is_total"))


def length_stats(lines: DataFrame, by: list[str]) -> DataFrame:
    """Numbers, lengths and word counts by group; null texts do not count."""
    t = lines.where("text is not null").withColumns({"c": F.length("text").cast("bigint"), "w": F.size(tokens(F.col("text"))).cast("bigint")})
    return t.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("c").alias("n_chars"), F.min("c").alias("min_chars"), F.max("c").alias("max_chars"), F.avg("c").alias("mean_chars"), F.sum("w").alias("n_words"), F.max("w").alias("max_words"))


def length_histogram(lines: DataFrame, bins: int = 40) -> DataFrame:
    """(bin, low, high, n): equal bins from the shortest to the longest text; at most `bins`; one bin if all are as long."""
    t = lines.where("text is not null").select(F.length("text").cast("bigint").alias("c"))
    ends = t.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(bins)), F.lit(1)).cast("bigint")
    placed = t.join(F.broadcast(ends)).select("lo", width.alias("width"), F.floor((F.col("c") - F.col("lo")) / width).alias("bin"))  # one row
    return placed.groupBy("bin").agg(F.min(F.col("lo") + F.col("bin") * F.col("width")).alias("low"), F.min(F.col("lo") + (F.col("bin") + 1) * F.col("width") - 1).alias("high"), F.count(F.lit(1)).alias("n"))


def char_frequency(lines: DataFrame, only_special: bool = False, text: str = "text") -> DataFrame:
    """(ch, n) over all texts; `only_special`: characters beyond ASCII. Counts are added up in each task first."""
    ch = lines.select(F.explode(F.split(F.col(text), "")).alias("ch")).where("ch <> ''")
    if only_special:
        ch = ch.where(F.ascii("ch") > 127)
    return ch.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def top_chars(frequency: DataFrame, k: int = 20) -> DataFrame:
    """The `k` most frequent; ties by character."""
    return frequency.orderBy(F.desc("n"), "ch").limit(k)


def sample_lines(images: DataFrame, texts: DataFrame, n: int = 8) -> DataFrame:
    """The first `n` images by stem with the text of the same stem, an empty one where none is."""
    return images.join(texts, "stem", "left").withColumn("text", F.coalesce("text", F.lit(""))).orderBy("stem").limit(n)
