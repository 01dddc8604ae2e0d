"""Problem 3: masses of tiny line files into few well-sized files, each complete line record once.

Method: the records pass an adaptive REBALANCE exchange; its run-time statistics merge small output
partitions and split large ones near the target size, so the number of files follows the bytes, not the
number of inputs. The files are written to a staging folder and committed by a rename only after the
multiset checksum of what lies there equals that of the source.

The checksum of the source is computed in a pass of its own that carries hashes instead of images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a PNG begins with, and its closing chunk (fixed values).
PNG_SIGNATURE, PNG_END = "89504E470D0A1A0A", "0000000049454E44AE426082"
_BLANK = r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}\x{feff}\x{200b}]*$"


def is_complete_png(image: Column) -> Column:
    """True where the bytes run from the signature to the closing chunk; null for null."""
    return F.startswith(image, F.unhex(F.lit(PNG_SIGNATURE))) & F.contains(image, F.unhex(F.lit(PNG_END)))


def _files(df: DataFrame) -> DataFrame:
    """Usable files with the split and number that their paths name."""
    path = F.regexp_replace("file_path", r"\\", "/")
    name = F.regexp_extract(path, r"(?i)(?:^|/)line_(\d+)[^/]*\.(?:png|gt\.txt)\s*$", 1)
    split = F.lower(F.regexp_extract(path, r"(?i)^(?:.*/)?(train|validation|test)/(?:[^/]*/)*[^/]*$", 1))
    is_image = F.lower(path).rlike(r"\.png\s*$")
    rank = F.struct("modified_at", "file_id", F.xxhash64(F.coalesce("img_bytes", F.encode("text", "UTF-8"))))
    picked = df.select(
        split.alias("split"),
        # Numbers longer than a BIGINT are compared as digits without leading zeros.
        F.regexp_replace(name, r"^0+(?=\d)", "").alias("number"),
        F.when(is_image & is_complete_png(F.col("img_bytes")), F.col("img_bytes")).alias("img"),
        F.when(~is_image & ~F.col("text").rlike(_BLANK), F.col("text")).alias("txt"),
        F.col("file_path").alias("path"),
        rank.alias("rank"),
    )
    return picked.where("split <> '' and number <> '' and (img is not null or txt is not null)")


def _records(files: DataFrame, image: Column) -> DataFrame:
    """One row a complete record: the last delivered complete image and transcription."""
    kept = files.select("split", "number", image.alias("img"), "txt", "path", F.when(F.col("img").isNotNull(), F.col("rank")).alias("ri"), F.when(F.col("txt").isNotNull(), F.col("rank")).alias("rt"))
    grouped = kept.groupBy("split", "number").agg(
        F.max_by("img", "ri").alias("img_bytes"),
        F.max_by("path", "ri").alias("image_path"),
        F.max_by("txt", "rt").alias("text"),
        F.max_by("path", "rt").alias("text_path"),
    )
    stem = F.concat(F.lit("line_"), F.when(F.length("number") < 6, F.lpad("number", 6, "0")).otherwise(F.col("number")))
    return grouped.where("img_bytes is not null and text is not null").select("split", stem.alias("stem"), "img_bytes", "text", "image_path", "text_path")


def line_records(df: DataFrame) -> DataFrame:
    """Each complete line record of a table of line files once.

    Input columns: file_id, file_path, modified_at, img_bytes, text; others are ignored. A record is
    a split (train, validation or test, the last such folder of the path, any case) and the number
    after `line_`. It is complete if some file ending in `.png` holds a whole PNG and some file ending
    in `.gt.txt` (any case) a text that is not blank. Of several, the last by modified_at, file_id and content hash counts.

    Files with a null path, of other names, empty or broken off count as absent; repeated rows give one
    record; an empty table gives no rows. A record delivered very often is pre-aggregated in each task.
    """
    return _records(_files(df), F.col("img"))


def _checksum(rows: DataFrame, image_hash: Column) -> tuple:
    row = [F.col("split"), F.col("stem"), image_hash, F.col("text"), F.col("image_path"), F.col("text_path")]
    wide = "decimal(38,0)"
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*row).cast(wide)), F.sum(F.xxhash64(F.lit(1), *row).cast(wide))).first())


def compact_line_files(df: DataFrame, out_path: str, target_bytes: int = 128 << 20) -> DataFrame:
    """Write the records of `line_records` to `out_path` in files near `target_bytes` and return them as read from there.

    Raises and leaves `out_path` untouched if the written rows are not the source's rows, each as often.
    """
    spark = df.sparkSession
    records, staging = line_records(df), f"{out_path.rstrip('/')}.staging"
    adaptive = {
        "enabled": "true",
        "advisoryPartitionSizeInBytes": str(target_bytes),
        "optimizeSkewsInRebalancePartitions.enabled": "true",
        "coalescePartitions.enabled": "true",
        # Merge up to the target size, not just as far as all cores stay busy.
        "coalescePartitions.parallelismFirst": "false",
        "coalescePartitions.minPartitionSize": str(min(1 << 20, target_bytes)),
    }
    with _settings(spark, {f"spark.sql.adaptive.{k}": v for k, v in adaptive.items()}):
        records.hint("rebalance").write.mode("overwrite").parquet(staging)
    files = _files(df)
    # The source side never carries the images: their hashes take the same way.
    hashed = _records(files, F.when(F.col("img").isNotNull(), F.xxhash64("img")))
    source = _checksum(hashed, F.col("img_bytes"))
    written = _checksum(spark.read.parquet(staging), F.xxhash64("img_bytes"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if source != written:
        fs.delete(hadoop.Path(staging), True)
        raise RuntimeError(f"compaction not committed: source has (rows, checksums) {source}, the written files {written}")
    # What lies there already is put aside first and goes only when the new files are in its place.
    out, aside = hadoop.Path(out_path), hadoop.Path(f"{out_path.rstrip('/')}.before")
    fs.delete(aside, True)
    replaced = fs.exists(out)
    if replaced and not fs.rename(out, aside):
        raise RuntimeError(f"compaction not committed: cannot rename {out_path}")
    if not fs.rename(hadoop.Path(staging), out):
        if replaced:
            fs.rename(aside, out)
        raise RuntimeError(f"compaction not committed: cannot rename {staging}")
    fs.delete(aside, True)
    return spark.read.parquet(out_path)


class _settings:
    """Session settings for a block, put back afterwards."""

    def __init__(self, spark: SparkSession, values: dict[str, str]) -> None:
        self.spark, self.values = spark, values

    def __enter__(self) -> None:
        self.before = {k: self.spark.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
