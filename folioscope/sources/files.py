"""Readers and writers of the project's files: corpora, manifests, reports, metrics, predictions, lexica, tables of a database.

A path that does not exist gives an empty table of the declared schema, as callers expect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import strip

CORPUS = "im struct<bytes:binary,path:string>, text string, language string, century tinyint"
MANIFEST = "repo_id string, filter struct<language:string,century:int>, splits map<string,bigint>, total bigint, s3_keys array<string>"
_BOOTSTRAP = "struct<n_bootstrap:int,alpha:double,cer_ci95:array<double>,wer_ci95:array<double>>"
REPORT = f"model string, test_set string, cer double, wer double, char_accuracy double, bootstrap {_BOOTSTRAP}, manuscripts map<string,struct<iou_mean:double,iou_share:double,n_lines:bigint,pages:bigint>>, raw string"
#: Further fields of reports as they are shipped: rates of the best epoch, scores of manuscripts under other names.
_SHIPPED = "validation_best struct<epoch:int,val_accuracy:double,cer:double,val_word_accuracy:double,wer:double>, segmentation_iou struct<threshold:double,manuscripts:map<string,struct<title:string,mean_iou:double,pct_above_threshold:double,n_lines:bigint,n_pages:bigint>>,mean_iou:double,pct_above_threshold:double>"
LISTING = "parquet_files array<struct<split:string,url:string,filename:string,size:bigint>>"
METRICS = "epoch int, accuracy double, cer double, word_accuracy double, wer double, best_val_metric double"
PREDICTIONS = "ref string, hyp string, image_path string"
LEXICON = "form string, cat string, lemma string"
PNG = "*.png"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop))


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def corpus_files(paths: Sequence[tuple[str, str]], split: str, max_files: int | None = None) -> list[str]:
    """Paths of a listing of (split, path) that belong to a split, the first `max_files` of them."""
    return [p for s, p in paths if s == split][:max_files]


def read_listing(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(split, url) of the files that a listing's JSON names, in its order; none where there is no listing. A listing is as long as a corpus has files."""
    files = _json(spark, path, LISTING).select(F.posexplode("parquet_files").alias("k", "f")).select("k", "f.split", "f.url")
    return [(r.split, r.url) for r in sorted(files.collect()) if r.url]


def read_corpus(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet files of the corpus with the declared schema; filters and columns reach the scan."""
    return spark.read.schema(CORPUS).parquet(*paths) if paths else _empty(spark, CORPUS)


def read_texts(spark: SparkSession, directory: str, pattern: str = "*.gt.txt") -> DataFrame:
    """(stem, text) of the text files of a directory, stripped."""
    if not exists(spark, f"{directory}/{pattern}"):
        return _empty(spark, "stem string, text string")
    raw = spark.read.option("pathGlobFilter", pattern).text(directory, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"(\.gt)?\.[^.]+$", "")
    return raw.select(stem.alias("stem"), strip(F.col("value")).alias("text"))


def read_images(spark: SparkSession, directory: str) -> DataFrame:
    """(stem, path, n_bytes) of the images of a directory; their bytes are not read."""
    if not exists(spark, f"{directory}/{PNG}"):
        return _empty(spark, "stem string, path string, n_bytes bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", PNG).load(directory)
    return files.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("stem"), "path", F.col("length").alias("n_bytes"))


def sample_directory(spark: SparkSession, directory: str, n: int = 8) -> DataFrame:
    """The first `n` images by name with their texts, empty where there is none."""
    images = read_images(spark, directory).orderBy("stem").limit(n)
    return images.join(read_texts(spark, directory), "stem", "left").withColumn("text", F.coalesce("text", F.lit(""))).orderBy("stem")


def read_pages(spark: SparkSession, directory: str, pattern: str = "*.xml") -> DataFrame:
    """(page, xml) of the page files of a directory."""
    if not exists(spark, f"{directory}/{pattern}"):
        return _empty(spark, "page string, xml string")
    raw = spark.read.option("pathGlobFilter", pattern).text(directory, wholetext=True)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.xml$", "").alias("page"), F.col("value").alias("xml"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else _empty(spark, schema)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, MANIFEST)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report of REPORT's fields, and best_epoch, iou_mean, iou_share; rates and manuscripts stand at the top or, as shipped, below.

    The trainer's own words are the field `raw` or one whose name ends in `_output`.
    """
    further = f"{REPORT}, {_SHIPPED}"
    text = spark.read.text(path, wholetext=True).where(F.col("value").rlike(r"\S")) if exists(spark, path) else _empty(spark, "value string")
    r = text.select(F.from_json("value", further).alias("r"), F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: F.endswith(k, F.lit("_output"))).alias("said")).select("r.*", "said")
    best, seg = F.col("validation_best"), F.col("segmentation_iou")
    shipped = F.transform_values(seg["manuscripts"], lambda _, m: F.struct(m["mean_iou"].alias("iou_mean"), m["pct_above_threshold"].alias("iou_share"), m["n_lines"].alias("n_lines"), m["n_pages"].alias("pages")))
    either = {"cer": best["cer"], "wer": best["wer"], "char_accuracy": best["val_accuracy"], "manuscripts": shipped, "raw": F.get(F.map_values("said"), F.lit(0))}
    out = r.withColumns({c: F.coalesce(c, other) for c, other in either.items()})
    return out.withColumns({"best_epoch": best["epoch"], "iou_mean": seg["mean_iou"], "iou_share": seg["pct_above_threshold"]}).drop("validation_best", "segmentation_iou", "said")


def manuscripts_of(report: DataFrame) -> DataFrame:
    """(manuscript, iou_mean, iou_share, n_lines, pages) of a report."""
    return report.select(F.explode("manuscripts").alias("manuscript", "m")).select("manuscript", "m.*")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Epoch metrics of a CSV, typed by column, in order of epochs; a cell that is no number is null."""
    if not exists(spark, path):
        return _empty(spark, METRICS)
    return spark.read.schema(METRICS).option("header", True).option("enforceSchema", False).csv(path).orderBy("epoch")


def typed_cell(c: Column) -> Column:
    """Struct (whole, decimal, other) with one of them set: digits only, a number with a point, anything else."""
    whole = F.when(~c.contains("."), c.try_cast("bigint"))
    decimal = F.when(c.contains("."), c.try_cast("double"))
    return F.struct(whole.alias("whole"), decimal.alias("decimal"), F.when(whole.isNull() & decimal.isNull(), c).alias("other"))


def metrics_or_log(metrics: DataFrame, log: DataFrame) -> DataFrame:
    """The metrics if they have rows, else what the log gave (epoch, accuracy, cer)."""
    own = metrics.select("epoch", "accuracy", "cer")
    return log.select("epoch", "accuracy", "cer") if own.isEmpty() else own


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(ref, hyp, image_path) of a CSV, all strings; short rows give null."""
    if not exists(spark, path):
        return _empty(spark, PREDICTIONS)
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in ("ref", "hyp", "image_path")])


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(form, cat, lemma) of a tab-separated file without quoting."""
    return spark.read.schema(LEXICON).option("sep", "\t").option("quote", "").csv(path) if exists(spark, path) else _empty(spark, LEXICON)


def read_database(spark: SparkSession, url: str | None, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table over JDBC; `partition` (column, lower, upper, number) reads it in parallel. Without url an error."""
    if not url:
        raise ValueError("no database url")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, lower, upper, number = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", number)
    return reader.load()


def write_database(df: DataFrame, url: str | None, table: str, batch: int = 10_000, **options: str) -> None:
    if not url:
        raise ValueError("no database url")
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode("append").save()


def write_lines(lines: DataFrame, path: str) -> dict[str, int]:
    """Prepared lines as parquet, a folder a split; returns the number of lines written of each."""
    lines.write.partitionBy("split").mode("overwrite").parquet(path)
    counts = lines.sparkSession.read.parquet(path).groupBy("split").count().collect()  # a row a split
    return {r["split"]: r["count"] for r in counts}


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Epoch metrics as one CSV in the fixed order of fields."""
    fields = [f.split()[0] for f in METRICS.split(", ")]
    metrics.select(*[F.col(c) if c in metrics.columns else F.lit(None).alias(c) for c in fields]).coalesce(1).orderBy("epoch").write.mode("overwrite").option("header", True).csv(path)


def write_path_list(images: DataFrame, path: str) -> None:
    """Sorted paths, one a line."""
    images.select("path").orderBy("path").coalesce(1).write.mode("overwrite").text(path)


def split_key(prefix: str, split: str) -> str:
    """Place of a split below a prefix."""
    return f"{prefix.rstrip('/')}/split={split}"


def manifest_key(prefix: str) -> str:
    return f"{prefix.rstrip('/')}/dataset_manifest.json"
