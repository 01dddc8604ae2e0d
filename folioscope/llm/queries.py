"""The named queries of this subpackage: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import encode, leaks, lookalikes, noise, overlap, privacy, terms
from folioscope.session import table


TEXT_FIELDS = ["text_raw", "text_normalized", "text_gt"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.differing_fields(table(spark, d, "run_lines"), ["run_id", "line_index"], TEXT_FIELDS).select("run_id", "line_index", "field")


def p1_fields(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.normalize_fields(table(spark, d, "run_lines").select("run_id", "line_index", *TEXT_FIELDS).distinct(), TEXT_FIELDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "corpus_lines"), "line_id", "text").where("mark is not null").select("term", "mark")


def p2_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "corpus_lines"), "line_id", "text").select("term", "n_occurrences", "n_records", "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.find_overlaps(table(spark, d, "corpus_lines"), table(spark, d, "dataset_manifest"))
    return pairs.select(F.least("eval_id", "train_id").alias("line_id_a"), F.greatest("eval_id", "train_id").alias("line_id_b")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(overlap.find_overlaps(table(spark, d, "corpus_lines"), table(spark, d, "dataset_manifest")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = noise.line_noise(*(table(spark, d, t) for t in ("run_lines", "lexicon", "runs", "name_forms")))
    return found.select("run_id", "line_index", "noise").distinct()


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    return noise.run_paragraphs(*(table(spark, d, t) for t in ("run_lines", "lexicon", "runs", "name_forms")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_ids(table(spark, d, "documents"), vocabulary=encode.vocabulary_path())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return leaks.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return privacy.find_personal(table(spark, d, "documents"), table(spark, d, "name_forms")).select("doc_id", "pii_kind", "start_pos")


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    return privacy.redact_personal(table(spark, d, "documents"), table(spark, d, "name_forms"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_fields, p2_found, p2_frequencies, p4_found, p4_report, p5_found, p5_text, p6_ids, p7_found, p7_clean, p8_found, p8_text)}
