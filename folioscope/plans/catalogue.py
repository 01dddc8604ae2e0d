"""The named queries outside the llm subpackage: name -> (callable(spark, sf_dir), SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators import compact
from folioscope.plans.reference import QUERIES
from folioscope.session import fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return compact.compact_line_files(table(spark, d, "line_files"), fresh_path(spark, "p3")).select("split", "stem")


P3_FOUND_SQL = r"""
WITH f AS (
  SELECT lower(regexp_extract(replace(file_path, '\', '/'), '(?i)^(?:.*/)?(train|validation|test)/(?:[^/]*/)*[^/]*$', 1)) AS split,
    regexp_extract(replace(file_path, '\', '/'), '(?i)(?:^|/)line_(\d+)[^/]*\.(?:png|gt\.txt)$', 1) AS digits,
    lower(file_path) LIKE '%.png' AND hex(img_bytes) LIKE '89504E470D0A1A0A%' AND hex(img_bytes) LIKE '%0000000049454E44AE426082' AS image,
    lower(file_path) LIKE '%.gt.txt' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AS body
  FROM line_files)
SELECT split, 'line_' || lpad(CAST(CAST(digits AS BIGINT) AS VARCHAR), CAST(greatest(6, length(CAST(CAST(digits AS BIGINT) AS VARCHAR))) AS INTEGER), '0') AS stem
FROM f WHERE split <> '' AND digits <> '' GROUP BY split, CAST(digits AS BIGINT) HAVING bool_or(image) AND bool_or(body)
"""


def catalogue() -> dict[str, tuple[Query, str | None]]:
    return QUERIES | {"p3_found": (p3_found, P3_FOUND_SQL)}
