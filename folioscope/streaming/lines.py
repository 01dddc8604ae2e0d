"""New lines as they arrive: the corpus filter and the normalisation on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.functions.text import normalize_for_cer
from folioscope.operators.corpus import filter_corpus
from folioscope.session import fresh_path


def append_lines(stream: DataFrame, path: str, language: str | None = None, century: int | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Write the usable lines of a stream with the corpus schema to `path`, with their normalised text, once each file.

    Stateless: each micro-batch is filtered and normalised as a table would be. Stops when all that has come is written.
    """
    kept = filter_corpus(stream, language, century).withColumn("text_normalized", normalize_for_cer(F.col("text")))
    place = checkpoint or fresh_path(stream.sparkSession, "lines-stream")
    return kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", place).trigger(availableNow=True).start()
