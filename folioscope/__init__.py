"""Spark-native analytics for line-level text corpora and transcription quality.

Subpackages
-----------
functions   Column -> Column building blocks (text, edit distance, geometry).
operators   DataFrame -> DataFrame operators (corpus, metrics, lexicon, runs, compaction ...).
sources     readers and writers (page XML, logs, JSON, CSV, JDBC).
plans       the query catalogue and its SQL twins.
streaming   incremental variants; see its docstring for what is absent by design.
llm         text preparation for training corpora; nothing else imports it.
"""

__version__ = "0.1.0"
