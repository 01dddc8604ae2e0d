"""Queries for the operators outside the llm subpackage, each beside its SQL twin.

The queries read the stored texts. As SQL engines differ in whether distances count bytes or characters, twins that
compare edit distances number the distinct characters of each pair and compare texts of one byte a number. So they agree with their
queries on all texts of up to 126 distinct characters a pair.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import geometry as geo
from folioscope.functions import text as tx
from folioscope.operators import corpus, lexicon, metrics, runs, segmentation, training
from folioscope.session import parallelism, table
from folioscope.sources import alto

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
SPLIT_SQL = f"lower(regexp_replace(split, '^{SP}+|{SP}+$', '', 'g'))"
WORDS_SQL = lambda c: f"list_filter(regexp_split_to_array({c}, '{SP}+'), lambda x: x <> '')"
CHARS_SQL = lambda c: f"regexp_extract_all({c}, '(?s).')"


#: The signs of one byte each that characters become.
_BYTES = "".join(map(chr, range(1, 127))).replace("'", "''")


def distance_sql(a: str, b: str) -> str:
    """Edit distance of two texts in characters: each distinct one of the pair becomes one byte."""
    signs = f"array_to_string(list_distinct({CHARS_SQL(f'{a} || {b}')}), '')"
    return f"levenshtein(translate({a}, {signs}, '{_BYTES}'), translate({b}, {signs}, '{_BYTES}'))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Corpus lines, each delivery once, with plain split names."""
    return table(spark, d, "corpus_lines").withColumn("split", F.lower(tx.strip(F.col("split"))))


# --- corpus ----------------------------------------------------------------------------------------


@query(f"""SELECT DISTINCT line_id, regexp_replace(text, '^{SP}+|{SP}+$', '', 'g') AS text, octet_length(im.bytes) AS n_bytes FROM corpus_lines
WHERE language = 'French' AND century = 13 AND regexp_replace(text, '^{SP}+|{SP}+$', '', 'g') <> '' AND octet_length(im.bytes) > 0""")
def corpus_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus.filter_corpus(table(spark, d, "corpus_lines"), "French", 13)
    return kept.select("line_id", "text", F.octet_length("im.bytes").cast("bigint").alias("n_bytes")).distinct()


_NUMBERED = f"""WITH l AS (SELECT DISTINCT line_id, {SPLIT_SQL} AS split FROM corpus_lines
  WHERE language = 'French' AND century = 13 AND regexp_replace(text, '^{SP}+|{SP}+$', '', 'g') <> '' AND octet_length(im.bytes) > 0),
o AS (SELECT *, list_position(['train', 'validation', 'test'], split) AS so FROM l WHERE split IN ('train', 'validation', 'test'))
"""


@query(_NUMBERED + ", n AS (SELECT line_id, split, row_number() OVER (ORDER BY so, line_id) - 1 AS line_idx FROM o) SELECT *, 'line_' || lpad(CAST(line_idx AS VARCHAR), 6, '0') AS stem FROM n")
def corpus_numbering(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus.filter_corpus(_lines(spark, d), "French", 13).select("line_id", "split").distinct()
    return corpus.number_lines(kept, ["train", "validation", "test"], ["line_id"])


@query(_NUMBERED + ", c AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY line_id) AS r FROM o), n AS (SELECT line_id, split, row_number() OVER (ORDER BY so, line_id) - 1 AS line_idx FROM c WHERE r <= 50) SELECT *, 'line_' || lpad(CAST(line_idx AS VARCHAR), 6, '0') AS stem FROM n")
def corpus_cap_per_split(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus.filter_corpus(_lines(spark, d), "French", 13).select("line_id", "split").distinct()
    return corpus.number_lines(kept, ["train", "validation", "test"], ["line_id"], max_per_split=50)


_SPLITS = f"WITH s AS (SELECT DISTINCT line_id, {SPLIT_SQL} AS split FROM corpus_lines), c AS (SELECT split, count(*) AS n FROM s GROUP BY split)"


@query(_SPLITS + " SELECT string_agg(split || '=' || n, ',' ORDER BY split) AS splits, CAST(sum(n) AS BIGINT) AS total FROM c WHERE split IS NOT NULL")
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = corpus.split_manifest(_lines(spark, d).select("line_id", "split").distinct())
    entries = F.array_sort(F.map_entries("splits"))
    return m.select(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("splits"), "total")


@query(f"WITH s AS (SELECT DISTINCT line_id, {SPLIT_SQL} AS split FROM corpus_lines) SELECT split, count(*) AS n, CAST(grouping(split) AS INTEGER) AS is_total FROM s GROUP BY ROLLUP (split)")
def split_totals(spark: SparkSession, d: str) -> DataFrame:
    return corpus.split_totals(_lines(spark, d).select("line_id", "split").distinct())


@query(f"""WITH s AS (SELECT DISTINCT line_id, {SPLIT_SQL} AS split, text FROM corpus_lines WHERE text IS NOT NULL), w AS (SELECT split, length(text) AS c, len({WORDS_SQL("text")}) AS w FROM s)
SELECT split, count(*) AS n_lines, CAST(sum(c) AS BIGINT) AS n_chars, min(c) AS min_chars, max(c) AS max_chars, sum(c) / count(*) AS mean_chars, CAST(sum(w) AS BIGINT) AS n_words, max(w) AS max_words FROM w GROUP BY split""")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.length_stats(_lines(spark, d).select("line_id", "split", "text").distinct(), ["split"])


@query("""WITH s AS (SELECT DISTINCT line_id, text FROM corpus_lines WHERE text IS NOT NULL), c AS (SELECT length(text) AS c FROM s),
e AS (SELECT min(c) AS lo, max(c) AS hi, greatest(CAST(ceil((max(c) - min(c) + 1) / 40) AS BIGINT), 1) AS w FROM c)
SELECT CAST((c - lo) // w AS BIGINT) AS bin, min(lo + ((c - lo) // w) * w) AS low, min(lo + ((c - lo) // w + 1) * w - 1) AS high, count(*) AS n FROM c, e GROUP BY 1""")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return corpus.length_histogram(_lines(spark, d).select("line_id", "text").distinct())


_CHARS = "WITH s AS (SELECT DISTINCT line_id, text FROM corpus_lines WHERE text IS NOT NULL), c AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM s), f AS (SELECT ch, count(*) AS n FROM c GROUP BY ch)"


@query(_CHARS + " SELECT * FROM f")
def char_frequency(spark: SparkSession, d: str) -> DataFrame:
    return corpus.char_frequency(_lines(spark, d).select("line_id", "text").distinct())


@query(_CHARS + " SELECT * FROM f WHERE unicode(ch) > 127 ORDER BY n DESC, ch LIMIT 20")
def special_char_top20(spark: SparkSession, d: str) -> DataFrame:
    return corpus.top_chars(corpus.char_frequency(_lines(spark, d).select("line_id", "text").distinct(), only_special=True))


@query("""WITH i AS (SELECT DISTINCT stem, octet_length(im.bytes) AS n_bytes FROM corpus_lines WHERE octet_length(im.bytes) > 0), t AS (SELECT DISTINCT stem, text FROM corpus_lines WHERE text IS NOT NULL)
SELECT i.stem, n_bytes, coalesce(text, '') AS text FROM i LEFT JOIN t ON i.stem = t.stem ORDER BY i.stem LIMIT 8""")
def sample_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "corpus_lines")
    images = lines.select("stem", F.octet_length("im.bytes").cast("bigint").alias("n_bytes")).where("n_bytes > 0").distinct()
    return corpus.sample_lines(images, lines.where("text is not null").select("stem", "text").distinct())


@query("SELECT DISTINCT manifest_id, e.key AS split, CAST(e.value AS INTEGER) AS n FROM (SELECT manifest_id, unnest(map_entries(splits)) AS e FROM dataset_manifest)")
def manifest_splits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_manifest").select("manifest_id", F.explode("splits").alias("split", "n")).distinct()


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY written_at DESC NULLS LAST, total DESC) AS k FROM dataset_manifest)
SELECT manifest_id, total, CAST(list_sum(map_values(splits)) AS BIGINT) AS counted, filter_on.language AS language FROM r WHERE k = 1""")
def manifest_last_issue(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by(F.struct("total", "splits", "filter_on"), F.struct("written_at", "total"))
    m = table(spark, d, "dataset_manifest").groupBy("manifest_id").agg(last.alias("m"))
    counted = F.aggregate(F.map_values("m.splits"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return m.select("manifest_id", "m.total", counted.alias("counted"), "m.filter_on.language")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """The exchange that a following group or distinct on the keys needs anyway, in a fixed number of partitions.

    Edit distances cost far more than their bytes tell; adaptive execution would merge them into one task.
    """
    return df.repartition(parallelism(df.sparkSession), *keys)


# --- text ------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    t = table(spark, d, "run_lines").select("run_id", "line_index", *(columns or ("text_raw",)))
    return _spread(t, "run_id", "line_index").distinct()


_RAW = "SELECT DISTINCT run_id, line_index, text_raw AS t FROM run_lines"
_COLLAPSE = lambda c: f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"


@query(f"SELECT run_id, line_index, translate(t, 'vV', 'uU') AS uv, translate(t, 'jJ', 'iI') AS ij, translate(t, 'ſ', 's') AS long_s FROM ({_RAW})")
def fold_rules(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text_raw")
    return _texts(spark, d).select("run_id", "line_index", tx.fold_uv(t).alias("uv"), tx.fold_ij(t).alias("ij"), tx.fold_long_s(t).alias("long_s"))


@query(f"SELECT run_id, line_index, {_COLLAPSE('t')} AS text FROM ({_RAW})")
def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("run_id", "line_index", tx.collapse_whitespace(F.col("text_raw")).alias("text"))


_UV, _IJ, _S = (lambda c: f"translate({c}, 'vV', 'uU')"), (lambda c: f"translate({c}, 'jJ', 'iI')"), (lambda c: f"translate({c}, 'ſ', 's')")
_NORMAL = lambda c: _COLLAPSE(_S(_IJ(_UV(f"nfc_normalize({c})"))))


@query(f"SELECT run_id, line_index, {_NORMAL('t')} AS text FROM ({_RAW})")
def normalize_for_cer(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("run_id", "line_index", tx.normalize_for_cer(F.col("text_raw")).alias("text"))


@query(f"""WITH r AS ({_RAW}) SELECT run_id, line_index, 0 AS ord, 'raw' AS step, t AS text FROM r UNION ALL SELECT run_id, line_index, 1, '+nfc', nfc_normalize(t) FROM r
UNION ALL SELECT run_id, line_index, 2, '+u/v', {_UV("nfc_normalize(t)")} FROM r UNION ALL SELECT run_id, line_index, 3, '+i/j', {_IJ(_UV("nfc_normalize(t)"))} FROM r
UNION ALL SELECT run_id, line_index, 4, '+long_s', {_S(_IJ(_UV("nfc_normalize(t)")))} FROM r UNION ALL SELECT run_id, line_index, 5, '+spaces', {_NORMAL("t")} FROM r""")
def normalize_steps(spark: SparkSession, d: str) -> DataFrame:
    s = _texts(spark, d).select("run_id", "line_index", F.explode(tx.normalize_steps(F.col("text_raw"))).alias("s"))
    return s.select("run_id", "line_index", "s.ord", "s.step", "s.text")


def _expand_sql(c: str) -> str:
    c = f"nfc_normalize(replace(replace(replace(replace({c}, '⁊', 'et'), 'ꝑ', 'per'), 'ꝓ', 'pro'), 'ꝙ', 'qui'))"
    for a, b in zip("ãẽĩõũÃẼĨÕŨ", ("an", "en", "in", "on", "un", "An", "En", "In", "On", "Un")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query(f"SELECT run_id, line_index, {_expand_sql('t')} AS text FROM ({_RAW})")
def expand_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("run_id", "line_index", tx.expand_abbreviations(F.col("text_raw")).alias("text"))


@query(r"SELECT run_id, line_index, len(regexp_extract_all(t, '[⁊ꝑꝓꝙ]')) + len(regexp_extract_all(nfc_normalize(t), '[ãẽĩõũñỹṽÃẼĨÕŨÑỸṼ\x{303}\x{363}-\x{36f}]')) AS n FROM (" + _RAW + ")")
def residual_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("run_id", "line_index", tx.residual_abbreviations(F.col("text_raw")).alias("n"))


# --- error rates -----------------------------------------------------------------------------------

_PAIRS = "SELECT DISTINCT run_id, line_index, text_gt AS ref, coalesce(text_raw, '') AS hyp FROM run_lines WHERE text_gt IS NOT NULL"
_WORDS = f"SELECT *, {WORDS_SQL('ref')} AS a, {WORDS_SQL('hyp')} AS b FROM ({_PAIRS})"
_SIGNS = "SELECT *, list_distinct(list_concat(a, b)) AS v FROM (" + _WORDS + ")"
_DIST = f"""SELECT run_id, line_index, ref, hyp, {distance_sql('ref', 'hyp')} AS d_chars, length(ref) AS n_chars, len(a) AS n_words,
levenshtein(coalesce(array_to_string(list_transform(a, lambda x: chr(32 + CAST(list_position(v, x) AS INTEGER))), ''), ''), coalesce(array_to_string(list_transform(b, lambda x: chr(32 + CAST(list_position(v, x) AS INTEGER))), ''), '')) AS d_words, len(b) AS m_words FROM ({_SIGNS})"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _texts(spark, d, "text_gt", "text_raw").where("text_gt is not null")
    return p.select("run_id", "line_index", F.col("text_gt").alias("ref"), F.coalesce("text_raw", F.lit("")).alias("hyp"))


@query(f"SELECT run_id, line_index, CASE WHEN n_chars > 0 THEN d_chars / n_chars WHEN length(hyp) = 0 THEN 0.0 ELSE 1.0 END AS cer, CASE WHEN n_words > 0 THEN d_words / n_words WHEN m_words = 0 THEN 0.0 ELSE 1.0 END AS wer FROM ({_DIST})")
def line_error_rates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.line_error_rates(_pairs(spark, d)).select("run_id", "line_index", "cer", "wer")


@query(f"SELECT run_id, line_index, CASE WHEN n_chars > 0 THEN d_chars / n_chars WHEN length(hyp) = 0 THEN 0.0 ELSE 1.0 END AS cer FROM ({_DIST}) ORDER BY cer DESC, run_id, line_index LIMIT 10")
def worst_predictions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.worst_predictions(_pairs(spark, d), 10, ["run_id", "line_index"]).select("run_id", "line_index", "cer")


_MICRO = "sum(d_chars) / sum(n_chars) AS cer, sum(d_words) / sum(n_words) AS wer, count(*) AS n_lines, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(n_words) AS BIGINT) AS n_words"


@query(f"SELECT {_MICRO} FROM ({_DIST})")
def corpus_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.corpus_metrics(_pairs(spark, d))


@query(f"SELECT manuscript, {_MICRO} FROM ({_DIST}) p JOIN (SELECT DISTINCT run_id, manuscript FROM runs) r ON p.run_id = r.run_id GROUP BY manuscript")
def corpus_metrics_by_manuscript(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "runs").select("run_id", "manuscript").distinct()
    return metrics.corpus_metrics(_pairs(spark, d).join(owners, "run_id"), by=["manuscript"])


@query(f"""WITH p AS ({_PAIRS}), n AS (SELECT {_NORMAL("ref")} AS ref, {_NORMAL("hyp")} AS hyp FROM p) SELECT 'raw' AS stage, sum({distance_sql("ref", "hyp")}) / sum(length(ref)) AS cer FROM p
UNION ALL SELECT 'normalized', sum({distance_sql("ref", "hyp")}) / sum(length(ref)) FROM n""")
def cer_before_after(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumns({"r": tx.normalize_for_cer(F.col("ref")), "h": tx.normalize_for_cer(F.col("hyp"))})
    both = p.select(F.explode(F.array(F.struct(F.lit("raw").alias("stage"), F.col("ref"), F.col("hyp")), F.struct(F.lit("normalized").alias("stage"), F.col("r").alias("ref"), F.col("h").alias("hyp")))).alias("x"))
    return metrics.corpus_metrics(both.select("x.*"), by=["stage"]).select("stage", "cer")


_A, _B, _C = metrics.FACTORS
_M = metrics.MODULUS
_TIMES = " + ".join(f"(CASE WHEN u >= {p} THEN 1 ELSE 0 END)" for p in metrics.POISSON)


@query(f"""WITH d AS ({_DIST}), r AS (SELECT d.*, rep, (((run_id * 100003 + line_index) % {_M}) * {_A} + rep * {_B} + 11) % {_M} * {_C} % {_M} AS h FROM d, (SELECT unnest(range(1000)) AS rep)),
u AS (SELECT *, CAST(xor(h, h >> 15) * {_A} % {_M} AS DOUBLE) / {_M} AS u FROM r), m AS (SELECT *, {_TIMES} AS m FROM u),
s AS (SELECT rep, sum(d_chars * m) / sum(n_chars * m) AS cer, sum(d_words * m) / sum(n_words * m) AS wer FROM m GROUP BY rep)
SELECT 1000 AS n_bootstrap, CAST(0.05 AS DOUBLE) AS alpha, list_sort(list(cer))[26] AS cer_lo, list_sort(list(cer))[975] AS cer_hi, list_sort(list(wer))[26] AS wer_lo, list_sort(list(wer))[975] AS wer_hi FROM s""")
def bootstrap_cer_ci(spark: SparkSession, d: str) -> DataFrame:
    distances = metrics.pair_distances(_pairs(spark, d))
    return metrics.bootstrap_ci(distances, F.col("run_id") * 100003 + F.col("line_index"))


# --- lexicon ---------------------------------------------------------------------------------------

_LEX = f"SELECT DISTINCT lower(regexp_replace(form, '^{SP}+|{SP}+$', '', 'g')) AS form FROM lexicon WHERE regexp_matches(lower(regexp_replace(form, '^{SP}+|{SP}+$', '', 'g')), '^\\p{{L}}+$') AND length(lower(regexp_replace(form, '^{SP}+|{SP}+$', '', 'g'))) >= 2"
_AFFIX = r"(?s)^([^\p{L}\p{N}_]*)(.*?)([^\p{L}\p{N}_]*)$"
_TOKENS = f"SELECT run_id, line_index, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token FROM (SELECT run_id, line_index, {WORDS_SQL('t')} AS w FROM ({_RAW}) WHERE t IS NOT NULL)"
_SPLITTED = f"SELECT *, regexp_extract(token, '{_AFFIX}', 1) AS bef, regexp_extract(token, '{_AFFIX}', 3) AS aft, lower(regexp_extract(token, '{_AFFIX}', 2)) AS word FROM ({_TOKENS})"
_LEXICON = f"WITH lex AS ({_LEX}), tok AS ({_SPLITTED}), unk AS (SELECT word, count(*) AS n FROM tok WHERE word <> '' AND word NOT IN (SELECT form FROM lex) GROUP BY word)"
#: Only letters of forms can be equal to a form's, so all others of a word are one sign.
_SIGN = lambda c: f"translate(regexp_replace({c}, '[^' || v || ']', '#', 'g'), v || '#', '{_BYTES}')"
_CANDS = f""", sg AS (SELECT array_to_string(list_distinct(flatten(list({CHARS_SQL("form")}))), '') AS v FROM lex), cw AS (SELECT word, {_SIGN("word")} AS c, length(word) AS k FROM unk, sg), cf AS (SELECT form, {_SIGN("form")} AS c, length(form) AS k FROM lex, sg),
near AS (SELECT word, form, CAST(levenshtein(cw.c, cf.c) AS INTEGER) AS distance FROM cw JOIN cf ON cf.k BETWEEN cw.k - 2 AND cw.k + 2 WHERE levenshtein(cw.c, cf.c) <= 2),
cand AS (SELECT *, CAST(row_number() OVER (PARTITION BY word ORDER BY distance, form) AS INTEGER) AS rank FROM near)"""


def _lex(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.load_lexicon(table(spark, d, "lexicon"))


def _unknown(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.unknown_words(lexicon.words_of(_texts(spark, d), ["run_id", "line_index"], "text_raw"), _lex(spark, d))


@query(_LEX)
def lexicon_load(spark: SparkSession, d: str) -> DataFrame:
    return _lex(spark, d)


@query(_LEXICON + " SELECT * FROM unk")
def unknown_words(spark: SparkSession, d: str) -> DataFrame:
    return _unknown(spark, d)


@query(_LEXICON + _CANDS + " SELECT * FROM cand WHERE rank <= 10")
def lexicon_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.candidates(_unknown(spark, d), _lex(spark, d))


_CORRECT = ", fix AS (SELECT tok.*, CASE WHEN best IS NOT NULL THEN bef || best || aft ELSE token END AS nw, best IS NOT NULL AS ch FROM tok LEFT JOIN best ON tok.word = best.word) SELECT run_id, line_index, string_agg(nw, ' ' ORDER BY pos) AS corrected, CAST(count(*) FILTER (ch) AS BIGINT) AS n_changes FROM fix GROUP BY run_id, line_index"


@query(_LEXICON + _CANDS + ", best AS (SELECT word, form AS best FROM cand WHERE rank = 1)" + _CORRECT)
def correct_lines(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.correct_lines(_texts(spark, d), ["run_id", "line_index"], "text_raw", _lex(spark, d)).drop("changes")


@query(_LEXICON + _CANDS + ", kn AS (SELECT word AS form, count(*) AS n FROM tok GROUP BY word), sc AS (SELECT cand.*, coalesce(n, 0) AS n FROM cand LEFT JOIN kn ON cand.form = kn.form WHERE rank <= 10), best AS (SELECT word, form AS best FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, rank) AS k FROM sc) WHERE k = 1)" + _CORRECT)
def correct_lines_scored(spark: SparkSession, d: str) -> DataFrame:
    words = lexicon.words_of(_texts(spark, d), ["run_id", "line_index"], "text_raw")
    counts = words.groupBy(F.col("word").alias("form")).agg(F.count(F.lit(1)).alias("n"))
    return lexicon.correct_lines(_texts(spark, d), ["run_id", "line_index"], "text_raw", _lex(spark, d), lexicon.by_frequency(counts)).drop("changes")


def _before(tokens: pd.Series, place: pd.Series, found: pd.Series) -> pd.Series:
    """The candidate that begins as the token before it; null if none does."""
    return pd.Series([next((c for c in cs if i > 0 and t[i - 1][:1] and c[:1] == t[i - 1][:1].lower()), None) for t, i, cs in zip(tokens, place, found)], dtype=object)


@query(_LEXICON + _CANDS + f""", near_by AS (SELECT tok.*, lag(token) OVER (PARTITION BY run_id, line_index ORDER BY pos) AS last FROM tok),
best AS (SELECT run_id, line_index, pos, coalesce(arg_min(form, rank) FILTER (form[1] = lower(last[1])), arg_min(form, rank)) AS best, string_agg(form, ' ' ORDER BY rank) AS cands FROM near_by n JOIN cand ON n.word = cand.word WHERE rank <= 10 GROUP BY run_id, line_index, pos),
fix AS (SELECT tok.*, CASE WHEN best IS NOT NULL THEN bef || best || aft ELSE token END AS nw, best, cands FROM tok LEFT JOIN best ON tok.run_id = best.run_id AND tok.line_index = best.line_index AND tok.pos = best.pos)
SELECT run_id, line_index, string_agg(nw, ' ' ORDER BY pos) AS corrected, CAST(count(*) FILTER (best IS NOT NULL) AS BIGINT) AS n_changes, coalesce(string_agg(pos || ':' || cands, '; ' ORDER BY pos) FILTER (best IS NOT NULL), '') AS candidates FROM fix GROUP BY run_id, line_index""")
def correct_lines_context(spark: SparkSession, d: str) -> DataFrame:
    """Corrections chosen with the token before the word."""
    fixed = lexicon.correct_lines(_texts(spark, d), ["run_id", "line_index"], "text_raw", _lex(spark, d), context=_before)
    shown = F.array_join(F.transform("changes", lambda x: F.concat(x["pos"].cast("string"), F.lit(":"), F.array_join(x["candidates"], " "))), "; ")
    return fixed.select("run_id", "line_index", "corrected", "n_changes", shown.alias("candidates"))


# --- training --------------------------------------------------------------------------------------

_EPOCHS = "SELECT event_type AS curve, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch, (sum(CAST(floor(value * 100) AS BIGINT)) % 1000) / 1000 AS cer FROM events GROUP BY 1, 2"


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    """A curve for each event type, an epoch for each day, a rate from the day's values."""
    e = table(spark, d, "events").select(F.col("event_type").alias("curve"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch"), F.floor(F.col("value") * 100).alias("v"))
    return e.groupBy("curve", "epoch").agg((F.sum("v") % 1000 / 1000).alias("cer"))


@query(f"""WITH e AS ({_EPOCHS}), m AS (SELECT *, coalesce(min(cer) OVER (PARTITION BY curve ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE) AS m FROM e),
b AS (SELECT *, cer < m AS better, sum((cer < m)::INT) OVER (PARTITION BY curve ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS isl FROM m),
s AS (SELECT *, row_number() OVER (PARTITION BY curve, isl ORDER BY epoch) - CASE WHEN isl > 0 THEN 1 ELSE 0 END AS stall FROM b)
SELECT curve, CAST(arg_min(epoch, cer) FILTER (better) AS INTEGER) AS best_epoch, min(cer) FILTER (better) AS best_cer, min(epoch) FILTER (stall >= 3) AS stop_epoch, coalesce(string_agg(epoch, ',' ORDER BY epoch) FILTER (NOT better), '') AS stalled FROM s GROUP BY curve""")
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    return training.early_stopping(_epochs(spark, d), 3, by=["curve"]).withColumn("stalled", F.array_join("stalled", ","))


@query(f"SELECT curve, epoch, value FROM (SELECT curve, epoch, 1 - cer AS value, row_number() OVER (PARTITION BY curve ORDER BY 1 - cer DESC, epoch) AS k FROM ({_EPOCHS})) WHERE k = 1")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return training.best_epoch(_epochs(spark, d).withColumn("accuracy", 1 - F.col("cer")), "accuracy", by=["curve"])


_SHIFT = lambda c, true: f"(({c}) + (CAST({true} AS DOUBLE) - max({c}) OVER ()))"


@query(f"SELECT curve, epoch, {_SHIFT('1 - cer', 0.95)} AS accuracy, 1 - {_SHIFT('1 - cer', 0.95)} AS cer FROM ({_EPOCHS})")
def curve_anchor(spark: SparkSession, d: str) -> DataFrame:
    e = _epochs(spark, d).select("curve", "epoch", (1 - F.col("cer")).alias("accuracy"))
    return training.anchor_curve(e, 0.95)


@query(f"SELECT curve, epoch, round({_SHIFT('1 - cer', 0.95533)}, 5) AS accuracy, round(1 - round({_SHIFT('1 - cer', 0.95533)}, 5), 5) AS cer, round({_SHIFT('cer', 0.764)}, 5) AS word_accuracy, round(1 - round({_SHIFT('cer', 0.764)}, 5), 5) AS wer FROM ({_EPOCHS})")
def curve_anchor_words(spark: SparkSession, d: str) -> DataFrame:
    e = _epochs(spark, d).select("curve", "epoch", (1 - F.col("cer")).alias("accuracy"), F.col("cer").alias("word_accuracy"))
    return training.anchor_curve(e, 0.95533, 0.764, 5)


@query(f"SELECT curve, epoch, 1 - cer AS accuracy, round(cer, 4) AS cer, CAST(1000 AS BIGINT) AS chars, CAST(round(cer * 1000) AS BIGINT) AS errors FROM (SELECT curve, epoch, cer FROM ({_EPOCHS}))")
def parse_train_log(spark: SparkSession, d: str) -> DataFrame:
    e = _epochs(spark, d)
    line = F.format_string("[12.3] Accuracy report (%d) %s 1000 %d", F.col("epoch"), (1 - F.col("cer")).cast("string"), F.round(F.col("cer") * 1000).cast("bigint"))
    logs = e.groupBy("curve").agg(F.array_join(F.array_sort(F.collect_list(F.concat(line, F.lit("\nnoise")))), "\n").alias("value"))  # an epoch a day
    return training.parse_log(logs, by=["curve"])


@query(f"SELECT epoch, 1 - c AS accuracy, round(c, 6) AS cer, c AS word_accuracy, round(1 - c, 6) AS wer, 1 - c AS best_val_metric FROM (SELECT epoch, arg_max(cer, curve) AS c FROM ({_EPOCHS}) GROUP BY epoch)")
def stage_log_last_wins(spark: SparkSession, d: str) -> DataFrame:
    a, w = (1 - F.col("cer")).cast("string"), F.col("cer").cast("string")
    line = F.concat(F.lit("\x1b[31mstage "), F.col("epoch"), F.lit("/∞ ━━━━ 120/120 0:01:40 \x1b[0m val_accuracy: "), a, F.lit(" val_word_accuracy: "), w, F.lit(" early_stopping: 3/10 "), a)
    return training.parse_stage_log(_epochs(spark, d).select(line.alias("value"), F.col("curve").alias("line_no")))


# --- geometry --------------------------------------------------------------------------------------

#: Boxes of an order: true ones from its odd lines, found ones from all, shifted; a page is an order, a manuscript 500 part keys.
_BOX = "SELECT l_orderkey AS page, l_linenumber AS i, CAST(l_partkey % 200 AS INTEGER) AS x0, CAST(l_suppkey % 90 AS INTEGER) AS y0, CAST(l_partkey % 200 + 40 + l_quantity AS INTEGER) AS x1, CAST(l_suppkey % 90 + 60 AS INTEGER) AS y1 FROM lineitem"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    x0, y0 = (F.col("l_partkey") % 200).cast("int"), (F.col("l_suppkey") % 90).cast("int")
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("i"), x0.alias("x0"), y0.alias("y0"), (F.col("l_partkey") % 200 + 40 + F.col("l_quantity")).cast("int").alias("x1"), (y0 + 60).alias("y1"))


@query(f"SELECT page, i, 3 AS n, x0 || '/' || y0 || ' ' || x1 || '/' || y1 || ' ' || x1 || '/' || y0 AS points FROM ({_BOX})")
def points_parse(spark: SparkSession, d: str) -> DataFrame:
    s = F.format_string("%d,%d %d.9 %d  %d,%d 7", "x0", "y0", "x1", "y1", "x1", "y0")
    p = geo.points(s)
    shown = F.array_join(F.transform(p, lambda q: F.concat_ws("/", q[0], q[1])), " ")
    return _boxes(spark, d).select("page", "i", F.size(p).alias("n"), shown.alias("points"))


@query(f"SELECT page, i, x0, y0 - 20 AS y0, x1, y1 + 20 AS y1 FROM ({_BOX})")
def baseline_bbox(spark: SparkSession, d: str) -> DataFrame:
    line = F.array(F.array("x0", "y1"), F.array("x1", "y0"))
    return _boxes(spark, d).select("page", "i", geo.bbox(geo.baseline_to_box(line)).alias("b")).select("page", "i", "b.*")


def _iou_sql(a: str, b: str) -> str:
    w, h = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))", f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    both = f"CAST({w} AS DOUBLE) * {h}"
    union = f"(CAST({a}.x1 - {a}.x0 AS DOUBLE) * ({a}.y1 - {a}.y0) + CAST({b}.x1 - {b}.x0 AS DOUBLE) * ({b}.y1 - {b}.y0) - {both})"
    return f"CASE WHEN {w} <= 0 OR {h} <= 0 THEN 0.0 ELSE {both} / {union} END"


@query(f"WITH b AS ({_BOX}) SELECT t.page, t.i, {_iou_sql('t', 'f')} AS iou FROM b t JOIN b f ON t.page = f.page AND f.i = t.i + 1")
def polygon_iou(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    corner = lambda s: F.array(F.array(f"{s}.x0", f"{s}.y0"), F.array(f"{s}.x1", f"{s}.y1"))
    j = b.alias("t").join(b.withColumn("i", F.col("i") - 1).alias("f"), ["page", "i"])
    return j.select("page", "i", geo.polygon_iou(corner("t"), corner("f")).alias("iou"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with true and found boxes; an order has a few lines."""
    b = _boxes(spark, d)
    box = F.struct("x0", "y0", "x1", "y1")
    moved = F.struct((F.col("x0") + 7).alias("x0"), (F.col("y0") + 5).alias("y0"), (F.col("x1") + 7).alias("x1"), (F.col("y1") + 5).alias("y1"))
    pick = lambda cond, s: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("i", s.alias("b"))))), lambda x: x["b"])
    return _spread(b, "page").groupBy("page").agg(pick(F.col("i") % 2 == 1, box).alias("truth"), pick(F.col("i") > 1, moved).alias("found"))


_GREEDY = f"""WITH RECURSIVE b AS ({_BOX}), t AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY i, b.x0, b.y0, b.x1, b.y1) AS k, x0, y0, x1, y1 FROM b WHERE i % 2 = 1),
f AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY i, b.x0, b.y0, b.x1, b.y1) AS j, x0 + 7 AS x0, y0 + 5 AS y0, x1 + 7 AS x1, y1 + 5 AS y1 FROM b WHERE i > 1),
m AS (SELECT t.page, t.k, list(struct_pack(j := f.j, v := {_iou_sql("t", "f")}) ORDER BY f.j) FILTER (f.j IS NOT NULL) AS c FROM t LEFT JOIN f ON t.page = f.page GROUP BY t.page, t.k),
g AS (SELECT page, 0::BIGINT AS k, []::BIGINT[] AS used, 0::DOUBLE AS v FROM (SELECT DISTINCT page FROM t)
UNION ALL SELECT page, k, CASE WHEN best.v > 0 THEN list_append(used, best.j) ELSE used END, coalesce(best.v, 0.0) FROM (
  SELECT m.page, m.k, g.used, list_sort(list_transform(list_filter(coalesce(m.c, []), lambda x: NOT list_contains(g.used, x.j)), lambda x: struct_pack(v := x.v, nj := -x.j, j := x.j)), 'DESC')[1] AS best FROM g JOIN m ON m.page = g.page AND m.k = g.k + 1)),
s AS (SELECT page, k, v FROM g WHERE k > 0), a AS (SELECT DISTINCT page FROM b)
"""


@query(_GREEDY + "SELECT a.page, coalesce(string_agg(CAST(round(v, 6) AS DECIMAL(9, 6)), ' ' ORDER BY k), '') AS ious FROM a LEFT JOIN s ON a.page = s.page GROUP BY a.page")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).select("page", geo.greedy_ious(F.col("truth"), F.col("found")).alias("v"))
    return p.select("page", F.array_join(F.transform("v", lambda v: F.round(v, 6).cast("decimal(9,6)").cast("string")), " ").alias("ious"))


@query(_GREEDY + ", p AS (SELECT a.page, coalesce(avg(v), 0.0) AS m, count(v) AS n FROM a LEFT JOIN s ON a.page = s.page GROUP BY a.page) SELECT page % 50 AS manuscript, round(avg(m), 6) AS iou_mean, CAST(sum(n) AS BIGINT) AS n_lines, count(*) AS pages FROM p GROUP BY 1")
def manuscript_iou(spark: SparkSession, d: str) -> DataFrame:
    pages = segmentation.page_iou(_pages(spark, d)).withColumn("manuscript", F.col("page") % 50)
    return segmentation.manuscript_iou(pages).select("manuscript", F.round("iou_mean", 6).alias("iou_mean"), "n_lines", "pages")


@query(f"WITH b AS ({_BOX}), t AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY i, b.x0, b.y0, b.x1, b.y1) AS k FROM b WHERE i % 2 = 1), f AS (SELECT page, x0 + 7 AS x0, y0 + 5 AS y0, x1 + 7 AS x1, y1 + 5 AS y1, row_number() OVER (PARTITION BY page ORDER BY i, b.x0, b.y0, b.x1, b.y1) AS k FROM b WHERE i > 1), v AS (SELECT {_iou_sql('t', 'f')} AS v FROM t JOIN f ON t.page = f.page AND t.k = f.k) SELECT round(avg(v), 6) AS iou_mean, round(avg((v >= 0.75)::INT::DOUBLE), 6) AS iou_share, count(*) AS n FROM v")
def iou_positional(spark: SparkSession, d: str) -> DataFrame:
    corners = lambda c: F.transform(c, lambda b: F.array(F.array(b["x0"], b["y0"]), F.array(b["x1"], b["y1"])))
    p = _pages(spark, d).select(corners("truth").alias("truth"), corners("found").alias("found"))
    s = segmentation.positional_stats(p)
    return s.select(F.round("iou_mean", 6).alias("iou_mean"), F.round("iou_share", 6).alias("iou_share"), "n")


# --- pages and runs --------------------------------------------------------------------------------


@query("""WITH c AS (SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: least(1.0, 0.6 + abs(x::DOUBLE)))), 4) AS mean_confidence FROM embeddings) SELECT *, mean_confidence < 0.70 AS needs_review FROM c""")
def line_confidence(spark: SparkSession, d: str) -> DataFrame:
    confs = F.transform("embedding", lambda x: F.least(F.lit(1.0), 0.6 + F.abs(x.cast("double"))))
    m = table(spark, d, "embeddings").select("vec_id", runs.mean_confidence(confs).alias("mean_confidence"))
    return m.withColumn("needs_review", runs.needs_review(F.col("mean_confidence")))


@query("""WITH l AS (SELECT DISTINCT * FROM run_lines) SELECT run_id, count(*) AS n_lines, count(*) FILTER (needs_review) AS n_flagged, count(*) FILTER (round(mean_confidence, 4) < 0.70) AS n_low,
count(*) FILTER ((round(mean_confidence, 4) < 0.70) <> needs_review) AS n_disagree, round(avg(mean_confidence), 6) AS mean_confidence FROM l GROUP BY run_id""")
def review_rate(spark: SparkSession, d: str) -> DataFrame:
    return runs.review_rates(table(spark, d, "run_lines").distinct(), ["run_id"]).withColumn("mean_confidence", F.round("mean_confidence", 6))


_L = "SELECT DISTINCT run_id, line_index // 30 AS page, line_index, text_raw, text_gt, mean_confidence, needs_review FROM run_lines WHERE run_id IS NOT NULL AND line_index IS NOT NULL"


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a page number: thirty lines a page."""
    l = table(spark, d, "run_lines").where("run_id is not null and line_index is not null")
    p = l.select("run_id", F.expr("cast(line_index div 30 as int)").alias("page"), "line_index", "text_raw", "text_gt", "mean_confidence", "needs_review")
    return _spread(p, "run_id", "page").distinct()


def _alto_pages(spark: SparkSession, d: str, text: str = "text_raw") -> DataFrame:
    """Page XML written from a field of the lines, thirty a page.

    A line has a string a word and an empty one after the first; lines without text have an empty string alone. Every third page
    nests its lines in a composed block, every fifth has its later lines on a second page element.
    """
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    # References keep white space in attributes from being read as blanks.
    esc_all = lambda c: F.replace(F.replace(F.replace(esc(c), F.lit("\t"), F.lit("&#9;")), F.lit("\n"), F.lit("&#10;")), F.lit("\r"), F.lit("&#13;"))
    glyph = F.when(F.col("mean_confidence").isNotNull(), F.repeat(F.format_string('<Glyph CONTENT="x" GC="%.4f"/>', F.col("mean_confidence")), 2)).otherwise(F.lit(""))
    words = F.split(F.coalesce(text, F.lit("")), " ")
    strings = F.transform(words, lambda w, i: F.concat(F.lit('<String CONTENT="'), esc_all(w), F.lit('">'), F.when(i == 0, glyph).otherwise(F.lit("")), F.lit("</String>"), F.when(i == 0, F.lit('<SP/><String CONTENT=""/>')).otherwise(F.lit(""))))
    line = F.concat(F.lit('<TextLine BASELINE="'), F.format_string("%d %d %d %d", F.lit(10), F.col("line_index") * 50, F.lit(900), F.col("line_index") * 50), F.lit('"><Shape><Polygon POINTS="0 0 9 9"/></Shape>'), F.array_join(strings, ""), F.lit("</TextLine>"))
    in_order = F.array_sort(F.collect_list(F.struct("line_index", line.alias("x"))))
    pages = _paged(spark, d).groupBy("run_id", "page").agg(in_order.alias("b")).withColumn("b", F.transform("b", lambda s: s["x"]))
    head = f'<alto xmlns="{alto.NAMESPACE}"><Description><sourceImageInformation><fileName> p.jpg </fileName></sourceImageInformation></Description><Layout>'
    block = lambda c: F.concat(F.lit('<Page WIDTH="1000" HEIGHT="2000"><PrintSpace>'), F.when(F.col("page") % 3 == 2, F.lit("<ComposedBlock>")).otherwise(F.lit("")), F.lit("<TextBlock>"), F.array_join(c, ""), F.lit("</TextBlock>"), F.when(F.col("page") % 3 == 2, F.lit("</ComposedBlock>")).otherwise(F.lit("")), F.lit("</PrintSpace></Page>"))
    body = F.when(F.col("page") % 5 == 4, F.concat(block(F.slice("b", 1, 10)), block(F.slice("b", 11, 100)))).otherwise(block(F.col("b")))
    return pages.select("run_id", "page", F.concat(F.lit(head), body, F.lit("</Layout></alto>")).alias("xml"))


#: A line's text is its words, empty ones left out, joined by one blank; lines without any are left out.
_XML_TEXT = "array_to_string(list_filter(string_split(coalesce(text_raw, ''), ' '), lambda x: x <> ''), ' ')"
_XML_LINES = f"SELECT run_id, page, line_index, row_number() OVER (PARTITION BY run_id, page ORDER BY line_index) - 1 AS i, {_XML_TEXT} AS t, mean_confidence FROM ({_L})"


@query(f"""SELECT run_id, page, 'p.jpg' AS image, 'line_' || i AS id, t AS text, CASE WHEN mean_confidence IS NULL THEN 0 ELSE 2 END AS n_confidences, coalesce(round(mean_confidence, 4), 0.0) AS mean_confidence, coalesce(round(mean_confidence, 4), 0.0) < 0.7 AS needs_review FROM ({_XML_LINES}) WHERE t <> ''""")
def alto_contract(spark: SparkSession, d: str) -> DataFrame:
    c = alto.to_contract(_alto_pages(spark, d)).select("run_id", "page", F.col("contract.source_image").alias("image"), F.explode("contract.lines").alias("l"))
    return c.select("run_id", "page", "image", "l.id", "l.text", F.size("l.char_confidences").alias("n_confidences"), "l.mean_confidence", "l.needs_review")


@query(f"SELECT run_id, page, coalesce(string_agg(t, chr(10) ORDER BY line_index) FILTER (t <> ''), '') AS text FROM ({_XML_LINES}) GROUP BY run_id, page")
def alto_text(spark: SparkSession, d: str) -> DataFrame:
    return _alto_pages(spark, d).select("run_id", "page", alto.plain_text(F.col("xml")).alias("text"))


@query(f"SELECT run_id, page, count(*) FILTER (t <> '') AS n, coalesce(string_agg(t, ' | ' ORDER BY line_index) FILTER (t <> ''), '') AS text FROM ({_XML_LINES}) GROUP BY run_id, page")
def alto_gt_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = alto.true_lines(F.col("xml"))
    return _alto_pages(spark, d).select("run_id", "page", F.size(lines).cast("bigint").alias("n"), F.array_join(lines, " | ").alias("text"))


@query(f"SELECT run_id, page, count(*) AS n, min(line_index) * 50 AS top, max(line_index) * 50 AS bottom FROM ({_L}) GROUP BY run_id, page")
def alto_baselines(spark: SparkSession, d: str) -> DataFrame:
    b = alto.baselines(F.col("xml"))["baselines"]
    ys = F.transform(b, lambda p: p[0][1])
    return _alto_pages(spark, d).select("run_id", "page", F.size(b).cast("bigint").alias("n"), F.array_min(ys).alias("top"), F.array_max(ys).alias("bottom"))


#: Contracts of seven forms, one for each run by its number; the twin finds their faults by itself.
_CONTRACTS = (
    '{"source_image": "i", "lines": []}',
    '{"source_image": "i", "review_threshold": 0.7}',
    '{"source_image": "i", "lines": [{"id": "x"}, {"id": "y", "text": "t", "char_confidences": [], "mean_confidence": 0.5, "needs_review": true}]}',
    '{"source_image": "i"',
    '{"source_image": null, "lines": []}',
    '{"lines": [], "page": {"width": 1}, "review_threshold": "high"}',
    '{"source_image": "i", "lines": 3}',
)
_REQUIRED = "SELECT unnest(['id', 'text', 'char_confidences', 'mean_confidence', 'needs_review']) AS f"


@query(f"""WITH r AS (SELECT DISTINCT run_id, ({list(_CONTRACTS)})[CAST(run_id % {len(_CONTRACTS)} AS INTEGER) + 1] AS c FROM runs), v AS (SELECT run_id, CAST(c AS JSON) AS j FROM r WHERE json_valid(c)),
e AS (SELECT run_id, unnest(CAST(json_extract(j, '$.lines[*]') AS JSON[])) AS x FROM v)
SELECT run_id, 'invalid json' AS problem FROM r WHERE NOT json_valid(c)
UNION ALL SELECT run_id, 'missing ' || f FROM v, (SELECT unnest(['source_image', 'lines']) AS f) WHERE NOT list_contains(json_keys(j), f)
UNION ALL SELECT DISTINCT run_id, 'line missing ' || f FROM e, ({_REQUIRED}) WHERE NOT list_contains(json_keys(x), f)
UNION ALL SELECT run_id, 'type source_image' FROM v WHERE json_type(j, '$.source_image') <> 'VARCHAR'
UNION ALL SELECT run_id, 'type lines' FROM v WHERE json_type(j, '$.lines') <> 'ARRAY'
UNION ALL SELECT run_id, 'type review_threshold' FROM v WHERE json_type(j, '$.review_threshold') NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT')""")
def contract_validate(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _CONTRACTS)), (F.col("run_id") % len(_CONTRACTS) + 1).cast("int"))
    return alto.contract_violations(table(spark, d, "runs").select("run_id").distinct().withColumn("contract", text), "run_id")


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their lines and true texts, thirty lines a page."""
    p = _paged(spark, d).withColumns({"t": F.coalesce("text_raw", F.lit("")), "g": F.col("text_gt")})
    rows = F.array_sort(F.collect_list(F.struct("line_index", F.struct(F.col("t").alias("text"), "mean_confidence", "needs_review").alias("l"), "g")))
    return p.groupBy("run_id", "page").agg(rows.alias("r")).select("run_id", "page", F.transform("r", lambda x: x["l"]).alias("lines"), F.transform(F.filter("r", lambda x: x["g"].isNotNull()), lambda x: x["g"]).alias("truth"))


_PAGE_TEXTS = f"""WITH l AS (SELECT *, coalesce(text_raw, '') AS t, text_gt AS g FROM ({_L})),
p AS (SELECT run_id, page, count(*) AS n_lines, count(*) FILTER (needs_review) AS n_review, round(avg(coalesce(mean_confidence, 0.0)), 6) AS mean_confidence, string_agg(t, ' ' ORDER BY line_index) AS raw, coalesce(string_agg(t, ' ' ORDER BY line_index) FILTER (NOT coalesce(needs_review, false)), '') AS sure, coalesce(string_agg(g, ' ' ORDER BY line_index), '') AS gt FROM l GROUP BY run_id, page),
q AS (SELECT *, {_NORMAL("sure")} AS nsure, {_NORMAL("gt")} AS ngt FROM p)
"""
_PAGE = f"""{_PAGE_TEXTS}, e AS (SELECT run_id, page, n_lines, n_review, mean_confidence, CASE WHEN gt = '' THEN 0.0 ELSE {distance_sql("raw", "gt")} / length(gt) END AS cer_raw, CASE WHEN gt = '' THEN 0.0 ELSE {distance_sql("sure", "gt")} / length(gt) END AS cer_reviewed,
CASE WHEN ngt = '' THEN 0.0 ELSE {distance_sql("nsure", "ngt")} / length(ngt) END AS cer_normalized FROM q)
"""


@query(_PAGE + "SELECT * FROM e")
def page_eval(spark: SparkSession, d: str) -> DataFrame:
    e = runs.evaluate_pages(_page_lines(spark, d)).drop("n_abbreviations")
    return e.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(_PAGE + "SELECT run_id, count(*) AS n_pages, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(n_review) AS BIGINT) AS n_review, sum(n_review) / sum(n_lines) AS needs_review_rate, round(avg(cer_raw), 6) AS cer_raw, round(avg(cer_normalized), 6) AS cer_normalized FROM e GROUP BY run_id")
def aggregate_pages(spark: SparkSession, d: str) -> DataFrame:
    a = runs.aggregate_pages(runs.evaluate_pages(_page_lines(spark, d)), by=["run_id"])
    return a.select("run_id", "n_pages", "n_lines", "n_review", "needs_review_rate", F.round("cer_raw", 6).alias("cer_raw"), F.round("cer_normalized", 6).alias("cer_normalized"))


#: Rounded to four places by decimals, ties upwards, as binary sums come out a little beside ties.
_PLACES = lambda x: f"CAST(round(CAST(round({x}, 9) AS DECIMAL(18, 9)), 4) AS DOUBLE)"
_XML_PAGE = f"""WITH l AS (SELECT run_id, page, line_index, {_XML_TEXT} AS t, {_XML_TEXT.replace("text_raw", "text_gt")} AS g, coalesce(round(mean_confidence, 4), 0.0) AS mc FROM ({_L})),
p AS (SELECT run_id, page, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (t <> '' AND mc < 0.7) AS n_review, count(*) FILTER (g <> '') AS n_lines_gt, coalesce({_PLACES("avg(mc) FILTER (t <> '')")}, 0.0) AS mean_confidence,
  coalesce(string_agg(t, ' ' ORDER BY line_index) FILTER (t <> ''), '') AS raw, coalesce(string_agg(t, ' ' ORDER BY line_index) FILTER (t <> '' AND mc >= 0.7), '') AS sure, coalesce(string_agg(g, ' ' ORDER BY line_index) FILTER (g <> ''), '') AS gt FROM l GROUP BY run_id, page),
q AS (SELECT *, {_NORMAL("sure")} AS nsure, {_NORMAL("gt")} AS ngt FROM p)
SELECT run_id, page, n_lines, n_lines - n_review AS n_lines_kept, n_lines_gt, n_review, mean_confidence, CASE WHEN gt = '' THEN 0.0 ELSE {_PLACES(distance_sql("raw", "gt") + " / length(gt)")} END AS cer_raw,
  CASE WHEN gt = '' THEN 0.0 ELSE {_PLACES(distance_sql("sure", "gt") + " / length(gt)")} END AS cer_reviewed, CASE WHEN ngt = '' THEN 0.0 ELSE {_PLACES(distance_sql("nsure", "ngt") + " / length(ngt)")} END AS cer_normalized FROM q"""


@query(_XML_PAGE)
def page_eval_alto(spark: SparkSession, d: str) -> DataFrame:
    """Found pages against true ones, both as page XML."""
    pairs = alto.page_pairs(_alto_pages(spark, d), _alto_pages(spark, d, "text_gt"), ["run_id", "page"])
    e = runs.evaluate_contracts(_spread(pairs, "run_id", "page"))
    return e.select("run_id", "page", "n_lines", "n_lines_kept", "n_lines_gt", "n_review", "mean_confidence", "cer_raw", "cer_reviewed", "cer_normalized")


@query("SELECT DISTINCT run_id, CAST(created_at AS VARCHAR) AS created_at, manuscript FROM (SELECT DISTINCT * FROM runs ORDER BY created_at DESC NULLS LAST, run_id DESC LIMIT 100)")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    r = runs.latest_runs(table(spark, d, "runs"))
    return r.select("run_id", F.col("created_at").cast("string").alias("created_at"), "manuscript")


@query("SELECT DISTINCT line_index, text_raw, mean_confidence FROM run_lines WHERE run_id = 1")
def run_lines(spark: SparkSession, d: str) -> DataFrame:
    return runs.lines_of_run(table(spark, d, "run_lines"), 1).select("line_index", "text_raw", "mean_confidence")


@query("WITH r AS (SELECT DISTINCT * FROM runs) SELECT run_id, manuscript, 'cer_raw' AS measure, cer_raw AS cer FROM r WHERE cer_raw IS NOT NULL UNION ALL SELECT run_id, manuscript, 'cer_normalized', cer_normalized FROM r WHERE cer_normalized IS NOT NULL")
def runs_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return runs.unpivot_rates(table(spark, d, "runs"))


@query("SELECT run_id, manuscript, CASE WHEN cer_raw <> 0 AND cer_normalized <> 0 THEN cer_raw - cer_normalized END AS gain FROM (SELECT DISTINCT * FROM runs)")
def run_gain(spark: SparkSession, d: str) -> DataFrame:
    return runs.normalization_gain(table(spark, d, "runs"))


@query("SELECT run_id, cer_normalized <= CAST(0.08 AS DOUBLE) AS reached, CASE WHEN cer_normalized <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, CAST(0.08 AS DOUBLE) / cer_normalized)) END AS progress FROM (SELECT DISTINCT * FROM runs) WHERE cer_normalized IS NOT NULL")
def target_progress(spark: SparkSession, d: str) -> DataFrame:
    return runs.target_progress(table(spark, d, "runs"))


@query("""WITH l AS (SELECT run_id, count(*) AS n FROM (SELECT DISTINCT run_id, line_index FROM run_lines) GROUP BY run_id), r AS (SELECT DISTINCT * FROM runs)
SELECT r.run_id, manuscript, coalesce(n, 0) AS n_lines, row_number() OVER (PARTITION BY manuscript ORDER BY created_at DESC NULLS LAST, r.run_id DESC) = 1 AS is_last FROM r LEFT JOIN l ON r.run_id = l.run_id""")
def runs_with_lines(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "run_lines").select("run_id", "line_index").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    last = F.row_number().over(Window.partitionBy("manuscript").orderBy(F.desc_nulls_last("created_at"), F.desc("run_id"))) == 1
    return table(spark, d, "runs").distinct().join(n, "run_id", "left").select("run_id", "manuscript", F.coalesce("n", F.lit(0)).alias("n_lines"), last.alias("is_last"))
