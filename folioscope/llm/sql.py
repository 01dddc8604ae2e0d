"""SQL twins of the queries that SQL can express on whole tables."""

from folioscope.llm.leaks import BREAK_MARKS

_TERMS = r"""
WITH l AS (SELECT line_id, min(text) AS text FROM corpus_lines WHERE text IS NOT NULL GROUP BY line_id),
n AS (SELECT count(*) AS total FROM l),
t AS (SELECT line_id, unnest(regexp_extract_all(nfc_normalize(lower(text)), '[\p{L}\p{M}]+')) AS term FROM l),
c AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT line_id) AS n_records FROM t GROUP BY term),
m AS (SELECT c.*, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.05 * total THEN 'common' END AS mark FROM c, n)
"""

#: A table of the twins' own: foreign letters, and the ASCII letters they look like (fixed values).
_FOREIGN = ("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХЅІЈ" + "ոսօցՕՏՍ" + "οϲνυιαρτκχγσΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ" + "ɡɑᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "aeopcyxijshdqwABEKMHOPCTYXSIJ" + "nuogOSU" + "ocvuiaptkxyoABEZHIKMNOPTYXC" + "gaABCDEHJKLMPRSTVWZ")
#: Of these, letters that resemble their ASCII letter only loosely; Greek letters that no ASCII letter resembles; ligatures (fixed values).
_LOOSELY, _GREEK_ONLY = "ցυτκχγσ", "βδεζηθλμξπςφψωΓΔΘΛΞΠΣΦΨΩ"
_LIGATURES = dict(zip("ﬀ ﬁ ﬂ ﬃ ﬄ ﬅ ﬆ ĳ Ĳ ⅱ ⅲ ⅳ ⅵ ⅶ ⅷ ⅸ ⅺ ⅻ Ⅱ Ⅲ Ⅳ Ⅵ Ⅶ Ⅷ Ⅸ Ⅺ Ⅻ".split(), "ff fi fl ffi ffl st st ij IJ ii iii iv vi vii viii ix xi xii II III IV VI VII VIII IX XI XII".split()))
_SPACES = r"\t\x{0b}\x{0c}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_HIDDEN = r"\p{Cf}\x{34f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{3164}\x{ffa0}"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
#: A stretch of Greek with a letter that is Greek alone; the letters that surely look like ASCII ones.
_KEPT = rf"[\p{{Greek}}\p{{M}}]*[{_GREEK_ONLY}][\p{{Greek}}\p{{M}}]*"
_ALIKE = "".join(c for c in _FOREIGN[0] if c not in _LOOSELY)


def _fields(name: str) -> str:
    """Form and kinds of one field, step by step."""
    ligatures = "w.c"
    for sign, letters in _LIGATURES.items():
        ligatures = f"replace({ligatures}, '{sign}', '{letters}')"
    mixed = rf"regexp_matches(x, '[A-Za-z]') AND regexp_matches(regexp_replace(x, '{_KEPT}', '', 'g'), '[{_ALIKE}]')"
    whole = rf"regexp_full_match(x, '[{_ALIKE}]+') AND NOT regexp_full_match(x, '[\p{{Greek}}]+')"
    spelled = rf"array_to_string(list_transform(regexp_extract_all(x, '{_KEPT}|[^\p{{Greek}}]+|[\p{{Greek}}\p{{M}}]+'), lambda y: CASE WHEN regexp_full_match(y, '{_KEPT}') THEN y ELSE translate(y, '{_FOREIGN[0]}', '{_FOREIGN[1]}') END), '')"
    word = r"regexp_extract_all(n, '[\p{L}\p{M}\p{Nl}]+|[^\p{L}\p{M}\p{Nl}]+')"
    return rf"""SELECT t, CASE WHEN (regexp_matches(t, '[{_SPACES}]') OR regexp_matches(t, '[{_HIDDEN}]')) AND NOT contains(t, '  ') THEN regexp_replace(o, ' +', ' ', 'g') ELSE o END AS {name},
  list_filter([CASE WHEN nfc_normalize(t) <> t OR nfc_normalize(l) <> l THEN 'decomposed' END, CASE WHEN regexp_matches(t, '[{_HIDDEN}]') THEN 'invisible' END, CASE WHEN regexp_matches(t, '[{"".join(_LIGATURES)}]') THEN 'ligature' END,
    CASE WHEN len(list_filter(ws, lambda x: {mixed})) > 0 THEN 'mixed_script' END, CASE WHEN regexp_matches(t, '[{_SPACES}]') THEN 'space' END, CASE WHEN len(list_filter(ws, lambda x: {whole})) > 0 THEN 'whole_script' END,
    CASE WHEN regexp_matches(t, '[\x{{ff01}}-\x{{ff5e}}]') THEN 'wide' END], lambda x: x IS NOT NULL) AS {name}_kinds
FROM (SELECT t, l, ws, nfc_normalize(array_to_string(list_transform(ws, lambda x: CASE WHEN {mixed} OR {whole} THEN {spelled} ELSE x END), '')) AS o
  FROM (SELECT t, l, {word} AS ws FROM (SELECT t, l, nfc_normalize(l) AS n FROM (SELECT t, {ligatures} AS l FROM (SELECT t, regexp_replace(regexp_replace(translate(t, '{_WIDE[0]}', '{_WIDE[1]}'), '[{_HIDDEN}]', '', 'g'), '[{_SPACES}]', ' ', 'g') AS c FROM (SELECT DISTINCT {name} AS t FROM run_lines WHERE {name} IS NOT NULL)) w))))"""


_NAMES = ("text_raw", "text_normalized", "text_gt")
_FIELDS = "WITH " + ", ".join(f"f_{n} AS ({_fields(n)})" for n in _NAMES)
_FORMS = f"{_FIELDS} SELECT run_id, line_index, " + ", ".join([f"f_{n}.{n}" for n in _NAMES] + [f"coalesce({n}_kinds, []::VARCHAR[]) AS {n}_kinds" for n in _NAMES]) + " FROM (SELECT DISTINCT run_id, line_index, text_raw, text_normalized, text_gt FROM run_lines) r " + " ".join(f"LEFT JOIN f_{n} ON r.{n} = f_{n}.t" for n in _NAMES)
_LOOKALIKES = f"{_FIELDS} " + " UNION ".join(f"SELECT DISTINCT run_id, line_index, '{n}' AS field FROM run_lines JOIN f_{n} ON run_lines.{n} = f_{n}.t WHERE len(list_filter({n}_kinds, lambda x: x <> 'whole_script')) > 0" for n in _NAMES)

#: Signs of the corpus beyond ASCII, each with a one-byte sign, as distances here count bytes.
_CODES = ("éëãẽõſ⁊ꝑ·èàâêûîôçùïœæĩũꝐÉ̃", "\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f")

_OVERLAPS = rf"""
WITH s AS (SELECT DISTINCT line_id, manifest_id, lower(regexp_replace(split, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS split, regexp_replace(translate(text, '{_CODES[0]}', '{_CODES[1]}'), '[^\x00-\x7f]', '?', 'g') AS t FROM corpus_lines WHERE length(text) >= 20),
n AS (SELECT DISTINCT manifest_id, lower(trim(unnest(map_keys(splits)))) AS split FROM dataset_manifest),
e AS (SELECT DISTINCT s.line_id, t, length(t) AS k FROM s JOIN n ON s.manifest_id = n.manifest_id AND s.split = n.split WHERE s.split <> 'train'),
r AS (SELECT DISTINCT line_id, t, length(t) AS k FROM s WHERE split = 'train')
SELECT DISTINCT least(e.line_id, r.line_id) AS line_id_a, greatest(e.line_id, r.line_id) AS line_id_b FROM e JOIN r ON abs(e.k - r.k) <= greatest(e.k, r.k) // 5 WHERE levenshtein(e.t, r.t) <= greatest(e.k, r.k) // 5
"""

_REPORT = _OVERLAPS[: _OVERLAPS.index("SELECT DISTINCT least")].replace("'g')) AS split,", "'g')) AS split, source, text,", 1).replace("DISTINCT s.line_id, t,", "DISTINCT s.line_id, s.split, source, text, t,").replace("DISTINCT line_id, t,", "DISTINCT line_id, source, text, t,") + """,
p AS (SELECT DISTINCT e.line_id AS eval_id, r.line_id AS train_id, e.split AS eval_split, e.source AS eval_source, r.source AS train_source, e.text = r.text AS same FROM e JOIN r ON abs(e.k - r.k) <= greatest(e.k, r.k) // 5 WHERE e.line_id <> r.line_id AND levenshtein(e.t, r.t) <= greatest(e.k, r.k) // 5)
SELECT eval_split, eval_source, count(*) AS n_pairs, count(DISTINCT eval_id) AS n_eval_lines, count(DISTINCT train_id) AS n_train_lines, CAST(sum(CAST(same AS INTEGER)) AS BIGINT) AS n_exact_pairs FROM p GROUP BY eval_split, eval_source"""

_MARKS = "".join("\\" + c if c in "-~=" else c for c in BREAK_MARKS)


def _words(table: str, key: str) -> str:
    joined = rf"regexp_replace(text, '([\p{{L}}\p{{M}}])[{_MARKS}][^\S\n\r]*[\n\r]\s*(\p{{L}})', '\1\2', 'g')"
    folded = rf"replace(translate(lower(regexp_replace(strip_accents(nfc_normalize({joined})), '[\p{{M}}\p{{Cf}}]', '', 'g')), 'vj', 'ui'), 'ſ', 's')"
    return rf"SELECT {key} AS k, regexp_extract_all({folded}, '\p{{L}}+') AS w FROM {table} WHERE text IS NOT NULL"


def _grams(table: str, key: str) -> str:
    return f"SELECT DISTINCT k, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM ({_words(table, key)}) WHERE len(w) >= 8"


_LEAKS = f"SELECT DISTINCT d.k AS doc_id, i.k AS item_id FROM ({_grams('documents', 'doc_id')}) d JOIN ({_grams('eval_items', 'item_id')}) i ON d.g = i.g"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _LOOKALIKES,
        "p1_fields": _FORMS,
        "p2_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p2_frequencies": _TERMS + "SELECT term, n_occurrences, n_records, mark FROM m",
        "p4_found": _OVERLAPS,
        "p4_report": _REPORT,
        "p7_found": _LEAKS,
    }
