"""Column functions on text. All are JVM expressions but composition and decomposition, which Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space as a regular-expression class; equals the split and strip classes of Unicode-aware languages.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Abbreviation signs and what they stand for (fixed values).
ABBREVIATIONS = {"⁊": "et", "ꝑ": "per", "ꝓ": "pro", "ꝙ": "qui"}

def _normal(form: str) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t), na_action="ignore")

    return run


_nfc, _nfd = _normal("NFC"), _normal("NFD")


def nfc(c: Column) -> Column:
    """Canonical composition; null stays null."""
    return _nfc(c)


def nfd(c: Column) -> Column:
    """Canonical decomposition; null stays null."""
    return _nfd(c)


def fold_uv(c: Column) -> Column:
    return F.translate(c, "vV", "uU")


def fold_ij(c: Column) -> Column:
    return F.translate(c, "jJ", "iI")


def fold_long_s(c: Column) -> Column:
    return F.translate(c, "ſ", "s")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def tokens(c: Column) -> Column:
    """Words between white space; an empty or blank text has none, null gives null."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


#: The rules of the error-rate normalisation in order. The first needs Python, the rest are one JVM expression.
NORMALIZATION_STEPS: list[tuple[str, Callable[[Column], Column]]] = [("nfc", nfc), ("u/v", fold_uv), ("i/j", fold_ij), ("long_s", fold_long_s), ("spaces", collapse_whitespace)]


def normalize_for_cer(c: Column, steps: list[tuple[str, Callable[[Column], Column]]] | None = None) -> Column:
    """All rules one after the other."""
    for _, rule in NORMALIZATION_STEPS if steps is None else steps:
        c = rule(c)
    return c


def normalize_steps(c: Column, steps: list[tuple[str, Callable[[Column], Column]]] | None = None) -> Column:
    """Array of (ord, step, text): the raw text, then the text after each further rule."""
    rows = [F.struct(F.lit(0).alias("ord"), F.lit("raw").alias("step"), c.alias("text"))]
    for k, (name, rule) in enumerate(NORMALIZATION_STEPS if steps is None else steps, 1):
        c = rule(c)
        rows.append(F.struct(F.lit(k).alias("ord"), F.lit("+" + name).alias("step"), c.alias("text")))
    return F.array(*rows)


def expand_abbreviations(c: Column, table: dict[str, str] | None = None) -> Column:
    """Signs of `table` (the standard one if none or empty) written out; a vowel with tilde becomes vowel and n; composed."""
    for sign, reading in (table or ABBREVIATIONS).items():
        c = F.replace(c, F.lit(sign), F.lit(reading))
    return nfc(F.regexp_replace(nfd(c), r"([aeiouAEIOU])\x{303}", "$1n"))


def residual_abbreviations(c: Column) -> Column:
    """How many signs of the standard table, tildes and superscript letters are left."""
    signs = "".join(ABBREVIATIONS)
    return (F.regexp_count(c, F.lit(f"[{signs}]")) + F.regexp_count(nfd(c), F.lit(r"[\x{303}\x{363}-\x{36f}]"))).cast("bigint")


def split_affixes(c: Column) -> Column:
    """Struct (before, core, after): signs that are no letters, digits or underscore, taken off both ends of a token."""
    other = r"[^\p{L}\p{N}_]*"
    pattern = rf"(?s)^({other})(.*?)({other})$"
    return F.struct(*[F.regexp_extract(c, pattern, i).alias(n) for i, n in ((1, "before"), (2, "core"), (3, "after"))])


def strip_ansi(c: Column) -> Column:
    """Without terminal colour sequences."""
    return F.regexp_replace(c, r"\x1b\[[0-9;]*[A-Za-z]", "")


def label_before_bracket(c: Column) -> Column:
    return F.trim(F.substring_index(c, "(", 1))


def percent(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", c.cast("double") * 100)


def non_blank_lines(c: Column) -> Column:
    """Lines of a text that hold more than white space."""
    return F.size(F.filter(F.split(c, "\n"), lambda x: strip(x) != "")).cast("bigint")
