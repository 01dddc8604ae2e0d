"""Problem 1: texts that look the same but are coded differently, into one consistent form.

Method: every letter resolves to the scripts it can be spelled in, its own and those of the letters that look
like it. For every token the sets of its letters are intersected. A token whose letters, as coded, have no script in common
is a mixed-script confusable; one of a single foreign script whose letters all look Latin is a whole-script
confusable. The script that all letters share is selected, of several the one most letters of the text have, and
the token is spelled in it. What remains is plain normalisation: wide forms, ligatures, composition, spaces, invisible signs.

Letters that resemble an ASCII letter only loosely count if the sure ones leave no script to all letters. In a token that no script can
spell, such as two words run together, stretches of one script stay that have a letter of this script alone; the others beside ASCII letters become Latin.

Signs that read or look differently stay: long s, Tironian et, barred p, the middle dot, dashes, q with
tilde, and words wholly in Greek.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts, and of phonetic Latin, that look like an ASCII letter (fixed values).
LOOKALIKES = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "F": "Ϝ", "G": "Ԍ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫͿ", "K": "ΚКᏦ",
    "L": "ᏞԼ", "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ",
    "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "αаɑ", "b": "Ь", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "f": "ք", "g": "ɡց", "h": "һհ", "i": "ιіıɩ", "j": "јϳ", "k": "κк", "l": "ӏ", "m": "м", "n": "ոп",
    "o": "οоօσᴏ", "p": "ρр", "q": "ԛգ", "r": "гᴦ", "s": "ѕꜱ", "t": "τт", "u": "υսᴜʋ", "v": "νѵᴠ", "w": "ԝѡᴡ", "x": "χх", "y": "уγүʏ", "z": "ᴢ",
}
#: Of these, letters that resemble their ASCII letter only loosely count inside a word that has another, sure one.
LOOSE = "σϜҽքցɩκкмпгτтʋѡχγҮүʏʀЬᴦυ"
#: Scripts whose words stand as they are when they are whole.
KEPT_SCRIPTS = frozenset({"GREEK"})
INVISIBLE_EXTRA = "͏ᅟᅠ឴឵ㅤﾠ"

_LATIN = {c: a for a, cs in LOOKALIKES.items() for c in cs}
WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ҃-֑҇-ׇؐ-ًؚ-ٰٟ᪰-᫿᷀-᷿⃐-⃿︠-︯]+[^\W\d_]*)*")
_PLAIN = re.compile(r"[\x20-\x7eÀ-ÿ\n]*")


@lru_cache(maxsize=65536)
def script(c: str) -> str:
    """First word of the character's name, which for letters is its script; empty if it has none."""
    return unicodedata.name(c, "").split(" ")[0]


def _spellings(loosely: bool) -> dict[str, dict[str, str]]:
    """How a letter is spelled in each script that has a letter like it; `loosely`: with the foreign letters of LOOSE."""
    out: dict[str, dict[str, str]] = {}
    for letter, others in LOOKALIKES.items():
        group = letter + "".join(c for c in others if loosely or c not in LOOSE or script(c) == "LATIN")
        first = {script(c): c for c in reversed(group)}
        for c in group:
            out[c] = out.get(c, {}) | first | ({script(c): c} if script(c) != "LATIN" else {})
    return out


_SURE, _LOOSELY = _spellings(False), _spellings(True)


@lru_cache(maxsize=65536)
def spelled(c: str, loosely: bool = False) -> dict[str, str]:
    """Script -> spelling of a letter, accents set aside; one that is a variant of an ASCII letter is spelled as that is."""
    base = unicodedata.normalize("NFD", c)[0]
    if base == "µ":
        base = "μ"
    elif unicodedata.decomposition(base).startswith(("<font>", "<compat>")) and base not in _LATIN and base != "ſ":
        plain = unicodedata.normalize("NFKC", base)
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            return {"LATIN": plain}
    return (_LOOSELY if loosely else _SURE).get(base) or {script(base): base}


@lru_cache(maxsize=65536)
def letter(c: str) -> bool:
    """Letters, and letters that stand for numbers."""
    return c.isalpha() or unicodedata.category(c) == "Nl"


@lru_cache(maxsize=65536)
def suspect(c: str) -> bool:
    """Whether a letter is of another script than Latin or looks like an ASCII letter."""
    return not c.isascii() and letter(c) and (script(c) != "LATIN" or unicodedata.normalize("NFD", c)[0] in _LATIN or script(c) not in spelled(c))


def resolve(word: str, loosely: bool = False) -> tuple[frozenset[str], frozenset[str]]:
    """The scripts of a word as coded, and those that each of its letters can be spelled in."""
    letters = [c for c in word if letter(c)]
    coded = frozenset(map(script, letters))
    common = frozenset.intersection(*(frozenset(spelled(c, loosely)) for c in letters)) if letters else frozenset()
    return coded, common


def _spell(word: str, wanted: str, loosely: bool = False) -> str:
    """The word's letters in one script, as far as it has them; accents stay."""
    parts = []
    for c in word:
        new = spelled(c, loosely).get(wanted)
        marks = unicodedata.normalize("NFD", c)[1:]
        parts.append(c if new is None or script(c) == wanted and c not in _LATIN and c != "µ" else unicodedata.normalize("NFC", new + marks))
    return "".join(parts)


def main_script(words: list[str]) -> str:
    """The script that most letters of the words are coded in; words that may be Latin in disguise do not count. Latin on ties, and if none counts."""
    counts: Counter[str] = Counter()
    for w in words:
        coded, common = (frozenset(("LATIN",)),) * 2 if w.isascii() else resolve(w)
        if coded == {"LATIN"} or "LATIN" not in common:
            counts.update(map(script, filter(letter, w)))
    return max(counts, key=lambda k: (counts[k], k == "LATIN"), default="LATIN")


def respell(word: str, words: list[str]) -> tuple[str, str]:
    """(spelling, kind) of a composed word among the words of its text: kind is mixed_script, whole_script or empty."""
    if word.isascii() or not any(map(suspect, word)):
        return word, ""
    coded, common = resolve(word)
    has_ascii = any(c.isascii() and c.isalpha() for c in word)
    if len(coded) == 1 and "LATIN" not in coded:
        odd = any(script(c) not in spelled(c) for c in word if letter(c))
        if not odd and (coded & KEPT_SCRIPTS or "LATIN" not in common or any(c in LOOSE for c in word) or main_script(words) in coded):
            return word, ""
        new = _spell(word, "LATIN" if "LATIN" in common else next(iter(common), ""))
        return new, "whole_script" if new != word else ""
    if not common and "LATIN" in resolve(word, True)[1]:
        common, new = frozenset(("LATIN",)), _spell(word, "LATIN", True)
    elif common:
        main, letters = main_script(words), Counter(map(script, word))
        new = _spell(word, max(common, key=lambda k: (k == main, letters[k], k == "LATIN", k)))
    else:
        # Words run together: stretches of one script with a letter that no other script has stay as they are.
        new = "".join(_spell(part, "LATIN") if has_ascii and all("LATIN" in spelled(c) for c in part if letter(c)) else part for part in _stretches(word))
    return new, "" if new == word and not (common and has_ascii and any(c in _LATIN and c not in LOOSE for c in word)) else "mixed_script" if has_ascii else "whole_script"


def _stretches(word: str) -> list[str]:
    """The word cut where the script of its letters changes."""
    out: list[str] = []
    last = ""
    for c in word:
        own = script(c) if letter(c) else last
        if out and own == last:
            out[-1] += c
        else:
            out.append(c)
        last = own
    return out


def _invisible(c: str) -> bool:
    return unicodedata.category(c) in ("Cf", "Cc", "Cs", "Co") and c not in "\n\r\t" or c in INVISIBLE_EXTRA


def _space(c: str) -> bool:
    return c != " " and (unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\t\x0b\x0c\x85")


@lru_cache(maxsize=65536)
def _single(c: str) -> tuple[str, str]:
    """(kind, plain form) of a character on its own: wide, ligature, invisible, space, or none."""
    if c.isascii() and c.isprintable() or c in "\n\r":
        return "", c
    if _invisible(c):
        return "invisible", ""
    if _space(c):
        return "space", " "
    if c in _LATIN:
        return "", c
    kind = unicodedata.decomposition(c).split(" ")[0]
    if kind in ("<wide>", "<narrow>"):
        return "wide", unicodedata.normalize("NFKC", c)
    if kind in ("<font>", "<compat>"):
        plain = unicodedata.normalize("NFKC", c)
        if plain.isalpha() and len(plain) > 1:
            return "ligature", plain
    return "", c


def inspect(text: str | None) -> tuple[str | None, list[str]]:
    """The consistent form of a text and the kinds of difference found in it.

    Kinds: invisible, space, wide, ligature, decomposed, mixed_script, whole_script. Null gives null.
    """
    if text is None or _PLAIN.fullmatch(text):
        return text, []
    kinds: set[str] = set()
    parts = []
    for c in text:
        kind, plain = _single(c)
        if kind:
            kinds.add(kind)
        parts.append(plain)
    plain = "".join(parts)
    composed = unicodedata.normalize("NFC", plain)
    if composed != plain:
        kinds.add("decomposed")
    elif unicodedata.normalize("NFC", text) != text:
        kinds.add("decomposed")

    words = WORD.findall(composed) if any(map(suspect, set(composed))) else []

    def consistently(m: re.Match) -> str:
        new, kind = respell(m.group(), words)
        if kind:
            kinds.add(kind)
        return new

    out = WORD.sub(consistently, composed) if words else composed
    out = unicodedata.normalize("NFC", out)
    if "space" in kinds or "invisible" in kinds:
        out = re.sub(" {2,}", " ", out) if "  " not in text else out
    return out, sorted(kinds)


#: Kinds that make a field a case of the query; whole-script words are respelled but have no ASCII letter.
CASES = ("invisible", "space", "wide", "ligature", "decomposed", "mixed_script")

_RESULT = "struct<form:string,kinds:array<string>>"


def consistent(column: Column) -> Column:
    """Struct of the consistent form of a text and the kinds of difference found; for null form is null and kinds empty."""

    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = [inspect(None if t is None else t) for t in s]
            yield pd.DataFrame({"form": [f for f, _ in found], "kinds": [k for _, k in found]})

    return run(column)


def normalize_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """`df` with each of `fields` in its consistent form, and `<field>_kinds`, the differences found there.

    Nulls stay null and have no kinds; empty texts stay empty; repeated rows stay; a column that is called
    `<field>_kinds` already is replaced.
    """
    out = df
    for f in fields:
        out = out.withColumn("__form", consistent(F.col(f"`{f}`"))).withColumn(f, F.col("__form.form")).withColumn(f"{f}_kinds", F.col("__form.kinds")).drop("__form")
    return out


def differing_fields(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, kinds) of every field that holds a case, each once."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("t")) for f in fields])).alias("x"))
    seen = long.select(*keys, "x.field", consistent(F.col("x.t")).alias("c"))
    cases = F.array_intersect("c.kinds", F.array(*map(F.lit, CASES)))
    return seen.select(*keys, "field", cases.alias("kinds")).where("size(kinds) > 0").distinct()
