"""Problem 8: personal information inside free text, found and replaced by typed placeholders.

Method: offset-preserving deobfuscation. Transducers rewrite a text step by step into a plain form:
invisible signs, letters with separate marks, wide forms, odd spaces and hyphens, words spelled with look-alikes (by the table and the
rules of problem 1), digits that are spelled out, at and dot that are written out. Each step keeps, for every position of its output, the position of its source. Identifiers
are detected in the plain form and their spans are mapped back, so the stored text alone is cut.

Names are recognised by a model trained from the name table: listed forms, and forms put together
from the parts that the listed forms of that role are made of.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.lookalikes import WORD, respell, suspect

KINDS = ("email", "phone", "id_number", "address", "name")
#: Forms of the name table that the tasks can hold; a larger table is refused, not shortened.
MAX_FORMS = 1_000_000

# --- transducers -----------------------------------------------------------------------------------

#: Signs that stand for one plain sign each (fixed values).
_SAME_LENGTH = str.maketrans(
    {
        **{chr(0xFF01 + i): chr(0x21 + i) for i in range(94)},
        **dict.fromkeys("               　", " "),
        **dict.fromkeys("‐‑‒–−﹣", "-"),
        **dict.fromkeys("’‘ʼ＇", "'"),
        "․": ".", "。": ".", "﹒": ".", "﹫": "@", "⁄": "/", "∕": "/",
    }
)
_ODD = re.compile("[   -   　！-～‐‑‒–−﹣’‘ʼ․。﹒﹫⁄∕]")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]+")
#: Letters with separate marks.
_MARKED = re.compile(r"[^\W\d_][\u0300-\u036f]+")
#: at and dot written out (fixed values).
_AT = r"\s*[\[({<]\s*(?:at|arobase|arobas|chez|@)\s*[\])}>]\s*|\s+(?:arobase|AT)\s+|\s+at\s+(?=[\w-]+\s+dot\s)"
_DOT = r"\s*[\[({<]\s*(?:dot|point|\.)\s*[\])}>]\s*|(?<=\w)\s+(?:dot|DOT|point)\s+(?=[\w-]+)"
_AT_RE = re.compile(_AT)
#: Whether a text holds any of these at all; no text that `_DISGUISED` rewrites is without.
_WRITTEN_OUT = re.compile(rf"{_AT}|{_DOT}")
_DISGUISED = re.compile(rf"[\w.+%-]*\w(?:{_AT})[\w-]+(?:(?:\.|{_DOT})[\w-]+)+|[\w.+%-]+(?: ?@ ?)[\w-]+(?:(?:\.)[\w-]+)*(?:(?:{_DOT})[\w-]+)+")
#: Digits spelled out (fixed values).
_DIGIT_WORDS = dict(zip("zéro zero oh un une one deux two trois three quatre four cinq five six sept seven huit eight neuf nine".split(), "000111223344556778899"))
_DIGIT_WORD = "(?:zéro|zero|oh|une?|one|deux|two|trois|three|quatre|four|cinq|five|six|sept|seven|huit|eight|neuf|nine)"
_SPELLED = re.compile(rf"\b(?:{_DIGIT_WORD}\b[\s,.-]{{0,2}}){{6,}}", re.I)
_DIGIT_PAIR = re.compile(rf"\b{_DIGIT_WORD}\b[\s,.-]{{1,2}}{_DIGIT_WORD}\b", re.I)


class Plain:
    """A text in plain form with the source position of each of its positions, kept as pieces that run in step."""

    __slots__ = ("text", "at", "shift")

    def __init__(self, text: str) -> None:
        self.text, self.at, self.shift = text, [0], [0]

    def source(self, position: int) -> int:
        k = bisect_right(self.at, position) - 1
        return position + self.shift[k]

    def rewrite(self, spans: list[tuple[int, int, str]]) -> None:
        """Put other strings in place of some spans; those of the same length keep their positions, others map to the source of their span's start."""
        if not spans:
            return
        parts, at, shift, last, length = [], [], [], 0, 0

        def keep(a: int, z: int) -> None:
            nonlocal length
            if a >= z:
                return
            k = bisect_right(self.at, a) - 1
            while k < len(self.at) and self.at[k] < z:
                begin = max(a, self.at[k])
                at.append(length + begin - a)
                shift.append(begin + self.shift[k] - (length + begin - a))
                k += 1
            parts.append(self.text[a:z])
            length += z - a

        for a, z, new in spans:
            keep(last, a)
            if len(new) == z - a:
                keep(a, z)
                parts[-1] = new
            else:
                origin = self.source(a)
                for c in new:
                    at.append(length)
                    shift.append(origin - length)
                    parts.append(c)
                    length += 1
            last = z
        keep(last, len(self.text))
        self.text, self.at, self.shift = "".join(parts), at or [0], shift or [0]


def _undisguise(m: re.Match) -> list[tuple[int, int, str]]:
    base, body = m.start(), m.group()
    at = next(iter(_AT_RE.finditer(body)), None)
    out, after = [], 0
    if at:
        out.append((base + at.start(), base + at.end(), "@"))
        after = at.end()
    else:
        after = body.index("@")
    out += [(base + after + d.start(), base + after + d.end(), ".") for d in re.finditer(_DOT, body[after:])]
    return out


def plain_form(text: str) -> Plain:
    """The plain form of a text, through all transducers."""
    p = Plain(text)
    if not text.isascii():
        if _INVISIBLE.search(p.text):
            p.rewrite([(m.start(), m.end(), "") for m in _INVISIBLE.finditer(p.text)])
        if _MARKED.search(p.text):
            p.rewrite([(m.start(), m.end(), unicodedata.normalize("NFC", m.group())) for m in _MARKED.finditer(p.text)])
        if _ODD.search(p.text):
            p.text = p.text.translate(_SAME_LENGTH)
        if any(map(suspect, set(p.text))):
            words = WORD.findall(p.text)
            p.rewrite([(m.start(), m.end(), new) for m in WORD.finditer(p.text) if (new := respell(m.group(), words)[0]) != m.group()])
    if _WRITTEN_OUT.search(p.text):
        p.rewrite([s for m in _DISGUISED.finditer(p.text) for s in _undisguise(m)])
    spelled = list(_SPELLED.finditer(p.text)) if _DIGIT_PAIR.search(p.text) else []
    if spelled:
        p.rewrite([(m.start() + w.start(), m.start() + w.end() + len(re.match(r"[\s,.-]{0,2}", m.group()[w.end() :]).group()) * (m.start() + w.end() < m.end()), _DIGIT_WORDS[w.group().lower()]) for m in spelled for w in re.finditer(r"[^\W\d_]+", m.group())])
    return p


# --- identifiers -----------------------------------------------------------------------------------

_EMAIL = re.compile(r"[\w.+%-]*\w(?:@| @ )(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@])")
_NUMBER = re.compile(r"[+(]?\d")

_PHONE = [
    re.compile(r"(?:\+|00)33 ?(?:\(0\))? ?[1-9](?P<s>[ .\-/]?)\d\d(?:(?P=s)\d\d){3}(?!\d)"),
    re.compile(r"0[1-9](?:(?P<s>[ .\-/])\d\d(?:(?P=s)\d\d){3}|\d{8})(?!\d)"),
    re.compile(r"(?:(?:\+|00)44 ?(?:\(0\))? ?[1-9]\d{1,4}|\(0\d{2,4}\)|0\d{2,4})[ -]?(?:\d{6,7}|\d{3}[ -]\d{3,4}|\d{4}[ -]\d{4})(?!\d)"),
    re.compile(r"(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])|\(\d{3}\) ?)\d{3}[ .-]\d{4}(?!\d)"),
    re.compile(r"\d{3}(?P<s>[.-])\d{3}(?P=s)\d{4}(?!\d)"),
    re.compile(r"\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,7}(?!\d)"),
]
_ID = [
    re.compile(r"[1-478](?P<s>[ .-]?)\d\d(?P=s)\d\d(?P=s)(?:\d\d|2[AB])(?P=s)\d{3}(?P=s)\d{3}(?:(?P=s)| )\d\d(?!\d)"),
    re.compile(r"\d{3}-\d\d-\d{4}(?![\d-])"),
    re.compile(r"\d\d[A-Z]{2}\d{4,5}(?!\w)"),
]
_PREFIXED = re.compile(r"(?<![\w/])(?:PASSPORT|PASSEPORT|PASS|CNI|IDN|ID|NIR|SSN|NINO)(?: ?(?:no\.?|n°|nº|№|#) ?| ?[:.\-] ?| )\d{6,12}(?![\w-])")

_HOUSE = r"\d{1,4}(?:[A-Z](?![A-Za-z])| ?(?:bis|ter|quater|BIS|TER)(?!\w))?"
_TOWN = r"[A-ZÀ-Þ][\w'-]+(?: (?:[A-ZÀ-Þ][\w'-]+))?"
_ADDRESS = [
    re.compile(rf"{_HOUSE},? (?:[A-Z][\w']* ){{1,4}}?(?:Lane|Close|Street|St|Road|Rd|Avenue|Ave|Yard|Court|Row|Square|Terrace|Way|Drive|Hill|Gardens|Mews|Crescent|Walk|Place|LANE|CLOSE|STREET|ROAD|RD|AVENUE|YARD|COURT|ROW|SQUARE)\b(?:(?:, |,?\n){_TOWN}(?= [A-Z]{{1,3}}\d|[.,;\n]|$)(?: [A-Z]{{1,3}}\d{{1,2}} ?\d[A-Z]{{2}})?)?"),
    re.compile(rf"{_HOUSE},? (?i:rue|allée|avenue|av\.?|place|pl\.|impasse|quai|chemin|boulevard|bd|bld|passage|cours|route|square|sentier|ruelle|venelle|faubourg|esplanade)(?: (?i:de|du|des|la|le|les|aux?|à))*(?: ?(?i:d|l)')?(?: ?(?:Saint|Sainte|St|Ste|SAINT|SAINTE) )? ?[A-ZÀ-Þ][\w'-]+(?:(?:, ?| - |\n| )(?:\d{{5}} )?[A-ZÀ-Þ][\w'-]*-?[\w'-]*(?=[.,;\]\n]|$)|(?:, ?|\n| )\d{{5}} [A-ZÀ-Þ][\w'-]+)?"),
]
_FLAT = re.compile(r"(?:Flat|FLAT|Apt\.?|Apartment|Unit|Suite|Appt\.?|Bât\.?|Appartement) ?\d{1,4}[A-Z]?,?[ \n]$")

_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]*\.?)*\.?")
_PARTICLE = re.compile(r"(?:de|du|des|von|van|le|la|De|Du|Des|Von|Van|Le|La|DE|DU|DES|VON|VAN|LE|LA)$")
_GAP = re.compile(r"[ \t]{1,2}|[ \t]?\n[ \t]?")
_GAP_PARTICLE = re.compile(r"(?:[ \t]{1,2}|\n)(?:(?i:de la|de|du|des|von|van|le|la|de l'|d'|l'))(?:[ \t]{1,2}|\n|(?<='))")
_GAP_COMMA = re.compile(r",(?:[ \t]{1,2}|\n)")
_BEFORE_PARTICLE = re.compile(r"(?:^|[^\w\s]|\n|\b(?:avec|par|à|et|ou|demander|joindre|reach|with|to|by|and|or|Dr|Pr|Mr|Ms|Mme|Mlle|Mrs|M\.|Prof\.|chez|from|for|pour|Selon|selon)) ?$")


class NameModel:
    """Given and family names: listed forms, and forms made of the parts of listed ones (letter successor variety)."""

    def __init__(self, forms: list[tuple[str, str]]) -> None:
        self.listed: dict[str, set[str]] = {"given": set(), "family": set()}
        for form, role in forms:
            if form and role in self.listed:
                self.listed[role].add(unicodedata.normalize("NFC", form.strip().lower()))
        # Where a beginning is followed by several letters, or an ending preceded by several, lies a seam between two parts.
        self.parts: dict[str, tuple[set[str], set[str], set[str]]] = {}
        for role, known in self.listed.items():
            after, before, size = defaultdict(set), defaultdict(set), Counter()
            for f in known:
                for i in range(2, len(f) - 1):
                    after[f[:i]].add(f[i])
                    before[f[i:]].add(f[i - 1])
                    size[f[:i], 0] += 1
                    size[f[i:], 1] += 1
            heads = {h for h, c in after.items() if len(c) >= 3 and size[h, 0] >= 4}
            tails = {t for t, c in before.items() if len(c) >= 3 and size[t, 1] >= 4}
            middles = Counter(m for f in known for m in self.middles(f, heads, tails))
            self.parts[role] = heads, tails, {m for m, n in middles.items() if n >= 3}
        self.cache: dict[str, int] = {}

    def roles(self, token: str) -> int:
        """Bits: 1 given, 2 family, 4 initial."""
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            found = self.cache[token] = self._roles(token)
        return found

    @staticmethod
    def middles(word: str, heads: set[str], tails: set[str]) -> set[str]:
        """What stands between a beginning and an ending of the word, for each such pair."""
        return {word[i:j] for i in range(2, len(word) - 1) if word[:i] in heads for j in range(i, len(word) - 1) if word[j:] in tails}

    def composed(self, word: str, role: str) -> bool:
        """A known beginning and ending with nothing, or a part that is common there, between them."""
        heads, tails, middles = self.parts[role]
        return bool(self.middles(word, heads, tails) & middles)

    def _roles(self, token: str) -> int:
        letters = [x for x in token.split("-") if x]
        if token.endswith("."):
            if all(len(x) == 2 and x[0].isalpha() and x[1] == "." or len(x) == 1 and x.isalpha() for x in letters):
                return 4
            return self._roles(token[:-1])
        words = token.lower().split("-")
        if min(map(len, words)) < 3:
            return 0
        sure = [bit for bit, role in ((1, "given"), (2, "family")) if all(w in self.listed[role] for w in words)]
        if sure:
            return sum(sure)
        return sum(bit for bit, role in ((1, "given"), (2, "family")) if all(w in self.listed[role] or self.composed(w, role) for w in words))


def find_names(text: str, model: NameModel, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of full names outside the spans already taken."""
    found, roles = [], model.roles
    tokens = [(m.start(), m.end(), r) for m in _CAPITAL.finditer(text) if (r := roles(m.group()))]
    if len(tokens) < 2:
        return found
    starts = [a for a, _ in taken]

    def free(a: int, z: int) -> bool:
        k = bisect_right(starts, a)
        return not (k and taken[k - 1][1] > a or k < len(taken) and taken[k][0] < z)

    i = 0
    while i + 1 < len(tokens):
        (a, b, x), (c, d, y) = tokens[i], tokens[i + 1]
        gap, full_stop = text[b:c], text[b - 1] == "."
        begin = None
        stop = d - (text[d - 1] == "." and not y & 4)
        if len(gap) <= 8 and not (full_stop and not x & 4):
            after = tokens[i + 2] if i + 2 < len(tokens) else None
            reversed_next = after and y & 2 and after[2] & 1 and (_GAP.fullmatch(text[d : after[0]]) or _GAP_COMMA.fullmatch(text[d : after[0]]))
            if text[a:b] == "M." and reversed_next:
                pass  # a title before a reversed name
            elif x & 5 and y & 2 and (_GAP.fullmatch(gap) or _GAP_PARTICLE.fullmatch(gap)):
                begin = a
            elif x & 2 and y & 5 and (_GAP_COMMA.fullmatch(gap) or y & 1 and _GAP.fullmatch(gap)):
                begin = a
                lead = re.search(r"(\w+)\s$", text[max(0, a - 8) : a])
                if lead and _PARTICLE.match(lead.group(1)):
                    at = a - len(lead.group())
                    if not lead.group(1).islower() or _BEFORE_PARTICLE.search(text[max(0, at - 14) : at]):
                        begin = at
        if begin is not None and free(begin, stop) and not (begin and (text[begin - 1].isalnum() or text[begin - 1] in "@_")):
            found.append((begin, stop))
            i += 2
        else:
            i += 1
    return found


def find_spans(text: str, model: NameModel) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the stored text, in order and without overlaps."""
    p = plain_form(text)
    body = p.text
    spans: list[tuple[int, int, str]] = []
    if "@" in body:
        spans += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(body)]
    mails = [(a, z) for a, z, _ in spans]
    spans += [(m.start(), m.end(), "id_number") for m in _PREFIXED.finditer(body)]
    last = 0
    for m in _NUMBER.finditer(body):
        a = m.start()
        before = body[a - 1 : a]
        if a < last or before and (before.isalnum() or before in "_/@" or before in ".-:" and body[a - 2 : a - 1].isalnum() and before != ":"):
            continue
        for kind, patterns in (("id_number", _ID), ("phone", _PHONE), ("address", _ADDRESS)):
            hit = next((h for q in patterns if (h := q.match(body, a)) and not re.match(r"[-/.]\d", body[h.end() : h.end() + 2])), None)
            if hit:
                z = hit.end()
                if kind == "address" and (flat := _FLAT.search(body[max(0, a - 24) : a])):
                    a -= len(flat.group())
                spans.append((a, z, kind))
                last = z
                break
    spans.sort()
    kept, end = [], 0
    for a, z, kind in spans:
        if a >= end and not (kind != "email" and any(x <= a < y for x, y in mails)):
            kept.append((a, z, kind))
            end = z
    kept += [(a, z, "name") for a, z in find_names(body, model, [(a, z) for a, z, _ in kept])]
    kept.sort()
    out = []
    for a, z, kind in kept:
        # What a replacement stood for ends where the next position's source begins.
        begin, end = p.source(a), p.source(z) if z < len(body) else len(text)
        out.append((kind, begin, begin + len(text[begin:end].rstrip(" \t\n,.-") if kind == "phone" else text[begin:end].rstrip())))
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    parts, last = [], 0
    for kind, a, z in spans:
        parts += [text[last:a], f"[{kind.upper()}]"]
        last = z
    return "".join([*parts, text[last:]])


# --- over tables -----------------------------------------------------------------------------------


def name_model(name_forms: DataFrame) -> NameModel:
    rows = name_forms.select("form", "role").where("form is not null and role is not null").distinct().limit(MAX_FORMS + 1).collect()
    if len(rows) > MAX_FORMS:
        raise ValueError(f"the name table has over {MAX_FORMS} forms; it would not fit the tasks")
    return NameModel([(r.form, r.role) for r in sorted(rows)])


def find_personal(df: DataFrame, name_forms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pii_kind, start_pos, end_pos) of every occurrence, positions 0-based in code points of the stored text.

    Null and empty texts have none; rows with a null id are kept under it; repeated rows give each
    occurrence once; an empty table gives no rows, an empty name table finds no names; other columns are ignored.
    """
    source = df.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where("t is not null")
    shared = df.sparkSession.sparkContext.broadcast(name_model(name_forms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            owner, kinds, starts, ends = [], [], [], []
            for n, text in enumerate(batch.column(1)):
                for kind, a, z in find_spans(text.as_py(), model):
                    owner.append(n)
                    kinds.append(kind)
                    starts.append(a)
                    ends.append(z)
            ids = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["d", "pii_kind", "start_pos", "end_pos"])

    found = source.mapInArrow(run, f"d {source.schema['d'].dataType.simpleString()}, pii_kind string, start_pos int, end_pos int")
    return found.distinct().select(F.col("d").alias(id_col), "pii_kind", "start_pos", "end_pos")


def redact_personal(df: DataFrame, name_forms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every row of `df` with typed placeholders such as [EMAIL] in its text; null stays null."""
    source = df.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    shared = df.sparkSession.sparkContext.broadcast(name_model(name_forms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [None if t is None else redact(t, find_spans(t, model)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["d", "t"])

    out = source.mapInArrow(run, f"d {source.schema['d'].dataType.simpleString()}, t string")
    return out.select(F.col("d").alias(id_col), F.col("t").alias(text_col))
