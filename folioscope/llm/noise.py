"""Problem 5: lines of a run, as an OCR engine left them, into continuous readable paragraphs.

Method: a hidden Markov model labels the lines of a run as header (running title), page (page or leaf
number, the break between pages) or body from layout features: the shape of a number, likeness to the run's
title, letter style. Viterbi finds the best labels; the body lines are joined, words broken at a line end made
whole, misread words found against the lexicon and put right where one form is nearest.

The model is trained here, without labels, by Viterbi re-estimation from a plausible start over all lines: every
round each task adds up the moves and symbols of its chunks' best paths, a few dozen numbers. Titles repeated in a run,
and proper names, are counted over the whole table too.

Runs are cut into chunks of CHUNK lines with MARGIN lines of context on both sides, so a run that
holds a third of all rows is many tasks.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.lookalikes import inspect, script
from folioscope.llm.overlap import edit_distance
from folioscope.operators.lexicon import candidates
from folioscope.session import cut, parallelism

ROUNDS = 4
CHUNK, MARGIN = 2_000, 60
#: Letters of a title at least; different titles that share an opening at least.
TITLE_LETTERS, OPENING_TITLES = 6, 3
#: A capitalised word unknown to the lexicon is a name if it stands in so many lines.
NAME_LINES = 2
#: Forms that the tasks can hold.
MAX_FORMS = 1_000_000
#: Tokens that break a word at a line end (fixed values).
MARKS = "-‐‑–—¬⸗=~"
#: What abbreviation signs may stand for (fixed values).
ABBREVIATIONS = {"ꝑ": ("per", "par", "por"), "ꝓ": ("pro",), "ꝙ": ("qui", "que"), "⁊": ("et",), "q̃": ("que", "qui"), "ꝯ": ("con", "com")}

STATES = ("header", "page", "body")
_ROMAN = re.compile(r"(?=[ivxlcdmj])m{0,3}(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4}|v?i{0,3}j)", re.I)
_NO_SIGN = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"(?=.*\d)[\dOoIlSB]{1,4}")


def clean(text: str | None) -> str:
    return " ".join((inspect(text)[0] or "").split())


@lru_cache(maxsize=100_000)
def key(text: str) -> str:
    """Letters of a line, folded, without a number before or after it: what titles are compared by."""
    words = [w for w in text.split()]
    while words and number_shape(words[0]):
        words = words[1:]
    while words and number_shape(words[-1]):
        words = words[:-1]
    letters = unicodedata.normalize("NFKD", "".join(words).lower())
    return _NO_SIGN.sub("", letters).replace("v", "u").replace("j", "i")


def number_shape(text: str) -> int:
    """2: a page or leaf number beyond doubt, 1: it may be one, 0: none."""
    t = text.strip()
    core = t.strip("[](){}·.—–-‐ ")
    m = re.match(r"(?i)(?:pages?|pag|pp|p|folios?|fol|fo|ff|f)(?![^\W\d_](?<![ivxlcdmj]))\.?\s*(?=[\divxlcdmjl])", core)
    marked = bool(m) or (core != t and not re.fullmatch(r"[^\W\d_]+[.]?", t))
    if m:
        core = core[m.end() :]
    core = core.strip()
    bare = re.sub(r"(?<=.)\s?[rv]$", "", core)
    for x in (core, bare):
        if _DIGITS.fullmatch(x):
            return 2
        if x and _ROMAN.fullmatch(x):
            return 2 if marked or len(x) > 2 or t.endswith(".") else 1
    return 0


def style(text: str) -> int:
    """1 for all capitals, letter-spaced or dotted at both ends: how titles are set."""
    letters = sum(map(str.isalpha, text))
    if letters < 5:
        return 0
    sizes = list(map(len, text.split()))
    single = sizes.count(1) >= 0.8 * len(sizes) and len(sizes) >= 6
    dotted = text[0] in "·•*" and text[-1] in "·•*"
    return int(single or dotted or sum(map(str.isupper, filter(str.isalpha, text))) >= 0.8 * letters)


def likeness(k: str, titles: list[str]) -> float:
    """How well a line's key agrees with a title or the beginning of one (titles are cut short), 0 to 1."""
    best = 1.0 if len(k) >= 5 and k in titles else 0.0
    if len(k) >= 5 and not best:
        for t in titles:
            if len(k) <= len(t) + 3 and len(k) >= 0.45 * len(t):
                d = min(edit_distance(k, t[:n], 8) for n in {min(len(t), len(k) + e) for e in (-1, 0, 1)})
                best = max(best, 1 - d / len(k))
    return best


@lru_cache(maxsize=100_000)
def _pieces(text: str, n: int = 5) -> tuple[str, ...]:
    return tuple(text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n))


def opening(k: str, openings: list[str]) -> float:
    """How well a line begins as titles of other runs do, before their last word."""
    best = 0.0
    for o in openings:
        if len(o) + 2 <= len(k) <= len(o) + 14:
            head = k[: len(o)]
            # Four edits leave one of five pieces whole.
            d = edit_distance(head, o, 4) if any(p in head for p in _pieces(o)) else 5
            best = max(best, 1 - d / len(o))
    return best


def features(text: str, titles: list[str], openings: list[str]) -> tuple[int, int, int]:
    """Symbols of a cleaned line: number shape, likeness to a title, style."""
    k = key(text)
    best = max(likeness(k, titles), opening(k, openings) - 0.1)
    return number_shape(text), 2 if best >= 0.72 else 1 if best >= 0.55 else 0, style(text)


class LineModel:
    """First-order hidden Markov model with independent categorical features in each state."""

    SIZES = (3, 3, 2)

    def __init__(self) -> None:
        # Start: numbers are page lines, likeness or style makes titles, most lines are body and follow body.
        self.first = [0.45, 0.15, 0.40]
        self.move = [[0.01, 0.04, 0.95], [0.80, 0.01, 0.19], [0.02, 0.03, 0.95]]
        self.emit = [[[0.96, 0.03, 0.01], [0.05, 0.10, 0.85], [0.5, 0.5]], [[0.02, 0.18, 0.80], [0.98, 0.01, 0.01], [0.97, 0.03]], [[0.988, 0.010, 0.002], [0.985, 0.014, 0.001], [0.995, 0.005]]]

    def label(self, symbols: list[tuple[int, ...]]) -> list[int]:
        """Viterbi path of lines with these symbols, one of each feature."""
        return self.path([code(x) for x in symbols])

    def path(self, codes: list[int]) -> list[int]:
        """Viterbi path of lines with these codes."""
        if not len(codes):
            return []
        local = [tuple(sum(math.log(self.emit[s][f][v]) for f, v in enumerate(symbol)) for s in range(3)) for symbol in SYMBOLS]
        (aa, ab, ac), (ba, bb, bc), (ca, cb, cc) = [[math.log(p) for p in m] for m in self.move]
        a, b, c = (math.log(p) + x for p, x in zip(self.first, local[codes[0]]))
        back: list[tuple[int, int, int]] = []
        for k in codes[1:]:
            x, y, z = local[k]
            # From which state each is reached best; the first on ties.
            to_a, to_b, to_c = (a + aa, b + ba, c + ca), (a + ab, b + bb, c + cb), (a + ac, b + bc, c + cc)
            i, j, l = to_a.index(max(to_a)), to_b.index(max(to_b)), to_c.index(max(to_c))
            back.append((i, j, l))
            a, b, c = to_a[i] + x, to_b[j] + y, to_c[l] + z
        path = [max(range(3), key=(a, b, c).__getitem__)]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]

    def counts(self, sequences: list[list[int]]) -> np.ndarray:
        """How often the best paths begin with a state, move, and have a code in a state: 3 + 9 + 3 * 18 numbers."""
        first, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, len(SYMBOLS)))
        for codes in sequences:
            path = np.array(self.path(codes))
            if len(path):
                first[path[0]] += 1
                np.add.at(move, (path[:-1], path[1:]), 1)
                np.add.at(emit, (path, np.array(codes)), 1)
        return np.concatenate([first, move.ravel(), emit.ravel()])

    def refit(self, counts: np.ndarray) -> LineModel:
        """The model that counts give; the start counts as `weight` lines a state."""
        weight, start, out = 50.0, LineModel(), LineModel()
        first, move, emit = counts[:3], counts[3:12].reshape(3, 3), counts[12:].reshape(3, len(SYMBOLS))
        share = lambda p, n: [(weight * q + float(k)) / (weight * sum(p) + float(sum(n))) for q, k in zip(p, n)]
        out.first = share(start.first, first)
        out.move = [share(p, n) for p, n in zip(start.move, move)]
        out.emit = [[share(p, [sum(emit[s][k] for k, x in enumerate(SYMBOLS) if x[f] == v) for v in range(self.SIZES[f])]) for f, p in enumerate(start.emit[s])] for s in range(3)]
        return out

    def fit(self, sequences: list[list[tuple[int, ...]]], rounds: int = ROUNDS) -> LineModel:
        """Re-estimated from the best paths of these sequences."""
        model, coded = self, [[code(x) for x in symbols] for symbols in sequences]
        for _ in range(rounds):
            model = model.refit(model.counts(coded))
        return model


#: All symbols a line can have, by code.
SYMBOLS = [(i, j, k) for i in range(3) for j in range(3) for k in range(2)]


def code(symbol: tuple[int, ...]) -> int:
    return symbol[0] * 6 + symbol[1] * 2 + symbol[2]


class Vocabulary:
    """Known forms: those of the lexicon and proper names."""

    def __init__(self, forms: list[str], names: list[str], others: list[str] | None = None) -> None:
        """`names` lend their beginnings and endings to words that look like names; `others`, such as family names, are only known."""
        self.forms = {unicodedata.normalize("NFC", f.strip().lower()) for f in forms if f and sum(c.isalpha() for c in f) == len(f.strip())}
        self.names = {unicodedata.normalize("NFC", n.strip().lower()) for n in names if n and n.strip()}
        self.heads: dict[str, set[str]] = defaultdict(set)
        self.tails: dict[str, set[str]] = defaultdict(set)
        for n in self.names:
            for i in range(2, len(n) - 2):
                self.heads[n[:i]].add(n[i:])
                self.tails[n[i:]].add(n[:i])
        self.known = self.forms | self.names | {unicodedata.normalize("NFC", n.strip().lower()) for n in others or [] if n and n.strip()}
        self.sorted = sorted(self.known)
        self.ends = sorted(f[::-1] for f in self.known)
        # Forms of up to 63 letters, the short ones first, as rows of letter codes; longer ones apart.
        self.short = sorted((f for f in self.known if len(f) < 64), key=lambda f: (len(f), f))
        self.long = [f for f in self.sorted if len(f) >= 64]
        self.size = np.array([len(f) for f in self.short], np.int64)
        self.letter = {c: k for k, c in enumerate(sorted(set("".join(self.short))), 1)}
        self.rows = np.zeros((int(self.size.max(initial=0)), len(self.short)), np.uint16)
        for k, f in enumerate(self.short):
            self.rows[: len(f), k] = [self.letter[c] for c in f]
        self.cache: dict[tuple[str, bool], bool] = {}
        self.near: dict[tuple[str, int], tuple[int, list[str]]] = {}

    def name_like(self, word: str) -> bool:
        """Composed of a beginning and an ending that several names share."""
        return any(len(self.heads.get(word[:i], ())) >= 3 and len(self.tails.get(word[i:], ())) >= 3 for i in range(2, len(word) - 2))

    def has(self, word: str) -> bool:
        """Whether a word, abbreviations resolved, is a form of the lexicon or a name."""
        capital = word[:1].isupper()
        found = self.cache.get((word, capital))
        if found is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            w = word.lower().replace("ſ", "s")
            found = w in self.known or foreign(w) or capital and self.name_like(w) or any(x in self.known for x in expansions(w))
            self.cache[word, capital] = found
        return found

    def begins(self, part: str) -> bool:
        i = bisect_left(self.sorted, part)
        return i < len(self.sorted) and self.sorted[i].startswith(part)

    def finishes(self, part: str) -> bool:
        i = bisect_left(self.ends, part[::-1])
        return i < len(self.ends) and self.ends[i].startswith(part[::-1])

    def nearest(self, word: str, limit: int = 2) -> tuple[int, list[str]]:
        """Least distance up to `limit`, and the forms at it."""
        w = word.lower().replace("ſ", "s")
        found = self.near.get((w, limit))
        if found is None:
            if len(self.near) > 100_000:
                self.near.clear()
            distances = self._distances(w, limit) + [(f, edit_distance(w, f, limit)) for f in self.long if abs(len(f) - len(w)) <= limit]
            best = min((d for _, d in distances), default=limit + 1)
            found = self.near[w, limit] = (best, [f for f, d in distances if d == best]) if best <= limit else (limit + 1, [])
        return found

    def _distances(self, w: str, limit: int) -> list[tuple[str, int]]:
        """Forms within `limit` of a word and their distances: bit-parallel columns over all forms of near length at once."""
        a, z = np.searchsorted(self.size, [len(w) - limit, len(w) + limit + 1])
        if a == z:
            return []
        if not w or len(w) > 63:
            return [(f, d) for f in self.short[a:z] if (d := edit_distance(w, f, limit)) <= limit]
        one, last = np.uint64(1), np.uint64(len(w) - 1)
        bits = np.zeros(len(self.letter) + 1, np.uint64)
        for i, c in enumerate(w):
            if c in self.letter:
                bits[self.letter[c]] |= np.uint64(1 << i)
        size = self.size[a:z]
        pv, mv, score, out = np.full(z - a, ~np.uint64(0)), np.zeros(z - a, np.uint64), np.full(z - a, len(w), np.int64), np.zeros(z - a, np.int64)
        for j in range(int(size[-1])):
            eq = bits[self.rows[j, a:z]]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += ((ph >> last) & one).astype(np.int64) - ((mh >> last) & one).astype(np.int64)
            ph, mh = ph << one | one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
            first, end = np.searchsorted(size, [j + 1, j + 2])
            out[first:end] = score[first:end]
        return [(self.short[a + k], int(out[k])) for k in np.nonzero(out <= limit)[0].tolist()]


def foreign(word: str) -> bool:
    """Whether all letters are of another script than Latin, as in a Greek word."""
    return not any(c.isdigit() or script(c) == "LATIN" for c in word)


def expansions(word: str) -> list[str]:
    """Readings of a lower-case word with abbreviation signs; none if it has no such sign."""
    out = [unicodedata.normalize("NFD", word)]
    if "̃" not in out[0] and not any(s in word for s in ABBREVIATIONS):
        return []
    for sign, readings in ABBREVIATIONS.items():
        if sign in out[0]:
            out = [o.replace(sign, r) for o in out for r in readings]
    for letter in "nm":
        out += [o.replace("̃", letter) for o in out if "̃" in o]
    return [unicodedata.normalize("NFC", o) for o in out if "̃" not in o]


_TOKEN = re.compile(r"[^\W_]+(?:̃[^\W_]*)*")
_ODD = re.compile(r"\d")


def tokens(text: str) -> list[str]:
    """Words of a cleaned body line: runs of letters and digits; numerals that stand alone are none."""
    out = []
    for m in _TOKEN.finditer(text):
        w = m.group()
        before, after = text[: m.start()][-1:], text[m.end() :][:1]
        if (before == "." or before == "·") and after in (".", "·") and (_ROMAN.fullmatch(w) or w.isdigit()):
            continue
        out.append(w)
    return out


def broken_end(text: str) -> tuple[str, str] | None:
    """(part of a word, mark) where a cleaned line ends in a letter with a mark directly after it."""
    m = re.search(rf"([^\W_]+(?:̃[^\W_]*)*)([{re.escape(MARKS)}])$", text)
    return (m.group(1), m.group(2)) if m else None


def label_lines(lines: list[tuple[int, str]], titles: list[str], openings: list[str], model: LineModel) -> dict[int, str]:
    """Label by line index; blank lines have none."""
    filled = [(i, t) for i, t in lines if t]
    path = model.label([features(t, titles, openings) for _, t in filled])
    return {i: STATES[s] for (i, _), s in zip(filled, path)}


def find_noise(lines: list[tuple[int, str]], labels: dict[int, str], vocabulary: Vocabulary) -> list[tuple[int, str, str]]:
    """(line index, noise, detail) of the lines of a run, cleaned and in order."""
    out = [(i, "header" if labels[i] == "header" else "page_no", t) for i, t in lines if t and labels[i] != "body"]
    body = [(i, t) for i, t in lines if t and labels[i] == "body"]
    carried: str | None = None
    for n, (i, text) in enumerate(body):
        words = tokens(text)
        bad: list[str] = []
        if carried is not None:
            head, words = words[0] if words else "", words[1:]
            if blame(carried, head, vocabulary) in ("second", "both"):
                bad.append(head)
            carried = None
        end = broken_end(text)
        if end and words and words[-1] == end[0]:
            following = tokens(body[n + 1][1]) if n + 1 < len(body) else []
            if following and goes_on(end[0], following[0], vocabulary):
                out.append((i, "hyphen", end[0] + following[0]))
                carried = end[0]
                words = words[:-1]
                if blame(end[0], following[0], vocabulary) in ("first", "both"):
                    bad.append(end[0])
            elif not following and not vocabulary.has(end[0]):
                out.append((i, "hyphen", end[0]))
                words = words[:-1]
                if not vocabulary.begins(end[0].lower().replace("ſ", "s")):
                    bad.append(end[0])
        bad += [w for w in words if not vocabulary.has(w)]
        if bad:
            out.append((i, "misread", " ".join(bad)))
    return out


def goes_on(part: str, following: str, vocabulary: Vocabulary) -> bool:
    """Whether a marked last word and the next word are one: the whole is a form, or the parts are none by themselves."""
    return vocabulary.has(part + following) or not (vocabulary.has(part) and vocabulary.has(following))


def blame(part: str, following: str, vocabulary: Vocabulary) -> str | None:
    """Which part of a broken word has wrong characters, if the whole is no form: first, second or both."""
    if vocabulary.has(part + following):
        return None
    a, b = (x.lower().replace("ſ", "s") for x in (part, following))
    d, near = vocabulary.nearest(a + b, 3)
    if not near:
        # The rest of the word may be missing; then the next word stands by itself.
        first, second = not vocabulary.begins(a), not vocabulary.finishes(b) and not vocabulary.has(following)
        return "both" if first and second else "first" if first else "second" if second else None
    if d > 1 and vocabulary.has(following) and vocabulary.begins(a):
        return None
    second, first = any(f.startswith(a) for f in near), any(f.endswith(b) for f in near)
    if first and second:  # either may be wrong; the longer part more likely is
        return "first" if len(a) > len(b) else "second"
    return "second" if second else "first" if first else "both"


def paragraphs(lines: list[tuple[int, str]], labels: dict[int, str], vocabulary: Vocabulary, usual: int) -> list[tuple[int, str]]:
    """(line index, text that the line gives to its paragraph) of the body lines.

    Titles and numbers are gone; a broken word stands whole in its first line; misread words are put right
    where one form alone is nearest. Joined by spaces the texts of a run read on; a line that ends a
    sentence well short of the `usual` length of the run ends a paragraph, which its text shows by a line feed.
    """

    def right(m: re.Match) -> str:
        w = m.group()
        if vocabulary.has(w) or _ROMAN.fullmatch(w):
            return w
        _, near = vocabulary.nearest(w, 1 if len(w) < 6 else 2)
        if len(near) != 1:
            return w
        return near[0].capitalize() if w[0].isupper() else near[0]

    body = [(i, t) for i, t in lines if t and labels[i] == "body"]
    out, start = [], 0
    for n, (i, text) in enumerate(body):
        own, begin, start = text, start, 0
        end = broken_end(text)
        following = tokens(body[n + 1][1]) if n + 1 < len(body) else []
        if end and following and goes_on(end[0], following[0], vocabulary):
            own = text[:-1] + following[0]
            start = body[n + 1][1].index(following[0]) + len(following[0])
        own = own[begin:].strip()
        stop = len(text) < 0.6 * usual and own.endswith((".", ":", ";", "?", "!"))
        out.append((i, _TOKEN.sub(right, own) + ("\n" if stop else "")))
    return out


# --- over tables -----------------------------------------------------------------------------------


@F.pandas_udf(T.StructType([T.StructField("clean", T.StringType()), T.StructField("key", T.StringType())]))
def _prepare(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        cleaned = [clean(t) for t in s]
        yield pd.DataFrame({"clean": cleaned, "key": [key(t) if t else "" for t in cleaned]})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _capitalised(s: pd.Series) -> pd.Series:
    def found(t: str) -> list[str]:
        end = broken_end(t)
        return sorted({w for w in tokens(t) if len(w) >= 4 and w[0].isupper() and w[1:].islower() and w.isalpha() and not (end and w == end[0])})

    return s.map(found)


def _chunks(lines: DataFrame) -> DataFrame:
    """Each line once for every chunk that sees it: its own, and the next or last one if it is in the margin."""
    at = F.pmod("line_index", F.lit(CHUNK))
    own = F.floor(F.col("line_index") / CHUNK).cast("int")
    # Lines count from 0, so nothing stands before the first chunk.
    near = F.array_compact(F.array(own, F.when((at < MARGIN) & (own != 0), own - 1), F.when(at >= CHUNK - MARGIN, own + 1)))
    # A fixed number of partitions: the work of a chunk is far more than its bytes tell adaptive execution.
    return lines.withColumn("own", own).withColumn("chunk", F.explode(near)).repartition(parallelism(lines.sparkSession), "run_id", "chunk")


def prepared_lines(lines: DataFrame, text: str = "text_raw") -> DataFrame:
    """(run_id, line_index, clean, key): each line once; rows without a key field or text take no part."""
    own = lines.select("run_id", F.col("line_index").cast("int").alias("line_index"), F.col(text).alias("t")).where("run_id is not null and line_index is not null and t is not null")
    once = own.groupBy("run_id", "line_index").agg(F.min("t").alias("t"))
    return once.select("run_id", "line_index", _prepare("t").alias("p")).select("run_id", "line_index", "p.clean", "p.key").where("clean <> ''")


def run_titles(prepared: DataFrame, runs: DataFrame | None) -> DataFrame:
    """(run_id, key): keys of TITLE_LETTERS letters or more that repeat in a run, and the run's title where known."""
    best = prepared.where(F.length("key") >= TITLE_LETTERS).groupBy("run_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("run_id", "key")
    if runs is not None:
        known = runs.where("run_id is not null and title is not null").select("run_id", _prepare("title").alias("p")).select("run_id", F.col("p.key").alias("key")).where(F.length("key") >= TITLE_LETTERS)
        best = best.unionByName(known)
    return best.distinct()


def title_openings(runs: DataFrame | None) -> list[str]:
    """Beginnings of titles before their last word that OPENING_TITLES different titles share; over MAX_FORMS are refused."""
    if runs is None:
        return []
    known = runs.where("title is not null").select("title", F.regexp_extract("title", r"^\s*(\S+(?:\s+\S+)+)\s+\S+\s*$", 1).alias("o")).where("o <> ''").distinct()
    found = _collected(known.groupBy("o").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OPENING_TITLES).select("o"), "openings of titles")
    return sorted({k for o in found if len(k := key(clean(o))) >= TITLE_LETTERS})


def _own_chunk() -> Column:
    return F.floor(F.col("line_index") / CHUNK).cast("int")


def _of_chunks(values: DataFrame, lines: DataFrame) -> DataFrame:
    """(r, c, values) of runs (run_id, values) for every chunk of the run: as many rows as a run has chunks, not lines."""
    chunks = lines.select("run_id", _own_chunk().alias("chunk")).distinct().join(values, "run_id")
    return chunks.select(F.col("run_id").alias("r"), F.col("chunk").alias("c"), *[F.col(v).alias(v) for v in values.columns if v != "run_id"])


def line_symbols(prepared: DataFrame, titles: DataFrame, openings: list[str]) -> DataFrame:
    """(run_id, chunk, at, clean, codes): the lines of each chunk in order, with the codes of their symbols."""

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"run_id": [], "chunk": [], "at": [], "clean": [], "codes": []})
        left, known = left.sort_values("line_index"), sorted(right["key"])
        codes = [code(features(t, known, openings)) for t in left["clean"]]
        return pd.DataFrame({"run_id": left["run_id"].iloc[:1], "chunk": left["chunk"].iloc[:1], "at": [left["line_index"].tolist()], "clean": [left["clean"].tolist()], "codes": [codes]})

    kind = prepared.schema["run_id"].dataType.simpleString()
    # A fixed number of partitions: the work of a chunk is far more than its bytes tell adaptive execution.
    own = prepared.select("run_id", "line_index", "clean", _own_chunk().alias("chunk")).repartition(parallelism(prepared.sparkSession), "run_id", "chunk")
    there = _of_chunks(titles, prepared)
    return own.groupBy("run_id", "chunk").cogroup(there.groupBy("r", "c")).applyInPandas(look, f"run_id {kind}, chunk int, at array<int>, clean array<string>, codes array<int>")


def fit_model(symbols: DataFrame, rounds: int = ROUNDS) -> LineModel:
    """The line model, trained on all chunks; each round sums a few dozen numbers a task."""
    model = LineModel()
    for _ in range(rounds):

        def count(batches: Iterator[pd.DataFrame], model: LineModel = model) -> Iterator[pd.DataFrame]:
            total = sum((model.counts([list(c) for c in pdf["codes"]]) for pdf in batches), model.counts([]))
            yield pd.DataFrame({"k": range(len(total)), "n": total})

        sums = symbols.select("codes").mapInPandas(count, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 66 rows
        model = model.refit(np.array([r.n for r in sorted(sums)]) if sums else model.counts([]))
    return model


def labelled_lines(lines: DataFrame, runs: DataFrame | None = None, text: str = "text_raw") -> DataFrame:
    """(run_id, line_index, clean, label) of every line with text."""
    prepared = cut(prepared_lines(lines, text))
    symbols = cut(line_symbols(prepared, run_titles(prepared, runs), title_openings(runs)))
    model = fit_model(symbols)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_index")
        pdf = pdf.assign(label=[STATES[s] for s in model.path(pdf["code"].tolist())])
        return pdf.loc[pdf["own"] == pdf["chunk"], ["run_id", "line_index", "clean", "label"]]

    kind = lines.schema["run_id"].dataType.simpleString()
    each = symbols.select("run_id", F.explode(F.arrays_zip("at", "clean", "codes")).alias("x")).select("run_id", F.col("x.at").alias("line_index"), "x.clean", F.col("x.codes").alias("code"))
    return cut(_chunks(each).groupBy("run_id", "chunk").applyInPandas(label, f"run_id {kind}, line_index int, clean string, label string"))


def proper_names(labelled: DataFrame, forms: list[str], given: list[str], family: list[str] | None = None) -> list[str]:
    """Capitalised words of the body that the lexicon lacks and that are names by their number or their parts.

    By number: they stand in NAME_LINES lines. By parts: of a beginning and an ending that two other such words
    have. Those that look like a misread form or name are left out. The rules are the same for any number of
    lines. Words are counted and judged in distributed tables; only the names are collected, and over MAX_FORMS refused.
    """
    plain = labelled.sparkSession.sparkContext.broadcast(Vocabulary(forms, given, family))

    @F.pandas_udf(T.BooleanType())
    def unknown(s: pd.Series) -> pd.Series:
        return s.map(lambda w: not plain.value.has(w)).astype(bool)

    @F.pandas_udf(T.BooleanType())
    def like_a_form(s: pd.Series) -> pd.Series:
        return s.map(lambda w: bool(plain.value.nearest(w, 1)[1])).astype(bool)

    words = labelled.where("label = 'body'").select(F.explode(_capitalised("clean")).alias("w"))
    found = cut(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(unknown("w")))
    often = found.where(F.col("n") >= NAME_LINES)
    rare = found.where(F.col("n") < NAME_LINES).withColumn("l", F.lower("w")).join(_parted(found), "l", "left_semi").select("w", "n")
    likely = cut(often.unionByName(rare).where(~like_a_form("w")))
    # Within two edits of a word eight times as frequent: a misread name.
    near = candidates(likely.select(F.col("w").alias("word")), found.where("n >= 8").select(F.col("w").alias("form")), k=None).select(F.col("word").alias("w"), F.col("form").alias("x"))
    counted = near.join(likely, "w").join(found.select(F.col("w").alias("x"), F.col("n").alias("m")), "x")
    return _collected(likely.join(counted.where("m >= 8 * n"), "w", "left_anti").select("w"), "names")


def _parted(found: DataFrame) -> DataFrame:
    """(l): lower-case words of a beginning and an ending that two others have each, and none other both."""
    words = found.select(F.lower("w").alias("l")).distinct().withColumn("k", F.length("l")).where("k >= 5")
    head, tail = lambda i: F.substring("l", F.lit(1), F.col(i)), lambda i: F.substring("l", F.col(i) + 1, F.col("k"))
    seams = words.withColumn("i", F.explode(F.sequence(F.lit(2), F.col("k") - 3)))
    cuts = seams.select("l", head("i").alias("h"), tail("i").alias("t"))
    shared = lambda c: cuts.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(c)
    kept = cuts.join(shared("h"), "h", "left_semi").join(shared("t"), "t", "left_semi")
    both = seams.withColumn("j", F.explode(F.sequence(F.lit(2), F.col("k") - 3))).select(head("i").alias("h"), tail("j").alias("t"))
    alone = both.join(kept, ["h", "t"], "left_semi").groupBy("h", "t").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return kept.join(alone, ["h", "t"], "left_semi").select("l").distinct()


def _collected(words: DataFrame, what: str) -> list[str]:
    """Values of the one column; more than the tasks can hold are refused, not shortened."""
    out = [r[0] for r in words.limit(MAX_FORMS + 1).collect()]
    if len(out) > MAX_FORMS:
        raise ValueError(f"there are over {MAX_FORMS} {what}; they would not fit the tasks")
    return out


def vocabulary_of(lexicon: DataFrame, labelled: DataFrame, name_forms: DataFrame | None) -> Vocabulary:
    """Forms and names for the tasks. Both are fixed tables; one of over MAX_FORMS forms is refused, not shortened."""
    forms = _collected(lexicon.select("form").where("form is not null").distinct(), "forms in the lexicon")
    given, family = ([], []) if name_forms is None else [_collected(name_forms.where(f"form is not null and role = '{role}'").select("form").distinct(), f"{role} names in name_forms") for role in ("given", "family")]
    return Vocabulary(forms, given + proper_names(labelled, forms, given, family), family)


def _by_chunk(labelled: DataFrame, vocabulary: Vocabulary, work, schema: str, usual: DataFrame | None = None) -> DataFrame:
    """`work` on the lines of every chunk and its margins; `usual` (run_id, usual) goes to each chunk of its run."""
    shared = labelled.sparkSession.sparkContext.broadcast(vocabulary)

    def run(pdf: pd.DataFrame, *more) -> pd.DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        if not len(pdf):
            return pd.DataFrame({c: [] for c in columns})
        pdf = pdf.sort_values("line_index")
        run_id = pdf["run_id"].iloc[0]
        own = set(pdf.loc[pdf["own"] == pdf["chunk"], "line_index"])
        rows = work(list(zip(pdf["line_index"].tolist(), pdf["clean"])), dict(zip(pdf["line_index"].tolist(), pdf["label"])), shared.value, *more)
        return pd.DataFrame([(run_id, *r) for r in rows if r[0] in own], columns=columns)

    groups = _chunks(labelled).groupBy("run_id", "chunk")
    if usual is None:
        return groups.applyInPandas(lambda pdf: run(pdf), schema)
    there = _of_chunks(usual, labelled).groupBy("r", "c")
    return groups.cogroup(there).applyInPandas(lambda pdf, more: run(pdf, int(more["usual"].max()) if len(more) else 0), schema)


def line_noise(lines: DataFrame, lexicon: DataFrame, runs: DataFrame | None = None, name_forms: DataFrame | None = None, text: str = "text_raw") -> DataFrame:
    """(run_id, line_index, noise, detail) with noise header, page_no, hyphen or misread; each once.

    `detail` is the title or number, the whole of the broken word, or the misread words. Lines with a null
    id or text, and blank ones, have no noise; repeated rows count once; of several texts of one line the
    least counts. An empty table gives no rows; other columns are ignored.
    """
    labelled = labelled_lines(lines, runs, text)
    kind = lines.schema["run_id"].dataType.simpleString()
    return _by_chunk(labelled, vocabulary_of(lexicon, labelled, name_forms), find_noise, f"run_id {kind}, line_index int, noise string, detail string")


def repaired_lines(lines: DataFrame, lexicon: DataFrame, runs: DataFrame | None = None, name_forms: DataFrame | None = None, text: str = "text_raw") -> DataFrame:
    """(run_id, line_index, text): what each body line gives to the continuous text of its run; see `paragraphs`."""
    labelled = labelled_lines(lines, runs, text)
    kind = lines.schema["run_id"].dataType.simpleString()
    return _by_chunk(labelled, vocabulary_of(lexicon, labelled, name_forms), paragraphs, f"run_id {kind}, line_index int, text string", usual_lengths(labelled))


def usual_lengths(labelled: DataFrame) -> DataFrame:
    """(run_id, usual): the upper median of the lengths of a run's body lines, from the numbers of lines of each length."""
    lengths = labelled.where("label = 'body'").groupBy("run_id", F.length("clean").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("run_id")  # as many rows as a run has lengths
    upto = F.sum("n").over(run.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return lengths.select("run_id", "k", upto.alias("upto"), F.sum("n").over(run).alias("total")).where("upto > total div 2").groupBy("run_id").agg(F.min("k").alias("usual"))


def run_paragraphs(lines: DataFrame, lexicon: DataFrame, runs: DataFrame | None = None, name_forms: DataFrame | None = None, text: str = "text_raw") -> DataFrame:
    """(run_id, paragraph_no, text): the continuous text of each run, paragraphs numbered from 0 in order.

    The parts of `repaired_lines` are joined by spaces. A paragraph's number is the number of ends before it: those
    of earlier chunks, summed over one row a chunk, and those of its own. A run without body lines has no rows.
    """
    chunk = F.floor(F.col("line_index") / CHUNK).cast("int")
    parts = cut(repaired_lines(lines, lexicon, runs, name_forms, text).select("run_id", chunk.alias("chunk"), "line_index", F.regexp_replace("text", "\n$", "").alias("text"), F.col("text").endswith("\n").cast("bigint").alias("ends")))
    earlier = Window.unboundedPreceding, -1
    ended = F.sum("ends").over(Window.partitionBy("run_id").orderBy("chunk").rowsBetween(*earlier))
    chunks = parts.groupBy("run_id", "chunk").agg(F.sum("ends").alias("ends")).select("run_id", "chunk", F.coalesce(ended, F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("ends").over(Window.partitionBy("run_id", "chunk").orderBy("line_index").rowsBetween(*earlier)), F.lit(0))
    numbered = parts.withColumn("within", within).join(chunks, ["run_id", "chunk"]).where("text <> ''")
    order = F.array_sort(F.collect_list(F.struct("line_index", "text")))
    out = numbered.groupBy("run_id", (F.col("before") + F.col("within")).alias("paragraph_no")).agg(order.alias("parts"))
    return out.select("run_id", "paragraph_no", F.array_join("parts.text", " ").alias("text"))
