"""Problem 7: held-out passages that occur, whole or in part, in a corpus.

Method: a broadcast hash set of the normalised n-grams of the held-out items; one scan of the corpus
slides a window of n words over every text, looks its hash up, and verifies each hit word by word. Spans with a
verified hit are cut out of the texts, or the documents are dropped.

Words are runs of letters, compared without case, accents, v/u, j/i and long s; whatever stands between them is
ignored; a word broken by a mark at the end of a line is whole.

The set is broadcast only up to `max_set_bytes`. More items are split by a hash of their id into blocks
that fit, one scan each, so any number of items gives the same result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut

#: Marks that break a word at the end of a line (fixed values).
BREAK_MARKS = "-‐‑‒–¬⸗=~­"
#: Bytes that an n-gram takes in the broadcast set, at most, with its words.
BYTES_PER_GRAM = 200

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(64)], np.uint64)


def _members(wanted) -> str:
    """Members for a re character class: the characters whose general category is wanted."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        ok = c <= sys.maxunicode and wanted(c)
        if ok and start is None:
            start = c
        elif not ok and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """A broken line end, marks and invisible signs, and a word: letters with marks among them."""
    marks = _members(lambda c: unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cf"))
    odd = _members(lambda c: unicodedata.category(chr(c)) in ("Nl", "No"))
    letter = rf"[^\W\d_{odd}]"
    latin = "A-Za-zÀ-ÖØ-öø-ÿ"  # tried first, as its class is small
    return re.compile(rf"[{re.escape(BREAK_MARKS)}][^\S\n\r]*[\n\r]\s*"), re.compile(f"[{marks}]+"), re.compile(rf"[{latin}]+(?![{latin}ªºµ\xad]|[^\x00-\xff])|{letter}+(?:[{marks}]+{letter}*)*")


def fold(word: str) -> str:
    """Lower case, without accents, marks and invisible signs; v, j and long s as u, i and s."""
    if not word.isascii():
        word = _patterns()[1].sub("", unicodedata.normalize("NFKD", word))
    return word.lower().replace("v", "u").replace("j", "i").replace("ſ", "s")


def _joined(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with words broken at a line end joined, and the stretches taken out for it."""
    gone: list[tuple[int, int]] = []
    if "\n" in text or "\r" in text:
        broken, marks, _ = _patterns()

        def join(m: re.Match) -> str:
            before, after = text[: m.start()][-8:], text[m.end() : m.end() + 1]
            if not (after.isalpha() and marks.sub("", before)[-1:].isalpha()):
                return m.group()
            gone.append(m.span())
            return ""

        return broken.sub(join, text), gone
    return text, gone


def raw_words(text: str) -> list[str]:
    """Words as they stand, those broken at a line end joined."""
    return _patterns()[2].findall(_joined(text)[0])


def located_words(text: str) -> tuple[list[str], list[int], list[int]]:
    """`raw_words`, and where each begins and ends in the text."""
    plain, gone = _joined(text)
    found = list(_patterns()[2].finditer(plain))
    starts, ends = [m.start() for m in found], [m.end() for m in found]
    if gone:
        # What was taken out before a place of the joined text: the breaks whose place in it is not behind.
        size = np.cumsum([z - a for a, z in gone])
        place = np.array([a for a, _ in gone]) - np.append(0, size[:-1])
        shift = np.append(0, size)
        starts = [x + int(shift[np.searchsorted(place, x, "right")]) for x in starts]
        ends = [x + int(shift[np.searchsorted(place, x, "left")]) for x in ends]
    return [m.group() for m in found], starts, ends


def words(text: str) -> list[str]:
    return [w for w in map(fold, raw_words(text)) if w]


class _Ids(dict):
    """Ids by word as it stands; -1 for words outside the vocabulary. Bounded: it only saves time."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = self.vocabulary.get(fold(word), -1)
        return found


class GramSet:
    """Word n-grams of a block of items: sorted hashes for the scan, the words for the check."""

    def __init__(self, items: list[tuple[object, str]], n: int) -> None:
        self.n = n
        self.ids: _Ids | None = None  # made in each worker
        self.vocabulary: dict[str, int] = {}
        grams: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for i in range(len(ids) - n + 1):
                grams.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.grams = grams
        self.hashes = np.unique(np.array([self._hash(np.array(g, np.int64), np.zeros(1, np.int64))[0] for g in grams], np.uint64)) if grams else np.zeros(0, np.uint64)

    def _hash(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            x = ids.astype(np.uint64) + np.uint64(1)
            for k in range(self.n):
                h += x[starts + k] * _FACTORS[k]
            return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def hits(self, text: str) -> list[tuple[int, set]]:
        """(index of the first word, items) of every window that is an n-gram of an item."""
        return self._hits(raw_words(text))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Stretches of the text that windows with an n-gram of an item cover, in order and apart."""
        found, starts, ends = located_words(text)
        out: list[list[int]] = []
        for i, _ in self._hits(found):
            a, z = starts[i], ends[i + self.n - 1]
            if out and a <= out[-1][1]:
                out[-1][1] = max(z, out[-1][1])
            else:
                out.append([a, z])
        return [(a, z) for a, z in out]

    def _hits(self, found: list[str]) -> list[tuple[int, set]]:
        if self.ids is None:
            self.ids = _Ids(self.vocabulary)
        if len(found) < self.n or not len(self.hashes):
            return []
        ids = np.fromiter(map(self.ids.__getitem__, found), np.int64, len(found))
        seen = np.concatenate([[0], np.cumsum(ids >= 0)])
        starts = np.nonzero(seen[self.n :] - seen[: -self.n] == self.n)[0]
        if not len(starts):
            return []
        h = self._hash(ids, starts)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        out = []
        for i in starts[self.hashes[at] == h].tolist():
            items = self.grams.get(tuple(ids[i : i + self.n].tolist()))
            if items:
                out.append((i, items))
        return out


def _blocks(items: DataFrame, item_id: str, item_text: str, max_set_bytes: int) -> list[DataFrame]:
    chosen = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    letters = chosen.agg(F.sum(F.size(F.split("t", r"[^\p{L}\p{M}]+")))).first()[0] or 0
    k = int(letters * BYTES_PER_GRAM // max_set_bytes) + 1
    return [chosen.where(F.pmod(F.xxhash64("i"), F.lit(k)) == b) for b in range(k)] if k > 1 else [chosen]


def find_leaks(corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 8, max_set_bytes: int = 64 << 20) -> DataFrame:
    """Pairs (doc_id, item_id), each once: the document has `n` consecutive words of the item at least.

    Null ids and null texts take no part; empty texts and items under `n` words match nothing; repeated
    rows of either table give the same pairs once; empty tables give no rows; other columns are ignored.
    """
    spark = corpus.sparkSession
    source = corpus.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    d_type, i_type = source.schema["d"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    parts = []
    for block in _blocks(items, item_id, item_text, max_set_bytes):
        grams = spark.sparkContext.broadcast(GramSet([(r.i, r.t) for r in block.collect()], n))

        def scan(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            index = grams.value
            for batch in batches:
                docs, found = [], []
                for doc, body in zip(batch.column(0), batch.column(1)):
                    hit = set().union(*(items for _, items in index.hits(body.as_py())))
                    docs.extend([doc.as_py()] * len(hit))
                    found.extend(sorted(hit))
                yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(found) if found else pa.array([], pa.null())], ["d", "i"]).cast(pa.schema([("d", batch.schema.field(0).type), ("i", _ARROW.get(i_type, pa.string()))]))

        parts.append(source.mapInArrow(scan, f"d {d_type}, i {i_type}"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(F.col("d").alias(doc_id), F.col("i").alias(item_id)).distinct()


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}


def drop_leaking_documents(corpus: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`corpus` without the documents of `leaks`; rows with a null id stay."""
    return corpus.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")


def remove_leaks(corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 8, max_set_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, text, n_spans): every row of `corpus`, its text without the stretches that have `n` consecutive words of an item.

    A stretch runs from the first letter of its first window to the last letter of its last; overlapping ones are
    one. Null and empty texts, and texts without such words, stay as they are with 0 spans; a null id is an id; repeated rows stay.
    """
    spark = corpus.sparkSession
    rows = corpus.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    schema = f"d {rows.schema['d'].dataType.simpleString()}, t string, a array<int>, z array<int>"
    none = F.array().cast("array<int>")
    rows = rows.select("d", "t", none.alias("a"), none.alias("z"))
    blocks = _blocks(items, item_id, item_text, max_set_bytes)
    for k, block in enumerate(blocks):
        grams = spark.sparkContext.broadcast(GramSet([(r.i, r.t) for r in block.collect()], n))

        def scan(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            index = grams.value
            for batch in batches:
                firsts, lasts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for a, z, body in zip(firsts, lasts, batch.column(1)):
                    for x, y in index.spans(body.as_py()) if body.is_valid else []:
                        a.append(x)
                        z.append(y)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32()))], ["d", "t", "a", "z"])

        rows = rows.mapInArrow(scan, schema)
        # One set at a time is in a worker's memory.
        rows = cut(rows) if k + 1 < len(blocks) else rows
    spans = F.aggregate(
        F.array_sort(F.arrays_zip("a", "z")),
        F.array().cast("array<struct<a:int,z:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["a"] <= F.element_at(acc, -1)["z"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["z"], s["z"]).alias("z")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["a"].alias("a"), s["z"].alias("z"))))),
    )
    s = rows.withColumn("s", F.when(F.size("a") > 0, spans).otherwise(F.array().cast("array<struct<a:int,z:int>>")))
    # What is left stands between the end of each stretch and the beginning of the next.
    ends, begins = F.concat(F.array(F.lit(0)), F.transform("s", lambda x: x["z"])), F.concat(F.transform("s", lambda x: x["a"]), F.array(F.length("t")))
    kept = F.array_join(F.zip_with(ends, begins, lambda a, z: F.substring(F.col("t"), a + 1, z - a)), "")
    return s.select(F.col("d").alias(doc_id), F.when(F.size("s") > 0, kept).otherwise(F.col("t")).alias(text), F.size("s").alias("n_spans"))
