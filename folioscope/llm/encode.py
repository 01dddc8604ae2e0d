"""Problem 6: encode texts with a public byte-level BPE vocabulary.

Method: a hierarchical-bitmap rank queue. Each pre-token is a linked list of byte positions. Every
adjacent pair that the vocabulary can merge waits in the bucket of its merge rank; a bitmap with three
levels of 64-bit words says which buckets are filled, so find-first-set picks the next rank in three
steps. Entries whose pair has changed meanwhile are stale and skipped. The work is n log n in the bytes
of a pre-token, however long it is.

Pre-tokens repeat, so each Python worker keeps the ids of those it has seen in a cache of bounded size.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pre-tokens a worker's cache may hold, and the longest that enters it (memory only).
CACHE_SIZE, CACHE_LENGTH = 400_000, 64


class RankQueue:
    """Buckets of positions by rank, least rank first, within a rank the leftmost position first.

    A bucket is a heap of positions; positions offered in ascending order cost an append. The queue is
    empty after each pre-token, so one serves for all and nothing is allocated for each.
    """

    __slots__ = ("buckets", "words", "groups", "top")

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.words = [0] * ((ranks >> 6) + 1)
        self.groups = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            heapq.heappush(bucket, position)
            return
        bucket.append(position)
        word = rank >> 6
        if not self.words[word]:
            group = rank >> 12
            self.groups[group] |= 1 << (word & 63)
            self.top |= 1 << group
        self.words[word] |= 1 << (rank & 63)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        bits = self.groups[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.words[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        self.words[word] = bits & (bits - 1)
        if not self.words[word]:
            self.groups[group] &= self.groups[group] - 1
            if not self.groups[group]:
                self.top &= self.top - 1
        return rank, bucket.pop()


def _classes() -> tuple[str, str, str]:
    """Members for re character classes: letters, numbers, white space (Unicode White_Space)."""

    def runs(chosen: list[int]) -> str:
        out, i = [], 0
        while i < len(chosen):
            j = i
            while j + 1 < len(chosen) and chosen[j + 1] == chosen[j] + 1:
                j += 1
            out.append(f"\\U{chosen[i]:08x}-\\U{chosen[j]:08x}" if j > i else f"\\U{chosen[i]:08x}")
            i = j + 1
        return "".join(out)

    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    space = [c for c in range(sys.maxunicode + 1) if (kinds[c] == "Z" or 9 <= c <= 13 or c == 0x85)]
    return runs([c for c, k in enumerate(kinds) if k == "L"]), runs([c for c, k in enumerate(kinds) if k == "N"]), runs(space)


@lru_cache(maxsize=1)
def splitter() -> re.Pattern:
    """The byte-level pre-tokenizer's pattern: contractions, letters, numbers, other signs, white space."""
    letter, number, space = _classes()
    # Runs of Latin letters come first, as their class is small; one that goes on in another letter is left to the full class.
    latin = "A-Za-zÀ-ÖØ-öø-ÿ"
    return re.compile(rf" ?[{latin}]+(?![{latin}ªºµ]|[^\x00-\xff])|'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class ByteBPE(dict):
    """Ids by pre-token; absent ones are encoded and, within the bounds, kept."""

    def __init__(self, vocabulary: str) -> None:
        super().__init__()
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # Byte-level alphabet: printable Latin-1 signs stand for themselves, the others for U+0100 onwards.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(plain)]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.first = [vocab[sign[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.queue = RankQueue(len(self.merges))
        self.find = splitter().findall

    def __missing__(self, piece: str) -> list[int]:
        ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        ids = [self.first[b] for b in data]
        n = len(ids)
        if n == 1:
            return ids
        merges, push, pop = self.merges, self.queue.push, self.queue.pop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pending = [-1] * n  # the rank that the pair at a position waits for; any other entry of it is stale

        for i in range(n - 1):
            if pair := merges.get((ids[i], ids[i + 1])):
                pending[i] = pair[0]
                push(pair[0], i)
        while entry := pop():
            rank, i = entry
            if pending[i] != rank:
                continue
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = pending[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for left in (i, before[i]):
                if left >= 0:
                    right = after[left]
                    if right < n and (pair := merges.get((ids[left], ids[right]))):
                        pending[left] = pair[0]
                        push(pair[0], left)
                    else:
                        pending[left] = -1
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.find(text))))


@lru_cache(maxsize=2)
def load(vocabulary: str) -> ByteBPE:
    """One encoder per Python worker and vocabulary."""
    return ByteBPE(vocabulary)


def encode_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row for each row of `df`: its id and `ids`, the token ids without special tokens.

    Empty and null texts give an empty list; strings of special tokens in a text are ordinary text. Null
    ids and repeated rows stay as they are; other columns are dropped. No shuffle: one Arrow pass over
    two columns. `vocabulary` must be readable on every executor.
    """
    source = df.select(df[id_col].alias(id_col), df[text_col].alias("__text"))
    id_type = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        get, find = bpe.__getitem__, bpe.find
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column(1):
                text = text.as_py()
                if text:
                    flat.extend(chain.from_iterable(map(get, find(text))))
                ends.append(len(flat))
            values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], [id_col, "ids"])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def vocabulary_path() -> str:
    """Place of the vocabulary file; FOLIOSCOPE_BPE overrides it."""
    return os.environ.get("FOLIOSCOPE_BPE", DEFAULT_VOCABULARY)
