"""Problem 2: how often every distinct term occurs, and in how many records.

Method: a global integer dictionary, terms encoded to integers, count arrays summed by identifier range.

1. The global dictionary gives a term the number of its seeded 64-bit hash, so every task encodes by it without
   asking for it. Two terms of one number are found where the dictionary is put together; then the whole is
   done again under the next seed, so numbers are unique in every result.
2. Every task adds up two integer arrays, occurrences and record presence, by `numpy.bincount` over a block's codes. A block ends
   with the task or when it holds `BLOCK_TERMS` terms; only its arrays, in the order of the numbers, and its part of the
   dictionary leave the task, so a term that fills a third of the corpus costs one entry a block.
3. The blocks are cut at the borders of identifier ranges, as many ranges as keep a task near `RANGE_TERMS` entries, however
   large the dictionary. Each range sums its arrays by number and puts its part of the dictionary together.

The vocabulary never reaches the driver; three numbers do: records, entries of all blocks, and numbers that two terms share.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut, parallelism

#: Terms a block may hold before its arrays are passed on; entries a range is planned for. Both bound a task's memory, not the result.
BLOCK_TERMS, RANGE_TERMS = 200_000, 2_000_000

_BLOCK = pa.schema([("term", pa.string()), ("occ", pa.int64()), ("pres", pa.int64())])
_PACK = pa.schema([("range", pa.int32()), ("records", pa.int64()), ("entries", pa.int64()), ("numbers", pa.binary()), ("occ", pa.binary()), ("pres", pa.binary()), ("ends", pa.binary()), ("terms", pa.binary())])
_PACK_DDL = "range int, records bigint, entries bigint, numbers binary, occ binary, pres binary, ends binary, terms binary"
_RANGE = pa.schema([("term", pa.string()), ("term_id", pa.int64()), ("occ", pa.int64()), ("pres", pa.int64()), ("shared", pa.bool_())])
_RANGE_DDL = "term string, term_id bigint, occ bigint, pres bigint, shared boolean"


def split_terms(text: str) -> list[str]:
    """Longest runs of letters and combining marks in the lower-cased, composed text."""
    import regex

    return regex.findall(r"[\p{L}\p{M}]+", unicodedata.normalize("NFC", text.lower()))


class _Counts:
    """Growing int64 arrays indexed by integer code."""

    def __init__(self) -> None:
        self.occ = np.zeros(1024, np.int64)
        self.pres = np.zeros(1024, np.int64)

    def add(self, codes: np.ndarray, rows: np.ndarray, size: int) -> None:
        if size > len(self.occ):
            room = max(size, 2 * len(self.occ))
            self.occ = np.concatenate([self.occ, np.zeros(room - len(self.occ), np.int64)])
            self.pres = np.concatenate([self.pres, np.zeros(room - len(self.pres), np.int64)])
        self.occ[:size] += np.bincount(codes, minlength=size)
        once = np.unique(rows * np.int64(size) + codes) % size
        self.pres[:size] += np.bincount(once, minlength=size)


def _encode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code: dict[str, int] = {}
    counts, records = _Counts(), 0

    def out() -> pa.RecordBatch:
        n = len(code)
        # The empty string is no term; its row carries the number of records.
        return pa.RecordBatch.from_arrays([pa.array([*code, ""], pa.string()), pa.array(np.append(counts.occ[:n], 0)), pa.array(np.append(counts.pres[:n], records))], schema=_BLOCK)

    for batch in batches:
        flat: list[int] = []
        lengths: list[int] = []
        for text in batch.column(0).to_pylist():
            words = split_terms(text)
            lengths.append(len(words))
            flat.extend([code.setdefault(w, len(code)) for w in words])
        records += len(lengths)
        if flat:
            counts.add(np.array(flat, np.int64), np.repeat(np.arange(len(lengths), dtype=np.int64), lengths), len(code))
        if len(code) > BLOCK_TERMS:
            yield out()
            code, counts, records = {}, _Counts(), 0
    yield out()


def number(term: str, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"), seed)


def _packed(at: int, records: int, numbers: np.ndarray, occ: np.ndarray, pres: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
    ends = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1, 4 * terms.offset) if len(terms) else np.zeros(1, np.int32)
    raw = terms.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if len(terms) and ends[-1] > ends[0] else b""
    values = at, records, len(numbers), numbers.tobytes(), occ.tobytes(), pres.tobytes(), (ends - ends[0]).tobytes(), raw
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _PACK.types)], schema=_PACK)


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    terms = pa.Array.from_buffers(pa.string(), r["entries"], [None, pa.py_buffer(r["ends"]), pa.py_buffer(r["terms"])])
    return np.frombuffer(r["numbers"], np.uint64), np.frombuffer(r["occ"], np.int64), np.frombuffer(r["pres"], np.int64), terms


def _numbered(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Blocks of `_encode_blocks` under their numbers in the global dictionary, in the order of these, one row each."""
    for block in batches:
        terms, occ, pres = block.column(0), block.column(1).to_numpy(), block.column(2).to_numpy()
        n = len(terms) - 1
        numbers = np.fromiter((number(t, seed) for t in terms.slice(0, n).to_pylist()), np.uint64, n)
        order = np.argsort(numbers, kind="stable")
        yield _packed(0, int(pres[-1]), numbers[order], occ[order], pres[order], terms.take(pa.array(order)))


def _cut_ranges(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Each block cut where an identifier range ends."""
    borders = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    for batch in batches:
        for r in batch.to_pylist():
            numbers, occ, pres, terms = _unpacked(r)
            edges = [0, *np.searchsorted(numbers, borders, "left").tolist(), len(numbers)]
            for k, (a, z) in enumerate(zip(edges, edges[1:])):
                if a < z:
                    yield _packed(k, 0, numbers[a:z], occ[a:z], pres[a:z], terms.slice(a, z - a))


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arrays of a range summed by number, with the terms that the numbers stand for."""
    parts: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            parts.setdefault(r["range"], []).append(_unpacked(r))
    for k in sorted(parts):
        blocks = parts.pop(k)
        numbers, occ, pres = (np.concatenate([b[i] for b in blocks]) for i in range(3))
        terms = pa.concat_arrays([b[3] for b in blocks])
        order = np.argsort(numbers, kind="stable")
        numbers, terms = numbers[order], terms.take(pa.array(order))
        begin = np.nonzero(np.append(True, numbers[1:] != numbers[:-1]))[0]
        # Neighbours of one number must be one term.
        other = np.append(False, (numbers[1:] == numbers[:-1]) & pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False))
        columns = [terms.take(pa.array(begin)), pa.array(numbers[begin].view(np.int64)), pa.array(np.add.reduceat(occ[order], begin)), pa.array(np.add.reduceat(pres[order], begin)), pa.array(np.add.reduceat(other.astype(np.int64), begin) > 0)]
        whole = pa.RecordBatch.from_arrays(columns, schema=_RANGE)
        for at in range(0, len(begin), 65_536):
            yield whole.slice(at, 65_536)


def _summed(records: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """(term, term_id, occ, pres, shared) of all terms under a seed, and the number of records."""
    blocks = cut(records.mapInArrow(lambda batches: _numbered(_encode_blocks(batches), seed), _PACK_DDL))
    total, entries = blocks.agg(F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    ranges = max(-(-entries // RANGE_TERMS), min(parallelism(records.sparkSession), -(-entries // 10_000)), 1)
    parts = blocks.mapInArrow(lambda batches: _cut_ranges(batches, ranges), _PACK_DDL)
    return cut(parts.repartitionById(ranges, "range").mapInArrow(_sum_ranges, _RANGE_DDL)), total


def term_frequencies(df: DataFrame, id_col: str, text_col: str, min_records: int = 3, max_share: float = 0.05) -> DataFrame:
    """Every distinct term of `text_col` with its counts over the distinct records of `id_col`.

    Columns: term, term_id (unique within a result), n_occurrences, n_records, n_total (records with
    a text), mark: `rare` in fewer than `min_records` records, `common` in more than `max_share` of all,
    else null; a term that would be both is `rare`.

    Nulls: a record without text does not count; rows with a null id are one record a distinct text. Rows of one id with
    several texts count once, with the least text. Empty or blank texts count as records without terms.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    texts = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    # A null id is no key: its rows are told apart by their text.
    records = texts.groupBy("i", F.when(F.col("i").isNull(), F.col("t")).alias("k")).agg(F.min("t").alias("t")).select("t")
    seed = 0
    while True:
        summed, total = _summed(records, seed)
        if not summed.where("shared").limit(1).collect():
            break
        seed += 1
    mark = F.when(F.col("pres") < min_records, F.lit("rare")).when(F.col("pres") > max_share * total, F.lit("common"))
    return summed.select("term", "term_id", F.col("occ").alias("n_occurrences"), F.col("pres").alias("n_records"), F.lit(total).cast("bigint").alias("n_total"), mark.alias("mark"))
