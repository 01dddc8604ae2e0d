"""Problem 4: lines of evaluation splits that stand, exactly or almost, in the train split.

Almost: both texts have `MIN_CHARS` characters and their edit distance is at most a fifth of the longer.

Method: an exact prefix-filter join on rare shingles between the two sides.

1. A shingle is a run of Q characters, hashed to one of 2^18 numbers (equal runs have equal numbers, so a collision only
   adds candidates). Shingle counts of either side, tables of at most 2^18 numbers, give the order from rare to common.
2. Prefix: of every distinct text as many shingles as its edit limit and one more, which do not overlap, the rarest
   such set on the other side. Each edit destroys one of them at most, so if the longer of two similar texts
   loses no more than its limit, one of its prefix shingles stands in the other. (A text of `MIN_CHARS` or more
   always has room for them.)
3. Length and position filters: the k-th prefix shingle counts only if it is shifted by less than k places as seen from
   the beginning, and by no more than the limit and one less k as seen from the end; some shingle of a similar pair is so.
   Postings are sorted by shingle, band of lengths and place, so that the places are a range of each band.
   Then bounds from bit signatures of shorter shingles, at last the edit distance itself.
4. Pairs of texts are joined back to line ids.

Layout: the distinct texts of a side are dealt to blocks of about `BLOCK_POSTINGS` shingles by a hash, so that their number
follows from the texts, not from the size of the cluster. A block is one compressed row: texts, lengths and prefixes as bits.
Each block of evaluation texts meets each of train in a task that makes the postings of both for itself. The blocks are read
where they lie, so the join shuffles and writes nothing but its pairs, and a hot shingle is spread over all tasks.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut

Q, SHINGLE_BITS, SIGNATURE_WORDS = 4, 18, 8
MIN_CHARS, SHARE = 20, 5  # a text counts from MIN_CHARS characters on; the distance is at most 1/SHARE of the longer
LEAST_BUCKETS, BUCKET_POSTINGS, PART_POSTINGS, EXACT_LENGTH = 12, 1_500_000, 100_000, 400
BLOCK_POSTINGS = 4_000_000  # shingles of a block


def code_points(texts: list[str]) -> np.ndarray:
    """Texts of one length as rows of code points."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(texts), -1).astype(np.uint64)


def shingles(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Numbers of the runs of q characters by position, for rows of code points."""
    n = max(points.shape[1] - q + 1, 0)
    h = np.zeros((len(points), n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            h = h * np.uint64(0x100000001B3) + points[:, k : k + n]
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SHINGLE_BITS)


def postings(points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, shingle) of all shingles of texts that follow each other in `points`."""
    places = np.maximum(length - Q + 1, 0)
    owner = np.repeat(np.arange(len(length), dtype=np.int32), places)
    place = (np.arange(len(owner)) - (np.cumsum(places) - places)[owner]).astype(np.int32)
    start = np.cumsum(length, dtype=np.int64) - length
    return owner, place, shingles(points[None])[0][start[owner] + place].astype(np.int32)


def signatures(points: np.ndarray, q: int) -> np.ndarray:
    """Rows of 512 bits for the runs of q characters; the n-th occurrence of a run has a bit of its own."""
    rows = len(points)
    bits = np.zeros((rows, 64 * SIGNATURE_WORDS), np.uint8)
    g = np.sort((shingles(points, q) >> np.uint64(SHINGLE_BITS - 16)).astype(np.uint16), axis=1)
    place = np.broadcast_to(np.arange(g.shape[1], dtype=np.int32), g.shape)
    fresh = np.ones(g.shape, bool)
    fresh[:, 1:] = g[:, 1:] != g[:, :-1]
    nth = place - np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
    with np.errstate(over="ignore"):
        bit = ((g.astype(np.uint32) + nth.astype(np.uint32) * np.uint32(0x9E3779B1)) * np.uint32(0xD6E8FEB9)) >> np.uint32(23)
    bits[np.arange(rows)[:, None], bit] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def lost_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bound, from signatures, of the runs of `a` that `b` lacks; an edit destroys q runs of q characters at most."""
    each = np.bitwise_count(a & ~b)  # numbers of up to 64, eight or four in a word, added up by multiplication
    each = each.view(np.uint64 if each.shape[1] == 8 else np.uint32).ravel().astype(np.uint64)
    low = np.uint64(0x00FF00FF00FF00FF)
    with np.errstate(over="ignore"):
        return ((((each & low) + (each >> np.uint64(8) & low)) * np.uint64(0x0001000100010001)) >> np.uint64(48)).astype(np.int64)


def prefixes(counts: np.ndarray, k: int, q: int = Q) -> np.ndarray:
    """Marks the rarest k shingles that do not overlap, for texts of one length: rows of shingle counts to rows of 0 and 1.

    Least sum of counts by dynamic programming; beyond `EXACT_LENGTH` places the rarest in each of k equal
    stretches, as any k that do not overlap will do.
    """
    rows, n = counts.shape
    chosen = np.zeros((rows, n), np.int8)
    if n > EXACT_LENGTH:
        edge = np.linspace(0, n + q - 1, k + 1).astype(np.int64)
        for a, z in zip(edge, edge[1:]):
            best = a + np.argmin(counts[:, a : max(z - q + 1, a + 1)], axis=1)
            chosen[np.arange(rows), best] = 1
        return chosen
    # cost[i][j]: least sum of j shingles that begin before place i - q + 1 and end before place i.
    cost = np.full((n + q, k + 1, rows), np.inf, np.float32)
    cost[:, 0] = 0
    for i in range(1, n + 1):
        cost[i + q - 1, 1:] = np.minimum(cost[i + q - 2, 1:], cost[i - 1, :-1] + counts[:, i - 1])
    at, left = np.full(rows, n + q - 1), np.full(rows, k)
    row = np.arange(rows)
    for i in range(n, 0, -1):
        here = (at >= i + q - 1) & (left > 0)
        take = here & (cost[i + q - 1, left, row] < cost[i + q - 2, left, row])
        chosen[take, i - 1] = 1
        at = np.where(take, i - 1, at)
        left = left - take
    return chosen


def edit_distance(a: str, b: str, limit: int) -> int:
    """Edit distance of two texts, or limit + 1 if it is larger; bit-parallel over whole texts."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, left = mask, 0, m, len(b)
    for c in b:
        left -= 1
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        if score - left > limit:
            return limit + 1
        ph = (ph << 1 | 1) & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return score


def edit_distances(pairs: list[tuple[str, str]], limits: list[int]) -> list[int]:
    """`edit_distance` of many pairs at once: the same bit-parallel columns, in words of 64 bits over arrays of pairs."""
    out = [0] * len(pairs)
    sized = sorted((-(-min(map(len, p)) // 64), max(map(len, p)), i) for i, p in enumerate(pairs))
    a = 0
    while a < len(sized):
        words, z, letters = sized[a][0], a, set()
        while z < len(sized) and sized[z][0] == words and z - a < 2048 and (z - a + 1) * (len(letters) + 1) * words < 1 << 21:
            letters.update(*pairs[sized[z][2]])
            z += 1
        some = [i for _, _, i in sized[a:z]]
        a = z
        found = _columns([sorted(pairs[i], key=len) for i in some], words, letters) if words and len(some) > 8 else [edit_distance(*pairs[i], limits[i]) for i in some]
        for i, d in zip(some, found):
            out[i] = min(int(d), limits[i] + 1)
    return out


def _columns(pairs: list[list[str]], words: int, code: set[str]) -> np.ndarray:
    """Edit distances of (shorter, longer) pairs whose shorter text takes `words` words of 64 bits."""
    row, u = np.arange(len(pairs)), np.uint64
    m, n = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    letters = np.array(sorted(map(ord, code)), np.uint32)
    short, long = (np.zeros((len(pairs), int(x.max())), np.int64) for x in (m, n))
    for k, (x, out) in enumerate(((m, short), (n, long))):
        points = np.frombuffer("".join(p[k] for p in pairs).encode("utf-32-le", "surrogatepass"), np.uint32)
        out[np.arange(out.shape[1]) < x[:, None]] = np.searchsorted(letters, points)
    peq = np.zeros((len(pairs), len(code), words), u)
    for i in range(short.shape[1]):
        has = row[i < m]
        peq[has, short[has, i], i // 64] |= u(1) << u(i % 64)
    last, at = u(1) << ((m - 1) % 64).astype(u), (m - 1) // 64
    pv, mv = np.full((words, len(pairs)), ~u(0)), np.zeros((words, len(pairs)), u)
    score = m.copy()
    for j in range(long.shape[1]):
        up, down = np.ones(len(pairs), u), np.zeros(len(pairs), u)
        for w in range(words):
            eq = peq[row, long[:, j], w]
            xv = eq | mv[w]
            eq |= down
            xh = (((eq & pv[w]) + pv[w]) ^ pv[w]) | eq
            ph, mh = mv[w] | ~(xh | pv[w]), pv[w] & xh
            here = (at == w) & (j < n)
            score += here * ((ph & last > 0).astype(np.int64) - (mh & last > 0))
            rise, fall = ph >> u(63), mh >> u(63)
            ph, mh = ph << u(1) | up, mh << u(1) | down
            pv[w], mv[w] = mh | ~(xv | ph), ph & xv
            up, down = rise, fall
    return score


def _of_one_length(lengths: np.ndarray, most: int = 2_000_000) -> Iterator[np.ndarray]:
    """Places of equal lengths in an ascending array, in groups of bounded total length."""
    edges = [0, *(np.nonzero(np.diff(lengths))[0] + 1).tolist(), len(lengths)]
    for a, z in zip(edges, edges[1:]):
        step = max(1, min(1024, most // (20 * int(lengths[a]))))
        for at in range(a, z, step):
            yield np.arange(at, min(at + step, z))


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, number in train texts, number in evaluation texts) of a task's texts."""
    counts = np.zeros((2, 1 << SHINGLE_BITS), np.int64)
    for batch in batches:
        texts, sides = batch.column(0).to_pylist(), [batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (1, 2)]
        owner, _, g = postings(code_points(["".join(texts)])[0], np.fromiter(map(len, texts), np.int64, len(texts)))
        for n, member in zip(counts, sides):
            n += np.bincount(g[member[owner]], minlength=len(n))
    at = np.nonzero(counts.any(axis=0))[0]
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], ["g", "t", "e"])


class Layout:
    """Where the postings of each shingle go, were they dealt to buckets (not used by `find_overlaps`, which joins blocks of texts).

    A shingle is cut into parts[0] parts of its train texts by parts[1] parts of its evaluation texts; each such unit has
    a bucket. Units are given to the bucket with the least work so far, the largest first. `counts` are those of
    train and evaluation, at most 2^SHINGLE_BITS each.
    """

    def __init__(self, counts: np.ndarray, buckets: int | None = None, part_postings: int = PART_POSTINGS) -> None:
        self.counts = counts
        self.live = (counts > 0).all(axis=0)
        n = np.where(self.live, counts, 0)
        self.buckets = buckets or max(LEAST_BUCKETS, -(-int(n.sum()) // BUCKET_POSTINGS))
        self.parts = np.maximum(-(-n // part_postings), 1).astype(np.int64)
        units = self.parts[0] * self.parts[1] * self.live
        self.first = np.concatenate([[0], np.cumsum(units)])
        # The pairs that the length and position filters leave are few of all pairs.
        each = n / self.parts
        work = np.repeat(each.sum(axis=0) + each[0] * each[1] / 200, units)
        self.bucket = np.zeros(len(work), np.int32)
        heap = [(0.0, b) for b in range(self.buckets)]
        for u in np.argsort(-work, kind="stable").tolist():
            load, b = heap[0]
            self.bucket[u] = b
            heapq.heapreplace(heap, (load + float(work[u]), b))

    def units(self, g: np.ndarray, texts: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(posting, unit) of live postings with shingles `g` of texts with the hashes `texts`, on a side (0 train, 1 evaluation)."""
        own, other = self.parts[side][g], self.parts[1 - side][g]
        at = np.repeat(np.arange(len(g)), other)
        k = np.arange(len(at)) - np.repeat(np.cumsum(other) - other, other)
        mine = (texts % own.astype(np.uint64)).astype(np.int64)[at]
        t, e = (mine, k) if side == 0 else (k, mine)
        return at, self.first[g[at]] + t * self.parts[1][g[at]] + e


class _Side:
    """A block's texts and their postings: text number, shingle, place, rank in the prefix (0 outside it)."""

    def __init__(self, texts: bytes, lengths: bytes, marks: bytes) -> None:
        self.joined = zlib.decompress(texts).decode("utf-8", "surrogatepass")
        self.length = np.frombuffer(lengths, np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)])
        self.points = code_points([self.joined])[0]
        self.owner, self.place, self.unit = postings(self.points, self.length)
        chosen = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(self.owner))
        nth = np.cumsum(chosen, dtype=np.int32)
        self.rank = chosen * (nth - (nth - chosen)[np.nonzero(self.place == 0)[0]][self.owner])
        self.bits: dict[int, np.ndarray] = {}

    def text(self, i: int) -> str:
        return self.joined[self.start[i] : self.start[i + 1]]

    def signatures(self, q: int) -> np.ndarray:
        """Those of runs of q characters; 0: those of 2 with the halves laid over each other, a bound of half the size."""
        if not self.bits:
            self.bits = {k: np.zeros((len(self.length), SIGNATURE_WORDS), np.uint64) for k in (2, 3)}
            for some in _of_one_length(self.length):
                n = int(self.length[some[0]])
                points = self.points[self.start[some][:, None] + np.arange(n)]
                for k, out in self.bits.items():
                    out[some] = signatures(points, k)
            self.bits[0] = self.bits[2][:, : SIGNATURE_WORDS // 2] | self.bits[2][:, SIGNATURE_WORDS // 2 :]
        return self.bits[q]


def _pack(shared, side: int):
    """The distinct texts of a task (one side, by length) to one row, the block: texts, lengths, places of the prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted((t for batch in batches for t in batch.column(0).to_pylist()), key=len)
        if not texts:
            return
        counts, marks = shared.value[1 - side], []
        length = np.fromiter(map(len, texts), np.int32, len(texts))
        for some in _of_one_length(length):
            points = code_points([texts[i] for i in some.tolist()])
            marks.append(prefixes(counts[shingles(points).astype(np.int64)], points.shape[1] // SHARE + 1).astype(bool).ravel())
        packed = zlib.compress("".join(texts).encode("utf-8", "surrogatepass"), 6), length.tobytes(), np.packbits(np.concatenate(marks)).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], [f"{name}{side}" for name in ("texts", "lengths", "marks")])

    return run


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the order that sorts them; as one array of numbers if they fit, which sorts faster."""
    bits = max(len(key) - 1, 0).bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 63:
        order = np.argsort(key)
        return key[order], order
    both = np.sort(key << bits | np.arange(len(key)))
    return both >> bits, both & (1 << bits) - 1


def _bands(length: np.ndarray) -> np.ndarray:
    """Bands of similar lengths: an eighth longer is a band more."""
    return (np.log(np.maximum(length, 1)) / np.log(1.125)).astype(np.int64)


def _spread(first: np.ndarray, count: np.ndarray, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(range, place) of all places of ranges, in chunks; a range is never split."""
    some = np.nonzero(count)[0]
    first, count = first[some], count[some]
    total = np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(count):
        z = max(a + 1, int(np.searchsorted(total, total[a] + chunk, "right")) - 1)
        yield np.repeat(some[a:z], count[a:z]), np.arange(total[z] - total[a]) + np.repeat(first[a:z] - (total[a:z] - total[a]), count[a:z])
        a = z


def candidates(index: _Side, probe: _Side, strict: bool, chunk: int = PART_POSTINGS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text of the index, text of the probe), each once, where the probe's is the longer (or as long, unless strict).

    Prefix shingles of the probe's texts look for themselves: those of the first half at nearly the same
    distance from the beginning, the others from the end.
    """
    found = [np.zeros(0, np.int64)]
    own = np.nonzero(probe.rank)[0]
    n, k = probe.length[probe.owner[own]], probe.rank[own].astype(np.int32)
    left, right = k - 1, n // SHARE + 1 - k  # how far it may be shifted from either end
    band = _bands(np.arange(int(max(index.length.max(), probe.length.max())) + 1))
    radix = int(band[-1]) + 1, len(band)
    for front in (True, False):
        half = np.nonzero((left <= right) == front)[0]
        if not len(half):
            continue
        wanted = np.zeros(1 << SHINGLE_BITS, bool)
        wanted[probe.unit[own[half]]] = True
        there = np.nonzero(wanted[index.unit])[0]
        number = np.cumsum(wanted) - 1
        length = index.length[index.owner[there]]
        place = index.place[there] if front else length - index.place[there]
        key, order = _ordered((number[index.unit[there]] * radix[0] + band[length]) * radix[1] + place)
        length, other = length[order], index.owner[there[order]]
        # Shifted by `shift` from one end, a shingle is shifted by shift - gap from the other: the difference of these two numbers.
        rest = place[order] - length

        at = probe.place[own[half]] if front else n[half] - probe.place[own[half]]
        unit, order = _ordered(number[probe.unit[own[half]]] * radix[1] + at)
        half, at, unit = half[order], at[order], unit // radix[1] * radix[0]
        mine, size, most = probe.owner[own[half]], n[half], (left + right)[half]
        reach, slack = (left[half], right[half]) if front else (right[half], left[half])
        lowest, longest = at - size - slack, size - 1 if strict else size
        low, high, near, far = band[size - most], band[size], np.maximum(at - reach, 0), np.minimum(at + reach, radix[1] - 1)
        for step in range(int((high - low).max()) + 1):
            some = np.nonzero(low + step <= high)[0]
            base = (unit[some] + low[some] + step) * radix[1]
            first = np.searchsorted(key, base + near[some])
            count = np.searchsorted(key, base + far[some], "right") - first
            for which, e in _spread(first, count, chunk):
                p = some[which]
                ok = ((rest[e] - lowest[p]).view(np.uint32) <= 2 * slack[p].view(np.uint32)) & (length[e] <= longest[p])
                p, e = p[ok], e[ok]
                a, b, w = other[e], mine[p], most[p]
                for q in (0, 2, 3):
                    x, y = index.signatures(q), probe.signatures(q)
                    for turn in (True, False):
                        ok = (lost_runs(y[b], x[a]) if turn else lost_runs(x[a], y[b])) <= (q or 2) * w
                        a, b, w = a[ok], b[ok], w[ok]
                found.append(np.unique(a.astype(np.int64) * len(probe.length) + b))
    return np.divmod(np.unique(np.concatenate(found)), len(probe.length))


def _meet(chunk: int):
    """Pairs of blocks: index either side, probe it with the prefixes of the other, verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = [c[r].as_py() for c in batch.columns]
                held, train = _Side(*row[:3]), _Side(*row[3:])
                # Either text may be the longer, whose prefix then decides.
                (t1, e1), (e2, t2) = candidates(train, held, True, chunk), candidates(held, train, False, chunk)
                e, t = np.concatenate([e1, e2]), np.concatenate([t1, t2])
                for a in range(0, len(e), 20_000):
                    pairs = [(held.text(i), train.text(j)) for i, j in zip(e[a : a + 20_000].tolist(), t[a : a + 20_000].tolist())]
                    limits = [max(map(len, p)) // SHARE for p in pairs]
                    rows = [(*p, d) for p, k, d in zip(pairs, limits, edit_distances(pairs, limits)) if d <= k]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int32()))], ["eval_text", "train_text", "distance"])

    return run


def similar_texts(texts: DataFrame, buckets: int | None = None, part_postings: int = PART_POSTINGS) -> DataFrame:
    """(eval_text, train_text, distance), each once, for `texts` (text, is_train, is_eval), which may repeat.

    buckets: pairs of blocks at least; part_postings: postings that a task looks at in one step.
    """
    spark = texts.sparkSession
    counted = texts.select("text", "is_train", "is_eval").mapInArrow(_count_shingles, "g int, t bigint, e bigint").groupBy("g").agg(F.sum("t").alias("t"), F.sum("e").alias("e"))
    counts = np.zeros((2, 1 << SHINGLE_BITS), np.int64)
    rows = counted.toArrow()  # at most 2^SHINGLE_BITS rows, however large the corpus
    for n, side in zip(counts, ("t", "e")):
        n[rows.column("g").to_numpy()] = rows.column(side).to_numpy()
    train, held = (max(1, -(-int(n.sum()) // BLOCK_POSTINGS)) for n in counts)
    train = max(train, -(-(buckets or LEAST_BUCKETS) // held))
    shared = spark.sparkContext.broadcast(counts.astype(np.float32))
    blocks = []
    for side, (member, number) in enumerate((("is_train", train), ("is_eval", held))):
        own = texts.where(member).select("text").repartition(number, "text").distinct()
        blocks.append(cut(own.mapInArrow(_pack(shared, side), f"texts{side} binary, lengths{side} binary, marks{side} binary")))
    # Every partition holds one block, so that a task has one pair; nothing is shuffled or written.
    met = blocks[1].crossJoin(blocks[0].hint("shuffle_replicate_nl"))
    return met.mapInArrow(_meet(part_postings), "eval_text string, train_text string, distance int")


def split_lines(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """(line_id, split, source, is_train, is_eval, text) of the lines that take part, as often as they were delivered.

    Train is the split `train`; evaluation splits are the others that the line's manifest names. Case and outer
    blanks do not count. Lines with null id, split or text, or under MIN_CHARS characters take no part.
    """
    def plain(c):
        return F.lower(F.trim(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))

    named = manifest.where("splits is not null").select(F.col("manifest_id").alias("m"), F.explode(F.map_keys("splits")).alias("s")).select("m", plain("s").alias("s")).where("s <> 'train'").distinct()
    own = lines.select("line_id", F.col("manifest_id").alias("m"), plain("split").alias("s"), "source", "text").where(f"line_id is not null and text is not null and length(text) >= {MIN_CHARS}")
    train = own.where("s = 'train'").withColumns({"is_train": F.lit(True), "is_eval": F.lit(False)})
    held = own.where("s <> 'train'").join(named, ["m", "s"], "left_semi").withColumns({"is_train": F.lit(False), "is_eval": F.lit(True)})
    return train.unionByName(held).select("line_id", F.col("s").alias("split"), "source", "is_train", "is_eval", "text")


def find_overlaps(lines: DataFrame, manifest: DataFrame, buckets: int | None = None, part_postings: int = PART_POSTINGS) -> DataFrame:
    """Pairs of an evaluation line and a similar train line, with split and source of each and the distance.

    Columns: eval_id, train_id, eval_split, eval_source, train_source, distance. Repeated rows and manifests
    issued twice give the same pairs once; an id that stands in both splits is no pair with itself. Empty tables
    give no rows; columns besides those of TESTDATA are ignored.
    """
    every = split_lines(lines, manifest)  # read again for each use: less than a copy of all texts on disk
    pairs = cut(similar_texts(every, buckets, part_postings))
    concerned = pairs.select(F.col("eval_text").alias("text")).union(pairs.select("train_text")).distinct()
    own = cut(every.join(concerned, "text", "left_semi").distinct())
    held = own.where("is_eval").select(F.col("text").alias("eval_text"), F.col("line_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    train = own.where("is_train").select(F.col("text").alias("train_text"), F.col("line_id").alias("train_id"), F.col("source").alias("train_source"))
    out = pairs.join(held, "eval_text").join(train, "train_text").where("eval_id <> train_id")
    return out.select("eval_id", "train_id", "eval_split", "eval_source", "train_source", "distance").distinct()


def overlap_report(overlaps: DataFrame) -> DataFrame:
    """Numbers per evaluation split and source: pairs, evaluation lines and train lines concerned, exact pairs."""
    return overlaps.groupBy("eval_split", "eval_source").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_distinct("eval_id").alias("n_eval_lines"),
        F.count_distinct("train_id").alias("n_train_lines"),
        F.sum((F.col("distance") == 0).cast("bigint")).alias("n_exact_pairs"),
    )
