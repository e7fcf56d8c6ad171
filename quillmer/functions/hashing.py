"""K-mer hashes: MurmurHash3 x64 128 (its low half) over whole arrays, and an MD5 form that SQL has too.

Hashes are longs that sort as the unsigned values do: 64-bit ones are stored with the top bit flipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import SketchParams
from ..plans import spread
from .kmers import _UPPER, COMPLEMENTS

# Fixed values of MurmurHash3 x64 128.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ADD1, _ADD2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)

#: Sequence bytes handled at once.
BLOCK = 1 << 18
#: Windows hashed in step: their arrays stay in a core's cache.
STEP = 1 << 15
#: Hashes that a task holds before it counts them.
HELD = 1 << 20


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def murmur3_low64(data: np.ndarray, starts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Low 64 bits of the hash of each ``data[start:start + k]``; ``data`` needs 8 spare bytes at its end."""
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h1 = np.full(len(starts), np.uint64(seed & 0xFFFFFFFF))
    h2 = h1.copy()
    with np.errstate(over="ignore"):
        for at in range(0, k - k % 16, 16):
            h1 ^= _rot(lanes[starts + at] * _C1, 31) * _C2
            h1 = (_rot(h1, 27) + h2) * np.uint64(5) + _ADD1
            h2 ^= _rot(lanes[starts + at + 8] * _C2, 33) * _C1
            h2 = (_rot(h2, 31) + h1) * np.uint64(5) + _ADD2
        tail, at = k % 16, k - k % 16
        if tail > 8:
            rest = lanes[starts + at + 8] & np.uint64((1 << 8 * (tail - 8)) - 1)
            h2 ^= _rot(rest * _C2, 33) * _C1
        if tail:
            rest = lanes[starts + at]
            if tail < 8:
                rest = rest & np.uint64((1 << 8 * tail) - 1)
            h1 ^= _rot(rest * _C1, 31) * _C2
        h1 ^= np.uint64(k)
        h2 ^= np.uint64(k)
        h1 += h2
        h2 += h1
        h1, h2 = _final(h1), _final(h2)
        return h1 + h2


def encode(h: np.ndarray, params: SketchParams) -> np.ndarray:
    """Stored form of the low 64 bits."""
    if params.hash_bits == 32:
        return (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def unsigned(hash_col: Column, params: SketchParams) -> Column:
    """The unsigned value of a stored hash."""
    if params.hash_bits == 64:
        return hash_col.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return hash_col.cast("decimal(20,0)")


def md5_60(kmer: Column) -> Column:
    return F.conv(F.substring(F.md5(kmer), 1, 15), 16, 10).cast("long")


#: Fixed values of MD5: rotations, sines, start.
_SHIFTS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_SINES = tuple(int(abs(math.sin(i + 1)) * 2**32) for i in range(64))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_60_words(words: list[np.ndarray], k: int) -> np.ndarray:
    """:func:`md5_60` of messages of ``k`` < 56 bytes, given as their little-endian words, the last one padded: one block, all messages in step."""
    n = len(words[0])
    rest = [0] * 16
    rest[14] = 8 * k
    if k % 4 == 0:
        rest[k // 4] = 0x80
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f = np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        if g < len(words):
            np.add(a, words[g], out=a)
            np.add(a, np.uint32(_SINES[i]), out=a)
        else:
            np.add(a, np.uint32((_SINES[i] + rest[g]) & 0xFFFFFFFF), out=a)
        np.left_shift(a, np.uint32(_SHIFTS[i]), out=f)
        np.right_shift(a, np.uint32(32 - _SHIFTS[i]), out=a)
        np.bitwise_or(a, f, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    a, b = (x + np.uint32(y) for x, y in zip((a, b), _START))
    return ((a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap().astype(np.uint64) >> np.uint64(4))).astype(np.int64)


def md5_60_of(both: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """:func:`md5_60` of each ``both[start:start + k]``; ``both`` needs 8 spare bytes at its end."""
    lanes = np.ndarray((len(both) - 3,), "<u4", both, strides=(1,))
    words = [lanes[starts + at] for at in range(0, k, 4)]
    if k % 4:
        words[-1] = words[-1] & np.uint32((1 << 8 * (k % 4)) - 1) | np.uint32(0x80 << 8 * (k % 4))
    return _md5_60_words(words, k)


def _complement_table() -> np.ndarray:
    table = np.full(256, ord("N"), np.uint8)
    for a, b in zip(_UPPER, COMPLEMENTS, strict=True):
        table[ord(a)] = ord(b)
    return table


class KmerHasher:
    """Hashes of all valid k-mers of byte strings."""

    def __init__(self, params: SketchParams) -> None:
        self.params = params
        self.fold = np.arange(256, dtype=np.uint8)
        if not params.preserve_case:
            self.fold[97:123] -= 32
        self.valid = np.zeros(256, bool)
        self.valid[list(params.alphabet.encode())] = True
        self.complement = _complement_table()

    def positions(self, raw: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """Starts of windows that hold letters of the alphabet only and don't cross any of ``ends``."""
        k = self.params.kmer
        if len(raw) < k:
            return np.zeros(0, np.int64)
        bad = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(~self.valid[raw], out=bad[1:])
        ok = bad[k:] == bad[:-k]
        if ends is not None:
            for back in range(1, k):  # windows that begin up to k - 1 before an end
                at = ends - back
                ok[at[(at >= 0) & (at < len(ok))]] = False
        return np.flatnonzero(ok)

    def hashes(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Stored hashes of the windows of ``raw`` (folded already) at ``at``."""
        k = self.params.kmer
        spare = np.zeros(8, np.uint8)
        if not len(at):
            return np.zeros(0, np.int64)
        if not self.params.canonical:
            return self._of(np.concatenate([raw, spare]), at)
        n = len(raw)
        both = np.concatenate([raw, self.complement[raw][::-1], spare])
        back = 2 * n - k - at
        lanes = np.ndarray((len(both) - 7,), ">u8", both, strides=(1,))
        less = np.zeros(len(at), bool)
        open_ = np.ones(len(at), bool)
        for j in range(0, k, 8):
            x, y = lanes[at + j].astype(np.uint64), lanes[back + j].astype(np.uint64)
            if k - j < 8:
                drop = np.uint64(8 * (8 - (k - j)))
                x, y = x >> drop, y >> drop
            less |= open_ & (y < x)
            open_ &= x == y
        return self._of(both, np.where(less, back, at))

    def _of(self, both: np.ndarray, starts: np.ndarray) -> np.ndarray:
        p = self.params
        out = np.empty(len(starts), np.int64)
        for a in range(0, len(starts), STEP):
            part = starts[a : a + STEP]
            out[a : a + STEP] = md5_60_of(both, part, p.kmer) if p.hash_fn == "md5_60" else encode(murmur3_low64(both, part, p.kmer, p.seed), p)
        return out

    def blocks(self, seqs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ends, hashes) of a binary array, about ``BLOCK`` bytes at once: the hashes of ``rows[i]`` end at ``ends[i]``; a row may come in several pieces."""
        for first, offsets, data in _portions(seqs):
            k = self.params.kmer
            for a in range(0, max(len(data) - k + 1, 0), BLOCK):
                raw = self.fold[data[a : a + BLOCK + k - 1]]
                at = self.positions(raw, offsets[1:-1] - a)
                at = at[at < BLOCK]
                ends = np.searchsorted(at, offsets[1:] - a)
                rows = np.flatnonzero(np.diff(ends, prepend=0))
                if len(rows):
                    yield first + rows, ends[rows], self.hashes(raw, at)

    def each(self, seqs: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, hashes) in pieces: short sequences together, a long one block by block."""
        k, held, size = self.params.kmer, [], 0

        def joined() -> Iterator[tuple[int, np.ndarray]]:
            raw = self.fold[np.frombuffer(b"".join(s for _, s in held), np.uint8)]
            ends = np.cumsum([len(s) for _, s in held])
            at = self.positions(raw, ends[:-1])
            h = self.hashes(raw, at)
            cut = np.searchsorted(at, np.append(0, ends))
            for i, (row, _) in enumerate(held):
                if cut[i + 1] > cut[i]:
                    yield row, h[cut[i] : cut[i + 1]]

        for row, seq in enumerate(seqs):
            if len(seq) < k:
                continue
            if len(seq) > BLOCK:
                for a in range(0, len(seq) - k + 1, BLOCK):
                    raw = self.fold[np.frombuffer(seq[a : a + BLOCK + k - 1], np.uint8)]
                    at = self.positions(raw)
                    if len(at):
                        yield row, self.hashes(raw, at)
                continue
            if size + len(seq) > BLOCK:
                yield from joined()
                held, size = [], 0
            held.append((row, seq))
            size += len(seq)
        if held:
            yield from joined()


def _portions(seqs: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of stretches of rows of a binary array; nulls are empty."""
    if not len(seqs):
        return
    seqs = seqs.cast(pa.large_binary())
    offsets = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    if seqs.null_count:  # what a null spans is not defined
        seqs = pa.array([x or b"" for x in seqs.to_pylist()], pa.large_binary())
        offsets = np.frombuffer(seqs.buffers()[1], np.int64)[: len(seqs) + 1]
    if seqs.buffers()[2] is None:
        return
    data, row = np.frombuffer(seqs.buffers()[2], np.uint8), 0
    while row < len(seqs):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        yield row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]]
        row = stop


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how often each occurs."""
    h = np.sort(h)
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[head], np.diff(np.append(head, len(h)))


class Wanted:
    """A set of hashes: bits by their low part, then the sorted array."""

    BITS = 22

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[hashes & ((1 << self.BITS) - 1)] = True

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = self.bits[h & ((1 << self.BITS) - 1)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.hashes[np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)] == h[at]
        return out


class Tally:
    """(group, hash, count) of a task, each pair once as far as they are held together.

    With a ``limit`` of each group only so many smallest hashes are kept: a hash among the smallest of a group is among the
    smallest of every part of it that has the hash, so those that stay at last, and their counts, are exact.
    Hashes of ``wanted`` (sorted) stay in any case.
    """

    def __init__(self, limit: int | None = None, wanted: np.ndarray | None = None) -> None:
        self.limit = limit
        self.wanted = None if wanted is None else Wanted(wanted)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.top = np.zeros(0, np.int64)  # of each group, what its smallest hashes don't exceed

    def add(self, group: np.ndarray, h: np.ndarray, groups: int) -> None:
        """``h`` of ``group``, numbers below ``groups``; those that can't stay are left out at once."""
        if self.limit is not None:
            if len(self.top) < groups:
                self.top = np.append(self.top, np.full(2 * groups - len(self.top), np.iinfo(np.int64).max))
            keep = h <= self.top[group]
            if self.wanted is not None:
                keep |= self.wanted.holds(h)
            group, h = group[keep], h[keep]
        self.held.append((group, h, np.ones(len(h), np.int64)))
        self.size += len(h)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, h, count = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((h, group))
        group, h = group[order], h[order]
        head = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (h[1:] != h[:-1])))
        count = np.add.reduceat(count[order], head)
        group, h = group[head], h[head]
        if self.limit is not None:
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            size = np.diff(np.append(first, len(h)))
            full = size >= self.limit
            self.top[group[first[full]]] = h[first[full] + self.limit - 1]
            keep = np.arange(len(h)) - np.repeat(first, size) < self.limit
            if self.wanted is not None:
                keep |= self.wanted.holds(h)
            group, h, count = group[keep], h[keep], count[keep]
        self.held, self.size = [(group, h, count)], len(h)
        return self.held[0]


def hashed(df: DataFrame, group: str, seq: str, params: SketchParams, limit: int | None = None, wanted=None) -> DataFrame:
    """(group, hash, count): k-mer hashes of ``seq``, counted within each task; a group may still have several rows for a hash.

    ``limit``: only so many smallest hashes of each group leave a task; with ``wanted``, a broadcast sorted array, those too that it holds.
    """
    rows = df.select(F.col(group).alias("grp"), F.col(seq).cast("binary").alias("seq")).where("seq is not null")
    rows = rows if df.isStreaming else spread(rows)
    kind = df.schema[group].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = KmerHasher(params)
        names: dict = {}  # a group's value -> its number in this task
        tally = Tally(limit, wanted.value if wanted is not None else None)

        def told() -> Iterator[pa.RecordBatch]:
            g, h, count = tally.merged()
            values = pa.array(list(names), arrow_kind)
            for a in range(0, len(h), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([values.take(pa.array(g[part])), pa.array(h[part]), pa.array(count[part])], [group, "hash", "count"])

        arrow_kind, check = None, HELD
        for b in batches:
            arrow_kind = b.column("grp").type
            coded = b.column("grp").dictionary_encode(null_encoding="encode")
            number = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)
            keys = number[coded.indices.to_numpy()]
            for row, ends, h in tool.blocks(b.column("seq")):
                tally.add(np.repeat(keys[row], np.diff(ends, prepend=0)), h, len(names))
                if tally.size > check:
                    tally.merged()
                    if tally.size > HELD // 2:
                        yield from told()
                        tally.held, tally.size = [], 0
        if tally.held:
            yield from told()

    schema = T.StructType([T.StructField(group, kind), T.StructField("hash", T.LongType()), T.StructField("count", T.LongType())])
    return rows.mapInArrow(run, schema)


def whole(df: DataFrame, group: str, seq: str, params: SketchParams) -> DataFrame:
    """(group, length, hashes, counts): the sketch of each row by itself, where a group is one row; nothing is shuffled."""
    rows = spread(df.select(F.col(group).alias("grp"), F.col(seq).cast("binary").alias("seq")))
    kind = df.schema[group].dataType
    limit = params.sketch_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = KmerHasher(params)
        for b in batches:
            n = b.num_rows
            sizes, hashes, counts, open_ = np.zeros(n, np.int64), [], [], {}

            def closed(row: int, h: np.ndarray, count: np.ndarray) -> None:
                take = np.flatnonzero(count >= params.min_copies)[:limit]
                sizes[row] = len(take)
                hashes.append(h[take])
                counts.append(count[take])

            for rows_, ends, h in tool.blocks(b.column("seq")):
                start = 0
                for row, end in zip(rows_.tolist(), ends.tolist(), strict=True):
                    own, start = counted(h[start:end]), end
                    if open_ and row not in open_:
                        closed(*open_.popitem()[1])
                    if row in open_:  # a long row, piece by piece
                        both, count = np.append(open_[row][1], own[0]), np.append(open_[row][2], own[1])
                        order = np.argsort(both, kind="stable")
                        head = np.flatnonzero(np.append(True, np.diff(both[order]) != 0))
                        own = both[order][head], np.add.reduceat(count[order], head)
                    cut = slice(limit if params.min_copies == 1 else None)
                    open_[row] = row, own[0][cut], own[1][cut]
            if open_:
                closed(*open_.popitem()[1])
            length = pc.fill_null(pc.binary_length(b.column("seq")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (hashes, counts)]
            yield pa.RecordBatch.from_arrays([b.column("grp"), pa.array(np.where(length >= params.kmer, length, 0)), *lists], [group, "length", "hashes", "counts"])

    longs = T.ArrayType(T.LongType())
    return rows.mapInArrow(run, T.StructType([T.StructField(group, kind), T.StructField("length", T.LongType()), T.StructField("hashes", longs), T.StructField("counts", longs)]))


class _Coder(KmerHasher):
    """K-mers as numbers in the base of the alphabet, instead of hashes."""

    def _of(self, both: np.ndarray, starts: np.ndarray) -> np.ndarray:
        digit = np.zeros(256, np.int64)
        letters = self.params.alphabet.encode()
        digit[list(letters)] = np.arange(len(letters))
        out, values = np.zeros(len(starts), np.int64), digit[both]
        for i in range(self.params.kmer):
            out *= len(letters)
            out += values[starts + i]
        return out


def kmer_totals(df: DataFrame, group: str, seq: str, params: SketchParams) -> DataFrame:
    """(group, n_kmers, n_distinct, most) of each row that has a k-mer, where a group is one row; k-mers must fit a long and not be canonical."""
    rows = spread(df.select(F.col(group).alias("grp"), F.col(seq).cast("binary").alias("seq")).where("seq is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _Coder(params)
        for b in batches:
            of, told, open_ = [], [], (-1, np.zeros(0, np.int64))

            def closed() -> None:
                if len(open_[1]):
                    count = counted(open_[1])[1]
                    of.append(open_[0])
                    told.append((len(open_[1]), len(count), int(count.max())))

            for row, ends, codes in tool.blocks(b.column("seq")):
                start = 0
                for i, end in zip(row.tolist(), ends.tolist(), strict=True):
                    if i != open_[0]:
                        closed()
                        open_ = i, codes[start:end]
                    else:  # a long row, piece by piece
                        open_ = i, np.append(open_[1], codes[start:end])
                    start = end
            closed()
            columns = np.array(told, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("grp").take(pa.array(of, pa.int64())), *(pa.array(columns[:, c]) for c in range(3))], [group, "n_kmers", "n_distinct", "most"])

    fields = [T.StructField(x, T.LongType()) for x in ("n_kmers", "n_distinct", "most")]
    return rows.mapInArrow(run, T.StructType([T.StructField(group, df.schema[group].dataType), *fields]))


def register(spark, params: SketchParams | None = None, name: str = "kmer_hash") -> None:
    """SQL function ``kmer_hash(kmer)``: the stored hash of a k-mer of the parameters' size, canonical if they say so; null if it isn't valid."""
    params = params or SketchParams()

    @F.pandas_udf(T.LongType())
    def kmer_hash(kmers: pd.Series) -> pd.Series:
        tool = KmerHasher(params)
        out: list[int | None] = [None] * len(kmers)
        for row, h in tool.each([(x or "").encode() for x in kmers]):
            if len(h) == 1:
                out[row] = int(h[0])
        return pd.Series(out, dtype="Int64")

    spark.udf.register(name, kmer_hash)
