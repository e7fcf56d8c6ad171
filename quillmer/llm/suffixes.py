"""Suffix-array deduplication of repeated passages.

A byte goes if a ``LENGTH``-byte string that also starts earlier (smaller document id, or earlier in the same
document) covers it; strings are judged on the input and never cross documents.

1. *Shards.*  The least hashed ``GRAM``-byte gram of a ``LENGTH``-byte window (leftmost of equal ones) names the
   window, so equal windows have equal names.  Neighbouring windows whose least gram stands at the same place form
   one piece of text, on average about 42 windows long; pieces are dealt to shards by name.  Pieces of equal bytes
   (told by Arrow's dictionary, never by a hash) are reduced to the earliest within a task first, then within the
   shard: the others are repeats as a whole.
2. *Suffix array of a shard*, over pieces that may share a window with other, different pieces (their names are equal,
   and on one side of the least gram half of a window's other bytes are, by a hash of these; all other pieces can't): suffixes are classified as
   smaller or larger than the next one; the leftmost-smaller (LMS) substrings are sorted by inducing and named, symbol
   by symbol; the order of LMS suffixes with equal names comes from the suffix array of the string of names, made in
   the same way (many names are written as two digits each, so that buckets stay few; names that occur once are left out, but
   for the one that ends a run of others); from it the whole array is induced, one bucket after another, each with
   whole-array operations: every suffix is placed once a pass.  Where the pieces of one name exceed an array's size
   they are cut again by another hash of the grams, and so dealt to smaller arrays.
3. *Permuted common prefixes.*  In text order, a common prefix is compared byte by byte only where it is irreducible
   (the bytes before differ); elsewhere it is one less than its left neighbour's.
4. Runs of the array whose neighbours share ``LENGTH`` bytes are equal windows: all but the earliest are removed.

Defined results: a null text counts as empty.  Rows that agree in id and text are one document.  Rows of one id with
different texts, and rows with a null id, are documents of their own: those of one id come in the order of two 64-bit
hashes of their texts, those with a null id so after all others.  An empty table gives an empty result; other
columns are ignored or, by :func:`deduplicated`, kept.  A text is worked on in segments of ``SEGMENT`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import attach, buffers, codes, free_name, is_empty, materialize, mix, pack, pick, text_slices, thrifty, trim, unpack

LENGTH = 100
GRAM = 16
SEGMENT = 1 << 21
#: Text that a task holds pieces of before it sends them.
FLUSH_BYTES = 4 << 20
#: Piece bytes that a shard is planned for, and piece bytes for each byte of text.
SHARD_BYTES = 8 << 20
#: Piece bytes of one suffix array.
PART_BYTES = 1_900_000
SPREAD = 3.4
LAST = (1 << 63) - 1
#: Names of LMS substrings that are symbols as they are; more are written as two digits.
SYMBOLS = 1024
#: Times that the pieces of one name are cut again by another hash, each time by other grams.
CUTS = 6
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POS_BITS = np.uint64(SEGMENT.bit_length() + 1)
_POS_MASK = np.uint64((1 << int(_POS_BITS)) - 1)


def pieces(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, salt: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start in raw, windows, name, place of the least gram in it) of the pieces of all texts, segment by segment; ``salt`` chooses the hash of grams."""
    salted = mix(np.array([salt], np.uint64)) if salt else np.zeros(1, np.uint64)
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    width = length - GRAM + 1  # grams in a window
    at = 0
    while at < len(raw):
        to = min(at + SEGMENT, len(raw))
        end = min(to + length - 1, len(raw))  # windows that start before `to` end by here
        g = mix((lanes[at:end] ^ salted) * _A ^ (lanes[at + GRAM - 8 : end + GRAM - 8] * _B + _A))
        low = (g & ~_POS_MASK) | np.arange(end - at, dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            low = np.minimum(low[: len(low) - step], low[step:])
            step *= 2
        if step < width:
            low = np.minimum(low[: len(low) - (width - step)], low[width - step :]) if len(low) > width - step else low[:0]
        count = min(to - at, end - at - length + 1)
        if count > 0:
            place = (low[:count] & _POS_MASK).astype(np.int64)
            begin = np.arange(at, at + count)
            text = np.searchsorted(offsets, begin, side="right") - 1
            inside = begin + length <= offsets[text + 1]
            head = np.append(True, place[1:] != place[:-1])
            head[1:] |= text[1:] != text[:-1]
            head |= ~inside
            heads = np.flatnonzero(head)
            n = np.diff(np.append(heads, count))
            # windows outside come last in a text: a run that begins inside ends before them
            ok = inside[heads]
            if not ok.all():
                out = np.append(0, np.cumsum(~inside))
                n = n - (out[heads + n] - out[heads])
            heads, n = heads[ok], n[ok]
            yield text[heads], begin[heads], n, g[place[heads]], place[heads] + at - begin[heads]
        at = to


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of all spans, one after another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lens, lens)


def gather(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Bytes of all spans, one after another; their indices are made for some spans at a time."""
    ends = np.cumsum(lens)
    out, a = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8), 0
    while a < len(lens):
        at = int(ends[a] - lens[a])
        z = max(a + 1, int(np.searchsorted(ends, at + block, side="right")))
        out[at : int(ends[z - 1])] = raw[spans(starts[a:z], lens[a:z])]
        a = z
    return out


# ---- suffix array


def _before(mask: np.ndarray) -> np.ndarray:
    """For each i the last index <= i where mask holds (it holds at 0)."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), 0))


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one.  The last symbol is the least and counts as smaller."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    rising = np.append(t[:-1] < t[1:], True)
    back = n - 1 - _before(differs[::-1])[::-1]  # first index >= i that differs from the next
    return rising[back]


def induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix array from LMS suffixes in order; with them ordered by first symbol only, LMS substrings come out sorted."""
    ends = np.cumsum(size)
    begins = ends - size
    n_lms = np.bincount(t[lms], minlength=len(size))
    lms_end = np.cumsum(n_lms)
    sa = np.full(len(t), -1, np.int32)
    head, tail = begins.copy(), ends - 1
    count = np.arange(len(t), dtype=np.int32)
    # what a suffix at 0 would induce is the last one, which neither pass places
    larger, lesser = ~smaller, smaller.copy()
    lesser[-1] = False

    def place(j: np.ndarray, by: int, at: np.ndarray) -> None:
        n = len(j)
        if n < 12:
            for x in j:
                c = t[x]
                k = at[c]
                sa[k] = x
                at[c] = k + by
            return
        c = t[j]
        order = c.argsort(kind="stable")
        c = c[order]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(c[1:], c[:-1], out=new[1:])
        k = count[:n]
        k = at[c] + by * (k - np.maximum.accumulate(k * new))
        sa[k] = j[order]
        at[c] = k + by  # of equal symbols the last one stays

    used = np.flatnonzero(size)
    for c, a, k, z in zip(used.tolist(), begins[used].tolist(), n_lms[used].tolist(), lms_end[used].tolist(), strict=True):
        b = head[c]
        while b > a:  # larger suffixes of this bucket, also those that these induce here
            j = sa[a:b] - 1
            a = b
            j = j[larger[j]]
            if len(j):
                place(j, 1, head)
                b = head[c]
        if k:
            j = lms[z - k : z] - 1
            j = j[larger[j]]
            if len(j):
                place(j, 1, head)
    for c, low, high, b in zip(used[::-1].tolist(), begins[used[::-1]].tolist(), head[used[::-1]].tolist(), (ends[used[::-1]] - 1).tolist(), strict=True):
        a = tail[c]
        while a < b:  # smaller suffixes of this bucket
            j = sa[b:a:-1] - 1
            b = a
            j = j[lesser[j]]
            if len(j):
                place(j, -1, tail)
                a = tail[c]
        j = sa[low:high][::-1] - 1
        j = j[lesser[j]]
        if len(j):
            place(j, -1, tail)
        if c == 0:
            sa[0] = len(t) - 1
    return sa


def names(t: np.ndarray, by_substring: np.ndarray, till: np.ndarray) -> np.ndarray:
    """Names of LMS substrings ``t[i:till]`` in their order: equal symbols, equal name."""
    padded = np.concatenate([t, np.zeros(4, np.uint16)])
    lanes = np.ndarray((len(t) + 1,), "<u8", padded, strides=(2,))
    start, many = by_substring.astype(np.int64), till - by_substring
    same = many[1:] == many[:-1]
    live, k = np.flatnonzero(same), 0
    while len(live):
        x = lanes[start[live] + k] ^ lanes[start[live + 1] + k]
        left = many[live] - k
        x &= np.where(left >= 4, np.uint64((1 << 64) - 1), (np.uint64(1) << (np.uint64(16) * np.minimum(left, 3).astype(np.uint64))) - np.uint64(1))
        same[live[x != 0]] = False
        live = live[(x == 0) & (left > 4)]
        k += 4
    return np.cumsum(np.append(False, ~same), dtype=np.int32)


def sort_suffixes(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols (uint16); the last one, 0, is smaller than all others."""
    smaller = classify(t)
    is_lms = np.append(False, smaller[1:] & ~smaller[:-1])
    lms = np.flatnonzero(is_lms).astype(np.int32)
    size = np.bincount(t)
    if len(lms) > 1:
        sa = induce(t, smaller, lms[np.argsort(t[lms], kind="stable")], size)
        by_substring = sa[is_lms[sa]]
        till = np.empty(len(t), np.int32)  # each ends with the next LMS symbol
        till[lms] = np.append(lms[1:], len(t) - 1) + 1
        name = np.empty(len(t), np.int32)
        name[by_substring] = names(t, by_substring, till[by_substring])
        name = name[lms]
        del sa, till
        alone = np.bincount(name)[name] == 1
        if alone.all():
            lms = by_substring
        else:
            # a comparison of two suffixes ends at a name that occurs once: others of these can go
            kept = ~alone
            kept[1:] |= ~alone[:-1]
            _, number = np.unique(name[kept], return_inverse=True)
            top = int(number.max())
            width, base = (1, top + 1) if top < SYMBOLS else (2, int(np.sqrt(top)) + 1)
            digits = np.zeros(width * len(number) + 1, np.uint16)
            digits[width - 1 : -1 : width] = number % base + 1
            if width == 2:
                digits[:-1:2] = number // base + 1
            order = sort_suffixes(digits)
            order = order[(order % width == 0) & (order < width * len(number))] // width
            rank = np.empty(len(number), np.int64)
            rank[order] = np.arange(len(number))
            place = np.zeros(len(name), np.int64)
            place[kept] = rank
            lms = lms[np.lexsort((place, name))]
    return induce(t, smaller, lms, size)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of bytes by induced sorting; the end of the data is smaller than any byte."""
    t = np.zeros(len(data) + 1, np.uint16)
    t[:-1] = data
    t[:-1] += 1
    return sort_suffixes(t)[1:]


# ---- common prefixes


def common_prefixes(data: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each position its common prefix with the suffix before it in ``sa``, at most ``room`` of either."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    pos = np.arange(n)
    left = np.maximum(pos - 1, 0)
    bleft = np.maximum(before - 1, 0)
    reducible = (pos > 0) & (before > 0) & (data[left] == data[bleft]) & (room[left] == room + 1) & (room[bleft] == room[np.maximum(before, 0)] + 1)
    irreducible = ~reducible
    at = np.flatnonzero(irreducible & (before >= 0))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    limit = np.minimum(room[at], room[before[at]])
    got = np.zeros(len(at), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        x = lanes[np.minimum(at[live] + got[live], n)] ^ lanes[np.minimum(before[at[live]] + got[live], n)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        got[live] += same
        live = live[(same == 8) & (got[live] < limit[live])]
    plcp = np.zeros(n, np.int64)
    plcp[at] = np.minimum(got, limit)
    root = _before(irreducible)
    return np.maximum(plcp[root] - (pos - root), 0)


def repeats(content: np.ndarray, begin: np.ndarray, lens: np.ndarray, doc: np.ndarray, pos: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of what goes, among pieces ``content[begin:begin+lens]`` that start at ``pos`` of ``doc``."""
    n = int(lens.sum() + len(lens))
    at = np.cumsum(lens + 1) - (lens + 1)
    data = np.full(n, 0xFF, np.uint8)  # no UTF-8 text has this byte
    ends_ = np.zeros(n, bool)
    ends_[at + lens] = True
    data[~ends_] = gather(content, begin, lens)
    room = np.repeat(at + lens, lens + 1) - np.arange(n)
    sa = suffix_array(data).astype(np.int64)
    plcp = common_prefixes(data, sa, room)
    equal = plcp[sa] >= length
    run = np.cumsum(~equal)
    member = np.append(equal[1:], False) | equal
    where, run = sa[member], run[member]
    if not len(where):
        return where, where, where
    piece = np.searchsorted(at, where, side="right") - 1
    d, p = doc[piece], pos[piece] + where - at[piece]
    order = np.lexsort((p, d, run))
    d, p, run, piece = d[order], p[order], run[order], piece[order]
    lead = np.append(True, run[1:] != run[:-1])
    first = _before(lead)
    gone = (d != d[first]) | (p != p[first])
    d, p = d[gone], p[gone]
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    if not len(d):
        return d, p, p
    new = np.append(True, (d[1:] != d[:-1]) | (p[1:] > p[:-1] + length))
    heads = np.flatnonzero(new)
    return d[heads], p[heads], p[np.append(heads[1:], len(p)) - 1] + length


# ---- the job


def fresh(code: np.ndarray, name: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by name, bytes and place; in it, which pieces are the earliest of equal ones, and which are later ones."""
    order = np.lexsort((pos, doc, code, name))
    code, doc, pos = code[order], doc[order], pos[order]
    first = np.append(True, code[1:] != code[:-1])[: len(code)]
    again = ~first
    again[1:] &= (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    return order, first, again


class Outbox:
    """Pieces of a task, reduced to the earliest of equal ones, packed by shard."""

    def __init__(self, shards: int, length: int) -> None:
        self.shards, self.length = shards, length
        self.clear()

    def clear(self) -> None:
        self.raw, self.key, self.doc, self.start, self.pos, self.windows, self.name, self.gram, self.size, self.docs = [], [], [], [], [], [], [], [], 0, 0

    def add(self, raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, marks: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """``ids`` and two ``marks`` (zero, if not given) make up the documents' names and order."""
        marks = marks or (np.zeros(len(ids), np.int64),) * 2
        for text, start, windows, name, gram in pieces(raw, offsets, self.length):
            self.gram.append(gram)
            self.doc.append(text + self.docs)
            self.start.append(start + self.size)
            self.pos.append(start - offsets[text])
            self.windows.append(windows)
            self.name.append(name)
        self.key.append(np.stack([ids, *marks]))
        self.raw.append(raw)
        self.size += len(raw)
        self.docs += len(ids)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.doc:
            self.clear()
            return
        raw, key = np.concatenate(self.raw), np.concatenate(self.key, axis=1)
        doc, start, pos, windows, name, gram = (np.concatenate(x) for x in (self.doc, self.start, self.pos, self.windows, self.name, self.gram))
        self.clear()
        if not len(doc):
            return
        key, rank = ranked(key)
        doc, lens = rank[doc], windows + self.length - 1
        code = codes(gather(raw, start, lens), lens)[0]
        shard = ((name >> np.uint64(32)) % np.uint64(self.shards)).astype(np.int64)
        order, first, again = fresh(code, name, doc, pos)
        by_shard = np.argsort(shard[order], kind="stable")
        order, first, again = order[by_shard], first[by_shard], again[by_shard]
        shard, doc, start, pos, lens, name, gram = (x[order] for x in (shard, doc, start, pos, lens, name, gram))
        heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for a, z in zip(heads, np.append(heads[1:], len(shard)), strict=True):
            f, r = a + np.flatnonzero(first[a:z]), a + np.flatnonzero(again[a:z])
            docs, number = np.unique(doc[a:z], return_inverse=True)
            body = pack(
                level=6,
                content=gather(raw, start[f], lens[f]),
                name=mix(name[f]) & np.uint64(0xFFFFFFFF),  # within a shard a short name does: what shares it is only compared
                id=key[0, docs].view(np.uint64),
                mark1=key[1, docs].view(np.uint64),
                mark2=key[2, docs].view(np.uint64),
                gram=gram[f],
                doc=number[f - a],
                pos=pos[f],
                lens=lens[f],
                rdoc=number[r - a],
                rpos=pos[r],
                rlens=lens[r],
            )
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32()), pa.array([body], pa.binary())], ["shard", "body"])


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of ``key`` in order, and the place of each column among them."""
    order = np.lexsort(key[::-1])
    ordered = key[:, order]
    new = np.append(True, (ordered[:, 1:] != ordered[:, :-1]).any(axis=0))[: key.shape[1]]
    rank = np.empty(key.shape[1], np.int64)
    rank[order] = np.cumsum(new) - 1
    return ordered[:, new], rank


def flank_shared(content: np.ndarray, gram: np.ndarray, size: int, ok: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Of pieces of equal name, those whose ``size`` bytes from ``gram`` on, where there are so many (``ok``), another piece seems to have too."""
    at = np.flatnonzero(ok)
    padded = np.concatenate([content, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(content) + 1,), "<u8", padded, strides=(1,))
    h = mix(name[at].astype(np.uint64))
    for k in [*range(0, size - 7, 8), size - 8]:
        h = mix(h ^ lanes[gram[at] + k])
    out = np.zeros(len(ok), bool)
    _, which, many = np.unique(h, return_inverse=True, return_counts=True)
    out[at] = many[which] > 1
    return out


def settle(content: np.ndarray, begin: np.ndarray, lens: np.ndarray, doc: np.ndarray, pos: np.ndarray, name: np.ndarray, gram: np.ndarray, length: int, cuts: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, start, end) of what goes among the pieces ``content[begin:begin+lens]``, whose least gram is ``gram`` bytes on."""
    whole = int(lens.sum()) == len(content) and bool((begin == np.cumsum(lens) - lens).all())  # the pieces are it, one after another
    code = codes(content if whole else gather(content, begin, lens), lens)[0]
    order, first, again = fresh(code, name, doc, pos)
    name, doc, pos, lens, begin, gram = (x[order] for x in (name, doc, pos, lens, begin, gram))
    yield doc[again], pos[again], pos[again] + lens[again]
    f = np.flatnonzero(first)
    # a window that two pieces share has half of what it holds besides the gram before it or behind it
    half = (length - GRAM) // 2
    if half >= 8:
        place = begin[f] + gram[f]
        f = f[flank_shared(content, place - half, half, gram[f] >= half, name[f]) | flank_shared(content, place + GRAM, half, gram[f] + GRAM + half <= lens[f], name[f])]
    many = np.bincount(np.cumsum(np.append(False, name[f][1:] != name[f][:-1]))) if len(f) else np.zeros(0, np.int64)
    f = f[np.repeat(many, many) > 1]
    while len(f):
        size = np.cumsum(lens[f])
        cut = int(np.searchsorted(size, PART_BYTES, side="right"))
        if cut < len(f):  # names stay whole
            cut = int(np.searchsorted(name[f], name[f[cut]], side="left")) or int(np.searchsorted(name[f], name[f[cut]], side="right"))
        part, f = f[:cut], f[cut:]
        if lens[part].sum() > PART_BYTES and cuts < CUTS:  # one name
            held = gather(content, begin[part], lens[part])
            offsets = np.append(0, np.cumsum(lens[part]))
            text, start, windows, names_, gram_ = (np.concatenate(x) for x in zip(*pieces(held, offsets, length, cuts + 1), strict=True))
            yield from settle(held, start, windows + length - 1, doc[part][text], pos[part][text] + start - offsets[text], names_, gram_, length, cuts + 1)
        else:
            yield repeats(content, begin[part], lens[part], doc[part], pos[part], length)


def shard_repeats(bodies: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of what goes by the pieces of one shard; a document is a column of its id and two marks."""
    got = [unpack(b) for b in bodies]
    tables = [np.stack([g.pop(k).astype(np.uint64).view(np.int64) for k in ("id", "mark1", "mark2")]) for g in got]
    key, rank = ranked(np.concatenate(tables, axis=1))
    at = 0
    for g, x in zip(got, tables, strict=True):
        mine = rank[at : at + x.shape[1]]
        at += x.shape[1]
        g["doc"], g["rdoc"] = mine[g["doc"].astype(np.int64)], mine[g["rdoc"].astype(np.int64)]
    name, gram, doc, pos, lens, rdoc, rpos, rlens = (np.concatenate([g.pop(k).astype(np.int64) for g in got]) for k in ("name", "gram", "doc", "pos", "lens", "rdoc", "rpos", "rlens"))
    content = np.concatenate([g.pop("content") for g in got])
    out = [(rdoc, rpos, rpos + rlens), *settle(content, np.cumsum(lens) - lens, lens, doc, pos, name, gram, length)]
    doc, start, end = (np.concatenate([np.asarray(x[i], np.int64) for x in out]) for i in range(3))
    return key[:, doc], start, end


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``docs`` and, in three columns of the names returned, what names its documents: the id, and for null and repeated ids two hashes of the text."""
    names_ = [free_name(docs, x) for x in ("doc_", "mark1_", "mark2_")]
    again = free_name(docs, "again_")
    rows = docs.withColumn(names_[0], F.col(f"`{id_col}`").cast("long"))
    ids = pick(docs, id=id_col).select(F.col("id").cast("long").alias(names_[0])).where(F.col(names_[0]).isNotNull())
    twice = materialize(ids.groupBy(names_[0]).agg(F.count("*").alias("n")).where("n > 1").select(names_[0], F.lit(True).alias(again)), "repeated-ids")
    odd = F.col(names_[0]).isNull()
    if not is_empty(twice):
        rows, odd = attach(rows, twice, names_[0], salt=text_col), odd | F.coalesce(F.col(again), F.lit(False))
    text = F.col(f"`{text_col}`")
    rows = rows.withColumns({names_[1]: F.when(odd, F.xxhash64(text)).otherwise(F.lit(0).cast("long")), names_[2]: F.when(odd, F.xxhash64(F.lit(1), text)).otherwise(F.lit(0).cast("long"))})
    rows = rows.withColumn(names_[0], F.coalesce(names_[0], F.lit(LAST)))
    return rows.select(*(f"`{c}`" for c in docs.columns), *names_), names_


def removed(rows: DataFrame, names_: list[str], text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Of :func:`keyed` rows, (doc, mark1, mark2, start, end): byte ranges that go; ranges of a document may overlap."""
    spark = rows.sparkSession
    rows = pick(rows, doc=names_[0], mark1=names_[1], mark2=names_[2], text=text_col).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * SPREAD / SHARD_BYTES) + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(shards, length)
        for b in text_slices(batches, "text", 1 << 19):
            raw, offsets = buffers(b.column("text"))
            box.add(raw, offsets, b.column("doc").to_numpy(), (b.column("mark1").to_numpy(), b.column("mark2").to_numpy()))
            if box.size >= FLUSH_BYTES:
                yield from box.flush()
                trim()
        yield from box.flush()

    def work(t: pa.Table) -> pa.Table:
        key, start, end = shard_repeats(t.column("body").to_pylist(), length)
        return pa.table({"doc": key[0], "mark1": key[1], "mark2": key[2], "start": start, "end": end})

    return rows.mapInArrow(thrifty(send), "shard int, body binary").groupBy("shard").applyInArrow(thrifty(work), "doc long, mark1 long, mark2 long, start long, end long")


def _merged(ranges: np.ndarray, size: int) -> np.ndarray:
    """Disjoint, apart ranges that cover the same bytes."""
    ranges = np.minimum(ranges[np.argsort(ranges[:, 0], kind="stable")], size)
    ranges = ranges[ranges[:, 1] > ranges[:, 0]]
    if not len(ranges):
        return ranges
    reach = np.maximum.accumulate(ranges[:, 1])
    heads = np.flatnonzero(np.append(True, ranges[1:, 0] > reach[:-1]))
    return np.column_stack([ranges[heads, 0], reach[np.append(heads[1:], len(ranges)) - 1]])


def _kept(text: bytes, flat: list | None) -> tuple[bytes, int]:
    """What is left, and the number of ranges that went."""
    if not flat:
        return text, 0
    gone = _merged(np.array(flat, np.int64).reshape(-1, 2), len(text))
    edges = [0, *gone.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(gone)


def _with_ranges(docs: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, str]:
    """``docs`` and, in a column of the name returned, the ranges of each."""
    rows, key = keyed(docs, id_col, text_col)
    gone = free_name(rows, "gone")
    ranges = removed(rows, key, text_col, length).withColumnsRenamed(dict(zip(("doc", "mark1", "mark2"), key, strict=True)))
    by_doc = ranges.groupBy(*key).agg(F.flatten(F.collect_list(F.array("start", "end"))).alias(gone))
    joined = squeezed(rows, text_col).join(by_doc, key, "left")
    return joined.select(*(f"`{c}`" for c in docs.columns), gone), gone


def squeezed(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with compressed texts (binary), for their way through a shuffle; see :func:`texts`."""
    schema = StructType([StructField(f.name, BinaryType()) if f.name == text_col else f for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for b in text_slices(batches, text_col):
            made = [None if t is None else tool.compress(t) for t in b.column(text_col).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()) if f.name == text_col else b.column(f.name) for f in schema.fields], schema.names)

    return rows.mapInArrow(thrifty(run), schema)


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """What :func:`squeezed` took."""
    tool = zstandard.ZstdDecompressor()
    return (None if t is None else tool.decompress(t.as_buffer()) for t in (x if x.is_valid else None for x in column))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    ranged, name = _with_ranges(rows, "doc_id", "text", length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            out = []
            for text, gone in zip(texts(b.column("text")), b.column(name).to_pylist(), strict=True):
                text = text or b""
                kept, n = _kept(text, gone)
                out.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(x) for x in zip(*out, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return ranged.mapInArrow(thrifty(run), SCHEMA)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut out of the text; what a cut leaves of a character goes too."""
    schema = docs.schema
    ranged, name = _with_ranges(docs, id_col, text_col, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text_col):
            left = [None if t is None else _kept(t, g)[0].decode("utf-8", "ignore") for t, g in zip(texts(b.column(text_col)), b.column(name).to_pylist(), strict=True)]
            columns = [pa.array(left, pa.string()) if f.name == text_col else b.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return ranged.mapInArrow(thrifty(run), schema)
