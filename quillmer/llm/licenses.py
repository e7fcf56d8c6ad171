"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Terms are lower-cased runs of ASCII letters, digits and non-ASCII bytes; numbers with points are one term ("2.0" is
"2").  The templates' pairs of neighbouring terms are winnowed (of each ``WINDOW`` of them the one of least hash, the
last of equal ones; of templates of up to ``SHORT`` terms all are kept) and make an inverted index; it holds the given
templates only and is broadcast.  All pairs of a text are looked up.  Where at least ``COVERAGE`` of a template's terms
stand in a text one after another, some changed or left out, the text shares a pair of the index: a longer template
then has a run of ``WINDOW + 1`` terms that the text has too, and a shorter one a run of two.  (Terms put in may part
all runs; such a notice can be missed.)

A hit is a candidate if the stretch of text around its diagonal has enough terms of the template at all.  Candidates
are clustered by diagonal, and each cluster is aligned with the whole template in a band around its diagonals: 2 for
equal terms, -1 for a substitution or a term left out on either side, text before and after free; all candidates
of a template at once.  Coverage is the share of the template's terms matched.  An occurrence must have each of the terms
that its template marks as telling, and within it no unmatched term may name another license (``RIVALS``) or, where the
template marks a number, be a number: "GNU Lesser General Public License, version 2.1" is no GPL 2.

Result: one row for each occurrence of coverage ``COVERAGE`` or more: doc_id, license, occurrence (0, 1, ... by
position within text and license), coverage, matched_terms, template_terms, start_char and end_char (code points of
the text, end exclusive) and matched_text.  Of overlapping occurrences, of whatever licenses, the one with more
matches stays, then that of higher coverage, then the earlier, then the first by name.

Defined results: a null or empty text has no occurrence, nor has a template of one term; rows with a null
id or repeated rows are scanned like others; an empty table gives an empty result; other columns are ignored.  Texts
are scanned whole, in passes of about 1 MB or one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Words, buffers, mix, pick, string_hashes, text_slices, thrifty
from .license_texts import RIVALS, TEMPLATES

WINDOW = 3
SHORT = 15
COVERAGE = 0.8
SCHEMA = "doc_id long, license string, occurrence int, coverage double, matched_terms int, template_terms int, start_char long, end_char long, matched_text string"

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_POINT = 0x7F  # stands for a point within a number
_GAP[_POINT] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Candidates aligned at once.
_GROUP = 256
_NONE = -(10**9)
#: Stands for a number that no template has.
NUMBER = -2


def terms(texts: pa.Array) -> tuple[Words, np.ndarray, pa.Array]:
    """Words, the number of each among the distinct terms, and these."""
    raw, offsets = buffers(texts)
    raw = np.where(raw == _POINT, 0x20, raw).astype(np.uint8)
    dots = np.flatnonzero(raw[1:-1] == 0x2E) + 1
    raw[dots[_DIGIT[raw[dots - 1]] & _DIGIT[raw[dots + 1]]]] = _POINT
    words = Words(raw, offsets, lower=True, separators=_GAP)
    code, distinct = words.codes()
    return words, code, pc.replace_substring_regex(distinct.cast(pa.large_string()), "(\\x7f0+)+$", "")


class Index:
    """Templates, their terms' numbers, and the inverted index of their winnowed pairs of terms."""

    def __init__(self, templates: dict[str, str], rivals: tuple[str, ...] = RIVALS) -> None:
        self.names = sorted(templates)
        words, code, distinct = terms(pa.array([templates[n] for n in self.names], pa.string()))
        self.vocabulary = pa.array(sorted({*distinct.to_pylist(), *rivals}), pa.large_string())
        own = pc.index_in(distinct, self.vocabulary).to_numpy()[code].astype(np.int64) if len(code) else np.zeros(0, np.int64)
        self.size = len(self.vocabulary)
        self.number_like = np.array([t[0].isdigit() for t in self.vocabulary.to_pylist()])
        self.rival = np.isin(self.vocabulary.to_pylist(), rivals)
        hashes = string_hashes(self.vocabulary)
        self.terms, self.telling, self.has, pairs = [], [], [], []
        for o, (name, a, z) in enumerate(zip(self.names, words.first.tolist(), words.first[1:].tolist(), strict=False)):
            t = own[a:z]
            marked = terms(pa.array([" ".join(re.findall(r"{([^}]*)}", templates[name]))], pa.string()))[2]
            telling = pc.index_in(marked, self.vocabulary).to_numpy()
            self.terms.append(t)
            self.telling.append(np.isin(t, telling))
            self.has.append(np.isin(np.arange(self.size), t))
            pairs += [(int(t[k]) * self.size + int(t[k + 1]), o, int(k)) for k in self.winnowed(t, hashes)]
        pairs.sort()
        self.pair, self.owner, self.place = (np.array([p[i] for p in pairs], np.int64) for i in range(3))

    @staticmethod
    def winnowed(t: np.ndarray, hashes: np.ndarray) -> list[int]:
        """Places of the pairs that stand for a template."""
        if len(t) <= SHORT:
            return list(range(len(t) - 1))
        h = mix(hashes[t[:-1]] * np.uint64(0x9FB21C651E98DF25) + hashes[t[1:]]).tolist()
        return sorted({min(range(k, k + WINDOW), key=lambda i: (h[i], -i)) for k in range(len(h) - WINDOW + 1)})

    def hits(self, text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the terms, template, place in it) of all shared pairs that one text holds; a term of no template is -1."""
        at = np.flatnonzero((term[:-1] >= 0) & (term[1:] >= 0) & (text[:-1] == text[1:]))
        pair = term[at] * self.size + term[at + 1]
        low, high = np.searchsorted(self.pair, pair, "left"), np.searchsorted(self.pair, pair, "right")
        n = high - low
        row = np.repeat(at, n)
        of = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return row, self.owner[of], self.place[of]


def align_many(template: np.ndarray, text: np.ndarray, start: np.ndarray, width: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each candidate and template term the text position matched with it in the best alignment, or -1.

    A candidate's diagonals are ``start .. start + width - 1`` (text minus template); it may use ``text[low:high]``.
    """
    n, m = len(start), len(template)
    moves = np.zeros((m, n, width), np.uint8)
    slope = np.arange(width)
    before = np.zeros((n, width), np.int64)  # starting anywhere in the text is free
    for i in range(m):
        j = start[:, None] + i + slope
        valid = (j >= low[:, None]) & (j < high[:, None])
        equal = valid & (text[np.clip(j, 0, len(text) - 1)] == template[i])
        now = np.where(valid, before + np.where(equal, 2, -1), _NONE)
        move = np.where(equal, 1, np.where(valid, 2, 0)).astype(np.uint8)
        skip = np.full((n, width), _NONE)  # a template term left out
        skip[:, :-1] = before[:, 1:] - 1
        skip[j < low[:, None] - 1] = _NONE
        up = (skip > now) & (skip > _NONE // 2)
        now, move = np.where(up, skip, now), np.where(up, 3, move)
        left = np.maximum.accumulate(now + slope, axis=1) - slope  # text terms left out
        more = valid & (left > now) & (left > _NONE // 2)
        now, moves[i] = np.where(more, left, now), np.where(more, 4, move)
        before = now
    out = np.full((n, m), -1)
    d, i, live = before.argmax(axis=1), np.full(n, m - 1), np.arange(n)
    while len(live):
        move = moves[i[live], live, d[live]]
        hit = live[move == 1]
        out[hit, i[hit]] = start[hit] + i[hit] + d[hit]
        i[live[(move >= 1) & (move <= 3)]] -= 1
        d[live[move == 3]] += 1
        d[live[move == 4]] -= 1
        live = live[(move > 0) & (i[live] >= 0)]
    return out


def align(template: list[int], text: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Matched (template, text) positions of the best alignment with diagonals text - template in low..high."""
    if not template or not text:
        return []
    at = align_many(np.array(template), np.array(text), np.array([low]), high - low + 1, np.array([0]), np.array([len(text)]))[0]
    return [(i, j) for i, j in enumerate(at.tolist()) if j >= 0]


def occurrences(index: Index, o: int, term: np.ndarray, text: np.ndarray, first: np.ndarray, at: np.ndarray, place: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, first term, last term, matches) of the alignments of template ``o`` that reach the coverage, of its hits."""
    template, telling = index.terms[o], index.telling[o]
    m, band = len(template), max(2, len(template) // 8)
    t, diagonal = text[at], at - place
    # enough of the template's terms must stand around the diagonal
    has = np.zeros(len(term) + 1, np.int64)
    np.cumsum((term >= 0) & index.has[o][term], out=has[1:])
    low, high = np.maximum(diagonal - band, first[t]), np.minimum(diagonal + m + band, first[t + 1])
    enough = has[high] - has[np.minimum(low, high)] >= coverage * m
    t, diagonal = t[enough], diagonal[enough]
    order = np.lexsort((diagonal, t))
    t, diagonal = t[order], diagonal[order]
    anchors, last = [], None
    for k, x in enumerate(zip(t.tolist(), diagonal.tolist(), strict=True)):
        if last is None or x[0] != last[0] or x[1] > last[1] + band:
            anchors.append(k)
            last = x
    t, diagonal = t[anchors], diagonal[anchors]
    for a in range(0, len(t), _GROUP):
        s, e = first[t[a : a + _GROUP]], first[t[a : a + _GROUP] + 1]
        found = align_many(template, term, diagonal[a : a + _GROUP] - band, 3 * band + 1, s, e)
        for k, row in enumerate(found):
            got = row >= 0
            n = int(got.sum())
            if n < coverage * m or not got[telling].all():
                continue
            places = row[got]
            inside = np.ones(int(places[-1] - places[0]) + 1, bool)
            inside[places - places[0]] = False
            odd = term[int(places[0]) : int(places[-1]) + 1][inside]
            odd_known = odd[odd >= 0]
            if index.rival[odd_known].any() or (index.number_like[template[telling]].any() and (odd == NUMBER).any() | index.number_like[odd_known].any()):
                continue
            yield int(t[a + k]), int(places[0]), int(places[-1]), n


def settled(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of (first, last, matches, terms, template) those that no better one overlaps, by position."""
    kept, taken = [], bytearray(max((x[1] + 1 for x in found), default=0))
    for x in sorted(set(found), key=lambda x: (-x[2], -x[2] / x[3], x[0], x[4])):
        if not any(taken[x[0] : x[1] + 1]):
            taken[x[0] : x[1] + 1] = b"\1" * (x[1] + 1 - x[0])
            kept.append(x)
    return sorted(kept)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in text_slices(batches, "text"):
            words, code, distinct = terms(b.column("text"))
            known = pc.index_in(distinct, index.vocabulary).fill_null(-1).to_numpy()
            other = pc.match_substring_regex(distinct, "^[0-9]").to_numpy(zero_copy_only=False) & (known < 0)
            term = np.where(other, NUMBER, known)[code].astype(np.int64) if len(code) else np.zeros(0, np.int64)
            text = words.text_of_word()
            at, owner, place = index.hits(text, term)
            found: dict[int, list] = {}
            for o in np.unique(owner).tolist():
                mine = owner == o
                for t, first, last, n in occurrences(index, o, term, text, words.first, at[mine], place[mine], coverage):
                    found.setdefault(t, []).append((first - int(words.first[t]), last - int(words.first[t]), n, len(index.terms[o]), o))
            out = []
            for t, each in sorted(found.items()):
                name, whole, a, number = b.column("id")[t].as_py(), b.column("text")[t].as_py().encode(), words.first[t], {}
                for first, last, matches, m, o in settled(each):
                    s, e = words.starts[a + first] - words.offsets[t], words.ends[a + last] - words.offsets[t]
                    start, span = len(whole[:s].decode("utf-8", "replace")), whole[s:e].decode("utf-8", "replace")
                    number[o] = number.get(o, -1) + 1
                    out.append((name, index.names[o], number[o], matches / m, matches, m, start, start + len(span), span))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return pick(docs, id=id_col, text=text_col).mapInArrow(thrifty(run), SCHEMA)
