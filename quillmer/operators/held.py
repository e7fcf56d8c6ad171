"""Sketches against a collection that is small enough for every task to hold: nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import SketchParams

#: Hashes and sketches of a collection that tasks hold.
HELD_HASHES = 4 << 20
HELD_SKETCHES = 100_000
#: Pairs, and hashes in common, that a task has at once.
STEP = 1 << 20


class Held:
    """A collection by hash: its postings in order, and what tells about each sketch."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks().sort_by("ref_idx")
        self.idx, self.n = rows["ref_idx"].to_numpy(), rows["n"].to_numpy()
        self.about = rows.select(["ref_idx", "name", "length", "n"])
        self.hashes = [x.values.to_numpy() for x in rows["hashes"]]
        flat = np.concatenate([*self.hashes, np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        self.keys, head = np.unique(flat[order], return_index=True)
        self.ends = np.append(head, len(flat))
        self.of = np.repeat(np.arange(len(self.n)), self.n)[order]
        self.rank = (np.arange(len(flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n) + 1)[order]

    def hits(self, hashes: np.ndarray, row: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, rank in the row, rank in the held sketch) of hashes in common, in the order of ``hashes``; pairs are numbered by row and sketch."""
        if not len(self.keys):
            return (np.zeros(0, np.int64),) * 3
        pos = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[pos] == hashes)
        start, count = self.ends[pos[hit]], self.ends[pos[hit] + 1] - self.ends[pos[hit]]
        at = np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)
        return np.repeat(row[hit], count) * len(self.n) + self.of[at], np.repeat(rank[hit], count), self.rank[at]


def held(sketches: DataFrame):
    """A broadcast table of ``sketches``, or None where they are too many."""
    got = sketches.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("hashes")).first()
    if got["rows"] > HELD_SKETCHES or got["hashes"] > HELD_HASHES:
        return None
    return sketches.sparkSession.sparkContext.broadcast(sketches.select("ref_idx", "name", "length", "n", "hashes").toArrow())


def _stretches(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, hashes, row of each, rank of each), some rows at once."""
    step = max(1, min(STEP // max(width, 1), 2000))
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        n = pc.list_value_length(part.column("hashes")).to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = part.column("hashes").flatten().to_numpy()
        yield part, hashes, np.repeat(np.arange(len(n)), n), np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n) + 1


PAIRS = "ref long, query long, ref_name string, query_name string, ref_length long, query_length long, ref_n long, query_n long, shared long, common long"


def pairs(sketches: DataFrame, other, params: SketchParams, every: bool, swapped: bool = False) -> DataFrame:
    """Pairs of ``sketches`` and the held ``other``: those that share a hash, or ``every`` one, with what tells their distance.

    ``swapped``: the held ones are the references.
    """
    names = [f.split()[0] for f in PAIRS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Held(other.value)
        width = len(side.n)
        for b in batches:
            for part, hashes, row, rank in _stretches(b, width):
                key, mine, theirs = side.hits(hashes, row, rank)
                order = np.argsort(key, kind="stable")
                key, place = key[order], (mine + theirs)[order]
                head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                x = np.diff(np.append(head, len(key)))
                inside = (place - (np.arange(len(key)) - np.repeat(head, x) + 1) <= params.sketch_size).astype(np.int64)
                pair, common = key[head], np.add.reduceat(inside, head) if len(head) else x
                if every:
                    cells = part.num_rows * width
                    shared, both = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
                    shared[pair], both[pair] = x, common
                    pair, x, common = np.arange(cells), shared, both
                for a in range(0, len(pair), 1 << 16):
                    cut = slice(a, a + (1 << 16))
                    one = part.select(["ref_idx", "name", "length", "n"]).take(pa.array(pair[cut] // width)).columns
                    two = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in side.about.take(pa.array(pair[cut] % width)).columns]
                    one, two = (two, one) if swapped else (one, two)
                    yield pa.RecordBatch.from_arrays([c for both_ in zip(one, two, strict=True) for c in both_] + [pa.array(x[cut]), pa.array(common[cut])], names)

    return sketches.select("ref_idx", "name", "length", "n", "hashes").mapInArrow(run, PAIRS)


WITHIN = "score double, error double, ref long, query long, ref_name string, query_name string"


def within(refs: DataFrame, queries, max_error: float) -> DataFrame:
    """:func:`compare.within` for held queries."""
    names = [f.split()[0] for f in WITHIN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Held(queries.value)
        width = len(side.n)
        for b in batches:
            for part, hashes, row, rank in _stretches(b, width):
                top, n = part.column("max_hash").to_numpy(), part.column("n").to_numpy()
                below = np.stack([np.searchsorted(h, top, "right") for h in side.hashes], axis=1) if width else np.zeros((len(n), 0), np.int64)
                j = np.minimum(np.minimum(below, n[:, None]), side.n[None, :]).ravel()
                with np.errstate(divide="ignore"):
                    error = 1 / np.sqrt(j)
                key, _, theirs = side.hits(hashes, row, rank)
                common = np.bincount(key[theirs <= j[key]], minlength=len(j))
                pair = np.flatnonzero((j > 0) & (error <= max_error))
                for a in range(0, len(pair), 1 << 16):
                    at = pair[a : a + (1 << 16)]
                    one, two = part.take(pa.array(at // width)), side.about.take(pa.array(at % width)).combine_chunks()
                    two = [two[c].chunk(0) if two[c].num_chunks else two[c].combine_chunks() for c in ("ref_idx", "name")]
                    yield pa.RecordBatch.from_arrays([pa.array(common[at] / j[at]), pa.array(error[at]), one.column("ref_idx"), two[0], one.column("name"), two[1]], names)

    return refs.where("n > 0").select("ref_idx", "name", "n", "max_hash", "hashes").mapInArrow(run, WITHIN)
