"""SimHash near-duplicates by pivot distance tables.

Fingerprints: lower-case A-Z, words, 4-word shingles with repeats joined by one space (fewer words: the whole
sequence, none: fingerprint zero), XXH64 with seed 42; a bit is 1 if it is set in over half of the hashes.
Documents of fingerprints that differ in at most ``MAX_BITS`` bits link.

Search, over distinct fingerprints only.  The Hamming distances to many pivots are tabulated; a pair whose coordinates
differ by more than ``MAX_BITS`` at any pivot can't link (triangle inequality), survivors are verified.  Every pair that
meets goes through the whole table; of larger groups only those rows meet whose distances to the first pivot are
within ``MAX_BITS`` at all.

Which pairs meet: two fingerprints that link differ by 4 bits at most, while their distances to any reference that does
not depend on them spread by as much again (32 +- 4), so that the table alone, exact as it is, would look at a fixed share
of all pairs.  So the bits are cut into blocks such that two linked fingerprints agree on ``keep`` of them at least, and
each choice of so many blocks makes a bucket; pairs meet within buckets.  The rows of a bucket of more than
``TILE`` are dealt once more by blocks of the bits on which it doesn't agree yet, and so on: a bucket never holds
more than the free bits tell apart, a row is copied a fixed number of times for each level, and no link is lost.  A bucket
yields a spanning forest of its links, never all pairs.

Defined results: a null text counts as empty; equal texts share a fingerprint; rows of one id are one node (so
fingerprints of one id are linked), of which equal fingerprints are returned once; rows with a null id are linked
like others and returned once for each fingerprint, their component is the smallest id that they reach, or null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Forest, Words, buffers, connected_components, is_empty, materialize, pick, signed, text_slices, thrifty, xxh64

SHINGLE = 4
MAX_BITS = 4
PIVOTS = 24
#: Rows of a bucket that are compared in one place.
TILE = 2048

#: Byte -> its eight bits, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each range first[i]:first[i+1] of hashes the bits that over half of them have."""
    counts = np.diff(first)
    # runs of at most 255 hashes, so that sums fit in a byte
    runs = np.maximum(1, -(-counts // 255))
    run_text = np.repeat(np.arange(len(counts)), runs)
    within = np.arange(len(run_text)) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = first[run_text] + 255 * within
    full = counts[run_text] > 0
    out = np.zeros(len(counts), np.uint64)
    if not full.any():
        return out
    run_text, begin = run_text[full], begin[full]
    as_bytes = h.view(np.uint8).reshape(-1, 8)
    heads = np.flatnonzero(np.append(True, run_text[1:] != run_text[:-1]))
    texts = run_text[heads]
    for j in range(8):
        lanes = np.add.reduceat(_SPREAD[as_bytes[:, j]], begin).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(lanes, heads, axis=0, dtype=np.int64)
        bits = np.packbits(2 * total > counts[texts][:, None], axis=1, bitorder="little")[:, 0]
        out[texts] |= bits.astype(np.uint64) << np.uint64(8 * j)
    return out


def fingerprints(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    words = Words(*buffers(texts), lower=True)
    n = len(words.counts)
    lens = words.ends - words.starts
    starts = np.cumsum(lens + 1) - (lens + 1)
    joined = np.full(int((lens + 1).sum()) + 8, 32, np.uint8)
    solid = np.flatnonzero(words.solid)
    joined[np.arange(len(solid)) + np.repeat(np.arange(len(lens)), lens)] = words.raw[solid]
    shingles = np.where(words.counts >= width, words.counts - width + 1, np.minimum(words.counts, 1))
    first = np.zeros(n + 1, np.int64)
    np.cumsum(shingles, out=first[1:])
    text = np.repeat(np.arange(n), shingles)
    begin = np.arange(first[-1]) - first[text] + words.first[text]
    end = begin + np.minimum(words.counts[text], width) - 1
    s = starts[begin]
    size = starts[end] + lens[end] - s
    h = np.empty(len(s), np.uint64)
    for a in range(0, len(s), 1 << 17):
        h[a : a + (1 << 17)] = xxh64(joined, s[a : a + (1 << 17)], size[a : a + (1 << 17)])
    return majority(h, first)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(signed(fingerprints(b.column("text"), width)))], ["doc_id", "fp"])

    return pick(docs, id=id_col, text=text_col).mapInArrow(thrifty(run), "doc_id long, fp long")


def marked(docs: DataFrame, name: str, text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``docs`` with its rows' fingerprints, 16 hex digits, as the last column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(signed(fingerprints(b.column(text_col), width)))], [*b.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    return docs.mapInArrow(thrifty(run), schema).withColumn(name, digits(name))


def digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def plan_keep(n: int, max_bits: int = MAX_BITS) -> int:
    """How many blocks two linked fingerprints have to share, of ``max_bits`` more: keys are about log2(n) bits wide."""
    return next((k for k in (2, 3) if 64 // (max_bits + k) * k >= np.log2(max(n, 2)) - 5), 4)


def masks(agreed: int, keep: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of bits such that two fingerprints that differ in ``max_bits`` bits at most, and agree on ``agreed``, agree on one of them; each holds ``agreed``."""
    free = [i for i in range(64) if not agreed >> i & 1]
    blocks = max_bits + keep
    cuts = [round(len(free) * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return sorted({agreed | sum(chosen) for chosen in combinations(parts, keep)})


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random words."""
    return np.random.default_rng(20240229).integers(0, 1 << 64, count, dtype=np.uint64)


class PivotTable:
    """Hamming distances of fingerprints to the pivots."""

    def __init__(self, fps: np.ndarray, max_bits: int) -> None:
        self.fps, self.max_bits = fps, max_bits
        self.rows = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)

    def linked(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that link: coordinate by coordinate, then in full."""
        for p in range(self.rows.shape[1]):
            near = np.abs(self.rows[x, p] - self.rows[y, p]) <= self.max_bits
            x, y = x[near], y[near]
        ok = np.bitwise_count(self.fps[x] ^ self.fps[y]) <= self.max_bits
        return x[ok], y[ok]


#: Buckets up to this size are compared at all offsets at once.
_SMALL = 48


def bucket_forest(fps: np.ndarray, key: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links within buckets of equal ``key``."""
    nodes, node = np.unique(fps, return_inverse=True)
    table, trees = PivotTable(nodes, max_bits), Forest(len(nodes))
    order = np.lexsort((table.rows[node, 0], key))  # within a bucket by distance to the first pivot
    key, node = key[order], node[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(key)))
    at = np.flatnonzero(np.repeat(size <= _SMALL, size))
    for d in range(1, _SMALL):
        at = at[at + d < len(key)]
        at = at[key[at + d] == key[at]]
        if not len(at):
            break
        trees.add(*table.linked(node[at], node[at + d]))
    for h, n in zip(heads[size > _SMALL].tolist(), size[size > _SMALL].tolist(), strict=True):
        mine = node[h : h + n]
        first = table.rows[mine, 0]
        reach = np.searchsorted(first, first + max_bits, side="right")  # rows that a row meets end here
        many = reach - np.arange(n) - 1
        ends = np.cumsum(many)
        a = 0
        while a < n:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), side="right")))
            x = np.repeat(np.arange(a, z), many[a:z])
            y = np.arange(len(x)) - np.repeat(np.cumsum(many[a:z]) - many[a:z], many[a:z]) + x + 1
            trees.add(*table.linked(mine[x], mine[y]))
            a = z
    return nodes[np.array(trees.left, np.int64)], nodes[np.array(trees.right, np.int64)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``nodes(fp)`` that connect all that are linked."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        fp, mask, k = (rows.column(x).to_numpy() for x in ("fp", "mask", "k"))
        _, mask = np.unique(mask, return_inverse=True)
        values, k = np.unique(k, return_inverse=True)
        left, right = bucket_forest(fp.view(np.uint64), mask * len(values) + k, max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(signed(left)), pa.array(signed(right))], ["a", "b"])

    keep, agreed, rows, found = plan_keep(nodes.count(), max_bits), [0], nodes.select("fp", F.lit(0).cast("long").alias("mask")), None
    while True:
        finer = nodes.sparkSession.createDataFrame([(_long(mask), [_long(m) for m in masks(mask, keep, max_bits)]) for mask in agreed], "mask long, finer array<long>")
        spread = rows.join(F.broadcast(finer), "mask").select("fp", F.explode("finer").alias("mask")).withColumn("k", F.col("fp").bitwiseAND(F.col("mask")))
        spread = materialize(spread, "buckets")
        sizes = materialize(spread.groupBy("mask", "k").count().where("count > 1"), "sizes")
        small = spread.join(sizes.where(F.col("count") <= TILE).select("mask", "k"), ["mask", "k"])
        met = small.repartition("mask", "k").mapInArrow(thrifty(search), "a long, b long")
        found = met if found is None else found.unionByName(met)
        hot = sizes.where(F.col("count") > TILE)
        agreed = [r["mask"] % (1 << 64) for r in hot.select("mask").distinct().collect()]  # at most as many as masks of this level
        if not agreed:
            return found
        # a level leaves fewer free bits, and a bucket holds no more rows than these tell apart: this ends
        rows, keep = spread.join(hot.select("mask", "k"), ["mask", "k"]).select("fp", "mask"), 2


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, max_bits: int = MAX_BITS, ids_are_nodes: bool = True) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Without ``ids_are_nodes`` different texts of one id are not linked by it.
    """
    prints = materialize(with_fingerprint(docs, id_col, text_col, width).distinct(), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = links(nodes.select("fp"), max_bits)
    if ids_are_nodes:
        ids = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
        ids = materialize(ids.select("doc_id", "a"), "repeated-ids")
        if not is_empty(ids):
            edges = edges.unionByName(prints.join(ids, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b")))
    component = connected_components(edges)
    # components are named by a fingerprint; name them by their smallest document instead
    named = nodes.join(component.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = materialize(named, "named")
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    label = materialize(named.join(least, "root").select("fp", "component_id"), "label")
    return prints.join(label, "fp").select("doc_id", digits("fp").alias("fingerprint"), "component_id")
