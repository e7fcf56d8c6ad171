"""Shared parts of the corpus operators.

* :func:`materialize` cuts lineage by writing a Parquet table below ``spark.checkpoint.dir``.
* :class:`Words` finds the words of a batch of texts with whole-array numpy operations.
* :func:`connected_components` labels graph components by repeated contraction; nothing but
  counters reaches the driver.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import json
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by one numpy pass; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Maps each byte to itself, A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), f"quillmer-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a lost executor then costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give memory that a finished task no longer uses back to the system: workers live on, and their next stage needs room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What a worker keeps from task to task, by the module that made it.
_KEPT: dict[str, tuple] = {}


def kept(module: str, key, make):
    """What ``make`` gave for this key; a module keeps one thing."""
    have = _KEPT.get(module)
    if have is None or have[0] != key:
        _KEPT.pop(module, None)
        have = _KEPT[module] = (key, make())
    return have[1]


def thrifty(run):
    """``run`` over batches, or a table: first drops what other modules keep, and calls :func:`trim` at its end."""
    module = run.__module__

    def make_room() -> None:
        others = [m for m in _KEPT if m != module]
        for m in others:
            del _KEPT[m]
        if others:
            gc.collect()
            trim()

    def over_batches(batches):
        make_room()
        try:
            yield from run(batches)
        finally:
            trim()

    def over_table(table: pa.Table) -> pa.Table:
        make_room()
        out = run(table)
        trim()
        return out

    return over_batches if inspect.isgeneratorfunction(run) else over_table


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


#: Rows of an Arrow batch: they hold whole texts, and each worker has a batch on both of its sides.
BATCH_ROWS = 1000


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, renamed: whatever else a table holds can't clash with ours.

    Arrow batches of the session get ``BATCH_ROWS`` rows at most from now on.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in cols.items()))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` at most, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls' bytes, and its int64 offsets from 0."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64
_SEED = np.uint64(42)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """XXH64 (seed 42) of the spans of ``data``, which must have 8 spare bytes at its end."""
    at8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    at4 = np.ndarray((len(data) - 7,), "<u4", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = np.full(len(starts), _SEED + _P5, np.uint64)
        at = starts.copy()
        big = np.flatnonzero(lens >= 32)
        if len(big):
            p, stripes = starts[big], lens[big] // 32
            v = [np.full(len(big), x, np.uint64) for x in (_SEED + _P1 + _P2, _SEED + _P2, _SEED, _SEED - _P1)]
            live, k = np.arange(len(big)), 0
            while len(live):
                q = p[live] + 32 * k
                for j in range(4):
                    v[j][live] = _round(v[j][live], at8[q + 8 * j])
                k += 1
                live = live[stripes[live] > k]
            acc = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.zeros_like(x), x)) * _P1 + _P4
            h[big] = acc
            at[big] += 32 * stripes
        h += lens.astype(np.uint64)
        left = (starts + lens) - at
        for k in range(3):
            i = np.flatnonzero(left >= 8 * (k + 1))
            lane = _round(np.zeros(len(i), np.uint64), at8[at[i] + 8 * k])
            h[i] = _rot(h[i] ^ lane, 27) * _P1 + _P4
        at += left & ~7
        left &= 7
        i = np.flatnonzero(left >= 4)
        h[i] = _rot(h[i] ^ (at4[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[i] += 4
        left &= 3
        for k in range(3):
            i = np.flatnonzero(left > k)
            h[i] = _rot(h[i] ^ (data[at[i] + k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def codes(raw: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the byte strings that make up ``raw`` one after another, equal for equal bytes only, and the distinct strings."""
    ends = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=ends[1:])
    coded = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def string_hashes(strings: pa.Array) -> np.ndarray:
    """XXH64 of each of some byte strings."""
    raw, offsets = buffers(strings)
    return xxh64(np.concatenate([raw, np.zeros(8, np.uint8)]), offsets[:-1], np.diff(offsets))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts of a batch.

    ``starts``/``ends`` index ``raw``; words ``first[i]:first[i+1]`` are those of text i.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = _WHITE) -> None:
        self.raw = raw = LOWER[raw] if lower else raw
        self.offsets = offsets
        solid = np.zeros(len(raw) + 2, bool)
        np.logical_not(separators[raw], out=solid[1:-1])
        begins = solid[1:-1] & ~solid[:-2]
        stops = solid[1:-1] & ~solid[2:]
        inner = offsets[(offsets > 0) & (offsets < len(raw))]  # words don't cross texts
        begins[inner] = solid[1:-1][inner]
        stops[inner - 1] = solid[1:-1][inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.solid = solid[1:-1]

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """The number of each word, equal for equal words only, and the distinct words."""
        return codes(self.raw[self.solid], self.ends - self.starts)

    def hashes(self) -> np.ndarray:
        """XXH64 of each word."""
        code, distinct = self.codes()
        return string_hashes(distinct)[code]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]], also of empty ranges."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == np.uint64 else h


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by pointer
    doubling, and contracts the edges to roots.  Hubs cost nothing special: minima are pre-aggregated before
    their shuffle and joins are between materialised tables, whose large partitions Spark splits.
    Nulls and self-links make no edge; a node that only has those is not returned.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not is_empty(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        hooks = materialize(hooks.select("node", F.least("node", "to").alias("to")), "hooks")
        while True:
            up = hooks.where("node <> to").select(F.col("node").alias("to"), F.col("to").alias("next"))
            if is_empty(hooks.where("node <> to").join(up, "to", "left_semi")):
                break
            hooks = materialize(hooks.join(up, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("component"))
        else:
            by = hooks.select(F.col("node").alias("component"), "to")
            labels = materialize(labels.join(by, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        ha = hooks.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        hb = hooks.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        half = materialize(edges.join(ha, "a").select("ra", "b"), "half")
        left = half.join(hb, "b").where("ra <> rb")
        edges = materialize(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


#: Rows of a table that may be broadcast, and bytes of their values as text; larger ones are joined by salted keys.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
SALTS = 32


def is_small(table: DataFrame) -> bool:
    """Both bounds, measured."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in table.columns), F.lit(8))
    got = table.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum(width).alias("size")).first()
    return got["n"] <= BROADCAST_ROWS and (got["size"] or 0) <= BROADCAST_BYTES


def attach(rows: DataFrame, table: DataFrame, key: str, salt: str) -> DataFrame:
    """``rows`` left join ``table`` on ``key``, of which ``table`` has each value once.

    A table within ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` is broadcast.  Beyond that both sides are dealt by key and salt,
    so that a key with many rows is spread over ``SALTS`` tasks; ``salt`` names a column of ``rows`` that varies.
    """
    if is_small(table):
        return rows.join(F.broadcast(table), key, "left")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def without(rows: DataFrame, gone: DataFrame, key: str | list[str]) -> DataFrame:
    """``rows`` whose key, of one column or several, isn't in ``gone(key)``; rows with a null key stay."""
    if is_small(gone):
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").select(*rows.columns)


def pack(level: int = 1, **arrays: np.ndarray) -> bytes:
    """Named arrays in one compressed block; integers in the narrowest width that holds them."""
    head, parts = {}, []
    for name, a in arrays.items():
        if a.dtype.kind in "iu" and (not len(a) or int(a.min()) >= 0):
            top = int(a.max()) if len(a) else 0
            a = a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
        head[name] = [a.dtype.str, len(a)]
        # bytes of like significance next to each other compress better
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"")
    text = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=level).compress(len(text).to_bytes(4, "little") + text + b"".join(parts))


def unpack(body: bytes) -> dict[str, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    size = int.from_bytes(data[:4], "little")
    at, out = 4 + size, {}
    for name, (kind, n) in json.loads(data[4:at]).items():
        width = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel() if n else np.zeros(0, kind)
        at += n * width
    return out


class Forest:
    """Union-find over 0..n-1 that remembers the links which joined two trees; a root is the smallest of its tree."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self.left: list[int] = []
        self.right: list[int] = []

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Links x[i] - y[i].  Each round takes one link of each x, then drops those that are within a tree by now."""
        while len(x):
            root = self.roots()
            new = root[x] != root[y]
            x, y = x[new], y[new]
            one = np.unique(x, return_index=True)[1]
            parent = self.parent
            for u, v in zip(x[one].tolist(), y[one].tolist(), strict=True):
                ru, rv = u, v
                while parent[ru] != ru:
                    ru = parent[ru]
                while parent[rv] != rv:
                    rv = parent[rv]
                if ru != rv:
                    parent[max(ru, rv)] = min(ru, rv)
                    self.left.append(u)
                    self.right.append(v)
