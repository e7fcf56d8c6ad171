"""Where in the references a query's minmers lie: windowed sketches with positions, hits clustered by query length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import BLOCK, KmerHasher, Wanted
from ..params import SketchParams
from ..plans import small, spread, written
from .screen import WANTED_HASHES


def leftmost_minmers(h: np.ndarray, window: int, size: int) -> np.ndarray:
    """Positions that are, in some window of ``window`` consecutive hashes, the leftmost of one of its ``size`` smallest distinct hashes."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    chosen = np.zeros(n, bool)
    step = max(1, (1 << 22) // window)
    frames = np.lib.stride_tricks.sliding_window_view(h, window)
    for a in range(0, len(frames), step):
        part = frames[a : a + step]
        order = np.argsort(part, axis=1, kind="stable")
        ranked = np.take_along_axis(part, order, axis=1)
        first = np.ones(ranked.shape, bool)
        first[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        take = first & (np.cumsum(first, axis=1) <= size)
        row, col = np.nonzero(take)
        chosen[a + row + order[row, col]] = True
    return np.flatnonzero(chosen)


#: Hashes looked at around positions at once.
NEAR = 1 << 19


def minmers_at(h: np.ndarray, rows: np.ndarray, at: np.ndarray, window: int, size: int) -> np.ndarray:
    """Which of the positions ``at`` :func:`leftmost_minmers` chooses in their rows, that end at ``rows``.

    A position is chosen if a window around it holds fewer than ``size`` smaller hashes: the window lies between the
    i-th smaller one on its left and the j-th on its right, i + j = size + 1, and the row's ends.  Rows with equal
    hashes near a position, and short ones, go the plain way.
    """
    out = np.zeros(len(at), bool)
    owner = np.searchsorted(rows, at, "right")
    begin, end = np.append(0, rows)[owner], rows[owner]
    slow = end - begin < window
    top = np.iinfo(np.int64).max
    step = max(1, NEAR // (2 * window))
    around = np.arange(1 - window, window)
    for a in range(0, len(at), step):
        part = slice(a, a + step)
        p, lo, hi = at[part, None], begin[part, None], end[part, None]
        near = p + around
        v = h[np.clip(near, 0, len(h) - 1)]
        v[(near < lo) | (near >= hi)] = top
        ordered = np.sort(v, axis=1)
        slow[part] |= ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] != top)).any(axis=1) | (h[at[part]] == top)
        less = v < h[p]
        left = np.cumsum(less[:, window - 2 :: -1] if window > 1 else less[:, :0], axis=1, dtype=np.int32)
        right = np.cumsum(less[:, window:], axis=1, dtype=np.int32)
        wall, end_ = (p - lo + 1)[:, 0], (hi - p)[:, 0]
        l, r = ([np.minimum(1 + (c < i).sum(axis=1), w) for i in range(1, min(size, window) + 1)] for c, w in ((left, wall), (right, end_)))
        for x, y in zip(l, reversed(r), strict=True):
            out[part] |= x + y - 1 >= window
    for row in np.unique(owner[slow]).tolist():
        lo, hi = int(rows[row - 1]) if row else 0, int(rows[row])
        chosen = np.zeros(hi - lo, bool)
        chosen[leftmost_minmers(h[lo:hi], window, size)] = True
        own = slice(*np.searchsorted(owner, [row, row + 1]))
        out[own] = chosen[at[own] - lo]
    return out


def minmers(seqs: DataFrame, params: SketchParams, window: int = 10_000, size: int | None = None, group: str = "ref_idx", seq: str = "seq", wanted=None) -> DataFrame:
    """(group, position, hash) of windowed minmers: k-mers as they stand, without case folding, strands or alphabet.

    ``wanted``, a broadcast sorted array: only minmers with a hash that it holds.
    """
    plain = params.with_(canonical=False, preserve_case=True)
    take = size or params.sketch_size
    rows = spread(seqs.select(F.col(group).alias("grp"), F.col(seq).cast("binary").alias("seq")).where("seq is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = KmerHasher(plain)
        tool.valid[:] = True
        asked = Wanted(wanted.value) if wanted is not None else None

        def found(b: pa.RecordBatch, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            h, ends = np.concatenate([x for _, x in held]), np.cumsum([len(x) for _, x in held])
            at = np.arange(len(h)) if asked is None else np.flatnonzero(asked.holds(h))
            if window * take <= 1 << 12:
                at = at[minmers_at(h, ends, at, window, take)]
            else:  # wide windows: sorted row by row
                chosen = np.zeros(len(h), bool)
                for end, (_, x) in zip(ends.tolist(), held, strict=True):
                    chosen[end - len(x) + leftmost_minmers(x, window, take)] = True
                at = at[chosen[at]]
            owner = np.searchsorted(ends, at, "right")
            names = b.column("grp").take(pa.array(np.array([row for row, _ in held], np.int64)[owner]))
            return pa.RecordBatch.from_arrays([names, pa.array((at - np.append(0, ends)[owner]).astype(np.int32)), pa.array(h[at])], [group, "position", "hash"])

        for b in batches:
            held: list[tuple[int, np.ndarray]] = []
            size_ = 0
            for row, ends, h in tool.blocks(b.column("seq")):
                start = 0
                for i, end in zip(row.tolist(), ends.tolist(), strict=True):
                    piece, start = h[start:end], end
                    if held and held[-1][0] == i:
                        held[-1] = i, np.append(held[-1][1], piece)
                    else:
                        if size_ > BLOCK:
                            yield found(b, held)
                            held, size_ = [], 0
                        held.append((i, piece))
                    size_ += len(piece)
            if held:
                yield found(b, held)

    kind = seqs.schema[group].dataType.simpleString()
    return rows.mapInArrow(run, f"{group} {kind}, position int, hash long")


def strands(queries: DataFrame) -> DataFrame:
    """Each of ``queries(query, name, seq)`` forward and, complemented by A-T and C-G only, backward."""
    back = F.reverse(F.translate("seq", "ACGT", "TGCA"))
    both = F.array(F.struct(F.lit(False).alias("minus"), F.col("seq").alias("s")), F.struct(F.lit(True).alias("minus"), back.alias("s")))
    return queries.select("query", "name", F.explode(both).alias("x")).select("query", "name", F.col("x.minus").alias("minus"), F.col("x.s").alias("seq"))


def query_hashes(queries: DataFrame, params: SketchParams) -> DataFrame:
    """(query, minus, hash): the smallest ``sketch_size`` distinct hashes of each query and strand."""
    plain = params.with_(canonical=False, preserve_case=True)
    rows = strands(queries).select("query", "minus", F.col("seq").cast("binary").alias("seq"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = KmerHasher(plain)
        tool.valid[:] = True
        for pdf in batches:
            for q, minus, data in zip(pdf["query"], pdf["minus"], pdf["seq"], strict=True):
                parts = [x for _, x in tool.each([bytes(data)])]
                if parts:
                    h = np.unique(np.concatenate(parts))[: params.sketch_size]
                    yield pd.DataFrame({"query": q, "minus": minus, "hash": h})

    return rows.mapInPandas(run, "query long, minus boolean, hash long")


def clusters(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """(query, ref_idx, minus, start, end, hits): maximal windows of at most the query's length that no other one contains.

    ``hits(query, ref_idx, minus, position)``, ``lengths(query, length)``.
    """
    over = Window.partitionBy("query", "ref_idx", "minus").orderBy("position")
    placed = hits.distinct().join(lengths, "query")
    # positions of a group are few next to the reference: they are the query's minmers only
    group = placed.groupBy("query", "ref_idx", "minus", "length").agg(F.array_sort(F.collect_list("position")).alias("p"))
    span = F.transform("p", lambda a: F.struct(a.alias("start"), F.filter("p", lambda x: (x >= a) & (x < a + F.col("length"))).alias("inside")))
    rows = group.select("query", "ref_idx", "minus", F.explode(span).alias("x"))
    rows = rows.select("query", "ref_idx", "minus", F.col("x.start").alias("position"), F.array_max("x.inside").alias("end"), F.size("x.inside").alias("hits"))
    rows = rows.withColumn("before", F.lag("end").over(over))
    return rows.where("before is null or end > before").select("query", "ref_idx", "minus", F.col("position").alias("start"), "end", "hits")


def find(refs: DataFrame, queries: DataFrame, params: SketchParams, window: int = 10_000, minmers_per_window: int | None = None, threshold: float = 0.0, best: int = 0, exclude_self: bool = False) -> DataFrame:
    """query, query_name, ref_idx, ref_name, start, end, minus, score.

    ``refs(ref_idx, name, seq)`` and ``queries(query, name, seq)``; both use the parameters' seed and hash width.
    ``end`` is where the last matched k-mer starts.  ``best`` hits a query are kept if it isn't 0: by score, then
    reference, start and strand.
    """
    probes = written(query_hashes(queries, params), "probes")
    wanted = None
    if probes.count() <= WANTED_HASHES:  # other minmers meet no query
        hashes = probes.select("hash").distinct().toArrow()["hash"].to_numpy()
        wanted = refs.sparkSession.sparkContext.broadcast(np.sort(hashes))
    loci = minmers(refs, params, window, minmers_per_window, wanted=wanted)
    names = refs.select("ref_idx", F.col("name").alias("ref_name"))
    asked = queries.select("query", F.col("name").alias("query_name"), F.octet_length("seq").alias("length"))
    hits = loci.join(small(probes), "hash").select("query", "ref_idx", "minus", "position")
    if exclude_self:
        hits = hits.join(names, "ref_idx").join(asked, "query").where("ref_name <> query_name").select("query", "ref_idx", "minus", "position")
    size = probes.groupBy("query", "minus").agg(F.count("*").alias("size"))
    out = clusters(hits, asked.select("query", "length")).join(size, ["query", "minus"]).withColumn("score", F.col("hits") / F.col("size")).where(F.col("score") >= threshold)
    if best:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "ref_idx", "start", "minus")
        out = out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best)
    return out.join(names, "ref_idx").join(asked, "query").select("query", "query_name", "ref_idx", "ref_name", "start", "end", "minus", "score")
