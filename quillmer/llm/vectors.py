"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are rotated to their principal axes and compared in tiles.  A tile of products is accumulated over the
leading dimensions first; what the rest can add is at most the product of the two suffix norms, so a tile stops when
no pair in it can still reach the threshold, and single pairs go on alone when few are left.  Pairs at the threshold
to within rounding are settled by the cosine of the vectors as given, in double precision.

Which tiles meet: vectors are dealt to the leaves of a k-d tree over the leading axes, whose split planes come from a
bounded sample (``SAMPLE`` vectors of smallest hash; it only steers the work).  Two leaves meet unless their boxes
are further apart than two vectors at the threshold can be.  A pair of leaves is one task; leaves are cut further by
hash where there are more than ``LEAF_ROWS`` rows for each.

A task returns numbers of links and a spanning forest, never pairs.  Equal vectors are one node throughout.

Defined results: a vector that is null, empty, zero or has a null or non-finite component links with nothing, and
vectors of unlike length don't link; rows of one id are one vector, the smallest usable array of them; a null id links with
nothing, is its own component (null) and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, attach, connected_components, materialize, pick, thrifty

THRESHOLD = 0.9
SAMPLE = 20_000
#: Bytes of it that the driver takes, as doubles: wider vectors give a smaller sample.
SAMPLE_BYTES = 128 << 20
LEAF_ROWS = 8192
TILE = 1024
#: Dimensions added before each look at the bound; the rest follows at once.
STEPS = (16, 16, 32)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Axes:
    """Principal axes of one vector length, and a k-d tree over the first of them."""

    def __init__(self, sample: np.ndarray, leaves: int, threshold: float) -> None:
        _, axes = np.linalg.eigh(sample.T @ sample)
        self.axes = axes[:, ::-1].copy()
        lead = sample @ self.axes[:, :8]
        reach = 2 - 2 * threshold + 1e-9  # squared distance of unit vectors at the threshold
        boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.full(lead.shape[1], -np.inf), np.full(lead.shape[1], np.inf), np.arange(len(lead)))]
        tree: list[tuple] = []
        self.tree = tree
        node_of_box = [None]
        whole: set[int] = set()  # boxes that no dimension's median splits
        while len(boxes) < leaves:
            at = max((i for i in range(len(boxes)) if i not in whole and len(boxes[i][2]) >= 16), key=lambda i: len(boxes[i][2]), default=None)
            if at is None:
                break
            low, high, rows = boxes[at]
            for d in np.argsort(-np.ptp(lead[rows], axis=0), kind="stable").tolist():
                cut = float(np.median(lead[rows, d]))
                left = rows[lead[rows, d] < cut]
                if 0 < len(left) < len(rows):
                    break
            else:
                whole.add(at)
                continue
            node = len(tree)
            tree.append([d, cut, at, len(boxes)])  # leaves, until they are split
            if node_of_box[at] is not None:
                parent, side = node_of_box[at]
                tree[parent][side] = ~node
            node_of_box[at] = (node, 2)
            node_of_box.append((node, 3))
            upper, lower = high.copy(), low.copy()
            upper[d], lower[d] = cut, cut
            boxes[at] = (low, upper, left)
            boxes.append((lower, high, np.setdiff1d(rows, left)))
        low, high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
        self.meets = []
        for i in range(len(boxes)):
            gap = np.maximum(0, np.maximum(low - high[i], low[i] - high))
            self.meets.append(np.flatnonzero((gap**2).sum(axis=1) <= reach))

    def leaf(self, units: np.ndarray) -> np.ndarray:
        lead = units @ self.axes[:, :8]
        out = np.zeros(len(units), np.int64)
        todo = [(0, np.arange(len(units)))] if self.tree else []
        while todo:
            node, rows = todo.pop()
            d, cut, left, right = self.tree[node]
            below = lead[rows, d] < cut
            for to, part in ((left, rows[below]), (right, rows[~below])):
                if to < 0:
                    todo.append((~to, part))
                else:
                    out[part] = to
        return out


def links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked rows of ``a`` and ``b``, tile by tile; within ``a`` (``same``) each pair once."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ra, rb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    dims = ra.shape[1]
    cuts = [0]
    for s in STEPS:
        if cuts[-1] + s < dims:
            cuts.append(cuts[-1] + s)
    cuts.append(dims)
    tail = lambda r: [np.sqrt(np.maximum((r[:, c:] ** 2).sum(axis=1), 0)) for c in cuts[1:]]
    ta, tb = tail(ra), tail(rb)
    slack = 1e-9
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            si, sj = slice(i, i + TILE), slice(j, j + TILE)
            acc, x, y = None, None, None
            for k, (c, d) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if x is None:
                    part = ra[si, c:d] @ rb[sj, c:d].T
                    acc = part if acc is None else acc + part
                    reach = acc + ta[k][si, None] * tb[k][None, sj]
                    open_ = reach >= threshold - slack
                    left = int(np.count_nonzero(open_))
                    if not left:
                        break
                    if left < 0.01 * open_.size:
                        x, y = np.nonzero(open_)
                        acc = acc[x, y]
                else:
                    acc = acc + np.einsum("ij,ij->i", ra[i + x, c:d], rb[j + y, c:d])
                    live = acc + ta[k][i + x] * tb[k][j + y] >= threshold - slack
                    x, y, acc = x[live], y[live], acc[live]
                    left = len(x)
                    if not left:
                        break
            if not left:
                continue
            if x is None:
                x, y = np.nonzero(acc >= threshold - slack)
                acc = acc[x, y]
            close = np.flatnonzero(np.abs(acc - threshold) < 1e-8)
            for part in np.array_split(close, max(1, len(close) // 65536)):
                p, q = i + x[part], j + y[part]
                acc[part] = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q])
            x, y = i + x[acc >= threshold], j + y[acc >= threshold]
            if same:
                x, y = x[x < y], y[x < y]
            yield x, y


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, v) with v null where the vector can't link, and the distinct vectors (rep, n, v)."""
    rows = pick(vectors, vec_id=id_col, v=vector_col)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    able = F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    one = rows.where("vec_id is not null").withColumn("v", F.when(able, F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    none = rows.where("vec_id is null").select("vec_id", F.lit(None).cast(rows.schema["v"].dataType).alias("v"))
    rows = materialize(one.unionByName(none), "vectors")
    nodes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    return rows, materialize(nodes, "distinct-vectors")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows, nodes = prepared(vectors, id_col, vector_col)
    total = nodes.count()
    widest = nodes.agg(F.max(F.size("v"))).first()[0] or 1
    sampled = nodes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(max(16, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))).toArrow().column("v").combine_chunks()
    by_length: dict[int, np.ndarray] = {}
    lens = sampled.value_lengths().to_numpy()
    for d in np.unique(lens).tolist():
        by_length[d] = sampled.take(pa.array(np.flatnonzero(lens == d))).flatten().to_numpy().astype(np.float64).reshape(-1, d)
    leaves = max(1, min(SAMPLE // 16, -(-total // LEAF_ROWS)))
    cut = max(1, -(-total // (LEAF_ROWS * leaves)))
    axes = {d: Axes(unit(v), leaves, threshold) for d, v in by_length.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(axes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            lens = lists.value_lengths().to_numpy()
            for d in np.unique(lens):
                at = np.flatnonzero(lens == d)
                v = lists.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, d)
                rep, n = b.column("rep").to_numpy()[at], b.column("n").to_numpy()[at]
                tree = shared.value.get(int(d))
                leaf = tree.leaf(unit(v)) if tree else np.zeros(len(v), np.int64)
                part = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % cut
                home = leaf * cut + part
                for h in np.unique(home):
                    mine = np.flatnonzero(home == h)
                    met = tree.meets[h // cut] if tree else np.zeros(1, np.int64)
                    partners = (met[:, None] * cut + np.arange(cut)[None, :]).ravel()
                    bytes_ = [x.tobytes() for x in v[mine].astype("<f8" if pa.types.is_float64(lists.type.value_type) else "<f4")]
                    for p in partners:
                        m = len(mine)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, d, np.int32)), pa.array(np.full(m, min(h, p), np.int64)), pa.array(np.full(m, max(h, p), np.int64)), pa.array(np.full(m, h > p)), pa.array(rep[mine]), pa.array(n[mine]), pa.array(bytes_, pa.binary())],
                            ["d", "i", "j", "second", "rep", "n", "v"],
                        )

    def compare(t: pa.Table) -> pa.Table:
        d, i, j = (t.column(x)[0].as_py() for x in ("d", "i", "j"))
        tree = shared.value.get(d)
        raw = b"".join(t.column("v").to_pylist())
        v = np.frombuffer(raw, "<f8" if len(raw) == 8 * d * len(t) else "<f4").astype(np.float64).reshape(-1, d)
        rep, n, second = (t.column(x).to_numpy() for x in ("rep", "n", "second"))
        first = np.flatnonzero(~second)
        later = first if i == j else np.flatnonzero(second)
        basis = tree.axes if tree else np.eye(d)
        if len(first):  # near vectors in near rows: whole tiles then stop early
            first = first[np.argsort((v[first] / np.linalg.norm(v[first], axis=1)[:, None]) @ basis[:, 0], kind="stable")]
            later = first if i == j else later
        count, trees = np.zeros(len(rep), np.int64), Forest(len(rep))
        for x, y in links(v[first], v[later], basis, i == j, threshold):
            x, y = first[x], later[y]
            count += np.bincount(x, weights=n[y], minlength=len(rep)).astype(np.int64) + np.bincount(y, weights=n[x], minlength=len(rep)).astype(np.int64)
            trees.add(x, y)
        linked = np.flatnonzero(count)
        return pa.table({"rep": rep[linked], "links": count[linked], "root": rep[trees.roots()[linked]]})

    dealt = nodes.mapInArrow(thrifty(deal), "d int, i long, j long, second boolean, rep long, n long, v binary")
    found = materialize(dealt.groupBy("d", "i", "j").applyInArrow(thrifty(compare), "rep long, links long, root long"), "vector-links")
    component = connected_components(found, "rep", "root").withColumnRenamed("node", "rep")
    links_of = found.groupBy("rep").agg(F.sum("links").alias("links"))
    summary = nodes.select("rep", "n").join(links_of, "rep", "left").join(component, "rep", "left").where("n > 1 or links is not null")
    summary = materialize(summary.select("rep", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "summary")
    copies = materialize(nodes.where("n > 1").select("v", F.col("rep").alias("of")), "copies")
    member = attach(rows, copies, "v", salt="vec_id").select("vec_id", F.coalesce("of", "vec_id").alias("rep"))
    out = attach(member, summary, "rep", salt="vec_id")
    component_id = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))
