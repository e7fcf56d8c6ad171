"""Bottom-s sketches.

Two forms: *postings* (ref_idx, hash, rank, count), one row a hash, and *sketches*, one row a reference with arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import KmerHasher, hashed, whole
from ..functions.stats import cardinality
from ..params import SketchParams
from ..plans import numbered, small

SKETCH_SCHEMA = "ref_idx long, name string, comment string, length long, n long, max_hash long, hashes array<long>, counts array<long>"


def hash_counts(seqs: DataFrame, params: SketchParams, group: str = "ref_idx", seq: str = "seq", limit: int | None = None) -> DataFrame:
    """(group, hash, count) over all k-mers, each hash once; with a ``limit`` at least so many smallest of each group."""
    rows = hashed(seqs, group, seq, params, limit)
    if limit is not None:  # few rows of a group are left, so that one shuffle by group serves its ranks too
        rows = rows.repartition(group)
    return rows.groupBy(group, "hash").agg(F.sum("count").alias("count"))


def bottom(counts: DataFrame, params: SketchParams, group: str = "ref_idx") -> DataFrame:
    """Postings: of each group the ``sketch_size`` smallest hashes seen ``min_copies`` times or more, ranked from 1.

    The row number's limit is applied before and after the shuffle by group, so no task gets more than
    ``sketch_size`` rows of a group from each task before.  Counts come by group and hash, so that a group with many
    sequences is spread over tasks until then.
    """
    if params.min_copies > 1:
        counts = counts.where(F.col("count") >= params.min_copies)
    order = Window.partitionBy(group).orderBy("hash")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.sketch_size).select(group, "hash", "rank", "count")


def by_rows(seqs: DataFrame, group: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of ``seqs`` that are their groups' only ones, and the others; None where there are no such, or few next to the others."""
    n = seqs.groupBy(group).count()
    got = n.agg(F.count("*").alias("groups"), F.count_if(F.col("count") > 1).alias("several")).first()
    if not got["several"]:
        return seqs, None
    if 2 * got["several"] > got["groups"]:
        return None, seqs
    keys = small(n.where("count > 1").select(F.col(group).alias("_group")))
    same = F.col(group).eqNullSafe(F.col("_group"))
    return seqs.join(keys, same, "left_anti"), seqs.join(keys, same, "left_semi")


def _merged_rows(rest: DataFrame, params: SketchParams, group: str, seq: str) -> DataFrame:
    """Postings of groups of several rows.  Unless rare k-mers have to be left out, which only the whole count tells, tasks keep each group's smallest hashes before the shuffle."""
    limit = params.sketch_size if params.min_copies == 1 else None
    return bottom(hash_counts(rest, params, group, seq, limit), params, group)


def postings(seqs: DataFrame, params: SketchParams, group: str = "ref_idx", seq: str = "seq") -> DataFrame:
    """Postings of ``seqs(group, seq)``; records shorter than a k-mer add nothing.

    A group of one row is sketched where it is read and never shuffled.
    """
    alone, rest = by_rows(seqs.select(group, seq), group)
    parts = []
    if alone is not None:
        parts.append(exploded(whole(alone, group, seq, params), group))
    if rest is not None:
        parts.append(_merged_rows(rest, params, group, seq))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def gathered(seqs: DataFrame, params: SketchParams, group: str = "ref_idx", seq: str = "seq") -> DataFrame:
    """(group, length, hashes, counts): each group's sketch and the bytes of its sequences that are long enough for a k-mer."""
    alone, rest = by_rows(seqs.select(group, seq), group)
    parts = []
    if alone is not None:
        parts.append(whole(alone, group, seq, params))
    if rest is not None:
        size = F.octet_length(seq).cast("long")
        lengths = rest.groupBy(group).agg(F.coalesce(F.sum(F.when(size >= params.kmer, size)), F.lit(0)).alias("length"))
        arrays = _merged_rows(rest, params, group, seq).groupBy(F.col(group).alias("_group")).agg(F.array_sort(F.collect_list(F.struct("hash", "count"))).alias("h"))
        both = lengths.join(arrays, F.col(group).eqNullSafe(F.col("_group")), "left")
        parts.append(both.select(group, "length", *(F.coalesce(F.col(f"h.{x}"), F.array().cast("array<long>")).alias(y) for x, y in (("hash", "hashes"), ("count", "counts")))))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def sized(rows: DataFrame) -> DataFrame:
    """Sketches from ``rows(ref_idx, name, comment, length, hashes, counts)``."""
    return rows.select("ref_idx", "name", "comment", "length", F.size("hashes").cast("long").alias("n"), F.array_max("hashes").alias("max_hash"), "hashes", "counts")


def record_comments(records: DataFrame, params: SketchParams) -> DataFrame:
    """(ref_idx, comment, records, total_length) of ``records(ref_idx, order, name, comment, seq)``.

    Records count that are long enough for a k-mer.  One record gives "name comment" (the comment alone where the
    sketch is named after it), several "[N seqs] name comment [...]" of the first.
    """
    long_enough = records.where(F.octet_length("seq") >= params.kmer)
    first = F.min_by(F.concat_ws(" ", F.col("name"), F.nullif("comment", F.lit(""))), "order")
    out = long_enough.groupBy("ref_idx").agg(first.alias("first"), F.count("*").alias("records"), F.sum(F.octet_length("seq").cast("long")).alias("total_length"))
    comment = F.when(F.col("records") > 1, F.concat(F.lit("["), F.col("records"), F.lit(" seqs] "), F.col("first"), F.lit(" [...]"))).otherwise(F.col("first"))
    return out.select("ref_idx", comment.alias("comment"), "records", "total_length")


def nested(posting: DataFrame, meta: DataFrame) -> DataFrame:
    """Sketches from postings and ``meta(ref_idx, name, comment, length)``; a null length is estimated later by :func:`with_lengths`."""
    arrays = posting.groupBy("ref_idx").agg(F.array_sort(F.collect_list(F.struct("hash", "count"))).alias("h"))
    rows = meta.join(arrays, "ref_idx", "left")
    hashes, counts = F.coalesce(F.col("h.hash"), F.array().cast("array<long>")), F.coalesce(F.col("h.count"), F.array().cast("array<long>"))
    return sized(rows.select("ref_idx", "name", "comment", "length", hashes.alias("hashes"), counts.alias("counts")))


def with_lengths(sketches: DataFrame, params: SketchParams) -> DataFrame:
    """Lengths as the parameters say: of read sets the genome size given, or else estimated from the sketch."""
    if not params.reads:
        return sketches
    estimate = F.floor(F.coalesce(cardinality(F.col("n"), F.col("max_hash"), params), F.lit(0.0))).cast("long")
    return sketches.withColumn("length", F.lit(params.genome_size).cast("long") if params.genome_size else estimate)


def sketch(records: DataFrame, params: SketchParams) -> DataFrame:
    """Sketches of ``records(file, file_idx, rec_no, name, comment, seq)``.

    Concatenated: one sketch a file, named after it; individual: one a record.  Read sets are one sketch altogether.
    """
    if params.reads:
        first = F.min_by("file", "file_idx")
        rows = records.withColumn("ref_idx", F.lit(0).cast("long"))
        name = records.agg(first.alias("file")).select(F.lit(0).cast("long").alias("ref_idx"), "file")
    elif params.concatenated:
        rows = records.withColumn("ref_idx", F.col("file_idx").cast("long"))
        name = rows.groupBy("ref_idx").agg(F.min("file").alias("file"))
    else:
        long_enough = records.where(F.octet_length("seq") >= params.kmer)
        rows = long_enough.join(numbered(long_enough.select("file_idx", "rec_no").distinct(), "ref_idx"), ["file_idx", "rec_no"])
        meta = rows.select("ref_idx", F.col("name"), "comment", F.octet_length("seq").cast("long").alias("length"))
        return nested(postings(rows, params), meta)
    if params.target_coverage:
        return until_coverage(rows, params)
    # files are read in turns, one record of each, so the first file's first record is the first of all
    about = record_comments(rows.withColumn("order", F.struct("file_idx", "rec_no")), params)
    meta = about.join(name, "ref_idx").select("ref_idx", F.col("file").alias("name"), "comment", F.col("total_length").alias("length"))
    return with_lengths(nested(postings(rows, params), meta), params)


def until_coverage(records: DataFrame, params: SketchParams) -> DataFrame:
    """Read-set sketches that take records in order only until the mean count of the sketch reaches the target.

    Order decides, so each reference is folded in one group; that is the operator's meaning, not a shortcut.
    """
    target = params.target_coverage or 0.0

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        # files are read in turns, one record of each that is long enough
        size = pdf["seq"].map(lambda s: len(s.encode() if isinstance(s, str) else s))
        pdf = pdf[size >= params.kmer].sort_values(["file_idx", "rec_no"])
        pdf = pdf.assign(turn=pdf.groupby("file_idx").cumcount()).sort_values(["turn", "file_idx"])
        if not len(pdf):
            return pd.DataFrame({c.split()[0]: [] for c in SKETCH_SCHEMA.split(", ")})
        tool = KmerHasher(params)
        counts: dict[int, int] = {}
        used, length, first = 0, 0, ""
        best: list[int] = []
        for name, comment, seq in zip(pdf["name"], pdf["comment"], pdf["seq"], strict=True):
            data = bytes(seq) if not isinstance(seq, str) else seq.encode()
            used, length = used + 1, length + len(data)
            if used == 1:
                first = f"{name} {comment}" if comment else name
            for _, h in tool.each([data]):
                for x, n in zip(*np.unique(h, return_counts=True), strict=True):
                    counts[int(x)] = counts.get(int(x), 0) + int(n)
            best = sorted(x for x, n in counts.items() if n >= params.min_copies)[: params.sketch_size]
            if best and sum(counts[x] for x in best) / len(best) >= target:
                break
        comment = f"[{used} seqs] {first} [...]" if used > 1 else first
        file = pdf.sort_values("file_idx")["file"].iloc[0]
        return pd.DataFrame({"ref_idx": [pdf["ref_idx"].iloc[0]], "name": [file], "comment": [comment], "length": [length], "n": [len(best)], "max_hash": [best[-1] if best else None], "hashes": [best], "counts": [[counts[x] for x in best]]}).astype({"max_hash": "Int64"})

    return with_lengths(records.select("ref_idx", "file", "file_idx", "rec_no", "name", "comment", "seq").groupBy("ref_idx").applyInPandas(fold, SKETCH_SCHEMA), params)


def exploded(sketches: DataFrame, group: str = "ref_idx") -> DataFrame:
    """Postings of sketches."""
    rows = sketches.select(group, "counts", F.posexplode("hashes").alias("pos", "hash"))
    return rows.select(group, "hash", (F.col("pos") + 1).alias("rank"), F.try_element_at("counts", F.col("pos") + 1).alias("count"))


def truncated(sketches: DataFrame, size: int) -> DataFrame:
    """Sketches cut to ``size`` hashes: what sketching with that size gives."""
    rows = sketches.withColumns({"hashes": F.slice("hashes", 1, size), "counts": F.slice("counts", 1, size)})
    return rows.withColumns({"n": F.size("hashes").cast("long"), "max_hash": F.array_max("hashes")})


def merged(parts: list[DataFrame], params: SketchParams, group: str = "ref_idx") -> DataFrame:
    """Postings of the union of what each part's postings were made from: exact as long as ``min_copies`` is 1."""
    if params.min_copies > 1:
        raise ValueError("sketches that dropped rare k-mers can't be merged")
    rows = parts[0].select(group, "hash", "count")
    for p in parts[1:]:
        rows = rows.unionByName(p.select(group, "hash", "count"))
    return bottom(rows.groupBy(group, "hash").agg(F.sum("count").alias("count")), params, group)


def renamed(sketches: DataFrame, name: str | None = None, comment: str | None = None) -> DataFrame:
    """Another name or comment for the first sketch."""
    first = F.col("ref_idx") == 0
    out = sketches
    if name is not None:
        out = out.withColumn("name", F.when(first, F.lit(name)).otherwise(F.col("name")))
    if comment is not None:
        out = out.withColumn("comment", F.when(first, F.lit(comment)).otherwise(F.col("comment")))
    return out


def low_kmer_warning(sketches: DataFrame, params: SketchParams) -> DataFrame:
    """(n_flagged, longest, length, chance, min_kmer): sketches so long that random k-mer matches are likely; no row if there is none."""
    import math

    flagged = sketches.where(F.col("length") > params.max_safe_length)
    out = flagged.agg(F.count("*").alias("n_flagged"), F.max_by("name", F.struct("length", -F.col("ref_idx"))).alias("longest"), F.max("length").alias("length")).where("n_flagged > 0")
    chance = F.col("length") / (F.col("length") + F.lit(params.kmer_space))
    least = F.ceil(F.ln(F.col("length") * (1 - params.warning) / params.warning) / math.log(len(params.alphabet))).cast("int")
    return out.withColumn("chance", chance).withColumn("min_kmer", least)


def rows_of(sketches: DataFrame) -> Iterator:
    return sketches.orderBy("ref_idx").toLocalIterator()
