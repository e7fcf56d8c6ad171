"""Screening: which sketched references a mixture of sequences contains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hashed
from ..functions.kmers import is_protein, translated
from ..functions.stats import identity, within_p_value
from ..params import SketchParams
from ..plans import written
from .sketch import exploded


#: References' hashes that are sent to every task (8 bytes each); beyond it, all of the mixture's k-mers are shuffled.
WANTED_HASHES = 4 << 20


def wanted_hashes(refs: DataFrame):
    """A broadcast sorted array of the references' hashes, or None where they are too many."""
    n = refs.agg(F.sum("n")).first()[0] or 0
    if n > WANTED_HASHES:
        return None
    hashes = refs.select(F.explode("hashes").alias("hash")).distinct().toArrow()["hash"].to_numpy()
    return refs.sparkSession.sparkContext.broadcast(np.sort(hashes))


def mixture_counts(mixture: DataFrame, params: SketchParams, seq: str = "seq", refs: DataFrame | None = None) -> DataFrame:
    """(hash, count) of all k-mers of the mixture; nucleotides are read in six frames if the parameters are for protein.

    With ``refs`` only of those k-mers that a reference's sketch holds, and of the mixture's own smallest hashes, which
    tell its size: tasks drop all others before the shuffle.
    """
    rows = mixture.select(F.lit(0).alias("grp"), F.col(seq).alias("seq"))
    if is_protein(params):
        rows = translated(rows, "seq")
    limit, wanted = None, None
    if refs is not None and not mixture.isStreaming:
        wanted = wanted_hashes(refs)
        limit = None if wanted is None else params.sketch_size
    return hashed(rows, "grp", "seq", params, limit, wanted).groupBy("hash").agg(F.sum("count").alias("count"))


def set_size(counts: DataFrame, params: SketchParams) -> float:
    """Estimated number of distinct k-mers: from the mixture's own sketch."""
    row = counts.select("hash").orderBy("hash").limit(params.sketch_size).agg(F.count("*").alias("n"), F.max("hash").alias("top")).first()
    return 2.0**params.hash_bits * row["n"] / (row["top"] + params.hash_offset) if row["n"] else 0.0


def seen_postings(refs: DataFrame, counts: DataFrame) -> DataFrame:
    """(ref_idx, hash, depth): references' hashes that the mixture has."""
    return exploded(refs).select("ref_idx", "hash").join(counts.select("hash", F.col("count").alias("depth")), "hash")


def winners(seen: DataFrame, refs: DataFrame, params: SketchParams) -> DataFrame:
    """Each seen hash for one reference only: that of highest identity, then greatest length, then smallest index."""
    score = seen.groupBy("ref_idx").agg(F.count("*").alias("shared")).join(refs.select("ref_idx", "n", "length"), "ref_idx")
    score = score.select("ref_idx", "length", identity(F.col("shared"), F.col("n"), params.kmer).alias("score"))
    best = Window.partitionBy("hash").orderBy(F.desc("score"), F.desc("length"), "ref_idx")
    ranked = seen.join(score, "ref_idx").withColumn("place", F.row_number().over(best))
    return ranked.where("place = 1").select("ref_idx", "hash", "depth")


def screen(refs: DataFrame, mixture: DataFrame, params: SketchParams, winner_takes_all: bool = False, min_identity: float = 0.0, max_p_value: float = 1.0, seq: str = "seq", counts: DataFrame | None = None) -> DataFrame:
    """ref_idx, name, comment, identity, shared, size, median_multiplicity (upper), p_value.

    References without a shared hash are left out unless ``min_identity`` is negative.  The counts, which are needed
    twice, are written below the shared folder; pass ``counts`` to reuse others.
    """
    if counts is None:
        counts = written(mixture_counts(mixture, params, seq, refs), "mixture")
    size = set_size(counts, params)
    seen = seen_postings(refs, counts)
    if winner_takes_all:
        seen = winners(seen, refs, params)
    depth = F.array_sort(F.collect_list("depth"))  # a sketch's worth of values
    per_ref = seen.groupBy("ref_idx").agg(F.count("*").alias("shared"), depth.alias("depths"))
    per_ref = per_ref.select("ref_idx", "shared", F.element_at("depths", (F.floor(F.col("shared") / 2) + 1).cast("int")).alias("median_multiplicity"))
    about = refs.select("ref_idx", "name", "comment", F.col("n").alias("size"))
    out = about.join(per_ref, "ref_idx", "left" if min_identity < 0 else "inner").fillna(0, ["shared", "median_multiplicity"])
    out = out.withColumn("identity", identity(F.col("shared"), F.col("size"), params.kmer)).where(F.col("identity") >= min_identity)
    out = out.withColumn("p_value", within_p_value(F.col("shared"), F.col("size"), F.lit(size), params))
    if max_p_value < 1:
        out = out.where(F.col("p_value") <= max_p_value)
    return out.select("ref_idx", "name", "comment", "identity", "shared", "size", "median_multiplicity", "p_value")
