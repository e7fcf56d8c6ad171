"""Sketching and screening of streams.

Bottom-s sketches without a minimum multiplicity merge exactly, so a stream is sketched batch by batch: each batch is
reduced to its own postings and merged into a stored table of at most ``sketch_size`` rows a group.  Hash counts of a
mixture are added up by a stateful aggregation restricted to hashes of the references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hashed
from ..operators.screen import wanted_hashes
from ..operators.sketch import bottom, exploded, hash_counts
from ..params import SketchParams
from ..plans import small


def sketch_stream(seqs: DataFrame, params: SketchParams, path: str, checkpoint: str, group: str = "ref_idx", seq: str = "seq"):
    """Keep the postings of a streaming ``seqs(group, seq)`` in ``path``, one version a batch; the started query.

    A batch that runs again after a failure writes the same version again, from the version before it.
    """
    if params.min_copies > 1:
        raise ValueError("sketches that drop rare k-mers can't be merged")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = hash_counts(batch, params, group, seq)
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v={number - 1}").select(group, "hash", "count"))
        total = rows.groupBy(group, "hash").agg(F.sum("count").alias("count"))
        bottom(total, params, group).write.mode("overwrite").parquet(f"{path}/v={number}")

    return seqs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def latest(spark, path: str) -> DataFrame:
    """The newest version of a stream's postings."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(F.max(F.regexp_extract("path", r"/v=(\d+)/", 1).cast("int")).alias("v"))
    return spark.read.parquet(f"{path}/v={names.first()['v']}")


def mixture_stream(seqs: DataFrame, refs: DataFrame, params: SketchParams, seq: str = "seq") -> DataFrame:
    """Streaming (hash, count) of a streaming mixture, of hashes that the references have: state is bounded by the references."""
    known = exploded(refs).select("hash").distinct()
    limit, wanted = None, wanted_hashes(refs)
    if wanted is not None:  # tasks drop all others but one, which the join drops
        limit = 1
    rows = hashed(seqs.select(F.lit(0).alias("grp"), F.col(seq).alias("seq")), "grp", "seq", params, limit, wanted)
    return rows.join(small(known), "hash", "left_semi").groupBy("hash").agg(F.sum("count").alias("count"))
