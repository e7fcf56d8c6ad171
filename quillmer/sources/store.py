"""Sketch collections on disk: a Parquet table of sketches and one of parameters; binary sketch files are read too."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sketch import SKETCH_SCHEMA, truncated
from ..params import SketchParams
from ..plans import numbered
from . import binary

SUFFIX = ".sketches"


def is_binary(path: str) -> bool:
    return path.endswith(binary.SUFFIXES)


def is_collection(path: str) -> bool:
    """By its name: a folder that :func:`save` wrote, or a binary sketch file."""
    return path.rstrip("/").endswith(SUFFIX) or is_binary(path)


def default_path(first_input: str, output: str | None = None) -> str:
    """Where a collection goes: the output name given, or the first input's, with the suffix once."""
    base = output or ("stdin" if first_input == "-" else first_input)
    return base if base.endswith(SUFFIX) else base + SUFFIX


def save(sketches: DataFrame, params: SketchParams, path: str, overwrite: bool = True) -> None:
    """Write a collection; the counts go in only if the parameters keep them."""
    spark, mode = sketches.sparkSession, "overwrite" if overwrite else "errorifexists"
    kept = sketches if params.counts else sketches.withColumn("counts", F.array().cast("array<long>"))
    kept.select(*(c.split()[0] for c in SKETCH_SCHEMA.split(", "))).write.mode(mode).parquet(f"{path}/sketches")
    spark.createDataFrame([(json.dumps(params.to_dict()),)], "params string").coalesce(1).write.mode(mode).json(f"{path}/params")


def load_params(spark: SparkSession, path: str) -> SketchParams:
    if is_binary(path):
        return binary.read_params(path)[0]
    row = spark.read.schema("params string").json(f"{path}/params").first()
    if row is None:
        raise ValueError(f"{path} is not a sketch collection")
    return SketchParams(**json.loads(row["params"]))


def count(spark: SparkSession, path: str) -> int:
    """Number of sketches, from the files' footers."""
    if is_binary(path):
        return binary.read_params(path)[1]
    return spark.read.schema(SKETCH_SCHEMA).parquet(f"{path}/sketches").count()


def load(spark: SparkSession, path: str, params: SketchParams | None = None, allow_smaller: bool = False) -> tuple[DataFrame, SketchParams] | None:
    """A collection and its parameters; with ``params``, reduced to their sketch size, or None and a warning if it can't be compared."""
    own = load_params(spark, path)
    rows = binary.read_sketches(spark, path) if is_binary(path) else spark.read.schema(SKETCH_SCHEMA).parquet(f"{path}/sketches")
    if params is None:
        return rows, own
    if why := params.accepts(own, allow_smaller):
        warnings.warn(f"{path} is left out: {why}", stacklevel=2)
        return None
    return (truncated(rows, params.sketch_size) if own.sketch_size > params.sketch_size else rows), params


def union(parts: list[DataFrame]) -> DataFrame:
    """All sketches of several collections, in order, renumbered; duplicates stay."""
    out = None
    for i, part in enumerate(parts):
        rows = part.withColumn("_part", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("nothing to join")
    places = numbered(out.select("_part", "ref_idx"), "_place")  # keys only; a collection names a sketch once
    joined = out.join(places, ["_part", "ref_idx"]).withColumn("ref_idx", F.col("_place"))
    return joined.select(*(c for c in out.columns if c != "_part"))


def paste(spark: SparkSession, output: str, paths: list[str], allow_smaller: bool = False) -> SketchParams:
    """Join collections into a new one; the first sets the parameters, those that don't fit are left out with a warning.  An existing output is an error."""
    first = load_params(spark, paths[0])
    loaded = [load(spark, p, first, allow_smaller) for p in paths]
    save(union([x[0] for x in loaded if x]), first, default_path(output), overwrite=False)
    return first


def require_same_options(**given) -> None:
    """Options that a stored collection has settled can't be given with it."""
    wrong = sorted(k for k, v in given.items() if v is not None)
    if wrong:
        raise ValueError(f"with a stored collection these can't be given: {', '.join(wrong)}")
