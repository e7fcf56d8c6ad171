"""Looking into sketch collections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unsigned
from ..params import SketchParams

_HASH_NAMES = {"murmur3": "MurmurHash3_x64_128", "md5_60": "MD5_60"}


def header(params: SketchParams, sketches: int) -> dict:
    return {"hash": _HASH_NAMES[params.hash_fn], "seed": params.seed, "kmer": params.kmer, "bits": params.hash_bits, "alphabet": params.alphabet, "canonical": params.canonical, "preserve_case": params.preserve_case, "sketch_size": params.sketch_size, "sketches": sketches}


def tabular(sketches: DataFrame) -> DataFrame:
    return sketches.select("ref_idx", F.col("n").alias("hashes"), "length", "name", "comment")


def histogram(sketches: DataFrame) -> DataFrame:
    """(ref_idx, name, bin, frequency): how many hashes of a sketch were counted ``bin`` times."""
    return sketches.select("ref_idx", "name", F.explode("counts").alias("bin")).groupBy("ref_idx", "name", "bin").agg(F.count("*").alias("frequency"))


def sketch_json(sketches: DataFrame, params: SketchParams, with_counts: bool | None = None) -> DataFrame:
    """(ref_idx, json): each sketch as an object with unsigned hashes."""
    fields = ["name", "length", "comment", F.transform("hashes", lambda h: unsigned(h, params)).alias("hashes")]
    if params.counts if with_counts is None else with_counts:
        fields.append("counts")
    return sketches.select("ref_idx", F.to_json(F.struct(*fields)).alias("json"))


def dump(sketches: DataFrame, params: SketchParams) -> str:
    """The whole collection as one JSON text, for collections that fit the driver."""
    head = {"kmer": params.kmer, "alphabet": params.alphabet, "preserveCase": params.preserve_case, "canonical": params.canonical, "sketchSize": params.sketch_size, "hashType": _HASH_NAMES[params.hash_fn], "hashBits": params.hash_bits, "hashSeed": params.seed}
    rows = sketch_json(sketches, params).orderBy("ref_idx").toLocalIterator()
    return json.dumps(head | {"sketches": [json.loads(r["json"]) for r in rows]}, indent=1)
