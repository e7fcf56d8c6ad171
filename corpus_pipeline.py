"""The corpus pipeline: rules, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.

Null ids and repeated rows: the rules judge each row; near-duplicate removal keeps rows with a null id, which no group
can name, and removes of a repeated id only the rows whose text is in the group; the other stages are as their operators say.  Empty tables pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmer.llm import bpe, mixing, quality, simhash, suffixes
from quillmer.llm.common import free_name, materialize, without
from quillmer.llm.queries import table, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    labels = table(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.shrunk_ratios(docs, labels.where("quality = 1").select("doc_id")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the rows of the document of smallest id."""
    name = free_name(docs, "fingerprint")
    groups = simhash.near_duplicates(docs, ids_are_nodes=False).withColumnRenamed("fingerprint", name)
    gone = materialize(groups.where("doc_id <> component_id").select("doc_id", name), "near-duplicates")
    return without(simhash.marked(docs, name), gone, ["doc_id", name]).drop(name)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stood earlier; ``n_chars`` follows."""
    out = suffixes.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def poisson_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in random order."""
    return mixing.replicated(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes decoded from them."""
    import public_tokenizers

    return bpe.digests(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", poisson_mixing),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: SQL has neither the hashed n-gram model nor BPE; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
