"""Taxonomy dumps: nodes, names, and which reference is which taxon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SEPARATOR = r"\t?\|\t?"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(tax_id, parent_id, rank) of ``id | parent | rank | ...`` lines."""
    part = F.split("value", _SEPARATOR)
    return spark.read.text(path).where("value <> ''").select(F.trim(part[0]).cast("long").alias("tax_id"), F.trim(part[1]).cast("long").alias("parent_id"), F.trim(part[2]).alias("rank"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(tax_id, name) of ``id | name | unique name | class |`` lines of class scientific name."""
    part = F.split("value", _SEPARATOR)
    rows = spark.read.text(path).where("value <> ''").select(F.trim(part[0]).cast("long").alias("tax_id"), F.trim(part[1]).alias("name"), F.trim(part[3]).alias("class"))
    return rows.where(F.col("class") == "scientific name").groupBy("tax_id").agg(F.max("name").alias("name"))


def read_taxonomy(spark: SparkSession, nodes_path: str, names_path: str) -> DataFrame:
    """(tax_id, parent_id, rank, name), parents as in the file."""
    return read_nodes(spark, nodes_path).join(read_names(spark, names_path), "tax_id", "left").select("tax_id", "parent_id", "rank", F.coalesce("name", F.lit("")).alias("name"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(tax_id, name) of lines with the id, one character, and the reference's name."""
    found = F.regexp_extract("value", r"^(\d+).(.*)$", 1)
    return spark.read.text(path).where(F.col("value").rlike(r"^\d+.")).select(found.cast("long").alias("tax_id"), F.regexp_extract("value", r"^(\d+).(.*)$", 2).alias("name"))
