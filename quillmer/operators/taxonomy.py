"""Taxonomic screening: lowest common ancestors of seen hashes, summed up the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import written
from .sketch import exploded


def resolved(nodes: DataFrame) -> DataFrame:
    """(tax_id, parent_id, rank, name) with a null parent for roots: their own parents, and those whose parent is missing."""
    parents = nodes.select(F.col("tax_id").alias("parent_id"), F.lit(True).alias("known"))
    joined = nodes.join(parents, "parent_id", "left")
    parent = F.when(F.col("known") & (F.col("parent_id") != F.col("tax_id")), F.col("parent_id"))
    return joined.select("tax_id", parent.alias("parent_id"), "rank", "name")


def missing_parents(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent isn't in the tree."""
    ids = nodes.select(F.col("tax_id").alias("parent_id"))
    return nodes.join(ids, "parent_id", "left_anti").select("tax_id", "parent_id")


def closure(nodes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(tax_id, ancestor, up): each node's ancestors, itself at distance 0.  ``wanted(tax_id)`` restricts the nodes.

    One join for each level of the tree, each level written.
    """
    step = written(nodes.where("parent_id is not null").select(F.col("tax_id").alias("ancestor"), "parent_id"), "parents")
    start = nodes.select("tax_id")
    if wanted is not None:
        start = start.join(wanted.select("tax_id").distinct(), "tax_id", "left_semi")
    front = written(start.select("tax_id", F.col("tax_id").alias("ancestor"), F.lit(0).alias("up")), "level")
    levels = []
    while front.take(1):
        levels.append(front)
        front = written(front.join(step, "ancestor").select("tax_id", F.col("parent_id").alias("ancestor"), (F.col("up") + 1).alias("up")), "level")
    out = front
    for level in levels:
        out = out.unionByName(level)
    return out


def reference_taxa(refs: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """(ref_idx, tax_id): by name from ``mapping(tax_id, name)``, else the last "taxid N" in the comment, else 0."""
    spelled = F.element_at(F.regexp_extract_all("comment", F.lit(r"taxid[ |](\d+)"), F.lit(1)), -1)
    found = F.when(F.size(F.regexp_extract_all("comment", F.lit(r"taxid[ |](\d+)"), F.lit(1))) > 0, spelled.cast("long"))
    if mapping is None:
        return refs.select("ref_idx", F.coalesce(found, F.lit(0).cast("long")).alias("tax_id"))
    one = mapping.groupBy("name").agg(F.max("tax_id").alias("mapped"))
    return refs.join(one, "name", "left").select("ref_idx", F.coalesce("mapped", found, F.lit(0).cast("long")).alias("tax_id"))


def hash_taxa(refs: DataFrame, taxa: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hash, tax_id): the lowest common ancestor of the references that hold a hash.

    0 is neutral; an id that isn't in the tree stays as it is alone and gives 1 with any other.
    """
    held = written(exploded(refs).select("ref_idx", "hash").join(taxa, "ref_idx").select("hash", "tax_id").distinct(), "held")
    some = held.where("tax_id <> 0")
    line = closure(nodes, some)
    n = some.groupBy("hash").agg(F.count("*").alias("n"), F.min("tax_id").alias("only"))
    meets = some.join(line, "tax_id").groupBy("hash", "ancestor").agg(F.count("*").alias("k"), F.max("up").alias("far"))
    meets = meets.join(n, "hash").where("k = n").groupBy("hash").agg(F.min_by("ancestor", "far").alias("lca"))
    every = held.select("hash").distinct()
    out = every.join(n, "hash", "left").join(meets, "hash", "left")
    lca = F.when(F.col("n").isNull(), F.lit(0).cast("long")).when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("lca", F.lit(1).cast("long")))
    return out.select("hash", lca.alias("tax_id"))


def taxon_counts(taxa_of_hashes: DataFrame, counts: DataFrame, min_count: int = 1) -> DataFrame:
    """(tax_id, tax_hashes, tax_seen): hashes assigned to a taxon, and those of them that the mixture has."""
    seen = taxa_of_hashes.join(counts.select("hash", "count"), "hash", "left")
    return seen.groupBy("tax_id").agg(F.count("*").alias("tax_hashes"), F.count_if(F.col("count") >= min_count).alias("tax_seen"))


def report(taxa: DataFrame, nodes: DataFrame) -> DataFrame:
    """place, depth, percent, seen, tax_seen, hashes, tax_hashes, tax_id, rank, name of clades with a seen hash, in tree order.

    Percentages are of all seen hashes, also unassigned ones; siblings go by seen hashes, then id.
    """
    taxa, nodes = written(taxa, "taxa"), written(nodes, "nodes")
    line = closure(nodes, taxa)
    clades = taxa.join(line, "tax_id").groupBy(F.col("ancestor").alias("tax_id")).agg(F.sum("tax_seen").alias("seen"), F.sum("tax_hashes").alias("hashes"))
    total = taxa.agg(F.sum("tax_seen").alias("t")).first()["t"] or 0
    clades = clades.where("seen > 0").join(taxa, "tax_id", "left").fillna(0, ["tax_seen", "tax_hashes"])
    clades = written(clades, "clades")
    up = closure(nodes, clades).join(clades.select(F.col("tax_id").alias("ancestor"), F.col("seen").alias("s")), "ancestor")
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("down"), (-F.col("s")).alias("s"), F.col("ancestor").alias("a")))), lambda x: F.struct(x["s"], x["a"]))
    paths = up.groupBy("tax_id").agg(path.alias("path"))
    out = clades.join(paths, "tax_id").join(nodes.select("tax_id", "rank", "name"), "tax_id")
    out = out.withColumn("place", F.row_number().over(Window.orderBy("path")))  # a report: as many rows as seen clades
    return out.select("place", (F.size("path") - 1).alias("depth"), (100.0 * F.col("seen") / F.lit(float(total or 1))).alias("percent"), "seen", "tax_seen", "hashes", "tax_hashes", "tax_id", "rank", "name")
