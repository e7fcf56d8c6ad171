"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source with ``size`` bytes of text and target weight ``w`` (weights add up to 1) is to be repeated
``rate = w * total / size`` times on average.  Each document is repeated by a Poisson number of that mean: the
inverse of the distribution at a number in [0, 1) hashed from seed and document id.  A large rate is the sum of
several Poissons of at most ``MAX_RATE``, each with its own hash.  Copies are dealt to partitions by a hash of seed,
id and copy number and sorted by it within each: the order by ``shuffle_key`` is a random one over the whole corpus.

Defined results: a null source is a source; a null id hashes as the word null; rows of one id are repeated alike; a
null or empty text has no bytes, and a source without any bytes gets rate 0; sources without a given weight get 0;
an empty table gives an empty result.  All columns are kept; ``rate``, ``replica`` and ``shuffle_key`` are added, and
columns that have these names (in whatever case) already get underscores at their names' end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, is_small, materialize

SEED = 17
#: Weights are in proportion to size ** (1 / TEMPERATURE) unless given.
TEMPERATURE = 2.0
MAX_RATE = 500.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, rate, parts, cdf): one row for each source, with the distribution of each of its ``parts`` Poissons."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    sizes = materialize(docs.select(F.col(f"`{source_col}`").alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "source-sizes")
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(1 / TEMPERATURE)))
    else:
        kind = sizes.schema["source"].dataType.simpleString()
        given = spark.createDataFrame(list(weights.items()), f"s {kind}, weight double") if weights else spark.createDataFrame([], f"s {kind}, weight double")
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "size", F.when(F.col("size") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0).alias("weight"))
    total = weighed.agg(F.sum("size").cast("double").alias("size"), F.sum("weight").alias("weight")).first()
    rate = F.when((F.col("size") > 0) & F.lit(bool(total["weight"])), F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit(total["size"] or 0.0) / F.col("size")).otherwise(0.0)
    parts = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / MAX_RATE)).cast("int")
    mean = F.col("rate") / F.col("parts")
    first = F.exp(-F.col("mean"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int"))
    grown = F.aggregate(
        steps,
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / k)).alias("cdf")),
    )
    return weighed.select("source", rate.alias("rate")).withColumn("parts", parts).withColumn("mean", mean).select("source", "rate", "parts", grown["cdf"].alias("cdf"))


def renamed(docs: DataFrame) -> dict[str, str]:
    """New names of columns that have a name of :func:`mixed`'s own."""
    return {c: free_name(docs, c) for c in docs.columns if c.lower() in ("rate", "replica", "shuffle_key")}


def replicated(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """:func:`mixed` with the columns of ``docs`` alone."""
    names = renamed(docs)
    return mixed(docs, weights, seed, id_col, source_col, text_col).select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its source's rate says, in global random order; adds rate, replica, shuffle_key."""
    docs = docs.withColumnsRenamed(renamed(docs))
    of, parts_, cdf, n = (free_name(docs, x) for x in ("source_of_rate", "poissons", "distribution", "copies"))
    table = materialize(rates(docs, weights, source_col, text_col), "rates").select(F.col("source").alias(of), "rate", F.col("parts").alias(parts_), F.col("cdf").alias(cdf))
    if is_small(table):
        table = F.broadcast(table)
    rows = docs.join(table, F.col(f"`{source_col}`").eqNullSafe(F.col(of)))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    number = F.aggregate(
        F.sequence(F.lit(0), F.col(parts_) - 1),
        F.lit(0),
        lambda acc, j: acc + F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), name, j.cast("string")))),
    )
    rows = rows.withColumn(n, number)
    copies = rows.withColumn("replica", F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1))))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), name, F.col("replica"))), 1, 15), 16, 10).cast("long")
    copies = copies.withColumn("shuffle_key", key).drop(of, parts_, cdf, n)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key", F.col(f"`{id_col}`"), "replica")


ORACLE = f"""
    WITH RECURSIVE s AS (SELECT source, sum(strlen(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
    w AS (SELECT source, size, pow(size, 0.5) AS weight FROM s),
    t AS (SELECT sum(size) AS size, sum(weight) AS weight FROM w),
    r AS (SELECT source, CASE WHEN w.size > 0 THEN w.weight / t.weight * t.size / w.size ELSE 0 END AS rate FROM w, t),
    m AS (SELECT source, rate, greatest(1, ceil(rate / {MAX_RATE}))::INT AS parts FROM r),
    c AS (
        SELECT source, rate, parts, rate / parts AS mean, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS cdf FROM m
        UNION ALL
        SELECT source, rate, parts, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c
        WHERE k < ceil(mean + 12 * sqrt(mean) + 30)
    ),
    d AS (
        SELECT doc_id, d.source, m.rate, j,
               ('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, 'null'), j::VARCHAR)), 1, 13))::BIGINT / pow(2, 52) AS u
        FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source, LATERAL (SELECT unnest(range(m.parts)) AS j)
    ),
    n AS (
        SELECT d.doc_id, any_value(d.rate) AS rate, count(*)::INT AS number
        FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u GROUP BY d.doc_id
    )
    SELECT doc_id, text, lang, source, n_chars, rate, replica,
           ('0x' || substr(md5(concat_ws(':', 'order{SEED}', doc_id::VARCHAR, replica::VARCHAR)), 1, 15))::BIGINT AS shuffle_key
    FROM (SELECT documents.*, n.rate, unnest(range(n.number))::INT AS replica FROM documents JOIN n USING (doc_id))
"""
