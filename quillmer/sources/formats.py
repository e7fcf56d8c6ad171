"""Text forms of results, one row a line, numbers with six significant digits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def general(x: Column) -> Column:
    """A double as ``%g`` prints it, also infinities."""
    rounded = F.format_string("%.5e", x)
    exponent = F.regexp_extract(rounded, r"e([+-]\d+)$", 1).cast("int")
    plain = F.when(exponent == 5, F.format_string("%.0f", x))
    for e in range(4, -5, -1):
        plain = plain.when(exponent == e, F.format_string(f"%.{5 - e}f", x))
    trim = lambda s: F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s)
    mantissa = trim(F.regexp_extract(rounded, r"^(.*)e", 1))
    scientific = F.concat(mantissa, F.lit("e"), F.regexp_extract(rounded, r"e([+-]\d+)$", 1))
    text = F.when((exponent < -4) | (exponent > 5), scientific).otherwise(trim(plain))
    return F.when(x.isNull(), "").when(F.isnan(x), "nan").when(x == math.inf, "inf").when(x == -math.inf, "-inf").when(x == 0, "0").otherwise(text)


def _line(*parts: Column) -> Column:
    return F.concat_ws("\t", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def dist_lines(pairs: DataFrame) -> DataFrame:
    line = _line(F.col("ref_name"), F.col("query_name"), general(F.col("distance")), general(F.col("p_value")), F.concat_ws("/", "common", "denom"))
    return pairs.orderBy("query", "ref").select(line.alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    line = _line(F.col("i_name"), F.col("j_name"), general(F.col("distance")), general(F.col("p_value")), F.concat_ws("/", "common", "denom"))
    return edges.orderBy("i", "j").select(line.alias("value"))


def triangle_lines(rows: DataFrame) -> DataFrame:
    """Lower-triangular Phylip: the number of rows first."""
    spark = rows.sparkSession
    n = rows.count()
    top = spark.createDataFrame([(-1, f"\t{n}")], "i long, value string")
    body = rows.select("i", F.concat_ws("\t", F.array(F.col("name")), F.transform("distances", general)).alias("value"))
    return top.unionByName(body).orderBy("i").select("value")


def screen_lines(rows: DataFrame) -> DataFrame:
    line = _line(general(F.col("identity")), F.concat_ws("/", "shared", "size"), F.col("median_multiplicity"), general(F.col("p_value")), F.col("name"), F.col("comment"))
    return rows.orderBy("ref_idx").select(line.alias("value"))


def report_lines(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    top = spark.createDataFrame([(0, "\t".join(["%", "hashes", "taxHashes", "hashesDB", "taxHashesDB", "rank", "taxID", "name"]))], "place int, value string")
    line = _line(F.format_string("%.4f", "percent"), F.col("seen"), F.col("tax_seen"), F.col("hashes"), F.col("tax_hashes"), F.col("rank"), F.col("tax_id"), F.concat(F.expr("repeat('  ', depth)"), F.col("name")))
    return top.unionByName(rows.select("place", line.alias("value"))).orderBy("place").select("value")


def histogram_lines(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ref_idx", "bin").select(_line(F.col("name"), F.col("bin"), F.col("frequency")).alias("value"))
