"""K-mers as column expressions: normalised text, valid runs, windows, strands, translation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import AMINO_ACIDS, SketchParams

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Complements of the IUPAC nucleotide codes A..Z; letters that are no code become N.
COMPLEMENTS = "TVGHNNCDNNMNKNNNNYSAABWNRN"

#: The standard genetic code, first base slowest, bases in the order TCAG; * is stop.
BASES = "TCAG"
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codons() -> dict[str, str]:
    return {a + b + c: GENETIC_CODE[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def upper_ascii(seq: Column) -> Column:
    """a-z to A-Z and nothing else; ``upper`` would also change other letters, even their number."""
    return F.translate(seq, _LOWER, _UPPER)


def normalised(seq: Column, params: SketchParams) -> Column:
    return seq if params.preserve_case else upper_ascii(seq)


def complement(seq: Column) -> Column:
    return F.translate(seq, _UPPER, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def alphabet_class(params: SketchParams) -> str:
    return "[" + "".join(re.escape(c) for c in params.alphabet) + "]"


def valid_runs(seq: Column, params: SketchParams) -> Column:
    """Maximal stretches of letters of the alphabet that hold a k-mer: no valid window crosses their ends."""
    return F.regexp_extract_all(normalised(seq, params), F.lit(f"{alphabet_class(params)}{{{params.kmer},}}"), F.lit(0))


def windows(run: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - (k - 1)), lambda p: F.substring(run, p, F.lit(k)))


def with_kmers(df: DataFrame, seq: str, params: SketchParams, out: str = "kmer", canonical_form: bool | None = None) -> DataFrame:
    """One row for each valid k-mer of ``seq``; the other columns stay.  Sequences are cut to runs first, so a row never carries a long text."""
    keep = [c for c in df.columns if c != seq]
    runs = df.select(*keep, F.explode(valid_runs(F.col(seq), params)).alias("_run"))
    rows = runs.select(*keep, F.explode(windows(F.col("_run"), params.kmer)).alias(out))
    use = params.canonical if canonical_form is None else canonical_form
    return rows.withColumn(out, canonical(F.col(out))) if use else rows


def frames(seq: Column) -> Column:
    """The six reading frames of an upper-case nucleotide string as protein; stops and codons with other letters are ``*``."""
    table = F.create_map(*[F.lit(x) for pair in codons().items() for x in pair])

    def frame(strand: Column, start: int) -> Column:
        n = F.floor((F.length(strand) - start) / 3).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(table, F.substring(strand, (i * 3 + start + 1).cast("int"), F.lit(3))), F.lit("*")))
        return F.when(n > 0, F.array_join(parts, "")).otherwise("")

    back = reverse_complement(seq)
    return F.array(*(frame(strand, start) for strand in (seq, back) for start in range(3)))


def translated(df: DataFrame, seq: str) -> DataFrame:
    """Each row six times, its nucleotide ``seq`` replaced by one of the reading frames."""
    keep = [c for c in df.columns if c != seq]
    return df.withColumn("_upper", upper_ascii(F.col(seq))).select(*keep, F.explode(frames(F.col("_upper"))).alias(seq))


def is_protein(params: SketchParams) -> bool:
    return set(params.alphabet) == set(AMINO_ACIDS)
