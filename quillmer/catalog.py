"""The sketch engine's queries over the test tables, each with equivalent DuckDB SQL where SQL can express it.

Every query reads its whole tables.  Text is sketched over the letters A-Z and the space; "DNA" is spelled from MD5
digests of keys, so that both engines can make it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import streaming
from .functions import hashing, kmers, stats
from .functions.kmers import _LOWER, _UPPER, COMPLEMENTS
from .operators import compare, find, info, screen, sketch, taxonomy
from .params import AMINO_ACIDS, SketchParams
from .plans import shared_folder, written
from .sources import sequences, store

LETTERS = _UPPER + " "
TEXT = SketchParams(kmer=12, sketch_size=200, alphabet=LETTERS, canonical=False, hash_fn="md5_60", counts=True)
DNA = SketchParams(kmer=11, sketch_size=100, hash_fn="md5_60", counts=True)
PROTEIN = SketchParams(kmer=5, sketch_size=60, alphabet=AMINO_ACIDS, canonical=False, hash_fn="md5_60", counts=True)
MURMUR = SketchParams(kmer=12, sketch_size=1000, alphabet=LETTERS, canonical=False, counts=True)
MURMUR_DNA = SketchParams(kmer=21, sketch_size=1000, counts=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs in both engines


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("ref_idx"), F.col("text").alias("seq"), "source")


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("ref_idx"), F.col("text").alias("seq"))


def by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("ref_idx"), F.col("text").alias("seq"))


def dna(key: Column, parts: str = "abcdef") -> Column:
    return F.translate(F.concat(*(F.md5(F.concat(F.lit(p), key.cast("string"))) for p in parts)), "0123456789abcdef", "ACGTACGTACGTACGT")


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Five customers in a row spell the same letters but for the sixth part, so that nations share k-mers."""
    c = table(spark, d, "customer")
    seq = F.concat(dna(F.floor(F.col("c_custkey") / 5).cast("long"), "abcde"), dna(F.col("c_custkey"), "f"))
    return c.select("c_custkey", F.col("c_nationkey").cast("long").alias("ref_idx"), seq.alias("seq"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("ref_idx"), dna(F.col("s_suppkey")).alias("seq"))


def sql_dna(key: str, parts: str = "abcdef") -> str:
    return "translate(" + " || ".join(f"md5('{p}' || ({key})::VARCHAR)" for p in parts) + ", '0123456789abcdef', 'ACGTACGTACGTACGT')"


SQL_DOCUMENTS = "SELECT doc_id AS ref_idx, text AS seq FROM documents"
SQL_BENCHMARK = "SELECT item_id AS ref_idx, text AS seq FROM benchmark"
SQL_BY_SOURCE = "SELECT regexp_extract(source, '(\\d+)$', 1)::BIGINT AS ref_idx, text AS seq FROM documents"
SQL_CUSTOMERS = f"SELECT c_custkey, c_nationkey::BIGINT AS ref_idx, {sql_dna('c_custkey // 5', 'abcde')} || {sql_dna('c_custkey', 'f')} AS seq FROM customer"
SQL_SUPPLIERS = f"SELECT s_suppkey, s_nationkey::BIGINT AS ref_idx, {sql_dna('s_suppkey')} AS seq FROM supplier"


def sql_kmers(name: str, seqs: str, p: SketchParams) -> str:
    """CTEs ``{name}_seqs``, ``{name}_runs``, ``{name}_kmers``."""
    kmer = f"least(kmer, reverse(translate(kmer, '{_UPPER}', '{COMPLEMENTS}')))" if p.canonical else "kmer"
    return f"""
    {name}_seqs AS ({seqs}),
    {name}_runs AS (
        SELECT ref_idx, unnest(regexp_extract_all(translate(seq, '{_LOWER}', '{_UPPER}'), '[{p.alphabet}]{{{p.kmer},}}')) AS run FROM {name}_seqs
    ),
    {name}_kmers AS (
        SELECT ref_idx, {kmer} AS kmer FROM (
            SELECT ref_idx, substr(run, pos, {p.kmer}) AS kmer FROM (SELECT ref_idx, run, unnest(range(1, length(run) - {p.kmer} + 2)) AS pos FROM {name}_runs)
        )
    )"""


def sql_postings(name: str, seqs: str, p: SketchParams) -> str:
    """CTEs up to ``{name}`` (ref_idx, hash, rank, count) and ``{name}_meta`` (ref_idx, n, top)."""
    return f"""{sql_kmers(name, seqs, p)},
    {name}_counts AS (SELECT ref_idx, ('0x' || substr(md5(kmer), 1, 15))::BIGINT AS hash, count(*) AS count FROM {name}_kmers GROUP BY ref_idx, kmer),
    {name} AS (
        SELECT * FROM (
            SELECT ref_idx, hash, count, row_number() OVER (PARTITION BY ref_idx ORDER BY hash) AS rank FROM {name}_counts WHERE count >= {p.min_copies}
        ) WHERE rank <= {p.sketch_size}
    ),
    {name}_meta AS (
        SELECT s.ref_idx, coalesce(any_value(m.n), 0) AS n, any_value(m.top) AS top, sum(CASE WHEN strlen(s.seq) >= {p.kmer} THEN strlen(s.seq) ELSE 0 END)::BIGINT AS length
        FROM {name}_seqs s LEFT JOIN (SELECT ref_idx, count(*) AS n, max(hash) AS top FROM {name} GROUP BY ref_idx) m USING (ref_idx) GROUP BY s.ref_idx
    )"""


def sketches(seqs: DataFrame, p: SketchParams) -> DataFrame:
    """Sketches named after their numbers."""
    rows = sketch.gathered(seqs, p)
    return written(sketch.sized(rows.select("ref_idx", F.concat(F.lit("ref"), F.col("ref_idx")).alias("name"), F.lit("").alias("comment"), "length", "hashes", "counts")), "sketches")


def sql_distance(k: int) -> str:
    return f"CASE WHEN common = denom THEN 0.0 WHEN common = 0 THEN 1.0 ELSE least(1.0, -ln(2.0 * (common::DOUBLE / denom) / (1.0 + common::DOUBLE / denom)) / {k}) END"


def sql_pairs(a: str, b: str, p: SketchParams, on: str = "", every: bool = False) -> str:
    """CTE ``pairs`` (ref, query, common, denom, distance, ref_length, query_length)."""
    hits = f"""
    ranked AS (
        SELECT x.ref_idx AS ref, y.ref_idx AS query, x.rank + y.rank - row_number() OVER (PARTITION BY x.ref_idx, y.ref_idx ORDER BY x.hash) AS place
        FROM {a} x JOIN {b} y ON x.hash = y.hash {on}
    ),
    hits AS (SELECT ref, query, count(*) AS shared, count(*) FILTER (WHERE place <= {p.sketch_size}) AS common FROM ranked GROUP BY ref, query),
    """
    condition = on.replace("x.ref_idx", "r.ref_idx").replace("y.ref_idx", "q.ref_idx").replace("AND ", "", 1) or "true"
    source = f"{a}_meta r JOIN {b}_meta q ON {condition} LEFT JOIN hits h ON h.ref = r.ref_idx AND h.query = q.ref_idx" if every else f"hits h JOIN {a}_meta r ON h.ref = r.ref_idx JOIN {b}_meta q ON h.query = q.ref_idx"
    return f"""{hits}
    measured AS (
        SELECT r.ref_idx AS ref, q.ref_idx AS query, coalesce(common, 0) AS common, least({p.sketch_size}, r.n + q.n - coalesce(shared, 0)) AS denom,
               r.length AS ref_length, q.length AS query_length
        FROM {source}
    ),
    pairs AS (SELECT *, {sql_distance(p.kmer)} AS distance FROM measured)"""


def sql_tail(x: str, n: str, p: str) -> str:
    """log10 of P[Binomial(n, p) >= x] for x > 0."""
    term = f"lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})"
    top = f"list_max(list_transform(range({x}, {n} + 1), lambda i: {term}))"
    return f"({top} + ln(list_sum(list_transform(range({x}, {n} + 1), lambda i: exp({term} - {top}))))) / ln(10)"


def _log10(x: Column) -> Column:
    return F.round(F.log10(x), 5)


# ---- queries


def kmer_valid_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = documents(spark, d).select("ref_idx", kmers.valid_runs(F.col("seq"), TEXT).alias("runs"))
    return runs.select(F.col("ref_idx").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + F.length(r)).alias("letters"))


def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    alone, rest = sketch.by_rows(documents(spark, d).select("ref_idx", "seq"), "ref_idx")
    parts = []
    if alone is not None:  # counted where they are read
        parts.append(hashing.kmer_totals(alone, "ref_idx", "seq", TEXT))
    if rest is not None:
        per = kmers.with_kmers(rest, "seq", TEXT).groupBy("ref_idx", "kmer").agg(F.count("*").alias("n"))
        parts.append(per.groupBy("ref_idx").agg(F.sum("n").alias("n_kmers"), F.count("*").alias("n_distinct"), F.max("n").alias("most")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumnRenamed("ref_idx", "doc_id")


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select("c_custkey", "seq", kmers.reverse_complement(F.col("seq")).alias("reverse_complement"))


def canonical_kmers(spark: SparkSession, d: str) -> DataFrame:
    rows = kmers.with_kmers(customers(spark, d).select("seq"), "seq", DNA.with_(kmer=7))
    return rows.groupBy("kmer").agg(F.count("*").alias("n"))


def sketch_bottom_s(spark: SparkSession, d: str) -> DataFrame:
    return sketch.postings(documents(spark, d), TEXT).select(F.col("ref_idx").alias("doc_id"), "hash", F.col("rank").cast("long").alias("rank"), "count")


def sketch_min_copies(spark: SparkSession, d: str) -> DataFrame:
    return sketch.postings(documents(spark, d), TEXT.with_(min_copies=2)).select(F.col("ref_idx").alias("doc_id"), "hash", F.col("rank").cast("long").alias("rank"), "count")


def sketch_by_group(spark: SparkSession, d: str) -> DataFrame:
    return sketch.postings(by_source(spark, d), TEXT).select(F.col("ref_idx").alias("source_no"), "hash", F.col("rank").cast("long").alias("rank"), "count")


def sketch_canonical_dna(spark: SparkSession, d: str) -> DataFrame:
    return sketch.postings(customers(spark, d), DNA).select(F.col("ref_idx").alias("nation"), "hash", F.col("rank").cast("long").alias("rank"), "count")


def sketch_cardinality(spark: SparkSession, d: str) -> DataFrame:
    per = sketch.postings(documents(spark, d), TEXT).groupBy(F.col("ref_idx").alias("doc_id")).agg(F.count("*").alias("n"), F.max("hash").alias("top"), F.round(F.avg("count"), 9).alias("coverage"))
    return per.select("doc_id", F.round(stats.cardinality(F.col("n"), F.col("top"), TEXT), 3).alias("distinct_kmers"), "coverage")


def sketch_merged(spark: SparkSession, d: str) -> DataFrame:
    """Sketches by source, merged from those of each language's documents."""
    docs = table(spark, d, "documents").select("lang", F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("ref_idx"), F.col("text").alias("seq"))
    parts = [sketch.postings(docs.where(which), TEXT) for which in ("lang = 'en'", "coalesce(lang, '') <> 'en'")]
    return sketch.merged(parts, TEXT).select(F.col("ref_idx").alias("source_no"), "hash", F.col("rank").cast("long").alias("rank"), "count")


def genome_length(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of read sets as their sketches tell them: all documents of a source."""
    p = TEXT.with_(reads=True)
    return sketch.with_lengths(sketches(by_source(spark, d), p), p).select("ref_idx", "length")


def dist_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = compare.dist(sketches(documents(spark, d), TEXT), sketches(benchmark(spark, d), TEXT), TEXT, p_values=False)
    return out.select("ref", "query", "common", "denom", F.round("distance", 9).alias("distance"))


def dist_filtered(spark: SparkSession, d: str) -> DataFrame:
    out = compare.dist(sketches(documents(spark, d), TEXT), sketches(benchmark(spark, d), TEXT), TEXT, max_distance=0.25, p_values=False)
    return out.select("ref", "query", "common", "denom", F.round("distance", 9).alias("distance"))


def dist_pvalue(spark: SparkSession, d: str) -> DataFrame:
    p = DNA.with_(kmer=9)
    s = sketches(customers(spark, d), p)
    out = compare.dist(s, sketches(suppliers(spark, d), p), p, max_distance=0.99)
    return out.select("ref", "query", "common", "denom", _log10(F.col("p_value")).alias("log10_p"))


def dist_p_filtered(spark: SparkSession, d: str) -> DataFrame:
    p = DNA.with_(kmer=9)
    out = compare.dist(sketches(customers(spark, d), p), sketches(suppliers(spark, d), p), p, max_distance=0.99, max_p_value=0.05)
    return out.select("ref", "query", "common", "denom")


def dist_table(spark: SparkSession, d: str) -> DataFrame:
    refs, queries = sketches(by_source(spark, d), TEXT), sketches(benchmark(spark, d), TEXT)
    out = compare.dist_table(compare.dist(refs, queries, TEXT, p_values=False), refs)
    return out.select("query", *(F.round(f"`{c}`", 9).alias(f"source_{c}") for c in out.columns if c.isdigit()))


def triangle_edges(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate documents."""
    out = compare.triangle(sketches(documents(spark, d), TEXT), TEXT, max_distance=0.2, p_values=False)
    return out.select("i", "j", "common", "denom", F.round("distance", 9).alias("distance"))


def triangle_rows(spark: SparkSession, d: str) -> DataFrame:
    s = sketches(by_source(spark, d), TEXT)
    rows = compare.triangle_rows(compare.triangle(s, TEXT, p_values=False), s)
    text = F.array_join(F.transform("distances", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")
    return rows.select("i", "name", F.size("distances").cast("long").alias("n"), text.alias("distances"))


def within_containment(spark: SparkSession, d: str) -> DataFrame:
    out = compare.within(sketches(documents(spark, d), TEXT), sketches(benchmark(spark, d), TEXT), TEXT, max_error=0.2)
    return out.select("ref", "query", F.round("score", 9).alias("score"), F.round("error", 9).alias("error"))


def _screened(spark: SparkSession, d: str, winner: bool) -> DataFrame:
    out = screen.screen(sketches(benchmark(spark, d), TEXT), documents(spark, d), TEXT, winner_takes_all=winner)
    return out.select(F.col("ref_idx").alias("item_id"), F.round("identity", 9).alias("identity"), "shared", "size", "median_multiplicity")


def screen_containment(spark: SparkSession, d: str) -> DataFrame:
    return _screened(spark, d, False)


def screen_winner(spark: SparkSession, d: str) -> DataFrame:
    return _screened(spark, d, True)


def screen_identity(spark: SparkSession, d: str) -> DataFrame:
    """Items that the documents hold nearly whole."""
    out = screen.screen(sketches(benchmark(spark, d), TEXT), documents(spark, d), TEXT, min_identity=0.95)
    return out.select(F.col("ref_idx").alias("item_id"), F.round("identity", 9).alias("identity"), "shared", "size", "median_multiplicity")


def screen_pvalue(spark: SparkSession, d: str) -> DataFrame:
    p = DNA.with_(kmer=9)
    out = screen.screen(sketches(customers(spark, d), p), suppliers(spark, d), p)
    return out.select(F.col("ref_idx").alias("nation"), "shared", "size", _log10(F.col("p_value")).alias("log10_p"))


def proteins(spark: SparkSession, d: str) -> DataFrame:
    """First forward frame of each supplier's letters."""
    return suppliers(spark, d).select("ref_idx", kmers.frames(F.col("seq"))[0].alias("seq"))


def screen_protein(spark: SparkSession, d: str) -> DataFrame:
    out = screen.screen(sketches(proteins(spark, d), PROTEIN), suppliers(spark, d), PROTEIN)
    return out.select(F.col("ref_idx").alias("nation"), F.round("identity", 9).alias("identity"), "shared", "size", "median_multiplicity")


def translation(spark: SparkSession, d: str) -> DataFrame:
    return suppliers(spark, d).select("s_suppkey", F.posexplode(kmers.frames(F.col("seq"))).alias("frame", "protein"))


def taxonomy_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Root 1, regions 10 + key, nations 100 + key."""
    root = spark.createDataFrame([(1, 1, "no rank", "root")], "tax_id long, parent_id long, rank string, name string")
    regions = table(spark, d, "region").select((F.col("r_regionkey") + 10).cast("long").alias("tax_id"), F.lit(1).cast("long").alias("parent_id"), F.lit("region").alias("rank"), F.col("r_name").alias("name"))
    nations = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("tax_id"), (F.col("n_regionkey") + 10).cast("long").alias("parent_id"), F.lit("nation").alias("rank"), F.col("n_name").alias("name"))
    return taxonomy.resolved(root.unionByName(regions).unionByName(nations))


def _lca(spark: SparkSession, d: str) -> DataFrame:
    refs = sketches(customers(spark, d), DNA)
    mapping = refs.select((F.col("ref_idx") + 100).alias("tax_id"), "name")
    return taxonomy.hash_taxa(refs, taxonomy.reference_taxa(refs, mapping), taxonomy_nodes(spark, d))


def tax_lca(spark: SparkSession, d: str) -> DataFrame:
    return _lca(spark, d)


def _report(spark: SparkSession, d: str, mixture: DataFrame) -> DataFrame:
    counts = screen.mixture_counts(mixture, DNA, refs=sketches(customers(spark, d), DNA))
    taxa = taxonomy.taxon_counts(_lca(spark, d), counts)
    out = taxonomy.report(taxa, taxonomy_nodes(spark, d))
    return out.select("place", "depth", F.round("percent", 6).alias("percent"), "seen", "tax_seen", "hashes", "tax_hashes", "tax_id", "rank", "name")


def tax_report(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: all suppliers, whose letters are in part those of customers."""
    return _report(spark, d, suppliers(spark, d))


def info_tabular(spark: SparkSession, d: str) -> DataFrame:
    return info.tabular(sketches(documents(spark, d), TEXT)).select("ref_idx", "hashes", "length", "name")


def info_histogram(spark: SparkSession, d: str) -> DataFrame:
    return info.histogram(sketches(by_source(spark, d), TEXT)).select("name", "bin", "frequency")


def paste_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Two collections joined at the smaller sketch size, duplicates and all."""
    a = sketches(benchmark(spark, d), TEXT.with_(sketch_size=50))
    b = sketch.truncated(sketches(by_source(spark, d), TEXT), 50)
    both = store.union([a, b])
    return sketch.exploded(both).join(both.select("ref_idx", "name"), "ref_idx").select("ref_idx", "name", "hash", F.col("rank").cast("long").alias("rank"), "count")


def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A collection saved, loaded again and reduced to a smaller size."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    store.save(sketches(by_source(spark, d), TEXT), TEXT, path)
    rows, _ = store.load(spark, path, TEXT.with_(sketch_size=30))
    return sketch.exploded(rows).select("ref_idx", "hash", F.col("rank").cast("long").alias("rank"), "count")


def low_k_warning(spark: SparkSession, d: str) -> DataFrame:
    p = TEXT.with_(kmer=4)
    return sketch.low_kmer_warning(sketches(by_source(spark, d), p), p).select("n_flagged", "longest", "length", F.round("chance", 9).alias("chance"), F.col("min_kmer").cast("long").alias("min_kmer"))


def sketch_comments(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as files and turns as records: name, composed comment and length of each sketch."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("ref_idx"), F.col("turn").alias("order"), F.concat(F.lit("turn"), F.col("turn")).alias("name"), F.col("role").alias("comment"), F.col("text").alias("seq"))
    return sketch.record_comments(turns, TEXT).select("ref_idx", "comment", "records", "total_length")


def fastx_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers' letters written as FASTA and read back."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = customers(spark, d).select(F.concat(F.lit("c"), F.col("c_custkey")).alias("name"), F.concat(F.lit("nation "), F.col("ref_idx")).alias("comment"), "seq")
    sequences.write_fasta(rows, path)
    return sequences.read_sequences(spark, [path]).select("name", "comment", F.col("seq").cast("string").alias("seq"))


def streaming_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the references' hashes in the documents, read as a stream."""
    refs = sketches(benchmark(spark, d), TEXT)
    rows = spark.readStream.schema(table(spark, d, "documents").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parque[t]")  # a pattern, as the table may be one file
    name = f"mixture_{uuid.uuid4().hex}"
    counts = streaming.mixture_stream(rows.select(F.col("text").alias("seq")), refs, TEXT)
    query = counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{shared_folder(spark)}/{name}").start()
    query.awaitTermination()
    return spark.table(name).select("hash", "count")


def sketch_murmur(spark: SparkSession, d: str) -> DataFrame:
    return sketch.postings(documents(spark, d), MURMUR).select(F.col("ref_idx").alias("doc_id"), "hash", "rank", "count")


def dist_murmur(spark: SparkSession, d: str) -> DataFrame:
    s = sketches(documents(spark, d), MURMUR)
    return compare.triangle(s, MURMUR, max_distance=0.2)


def screen_murmur(spark: SparkSession, d: str) -> DataFrame:
    return screen.screen(sketches(benchmark(spark, d), MURMUR), documents(spark, d), MURMUR)


def bounds_table(spark: SparkSession, d: str) -> DataFrame:
    return stats.bounds(spark)


def find_minmers(spark: SparkSession, d: str) -> DataFrame:
    return find.minmers(customers(spark, d).select(F.col("c_custkey").alias("ref_idx"), "seq"), MURMUR_DNA.with_(kmer=15), window=20, size=2)


def _hits(spark: SparkSession, d: str, best: int) -> DataFrame:
    refs = documents(spark, d).select("ref_idx", F.concat(F.lit("doc"), F.col("ref_idx")).alias("name"), "seq")
    asked = benchmark(spark, d).select(F.col("ref_idx").alias("query"), F.concat(F.lit("item"), F.col("ref_idx")).alias("name"), "seq")
    return find.find(refs, asked, MURMUR.with_(kmer=16, sketch_size=1000), window=50, minmers_per_window=4, threshold=0.05, best=best)


def find_hits(spark: SparkSession, d: str) -> DataFrame:
    """The best ten hits of each passage."""
    return _hits(spark, d, 10)


def find_hits_all(spark: SparkSession, d: str) -> DataFrame:
    """Every hit of each passage, as the operator's default."""
    return _hits(spark, d, 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        kmer_valid_runs, kmer_counts, revcomp, canonical_kmers, sketch_bottom_s, sketch_min_copies, sketch_by_group, sketch_canonical_dna, sketch_cardinality,
        sketch_merged, genome_length, dist_pairs, dist_filtered, dist_p_filtered, dist_pvalue, dist_table, triangle_edges, triangle_rows, within_containment, screen_containment, screen_winner, screen_identity, screen_pvalue,
        screen_protein, translation, tax_lca, tax_report, info_tabular, info_histogram, paste_truncate, store_round_trip, low_k_warning, sketch_comments,
        fastx_records, streaming_mixture, sketch_murmur, dist_murmur, screen_murmur, bounds_table, find_minmers, find_hits, find_hits_all,
    )
}


# ---- the same in DuckDB's SQL


def _sketch_sql(seqs: str, p: SketchParams, name: str) -> str:
    return f"WITH {sql_postings('a', seqs, p)} SELECT ref_idx AS {name}, hash, rank, count FROM a"


_PAIRS = f"WITH {sql_postings('a', SQL_DOCUMENTS, TEXT)}, {sql_postings('b', SQL_BENCHMARK, TEXT)}, "
_SOURCES = f"WITH {sql_postings('a', SQL_BY_SOURCE, TEXT)}"
_P9 = DNA.with_(kmer=9)


def _screen_sql(winner: bool) -> str:
    credited = """
    scored AS (SELECT a.ref_idx, count(*) AS shared FROM a JOIN mix USING (hash) GROUP BY a.ref_idx),
    rated AS (SELECT s.ref_idx, m.length, CASE WHEN shared = n THEN 1.0 ELSE pow(shared::DOUBLE / n, 1.0 / {k}) END AS score FROM scored s JOIN a_meta m USING (ref_idx)),
    seen AS (
        SELECT ref_idx, depth FROM (
            SELECT a.ref_idx, mix.n AS depth, row_number() OVER (PARTITION BY hash ORDER BY score DESC, length DESC, a.ref_idx) AS place
            FROM a JOIN mix USING (hash) JOIN rated USING (ref_idx)
        ) WHERE place = 1
    )""".format(k=TEXT.kmer)
    plain = "seen AS (SELECT a.ref_idx, mix.n AS depth FROM a JOIN mix USING (hash))"
    return f"""
    WITH {sql_postings('a', SQL_BENCHMARK, TEXT)}, {sql_kmers('m', SQL_DOCUMENTS, TEXT)},
    mix AS (SELECT ('0x' || substr(md5(kmer), 1, 15))::BIGINT AS hash, sum(n)::BIGINT AS n FROM (SELECT kmer, count(*) AS n FROM m_kmers GROUP BY kmer) GROUP BY 1),
    {credited if winner else plain},
    per AS (SELECT ref_idx, count(*) AS shared, list_sort(list(depth)) AS depths FROM seen GROUP BY ref_idx)
    SELECT per.ref_idx AS item_id, round(CASE WHEN shared = n THEN 1.0 ELSE pow(shared::DOUBLE / n, 1.0 / {TEXT.kmer}) END, 9) AS identity, shared, n AS size, depths[shared // 2 + 1] AS median_multiplicity
    FROM per JOIN a_meta USING (ref_idx)
    """


def _frames_sql(source: str) -> str:
    """CTE ``frames`` (s_suppkey, ref_idx, frame, protein) of ``source`` (s_suppkey, ref_idx, seq)."""
    table_ = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in kmers.codons().items()) + "}"
    return f"""
    strands AS (
        SELECT s_suppkey, ref_idx, 0 AS back, seq AS s FROM ({source})
        UNION ALL SELECT s_suppkey, ref_idx, 1, reverse(translate(seq, '{_UPPER}', '{COMPLEMENTS}')) FROM ({source})
    ),
    frames AS (
        SELECT s_suppkey, ref_idx, 3 * back + f AS frame,
               list_aggregate(list_transform(range(0, (length(s) - f) // 3), lambda i: coalesce(({table_})[substr(s, 3 * i + f + 1, 3)], '*')), 'string_agg', '') AS protein
        FROM strands, (SELECT unnest(range(3)) AS f)
    )"""


_PROTEIN_SEQS = "SELECT ref_idx, protein AS seq FROM frames WHERE frame = 0"
_TREE = """
    nodes AS (
        SELECT 1 AS tax_id, NULL::BIGINT AS parent_id, 'no rank' AS rank, 'root' AS name
        UNION ALL SELECT r_regionkey + 10, 1, 'region', r_name FROM region
        UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'nation', n_name FROM nation
    ),
    line AS (
        SELECT tax_id, tax_id AS ancestor, 0 AS up FROM nodes
        UNION ALL SELECT l.tax_id, n.parent_id, l.up + 1 FROM line l JOIN nodes n ON n.tax_id = l.ancestor WHERE n.parent_id IS NOT NULL
    ),
    held AS (SELECT DISTINCT hash, ref_idx + 100 AS tax_id FROM a),
    lca AS (
        SELECT hash, arg_min(ancestor, far) AS tax_id FROM (
            SELECT hash, ancestor, max(up) AS far, count(*) AS k, any_value(n) AS n
            FROM held JOIN line USING (tax_id) JOIN (SELECT hash, count(*) AS n FROM held GROUP BY hash) USING (hash) GROUP BY hash, ancestor
        ) WHERE k = n GROUP BY hash
    )"""

ORACLES: dict[str, str] = {
    "kmer_valid_runs": f"""
        SELECT doc_id, len(runs) AS n_runs, coalesce(list_sum(list_transform(runs, lambda r: length(r))), 0)::BIGINT AS letters
        FROM (SELECT doc_id, regexp_extract_all(translate(text, '{_LOWER}', '{_UPPER}'), '[{TEXT.alphabet}]{{{TEXT.kmer},}}') AS runs FROM documents)
    """,
    "kmer_counts": f"""
        WITH {sql_kmers('a', SQL_DOCUMENTS, TEXT)}
        SELECT ref_idx AS doc_id, sum(n)::BIGINT AS n_kmers, count(*) AS n_distinct, max(n) AS most FROM (SELECT ref_idx, kmer, count(*) AS n FROM a_kmers GROUP BY ALL) GROUP BY ref_idx
    """,
    "revcomp": f"SELECT c_custkey, seq, reverse(translate(seq, '{_UPPER}', '{COMPLEMENTS}')) AS reverse_complement FROM ({SQL_CUSTOMERS})",
    "canonical_kmers": f"WITH {sql_kmers('a', SQL_CUSTOMERS, DNA.with_(kmer=7))} SELECT kmer, count(*) AS n FROM a_kmers GROUP BY kmer",
    "sketch_bottom_s": _sketch_sql(SQL_DOCUMENTS, TEXT, "doc_id"),
    "sketch_min_copies": _sketch_sql(SQL_DOCUMENTS, TEXT.with_(min_copies=2), "doc_id"),
    "sketch_by_group": _sketch_sql(SQL_BY_SOURCE, TEXT, "source_no"),
    "sketch_canonical_dna": _sketch_sql(SQL_CUSTOMERS, DNA, "nation"),
    "sketch_cardinality": f"""
        WITH {sql_postings('a', SQL_DOCUMENTS, TEXT)}
        SELECT ref_idx AS doc_id, round(pow(2, 60) * count(*) / max(hash), 3) AS distinct_kmers, round(avg(count), 9) AS coverage FROM a GROUP BY ref_idx
    """,
    "dist_pairs": _PAIRS + sql_pairs("a", "b", TEXT, every=True) + " SELECT ref, query, common, denom, round(distance, 9) AS distance FROM pairs",
    "dist_filtered": _PAIRS + sql_pairs("a", "b", TEXT) + " SELECT ref, query, common, denom, round(distance, 9) AS distance FROM pairs WHERE distance <= 0.25",
    "dist_pvalue": f"""
        WITH {sql_postings('a', SQL_CUSTOMERS, _P9)}, {sql_postings('b', SQL_SUPPLIERS, _P9)}, {sql_pairs('a', 'b', _P9)},
        c AS (SELECT *, 1 / (1 + {_P9.kmer_space} / ref_length) AS pa, 1 / (1 + {_P9.kmer_space} / query_length) AS pb FROM pairs WHERE distance <= 0.99 AND common > 0),
        r AS (SELECT *, pa * pb / (pa + pb - pa * pb) AS p FROM c)
        SELECT ref, query, common, denom, round({sql_tail('common', 'denom', 'p')}, 5) AS log10_p FROM r
    """,
    "dist_p_filtered": f"""
        WITH {sql_postings('a', SQL_CUSTOMERS, _P9)}, {sql_postings('b', SQL_SUPPLIERS, _P9)}, {sql_pairs('a', 'b', _P9)},
        c AS (SELECT *, 1 / (1 + {_P9.kmer_space} / ref_length) AS pa, 1 / (1 + {_P9.kmer_space} / query_length) AS pb FROM pairs WHERE distance <= 0.99 AND common > 0),
        r AS (SELECT *, pa * pb / (pa + pb - pa * pb) AS p FROM c)
        SELECT ref, query, common, denom FROM r WHERE {sql_tail('common', 'denom', 'p')} <= log10(0.05)
    """,
    "sketch_merged": _sketch_sql(SQL_BY_SOURCE, TEXT, "source_no"),
    "genome_length": _SOURCES + " SELECT ref_idx, floor(pow(2, 60) * n / top)::BIGINT AS length FROM a_meta",
    "screen_identity": f"SELECT * FROM ({_screen_sql(False)}) WHERE identity >= 0.95",
    "dist_table": _SOURCES + f", {sql_postings('b', SQL_BENCHMARK, TEXT)}, {sql_pairs('a', 'b', TEXT, every=True)} SELECT query, " + ", ".join(f"round(max(CASE WHEN ref = {i} THEN distance END), 9) AS source_{i}" for i in range(20)) + " FROM pairs GROUP BY query",
    "triangle_edges": f"WITH {sql_postings('a', SQL_DOCUMENTS, TEXT)}, {sql_pairs('a', 'a', TEXT, on='AND x.ref_idx > y.ref_idx')} SELECT ref AS i, query AS j, common, denom, round(distance, 9) AS distance FROM pairs WHERE distance <= 0.2",
    "triangle_rows": _SOURCES + f""", {sql_pairs('a', 'a', TEXT, on='AND x.ref_idx > y.ref_idx', every=True)},
        rows_ AS (SELECT ref, count(*) AS n, string_agg((round(distance * 1000000))::BIGINT::VARCHAR, ',' ORDER BY query) AS distances FROM pairs GROUP BY ref)
        SELECT ref_idx AS i, 'ref' || ref_idx AS name, coalesce(r.n, 0) AS n, coalesce(distances, '') AS distances FROM a_meta m LEFT JOIN rows_ r ON r.ref = m.ref_idx
    """,
    "within_containment": _PAIRS + """
        q AS (SELECT r.ref_idx AS ref, y.ref_idx AS query, y.rank, r.n AS rn, r.top, qm.n AS qn, y.hash FROM a_meta r, b y JOIN b_meta qm ON qm.ref_idx = y.ref_idx WHERE r.n > 0),
        reach AS (SELECT ref, query, least(any_value(rn), any_value(qn), count(*) FILTER (WHERE hash <= top)) AS j FROM q GROUP BY ref, query),
        hits AS (SELECT q.ref, q.query, count(*) AS common FROM q JOIN reach USING (ref, query) JOIN a ON a.ref_idx = q.ref AND a.hash = q.hash WHERE q.rank <= j GROUP BY q.ref, q.query)
        SELECT ref, query, round(coalesce(common, 0)::DOUBLE / j, 9) AS score, round(1 / sqrt(j), 9) AS error FROM reach LEFT JOIN hits USING (ref, query) WHERE j > 0 AND 1 / sqrt(j) <= 0.2
    """,
    "screen_containment": _screen_sql(False),
    "screen_winner": _screen_sql(True),
    "screen_pvalue": f"""
        WITH {sql_postings('a', SQL_CUSTOMERS, _P9)}, {sql_postings('m', "SELECT 0 AS ref_idx, seq FROM (" + SQL_SUPPLIERS + ")", _P9)},
        size AS (SELECT pow(2, 60) * n / top AS s FROM m_meta),
        per AS (SELECT a.ref_idx, count(*) AS shared FROM a JOIN (SELECT DISTINCT hash FROM m_counts) USING (hash) GROUP BY a.ref_idx),
        r AS (SELECT ref_idx, shared, n, least(1.0, s / {_P9.kmer_space}) AS p FROM per JOIN a_meta USING (ref_idx), size)
        SELECT ref_idx AS nation, shared, n AS size, round({sql_tail('shared', 'n', 'p')}, 5) AS log10_p FROM r
    """,
    "screen_protein": f"""
        WITH {_frames_sql(SQL_SUPPLIERS)}, {sql_postings('a', _PROTEIN_SEQS, PROTEIN)}, {sql_kmers('m', 'SELECT 0 AS ref_idx, protein AS seq FROM frames', PROTEIN)},
        mix AS (SELECT ('0x' || substr(md5(kmer), 1, 15))::BIGINT AS hash, count(*) AS n FROM m_kmers GROUP BY kmer),
        per AS (SELECT a.ref_idx, count(*) AS shared, list_sort(list(mix.n)) AS depths FROM a JOIN mix USING (hash) GROUP BY a.ref_idx)
        SELECT ref_idx AS nation, round(CASE WHEN shared = n THEN 1.0 ELSE pow(shared::DOUBLE / n, 1.0 / {PROTEIN.kmer}) END, 9) AS identity, shared, n AS size, depths[shared // 2 + 1] AS median_multiplicity
        FROM per JOIN a_meta USING (ref_idx)
    """,
    "translation": f"WITH {_frames_sql(SQL_SUPPLIERS)} SELECT s_suppkey, frame, protein FROM frames",
    "tax_lca": f"WITH RECURSIVE {sql_postings('a', SQL_CUSTOMERS, DNA)}, {_TREE} SELECT hash, tax_id FROM lca",
    "tax_report": f"""
        WITH RECURSIVE {sql_postings('a', SQL_CUSTOMERS, DNA)}, {_TREE},
        {sql_kmers('m', 'SELECT 0 AS ref_idx, seq FROM (' + SQL_SUPPLIERS + ')', DNA)},
        mix AS (SELECT DISTINCT ('0x' || substr(md5(kmer), 1, 15))::BIGINT AS hash FROM m_kmers),
        taxa AS (SELECT tax_id, count(*) AS tax_hashes, count(mix.hash) AS tax_seen FROM lca LEFT JOIN mix USING (hash) GROUP BY tax_id),
        clades AS (SELECT ancestor AS tax_id, sum(tax_seen)::BIGINT AS seen, sum(tax_hashes)::BIGINT AS hashes FROM taxa JOIN line USING (tax_id) GROUP BY ancestor HAVING sum(tax_seen) > 0),
        paths AS (
            SELECT l.tax_id, list({{'s': -c.seen, 'a': c.tax_id}} ORDER BY l.up DESC) AS path FROM line l JOIN clades c ON c.tax_id = l.ancestor JOIN clades own ON own.tax_id = l.tax_id GROUP BY l.tax_id
        )
        SELECT (row_number() OVER (ORDER BY path))::INT AS place, (len(path) - 1)::INT AS depth, round(100.0 * seen / (SELECT sum(tax_seen) FROM taxa), 6) AS percent, seen,
               coalesce(tax_seen, 0) AS tax_seen, hashes, coalesce(tax_hashes, 0) AS tax_hashes, tax_id::BIGINT AS tax_id, rank, name
        FROM clades JOIN paths USING (tax_id) JOIN nodes USING (tax_id) LEFT JOIN taxa USING (tax_id)
    """,
    "info_tabular": f"WITH {sql_postings('a', SQL_DOCUMENTS, TEXT)} SELECT ref_idx, n AS hashes, length, 'ref' || ref_idx AS name FROM a_meta",
    "info_histogram": _SOURCES + " SELECT 'ref' || ref_idx AS name, count AS bin, count(*) AS frequency FROM a GROUP BY ref_idx, count",
    "paste_truncate": f"""
        WITH {sql_postings('a', SQL_BENCHMARK, TEXT.with_(sketch_size=50))}, {sql_postings('b', SQL_BY_SOURCE, TEXT.with_(sketch_size=50))},
        every AS (SELECT 0 AS part, * FROM a UNION ALL SELECT 1, * FROM b),
        names AS (SELECT part, ref_idx, row_number() OVER (ORDER BY part, ref_idx) - 1 AS number FROM (SELECT 0 AS part, ref_idx FROM a_meta UNION ALL SELECT 1, ref_idx FROM b_meta))
        SELECT number AS ref_idx, 'ref' || e.ref_idx AS name, hash, rank, count FROM every e JOIN names n ON n.part = e.part AND n.ref_idx = e.ref_idx
    """,
    "store_round_trip": f"WITH {sql_postings('a', SQL_BY_SOURCE, TEXT.with_(sketch_size=30))} SELECT ref_idx, hash, rank, count FROM a",
    "low_k_warning": f"""
        WITH {sql_postings('a', SQL_BY_SOURCE, TEXT.with_(kmer=4))},
        f AS (SELECT count(*) AS n_flagged, 'ref' || arg_max(ref_idx, (length, -ref_idx)) AS longest, max(length) AS length FROM a_meta WHERE length > {TEXT.with_(kmer=4).max_safe_length})
        SELECT n_flagged, longest, length, round(length / (length + pow(27.0, 4)), 9) AS chance, ceil(ln(length * (1 - 0.01) / 0.01) / ln(27))::BIGINT AS min_kmer FROM f WHERE n_flagged > 0
    """,
    "sketch_comments": f"""
        WITH r AS (SELECT conv_id, turn, 'turn' || turn || CASE WHEN role IS NULL OR role = '' THEN '' ELSE ' ' || role END AS head, strlen(text) AS size FROM conversations WHERE strlen(text) >= {TEXT.kmer})
        SELECT conv_id AS ref_idx, CASE WHEN count(*) > 1 THEN '[' || count(*) || ' seqs] ' || arg_min(head, turn) || ' [...]' ELSE arg_min(head, turn) END AS comment, count(*) AS records, sum(size)::BIGINT AS total_length
        FROM r GROUP BY conv_id
    """,
    "fastx_records": f"SELECT 'c' || c_custkey AS name, 'nation ' || ref_idx AS comment, seq FROM ({SQL_CUSTOMERS})",
    "streaming_mixture": f"""
        WITH {sql_postings('a', SQL_BENCHMARK, TEXT)}, {sql_kmers('m', SQL_DOCUMENTS, TEXT)},
        mix AS (SELECT ('0x' || substr(md5(kmer), 1, 15))::BIGINT AS hash, count(*) AS count FROM m_kmers GROUP BY kmer)
        SELECT hash, count FROM mix WHERE hash IN (SELECT hash FROM a)
    """,
}
