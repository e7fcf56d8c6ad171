"""The corpus operators as queries over the tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, katz, licenses, mixing, quality, simhash, suffixes, tokenids, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratios = quality.shrunk_ratios(docs, labels.where("quality = 1").select("doc_id"))
    return quality.judge(docs, ratios)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_katz_scores": op3_katz_scores,
    "op4_poisson_mixing": op4_poisson_mixing,
    "op5_token_id_files": op5_token_id_files,
    "op6_license_scan": op6_license_scan,
    "op7_warc": op7_warc,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

#: DuckDB SQL of those queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": """
        WITH RECURSIVE g AS (
            SELECT vec_id, min(CASE WHEN len(e) > 0 AND NOT list_bool_or(list_transform(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0)) THEN e END) AS e
            FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) GROUP BY vec_id
        ),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
        c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
        FROM g LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
    """,
    "op10_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM d)),
        again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
        runs AS (SELECT doc_id, p, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS head FROM again)),
        gone AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS z FROM runs GROUP BY doc_id, run),
        kept AS (
            SELECT doc_id, z AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000::BIGINT) AS z FROM gone
            UNION ALL SELECT doc_id, 0, coalesce(a, 1000000000::BIGINT) FROM d LEFT JOIN (SELECT doc_id, min(a) AS a FROM gone GROUP BY doc_id) USING (doc_id)
        ),
        cut AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
        g AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed FROM gone GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(cut.h)) AS kept_sha256
        FROM d JOIN cut USING (doc_id) LEFT JOIN g USING (doc_id)
    """,
    "op4_poisson_mixing": mixing.ORACLE,
    "op7_warc": """
        WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT h, max(page_id) AS top, count(*) AS k FROM d WHERE n >= 1000 GROUP BY h)
        SELECT page_id, n AS payload_bytes, d.h AS payload_digest,
               CASE WHEN k > 1 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN k > 1 AND page_id <> top THEN top END AS refers_to
        FROM d LEFT JOIN g ON d.h = g.h AND d.n >= 1000
    """,
}
