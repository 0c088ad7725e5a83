"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, media, minhash, packing, pii, secrets, sharding, substrings, topk, toxicity

#: Ranks and pattern of op2; the file is a parameter, read where the workers run.
RANKS = os.environ.get("EMBERLOG_RANKS")
#: The key of op9's surrogates; a corpus that is given away needs a secret one.
KEY = os.environ.get("EMBERLOG_PII_KEY", "public key of the registered queries")


def tokenizer() -> tuple[str, str]:
    """Path of the ranks, and the pattern."""
    import public_tokenizers

    return RANKS or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_read(spark, sf_dir, "documents"), *tokenizer())


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_read(spark, sf_dir, "documents"))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_read(spark, sf_dir, "documents"), 40)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), 10, F.col("vec_id") % 100 == 0)



def learnable():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), learnable())
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_read(spark, sf_dir, "documents"), ["doc_id", "text"], KEY)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), size=2)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_byte_bpe, op3_media_columns, op4_byte_shards, op5_best_fit_packing, op6_top_k, op7_toxicity, op8_substring_dedup, op9_pii_surrogates, op10_minhash)}

ORACLE_SQL = {
    "op10_minhash": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
          SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w
        ), c AS (  -- documents with equal sets are one
          SELECT doc_id, g, len(g) AS n, min(doc_id) OVER (PARTITION BY CASE WHEN len(g) = 0 THEN CAST(doc_id AS VARCHAR) ELSE sha256(array_to_string(list_sort(g), chr(10))) END) AS r FROM s
        ), e AS (SELECT doc_id, n, unnest(g) AS x FROM c WHERE doc_id = r),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n - count(*) AS n_union, count(*) AS n_common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n),
        l AS (SELECT u, v FROM p WHERE 100 * n_common >= 80 * n_union UNION ALL SELECT v, u FROM p WHERE 100 * n_common >= 80 * n_union),
        t AS (SELECT doc_id AS d, doc_id AS k FROM c WHERE doc_id = r UNION SELECT l.v, t.k FROM t JOIN l ON l.u = t.d WHERE t.k < l.v),
        m AS (SELECT d, min(k) AS k FROM t GROUP BY d)
        SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, m.k AS component_id, c.doc_id = m.k AS kept FROM c JOIN m ON m.d = c.r""",
    "op6_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        ) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        dup AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM dup),
        g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
        k AS (SELECT d.doc_id, len(w) AS n, d.w, g.ps FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
               sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE
                 coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(1, n + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]), ' '), '') END) AS kept_sha256
        FROM k""",
}
