"""Thin queries over the whole tables, one for each training-data operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import private_key, table
from .context_mixing import score_texts
from .mixing import mix
from .packing import pack
from .privacy import KINDS, pseudonymise
from .quality_classifier import fit, score_quality
from .quality_rules import quality_rules
from .simhash import near_duplicates
from .substring_dedup import remove_repeats
from .topk import top_k
from .warc import read_archives, write_archives


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_private_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), key=private_key(spark)).select("doc_id", "text", *[F.col(f"_found.{k}").alias(f"n_{k}") for k in KINDS])


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def _remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), _remainder(3) == 1
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels").where(~held_out)), held_out)


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), _remainder(7) == 2)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = F.coalesce("_cleaned", F.lit(""))
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "_rules.*", F.length(cleaned).cast("long").alias("kept_chars"), F.sha2(cleaned, 256).alias("kept_sha256"))


#: Token shares that the mixture is raked to.
TARGETS = {
    "source": {"src0": 0.3},
    "lang": {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1},
    "topic": {f"t{k}": 0.125 for k in range(8)},
}


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), TARGETS, with_text=False).select("doc_id", "source", "lang", "_mix.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc_roundtrip": op2_warc_roundtrip,
    "op3_private_pseudonyms": op3_private_pseudonyms,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_context_mixing": op6_context_mixing,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_source_mixing": op10_source_mixing,
}

SQL: dict[str, str] = {
    "op2_warc_roundtrip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            list_reduce(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(hex, CAST(j // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS INT)) & 31 AS INT) + 1, 1)), lambda a, b: a || b) AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
    "op7_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op9_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
        win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
        cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
        l AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
            FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d)),
        lw AS (SELECT * FROM l WHERE n > 0),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
        freq AS (SELECT host, h FROM lw GROUP BY host, h HAVING count(DISTINCT text) > 10),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS left_text FROM l LEFT JOIN (SELECT host, h, true AS often FROM freq) USING (host, h) WHERE n = 0 OR often IS NULL GROUP BY doc_id),
        rm AS (SELECT doc_id, count(*) AS lines, sum(n) AS gone FROM lw JOIN freq USING (host, h) GROUP BY doc_id),
        x AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
            CAST(coalesce(rm.lines, 0) AS BIGINT) AS n_removed_lines, CAST(len(words) - coalesce(rm.gone, 0) AS BIGINT) AS kept_words,
            CAST(length(coalesce(kept.left_text, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept.left_text, '')) AS kept_sha256
            FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id LEFT JOIN rm ON rm.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id),
        y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x)
        SELECT *, NOT base_failed AND NOT (n_removed_lines > 0 AND kept_words < 0.3 * n_words) AS kept FROM y""",
}
