"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, extraction, licenses, packing, phrases, quality, simhash, substring, tokens, toxicity, vptree, warc, whitening
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.search(table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.digest(table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_quality_rules, op3_simhash, op4_token_output, op5_packing, op6_bpe, op7_nearest_neighbours, op8_substring_dedup, op9_toxicity, op10_warc,
        op11_main_text, op12_collocations, op13_whitening,
    )
}
#: Queries that SQL cannot express, or not at whole-table size, are tested against brute force instead.
ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.scan_sql(),
    "op12_collocations": phrases.mine_sql(),
    "op10_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        m AS (SELECT payload_digest, max(page_id) AS first FROM q WHERE payload_bytes >= {warc.REVISIT_BYTES} GROUP BY payload_digest)
        SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM q LEFT JOIN m ON q.payload_digest = m.payload_digest AND payload_bytes >= {warc.REVISIT_BYTES}""",
}
