"""The registered queries of the training-data operators: thin calls that
apply each operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, exact_dedup, language_id, packing, quality, reversed_search, rules, secrets,
               sentencepiece_codec, simhash, toxicity, url_filter, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark, sf_dir):
    """Every document with the group of equal texts it is in."""
    out = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_url_filters(spark, sf_dir):
    """Every page's verdict."""
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark, sf_dir):
    """Every document's quality score."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark, sf_dir):
    """Every piece of every document with its place in a sequence."""
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_secret_scans(spark, sf_dir):
    """Every document's secrets."""
    out = secrets.secret_scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op6_toxicity(spark, sf_dir):
    """Every document's toxicity score."""
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark, sf_dir):
    """Every document encoded and decoded again: number and checksum of its
    ids, and whether the text came back (a text that itself holds U+2581
    cannot)."""
    docs = _table(spark, sf_dir, "documents")
    both = sentencepiece_codec.sp_round_trip(docs)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids_crc32", "round_trip")


def op8_warc(spark, sf_dir):
    """Every page's record, read back from the normalised archives."""
    out = warc.warc_round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash_dedup(spark, sf_dir):
    """Every document's fingerprint and component."""
    out = simhash.simhash_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id")


def op10_quality_rules(spark, sf_dir):
    """Every document's counts and verdict."""
    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark, sf_dir):
    """Every damaged conversation's faults and cheapest repair."""
    damaged = conversation_repair.damage(_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_report(damaged, present_col="present")


def op12_language_id(spark, sf_dir):
    """Every document's language."""
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    """Every benchmark item's ten best documents."""
    return reversed_search.lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_ASCII_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP1_SQL = f"""
WITH t AS (SELECT doc_id, {_ASCII_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)"""

OP8_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= {warc.LEAST} GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN g.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= {warc.LEAST}"""

QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_url_filters, op3_quality_classifier, op4_best_fit_packing, op5_secret_scans, op6_toxicity,
    op7_sentencepiece, op8_warc, op9_simhash_dedup, op10_quality_rules, op11_conversation_repair, op12_language_id,
    op13_lexical_search)}
ORACLE = {"op1_exact_dedup": OP1_SQL, "op2_url_filters": url_filter.sql(), "op8_warc": OP8_SQL,
          "op11_conversation_repair": conversation_repair.sql(), "op13_lexical_search": reversed_search.sql()}
