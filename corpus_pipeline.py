"""A corpus-cleaning pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; all but the last return the columns of ``documents``.  ``run``
writes each stage's rows as Parquet under the shared folder of
spark.checkpoint.dir and reads them again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import exact_dedup, packing, secrets, simhash, toxicity
from pricelens.llm.common import FILE, ROW, filed, located, prepare, run_dir, save


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    s = toxicity.SETTINGS
    plain = docs.select(*docs.columns)
    scored = toxicity.scored(plain, plain.columns, *toxicity.fit(plain, labels), s)
    return scored.where(F.col("tox_score") < toxicity.THRESHOLD).select(*docs.columns)


def _only(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` (a file scan) that ``verdicts`` (locator, kept)
    keeps; a row travels as one struct, so that its columns may have any name."""
    keep = verdicts.where("kept").select(FILE, ROW)
    rows = located(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("document"))
    return rows.join(keep, [FILE, ROW], "left_semi").select("document.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    docs = filed(docs)
    return _only(docs, exact_dedup.exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays."""
    docs = filed(docs)
    return _only(docs, simhash.simhash_dedup(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece with its place."""
    out = packing.pack_documents(docs, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies),
          ("secret scans", mask_secrets), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), f"{folder}/stage-{number}")
    return docs
