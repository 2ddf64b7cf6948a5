"""Operator 1, exact dedup: a stateful stream with disk-backed keyed state.

Documents arrive as rows of (digest, id, content locator).  A streaming
aggregation keyed by the digest keeps, in RocksDB and without expiry, the
digest, the stable identifier (the largest id seen, with the locator of its
content: file and row) and the number of rows.  Partial aggregation before
the shuffle turns a digest that holds a third of all rows into one row per
task.  A digest that was met before is only a *hit*: before any row is
dropped, the full bytes of every hit are compared with the content at the
locator.  Where bytes differ under one digest, the rows of that digest are
grouped again by their whole text.

The state survives a restart: running again with the same ``state_dir`` and
further arrivals continues from the checkpoint.  Earlier rows of the digests
that arrive again are read by their locators (their files must still be
there), so that hits on them are compared, and grouped again, like all others.

Texts are equal when identical after lower-casing A-Z only.  Null text counts
as empty; all empty texts are one group.  Repeated rows (same id, same text)
count each; of equal ids the row with the largest locator stays.  A null id
is smaller than any other.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import FILE, ROW, _with_locator, id_and_text, located, prepare, run_dir, save, texts

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else every state partition reserves megabytes of disk for its log files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(col):
    return F.translate(F.coalesce(col, F.lit("")), _UPPER, _LOWER)


def _digests(with_text: bool):
    def run(batches):
        for b in batches:
            low = pc.ascii_lower(pa.array(texts(b), pa.string()))
            sha = [hashlib.sha256(t.as_buffer() if t.is_valid else b"").hexdigest() for t in low]
            cols = [b.column("doc_id"), b.column(FILE), b.column(ROW), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([b.column("text")] if with_text else []),
                                             ["doc_id", FILE, ROW, "sha"] + ["text"] * with_text)
    return run


def digested(docs: DataFrame, digest_chars: int, with_text: bool = False) -> DataFrame:
    """(doc_id, locator, sha, digest[, text]); the digest is the first
    ``digest_chars`` hexadecimal digits of the SHA-256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(_digests(with_text), f"doc_id {kind}, {FILE} string, {ROW} bigint, sha string"
                          + ", text string" * with_text)
    return out.withColumn("digest", F.substring("sha", 1, digest_chars))


def keyed_state(spark: SparkSession, arrivals: str, schema: StructType, state_dir: str,
                max_bytes_per_trigger: int = 1 << 40) -> DataFrame:
    """Drain the arrivals through the keyed state; (digest, n, rep) of every
    digest that the state holds, rep being (doc_id, file, row)."""
    old = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = (spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger))
                  .parquet(arrivals)
                  .groupBy("digest")
                  .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", FILE, ROW)).alias("rep")))
        changes = f"{state_dir}/changes"

        def keep(batch: DataFrame, number: int):
            # a batch that is run again replaces what its first attempt wrote
            batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

        (stream.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint")
         .foreachBatch(keep).trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rep = f"rep struct<doc_id:{schema['doc_id'].dataType.simpleString()},{FILE}:string,{ROW}:bigint>"
    seen = spark.read.schema(f"digest string, n bigint, {rep}").parquet(f"{changes}/batch=*")
    # n grows with every change of a digest: the largest is the last
    return seen.groupBy("digest").agg(F.max(F.struct("n", "rep")).alias("s")).select("digest", "s.n", "s.rep")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None,
                digest_chars: int = 64, max_bytes_per_trigger: int = 1 << 40) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256 and the row's locator (src_file, src_row)."""
    spark = docs.sparkSession
    prepare(spark)
    lasting, state_dir = state_dir is not None, state_dir or run_dir(spark, "exact_dedup")
    rows = located(docs, *id_and_text(docs, id_col, text_col))
    arrivals = digested(rows, digest_chars)
    path = f"{state_dir}/arrivals"
    call = uuid.uuid4().hex[:12]
    if lasting:
        arrivals = arrivals.withColumn("text_name", F.lit(_text_name(docs, text_col)))
    arrived = save(arrivals, f"{path}/{call}")
    if not arrived.take(1):
        state = spark.createDataFrame([], f"digest string, n bigint, rep struct<doc_id:"
                                      f"{rows.schema['doc_id'].dataType.simpleString()},{FILE}:string,{ROW}:bigint>")
    else:
        state = save(keyed_state(spark, f"{path}/*", arrivals.schema, state_dir, max_bytes_per_trigger), f"{state_dir}/state")
    before = _earlier(rows, arrived, path, call) if lasting else None
    rows = rows if before is None else rows.unionByName(save(before, f"{state_dir}/earlier"))
    differing = save(_differing(rows, state, digest_chars, state_dir), f"{state_dir}/differing")
    rep = F.col("rep")
    out = arrived.join(state, "digest")
    if differing.take(1):
        split = differing.distinct()
        again = _regrouped(rows, split, digest_chars)
        if before is not None:          # only the rows of this call come out
            again = again.join(arrived.select(FILE, ROW), [FILE, ROW], "left_semi").dropDuplicates([FILE, ROW])
        out = out.drop("text_name").join(split, "digest", "left_anti").unionByName(again)
    here = (F.col(FILE) == rep[FILE]) & (F.col(ROW) == rep[ROW])
    return out.select("doc_id", rep["doc_id"].alias("keep_id"), F.col("n").alias("group_size"), here.alias("kept"),
                      F.col("sha").alias("text_sha256"), FILE, ROW)


def _text_name(docs: DataFrame, text_col: str) -> str:
    """The text's column in the files that the locators of ``docs`` name."""
    try:
        _with_locator(docs, []).schema
        return text_col
    except AnalysisException:
        return "text"


def _earlier(rows: DataFrame, arrived: DataFrame, path: str, call: str) -> DataFrame | None:
    """The rows, with their texts, that earlier calls saw under digests of this
    one: one scan of the files that their locators name."""
    spark = rows.sparkSession
    seen = spark.read.schema(arrived.schema).parquet(f"{path}/*")
    past = (seen.where(~seen.metadataColumn("_metadata")["file_path"].contains(f"/{call}/"))
            .join(arrived.select("digest"), "digest", "left_semi").select("doc_id", FILE, ROW, "text_name"))
    files: dict = {}
    for r in past.select("text_name", FILE).distinct().toLocalIterator():          # a row a file
        files.setdefault(r["text_name"], []).append(unquote(r[FILE]))
    out = None
    for name, named in files.items():
        scan = spark.read.parquet(*named)
        found = _with_locator(scan, [scan[f"`{name}`"].alias("text")])
        part = past.where(F.col("text_name") == name).join(found, [FILE, ROW]).select(*rows.columns)
        out = part if out is None else out.unionByName(part)
    return out


def _differing(rows: DataFrame, state: DataFrame, digest_chars: int, state_dir: str) -> DataFrame:
    """The digest of every row whose bytes differ from the content at the
    locator.  Only rows of digests with several rows are kept after the join
    on the digest.  Nothing that needs a digest's rows together stands above
    either join, so that adaptive execution can split a hot digest."""
    hits = save(digested(rows, digest_chars, with_text=True)
                .join(state.where("n > 1").select("digest", "rep"), "digest")
                .select("digest", "text", ((F.col(FILE) == F.col(f"rep.{FILE}"))
                                           & (F.col(ROW) == F.col(f"rep.{ROW}"))).alias("is_rep")),
                f"{state_dir}/hits")
    reps = hits.where("is_rep").select("digest", F.col("text").alias("rep_text"))
    a, b = F.coalesce("text", F.lit("")), F.coalesce("rep_text", F.lit(""))
    same = F.when(a == b, True).otherwise(normalised(F.col("text")) == normalised(F.col("rep_text")))
    return hits.where("not is_rep").join(reps, "digest").where(~same).select("digest")


def _regrouped(rows: DataFrame, split: DataFrame, digest_chars: int) -> DataFrame:
    """The rows of the given digests, grouped by their whole normalised text."""
    some = (digested(rows, digest_chars, with_text=True).join(split, "digest")
            .withColumn("norm", normalised(F.col("text"))))
    groups = some.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"),
                                                F.max(F.struct("doc_id", FILE, ROW)).alias("rep"))
    return some.join(groups, ["digest", "norm"]).select("digest", "doc_id", FILE, ROW, "sha", "n", "rep")
