"""Structured Streaming forms of the daily pipeline (A11, L1, L3-L5), each with
a batch twin that is used to check it.  L2 is in ``alert_stream``, L6 in
``commits``.

Event time is ``scraped_at``; watermarks need TIMESTAMP (not TIMESTAMP_NTZ),
so streams cast it with the session time zone pinned to UTC.
"""

from __future__ import annotations

import os
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_DIGEST_HOURS, ensure_checkpoint_dir, ship_package
from .commits import CommittedTables, upsert_windows


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """A fresh folder for a query under the shared checkpoint root."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")


def price_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                 max_files: int | None = 1000) -> DataFrame:
    """New observations landing as parquet files in ``path``; a micro-batch
    reads at most ``max_files`` of them."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def event_time(df: DataFrame, col: str = "scraped_at") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


# --- L1 ---------------------------------------------------------------------------

def daily_dedup_stream(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """L1: at most one observation per competitor and UTC day (first to arrive)."""
    s = event_time(stream).withColumn("day", F.to_date("scraped_at"))
    return s.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["competitor_id", "day"])


def daily_dedup(history: DataFrame) -> DataFrame:
    """L1 batch twin: first observation by (scraped_at, id) per competitor and
    day, as a partial aggregate (hot competitors combine map-side)."""
    d = history.withColumn("day", F.to_date("scraped_at"))
    cols = [c for c in d.columns if c not in ("competitor_id", "day")]
    return (d.groupBy("competitor_id", "day")
            .agg(F.min_by(F.struct(*cols), F.struct("scraped_at", "id")).alias("r"))
            .select("competitor_id", "day", "r.*"))


# --- L3 ---------------------------------------------------------------------------

def _daily_stats(df: DataFrame) -> DataFrame:
    ok = df.filter((F.col("scrape_status") == "success") & F.col("price").isNotNull())
    return (ok.groupBy(F.window("scraped_at", "1 day").alias("w"), "competitor_id")
            .agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"),
                 F.sum("price").alias("sum_price"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "competitor_id", "min_price", "max_price",
                    (F.col("sum_price").cast("double") / F.col("n")).alias("avg_price"), "n"))


def daily_price_window_stream(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """L3: tumbling 1-day min / max / avg / count per competitor, for
    ``run_windows``: a batch hands on the windows that it changed, and a window
    leaves the state when the watermark passes its end."""
    return _daily_stats(event_time(stream).withWatermark("scraped_at", delay))


def daily_price_window(history: DataFrame) -> DataFrame:
    """L3 batch twin."""
    return _daily_stats(event_time(history))


# --- L4 ---------------------------------------------------------------------------

def _digest_windows(alerts: DataFrame, settings: DataFrame) -> DataFrame:
    """Alerts with their user's frequency and the window's start and end."""
    a = event_time(alerts, "detected_at")
    freq = settings.select("user_id", "digest_frequency_hours")
    hours = F.col("digest_frequency_hours").cast("bigint")
    j = a.join(freq, "user_id", "left").withColumn(
        "freq", F.when(hours > 0, hours).otherwise(F.lit(DEFAULT_DIGEST_HOURS)))
    at, size = F.unix_seconds("detected_at"), F.col("freq") * 3600
    start = at - F.pmod(at, size)
    return j.select("user_id", "freq", "alert_type", F.timestamp_seconds(start).alias("window_start"),
                    F.timestamp_seconds(start + size).alias("window_end"))


def _digest_counts():
    return F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("alert_type") == "price_drop").alias("drops")


def digest_window(alerts: DataFrame, settings: DataFrame) -> DataFrame:
    """L4: alerts per user per tumbling digest window of the user's frequency,
    any whole number of hours, in one pass: the window's start is the epoch
    time rounded down to the frequency.  Users without settings, or without a
    positive frequency, use the default."""
    return _digest_windows(alerts, settings).groupBy("user_id", "freq", "window_start").agg(*_digest_counts())


def digest_window_stream(alerts: DataFrame, settings: DataFrame, delay: timedelta = timedelta(days=1)) -> DataFrame:
    """L4 as a stream, for ``run_windows``.  A window's end is its event time,
    so that it leaves the state when the watermark passes it.  The newest end
    may lie one window of the longest frequency ahead of the newest alert, so
    the watermark stays that much behind: an alert up to ``delay`` late still
    finds its window."""
    hours = F.col("digest_frequency_hours").cast("bigint")
    longest = settings.agg(F.max(hours)).first()[0] or 0
    behind = delay + timedelta(hours=max(longest, DEFAULT_DIGEST_HOURS))
    rows = _digest_windows(alerts, settings).withWatermark("window_end", f"{int(behind.total_seconds())} seconds")
    return rows.groupBy("user_id", "freq", "window_start", "window_end").agg(*_digest_counts()).drop("window_end")


# --- running, L5, L6 ------------------------------------------------------------------

def run_to_table(stream_df: DataFrame, name: str) -> DataFrame:
    """Drain everything available (``availableNow``) into parquet under the
    shared checkpoint folder by the exactly-once file sink and return it as a
    table; nothing goes through the driver."""
    spark = stream_df.sparkSession
    ship_package(spark)
    out = os.path.join(ensure_checkpoint_dir(spark), "stream_out", f"{name}-{uuid.uuid4().hex[:8]}")
    # the folder exists, empty, before the stream may find nothing to write
    spark.createDataFrame([], stream_df.schema).write.mode("overwrite").parquet(out)
    (stream_df.writeStream.outputMode("append").option("checkpointLocation", checkpoint_location(spark, name))
     .format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream_df.schema).parquet(out)


def run_windows(stream_df: DataFrame, keys: list[str], root: str) -> tuple[DataFrame, list[dict]]:
    """Drain a windowed aggregation in update mode: every batch writes only the
    windows that it changed (``upsert_windows``), closed windows leave the
    state.  Returns the newest row of every window (``keys``) and the batches'
    progress reports.  Called again with the same ``root``, it goes on."""
    spark = stream_df.sparkSession
    tables = CommittedTables(spark, root)
    query = (stream_df.writeStream.outputMode("update").option("checkpointLocation", f"{tables.root}/checkpoint")
             .foreachBatch(upsert_windows(tables)).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = tables.latest("windows", keys)
    return spark.createDataFrame([], stream_df.schema) if rows is None else rows, query.recentProgress


def count_late(path: str, delay: timedelta, window: str = "1 day"):
    """foreachBatch handler that tells late observations from others.  An
    observation is late when its event-time window ended at or before the
    watermark, the newest event time of all earlier batches less ``delay``.
    Each batch writes its rows with the flag, and its newest event time, under
    its own number, so that a batch that is run again replaces its first try."""
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = f"{path}/newest"
        seen = (spark.read.schema("t timestamp, batch bigint").parquet(newest).filter(F.col("batch") < number)
                if number else spark.createDataFrame([], "t timestamp, batch bigint"))
        mark = seen.agg(F.max("t") - F.lit(delay)).scalar()
        end = F.window("scraped_at", window)["end"]
        flagged = batch.withColumn("end", end).withColumn(
            "late", F.coalesce(F.col("end") <= mark, F.lit(False))).drop("end")
        flagged.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        (spark.read.parquet(f"{path}/rows/batch={number}").agg(F.max("scraped_at").alias("t"))
         .write.mode("overwrite").parquet(f"{newest}/batch={number}"))
    return handle


def idempotent_sink(path: str):
    """foreachBatch writer of a single table that replaces the folder of its
    batch id, so a replayed batch (after a failure) rewrites instead of
    duplicating.  For several tables see ``commits``."""
    def write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))
    return write
