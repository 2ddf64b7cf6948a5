"""Change detection on arrival, written together with the history.

``alert_batches`` is a foreachBatch writer.  Its state is four committed
tables (see ``commits``), keyed by competitor and time bucket:

    history  the arrived rows, in folders by UTC day
    edges    first and last successful row of every (competitor, bucket)
    tails    newest successful row of every competitor
    alerts   every successful row with its predecessor and alert type

A row behind its competitor's tail (nearly all rows) is compared with the row
before it in the batch, by bucket, so that a hot competitor is spread over its
buckets, or with the tail.  A row that arrives late, however late, is put in
its place: its bucket's rows are read from the history (only the days that
late rows touch), and where it is first in its bucket the edges give the last
row of the nearest earlier bucket.  The row behind a late one comes out
again; ``revision`` is the number of the batch that handed a row on, and
``last_revision`` reads the last answer for every row.

No state is kept outside these tables, nothing is held per competitor in
Python, and only the list of late days (a calendar's worth at most) comes to
the driver.  A batch that is run again after a failure is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.alerts import classify_change, pct_change
from ..operators.series import lag_within_buckets, time_bucket
from .commits import CommittedTables

KEY = "competitor_id"
COMPACT_EVERY = 50           # batches after which edges and tails are written whole again
_BUCKET = "__bucket"


def _ok(history: DataFrame) -> DataFrame:
    return (history.filter((F.col("scrape_status") == "success") & F.col("price").isNotNull())
            .select("id", KEY, "price", "currency", "scraped_at"))


def _row():
    """A row as a struct whose order is the competitor's order."""
    return F.struct("scraped_at", "id", "price", "currency")


def _merged_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy(KEY, _BUCKET).agg(F.min("first").alias("first"), F.max("last").alias("last"))


def _merged_tails(tails: DataFrame) -> DataFrame:
    return tails.groupBy(KEY).agg(F.max("last").alias("tail"))


def _after(row, other):
    """Whether a row comes behind another in (scraped_at, id) order."""
    return F.struct(row["scraped_at"], row["id"]) > F.struct(other["scraped_at"], other["id"])


def _on_time(rows: DataFrame, bucket: str) -> DataFrame:
    """Rows behind their competitor's tail with their predecessors."""
    d = lag_within_buckets(rows, KEY, ["scraped_at", "id"], ["price", "currency"], prefix="__p_", bucket_unit=bucket)
    first = F.col("__p_price").isNull()
    return d.select("id", KEY, "price", "currency", "scraped_at",
                    F.when(first, F.col("tail.price")).otherwise(F.col("__p_price")).alias("old_price"),
                    F.when(first, F.col("tail.currency")).otherwise(F.col("__p_currency")).alias("old_currency"))


def _late(rows: DataFrame, history: DataFrame, edges: DataFrame, bucket: str) -> DataFrame:
    """Late rows with their predecessors, and the rows behind them once more.
    ``history`` holds the days that late rows touch."""
    rows = rows.withColumn(_BUCKET, time_bucket(F.col("scraped_at"), bucket))
    own = rows.groupBy(KEY, _BUCKET).agg(F.min(_row()).alias("own_first"), F.max(_row()).alias("own_last"))
    old = (_ok(history).withColumn(_BUCKET, time_bucket(F.col("scraped_at"), bucket))
           .join(own.select(KEY, _BUCKET), [KEY, _BUCKET], "left_semi"))
    # the buckets of these competitors: one row each, with the last row before the bucket
    known = _merged_edges(edges.join(own.select(KEY).distinct(), KEY, "left_semi"))
    chain = known.join(own, [KEY, _BUCKET], "full_outer")
    own_is_last = F.col("last").isNull() | F.coalesce(_after(F.col("own_last"), F.col("last")), F.lit(False))
    by_bucket = Window.partitionBy(KEY).orderBy(_BUCKET)
    chain = chain.withColumn("__end", F.when(own_is_last, F.col("own_last")).otherwise(F.col("last")))
    chain = (chain.withColumn("before", F.lag("__end").over(by_bucket))
             .withColumn("before_is_new", F.coalesce(F.lag(own_is_last).over(by_bucket), F.lit(False))))
    # inside the buckets that late rows touch
    both = rows.select("id", KEY, "price", "currency", "scraped_at", _BUCKET, F.lit(True).alias("new")).unionByName(
        old.select("id", KEY, "price", "currency", "scraped_at", _BUCKET, F.lit(False).alias("new")))
    inside = Window.partitionBy(KEY, _BUCKET).orderBy("scraped_at", "id")
    both = (both.withColumn("prev", F.lag(_row()).over(inside))
            .withColumn("prev_is_new", F.coalesce(F.lag("new").over(inside), F.lit(False))))
    prev = F.coalesce("prev", "before")
    placed = (both.filter(F.col("new") | F.col("prev_is_new"))
              .join(chain.select(KEY, _BUCKET, "before"), [KEY, _BUCKET])
              .select("id", KEY, "price", "currency", "scraped_at", prev["price"].alias("old_price"),
                      prev["currency"].alias("old_currency")))
    # the first known row of a bucket, behind a late row in an earlier bucket
    still_first = F.col("first").isNotNull() & (F.col("own_first").isNull() | _after(F.col("own_first"), F.col("first")))
    behind = chain.filter(still_first & F.col("before_is_new")).select(
        F.col("first.id").alias("id"), KEY, F.col("first.price").alias("price"), F.col("first.currency").alias("currency"),
        F.col("first.scraped_at").alias("scraped_at"), F.col("before.price").alias("old_price"),
        F.col("before.currency").alias("old_currency"))
    return placed.unionByName(behind)


def classified(rows: DataFrame, competitors: DataFrame, products: DataFrame) -> DataFrame:
    """Rows with their predecessors -> detections, by the batch path's
    expressions (I1, I2)."""
    comp = competitors.select(F.col("id").alias(KEY), "product_id", F.col("alert_threshold_percent").alias("threshold_percent"))
    prod = products.select(F.col("id").alias("product_id"), "user_id")
    d = rows.filter(F.col("price") != 0).join(comp, KEY).join(prod, "product_id")
    kind = classify_change(F.col("old_price"), F.col("price"), F.col("old_currency"), F.col("currency"),
                           F.col("threshold_percent"))
    pct = pct_change(F.col("old_price"), F.col("price"))
    return d.select("id", "user_id", "product_id", KEY, kind.alias("alert_type"),
                    "old_price", F.col("price").alias("new_price"),
                    F.when(F.col("old_currency") == F.col("currency"), F.bround(pct, 2)).cast("decimal(12,2)")
                    .alias("price_change_percent"), "old_currency", F.col("currency").alias("new_currency"),
                    F.col("scraped_at").alias("detected_at"))


def alert_batches(tables: CommittedTables, competitors: DataFrame, products: DataFrame, bucket: str = "day",
                  compact_every: int = COMPACT_EVERY):
    """The foreachBatch writer.  ``bucket`` is a unit of ``date_trunc``: a
    finer one spreads a competitor with very many rows a day further."""
    def handle(batch: DataFrame, number: int) -> None:
        attempt = tables.attempt(number)
        if attempt is None:                              # run again after it was committed
            return
        entries = tables.entries(before=number)
        day = F.to_date("scraped_at")
        new = _ok(attempt.write("history", batch.withColumn("day", day), partition_by=("day",)))
        ends = (new.groupBy(KEY, time_bucket(F.col("scraped_at"), bucket).alias(_BUCKET))
                .agg(F.min(_row()).alias("first"), F.max(_row()).alias("last")))
        tails, edges = (tables.read(t, entries=entries) for t in ("tails", "edges"))
        whole = number % compact_every == compact_every - 1 and tails is not None
        if whole:                                        # small files of many batches become few
            ends = _merged_edges(ends.unionByName(edges.drop("batch")))
        ends = attempt.write("edges", ends, replaces=whole)
        newest = ends.groupBy(KEY).agg(F.max("last").alias("last"))
        attempt.write("tails", newest, replaces=whole)
        if tails is None:
            none = T.StructType([new.schema["price"], new.schema["currency"]])
            out = _on_time(new.withColumn("tail", F.lit(None).cast(none)), bucket)
        else:
            placed = new.join(_merged_tails(tails), KEY, "left")
            here = F.struct("scraped_at", "id")
            late = F.coalesce(here <= F.struct("tail.scraped_at", "tail.id"), F.lit(False))
            days = [r.day for r in placed.filter(late).select(day.alias("day")).distinct().collect()]
            out = _on_time(placed.filter(~late) if days else placed, bucket)
            if days:
                seen = tables.read("history", entries=entries).filter(F.col("day").isin(days))
                out = out.unionByName(_late(placed.filter(late).drop("tail"), seen, edges, bucket))
        attempt.write("alerts", classified(out, competitors, products).withColumn("revision", F.lit(number).cast("bigint")))
        attempt.commit()
    return handle


def run_alerts(stream: DataFrame, competitors: DataFrame, products: DataFrame, root: str,
               bucket: str = "day", compact_every: int = COMPACT_EVERY, checkpoint: str | None = None) -> CommittedTables:
    """Drain what has arrived (``availableNow``) into the tables under ``root``;
    called again, it goes on where it stopped.  Keys may have any type."""
    tables = CommittedTables(stream.sparkSession, root)
    timed = stream.withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    (timed.writeStream.option("checkpointLocation", checkpoint or f"{tables.root}/checkpoint")
     .foreachBatch(alert_batches(tables, competitors, products, bucket, compact_every))
     .trigger(availableNow=True).start().awaitTermination())
    return tables


def last_revision(alerts: DataFrame) -> DataFrame:
    """The last revision of every row that the stream handed on."""
    cols = [c for c in alerts.columns if c not in ("id", "revision", "batch")]
    return alerts.groupBy("id").agg(F.max_by(F.struct(*cols), "revision").alias("r")).select("id", "r.*")
