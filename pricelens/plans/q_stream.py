"""Registered queries: streaming jobs (run to completion) and batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import ensure_checkpoint_dir
from ..sources.tables import model_price_history_stream
from ..streaming import jobs as S
from ..streaming.alert_stream import last_revision, run_alerts
from .registry import query


def _ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("L1_daily_dedup", """
SELECT competitor_id, CAST(scraped_at AS DATE) AS day, arg_min(id, (scraped_at, id)) AS id FROM price_history
GROUP BY 1, 2""", ("price_history",))
def l1(m):
    """L1 batch twin: first observation per competitor and UTC day."""
    return S.daily_dedup(m.price_history).select("competitor_id", "day", "id")


@query("L1_daily_dedup_stream", """
SELECT DISTINCT competitor_id, CAST(scraped_at AS DATE) AS day FROM price_history""", ("price_history",))
def l1s(m):
    """L1 as a stream (watermark + dropDuplicatesWithinWatermark), drained:
    exactly one observation per (competitor, day) key.  Which one is kept is
    arrival order, so the key set is compared."""
    s = S.daily_dedup_stream(model_price_history_stream(m.spark, m.sf_dir))
    return S.run_to_table(s.select("competitor_id", "day"), f"l1_{uuid.uuid4().hex[:8]}")


_DET = """id, user_id, product_id, competitor_id, alert_type, CAST(old_price AS DOUBLE) AS old_price,
  CAST(new_price AS DOUBLE) AS new_price, CAST(price_change_percent AS DOUBLE) AS price_change_percent,
  old_currency, new_currency, detected_at"""


def _root(m, name):
    return f"{ensure_checkpoint_dir(m.spark)}/stream_tables/{name}-{uuid.uuid4().hex[:8]}"


@query("L2_stream_alerts", f"SELECT {_DET} FROM detections", ("detections",))
def l2(m):
    """L2: change detection on the stream, drained, its state in tables by
    competitor and day; equals the batch detection."""
    tables = run_alerts(model_price_history_stream(m.spark, m.sf_dir), m.competitors, m.products, _root(m, "l2"))
    return _ntz(last_revision(tables.read("alerts")), "detected_at")


@query("L2_stream_alerts_out_of_order", f"SELECT {_DET} FROM detections", ("detections",))
def l2o(m):
    """L2 over observations that arrive out of order: three arrivals, each with
    rows between those of the others, up to the whole history late; the last
    revisions equal the batch detection.  The stream goes on as each arrival
    lands and reads it in one batch, in however many files it came: the number
    of batches, and so of passes over competitors and state, is that of the
    arrivals and does not grow with the data."""
    path = f"{ensure_checkpoint_dir(m.spark)}/scratch/arrivals-{uuid.uuid4().hex[:8]}"
    root, h = _root(m, "l2o"), m.price_history
    for part in (2, 0, 1):
        h.filter(F.col("id") % 3 == part).write.mode("append").parquet(path)
        st = S.price_stream(m.spark, path, h.schema, max_files=None)
        tables = run_alerts(st, m.competitors, m.products, root)
    return _ntz(last_revision(tables.read("alerts")), "detected_at")


@query("L3_daily_price_window", """
SELECT date_trunc('day', scraped_at) AS window_start, competitor_id, CAST(min(price) AS DOUBLE) AS min_price,
  CAST(max(price) AS DOUBLE) AS max_price, CAST(sum(price) AS DOUBLE) / count(*) AS avg_price, count(*) AS n
FROM price_history WHERE scrape_status = 'success' AND price IS NOT NULL GROUP BY 1, 2""", ("price_history",))
def l3(m):
    """L3 batch twin: daily min / max / avg / count per competitor."""
    return _ntz(S.daily_price_window(m.price_history), "window_start")


@query("L3_daily_price_window_stream", """
SELECT date_trunc('day', scraped_at) AS window_start, competitor_id, CAST(min(price) AS DOUBLE) AS min_price,
  CAST(max(price) AS DOUBLE) AS max_price, CAST(sum(price) AS DOUBLE) / count(*) AS avg_price, count(*) AS n
FROM price_history WHERE scrape_status = 'success' AND price IS NOT NULL GROUP BY 1, 2""", ("price_history",))
def l3s(m):
    """L3 as a stream in update mode: changed windows are written, the newest
    row of each is read (every window, including open ones)."""
    s = S.daily_price_window_stream(model_price_history_stream(m.spark, m.sf_dir))
    return _ntz(S.run_windows(s, ["window_start", "competitor_id"], _root(m, "l3"))[0], "window_start")


@query("L4_digest_window", """
SELECT a.user_id, coalesce(s.digest_frequency_hours, 24) AS freq,
  time_bucket(to_hours(coalesce(s.digest_frequency_hours, 24)), a.detected_at, TIMESTAMP '1970-01-01') AS window_start,
  count(*) AS alerts, CAST(count_if(a.alert_type = 'price_drop') AS BIGINT) AS drops
FROM pending_alerts a LEFT JOIN user_alert_settings s ON s.user_id = a.user_id GROUP BY 1, 2, 3""",
       ("pending_alerts", "user_alert_settings"))
def l4(m):
    """L4 batch twin: alerts per user per digest window of their frequency."""
    return _ntz(S.digest_window(m.pending_alerts, m.user_alert_settings), "window_start")


@query("L3_daily_price_window_lineitem", """
SELECT date_trunc('day', CAST(l_shipdate AS TIMESTAMP)) AS window_start, l_suppkey AS competitor_id,
  CAST(min(p) AS DOUBLE) AS min_price, CAST(max(p) AS DOUBLE) AS max_price, CAST(sum(p) AS DOUBLE) / count(*) AS avg_price,
  count(*) AS n
FROM (SELECT l_suppkey, l_shipdate,
        CAST(CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
                  // (2 * CAST(l_quantity AS BIGINT)) AS DECIMAL(12,0)) * 0.01 AS DECIMAL(10,2)) AS p
      FROM lineitem WHERE l_quantity > 0) t
GROUP BY 1, 2""")
def l3_li(m):
    """L3 batch twin over the large lineitem-derived history (supplier =
    competitor, unit price = price, ship date = observation time)."""
    b = m.bench_history.withColumn("scrape_status", F.lit("success"))
    return _ntz(S.daily_price_window(b), "window_start")


@query("L4_digest_window_stream", """
SELECT a.user_id, coalesce(s.digest_frequency_hours, 24) AS freq,
  time_bucket(to_hours(coalesce(s.digest_frequency_hours, 24)), a.detected_at, TIMESTAMP '1970-01-01') AS window_start,
  count(*) AS alerts, CAST(count_if(a.alert_type = 'price_drop') AS BIGINT) AS drops
FROM pending_alerts a LEFT JOIN user_alert_settings s ON s.user_id = a.user_id GROUP BY 1, 2, 3""",
       ("pending_alerts", "user_alert_settings"))
def l4s(m):
    """L4 as a stream: the alert table lands as files (the alert sink's
    output), a file stream feeds the digest windows (alerts up to a day late),
    drained in update mode."""
    path = f"{ensure_checkpoint_dir(m.spark)}/scratch/alerts-{uuid.uuid4().hex[:8]}"
    m.pending_alerts.write.parquet(path)
    st = m.spark.readStream.schema(m.spark.read.parquet(path).schema).parquet(path)
    dw = S.digest_window_stream(st, m.user_alert_settings)
    return _ntz(S.run_windows(dw, ["user_id", "freq", "window_start"], _root(m, "l4"))[0], "window_start")
