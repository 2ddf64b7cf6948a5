"""Registered queries: operators that are parts of larger flows, exposed on
their own (A9-A11, B13, C10, D14, D15, E8, E9, G2, H14, H15, I1, I7, I8,
J1-J3, L5, L6)."""

from __future__ import annotations

import os
import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from ..config import ensure_checkpoint_dir
from ..functions import text as TX
from ..operators import alerts as A
from ..operators import insights as IN
from ..sources import catalog as CT
from ..sources.landed import landed_catalog
from ..sources.model_sql import with_models
from ..sources.tables import model_price_history_stream
from ..streaming import jobs as S
from ..streaming.alert_stream import last_revision, run_alerts
from . import q_alerts as QA
from .q_catalog import _EXP
from .registry import AS_OF, ORACLE, query


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:8]}")


def _all_delivered(m):
    rows = QA._digest_rows(m)
    delivery = rows.select("user_id").distinct().select("user_id", F.lit(True).alias("success"),
                                                        F.lit(None).cast("string").alias("error"))
    return A.finish_digest(m.pending_alerts, m.user_alert_settings, delivery, rows, AS_OF)


_A9_MODELS = ("pending_alerts", "user_alert_settings", "users", "products", "competitors")


@query("A9_append_alert_history", f"""WITH {QA._DIGEST_SQL}
SELECT user_id, TIMESTAMP '2024-01-31 00:00:00' AS digest_sent_at, CAST(count(*) AS BIGINT) AS alerts_count,
       'sent' AS email_status FROM dig GROUP BY user_id""", _A9_MODELS)
def a9(m):
    """Digest history rows appended after a successful delivery."""
    return _all_delivered(m)[2].select("user_id", "digest_sent_at", "alerts_count", "email_status")


@query("A9_alert_history_ids", f"""WITH {QA._DIGEST_SQL}
SELECT user_id, TIMESTAMP '2024-01-31 00:00:00' AS digest_sent_at, id AS alert_id FROM dig""", _A9_MODELS)
def a9_ids(m):
    """The alerts of each history row, one row each."""
    return _all_delivered(m)[3]


@query("A10_append_insights")
def a10(m):
    """A10: validated insights as insight rows."""
    from .q_insights import _raw_insights
    return IN.insights_append(IN.validate_insights(_raw_insights(m)), AS_OF)




@query("A11_price_stream", "SELECT id, competitor_id, CAST(price AS DOUBLE) AS price, scrape_status FROM price_history",
       ("price_history",))
def a11(m):
    """The observation stream drained into a table."""
    s = model_price_history_stream(m.spark, m.sf_dir).select("id", "competitor_id", "price", "scrape_status")
    return S.run_to_table(s, f"a11_{uuid.uuid4().hex[:8]}")


@query("B13_catalog_projection", f"""WITH {_EXP}
SELECT a2.name, a2.price, a2.currency, a2.image_url, a2.product_url, 'shopify' AS platform,
  CASE WHEN b.pid % 17 <> 0 THEN CAST(b.pid * 10 AS VARCHAR) END AS variant_id, CASE WHEN b.pid % 17 <> 0 THEN b.sku END AS sku, a2.in_stock
FROM a2 JOIN b ON b.store = a2.store AND b.page = a2.page AND b.ordinal = a2.ordinal""", ("catalog",))
def b13(m):
    """Unified catalog rows projected to the response columns."""
    n = CT.shopify_products_json(landed_catalog(m.catalog)["shopify_json"])
    return n.select("name", "price", "currency", "image_url", "product_url", "platform", "variant_id", "sku", "in_stock")


@query("C10_track_zip", f"""WITH {_EXP},
it AS (SELECT CAST(regexp_extract(store, 'store(\\d+)', 1) AS BIGINT) AS request_id, page * 100000 + ordinal AS ordinal, price, currency FROM best
       WHERE in_stock)
SELECT request_id * 4294967296 + ordinal AS competitor_id, CAST(CAST(price AS DECIMAL(10,2)) AS DOUBLE) AS price, currency
FROM it WHERE request_id <> 4 AND price IS NOT NULL""", ("catalog",))
def c10(m):
    """Initial prices tied to their competitors by a key derived from
    the request row (no positional pairing)."""
    from ..operators import maintenance as MT
    from .q_maint import _track_items
    return MT.track_products(_track_items(m), AS_OF)["price_history"].select("competitor_id", "price", "currency")


@query("D14_total_with_page", """
SELECT id, total FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn, count(*) OVER () AS total
  FROM competitors) t WHERE rn <= 25""", ("competitors",))
def d14(m):
    """First page (25) of the competitor list with the exact total; the
    total is a separate aggregate, the page a top-k (no global window)."""
    total = m.competitors.agg(F.count(F.lit(1))).scalar()       # scalar subquery, no join
    page = m.competitors.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(25).select("id")
    return page.withColumn("total", total)


@query("D15_distinct_urls", f"WITH {_EXP} SELECT DISTINCT product_url FROM allrows WHERE in_stock", ("catalog",))
def d15(m):
    """The set of selected URLs (the in-stock rows of every source)."""
    cat = CT.normalise(landed_catalog(m.catalog))
    return CT.distinct_urls(cat.filter(F.col("in_stock")))


@query("E8_top5_insights", """
SELECT id, product_id, pos FROM (SELECT id, product_id,
  row_number() OVER (PARTITION BY product_id ORDER BY generated_at, id) AS pos FROM insights) t WHERE pos <= 5""",
       ("insights",))
def e8(m):
    """First five insights per product."""
    from ..operators.dashboard import top_per_group
    return top_per_group(m.insights, "product_id", ["generated_at", "id"], 5).select("id", "product_id", "pos")


@query("E9_line_number", f"""WITH {QA._DIGEST_SQL} SELECT id, line_no FROM dig WHERE mailed""",
       ("pending_alerts", "user_alert_settings", "users", "products", "competitors"))
def e9(m):
    """1-based digest line numbers of the mailed alerts."""
    return QA._digest_rows(m).filter("mailed").select("id", "line_no")


@query("H14_digest_line", None)
def h14(m):
    """One plain-text digest entry per mailed alert."""
    r = QA._digest_rows(m).filter("mailed")
    return r.select("id", TX.digest_line(F.col("line_no"), F.col("product_name"), F.col("competitor_name"),
                                         F.col("alert_type"), F.col("price_change_percent"), F.col("old_price"),
                                         F.col("new_price"), F.lit("USD")).alias("line"))


_line, _mail = QA._line_sql()
ORACLE["H14_digest_line"] = with_models(f"WITH {QA._DIGEST_SQL} SELECT id, {_line} AS line FROM dig WHERE mailed",
                                        "pending_alerts", "user_alert_settings", "users", "products", "competitors")


@query("H15_digest_subject", None)
def h15(m):
    """Digest subjects over every (drops, increases) pair seen per user-day."""
    g = m.pending_alerts.groupBy("user_id", F.to_date("detected_at").alias("d")).agg(
        F.count_if(F.col("alert_type") == "price_drop").alias("drops"),
        F.count_if(F.col("alert_type") == "price_increase").alias("increases"))
    return g.select("user_id", "d", TX.digest_subject(F.col("drops"), F.col("increases")).alias("subject"))


_subj = ("'Price Alert: ' || concat_ws(' & ', "
         "CASE WHEN drops > 0 THEN CAST(drops AS VARCHAR) || ' price drop' || CASE WHEN drops > 1 THEN 's' ELSE '' END END, "
         "CASE WHEN increases > 0 THEN CAST(increases AS VARCHAR) || ' price increase' || CASE WHEN increases > 1 THEN 's' ELSE '' END END)")
ORACLE["H15_digest_subject"] = with_models(f"""
SELECT user_id, d, {_mail(_subj, 200)} AS subject FROM (
  SELECT user_id, CAST(detected_at AS DATE) AS d, CAST(count_if(alert_type = 'price_drop') AS BIGINT) AS drops,
         CAST(count_if(alert_type = 'price_increase') AS BIGINT) AS increases FROM pending_alerts GROUP BY 1, 2) t""", "pending_alerts")


@query("I1_pct_change", """
SELECT id, CASE WHEN old_price <> 0 THEN CAST((new_price - old_price) * 100 AS DOUBLE) / CAST(old_price AS DOUBLE) END AS pct
FROM detections""", ("detections",))
def i1(m):
    """Change in percent, (new - old) * 100 / old (null for old 0)."""
    d = m.detections
    return d.select("id", F.when(F.col("old_price") != 0, ((F.col("new_price") - F.col("old_price")) * 100).cast("double")
                                 / F.col("old_price").cast("double")).alias("pct"))


@query("I7_confidence", """
SELECT id, CAST(CASE WHEN TRY_CAST(c AS DOUBLE) BETWEEN 0 AND 1 THEN round(CAST(c AS DECIMAL(20,10)), 2) ELSE 0.5 END AS DOUBLE)
  AS confidence FROM (SELECT id, CASE WHEN id % 6 = 0 THEN '1.5' WHEN id % 8 = 0 THEN 'x' WHEN id % 5 = 0 THEN '-0.2'
  ELSE CAST(confidence_score * 0.9 AS VARCHAR) END AS c FROM insights) t""", ("insights", "products"))
def i7(m):
    """Confidence validation over raw confidence texts."""
    i = m.insights
    c = (F.when(F.col("id") % 6 == 0, F.lit("1.5")).when(F.col("id") % 8 == 0, F.lit("x"))
         .when(F.col("id") % 5 == 0, F.lit("-0.2")).otherwise((F.col("confidence_score") * F.lit(0.9).cast("decimal(2,1)")).cast("string")))
    return i.select("id", TX.confidence(c).alias("confidence"))


@query("I8_insight_type", """
SELECT id, CASE WHEN lower(t) IN ('pattern', 'alert', 'recommendation') THEN lower(t) ELSE 'pattern' END AS insight_type
FROM (SELECT id, CASE WHEN id % 4 = 1 THEN upper(insight_type) WHEN id % 9 = 0 THEN 'trend' ELSE insight_type END AS t
      FROM insights) x""", ("insights", "products"))
def i8(m):
    """I8: insight type normalisation."""
    i = m.insights
    t = F.when(F.col("id") % 4 == 1, F.upper("insight_type")).when(F.col("id") % 9 == 0, F.lit("trend")).otherwise(F.col("insight_type"))
    return i.select("id", TX.insight_type(t).alias("insight_type"))


@query("J1_json_path", f"""WITH {_EXP} SELECT store, page, ordinal, currency FROM a3""", ("catalog",))
def j1(m):
    """Nested JSON paths with defaults (storefront currency code)."""
    return CT.shopify_storefront(landed_catalog(m.catalog)["shopify_storefront"]).select("store", "page", "ordinal", "currency")


@query("J2_tags_split", f"""WITH {_EXP} SELECT store, page, ordinal, tags FROM a2""", ("catalog",))
def j2(m):
    """Tags given as JSON array or comma string -> clean array."""
    return CT.shopify_products_json(landed_catalog(m.catalog)["shopify_json"]).select("store", "page", "ordinal", "tags")


@query("J3_names_of", f"""WITH {_EXP} SELECT store, page, ordinal, tags FROM a5""", ("catalog",))
def j3(m):
    """Names of category / tag objects (Woo REST: categories ++ tags)."""
    return CT.woo_rest_api(landed_catalog(m.catalog)["woo_rest"]).select("store", "page", "ordinal", "tags")


@query("G2_union_pages", f"WITH {_EXP} SELECT store, source_rank, page, ordinal, name FROM allrows", ("catalog",))
def g2(m):
    """Landed pages of all four sources written as files (one per store
    page) and scanned back as multi-file sources, then normalised."""
    back = {}
    for kind, pages in landed_catalog(m.catalog).items():
        path = _scratch(m.spark, f"landed-{kind}")
        CT.write_landed_pages(pages, path)
        back[kind] = CT.read_landed_pages(m.spark, path)
    return CT.normalise(back).select("store", "source_rank", "page", "ordinal", "name")


@query("L5_late_data", """
WITH a AS (SELECT *, CASE WHEN scraped_at >= TIMESTAMP '2024-01-22' THEN 1 WHEN scraped_at >= TIMESTAMP '2024-01-15' THEN 2
                          WHEN id % 4 = 0 THEN 4 ELSE 3 END AS arrival FROM price_history),
b AS (SELECT id, date_trunc('day', scraped_at) AS day, arrival FROM a),
w AS (SELECT arrival, max(scraped_at) AS t FROM a GROUP BY 1),
mark AS (SELECT n.arrival, max(w.t) - INTERVAL 10 DAY AS mark FROM w n LEFT JOIN w ON w.arrival < n.arrival GROUP BY 1)
SELECT day, CAST(arrival - 1 AS BIGINT) AS batch, count(*) AS n, CAST(count_if(coalesce(day + INTERVAL 1 DAY <= mark, false)) AS BIGINT) AS late
FROM b JOIN mark USING (arrival) GROUP BY 1, 2""", ("price_history",))
def l5(m):
    """Observations that arrive behind the watermark (ten days), counted
    per day and arrival.  The newest part of the history arrives first, then a
    middle part, then the oldest in two parts."""
    spark = m.spark
    path, out = _scratch(spark, "arrivals"), _scratch(spark, "late")
    h = m.price_history
    at = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    part = (F.when(F.col("scraped_at") >= at("2024-01-22"), 1).when(F.col("scraped_at") >= at("2024-01-15"), 2)
            .when(F.col("id") % 4 == 0, 4).otherwise(3))
    h.withColumn("arrival", part).write.partitionBy("arrival").parquet(path)
    name = S.checkpoint_location(spark, "l5")
    landed = _scratch(spark, "landed")
    for k in (1, 2, 3, 4):      # one drained run per arrival, on one checkpoint
        spark.read.schema(h.schema).parquet(f"{path}/arrival={k}").write.mode("append").parquet(landed)
        stream = S.event_time(S.price_stream(spark, landed, h.schema, max_files=None))
        (stream.writeStream.foreachBatch(S.count_late(out, timedelta(days=10))).option("checkpointLocation", name)
         .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.parquet(f"{out}/rows")
    return (rows.groupBy(F.date_trunc("day", "scraped_at").cast("timestamp_ntz").alias("day"), F.col("batch").cast("bigint").alias("batch"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late")))


@query("L6_sink_idempotent", f"SELECT {QA._DET_COLS.replace('reason,', '').replace('CAST(threshold_percent AS DOUBLE) AS threshold_percent,', '')} FROM detections",
       ("detections",))
def l6(m):
    """History and alerts of the stream, committed together per batch.  The
    stream is run again from an empty checkpoint onto the same tables, as after
    the loss of its checkpoint: every batch is there already, and none is
    written twice."""
    spark = m.spark
    root = _scratch(spark, "alerts_sink")
    run_alerts(model_price_history_stream(spark, m.sf_dir), m.competitors, m.products, root)
    tables = run_alerts(model_price_history_stream(spark, m.sf_dir), m.competitors, m.products, root,
                        checkpoint=f"{root}/checkpoint-2")
    return last_revision(tables.read("alerts")).withColumn("detected_at", F.col("detected_at").cast("timestamp_ntz"))


@query("L6_sink_history", """SELECT id, competitor_id, CAST(price AS DOUBLE) AS price, currency, scraped_at, scrape_status
FROM price_history""", ("price_history",))
def l6_history(m):
    """The history as the same batches committed it."""
    tables = run_alerts(model_price_history_stream(m.spark, m.sf_dir), m.competitors, m.products,
                        _scratch(m.spark, "history_sink"))
    h = tables.read("history")
    return h.select("id", "competitor_id", "price", "currency", F.col("scraped_at").cast("timestamp_ntz").alias("scraped_at"),
                    "scrape_status")


from .q_insights import M6_SQL  # noqa: E402
ORACLE["A10_append_insights"] = with_models(f"""SELECT product_id, insight_text, insight_type, confidence_score,
  TIMESTAMP '2024-01-31 00:00:00' AS generated_at FROM ({M6_SQL}) t""", "insights", "products")
