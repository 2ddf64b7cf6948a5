"""Registered queries: price-history reads (B, C, D, E, F families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import history as H
from .registry import AS_OF, query

TODAY = "2024-01-30 18:00:00"   # an evaluation time inside the data, for "today" filters

_DOMAIN_STRIP = r"regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1), '^www\.', '')"


@query("E1_previous_price", """
SELECT id, competitor_id, CAST(price AS DOUBLE) AS price, currency,
       CAST(old_price AS DOUBLE) AS old_price, old_currency
FROM ph_prev""", ("ph_prev",))
def e1(m):
    """Previous successful non-null price per observation."""
    return H.with_previous_price(m.price_history).select("id", "competitor_id", "price", "currency",
                                                         "old_price", "old_currency")


@query("A1_load_tables", """
SELECT id, competitor_id, CAST(price AS DOUBLE) AS price, currency, scraped_at, scrape_status, error_message
FROM price_history""", ("price_history",))
def a1(m):
    """A1: the price_history table written with its fixed schema and scanned back
    (column pruning and predicate pushdown reach the parquet scan)."""
    import os
    import uuid
    from pyspark.sql import types as T
    from ..config import ensure_checkpoint_dir
    from ..sources.tables import load_table
    path = os.path.join(ensure_checkpoint_dir(m.spark), "tables", f"price_history-{uuid.uuid4().hex[:10]}")
    m.price_history.write.mode("overwrite").parquet(path)
    return load_table(m.spark, path, "price_history", key=T.LongType())


_A1_TABLES = ("products", "competitors", "price_history", "insights", "tracking_jobs", "pending_alerts",
              "user_alert_settings", "alert_history")


@query("A1_load_all_tables", """
WITH tracking_jobs AS (SELECT id, user_id, id AS product_group_id, CAST(1 AS INTEGER) AS total_items, CAST(1 AS INTEGER) AS completed_items,
  CAST(0 AS INTEGER) AS failed_items, 'completed' AS status, created_at, updated_at FROM products)
SELECT 'products' AS tbl, id AS key, concat_ws('|', user_id, product_name, is_active, created_at, updated_at) AS cells FROM products
UNION ALL SELECT 'competitors', id, concat_ws('|', product_id, url, retailer_name, alert_threshold_percent, expected_currency, created_at) FROM competitors
UNION ALL SELECT 'price_history', id, concat_ws('|', competitor_id, price, currency, scraped_at, scrape_status, error_message) FROM price_history
UNION ALL SELECT 'insights', id, concat_ws('|', product_id, insight_text, insight_type, confidence_score, generated_at) FROM insights
UNION ALL SELECT 'tracking_jobs', id, concat_ws('|', user_id, product_group_id, total_items, completed_items, failed_items, status, created_at, updated_at) FROM tracking_jobs
UNION ALL SELECT 'pending_alerts', id, concat_ws('|', user_id, product_id, competitor_id, alert_type, old_price, new_price,
  price_change_percent, threshold_percent, old_currency, new_currency, included_in_digest, detected_at) FROM pending_alerts
UNION ALL SELECT 'user_alert_settings', user_id, concat_ws('|', email_enabled, digest_frequency_hours, alert_price_drop,
  alert_price_increase, last_digest_sent_at, created_at, updated_at) FROM user_alert_settings
UNION ALL SELECT 'alert_history', id, concat_ws('|', user_id, digest_sent_at, alerts_count, email_status, error_message) FROM alert_history""",
       ("products", "competitors", "price_history", "insights", "pending_alerts", "user_alert_settings", "alert_history"))
def a1_all(m):
    """A1: every application table written, and scanned back with its fixed
    schema; all cells of all rows as text."""
    import os
    import uuid
    from pyspark.sql import types as T
    from ..config import ensure_checkpoint_dir
    from ..schemas import table_schemas
    from ..sources.tables import load_table
    base = os.path.join(ensure_checkpoint_dir(m.spark), "tables", f"all-{uuid.uuid4().hex[:10]}")
    jobs = m.products.select("id", "user_id", F.col("id").alias("product_group_id"), F.lit(1).alias("total_items"),
                             F.lit(1).alias("completed_items"), F.lit(0).alias("failed_items"),
                             F.lit("completed").alias("status"), "created_at", "updated_at")
    out = None
    for name in _A1_TABLES:
        table = jobs if name == "tracking_jobs" else getattr(m, name)
        schema = table_schemas(T.LongType())[name]
        table.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{base}/{name}")
        back = load_table(m.spark, f"{base}/{name}", name, key=T.LongType())
        first, *rest = [f.name for f in schema]
        rows = back.select(F.lit(name).alias("tbl"), F.col(first).alias("key"),
                           F.concat_ws("|", *[F.col(c).cast("string") for c in rest]).alias("cells"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("B3_last_n_days", """
SELECT id, competitor_id, scraped_at FROM price_history
WHERE scraped_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""", ("price_history",))
def b3(m):
    """Observations of the last 7 days before as_of."""
    return H.last_n_days(m.price_history, AS_OF, 7).select("id", "competitor_id", "scraped_at")


@query("B4_success_price", """
SELECT id, competitor_id, CAST(price AS DOUBLE) AS price FROM price_history
WHERE scrape_status = 'success' AND price IS NOT NULL""", ("price_history",))
def b4(m):
    """Successful observations with a price."""
    return H.success_price(m.price_history).select("id", "competitor_id", "price")


@query("B7_scraped_today", f"""
SELECT id, competitor_id, scrape_status FROM price_history
WHERE scraped_at >= date_trunc('day', TIMESTAMP '{TODAY}')""", ("price_history",))
def b7(m):
    """Observations since UTC midnight."""
    return H.since_midnight(m.price_history, TODAY).select("id", "competitor_id", "scrape_status")


@query("C3_owned_semi", """
SELECT id, competitor_id FROM price_history
WHERE competitor_id IN (SELECT id FROM competitors WHERE product_id IN (SELECT id FROM products WHERE user_id = 1))""",
       ("price_history", "competitors", "products"))
def c3(m):
    """Rows a user may read (row-level security as semi joins)."""
    return H.owned_history(m.price_history, m.competitors, m.products, 1).select("id", "competitor_id")


@query("C7_not_scraped_today", f"""
SELECT id FROM competitors c WHERE NOT EXISTS (
  SELECT 1 FROM price_history p WHERE p.competitor_id = c.id
  AND p.scraped_at >= date_trunc('day', TIMESTAMP '{TODAY}'))""", ("price_history", "competitors"))
def c7(m):
    """Competitors without an observation (any status) since midnight."""
    today = H.since_midnight(m.price_history, TODAY).select(F.col("competitor_id").alias("id"))
    return m.competitors.select("id").join(today, "id", "left_anti")


@query("E2_latest_price", """
SELECT c.id, CAST(l.price AS DOUBLE) AS latest_price, l.currency AS latest_currency,
       l.scrape_status AS latest_status, l.scraped_at AS latest_scraped_at,
       CASE WHEN l.scrape_status IS NULL THEN 'Pending...'
            WHEN l.scrape_status = 'success' AND coalesce(l.price <> 0, false) THEN '$' || CAST(CAST(l.price AS DECIMAL(12,2)) AS VARCHAR)
            ELSE 'Failed' END AS display
FROM competitors c LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY scraped_at DESC, id DESC) AS rn
  FROM price_history) l ON l.competitor_id = c.id AND l.rn = 1""", ("price_history", "competitors"))
def e2(m):
    """Latest observation of any status per competitor, with display text."""
    return H.latest_price_display(m.competitors, m.price_history).select(
        "id", "latest_price", "latest_currency", "latest_status", "latest_scraped_at", "display")


_STATS_SQL = """
w AS (SELECT * FROM price_history WHERE scraped_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY),
ok AS (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY scraped_at, id) AS r_asc,
              row_number() OVER (PARTITION BY competitor_id ORDER BY scraped_at DESC, id DESC) AS r_desc
       FROM w WHERE scrape_status = 'success' AND price IS NOT NULL AND price <> 0),
a AS (SELECT competitor_id, count(*) AS data_points, min(scraped_at) AS first_seen, max(scraped_at) AS last_seen
      FROM w GROUP BY competitor_id),
s AS (SELECT competitor_id, count(price) AS success_points, sum(price) AS sum_price, min(price) AS min_price,
             max(price) AS max_price, max(CASE WHEN r_desc = 1 THEN price END) AS current_price,
             max(CASE WHEN r_asc = 1 THEN price END) AS first_price,
             sum(price * price) AS s2
      FROM ok GROUP BY competitor_id),
stats AS (SELECT c.id AS competitor_id, c.product_id, c.url, c.retailer_name, c.created_at,
       coalesce(a.data_points, 0) AS data_points, s.success_points, s.min_price, s.max_price, s.current_price,
       s.first_price, a.first_seen, a.last_seen, s.sum_price, s.s2,
       CAST(s.sum_price AS DOUBLE) / s.success_points AS average_price,
       CASE WHEN s.first_price > 0 THEN CAST((s.current_price - s.first_price) * 100 AS DOUBLE) / CAST(s.first_price AS DOUBLE) END
         AS price_change_percent
FROM competitors c LEFT JOIN a ON a.competitor_id = c.id LEFT JOIN s ON s.competitor_id = c.id)"""


@query("D2_competitor_stats", f"""
WITH {_STATS_SQL}
SELECT competitor_id, product_id, data_points, coalesce(success_points, 0) AS success_points,
       CAST(min_price AS DOUBLE) AS min_price, CAST(max_price AS DOUBLE) AS max_price,
       CAST(current_price AS DOUBLE) AS current_price, CAST(first_price AS DOUBLE) AS first_price,
       average_price, price_change_percent, first_seen, last_seen FROM stats""",
       ("price_history", "competitors"))
def d2(m):
    """Per-competitor window statistics (all competitors kept)."""
    s = H.competitor_stats(m.competitors, m.price_history, AS_OF, 30)
    return s.select("competitor_id", "product_id", "data_points",
                    F.coalesce("success_points", F.lit(0)).alias("success_points"), "min_price", "max_price",
                    "current_price", "first_price", "average_price", "price_change_percent", "first_seen", "last_seen")


@query("D9_price_variance", f"""
WITH {_STATS_SQL}
SELECT competitor_id,
       CAST(success_points * s2 - sum_price * sum_price AS DOUBLE) / CAST(success_points * success_points AS DOUBLE)
         AS price_variance
FROM stats WHERE success_points > 0""", ("price_history", "competitors"))
def d9(m):
    """Population variance of successful prices per competitor, from exact
    decimal moments (n*sum(x^2) - sum(x)^2) / n^2."""
    return H.price_variance(m.price_history, AS_OF, 30)


@query("D3_product_range", """
SELECT c.product_id, min(p.scraped_at) AS date_range_start, max(p.scraped_at) AS date_range_end,
       count(*) AS total_data_points
FROM price_history p JOIN competitors c ON c.id = p.competitor_id
WHERE p.scraped_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY GROUP BY c.product_id""",
       ("price_history", "competitors"))
def d3(m):
    """D3: per product earliest / latest timestamp and all rows in the window."""
    return H.product_range(m.price_history, m.competitors, AS_OF, 30)


@query("D4_product_summary", f"""
WITH {_STATS_SQL},
n AS (SELECT *, coalesce(CASE WHEN retailer_name <> '' THEN retailer_name END, {_DOMAIN_STRIP}) AS competitor_name
      FROM stats),
lo AS (SELECT product_id, competitor_name AS lowest_competitor, min_price AS lowest_price,
         row_number() OVER (PARTITION BY product_id ORDER BY min_price, created_at, competitor_id) AS r
       FROM n WHERE min_price IS NOT NULL),
hi AS (SELECT product_id, competitor_name AS highest_competitor, max_price AS highest_price,
         row_number() OVER (PARTITION BY product_id ORDER BY max_price DESC, created_at, competitor_id) AS r
       FROM n WHERE max_price > 0),
g AS (SELECT product_id, count(*) AS competitor_count, sum(data_points) AS total_points,
             coalesce(sum(price_change_percent), 0.0) / greatest(count(*), 1) AS avg_change_percent
      FROM n GROUP BY product_id)
SELECT g.product_id, CAST(lo.lowest_price AS DOUBLE) AS lowest_price, lo.lowest_competitor,
       CAST(hi.highest_price AS DOUBLE) AS highest_price, hi.highest_competitor,
       g.competitor_count, CAST(g.total_points AS BIGINT) AS total_points, g.avg_change_percent
FROM g LEFT JOIN lo ON lo.product_id = g.product_id AND lo.r = 1
       LEFT JOIN hi ON hi.product_id = g.product_id AND hi.r = 1""", ("price_history", "competitors"))
def d4(m):
    """Product summary over the competitors' statistics."""
    s = H.competitor_stats(m.competitors, m.price_history, AS_OF, 30)
    s = s.withColumn("competitor_name", U.retailer_or_domain(F.col("retailer_name"), F.col("url"), "strip"))
    return H.product_summary(s).withColumn("total_points", F.col("total_points").cast("bigint"))


def _d11_sql(size: int) -> str:
    return f"""
SELECT competitor_id, day, (pos - 1) // {size} AS chunk, list(id ORDER BY pos) AS ids,
       list(CAST(CASE WHEN price <> 0 THEN price END AS DOUBLE) ORDER BY pos) AS prices, list(scrape_status ORDER BY pos) AS statuses
FROM (SELECT *, CAST(scraped_at AS DATE) AS day,
        row_number() OVER (PARTITION BY competitor_id, CAST(scraped_at AS DATE) ORDER BY scraped_at, id) AS pos
      FROM price_history WHERE scraped_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY) t GROUP BY 1, 2, 3"""


def _d11(s):
    return s.select("competitor_id", "day", "chunk", F.transform("data_points", lambda p: p["id"]).alias("ids"),
                    F.transform("data_points", lambda p: p["price"].cast("double")).alias("prices"),
                    F.transform("data_points", lambda p: p["status"]).alias("statuses"))


@query("D11_series_collect", _d11_sql(1000), ("price_history",))
def d11(m):
    """Ordered chart points per competitor and day (failures kept as
    gaps), at most 1,000 a row."""
    return _d11(H.series_points(m.price_history, AS_OF, 30))


@query("D11_series_chunks", _d11_sql(2), ("price_history",))
def d11c(m):
    """D11 with rows of two points."""
    return _d11(H.series_points(m.price_history, AS_OF, 30, size=2))


@query("E3_last_n_points", """
SELECT competitor_id, id, CAST(price AS DOUBLE) AS price,
       row_number() OVER (PARTITION BY competitor_id ORDER BY scraped_at, id) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY scraped_at DESC, id DESC) AS rd FROM price_history
  WHERE scrape_status = 'success' AND price IS NOT NULL AND price <> 0) t
WHERE rd <= 10""", ("price_history",))
def e3(m):
    """The newest 10 successful points per competitor, ascending."""
    return H.last_n_points(m.price_history, 10).select("competitor_id", "id", "price", "pos")


@query("E6_first_last", """
SELECT competitor_id, CAST(max(CASE WHEN ra = 1 THEN price END) AS DOUBLE) AS first_price,
       CAST(max(CASE WHEN rd = 1 THEN price END) AS DOUBLE) AS last_price FROM (
  SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY scraped_at, id) AS ra,
            row_number() OVER (PARTITION BY competitor_id ORDER BY scraped_at DESC, id DESC) AS rd
  FROM price_history WHERE scrape_status = 'success' AND price IS NOT NULL AND price <> 0
  AND scraped_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY) t GROUP BY competitor_id""",
       ("price_history",))
def e6(m):
    """First and last successful price per competitor in the window."""
    return H.first_last(m.price_history, AS_OF, 30)


@query("E7_indexed_series", """
SELECT id, competitor_id, CAST(price AS DOUBLE) AS price, CAST(first_price AS DOUBLE) AS first_price,
       CASE WHEN first_price > 0 THEN CAST((price - first_price) * 100 AS DOUBLE) / CAST(first_price AS DOUBLE) END
         AS change_vs_first
FROM (SELECT *, first_value(price) OVER (PARTITION BY competitor_id ORDER BY scraped_at, id) AS first_price
      FROM price_history WHERE scrape_status = 'success' AND price IS NOT NULL AND price <> 0
      AND scraped_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY) t""", ("price_history",))
def e7(m):
    """Every successful point's change vs the window's first point."""
    return H.indexed_series(m.price_history, AS_OF, 30).select("id", "competitor_id", "price", "first_price",
                                                                "change_vs_first")


@query("F5_history_page", """
SELECT product_id, id, competitor_id, row_pos, total FROM (
  SELECT c.product_id, p.id, p.competitor_id,
         row_number() OVER (PARTITION BY c.product_id ORDER BY p.scraped_at DESC, p.id DESC) - 1 AS row_pos,
         count(*) OVER (PARTITION BY c.product_id) AS total
  FROM price_history p JOIN competitors c ON c.id = p.competitor_id) t
WHERE row_pos >= 20 AND row_pos < 70""", ("price_history", "competitors"))
def f5(m):
    """F5 + D14: newest-first page (offset 20, limit 50) of every product's
    history with the exact total."""
    return H.history_page(m.price_history, m.competitors, None, limit=50, offset=20).select(
        "product_id", "id", "competitor_id", "row_pos", "total")


@query("D5_insight_features", """
WITH w AS (SELECT * FROM price_history WHERE scraped_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY
           AND scrape_status = 'success' AND price IS NOT NULL AND price <> 0),
s AS (SELECT competitor_id, count(*) AS price_count, sum(price) AS sp, min(price) AS min_price, max(price) AS max_price,
             arg_min(price, scraped_at) AS first_price, arg_max(price, scraped_at) AS current_price
      FROM w GROUP BY competitor_id),
j AS (SELECT s.*, c.product_id, CAST(round(sp * 100) AS BIGINT) AS sc FROM s JOIN competitors c ON c.id = s.competitor_id)
SELECT competitor_id, product_id, price_count, CAST(min_price AS DOUBLE) AS min_price, CAST(max_price AS DOUBLE) AS max_price,
       CAST(first_price AS DOUBLE) AS first_price, CAST(current_price AS DOUBLE) AS current_price,
       CAST(CAST((sc // price_count) + CASE WHEN 2 * (sc % price_count) > price_count
                 OR (2 * (sc % price_count) = price_count AND (sc // price_count) % 2 = 1) THEN 1 ELSE 0 END
            AS DECIMAL(18,0)) * 0.01 AS DOUBLE) AS average_price,
       count(*) OVER (PARTITION BY product_id) AS total_competitors,
       (SELECT list(CAST(x.price AS DOUBLE) || ' ' || x.currency || ' ' || strftime(x.scraped_at, '%Y-%m-%d %H:%M:%S') ORDER BY x.scraped_at, x.id)
        FROM (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY scraped_at DESC, id DESC) AS rn FROM w) x
        WHERE x.rn <= 10 AND x.competitor_id = j.competitor_id) AS points
FROM j""", ("price_history", "competitors"))
def d5(m):
    """Insight input features per competitor, its last ten points as text."""
    f = H.insight_features(m.price_history, m.competitors, AS_OF, 30)
    return f.select("competitor_id", "product_id", "price_count", "min_price", "max_price", "first_price",
                    "current_price", "average_price", "total_competitors",
                    F.transform("price_history", lambda p: F.concat_ws(
                        " ", p["price"].cast("double").cast("string"), p["currency"],
                        F.date_format(p["scraped_at"], "yyyy-MM-dd HH:mm:ss"))).alias("points"))
