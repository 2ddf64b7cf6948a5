"""Registered queries: dashboard, lists, joins and filters (B, C, D, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import alerts as A
from ..operators import dashboard as DB
from .registry import AS_OF, query


@query("D1_dashboard_stats", """
SELECT u.user_id, coalesce(p.n, 0) AS total_products, coalesce(c.n, 0) AS total_competitors,
       coalesce(a.n, 0) AS alerts_this_week, coalesce(i.n, 0) AS total_insights
FROM users u
LEFT JOIN (SELECT user_id, count(*) AS n FROM products GROUP BY user_id) p ON p.user_id = u.user_id
LEFT JOIN (SELECT pr.user_id, count(*) AS n FROM competitors c JOIN products pr ON pr.id = c.product_id GROUP BY pr.user_id) c
  ON c.user_id = u.user_id
LEFT JOIN (SELECT user_id, count(*) AS n FROM pending_alerts
           WHERE detected_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY user_id) a ON a.user_id = u.user_id
LEFT JOIN (SELECT pr.user_id, count(*) AS n FROM insights i JOIN products pr ON pr.id = i.product_id GROUP BY pr.user_id) i
  ON i.user_id = u.user_id""", ("users", "products", "competitors", "pending_alerts", "insights"))
def d1(m):
    """Dashboard counters per user."""
    return DB.dashboard_stats(m.users, m.products, m.competitors, m.pending_alerts, m.insights, AS_OF)


@query("D7_competitor_count", """
SELECT p.id AS product_id, coalesce(c.n, 0) AS competitor_count
FROM products p LEFT JOIN (SELECT product_id, count(*) AS n FROM competitors GROUP BY product_id) c ON c.product_id = p.id""",
       ("products", "competitors"))
def d7(m):
    """Competitors per product (0 kept)."""
    return DB.competitor_count(m.products, m.competitors).select("product_id", "competitor_count")


@query("F1_recent_activity", """
SELECT id, user_id, type, product_id, product_name, retailer, old_price, new_price, change_percent, detected_at, pos FROM (
  SELECT a.id, a.user_id, a.alert_type AS type, p.id AS product_id, coalesce(p.product_name, 'Unknown') AS product_name,
         CASE WHEN c.id IS NULL THEN 'Unknown' ELSE c.retailer_name END AS retailer,
         CAST(CASE WHEN a.old_price <> 0 THEN a.old_price END AS DOUBLE) AS old_price,
         CAST(CASE WHEN a.new_price <> 0 THEN a.new_price END AS DOUBLE) AS new_price,
         CAST(CASE WHEN a.price_change_percent <> 0 THEN a.price_change_percent END AS DOUBLE) AS change_percent,
         a.detected_at, row_number() OVER (PARTITION BY a.user_id ORDER BY a.detected_at DESC, a.id DESC) AS pos
  FROM pending_alerts a LEFT JOIN products p ON p.id = a.product_id LEFT JOIN competitors c ON c.id = a.competitor_id) t
WHERE pos <= 10""", ("pending_alerts", "products", "competitors"))
def f1(m):
    """10 newest alerts per user (any state) as dashboard activity."""
    return DB.recent_activity(m.pending_alerts, m.products, m.competitors, 10)


@query("F2_recent_products", """
SELECT p.id AS product_id, p.user_id, p.product_name, coalesce(c.n, 0) AS competitor_count, p.pos FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS pos FROM products) p
LEFT JOIN (SELECT product_id, count(*) AS n FROM competitors GROUP BY product_id) c ON c.product_id = p.id
WHERE p.pos <= 5""", ("products", "competitors"))
def f2(m):
    """5 newest products per user with competitor counts."""
    cc = DB.competitor_count(m.products, m.competitors)
    return DB.top_per_group(cc, "user_id", [F.col("created_at").desc(), F.col("product_id").desc()], 5).select(
        "product_id", "user_id", "product_name", "competitor_count", "pos")


@query("F3_recent_insights", """
SELECT id, user_id, product_name, insight_type, pos FROM (
  SELECT i.id, p.user_id, p.product_name, i.insight_type,
         row_number() OVER (PARTITION BY p.user_id ORDER BY i.generated_at DESC, i.id DESC) AS pos
  FROM insights i JOIN products p ON p.id = i.product_id) t WHERE pos <= 50""", ("insights", "products"))
def f3(m):
    """50 newest insights per user with the product name."""
    j = m.insights.join(m.products.select(F.col("id").alias("product_id"), "user_id", "product_name"), "product_id")
    return DB.top_per_group(j, "user_id", [F.col("generated_at").desc(), F.col("id").desc()], 50).select(
        "id", "user_id", "product_name", "insight_type", "pos")


@query("F4_alert_history_top", """
SELECT id, user_id, alerts_count, email_status, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY digest_sent_at DESC, id DESC) AS pos FROM alert_history) t
WHERE pos <= 20""", ("alert_history",))
def f4(m):
    """newest 20 digest history rows per user."""
    return DB.top_per_group(m.alert_history, "user_id", [F.col("digest_sent_at").desc(), F.col("id").desc()], 20).select(
        "id", "user_id", "alerts_count", "email_status", "pos")


@query("F7_product_list", """
SELECT p.id, p.user_id, p.product_name, p.list_pos, p.total, coalesce(c.ids, []) AS competitor_ids FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS list_pos,
         count(*) OVER (PARTITION BY user_id) AS total FROM products WHERE is_active) p
LEFT JOIN (SELECT product_id, list(id ORDER BY created_at, id) AS ids FROM competitors GROUP BY product_id) c
  ON c.product_id = p.id""", ("products", "competitors"))
def f7(m):
    """F7 + C1: active products newest first with their competitors (ordered)."""
    pl = DB.product_list(m.products, m.competitors)
    return pl.select("id", "user_id", "product_name", "list_pos", "total",
                     F.transform("competitors", lambda c: c["id"]).alias("competitor_ids"))


@query("C1_product_competitors", """
SELECT p.id, coalesce(c.n, 0) AS n_competitors, coalesce(c.urls, []) AS urls FROM products p
LEFT JOIN (SELECT product_id, count(*) AS n, list(url ORDER BY created_at, id) AS urls FROM competitors GROUP BY product_id) c
  ON c.product_id = p.id""", ("products", "competitors"))
def c1(m):
    """Product with its ordered competitor array (empty kept)."""
    pc = DB.product_competitors(m.products, m.competitors)
    return pc.select("id", F.size("competitors").cast("bigint").alias("n_competitors"),
                     F.transform("competitors", lambda c: c["url"]).alias("urls"))


@query("C2_owned_inner", """
SELECT c.id, p.user_id, p.product_name FROM competitors c JOIN products p ON p.id = c.product_id""",
       ("competitors", "products"))
def c2(m):
    """Competitors joined to their owning product (inner)."""
    return DB.owned_competitors(m.competitors, m.products).select("id", "user_id", "product_name")


@query("C8_no_insight_today", """
SELECT id FROM products p WHERE NOT EXISTS (SELECT 1 FROM insights i WHERE i.product_id = p.id
  AND i.generated_at >= date_trunc('day', TIMESTAMP '2024-01-31 00:00:00'))""", ("products", "insights"))
def c8(m):
    """Products that may get insights today."""
    return DB.no_insight_today(m.products, m.insights, AS_OF).select("id")


@query("C9_scrape_worklist", """
SELECT c.id, c.url FROM competitors c WHERE c.product_id IN (SELECT id FROM products WHERE is_active)""",
       ("competitors", "products"))
def c9(m):
    """Competitors of active products."""
    return DB.scrape_worklist(m.competitors, m.products).select("id", "url")


@query("C12_export_names", r"""
SELECT p.id, coalesce(CASE WHEN c.retailer_name <> '' THEN c.retailer_name END,
   CASE WHEN regexp_replace(lower(regexp_extract(c.url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') = ''
        THEN 'Unknown'
        ELSE regexp_replace(lower(regexp_extract(c.url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') END,
   'Unknown') AS competitor
FROM price_history p LEFT JOIN competitors c ON c.id = p.competitor_id""", ("price_history", "competitors"))
def c12(m):
    """History rows with the competitor display name (export rules)."""
    c = m.competitors.select(F.col("id").alias("competitor_id"),
                             U.retailer_or_domain(F.col("retailer_name"), F.col("url"), "export").alias("competitor"))
    return (m.price_history.join(c, "competitor_id", "left")
            .select("id", F.coalesce("competitor", F.lit("Unknown")).alias("competitor")))


@query("B1_tenant_filter", "SELECT id, product_name FROM products WHERE user_id = 2", ("products",))
def b1(m):
    """B1: one user's products."""
    return m.products.filter(F.col("user_id") == 2).select("id", "product_name")


@query("B2_active_filter", "SELECT id FROM products WHERE is_active", ("products",))
def b2(m):
    """B2: active products."""
    return m.products.filter("is_active").select("id")


@query("B8_pending_filter", "SELECT id FROM pending_alerts WHERE NOT included_in_digest", ("pending_alerts",))
def b8(m):
    """Unsent alerts."""
    return m.pending_alerts.filter(~F.col("included_in_digest")).select("id")


@query("B9_insight_type_filter", "SELECT id FROM insights WHERE insight_type = 'alert'", ("insights",))
def b9(m):
    """Insights of one type."""
    return m.insights.filter(F.col("insight_type") == "alert").select("id")


@query("B10_recent_alerts", """
SELECT id FROM pending_alerts WHERE detected_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""",
       ("pending_alerts",))
def b10(m):
    """Alerts of the last 7 days, sent or not."""
    from ..operators.history import last_n_days
    return last_n_days(m.pending_alerts, AS_OF, 7, ts="detected_at").select("id")


@query("B11_in_list", """
SELECT id FROM price_history WHERE competitor_id IN (SELECT id FROM competitors WHERE product_id = 3)""",
       ("price_history", "competitors"))
def b11(m):
    """Rows whose competitor is in a derived id set (semi join, never a
    collected list)."""
    ids = m.competitors.filter(F.col("product_id") == 3).select(F.col("id").alias("competitor_id"))
    return m.price_history.join(ids, "competitor_id", "left_semi").select("id")


@query("B12_point_lookup", "SELECT id, product_name, is_active FROM products WHERE id = 7", ("products",))
def b12(m):
    """One product by id (empty = not found)."""
    return m.products.filter(F.col("id") == 7).select("id", "product_name", "is_active")


@query("D13_scrape_success_rate", r"""
SELECT CAST(p.scraped_at AS DATE) AS day,
       regexp_replace(lower(regexp_extract(c.url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') AS domain,
       count(*) AS attempts, CAST(count_if(p.scrape_status = 'success') AS BIGINT) AS successes,
       avg(CASE WHEN p.scrape_status = 'success' THEN 1 ELSE 0 END) AS success_rate
FROM price_history p JOIN competitors c ON c.id = p.competitor_id GROUP BY 1, 2""", ("price_history", "competitors"))
def d13(m):
    """Scrape success share per day and domain."""
    return DB.scrape_success_rate(m.price_history, m.competitors)


def _d10_sql(size: int) -> str:
    return f"""
WITH t AS (SELECT product_id, count(*) AS total FROM competitors GROUP BY 1),
s AS (SELECT c.product_id, CAST(p.scraped_at AS DATE) AS run_day, p.competitor_id, p.scrape_status,
        concat_ws('|', c.id, coalesce(nullif(c.retailer_name, ''), replace(regexp_extract(c.url, '://([^/]*)', 1), 'www.', '')),
                  coalesce(CAST(p.price AS VARCHAR), ''), p.currency, p.scrape_status, coalesce(p.error_message, '')) AS result,
        row_number() OVER (PARTITION BY c.product_id, CAST(p.scraped_at AS DATE)
                           ORDER BY c.id, p.price NULLS FIRST, p.currency, p.scrape_status) AS pos
      FROM price_history p JOIN competitors c ON c.id = p.competitor_id),
r AS (SELECT product_id, run_day, count(DISTINCT competitor_id) AS completed,
             CAST(count_if(scrape_status = 'failed') AS BIGINT) AS failed_items FROM s GROUP BY 1, 2),
k AS (SELECT product_id, run_day, (pos - 1) // {size} AS chunk, list(result ORDER BY pos) AS results FROM s GROUP BY 1, 2, 3)
SELECT r.product_id, r.run_day, completed, failed_items, total, chunk, results,
       CASE WHEN completed >= total THEN 'completed' ELSE 'scraping' END AS status
FROM r JOIN t USING (product_id) JOIN k ON k.product_id = r.product_id AND k.run_day = r.run_day"""


@query("D10_run_progress", _d10_sql(1000), ("price_history", "competitors"))
def d10(m, size=1000):
    """Per run (product, day) completed / total / failed, status, and the
    results, at most 1,000 a row."""
    r = DB.run_progress(m.price_history, m.competitors, size)
    text = lambda x: F.concat_ws("|", x["competitor_id"].cast("string"), x["retailer"], F.coalesce(x["price"], F.lit("")),
                                 x["currency"], x["status"], F.coalesce(x["error_message"], F.lit("")))
    return r.withColumn("results", F.transform("results", text))


@query("D10_run_chunks", _d10_sql(3), ("price_history", "competitors"))
def d10c(m):
    """D10 with three results a row."""
    return d10(m, 3)
