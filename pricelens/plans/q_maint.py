"""Registered queries: table maintenance and sink frames (K*, A7-A12)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..config import ensure_checkpoint_dir
from ..operators import maintenance as MT
from ..sources import catalog as CT
from ..sources.landed import landed_catalog
from .q_catalog import _EXP
from .q_history import _DOMAIN_STRIP, _STATS_SQL
from .registry import AS_OF, query


def _track_items(m):
    best = CT.first_match_source(CT.normalise(landed_catalog(m.catalog)))
    s = F.regexp_extract("store", r"store(\d+)", 1).cast("bigint")
    return (best.filter(F.col("in_stock"))
            .select(s.alias("request_id"), (s % 5).alias("user_id"),
                    F.concat(F.lit("Group "), s.cast("string"), F.lit(" <main>")).alias("group_name"),
                    F.when(s == 4, F.lit(150)).otherwise(F.lit(5) * (s % 3)).alias("threshold"),
                    (F.col("page") * 100000 + F.col("ordinal")).alias("ordinal"),
                    F.col("product_url").alias("url"), "price", "currency"))


@query("K1_track_products", f"""WITH {_EXP},
it AS (SELECT CAST(regexp_extract(store, 'store(\\d+)', 1) AS BIGINT) AS request_id, price FROM best WHERE in_stock)
SELECT request_id, count(*) AS products_added, count(price) AS prices_stored FROM it WHERE request_id <> 4 GROUP BY 1""",
       ("catalog",))
def k1(m):
    """K1: tracking requests (one per store, the in-stock discovered products
    selected) -> product, competitors and initial prices; a request with
    threshold 150 is rejected."""
    return MT.track_products(_track_items(m), AS_OF)["summary"]


@query("K1_track_competitors", f"""WITH {_EXP},
it AS (SELECT CAST(regexp_extract(store, 'store(\\d+)', 1) AS BIGINT) AS request_id, page * 100000 + ordinal AS ordinal, product_url FROM best
       WHERE in_stock)
SELECT request_id * 4294967296 + ordinal AS id, request_id AS product_id,
       regexp_replace(lower(regexp_extract(product_url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', '') AS retailer_name,
       CAST(5 * (request_id % 3) AS DOUBLE) AS alert_threshold_percent
FROM it WHERE request_id <> 4""", ("catalog",))
def k1c(m):
    """K1: the competitors written by the tracking requests."""
    return MT.track_products(_track_items(m), AS_OF)["competitors"].select(
        "id", "product_id", "retailer_name", "alert_threshold_percent")


@query("K1_track_results", f"""WITH {_EXP},
it AS (SELECT CAST(regexp_extract(store, 'store(\\d+)', 1) AS BIGINT) AS request_id, page * 100000 + ordinal AS ordinal FROM best WHERE in_stock),
r AS (SELECT request_id, count(*) AS n_items, min(ordinal) AS first FROM it GROUP BY 1)
SELECT request_id, request_id % 5 AS user_id, 'Group ' || request_id || ' <main>' AS product_name,
  CASE WHEN request_id = 4 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00' END AS created_at,
  CASE WHEN request_id = 4 THEN 'threshold must be within 0..100' END AS error FROM r""", ("catalog",))
def k1r(m):
    """K1: the products written by the tracking requests, and the requests that
    were rejected with their errors."""
    t = MT.track_products(_track_items(m), AS_OF)
    ok = t["products"].select(F.col("id").alias("request_id"), "user_id", "product_name", "created_at",
                              F.lit(None).cast("string").alias("error"))
    bad = t["rejected"].select("request_id", "user_id", F.col("group_name").alias("product_name"),
                               F.lit(None).cast("timestamp_ntz").alias("created_at"), "error")
    return ok.unionByName(bad)


def _patch(m):
    """Product patches; every sixth product gets a second, later one that
    renames it again and says nothing about the flag."""
    n = m.raw("supplier")
    k = F.col("s_suppkey")
    first = (n.filter((k % 3 == 0) | (k % 4 == 0) | (k % 5 == 1))
             .select(k.cast("bigint").alias("id"), F.lit(1).alias("seq"),
                     F.when(k % 3 == 0, F.concat(F.upper("s_name"), F.lit(" <v2>"))).alias("product_name"),
                     F.when(k % 4 == 0, F.lit(False)).alias("is_active")))
    second = n.filter(k % 6 == 0).select(k.cast("bigint").alias("id"), F.lit(2).alias("seq"),
                                         F.concat(F.lit(" "), F.lower("s_name"), F.lit(" ")).alias("product_name"),
                                         F.lit(None).cast("boolean").alias("is_active"))
    return first.unionByName(second)


@query("K2_update_product", """
WITH patch AS (SELECT CAST(s_suppkey AS BIGINT) AS id,
  CASE WHEN s_suppkey % 6 = 0 THEN lower(s_name) WHEN s_suppkey % 3 = 0 THEN upper(s_name) || ' <v2>' END AS pname,
  CASE WHEN s_suppkey % 4 = 0 THEN false END AS pactive FROM supplier
  WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 OR s_suppkey % 5 = 1)
SELECT p.id, coalesce(replace(replace(trim(v.pname), '<', '&lt;'), '>', '&gt;'), p.product_name) AS product_name,
       coalesce(v.pactive, p.is_active) AS is_active,
       CASE WHEN v.pname IS NOT NULL OR v.pactive IS NOT NULL THEN TIMESTAMP '2024-01-31 00:00:00' ELSE p.updated_at END AS updated_at,
       CASE WHEN v.id IS NOT NULL AND v.pname IS NULL AND v.pactive IS NULL THEN 'No fields to update' END AS error
FROM products p LEFT JOIN patch v ON v.id = p.id""", ("products",))
def k2(m):
    """K2: partial product updates (name escaped, active flag, updated_at),
    some products patched twice, and the errors of empty patches."""
    out, errors = MT.update_products(m.products, _patch(m), AS_OF, order="seq")
    return out.join(errors, "id", "left").select("id", "product_name", "is_active", "updated_at", "error")


@query("K3_soft_delete", """
WITH fresh AS (SELECT DISTINCT c.product_id FROM price_history p JOIN competitors c ON c.id = p.competitor_id
               WHERE p.scrape_status = 'success' AND p.price IS NOT NULL
                 AND p.scraped_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY)
SELECT id, CASE WHEN id NOT IN (SELECT product_id FROM fresh) THEN false ELSE is_active END AS is_active FROM products""",
       ("products", "competitors", "price_history"))
def k3(m):
    """K3: soft delete of stale products (no successful price in 7 days); every
    id is given twice."""
    from ..operators.history import last_n_days, success_price
    fresh = (success_price(last_n_days(m.price_history, AS_OF, 7))
             .join(m.competitors.select(F.col("id").alias("competitor_id"), "product_id"), "competitor_id")
             .select(F.col("product_id").alias("id")))
    stale = m.products.select("id").join(fresh, "id", "left_anti")
    return MT.soft_delete(m.products, stale.unionByName(stale)).select("id", "is_active")


@query("K4_delete_account", """
WITH gp AS (SELECT id FROM products WHERE user_id IN (0, 2)),
gc AS (SELECT id FROM competitors WHERE product_id IN (SELECT id FROM gp))
SELECT 'products' AS tbl, id AS key FROM products WHERE user_id NOT IN (0, 2)
UNION ALL SELECT 'competitors', id FROM competitors WHERE product_id NOT IN (SELECT id FROM gp)
UNION ALL SELECT 'price_history', id FROM price_history WHERE competitor_id NOT IN (SELECT id FROM gc)
UNION ALL SELECT 'insights', id FROM insights WHERE product_id NOT IN (SELECT id FROM gp)
UNION ALL SELECT 'pending_alerts', id FROM pending_alerts WHERE user_id NOT IN (0, 2) AND product_id NOT IN (SELECT id FROM gp)
  AND competitor_id NOT IN (SELECT id FROM gc)
UNION ALL SELECT 'user_alert_settings', user_id FROM user_alert_settings WHERE user_id NOT IN (0, 2)
UNION ALL SELECT 'tracking_jobs', id + 1000000 FROM products WHERE id NOT IN (SELECT id FROM gp)""",
       ("products", "competitors", "price_history", "insights", "pending_alerts", "user_alert_settings"))
def k4(m):
    """K4: account deletion (users 0, the hot one, and 2) with cascades; the
    keys left in each table."""
    jobs = m.products.select((F.col("id") + 1000000).alias("id"), F.col("id").alias("product_group_id"))
    t = {"products": m.products, "competitors": m.competitors, "price_history": m.price_history, "insights": m.insights,
         "pending_alerts": m.pending_alerts, "user_alert_settings": m.user_alert_settings, "tracking_jobs": jobs}
    out = MT.delete_accounts(t, m.users.filter(F.col("user_id").isin(0, 2)))
    r = None
    for name in t:
        key = "user_id" if name == "user_alert_settings" else "id"
        part = out[name].select(F.lit(name).alias("tbl"), F.col(key).alias("key"))
        r = part if r is None else r.unionByName(part)
    return r


@query("K7_accept_currency", """
WITH latest AS (SELECT competitor_id, arg_max(currency, (scraped_at, id)) AS cur FROM price_history
                WHERE scrape_status = 'success' GROUP BY 1),
acc AS (SELECT l.competitor_id, l.cur FROM latest l JOIN competitors c ON c.id = l.competitor_id
        WHERE l.cur <> c.expected_currency)
SELECT a.id, a.included_in_digest OR (acc.competitor_id IS NOT NULL AND a.alert_type = 'currency_changed') AS included_in_digest,
       coalesce(acc.cur, c.expected_currency) AS expected_currency
FROM pending_alerts a JOIN competitors c ON c.id = a.competitor_id LEFT JOIN acc ON acc.competitor_id = a.competitor_id""",
       ("pending_alerts", "competitors", "price_history"))
def k7(m):
    """K7: competitors whose latest successful observation is in another
    currency than expected accept it; their currency alerts are dismissed."""
    latest = (m.price_history.filter(F.col("scrape_status") == "success").groupBy("competitor_id")
              .agg(F.max_by("currency", F.struct("scraped_at", "id")).alias("currency")))
    acc = (latest.join(m.competitors.select(F.col("id").alias("competitor_id"), "expected_currency"), "competitor_id")
           .filter(F.col("currency") != F.col("expected_currency")).select("competitor_id", "currency"))
    # each is preceded by an acceptance of another currency
    acc = (acc.withColumn("seq", F.lit(2))
           .unionByName(acc.select("competitor_id", F.lit("XXX").alias("currency"), F.lit(1).alias("seq"))))
    comps, pend = MT.accept_currency(m.competitors, m.pending_alerts, acc, order="seq")
    return (pend.join(comps.select(F.col("id").alias("competitor_id"), "expected_currency"), "competitor_id")
            .select("id", "included_in_digest", "expected_currency"))


@query("K8_accept_all_currencies", """
WITH sel AS (SELECT * FROM pending_alerts WHERE user_id IN (1, 3) AND alert_type = 'currency_changed'
             AND NOT included_in_digest AND new_currency IS NOT NULL),
latest AS (SELECT competitor_id, arg_max(new_currency, (detected_at, id)) AS cur FROM sel GROUP BY 1)
SELECT c.id, coalesce(l.cur, c.expected_currency) AS expected_currency,
       (SELECT count(*) FROM sel s WHERE s.competitor_id = c.id) AS accepted
FROM competitors c LEFT JOIN latest l ON l.competitor_id = c.id""", ("pending_alerts", "competitors"))
def k8(m):
    """K8: users 1 and 3 accept all pending currency changes."""
    users = m.users.filter(F.col("user_id").isin(1, 3))
    comps, pend, _ = MT.accept_all_currencies(m.competitors, m.pending_alerts, users)
    acc = (pend.join(m.pending_alerts.filter(~F.col("included_in_digest")).select("id"), "id", "left_semi")
           .filter("included_in_digest").groupBy("competitor_id").agg(F.count(F.lit(1)).alias("accepted")))
    return (comps.select("id", "expected_currency")
            .join(acc.withColumnRenamed("competitor_id", "id"), "id", "left").fillna(0, ["accepted"]))


@query("K9_settings_upsert", """
WITH act AS (SELECT user_id, CAST(count_if(alert_type = 'price_drop') AS BIGINT) AS d, CAST(count_if(alert_type = 'price_increase') AS BIGINT) AS i,
                    count(*) AS n FROM pending_alerts GROUP BY user_id),
patch AS (SELECT user_id, CAST(NULL AS BOOLEAN) AS email_enabled,
            CASE WHEN n > (SELECT avg(n) FROM act) THEN 6 END AS digest_frequency_hours,
            CASE WHEN i > d THEN false END AS alert_price_drop, CAST(NULL AS BOOLEAN) AS alert_price_increase FROM act)
SELECT coalesce(s.user_id, p.user_id) AS user_id,
  coalesce(p.email_enabled, s.email_enabled, true) AS email_enabled,
  coalesce(CAST(p.digest_frequency_hours AS BIGINT), s.digest_frequency_hours, 24) AS digest_frequency_hours,
  coalesce(p.alert_price_drop, s.alert_price_drop, true) AS alert_price_drop,
  coalesce(p.alert_price_increase, s.alert_price_increase, true) AS alert_price_increase, s.last_digest_sent_at,
  coalesce(s.created_at, TIMESTAMP '2024-01-31 00:00:00') AS created_at,
  CASE WHEN p.user_id IS NOT NULL THEN TIMESTAMP '2024-01-31 00:00:00' ELSE s.updated_at END AS updated_at
FROM user_alert_settings s FULL JOIN patch p ON p.user_id = s.user_id""", ("pending_alerts", "user_alert_settings"))
def k9(m):
    """K9: settings upsert; the patch is derived from each user's alert
    activity (busier than average -> 6 h digests; more increases than drops
    -> drop alerts off); users without a row get the defaults plus the patch."""
    act = m.pending_alerts.groupBy("user_id").agg(
        F.count_if(F.col("alert_type") == "price_drop").alias("d"),
        F.count_if(F.col("alert_type") == "price_increase").alias("i"), F.count(F.lit(1)).alias("n"))
    avg_n = act.agg(F.avg("n")).scalar()                       # scalar subquery, no join
    patch = (act.withColumn("__avg", avg_n)
             .select("user_id", F.lit(None).cast("boolean").alias("email_enabled"),
                     F.when(F.col("n") > F.col("__avg"), F.lit(6)).cast("int").alias("digest_frequency_hours"),
                     F.when(F.col("i") > F.col("d"), F.lit(False)).alias("alert_price_drop"),
                     F.lit(None).cast("boolean").alias("alert_price_increase")))
    # an earlier patch of the same users, which the later one overrides field by field
    early = patch.withColumns({"digest_frequency_hours": F.when(F.col("digest_frequency_hours").isNotNull(), F.lit(99)),
                               "alert_price_drop": F.when(F.col("alert_price_drop").isNotNull(), F.lit(True))})
    both = patch.withColumn("seq", F.lit(2)).unionByName(early.withColumn("seq", F.lit(1)))
    return MT.upsert_settings(m.user_alert_settings, both, AS_OF, order="seq")


# Tables some of whose rows break a rule.  Per table: its columns over the model tables, and the planted faults
# (column, condition, value) in both languages' common subset of SQL; the first fault of a column that applies counts.
_FAULTY = {
    "products": ("SELECT id, user_id, product_name FROM products", [
        ("user_id", "id % 41 = 3", "NULL"), ("user_id", "id % 41 = 4", "-1 - id"), ("product_name", "id % 41 = 5", "NULL")]),
    "competitors": ("SELECT id, product_id, url, alert_threshold_percent FROM competitors", [
        ("product_id", "id % 50 = 9", "-1 - id"), ("product_id", "id % 50 = 10", "NULL"), ("url", "id % 50 = 11", "NULL"),
        ("alert_threshold_percent", "id % 70 = 8", "101")]),
    "price_history": ("SELECT id, competitor_id, scrape_status FROM price_history", [
        ("scrape_status", "id % 500 = 7", "'skipped'"), ("scrape_status", "id % 500 = 8", "NULL"),
        ("competitor_id", "id % 500 = 9", "NULL"), ("competitor_id", "id % 500 = 10", "-5 - id")]),
    "insights": ("SELECT id, product_id, insight_text, insight_type, confidence_score FROM insights", [
        ("insight_type", "product_id % 10 = 3", "'guess'"), ("insight_type", "id % 37 = 1", "NULL"),
        ("confidence_score", "product_id % 4 = 1", "1.5"), ("confidence_score", "id % 37 = 2", "NULL"),
        ("insight_text", "id % 37 = 3", "NULL"), ("product_id", "id % 37 = 4", "NULL"), ("product_id", "id % 37 = 5", "-1 - id")]),
    "tracking_jobs": ("SELECT id, user_id, id AS product_group_id, 1 AS total_items, 'completed' AS status FROM products", [
        ("status", "id % 9 = 4", "'stuck'"), ("status", "id % 9 = 5", "NULL"), ("user_id", "id % 31 = 1", "NULL"),
        ("user_id", "id % 31 = 2", "-1 - id"), ("product_group_id", "id % 31 = 3", "-1 - id"),
        ("product_group_id", "id % 31 = 4", "NULL"), ("total_items", "id % 31 = 5", "NULL")]),
    "pending_alerts": ("SELECT id, user_id, product_id, competitor_id, alert_type FROM pending_alerts", [
        ("alert_type", "id % 300 = 1", "'none'"), ("alert_type", "id % 300 = 2", "NULL"), ("user_id", "id % 300 = 3", "NULL"),
        ("user_id", "id % 300 = 4", "-1 - id"), ("product_id", "id % 300 = 5", "NULL"), ("product_id", "id % 300 = 6", "-1 - id"),
        ("competitor_id", "id % 300 = 7", "NULL"), ("competitor_id", "id % 300 = 8", "-1 - id")]),
    "user_alert_settings": ("SELECT user_id FROM user_alert_settings UNION ALL SELECT user_id FROM user_alert_settings WHERE user_id % 4 = 2 "
                            "UNION ALL SELECT -1 - user_id FROM user_alert_settings WHERE user_id % 3 = 1 "
                            "UNION ALL SELECT NULL FROM user_alert_settings WHERE user_id = 1", []),
    "alert_history": ("SELECT id, user_id, alerts_count, email_status FROM alert_history", [
        ("email_status", "id % 60 = 1", "'lost'"), ("email_status", "id % 60 = 2", "NULL"), ("user_id", "id % 60 = 3", "NULL"),
        ("user_id", "id % 60 = 4", "-1 - id"), ("alerts_count", "id % 60 = 5", "NULL")]),
}
_BROKEN_MODELS = ("price_history", "insights", "pending_alerts", "alert_history", "competitors", "products",
                  "user_alert_settings", "users")


def _faulty_sql(table: str) -> str:
    base, faults = _FAULTY[table]
    if not faults:
        return base
    cols = re.findall(r"(\w+)(?:,| FROM)", base)
    cases = []
    for c in cols:
        own = [f for f in faults if f[0] == c]
        whens = " ".join(f"WHEN {cond} THEN {value}" for _, cond, value in own)
        cases.append(f"CASE {whens} ELSE {c} END AS {c}" if own else c)
    return f"SELECT {', '.join(cases)} FROM ({base}) base"


def _broken_sql() -> str:
    """The rules of the schema, stated one by one over the faulty tables."""
    name = lambda t: f"f_{t}"
    key = lambda t: "user_id" if t in ("users", "user_alert_settings") else "id"
    bad = []
    for table, cols in {"products": ("user_id", "product_name"), "competitors": ("product_id", "url"),
                        "price_history": ("competitor_id", "scrape_status"),
                        "insights": ("product_id", "insight_text", "insight_type", "confidence_score"),
                        "tracking_jobs": ("user_id", "total_items"),
                        "pending_alerts": ("user_id", "product_id", "competitor_id", "alert_type"),
                        "user_alert_settings": ("user_id",), "alert_history": ("user_id", "alerts_count")}.items():
        bad += [(f"{table}.{c}_not_null", table, f"{c} IS NULL") for c in cols]
    for table, col, parent in (("products", "user_id", "users"), ("competitors", "product_id", "products"),
                               ("price_history", "competitor_id", "competitors"), ("insights", "product_id", "products"),
                               ("tracking_jobs", "user_id", "users"), ("tracking_jobs", "product_group_id", "products"),
                               ("pending_alerts", "user_id", "users"), ("pending_alerts", "product_id", "products"),
                               ("pending_alerts", "competitor_id", "competitors"),
                               ("user_alert_settings", "user_id", "users"), ("alert_history", "user_id", "users")):
        rows = "users" if parent == "users" else name(parent)
        bad.append((f"{table}.{col}_fk", table,
                    f"{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {rows} p WHERE p.{key(parent)} = c.{col})"))
    bad += [("price_history.scrape_status", "price_history", "scrape_status NOT IN ('success', 'failed')"),
            ("insights.insight_type", "insights", "insight_type NOT IN ('pattern', 'alert', 'recommendation')"),
            ("insights.confidence_score", "insights", "NOT (confidence_score BETWEEN 0 AND 1)"),
            ("pending_alerts.alert_type", "pending_alerts", "alert_type NOT IN ('price_drop', 'price_increase', 'currency_changed')"),
            ("alert_history.email_status", "alert_history", "email_status NOT IN ('pending', 'sent', 'failed')"),
            ("competitors.alert_threshold_percent", "competitors", "NOT (alert_threshold_percent BETWEEN 0 AND 100)"),
            ("tracking_jobs.status", "tracking_jobs", "status NOT IN ('pending', 'processing', 'completed', 'failed')")]
    tables = ",\n".join(f"{name(t)} AS ({_faulty_sql(t)})" for t in _FAULTY)
    parts = [f"SELECT '{rule}' AS rule, CAST({key(t)} AS VARCHAR) AS key FROM {name(t)} c WHERE {cond}" for rule, t, cond in bad]
    parts.append("SELECT 'user_alert_settings.user_id_unique', CAST(user_id AS VARCHAR) FROM f_user_alert_settings "
                 "WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1")
    names = ", ".join(f"('{rule}')" for rule in [*(b[0] for b in bad), "user_alert_settings.user_id_unique"])
    every = f"rules AS (SELECT rule FROM (VALUES {names}) v(rule))"
    return f"{tables},\n{every},\nbad AS ({' UNION ALL '.join(parts)})"


def _broken(m):
    """The faulty tables as frames, and the users."""
    models = {t: getattr(m, t) for t in _BROKEN_MODELS}
    out = {t: m.spark.sql(re.sub(r"FROM (\w+)", r"FROM {\1}", _faulty_sql(t)),
                          **{k: v for k, v in models.items() if f"FROM {k}" in _faulty_sql(t)}) for t in _FAULTY}
    return {**out, "users": m.users}


@query("K10_constraint_report", f"""WITH {_broken_sql()}
SELECT r.rule, count(bad.rule) AS violations FROM rules r LEFT JOIN bad ON bad.rule = r.rule GROUP BY r.rule""", _BROKEN_MODELS)
def k10(m):
    """Constraint violations per rule of the schema, over tables some of
    whose rows break a rule."""
    return MT.constraint_report(_broken(m))


@query("K10_constraint_violations", f"WITH {_broken_sql()} SELECT rule, key FROM bad", _BROKEN_MODELS)
def k10v(m):
    """The rows that break a rule of the schema."""
    return MT.constraint_violations(_broken(m))


@query("A7_append_prices", """
SELECT event_id AS id, user_id AS competitor_id,
  CAST(CASE WHEN event_type = 'error' OR CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0
              OR CAST(value AS DECIMAL(10,2)) = 0 THEN NULL
            ELSE CAST(value AS DECIMAL(10,2)) END AS DOUBLE) AS price,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS scrape_status FROM events""")
def a7(m):
    """Scrape results -> history rows (falsy price stored as NULL)."""
    e = m.raw("events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    failed = F.col("event_type") == "error"
    res = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("competitor_id"),
                   F.when(failed, F.lit(None)).when(k % 10 == 0, F.lit(0)).otherwise(F.col("value")).cast("decimal(10,2)").alias("price"),
                   F.lit("USD").alias("currency"), F.col("ts").cast("timestamp_ntz").alias("scraped_at"),
                   F.when(failed, "failed").otherwise("success").alias("status"),
                   F.when(failed, "timeout").alias("error"))
    return MT.append_prices(res, AS_OF).select("id", "competitor_id", "price", "scrape_status")


@query("A8_price_csv", r"""
SELECT c.product_id, strftime(p.scraped_at, '%Y-%m-%d') AS "Date", strftime(p.scraped_at, '%H:%M:%S') AS "Time",
  coalesce(CASE WHEN c.retailer_name <> '' THEN c.retailer_name END,
    CASE WHEN regexp_replace(lower(regexp_extract(c.url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') = '' THEN 'Unknown'
         ELSE regexp_replace(lower(regexp_extract(c.url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') END) AS "Competitor",
  CAST(CAST(CASE WHEN p.id % 97 = 0 THEN p.price + 12345678 ELSE p.price END AS DOUBLE) AS VARCHAR) AS "Price",
  p.currency AS "Currency", p.scrape_status AS "Status", p.error_message AS "Error"
FROM price_history p JOIN competitors c ON c.id = p.competitor_id""", ("price_history", "competitors"))
def a8(m):
    """The CSV export of every product, written and read back; some prices
    have eight digits."""
    big = m.price_history.withColumn("price", F.when(F.col("id") % 97 == 0, F.col("price") + 12345678)
                                     .otherwise(F.col("price")).cast("decimal(10,2)"))
    path = f"{ensure_checkpoint_dir(m.spark)}/scratch/csv-{uuid.uuid4().hex[:10]}"
    MT.write_price_csv(MT.price_csv_rows(big, m.competitors), path)
    return MT.read_price_csv(m.spark, path).drop("month")


@query("A12_nested_json_out", """
SELECT p.id, coalesce(c.n, 0) AS n_competitors, c.first_url, p.product_name
FROM products p LEFT JOIN (SELECT product_id, count(*) AS n, arg_min(url, (created_at, id)) AS first_url
                           FROM competitors GROUP BY 1) c ON c.product_id = p.id""", ("products", "competitors"))
def a12(m):
    """Product documents with nested competitors as JSON (checked by
    reading fields back out of the documents)."""
    d = MT.product_documents(m.products, m.competitors)
    return d.select("id", F.json_array_length(F.get_json_object("document", "$.competitors")).cast("bigint").alias("n_competitors"),
                    F.get_json_object("document", "$.competitors[0].url").alias("first_url"),
                    F.get_json_object("document", "$.product_name").alias("product_name"))


@query("A12_chart_document", f"""WITH {_STATS_SQL},
head AS (SELECT p.id AS product_id, 'product' AS part, CAST(NULL AS BIGINT) AS competitor_id, CAST(NULL AS DATE) AS day,
    p.product_name AS name, count(w.id) AS n, CAST(NULL AS DOUBLE) AS average_price, CAST(NULL AS DOUBLE) AS low,
    CAST(NULL AS DOUBLE) AS last, strftime(min(w.scraped_at), '%Y-%m-%dT%H:%M:%S') AS first_at
  FROM products p LEFT JOIN competitors c ON c.product_id = p.id LEFT JOIN w ON w.competitor_id = c.id GROUP BY p.id, p.product_name),
comp AS (SELECT product_id, 'competitor', competitor_id, NULL, coalesce(CASE WHEN retailer_name <> '' THEN retailer_name END,
    {_DOMAIN_STRIP}), NULL, average_price, CAST(min_price AS DOUBLE), CAST(current_price AS DOUBLE), NULL FROM stats),
pts AS (SELECT c.product_id, 'points', w.competitor_id, CAST(w.scraped_at AS DATE), NULL, count(*), NULL,
    CAST(min(CASE WHEN w.price <> 0 THEN w.price END) AS DOUBLE),
    CAST(arg_max(coalesce(CASE WHEN w.price <> 0 THEN w.price END, -1), (w.scraped_at, w.id)) AS DOUBLE),
    strftime(min(w.scraped_at), '%Y-%m-%dT%H:%M:%S')
  FROM w JOIN competitors c ON c.id = w.competitor_id GROUP BY 1, 3, 4)
SELECT * FROM head UNION ALL SELECT * FROM comp UNION ALL SELECT * FROM pts""", ("price_history", "competitors", "products"))
def a12c(m):
    """The chart documents' parts, with fields read back out of the JSON."""
    d = MT.chart_documents(m.products, m.competitors, m.price_history, AS_OF)
    get = lambda path: F.get_json_object("document", path)
    pts = F.from_json(get("$.data_points"), "array<struct<timestamp: string, price: double>>")
    part = F.col("part")
    return d.select(
        "product_id", "part", "competitor_id", "day",
        F.coalesce(get("$.product_name"), get("$.competitor_name")).alias("name"),
        F.when(part == "product", get("$.total_data_points").cast("bigint")).when(part == "points", F.size(pts).cast("bigint")).alias("n"),
        get("$.average_price").cast("double").alias("average_price"),
        F.coalesce(get("$.min_price").cast("double"), F.array_min(F.transform(pts, lambda x: x["price"]))).alias("low"),
        F.when(part == "points", F.coalesce(F.element_at(pts, -1)["price"], F.lit(-1.0)))
         .otherwise(get("$.current_price").cast("double")).alias("last"),
        F.substring(F.coalesce(get("$.date_range_start"), F.element_at(pts, 1)["timestamp"]), 1, 19).alias("first_at"))
