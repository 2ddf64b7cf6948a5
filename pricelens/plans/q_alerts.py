"""Registered queries: change detection, alerts and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from .registry import AS_OF, query

_DET_COLS = """id, user_id, product_id, competitor_id, alert_type, reason,
       CAST(old_price AS DOUBLE) AS old_price, CAST(new_price AS DOUBLE) AS new_price,
       CAST(price_change_percent AS DOUBLE) AS price_change_percent,
       CAST(threshold_percent AS DOUBLE) AS threshold_percent, old_currency, new_currency, detected_at"""


@query("I2_classify_change", f"SELECT {_DET_COLS} FROM detections", ("detections",))
def i2(m):
    """E1 + I2 over the whole history: every checked observation with its
    previous price, change % (half-even, 2 decimals), alert type and reason."""
    return m.detections

BATCH_FROM = "2024-01-16 00:00:00"   # detections from here on form the batch; earlier unsent ones are "existing"


def _batch(m):
    d = m.detections.filter(F.col("detected_at") >= F.lit(BATCH_FROM).cast("timestamp_ntz"))
    existing = m.pending_alerts.filter(F.col("detected_at") < F.lit(BATCH_FROM).cast("timestamp_ntz"))
    settings = A.settings_with_defaults(m.users, m.user_alert_settings)
    return A.alert_decision(d, settings, existing_pending=existing)


_I3_SQL = f"""
WITH RECURSIVE cand AS (
  SELECT d.*, s.email_enabled, s.alert_price_drop, s.alert_price_increase, s.user_id IS NOT NULL AS has
  FROM detections d LEFT JOIN user_alert_settings s ON s.user_id = d.user_id
  WHERE d.alert_type IS NOT NULL AND d.detected_at >= TIMESTAMP '{BATCH_FROM}'),
blk AS (SELECT *, CASE WHEN alert_type = 'currency_changed' OR NOT has THEN NULL
                       WHEN NOT email_enabled THEN 'User has disabled email alerts'
                       WHEN alert_type = 'price_drop' AND NOT alert_price_drop THEN 'User has disabled price drop alerts'
                       WHEN alert_type = 'price_increase' AND NOT alert_price_increase THEN 'User has disabled price increase alerts'
                  END AS blocked FROM cand),
passed AS (SELECT id, user_id, alert_type, row_number() OVER (PARTITION BY user_id ORDER BY detected_at, id) AS rn
           FROM blk WHERE blocked IS NULL),
seq AS (
  SELECT u.user_id, CAST(0 AS BIGINT) AS rn, (SELECT count(*) FROM pending_alerts p WHERE NOT p.included_in_digest
           AND p.detected_at < TIMESTAMP '{BATCH_FROM}' AND p.user_id = u.user_id) AS n, CAST(NULL AS BIGINT) AS id,
         CAST(NULL AS BIGINT) AS seen, false AS created FROM (SELECT DISTINCT user_id FROM passed) u
  UNION ALL
  SELECT s.user_id, p.rn, s.n + CASE WHEN p.alert_type = 'currency_changed' OR s.n < 100 THEN 1 ELSE 0 END, p.id, s.n,
         p.alert_type = 'currency_changed' OR s.n < 100
  FROM seq s JOIN passed p ON p.user_id = s.user_id AND p.rn = s.rn + 1)
SELECT b.id, b.user_id, product_id, competitor_id, b.alert_type, detected_at,
       CAST(price_change_percent AS DOUBLE) AS price_change_percent, coalesce(q.created, false) AS alert_created,
       CASE WHEN blocked IS NOT NULL THEN blocked
            WHEN b.alert_type = 'currency_changed' THEN 'Currency changed: ' || old_currency || ' → ' || new_currency
            WHEN NOT q.created THEN 'User has too many pending alerts (' || CAST(q.seen AS VARCHAR) || ')'
            ELSE 'Alert created: ' || b.alert_type || ' of ' || CAST(abs(price_change_percent) AS VARCHAR) || '%'
       END AS message
FROM blk b LEFT JOIN seq q ON q.id = b.id"""


@query("I3_alert_decision", _I3_SQL, ("detections", "pending_alerts", "user_alert_settings"))
def i3(m):
    """I3 (+C5, E4): settings and the pending cap applied to a batch of
    detections, with the existing unsent alerts counted per user."""
    return _batch(m).select("id", "user_id", "product_id", "competitor_id", "alert_type", "detected_at",
                            "price_change_percent", "alert_created", "message")


@query("E4_pending_cap", f"""
WITH dec AS ({_I3_SQL})
SELECT user_id, alert_type, alert_created, count(*) AS n FROM dec GROUP BY user_id, alert_type, alert_created""",
       ("detections", "pending_alerts", "user_alert_settings"))
def e4(m):
    """Accepted / rejected counts per user and alert type after the cap."""
    return (_batch(m).groupBy("user_id", "alert_type", "alert_created").agg(F.count(F.lit(1)).alias("n")))


@query("C5_settings_defaults", """
SELECT a.id, a.user_id, coalesce(s.email_enabled, true) AS email_enabled,
       coalesce(s.alert_price_drop, true) AS alert_price_drop, coalesce(s.alert_price_increase, true) AS alert_price_increase,
       coalesce(s.digest_frequency_hours, 24) AS digest_frequency_hours, s.user_id IS NOT NULL AS has_settings
FROM detections a JOIN users u ON u.user_id = a.user_id LEFT JOIN user_alert_settings s ON s.user_id = a.user_id
WHERE a.alert_type IS NOT NULL""", ("detections", "users", "user_alert_settings"))
def c5(m):
    """Effective settings for every alert candidate (no settings row =
    everything enabled)."""
    eff = A.settings_with_defaults(m.users, m.user_alert_settings)
    cand = m.detections.filter(F.col("alert_type").isNotNull()).select("id", "user_id")
    return cand.join(eff, "user_id").select("id", "user_id", "email_enabled", "alert_price_drop",
                                            "alert_price_increase", "digest_frequency_hours", "has_settings")


_DUE_SQL = """
due AS (SELECT s.user_id, coalesce(s.digest_frequency_hours, 24) AS digest_frequency_hours, pc.pending_count, u.email
  FROM user_alert_settings s
  JOIN (SELECT user_id, count(*) AS pending_count FROM pending_alerts WHERE NOT included_in_digest GROUP BY user_id) pc
    ON pc.user_id = s.user_id
  JOIN users u ON u.user_id = s.user_id
  WHERE s.email_enabled AND (s.last_digest_sent_at IS NULL OR
        date_diff('second', s.last_digest_sent_at, TIMESTAMP '2024-01-31 00:00:00') >= coalesce(s.digest_frequency_hours, 24) * 3600))"""


@query("C6_digest_due", f"WITH {_DUE_SQL} SELECT * FROM due",
       ("pending_alerts", "user_alert_settings", "users"))
def c6(m):
    """C6 + I6: users due for a digest with their unsent count and e-mail."""
    return A.users_due_for_digest(m.user_alert_settings, m.pending_alerts, m.users, AS_OF).select(
        "user_id", "digest_frequency_hours", "pending_count", "email")


_DETAILS_SQL = """
det AS (SELECT a.*, coalesce(p.product_name, 'Unknown') AS product_name,
               coalesce(CASE WHEN c.retailer_name <> '' THEN c.retailer_name END, 'Unknown Store') AS competitor_name
        FROM pending_alerts a LEFT JOIN products p ON p.id = a.product_id LEFT JOIN competitors c ON c.id = a.competitor_id)"""


@query("C4_alert_details", f"""WITH {_DETAILS_SQL}
SELECT id, user_id, product_name, competitor_name, alert_type, CAST(old_price AS DOUBLE) AS old_price,
       CAST(new_price AS DOUBLE) AS new_price, CAST(price_change_percent AS DOUBLE) AS price_change_percent, detected_at
FROM det""", ("pending_alerts", "products", "competitors"))
def c4(m):
    """C4: alerts with product and store names (two left joins)."""
    return A.alert_details(m.pending_alerts, m.products, m.competitors).select(
        "id", "user_id", "product_name", "competitor_name", "alert_type", "old_price", "new_price",
        "price_change_percent", "detected_at")


@query("F9_pending_list", f"""WITH {_DETAILS_SQL}
SELECT id, user_id, product_name, competitor_name, alert_type, detected_at,
       row_number() OVER (PARTITION BY user_id ORDER BY detected_at DESC, id DESC) AS list_pos,
       count(*) OVER (PARTITION BY user_id) AS total
FROM det WHERE NOT included_in_digest""", ("pending_alerts", "products", "competitors"))
def f9(m):
    """F9 + B8: every unsent alert of every user, newest first, with the total."""
    from ..operators import dashboard as DB
    return DB.pending_list(A.alert_details(m.pending_alerts, m.products, m.competitors)).select(
        "id", "user_id", "product_name", "competitor_name", "alert_type", "detected_at", "list_pos", "total")


@query("D6_pending_count", """
SELECT user_id, count(*) AS pending_count FROM pending_alerts WHERE NOT included_in_digest GROUP BY user_id""",
       ("pending_alerts",))
def d6(m):
    """Unsent alerts per user."""
    return A.pending_counts(m.pending_alerts)


def _digest_rows(m):
    due = A.users_due_for_digest(m.user_alert_settings, m.pending_alerts, m.users, AS_OF)
    det = A.alert_details(m.pending_alerts, m.products, m.competitors)
    return A.digest_alerts(det, due)


_DIGEST_SQL = f"""{_DUE_SQL}, {_DETAILS_SQL},
rows_ AS (SELECT d.*, row_number() OVER (PARTITION BY d.user_id ORDER BY d.detected_at DESC, d.id DESC) AS rn
          FROM det d WHERE NOT d.included_in_digest AND d.user_id IN (SELECT user_id FROM due)),
dig AS (SELECT *, CASE WHEN rn <= 50 THEN rn END AS line_no, rn <= 50 AS mailed FROM rows_)"""


@query("E5_digest_cap", f"""WITH {_DIGEST_SQL}
SELECT id, user_id, line_no, mailed FROM dig""", ("pending_alerts", "user_alert_settings", "users", "products", "competitors"))
def e5(m):
    """E5 + E9: due users' unsent alerts, newest first; the first 50 are mailed."""
    return _digest_rows(m).select("id", "user_id", "line_no", "mailed")


def _line_sql():
    def mail(x, n=500):
        t = f"trim({x})"
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            t = f"replace({t}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
        for p in ("javascript:", "<script", "onerror=", "onclick="):
            t = f"replace({t}, '{p}', '')"
        return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' WHEN length({t}) > {n} "
                f"THEN substr({t}, 1, {n - 3}) || '...' ELSE {t} END")
    return ("CAST(line_no AS VARCHAR) || '. ' || " + mail("product_name", 150) + " || chr(10) || '   Store: ' || "
            + mail("competitor_name") + " || chr(10) || '   Change: ' || CASE WHEN alert_type = 'price_drop' THEN '↓' ELSE '↑' END"
            " || ' ' || CAST(round_even(CAST(abs(coalesce(price_change_percent, 0)) AS DECIMAL(20,4)), 1) AS VARCHAR) || '%'"
            " || chr(10) || '   Price: USD ' || CAST(CAST(coalesce(old_price, 0) AS DECIMAL(20,2)) AS VARCHAR)"
            " || ' → USD ' || CAST(CAST(coalesce(new_price, 0) AS DECIMAL(20,2)) AS VARCHAR)"), mail


@query("D8_digest_counts", None)
def d8(m):
    """D8 + H14 + H15: per digest the drop / increase counts, subject and body."""
    return A.digest_messages(_digest_rows(m)).select("user_id", "drops", "increases", "alerts_count",
                                                     "alerts_mailed", "subject", "body")


def _d8_sql():
    line, mail = _line_sql()
    subj_raw = ("'Price Alert: ' || concat_ws(' & ', "
                "CASE WHEN drops > 0 THEN CAST(drops AS VARCHAR) || ' price drop' || CASE WHEN drops > 1 THEN 's' ELSE '' END END, "
                "CASE WHEN increases > 0 THEN CAST(increases AS VARCHAR) || ' price increase' || CASE WHEN increases > 1 THEN 's' ELSE '' END END)")
    return f"""WITH {_DIGEST_SQL},
c AS (SELECT user_id, CAST(count_if(alert_type = 'price_drop') AS BIGINT) AS drops, CAST(count_if(alert_type = 'price_increase') AS BIGINT) AS increases,
             count(*) AS alerts_count FROM dig GROUP BY user_id),
b AS (SELECT user_id, count(*) AS alerts_mailed, string_agg({line}, chr(10) || chr(10) ORDER BY line_no) AS body
      FROM dig WHERE mailed GROUP BY user_id)
SELECT c.user_id, drops, increases, alerts_count, alerts_mailed, {mail(subj_raw, 200)} AS subject, body
FROM c LEFT JOIN b ON b.user_id = c.user_id"""


from .registry import ORACLE as _OR  # noqa: E402
from ..sources.model_sql import with_models as _wm  # noqa: E402
_OR["D8_digest_counts"] = _wm(_d8_sql(), "pending_alerts", "user_alert_settings", "users", "products", "competitors")


def _delivered(m):
    """A digest run whose mails to even users arrive and to odd ones do not."""
    rows = _digest_rows(m)
    delivery = (rows.select("user_id").distinct()
                .select("user_id", (F.col("user_id") % 2 == 0).alias("success"),
                        F.when(F.col("user_id") % 2 != 0, F.lit("smtp unavailable")).alias("error")))
    return A.finish_digest(m.pending_alerts, m.user_alert_settings, delivery, rows, AS_OF)


@query("K11_finish_digest", f"""WITH {_DIGEST_SQL}
SELECT user_id, CAST(count(*) AS BIGINT) AS alerts_count, CAST(count_if(mailed) AS BIGINT) AS alerts_mailed,
       CASE WHEN user_id % 2 = 0 THEN 'sent' ELSE 'failed' END AS email_status,
       CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'smtp unavailable' END AS error_message
FROM dig GROUP BY user_id""", ("pending_alerts", "user_alert_settings", "users", "products", "competitors"))
def k11(m):
    """K11 (+A9): history rows (sent / failed) of a delivery result."""
    return _delivered(m)[2].select("user_id", "alerts_count", "alerts_mailed", "email_status", "error_message")


@query("K11_finish_digest_settings", f"""WITH {_DIGEST_SQL}
SELECT s.user_id, CASE WHEN s.user_id IN (SELECT user_id FROM dig WHERE user_id % 2 = 0) THEN TIMESTAMP '2024-01-31 00:00:00'
                       ELSE s.last_digest_sent_at END AS last_digest_sent_at,
  CASE WHEN s.user_id IN (SELECT user_id FROM dig WHERE user_id % 2 = 0) THEN TIMESTAMP '2024-01-31 00:00:00'
       ELSE s.updated_at END AS updated_at
FROM user_alert_settings s""", ("pending_alerts", "user_alert_settings", "users", "products", "competitors"))
def k11s(m):
    """The settings after a delivery result: only users whose mail arrived
    have a new last digest."""
    return _delivered(m)[1].select("user_id", "last_digest_sent_at", "updated_at")


@query("K5_mark_included", f"""WITH {_DIGEST_SQL}
SELECT a.id, a.included_in_digest OR (a.id IN (SELECT id FROM dig WHERE user_id % 2 = 0)) AS included_in_digest
FROM pending_alerts a""", ("pending_alerts", "user_alert_settings", "users", "products", "competitors"))
def k5(m):
    """K5: pending alerts after a digest run marked the delivered ones."""
    return _delivered(m)[0].select("id", "included_in_digest")


@query("D12_digest_batch_totals", """
SELECT count(*) AS total, CAST(count_if(email_status = 'sent') AS BIGINT) AS sent, CAST(count_if(email_status = 'failed') AS BIGINT) AS failed
FROM alert_history""", ("alert_history",))
def d12(m):
    """Total / sent / failed over digest history rows."""
    return A.digest_batch_totals(m.alert_history)


@query("K6_cleanup_alerts", """
SELECT id FROM pending_alerts WHERE NOT (included_in_digest AND detected_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY)""",
       ("pending_alerts",))
def k6(m):
    """K6: pending alerts kept after deleting included ones older than 7 days."""
    return A.cleanup_alerts(m.pending_alerts, AS_OF).select("id")
