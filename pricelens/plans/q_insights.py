"""Registered queries: insight analytics (M*) and remaining text scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import timefmt as TF
from ..operators import insights as IN
from .registry import AS_OF, query

_OK = """ok AS (SELECT * FROM price_history WHERE scraped_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY
      AND scrape_status = 'success' AND price IS NOT NULL AND price <> 0)"""


@query("M1_weekly_cycle", f"""WITH {_OK},
d AS (SELECT competitor_id, dayofweek(scraped_at) + 1 AS weekday, count(*) AS n_d, sum(price) AS s_d FROM ok GROUP BY 1, 2),
o AS (SELECT competitor_id, count(*) AS n, sum(price) AS s FROM ok GROUP BY 1)
SELECT d.competitor_id, weekday, n_d, CAST(s_d AS DOUBLE) / n_d AS avg_price,
  CASE WHEN s <> 0 THEN CAST(s_d * n AS DOUBLE) / CAST(s * n_d AS DOUBLE) END AS ratio_to_mean
FROM d JOIN o USING (competitor_id)""", ("price_history",))
def m1(m):
    """M1: weekday means vs overall mean per competitor."""
    return IN.weekly_cycle(m.price_history, AS_OF)


@query("M2_trend", f"""WITH {_OK},
x AS (SELECT *, CAST(date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', scraped_at) AS BIGINT) AS x FROM ok),
g AS (SELECT competitor_id, count(*) AS n, CAST(sum(x) AS DECIMAL(38,0)) AS sx, sum(price) AS sy,
             sum(CAST(x AS DECIMAL(38,0)) * x) AS sxx, sum(CAST(x AS DECIMAL(20,0)) * price) AS sxy, sum(price * price) AS syy
      FROM x GROUP BY 1),
h AS (SELECT competitor_id, n, CAST(n * sxy - sx * sy AS DOUBLE) AS num, CAST(n * sxx - sx * sx AS DOUBLE) AS denx,
             CAST(n * syy - sy * sy AS DOUBLE) AS deny FROM g)
SELECT competitor_id, n, CASE WHEN denx <> 0 THEN num / denx * 1440.0 END AS slope_per_day,
       CASE WHEN denx <> 0 AND deny <> 0 THEN (num / denx) * (num / deny) END AS r2 FROM h""", ("price_history",))
def m2(m):
    """M2: price trend (slope per day, r^2) per competitor."""
    return IN.trend(m.price_history, AS_OF)


@query("M3_anomalies", f"""WITH {_OK},
g AS (SELECT competitor_id, count(*) AS n, sum(price) AS s1, sum(price * price) AS s2 FROM ok GROUP BY 1),
j AS (SELECT ok.*, n * price - s1 AS dev, n * s2 - s1 * s1 AS var_n FROM ok JOIN g USING (competitor_id))
SELECT id, competitor_id, CAST(price AS DOUBLE) AS price, scraped_at, CAST(dev AS DOUBLE) / sqrt(CAST(var_n AS DOUBLE)) AS z
FROM j WHERE var_n > 0 AND dev * dev > 4 * var_n""", ("price_history",))
def m3(m):
    """M3: price points with |z| > 2."""
    return IN.anomalies(m.price_history, AS_OF)


@query("M4_price_position", f"""WITH {_OK},
cur AS (SELECT competitor_id, arg_max(price, (scraped_at, id)) AS current_price FROM ok GROUP BY 1),
c AS (SELECT cur.*, product_id FROM cur JOIN competitors ON competitors.id = cur.competitor_id),
p AS (SELECT product_id, count(*) AS pn, sum(current_price) AS ps FROM c GROUP BY 1)
SELECT product_id, competitor_id, CAST(current_price AS DOUBLE) AS current_price,
  rank() OVER (PARTITION BY product_id ORDER BY current_price) AS price_rank, pn AS competitors,
  CASE WHEN ps <> 0 THEN CAST((current_price * pn - ps) * 100 AS DOUBLE) / CAST(ps AS DOUBLE) END AS pct_vs_mean
FROM c JOIN p USING (product_id)""", ("price_history", "competitors"))
def m4(m):
    """M4: competitor price position within the product."""
    return IN.price_position(m.price_history, m.competitors, AS_OF)


_M5_SQL = f"""WITH {_OK},
x AS (SELECT *, CAST(date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', scraped_at) AS BIGINT) AS x FROM ok),
g AS (SELECT competitor_id, count(*) AS n, CAST(sum(x) AS DECIMAL(38,0)) AS sx, sum(price) AS sy,
             sum(CAST(x AS DECIMAL(38,0)) * x) AS sxx, sum(CAST(x AS DECIMAL(20,0)) * price) AS sxy, sum(price * price) AS syy
      FROM x GROUP BY 1),
h AS (SELECT competitor_id, CAST(n * sxy - sx * sy AS DOUBLE) AS num, CAST(n * sxx - sx * sx AS DOUBLE) AS denx,
             CAST(n * syy - sy * sy AS DOUBLE) AS deny FROM g),
tr AS (SELECT competitor_id, num / denx * 1440.0 AS slope, CASE WHEN deny <> 0 THEN (num / denx) * (num / deny) END AS r2
       FROM h WHERE denx <> 0),
names AS (SELECT id AS competitor_id, product_id, coalesce(CASE WHEN retailer_name <> '' THEN retailer_name END,
            regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1), '^www\\.', '')) AS cname
          FROM competitors),
m AS (SELECT competitor_id, count(*) AS n, sum(price) AS s1, sum(price * price) AS s2 FROM ok GROUP BY 1),
an AS (SELECT ok.competitor_id, count(*) AS k FROM ok JOIN m USING (competitor_id)
       WHERE n * s2 - s1 * s1 > 0 AND (n * price - s1) * (n * price - s1) > 4 * (n * s2 - s1 * s1) GROUP BY 1),
cur AS (SELECT competitor_id, arg_max(price, (scraped_at, id)) AS cp FROM ok GROUP BY 1),
cp AS (SELECT cur.*, names.product_id, names.cname FROM cur JOIN names USING (competitor_id)),
pm AS (SELECT product_id, count(*) AS pn, sum(cp) AS ps FROM cp GROUP BY 1),
wd AS (SELECT competitor_id, dayofweek(scraped_at) + 1 AS weekday, count(*) AS n_d, sum(price) AS s_d FROM ok GROUP BY 1, 2),
wo AS (SELECT competitor_id, count(*) AS n, sum(price) AS s FROM ok GROUP BY 1),
wk AS (SELECT wd.competitor_id, weekday, CAST(s_d * n AS DOUBLE) / CAST(s * n_d AS DOUBLE) AS ratio
       FROM wd JOIN wo USING (competitor_id) WHERE s <> 0),
pos AS (SELECT cp.*, rank() OVER (PARTITION BY cp.product_id ORDER BY cp) AS rk,
          CASE WHEN ps <> 0 THEN CAST((cp * pn - ps) * 100 AS DOUBLE) / CAST(ps AS DOUBLE) END AS pct FROM cp JOIN pm USING (product_id)),
rows_ AS (
  SELECT n.product_id, t.competitor_id, 'pattern' AS type,
         n.cname || ': prices trending ' || CASE WHEN t.slope < 0 THEN 'down' ELSE 'up' END || ' by '
           || CAST(round_even(CAST(abs(t.slope) AS DECIMAL(30,10)), 2) AS VARCHAR) || ' per day' AS text,
         coalesce(t.r2, 0.0) AS raw_conf FROM tr t JOIN names n USING (competitor_id)
  UNION ALL SELECT n.product_id, a.competitor_id, 'ALERT', n.cname || ': ' || CAST(a.k AS VARCHAR) || ' unusual price points', 0.75
  FROM an a JOIN names n USING (competitor_id)
  UNION ALL SELECT product_id, competitor_id, 'recommendation',
         cname || ' is the cheapest, ' || CAST(round_even(CAST(abs(pct) AS DECIMAL(30,10)), 1) AS VARCHAR) || '% below the average', 0.9
  FROM pos WHERE rk = 1
  UNION ALL SELECT n.product_id, w.competitor_id, 'pattern',
         n.cname || ': cheapest on ' || ['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'][w.weekday]
           || ' (' || CAST(round_even(CAST((1.0 - w.ratio) * 100 AS DECIMAL(30,10)), 1) AS VARCHAR) || '% below its average)', 0.6
  FROM (SELECT competitor_id, arg_min(weekday, (ratio, weekday)) AS weekday, min(ratio) AS ratio FROM wk
        WHERE ratio < 0.98 GROUP BY 1) w JOIN names n USING (competitor_id)),
todo AS (SELECT id AS product_id FROM products p WHERE NOT EXISTS (SELECT 1 FROM insights i WHERE i.product_id = p.id
         AND i.generated_at >= TIMESTAMP '2024-01-31 00:00:00')),
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY product_id ORDER BY raw_conf DESC, type, competitor_id) AS rank
           FROM rows_ r WHERE product_id IN (SELECT product_id FROM todo))
SELECT product_id, rank, CASE WHEN lower(type) IN ('pattern', 'alert', 'recommendation') THEN lower(type) ELSE 'pattern' END
         AS insight_type, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS insight_text,
       CAST(CASE WHEN raw_conf BETWEEN 0 AND 1 THEN round(CAST(raw_conf AS DECIMAL(20,10)), 2) ELSE 0.5 END AS DOUBLE)
         AS confidence_score
FROM ranked WHERE rank <= 5"""


@query("M5_insight_rows", _M5_SQL, ("price_history", "competitors", "products", "insights"))
def m5(m):
    """M5 (+E8, C8): at most five rule-based insights per product due today."""
    return IN.insight_rows(m.price_history, m.competitors, m.products, m.insights, AS_OF)


def _raw_insights(m):
    """Insight JSON as an external generator would return it (built from the
    insights table, with off-spec types, texts and confidences mixed in)."""
    i = m.insights
    typ = F.when(F.col("id") % 4 == 1, F.upper("insight_type")).when(F.col("id") % 9 == 0, F.lit("trend")).otherwise(F.col("insight_type"))
    txt = (F.when(F.col("id") % 5 == 0, F.concat(F.lit("  <b>"), F.col("insight_text"), F.lit("</b> SELECT javascript:x ")))
           .when(F.col("id") % 7 == 0, F.repeat(F.col("insight_text"), 30))
           .otherwise(F.col("insight_text")))
    conf = (F.when(F.col("id") % 6 == 0, F.lit("1.5")).when(F.col("id") % 8 == 0, F.lit("x"))
            .otherwise(F.col("confidence_score").cast("string")))
    item = F.struct(typ.alias("type"), txt.alias("text"), conf.alias("confidence"))
    g = i.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))).alias("a"))
    return g.select("product_id", F.to_json(F.struct(F.transform("a", lambda e: e["x"]).alias("insights"))).alias("payload"))


M6_SQL = r"""
WITH raw AS (SELECT product_id, id, row_number() OVER (PARTITION BY product_id ORDER BY id) - 1 AS pos,
  CASE WHEN id % 4 = 1 THEN upper(insight_type) WHEN id % 9 = 0 THEN 'trend' ELSE insight_type END AS t,
  CASE WHEN id % 5 = 0 THEN '  <b>' || insight_text || '</b> SELECT javascript:x '
       WHEN id % 7 = 0 THEN repeat(insight_text, 30) ELSE insight_text END AS txt,
  CASE WHEN id % 6 = 0 THEN '1.5' WHEN id % 8 = 0 THEN 'x' ELSE CAST(confidence_score AS VARCHAR) END AS c FROM insights),
s AS (SELECT *, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(txt, '<', '&lt;'), '>', '&gt;'),
        '<script', ''), 'javascript:', ''), 'SELECT ', ''), 'DROP ', ''), 'INSERT ', ''), 'UPDATE ', ''), 'DELETE ', ''),
        '^\s+|\s+$', '', 'g') AS st, TRY_CAST(c AS DOUBLE) AS cd FROM raw)
SELECT product_id, pos,
  CASE WHEN lower(t) IN ('pattern', 'alert', 'recommendation') THEN lower(t) ELSE 'pattern' END AS insight_type,
  CASE WHEN length(st) > 500 THEN substr(st, 1, 497) || '...' ELSE st END AS insight_text,
  CAST(CASE WHEN cd BETWEEN 0 AND 1 THEN round(CAST(c AS DECIMAL(20,10)), 2) ELSE 0.5 END AS DOUBLE) AS confidence_score
FROM s WHERE pos < 5"""


@query("M6_validate_insights", M6_SQL, ("insights", "products"))
def m6(m):
    """M6: external insight JSON validated into insight rows."""
    return IN.validate_insights(_raw_insights(m))


@query("H8_sanitize_insight", r"""
SELECT doc_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 497) || '...' ELSE t END AS text FROM (
  SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '<', '&lt;'), '>', '&gt;'),
        '<script', ''), 'javascript:', ''), 'SELECT ', ''), 'DROP ', ''), 'INSERT ', ''), 'UPDATE ', ''), 'DELETE ', ''),
        '^[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}\x{2028}\x{2029}\x{0085}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}\x{2028}\x{2029}\x{0085}]+$', '', 'g') AS t
  FROM documents) d""")
def h8(m):
    """H8: insight text sanitising over whole documents."""
    return m.raw("documents").select("doc_id", TX.sanitize_insight(F.col("text")).alias("text"))


def _mail_sql(x, n):
    t = rf"regexp_replace({x}, '^[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{1680}}\x{{2028}}\x{{2029}}\x{{0085}}]+|[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{1680}}\x{{2028}}\x{{2029}}\x{{0085}}]+$', '', 'g')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        t = f"replace({t}, '{a}', '{b}')"
    for p in ("javascript:", "<script", "onerror=", "onclick="):
        t = f"replace({t}, '{p}', '')"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' WHEN length({t}) > {n} THEN substr({t}, 1, {n - 3}) || '...' ELSE {t} END"


@query("H9_sanitize_mail", f"SELECT conv_id, turn, {_mail_sql('text', 150)} AS text FROM conversations")
def h9(m):
    """H9: mail-safe text (product-name limit 150) over conversation turns."""
    return m.raw("conversations").select("conv_id", "turn", TX.sanitize_mail(F.col("text"), 150).alias("text"))


_EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"


@query("H11_clean_email", f"""
SELECT doc_id, e AS raw, CASE WHEN contains(lower(trim(e)), '@') AND contains(lower(trim(e)), '.') THEN lower(trim(e)) END AS email
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL_RE}')) AS e FROM documents) t""")
def h11(m):
    """Every e-mail-like token of the whole documents, validated."""
    d = m.raw("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_EMAIL_RE), 0)).alias("raw"))
    c = TX.clean_email(F.col("raw"))
    return d.select("doc_id", "raw", c["email"].alias("email"))


@query("I4_split_datetime", """
WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
    WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 2 THEN '' ELSE 'n/a ' || CAST(event_id AS VARCHAR) END AS iso
  FROM events)
SELECT event_id, CASE WHEN iso = '' THEN '' WHEN iso LIKE 'n/a%' THEN iso ELSE substr(iso, 1, 10) END AS date,
  CASE WHEN iso = '' OR iso LIKE 'n/a%' THEN '' ELSE substr(iso, 12, 8) END AS time FROM s""")
def i4(m):
    """I4: ISO timestamps (Z / offset / empty / junk) -> date and time text."""
    e = m.raw("events")
    base = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    iso = (F.when(k == 0, F.concat(base, F.lit("Z"))).when(k == 1, F.concat(base, F.lit("+00:00")))
           .when(k == 2, F.lit("")).otherwise(F.concat(F.lit("n/a "), F.col("event_id").cast("string"))))
    s = TF.split_datetime(iso)
    return e.select("event_id", s["date"].alias("date"), s["time"].alias("time"))
