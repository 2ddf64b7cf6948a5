"""The model tables of ``tables.ModelTables`` as ANSI SQL common table
expressions over the raw test tables (used by the DuckDB oracle)."""

from __future__ import annotations

# exact half-even rounding of a/b (b > 0) to 2 decimals, integers only
_PCT_NUM = "(CAST(round((p.price - p.old_price) * 100) AS BIGINT) * 10000)"
_PCT_DEN = "CAST(round(p.old_price * 100) AS BIGINT)"

MODEL_CTES = {
    "users": """SELECT user_id, 'user' || CAST(user_id AS VARCHAR) || '@example.com' AS email FROM (
        SELECT CAST(s_suppkey AS BIGINT) AS user_id FROM supplier WHERE s_suppkey = 0 UNION ALL
        SELECT CAST(s_suppkey // 4 + 1 AS BIGINT) AS user_id FROM supplier WHERE s_suppkey % 4 = 0)""",
    "products": """SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey // 4 + 1 END AS BIGINT) AS user_id,
        s_name AS product_name, s_suppkey % 5 <> 0 AS is_active,
        TIMESTAMP '2023-12-01 00:00:00' + (s_suppkey % 720) * INTERVAL 1 HOUR AS created_at,
        TIMESTAMP '2023-12-01 00:00:00' + (s_suppkey % 720) * INTERVAL 1 HOUR AS updated_at FROM supplier""",
    "competitors": """SELECT CAST(c_custkey AS BIGINT) AS id,
        CAST(c_custkey % (SELECT count(*) FROM supplier) AS BIGINT) AS product_id,
        'https://www.' || lower(c_mktsegment) || '.example.com/p/' || CAST(c_custkey AS VARCHAR) AS url,
        CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS retailer_name,
        CAST(5 * (1 + c_custkey % 4) AS DECIMAL(5,2)) AS alert_threshold_percent,
        'USD' AS expected_currency,
        TIMESTAMP '2023-12-15 00:00:00' + (c_custkey % 1000) * INTERVAL 1 MINUTE AS created_at FROM customer""",
    "price_history": """SELECT event_id AS id, user_id AS competitor_id,
        CASE WHEN event_type = 'error' THEN NULL ELSE CAST(value AS DECIMAL(10,2)) END AS price,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
        CAST(ts AS TIMESTAMP) AS scraped_at,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS scrape_status,
        CASE WHEN event_type = 'error' THEN 'timeout' END AS error_message FROM events""",
    "user_alert_settings": """SELECT user_id, user_id % 7 <> 3 AS email_enabled,
        CAST(CASE WHEN user_id % 10 = 3 THEN 24 ELSE CASE user_id % 5 WHEN 0 THEN 6 WHEN 1 THEN 1 WHEN 2 THEN 8 ELSE 48 END END
             AS BIGINT) AS digest_frequency_hours,
        user_id % 6 <> 1 AS alert_price_drop, user_id % 6 <> 2 AS alert_price_increase,
        CASE user_id % 3 WHEN 1 THEN TIMESTAMP '2024-01-30 14:00:00' WHEN 2 THEN TIMESTAMP '2024-01-28 00:00:00' END
          AS last_digest_sent_at,
        TIMESTAMP '2023-12-01 00:00:00' AS created_at, TIMESTAMP '2023-12-01 00:00:00' AS updated_at
        FROM users WHERE user_id % 5 <> 4""",
    "ph_prev": """SELECT *, lag(price) OVER w AS old_price, lag(currency) OVER w AS old_currency
        FROM price_history WHERE scrape_status = 'success' AND price IS NOT NULL
        WINDOW w AS (PARTITION BY competitor_id ORDER BY scraped_at, id)""",
    "detections": f"""SELECT p.id, pr.user_id, c.product_id, p.competitor_id,
        CASE WHEN p.old_price IS NULL THEN NULL
             WHEN p.old_currency <> p.currency THEN 'currency_changed'
             WHEN p.old_price = 0 THEN NULL
             WHEN (p.price - p.old_price) * 100 <= -c.alert_threshold_percent * p.old_price THEN 'price_drop'
             WHEN (p.price - p.old_price) * 100 >= c.alert_threshold_percent * p.old_price THEN 'price_increase'
             WHEN abs(p.price - p.old_price) >= 5.00 THEN CASE WHEN p.price < p.old_price THEN 'price_drop' ELSE 'price_increase' END
        END AS alert_type,
        CASE WHEN p.old_price IS NULL THEN 'first'
             WHEN p.old_currency <> p.currency THEN 'currency_changed'
             WHEN p.old_price = 0 THEN 'previous_zero'
             WHEN (p.price - p.old_price) * 100 <= -c.alert_threshold_percent * p.old_price THEN 'price_drop'
             WHEN (p.price - p.old_price) * 100 >= c.alert_threshold_percent * p.old_price THEN 'price_increase'
             WHEN abs(p.price - p.old_price) >= 5.00 THEN CASE WHEN p.price < p.old_price THEN 'price_drop' ELSE 'price_increase' END
             ELSE 'below_threshold'
        END AS reason,
        p.old_price, p.price AS new_price,
        CASE WHEN p.old_currency = p.currency AND p.old_price <> 0 THEN
          CAST(CAST(sign({_PCT_NUM}) * ((abs({_PCT_NUM}) // {_PCT_DEN})
              + CASE WHEN 2 * (abs({_PCT_NUM}) % {_PCT_DEN}) > {_PCT_DEN}
                       OR (2 * (abs({_PCT_NUM}) % {_PCT_DEN}) = {_PCT_DEN} AND (abs({_PCT_NUM}) // {_PCT_DEN}) % 2 = 1)
                     THEN 1 ELSE 0 END) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(12,2))
        END AS price_change_percent,
        c.alert_threshold_percent AS threshold_percent,
        p.old_currency, p.currency AS new_currency, p.scraped_at AS detected_at
        FROM ph_prev p JOIN competitors c ON c.id = p.competitor_id JOIN products pr ON pr.id = c.product_id
        WHERE p.price <> 0""",
    "pending_alerts": """SELECT id, user_id, product_id, competitor_id, alert_type, old_price, new_price,
        price_change_percent, threshold_percent, old_currency, new_currency,
        detected_at < TIMESTAMP '2024-01-15 00:00:00' AS included_in_digest, detected_at
        FROM detections WHERE alert_type IS NOT NULL""",
    "alert_history": """SELECT user_id * 1000 + dayofyear(d) AS id, user_id,
        CAST(d AS TIMESTAMP) + INTERVAL 1 DAY AS digest_sent_at, CAST(count(*) AS BIGINT) AS alerts_count,
        CASE WHEN day(d) % 7 = 0 THEN 'failed' ELSE 'sent' END AS email_status,
        CASE WHEN day(d) % 7 = 0 THEN 'smtp error' END AS error_message
        FROM (SELECT user_id, CAST(detected_at AS DATE) AS d FROM pending_alerts) GROUP BY user_id, d""",
    "insights": """SELECT p.id * 10 + k.k AS id, p.id AS product_id,
        k.t || ' insight for ' || p.product_name AS insight_text, k.t AS insight_type,
        CAST(k.c AS DECIMAL(3,2)) AS confidence_score,
        TIMESTAMP '2024-01-31 00:00:00' - (p.id % 48) * INTERVAL 1 HOUR AS generated_at
        FROM products p, (SELECT unnest([0, 1, 2]) AS k, unnest(['pattern', 'alert', 'recommendation']) AS t,
                                 unnest([0.50, 0.75, 1.00]) AS c) k""",
    "catalog": """SELECT p_partkey AS pid, p_name AS name, p_retailprice AS price, p_type AS product_type,
        p_brand AS sku, p_size % 7 <> 0 AS in_stock, string_split(p_type, ' ') AS tags, p_size AS size FROM part""",
}


def with_models(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it (transitively) needs."""
    deps = {
        "detections": ["ph_prev", "competitors", "products"],
        "ph_prev": ["price_history"],
        "pending_alerts": ["detections"],
        "alert_history": ["pending_alerts"],
        "insights": ["products"],
        "user_alert_settings": ["users"],
    }
    order: list[str] = []

    def visit(n):
        for d in deps.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({MODEL_CTES[n]})" for n in order)
    if not ctes:
        return body
    b = body.lstrip()
    if b[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{b[14:].lstrip()}"
    if b[:4].upper() == "WITH":
        return f"WITH {ctes},\n{b[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
