"""Registered queries: scalar functions (H*, I*, B14-B16) over text drawn
from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import price as P
from ..functions import text as TX
from ..functions import timefmt as TF
from ..functions import url as U
from .registry import AS_OF, query

# price texts: events.value rendered with the currency spellings the scrapers see
_PRICE_TEXT_SQL = """
pt AS (SELECT event_id, CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) AS v,
              CAST(json_extract_string(props, '$.k') AS BIGINT) % 9 AS k FROM events),
texts AS (SELECT event_id, CASE k WHEN 0 THEN '$' || v WHEN 1 THEN '₦' || v WHEN 2 THEN 'C$' || chr(160) || v
   WHEN 3 THEN '€' || v WHEN 4 THEN '£' || v WHEN 5 THEN v || ' ngn' WHEN 6 THEN 'Rs. ' || v
   WHEN 7 THEN replace(v, '.', ',') || ' €' ELSE 'from $' || v || ' - $' || v END AS text FROM pt)"""


def _price_texts(m):
    e = m.raw("events")
    v = F.col("value").cast("decimal(10,2)").cast("string")
    k = F.get_json_object("props", "$.k").cast("bigint") % 9
    t = (F.when(k == 0, F.concat(F.lit("$"), v)).when(k == 1, F.concat(F.lit("₦"), v))
         .when(k == 2, F.concat(F.lit("C$ "), v)).when(k == 3, F.concat(F.lit("€"), v))
         .when(k == 4, F.concat(F.lit("£"), v)).when(k == 5, F.concat(v, F.lit(" ngn")))
         .when(k == 6, F.concat(F.lit("Rs. "), v)).when(k == 7, F.concat(F.replace(v, F.lit("."), F.lit(",")), F.lit(" €")))
         .otherwise(F.concat(F.lit("from $"), v, F.lit(" - $"), v)))
    return e.select("event_id", t.alias("text"))


def _sql_parse(cleaned):
    return (f"CASE WHEN regexp_matches({cleaned}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') "
            f"THEN CAST(TRY_CAST({cleaned} AS DECIMAL(18,4)) AS DOUBLE) END")


_WS = r"\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}\x{2028}\x{2029}\x{0085}"
_H1_CLEAN = f"regexp_replace(regexp_replace(text, '[£€$₦,{_WS}]', '', 'g'), '[A-Za-z]', '', 'g')"
_H2_CLEAN = f"regexp_replace(regexp_replace(text, '[£€$¥₹,{_WS}]', '', 'g'), '[A-Za-z]', '', 'g')"


@query("H1_parse_price", f"""WITH {_PRICE_TEXT_SQL}
SELECT event_id, text, {_sql_parse(_H1_CLEAN)} AS price,
  CASE WHEN text IS NULL OR text = '' THEN 'USD' WHEN contains(text, '₦') OR contains(upper(text), 'NGN') THEN 'NGN'
       WHEN contains(text, '£') THEN 'GBP' WHEN contains(text, '€') THEN 'EUR'
       WHEN contains(text, 'CAD') OR contains(text, 'C$') THEN 'CAD' ELSE 'USD' END AS currency FROM texts""")
def h1(m):
    """H1: price text -> (price, currency), reference mode."""
    t = _price_texts(m)
    p = P.parse_price(F.col("text"))
    return t.select("event_id", "text", p["price"].alias("price"), p["currency"].alias("currency"))


@query("H2_parse_price_catalog", f"""WITH {_PRICE_TEXT_SQL}
SELECT event_id, {_sql_parse(_H2_CLEAN)} AS price,
  CASE WHEN text IS NULL OR text = '' THEN 'USD' WHEN contains(text, '£') THEN 'GBP' WHEN contains(text, '€') THEN 'EUR'
       WHEN contains(text, '¥') THEN 'JPY' WHEN contains(text, '₹') THEN 'INR' ELSE 'USD' END AS currency FROM texts""")
def h2(m):
    """H2: catalog-card price text -> (price, currency)."""
    p = P.parse_price_catalog(F.col("text"))
    return _price_texts(m).select("event_id", p["price"].alias("price"), p["currency"].alias("currency"))


@query("H3_minor_units", """
SELECT p_partkey AS pid, CAST(CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS DECIMAL(38,0)) / 100 AS DOUBLE) AS price
FROM part""")
def h3(m):
    """H3: integer minor-unit strings (from part prices) back to decimals."""
    c = m.catalog
    minor = F.round(F.col("price") * 100).cast("bigint").cast("string")
    return c.select("pid", P.minor_units(minor, F.lit(2)).alias("price"))


_NETLOC = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)"
_HOST = f"lower(regexp_replace(regexp_replace({_NETLOC}, '^.*@', ''), ':[^:]*$', ''))"


@query("H4_domain", f"""
SELECT page_id, {_NETLOC} AS netloc, regexp_replace({_NETLOC}, '^www\\.', '') AS strip,
  CASE WHEN regexp_replace(lower({_NETLOC}), '^www\\.', '') = '' THEN 'Unknown'
       ELSE regexp_replace(lower({_NETLOC}), '^www\\.', '') END AS export,
  replace({_NETLOC}, 'www.', '') AS no_www, regexp_replace(lower({_NETLOC}), '^www\\.', '') AS lower_,
  CASE WHEN {_HOST} = '' THEN url ELSE regexp_replace({_HOST}, '^(.*?)www\\.', '\\1') END AS hostname
FROM pages""")
def h4(m):
    """H4: the six domain spellings of every page URL."""
    u = F.col("url")
    return m.raw("pages").select("page_id", U.domain_of(u, "netloc").alias("netloc"), U.domain_of(u, "strip").alias("strip"),
                                 U.domain_of(u, "export").alias("export"), U.domain_of(u, "no_www").alias("no_www"),
                                 U.domain_of(u, "lower").alias("lower_"), U.domain_of(u, "hostname").alias("hostname"))


@query("H5_retailer_or_domain", r"""
SELECT id, coalesce(CASE WHEN retailer_name <> '' THEN retailer_name END,
  regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1), '^www\.', '')) AS competitor_name
FROM competitors""", ("competitors",))
def h5(m):
    """H5: retailer name or domain."""
    return m.competitors.select("id", U.retailer_or_domain(F.col("retailer_name"), F.col("url")).alias("competitor_name"))


_URL_IN_SQL = """
ui AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?://', '')
                                     WHEN 1 THEN chr(9) || ' ' || url || chr(160) || chr(10)
                                     WHEN 2 THEN replace(regexp_replace(url, '^https?://', ''), '.', ' ')
                                     ELSE url END AS raw FROM pages)"""


def _url_inputs(m):
    p = m.raw("pages")
    k = F.col("page_id") % 4
    raw = (F.when(k == 0, F.regexp_replace("url", "^https?://", ""))
           .when(k == 1, F.concat(F.lit("\t "), F.col("url"), F.lit("\u00a0\n")))
           .when(k == 2, F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("."), F.lit(" ")))
           .otherwise(F.col("url")))
    return p.select("page_id", raw.alias("raw"))


@query("B14_url_normalise", f"""WITH {_URL_IN_SQL},
t AS (SELECT page_id, regexp_replace(raw, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g') AS u FROM ui)
SELECT page_id,
  CASE WHEN u = '' OR lower(u) LIKE 'http://%' THEN NULL
       WHEN starts_with(u, 'https://') THEN u
       WHEN contains(u, '.') AND NOT contains(u, ' ') THEN 'https://' || u END AS url,
  CASE WHEN u = '' THEN '{U.ERR_EMPTY}' WHEN lower(u) LIKE 'http://%' THEN '{U.ERR_HTTP}'
       WHEN NOT starts_with(u, 'https://') AND NOT (contains(u, '.') AND NOT contains(u, ' '))
       THEN '{U.ERR_FORMAT}' END AS error FROM t""")
def b14(m):
    """User-typed URLs -> (normalised url, error)."""
    n = U.normalise_url(F.col("raw"))
    return _url_inputs(m).select("page_id", n["url"].alias("url"), n["error"].alias("error"))


_SAFE_IN_SQL = """
si AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN regexp_replace(url, '^https?://[^/]*', 'https://10.0.0.' || CAST(page_id % 256 AS VARCHAR))
    WHEN 1 THEN regexp_replace(url, '^https?://[^/]*', 'https://172.' || CAST(10 + page_id % 30 AS VARCHAR) || '.1.1')
    WHEN 2 THEN regexp_replace(url, '^(https?://[^/]*)', '\\1.internal')
    WHEN 3 THEN regexp_replace(url, '^https?://[^/]*', 'https://localhost:8443')
    ELSE url END AS u FROM pages)"""


@query("B15_url_safety", f"""WITH {_SAFE_IN_SQL},
h AS (SELECT page_id, u, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)) AS sch,
        lower(regexp_replace(regexp_replace(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', ''), ':[^:]*$', '')) AS host
      FROM si)
SELECT page_id, err IS NULL AS ok, err AS error FROM (
  SELECT page_id, CASE WHEN sch <> 'https' THEN '{U.ERR_SCHEME}'
    WHEN regexp_matches(host, '{"|".join("(" + p + ")" for p in U.BLOCKED_HOST_PATTERNS)}')
      OR host IN ('169.254.169.254', 'metadata.google.internal')
      OR regexp_matches(host, '(\\.local|\\.localhost|\\.internal|\\.corp|\\.lan|\\.home|\\.intranet)$')
    THEN '{U.ERR_PRIVATE}' END AS err FROM h) t""")
def b15(m):
    """SSRF rules over page URLs with private / internal hosts mixed in."""
    p = m.raw("pages")
    k = F.col("page_id") % 6
    u = (F.when(k == 0, F.regexp_replace("url", "^https?://[^/]*", F.concat(F.lit("https://10.0.0."), (F.col("page_id") % 256).cast("string"))))
         .when(k == 1, F.regexp_replace("url", "^https?://[^/]*", F.concat(F.lit("https://172."), (F.lit(10) + F.col("page_id") % 30).cast("string"), F.lit(".1.1"))))
         .when(k == 2, F.regexp_replace("url", "^(https?://[^/]*)", "$1.internal"))
         .when(k == 3, F.regexp_replace("url", "^https?://[^/]*", "https://localhost:8443"))
         .otherwise(F.col("url")))
    s = U.url_safety(u)
    return p.select("page_id", s["ok"].alias("ok"), s["error"].alias("error"))


@query("H7_escape_name", r"""
SELECT conv_id, turn, replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '<', '&lt;'), '>', '&gt;') AS name
FROM conversations""")
def h7(m):
    """H7: trim and escape angle brackets (conversation turns as names)."""
    return m.raw("conversations").select("conv_id", "turn", TX.escape_name(F.col("text")).alias("name"))


@query("H10_safe_filename", r"""
SELECT p_partkey AS id, trim(regexp_replace(p_name || ' <' || p_brand || '>/' || p_type, '[^\p{L}\p{N}._ \-]', '_', 'g'))
  || '_price_history_20240131.csv' AS filename FROM part""")
def h10(m):
    """Export file names from (part) product names."""
    n = m.raw("part")
    name = F.concat(F.col("p_name"), F.lit(" <"), F.col("p_brand"), F.lit(">/"), F.col("p_type"))
    return n.select(F.col("p_partkey").alias("id"),
                    U.export_filename(name, F.lit("2024-01-31").cast("date")).alias("filename"))


@query("H12_user_name", """
WITH t AS (SELECT doc_id, generate_subscripts(regexp_extract_all(text, '[^\\s<>]*@[^\\s<>]*'), 1) - 1 AS pos,
                  unnest(regexp_extract_all(text, '[^\\s<>]*@[^\\s<>]*')) AS e FROM documents
  UNION ALL SELECT doc_id, -1, source FROM documents UNION ALL SELECT doc_id, -2, '' FROM documents
  UNION ALL SELECT doc_id, -3, NULL FROM documents)
SELECT doc_id, pos, CASE WHEN coalesce(e, '') = '' THEN 'User' ELSE split_part(e, '@', 1) END AS name FROM t""")
def h12(m):
    """Greeting name for every address-like token of the documents, for a
    text without '@', and for an empty and a missing one."""
    docs = m.raw("documents")
    d = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\s<>]*@[^\s<>]*"), 0)).alias("pos", "e"))
    for pos, e in ((-1, F.col("source")), (-2, F.lit("")), (-3, F.lit(None).cast("string"))):
        d = d.unionByName(docs.select("doc_id", F.lit(pos).alias("pos"), e.alias("e")))
    return d.select("doc_id", "pos", TX.user_name(F.col("e")).alias("name"))


@query("H13_format_money", """
SELECT id, CASE WHEN price IS NULL OR price = 0 THEN 'Price N/A'
  ELSE CASE currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' ELSE currency || ' ' END || format('{:,.2f}', price) END AS text
FROM price_history""", ("price_history",))
def h13(m):
    """Money display text."""
    return m.price_history.select("id", P.format_money(F.col("price"), F.col("currency")).alias("text"))


@query("H16_truncate_error", "SELECT doc_id, left(text, 200) AS err FROM documents")
def h16(m):
    """Error texts cut to 200 characters (documents as error bodies)."""
    return m.raw("documents").select("doc_id", TX.truncate_error(F.col("text")).alias("err"))


@query("H17_platform_of_html", """
SELECT page_id, CASE WHEN contains(lower(html), 'shopify') THEN 'shopify'
  WHEN contains(lower(html), 'woocommerce') OR contains(lower(html), 'wc-block') THEN 'woocommerce' END AS platform
FROM pages""")
def h17(m):
    """Platform detected from page text."""
    return m.raw("pages").select("page_id", U.platform_of_html(F.col("html")).alias("platform"))


@query("I5_time_ago", """
SELECT id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN CAST(m AS VARCHAR) || 'm ago'
  WHEN h < 24 THEN CAST(h AS VARCHAR) || 'h ago' WHEN d < 7 THEN CAST(d AS VARCHAR) || 'd ago'
  ELSE strftime(detected_at, '%-m/%-d/%Y') END AS ago FROM (
  SELECT id, detected_at, CAST(floor(ms / 60000) AS BIGINT) AS m, CAST(floor(ms / 3600000) AS BIGINT) AS h, CAST(floor(ms / 86400000) AS BIGINT) AS d FROM (
    SELECT id, detected_at, date_diff('millisecond', detected_at, TIMESTAMP '2024-01-31 00:00:00') AS ms FROM pending_alerts) a) b""",
       ("pending_alerts",))
def i5(m):
    """Relative time of alerts."""
    return m.pending_alerts.select("id", TF.time_ago(F.col("detected_at"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("ago"))


@query("I6_due_check", """
SELECT h.id, h.digest_sent_at IS NULL OR date_diff('second', h.digest_sent_at, TIMESTAMP '2024-01-20 00:00:00')
  >= coalesce(s.digest_frequency_hours, 24) * 3600 AS due
FROM alert_history h LEFT JOIN user_alert_settings s ON s.user_id = h.user_id""", ("alert_history", "user_alert_settings"))
def i6(m):
    """Would a digest be due on 2024-01-20 counting from each past digest
    (its user's frequency, 24 h without settings)."""
    h = m.alert_history.join(m.user_alert_settings.select("user_id", "digest_frequency_hours"), "user_id", "left")
    return h.select("id", TF.digest_due(F.col("digest_sent_at"), F.coalesce("digest_frequency_hours", F.lit(24)),
                                        F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).alias("due"))


@query("I9_fmt_pct", """
SELECT id, CASE WHEN price_change_percent IS NULL OR price_change_percent = 0 THEN ''
  ELSE CASE WHEN alert_type = 'price_drop' THEN '-' ELSE '+' END
       || CAST(round_even(CAST(abs(price_change_percent) AS DECIMAL(20,4)), 1) AS VARCHAR) || '%' END AS txt
FROM pending_alerts""", ("pending_alerts",))
def i9(m):
    """Signed one-decimal percent text."""
    return m.pending_alerts.select("id", P.format_signed_pct(F.col("price_change_percent"),
                                                            F.col("alert_type") == "price_drop").alias("txt"))


@query("B16_threshold_validation", """
SELECT id, alert_threshold_percent BETWEEN 0 AND 100 AS threshold_ok,
  length(coalesce(retailer_name, '')) <= 100 AS name_ok FROM competitors""", ("competitors",))
def b16(m):
    """Request validation rules as boolean columns."""
    c = m.competitors
    return c.select("id", F.col("alert_threshold_percent").between(0, 100).alias("threshold_ok"),
                    (F.char_length(F.coalesce("retailer_name", F.lit(""))) <= 100).alias("name_ok"))
