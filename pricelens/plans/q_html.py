"""Registered queries: HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import html as HT
from ..sources.landed import listing_pages, product_pages
from .registry import query


@query("A6_html_pages", """
SELECT page_id, octet_length(encode(html)) AS n_bytes, CASE WHEN octet_length(encode(html)) > 20000
  THEN 'Page body exceeds 20000 bytes' END AS landed_error,
  CASE WHEN octet_length(encode(html)) <= 20000 THEN octet_length(encode(html)) END AS kept_bytes FROM pages""")
def a6(m):
    """Landed pages, all bodies kept; and what a limit of 20,000 bytes,
    given as a parameter, reports."""
    p = m.raw("pages")
    own = HT.landed_html(p).select("page_id", F.octet_length("html").alias("n_bytes"))
    cut = HT.landed_html(p, 20_000).select("page_id", "landed_error", F.octet_length("html").alias("kept_bytes"))
    return own.join(cut, "page_id")


def _parts(m) -> int:
    """The test tables are single files of one split: deal pages out before they are parsed."""
    return int(m.spark.conf.get("spark.sql.shuffle.partitions"))


def _join_sql(base: str, href: str) -> str:
    """The reference's rule for one link, written over path segments."""
    origin = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1)"
    path = f"regexp_extract({base}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
    own = f"string_split(regexp_extract({href}, '^[^?#]*'), '/')"
    rest = f"substr({href}, length(regexp_extract({href}, '^[^?#]*')) + 1)"
    up = f"string_split({path}, '/')"
    up = f"CASE WHEN {up}[-1] <> '' THEN {up}[:-2] ELSE {up} END"
    both = f"({up} || {own})"
    both = f"CASE WHEN len{both} > 2 THEN [{both}[1]] || list_filter({both}[2:-2], lambda x: x <> '') || [{both}[-1]] ELSE {both} END"

    def fold(segs):
        kept = (f"list_reduce(list_transform({segs}, lambda x: [x]), lambda a, x: CASE WHEN x[1] = '..' THEN a[1:len(a) - 1] "
                "WHEN x[1] = '.' THEN a ELSE a || x END, CAST([] AS VARCHAR[]))")
        text = f"array_to_string({kept} || CASE WHEN ({segs})[-1] IN ('.', '..') THEN [''] ELSE [] END, '/')"
        return f"CASE WHEN starts_with({text}, '/') THEN {text} ELSE '/' || {text} END"
    return f"""CASE WHEN {href} IS NULL OR {href} = '' THEN {base}
  WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN {href}
  WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^[^:]*') || ':' || {href}
  WHEN starts_with({href}, '/') THEN {origin} || {fold(own)} || {rest}
  WHEN starts_with({href}, '?') THEN {origin} || {path} || {href}
  WHEN starts_with({href}, '#') THEN regexp_extract({base}, '^[^#]*') || {href}
  ELSE {origin} || {fold(both)} || {rest} END"""


@query("H6_url_join", f"""
WITH h AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href,
                  generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
d AS (SELECT *, base || '/a/b/c/d/e/f/' AS deep, repeat('../', CAST((page_id + pos) % 9 AS INTEGER)) || './x/' || page_id AS up FROM h)
SELECT page_id, pos, {_join_sql("base", "href")} AS link, {_join_sql("deep", "up")} AS up_link FROM d""")
def h6(m):
    """H6: every link of every page resolved against the page URL; and, from a
    folder six levels below it, a link that climbs zero to eight levels."""
    p = m.raw("pages").select("page_id", F.col("url").alias("base"),
                              F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("pos", "href"))
    climbs = F.repeat(F.lit("../"), ((F.col("page_id") + F.col("pos")) % 9).cast("int"))
    up = F.concat(climbs, F.lit("./x/"), F.col("page_id").cast("string"))
    return p.select("page_id", "pos", U.url_join(F.col("base"), F.col("href")).alias("link"),
                    U.url_join(F.concat("base", F.lit("/a/b/c/d/e/f/")), up).alias("up_link"))


@query("H18_platform_of_payload")
def h18(m):
    """Platform of landed responses (catalog JSON pages and HTML pages)."""
    from ..sources.landed import landed_catalog
    land = landed_catalog(m.catalog)
    j = (land["shopify_json"].unionByName(land["shopify_storefront"]).unionByName(land["woo_store"])
         .unionByName(land["woo_rest"])
         .select(F.col("payload").alias("body"), F.col("store").alias("url"), "page"))
    h = m.raw("pages").select(F.col("html").alias("body"), "url", F.lit(None).cast("bigint").alias("page"))
    return j.unionByName(h).select("url", "page", U.platform_of_payload(F.col("body"), F.col("url")).alias("platform"))


@query("J4_html_elements")
def j4(m):
    """Element table of every landed page (whole pages)."""
    e = HT.html_elements(m.raw("pages"), _parts(m), text=False, ancestors=False)
    return e.select("page_id", "idx", "parent", "depth", "tag", "elem_id", F.size("classes").alias("n_classes"),
                    (F.col("c1") - F.col("c0")).alias("text_len"))


@query("J5_page_price")
def j5(m):
    """Price cascade over product pages (eight markup styles)."""
    return HT.page_price(product_pages(m.catalog), partitions=_parts(m))


@query("J6_product_cards")
def j6(m):
    """J6 + J7: product cards of listing pages, JSON-LD when cards fail."""
    return HT.generic_catalog(listing_pages(m.catalog), _parts(m)).drop("ordinal")


@query("J7_json_ld")
def j7(m):
    """JSON-LD products of listing pages."""
    return HT.json_ld_products(listing_pages(m.catalog))


@query("J8_scrape_result")
def j8(m):
    """Scrape result per competitor: URL rules, then the landed page's
    price (competitors point at the product pages of their part)."""
    pages = product_pages(m.catalog)
    c = m.competitors.select(
        F.col("id").alias("competitor_id"),
        F.when(F.col("id") % 10 == 3, F.concat(F.lit("http://shop.example.com/x/"), F.col("id").cast("string")))
         .when(F.col("id") % 10 == 7, F.concat(F.lit("https://192.168.0."), (F.col("id") % 200).cast("string")))
         .otherwise(F.concat(F.lit("shop"), (F.col("id") % 4).cast("string"), F.lit(".example.com/item/"),
                             (F.col("id") * 7 % 2000).cast("string"))).alias("url"))
    return HT.scrape_result(c, pages, partitions=_parts(m))


# --- oracle SQL for the HTML queries: expected values stated from the part rows
# by the markup rules of ``sources.landed`` (the Spark side parses the pages)
from ..functions.url import ERR_HTTP, ERR_PRIVATE  # noqa: E402
from .registry import ORACLE  # noqa: E402

_J5_EXPECTED = """
pp AS (SELECT p_partkey AS page_id,
         'https://shop' || CAST(p_partkey % 4 AS VARCHAR) || '.example.com/item/' || CAST(p_partkey AS VARCHAR) AS url,
         CASE p_partkey % 8 WHEN 6 THEN NULL WHEN 7 THEN CAST(round(p_retailprice * 100) AS DOUBLE)
              ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) END AS price,
         CASE p_partkey % 8 WHEN 1 THEN 'GBP' WHEN 2 THEN 'EUR' WHEN 4 THEN 'CAD' WHEN 7 THEN 'NGN' ELSE 'USD' END AS currency
       FROM part)"""

ORACLE["J5_page_price"] = f"WITH {_J5_EXPECTED} SELECT page_id, price, currency FROM pp"

ORACLE["J8_scrape_result"] = f"""WITH {_J5_EXPECTED},
t AS (SELECT c_custkey AS competitor_id,
        CASE WHEN c_custkey % 10 = 3 THEN 'http' WHEN c_custkey % 10 = 7 THEN 'private' ELSE 'ok' END AS kind,
        'https://shop' || CAST(c_custkey % 4 AS VARCHAR) || '.example.com/item/' || CAST((c_custkey * 7) % 2000 AS VARCHAR) AS nurl
      FROM customer)
SELECT t.competitor_id, CASE WHEN kind = 'ok' THEN pp.price END AS price,
  CASE WHEN kind = 'ok' AND pp.price IS NOT NULL THEN pp.currency ELSE 'USD' END AS currency,
  CASE WHEN kind = 'ok' AND pp.price IS NOT NULL THEN 'success' ELSE 'failed' END AS status,
  CASE kind WHEN 'http' THEN '{ERR_HTTP}' WHEN 'private' THEN '{ERR_PRIVATE}'
       ELSE CASE WHEN pp.price IS NULL THEN '{HT.FAIL_MESSAGE}' END END AS error_message
FROM t LEFT JOIN pp ON pp.url = t.nurl"""

_LISTING = """
lp AS (SELECT p_partkey AS pid, p_name AS name, p_retailprice AS p, p_brand AS sku, p_partkey // 8 AS page_id,
         (p_partkey // 8) % 5 AS style, count(*) OVER (PARTITION BY p_partkey // 8) AS n_on_page,
         row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) - 1 AS pos,
         'https://list.example.com/products/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS product_url
       FROM part),
ld AS (SELECT page_id, CAST(0 AS BIGINT) AS block, pos, name, CAST(CAST(p AS DECIMAL(10,2)) AS DOUBLE) AS price, 'GBP' AS currency,
         'https://img.example.com/' || CAST(pid AS VARCHAR) AS image_url, product_url, sku, 'custom' AS platform
       FROM lp WHERE style = 4),
cards AS (SELECT page_id, name, CAST(CAST(p AS DECIMAL(10,2)) AS DOUBLE) AS price,
         CASE WHEN style = 1 THEN 'EUR' ELSE 'GBP' END AS currency, product_url,
         CASE WHEN style = 1 THEN 'https://list.example.com/i/' || CAST(pid AS VARCHAR) || '.png'
              ELSE 'https://img.example.com/' || CAST(pid AS VARCHAR) || '.jpg' END AS image_url,
         CAST(NULL AS VARCHAR) AS sku, 'custom' AS platform, 'cards' AS source
       FROM lp WHERE style <> 4 AND n_on_page >= 2)"""

ORACLE["J7_json_ld"] = f"WITH {_LISTING} SELECT * FROM ld"
ORACLE["J6_product_cards"] = f"""WITH {_LISTING}
SELECT page_id, name, price, currency, product_url, image_url, sku, platform, source FROM cards
UNION ALL SELECT page_id, name, price, currency, product_url, image_url, sku, platform, 'json_ld' FROM ld"""

ORACLE["H18_platform_of_payload"] = """
SELECT DISTINCT 'https://store' || CAST(p_partkey % 6 AS VARCHAR) || '.example.com' AS url, (p_partkey // 6) // 50 AS page,
  CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN 'shopify' ELSE 'woocommerce' END AS platform
FROM part WHERE p_partkey % 6 IN (0, 1, 2, 4, 5)
UNION ALL
SELECT DISTINCT 'https://store' || CAST(p_partkey % 6 AS VARCHAR) || '.example.com', (p_partkey // 6) // 50, 'custom'
FROM part WHERE p_partkey % 6 IN (1, 3)
UNION ALL
SELECT url, NULL, CASE WHEN contains(html, 'cdn.shopify') OR contains(html, 'Shopify.theme') THEN 'shopify'
  WHEN lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)) = 'https'
   AND regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1) <> '' THEN 'custom' END FROM pages"""


from ..sources.model_sql import with_models as _wm  # noqa: E402
from .q_catalog import _EXP  # noqa: E402

ORACLE["F8_handler_fallback"] = _wm(f"""WITH {_EXP}, {_LISTING},
gen AS (SELECT 'https://list.example.com' AS store, CAST(5 AS BIGINT) AS source_rank, name, price, currency FROM cards
        UNION ALL SELECT 'https://list.example.com', CAST(5 AS BIGINT), name, price, currency FROM ld)
SELECT store, source_rank, name, price, currency FROM best
UNION ALL SELECT * FROM gen""", "catalog")


@query("J4_html_elements_product_pages")
def j4p(m):
    """J4 on the landed product pages: per page the number of elements, the
    tag sequence in document order and the text of the root element."""
    e = HT.html_elements(product_pages(m.catalog), _parts(m), ancestors=False)
    g = e.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_elements"),
        F.array_sort(F.collect_list(F.struct("idx", "tag"))).alias("__t"),
        F.min_by("text", "idx").alias("root_text"))
    return g.select("page_id", "n_elements", F.array_join(F.transform("__t", lambda x: x["tag"]), ",").alias("tags"),
                    "root_text")


ORACLE["J4_html_elements_product_pages"] = """
SELECT p_partkey AS page_id,
  CAST(CASE p_partkey % 8 WHEN 0 THEN 7 WHEN 1 THEN 6 WHEN 3 THEN 4 WHEN 5 THEN 4 ELSE 3 END AS BIGINT) AS n_elements,
  CASE p_partkey % 8 WHEN 0 THEN 'html,head,script,body,h1,div,span' WHEN 1 THEN 'html,body,h1,p,span,bdi'
       WHEN 2 THEN 'html,body,span' WHEN 3 THEN 'html,head,meta,body' WHEN 4 THEN 'html,body,div'
       WHEN 5 THEN 'html,body,span,span' WHEN 6 THEN 'html,body,p' ELSE 'html,body,div' END AS tags,
  CASE p_partkey % 8 WHEN 0 THEN p_name || '$' || format('{:,.2f}', p_retailprice)
       WHEN 1 THEN p_name || '£' || format('{:,.2f}', p_retailprice)
       WHEN 2 THEN format('{:,.2f}', p_retailprice) || ' €'
       WHEN 3 THEN ''
       WHEN 4 THEN 'Now only C$' || format('{:,.2f}', p_retailprice)
       WHEN 5 THEN '$0.00$' || format('{:,.2f}', p_retailprice)
       WHEN 6 THEN 'Call us for a quote'
       ELSE '₦' || format('{:,.0f}', p_retailprice * 100) END AS root_text
FROM part"""
