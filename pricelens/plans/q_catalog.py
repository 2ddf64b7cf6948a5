"""Registered queries: catalog normalisation and discovery (A2-A5, G*, B5,
B6, F6, F8, F10, C11, D15, D16, K1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import materialize
from ..sources import catalog as CT
from ..sources.landed import landed_catalog
from .registry import query

_OUT = ["store", "source_rank", "page", "ordinal", "name", "price", "currency", "image_url", "product_url", "in_stock", "tags"]

# expected normalised rows, stated directly over part
_EXP = r"""
b AS (SELECT pid, name, price AS p, product_type, sku, in_stock, tags, pid % 6 AS s,
        'https://store' || CAST(pid % 6 AS VARCHAR) || '.example.com' AS store, pid // 6 AS seq, (pid // 6) // 50 AS page,
        replace(name, ' ', '-') || '-' || CAST(pid AS VARCHAR) AS handle,
        row_number() OVER (PARTITION BY pid % 6, (pid // 6) // 50 ORDER BY pid // 6) - 1 AS ordinal
      FROM catalog),
a2 AS (SELECT store, CAST(1 AS BIGINT) AS source_rank, page, ordinal,
        name, CASE WHEN pid % 17 = 0 THEN NULL ELSE CAST(CAST(p AS DECIMAL(10,2)) AS DOUBLE) END AS price, 'USD' AS currency,
        CASE WHEN pid % 3 = 0 THEN NULL ELSE 'https://cdn.example.com/' || CAST(pid AS VARCHAR) || '.jpg' END AS image_url,
        store || '/products/' || handle AS product_url, CASE WHEN pid % 17 = 0 THEN false ELSE in_stock END AS in_stock,
        list_filter(list_transform(tags, lambda x: trim(x)), lambda x: x <> '') AS tags, product_type, name AS description
      FROM b WHERE s IN (0, 1, 2) AND (pid % 13 <> 0 OR pid % 17 = 0)),
a3 AS (SELECT store, CAST(2 AS BIGINT) AS source_rank, page, ordinal,
        name, CAST(CAST(p AS DECIMAL(10,2)) AS DOUBLE) AS price, CASE WHEN pid % 5 = 0 THEN 'CAD' ELSE 'USD' END AS currency,
        'https://cdn.example.com/' || CAST(pid AS VARCHAR) || '.png' AS image_url,
        store || '/products/' || handle AS product_url, in_stock, tags,
        product_type, name AS description
      FROM b WHERE s IN (1, 3) AND page % 5 <> 4),
a4 AS (SELECT store, CAST(3 AS BIGINT) AS source_rank, page, ordinal,
        name, CASE WHEN pid % 11 = 0 THEN CAST(round(p) AS DOUBLE) ELSE CAST(CAST(CAST(round(p * 100) AS BIGINT) AS DECIMAL(38,0)) / 100 AS DOUBLE) END AS price,
        CASE WHEN pid % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
        'https://img.example.com/' || CAST(pid AS VARCHAR) AS image_url,
        CASE WHEN pid % 4 = 0 THEN store || '/product/' || handle ELSE store || '/shop/' || handle END AS product_url,
        CASE WHEN pid % 7 = 1 THEN true ELSE in_stock END AS in_stock, list_filter(tags, lambda x: x <> '') AS tags,
        NULL AS product_type, CASE WHEN pid % 3 = 0 THEN 'short ' || name ELSE name END AS description
      FROM b WHERE s = 4),
a5 AS (SELECT store, CAST(4 AS BIGINT) AS source_rank, page, ordinal,
        name, CAST(CAST(p AS DECIMAL(10,2)) AS DOUBLE) AS price, 'USD' AS currency,
        'https://img.example.com/' || CAST(pid AS VARCHAR) AS image_url, store || '/product/' || handle AS product_url,
        in_stock, list_filter([tags[1], sku], lambda x: x <> '') AS tags, NULL AS product_type, name AS description
      FROM b WHERE s = 5),
allrows AS (SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4 UNION ALL SELECT * FROM a5),
best AS (SELECT * FROM allrows a WHERE source_rank = (SELECT min(source_rank) FROM allrows x WHERE x.store = a.store))"""

_COLS = "store, source_rank, page, ordinal, name, price, currency, image_url, product_url, in_stock, tags"


def _landed(m):
    return landed_catalog(m.catalog)


def _norm(m):
    return CT.normalise(_landed(m))


@query("A2_shopify_catalog", f"WITH {_EXP} SELECT {_COLS} FROM a2", ("catalog",))
def a2(m):
    """A2: products.json pages -> unified rows."""
    return CT.shopify_products_json(_landed(m)["shopify_json"]).select(*_OUT)


@query("A3_storefront_catalog", f"WITH {_EXP} SELECT {_COLS} FROM a3", ("catalog",))
def a3(m):
    """A3: storefront GraphQL pages -> unified rows (error pages yield none)."""
    return CT.shopify_storefront(_landed(m)["shopify_storefront"]).select(*_OUT)


@query("A4_woo_store_catalog", f"WITH {_EXP} SELECT {_COLS} FROM a4", ("catalog",))
def a4(m):
    """A4: Woo Store API pages (minor units) -> unified rows."""
    return CT.woo_store_api(_landed(m)["woo_store"]).select(*_OUT)


@query("A5_woo_rest_catalog", f"WITH {_EXP} SELECT {_COLS} FROM a5", ("catalog",))
def a5(m):
    """A5: Woo REST pages -> unified rows."""
    return CT.woo_rest_api(_landed(m)["woo_rest"]).select(*_OUT)


@query("G1_union_catalogs", f"WITH {_EXP} SELECT {_COLS} FROM allrows", ("catalog",))
def g1(m):
    """G1 + G2: all landed pages of all sources in one table."""
    return _norm(m).select(*_OUT)


@query("F8_first_match_source", f"WITH {_EXP} SELECT store, source_rank, page, ordinal, name FROM best", ("catalog",))
def f8(m):
    """F8: per store only the best-ranked source that produced rows, decided by
    the response log."""
    return CT.discover(_landed(m)).select("store", "source_rank", "page", "ordinal", "name")


def _woo_answers(m):
    """The landed pages of WooCommerce stores whose endpoints answer
    differently: the REST products of store 5, once with an empty list from the
    store endpoint, once with an error object, once without an answer, and a
    store that answers with empty lists only."""
    landed = _landed(m)
    rest, api = landed["woo_rest"], landed["woo_store"]
    named = lambda df, name: df.withColumn("store", F.lit(f"https://{name}.example.com"))
    one = rest.filter(F.col("page") == 0)
    answer = lambda name, payload: named(one, name).withColumn("payload", F.lit(payload))
    landed["woo_store"] = (api.unionByName(answer("quiet", " []")).unionByName(answer("refused", '{"code":"rest_no_route"}'))
                           .unionByName(answer("bare", "[]")))
    landed["woo_rest"] = (rest.unionByName(named(rest, "quiet")).unionByName(named(rest, "refused"))
                          .unionByName(named(rest, "silent")).unionByName(answer("bare", "[]")))
    return landed


_ANSWERS = f"""{_EXP},
answers AS (SELECT store, source_rank, page, ordinal, name FROM best
  UNION ALL SELECT 'https://' || n.name || '.example.com', source_rank, page, ordinal, a5.name
  FROM a5, (VALUES ('refused'), ('silent')) n(name))"""


@query("F8_answered_empty", f"WITH {_ANSWERS} SELECT * FROM answers", ("catalog",))
def f8e(m):
    """F8: an endpoint that answers with an empty list wins over later ones; an
    error answer, or none, does not."""
    return CT.discover(_woo_answers(m)).select("store", "source_rank", "page", "ordinal", "name")


@query("F8_response_log", f"""WITH {_EXP},
log AS (SELECT store, source_rank, count(*) AS n FROM allrows GROUP BY 1, 2
  UNION ALL SELECT 'https://' || n.name || '.example.com', CAST(4 AS BIGINT), (SELECT count(*) FROM a5)
    FROM (VALUES ('quiet'), ('refused'), ('silent')) n(name)
  UNION ALL SELECT * FROM (VALUES ('https://quiet.example.com', CAST(3 AS BIGINT), CAST(0 AS BIGINT)),
    ('https://refused.example.com', 3, 0), ('https://bare.example.com', 3, 0), ('https://bare.example.com', 4, 0)) v),
chosen AS (SELECT store, min(source_rank) AS source_rank FROM allrows GROUP BY 1
  UNION ALL SELECT * FROM (VALUES ('https://quiet.example.com', CAST(3 AS BIGINT)), ('https://refused.example.com', 4),
    ('https://silent.example.com', 4)) v)
SELECT l.store, l.source_rank, CAST(l.n AS BIGINT) AS n, l.store <> 'https://refused.example.com' OR l.source_rank = 4 AS answered,
  c.source_rank IS NOT NULL AS chosen
FROM log l LEFT JOIN chosen c ON c.store = l.store AND c.source_rank = l.source_rank""", ("catalog",))
def f8l(m):
    """F8: the response log by store and endpoint, and the endpoint that counts."""
    headers = CT.page_headers(_woo_answers(m))
    log = headers.groupBy("store", "source_rank").agg(F.sum("n").alias("n"), F.max("answered").alias("answered"))
    chosen = CT.choose_sources(headers).withColumn("chosen", F.lit(True))
    return (log.join(chosen, ["store", "source_rank"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
            .select("store", F.col("source_rank").cast("bigint").alias("source_rank"), "n", "answered", "chosen"))


@query("B5_keyword_filter", f"""WITH {_EXP}
SELECT store, source_rank, page, ordinal FROM allrows
WHERE contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(product_type, ''), array_to_string(coalesce(tags, []), ' '),
                              coalesce(description, ''))), 'ring')
   OR contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(product_type, ''), array_to_string(coalesce(tags, []), ' '),
                              coalesce(description, ''))), 'bolt')""", ("catalog",))
def b5(m):
    """Keyword 'Ring  BOLT' (any word, case-insensitive)."""
    return CT.keyword_filter(_norm(m), "Ring  BOLT").select("store", "source_rank", "page", "ordinal")


@query("B6_stock_filter", f"WITH {_EXP} SELECT store, source_rank, page, ordinal FROM allrows WHERE NOT in_stock", ("catalog",))
def b6(m):
    """Out-of-stock rows."""
    return CT.stock_filter(_norm(m), "out_of_stock").select("store", "source_rank", "page", "ordinal")


_F6 = f"""WITH {_EXP},
r AS (SELECT *, page AS pg, row_number() OVER (PARTITION BY store ORDER BY page, ordinal) AS rn FROM best),
fp AS (SELECT store, pg, min(rn) AS first FROM r GROUP BY 1, 2),
f AS (SELECT r.* FROM r JOIN fp USING (store, pg) WHERE fp.first <= 30),
k AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY page, ordinal) AS rank_in_store FROM f
      WHERE contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(product_type, ''),
                     array_to_string(coalesce(tags, []), ' '), coalesce(description, ''))), 'widget'))"""


@query("F6_limit_after_filter", _F6 + " SELECT store, page, ordinal, rank_in_store FROM k WHERE rank_in_store <= 7", ("catalog",))
def f6(m):
    """fetch budget of 30 rows per store (whole pages), keyword 'widget',
    then the first 7."""
    return CT.fetch_filter_limit(CT.discover(_landed(m), max_fetch=30), "widget", 7).select(
        "store", "page", "ordinal", "rank_in_store")


@query("F10_single_product", f"""WITH {_EXP}
SELECT store, page, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY page, ordinal) AS rn FROM best) t WHERE rn = 1""",
       ("catalog",))
def f10(m):
    """first product per store."""
    return CT.single_product(CT.discover(_landed(m))).select("store", "page", "ordinal")


@query("D16_discovery_result", _F6.replace("fp.first <= 30", "true") + """,
found AS (SELECT store, min(CASE WHEN source_rank <= 2 THEN 'shopify' ELSE 'woocommerce' END) AS platform, count(*) AS total_found,
  list(name ORDER BY page, ordinal) AS names, list(price ORDER BY page, ordinal) AS prices,
  list(currency ORDER BY page, ordinal) AS currencies, list(product_url ORDER BY page, ordinal) AS urls
  FROM k WHERE rank_in_store <= 20 GROUP BY store),
err AS (SELECT DISTINCT store, left('HTTP 503 from ' || store || repeat(' retry', 50), 200) AS error FROM b WHERE s % 2 = 1
        UNION ALL SELECT 'https://gone.example.com', 'not found')
SELECT store, platform, total_found, names, prices, currencies, urls, error FROM found FULL JOIN err USING (store)""",
       ("catalog",))
def d16(m):
    """Per store the discovery result for keyword 'widget', limit 20, and
    the errors of stores that failed (one of them without any row)."""
    landed = _landed(m)
    odd = F.regexp_extract("store", r"store(\d+)", 1).cast("bigint") % 2 == 1
    log = materialize(CT.page_headers(landed), "response_log")
    errors = (log.filter("n > 0").select("store").distinct().filter(odd)
              .withColumn("error", F.concat(F.lit("HTTP 503 from "), "store", F.repeat(F.lit(" retry"), F.lit(50))))
              .unionByName(m.raw("region").limit(1).select(F.lit("https://gone.example.com").alias("store"),
                                                           F.lit("not found").alias("error"))))
    r = CT.discovery_result(CT.discover(landed, log=log), "widget", 20, errors=errors, decided=True)
    part = {n: F.col("products").getField(c) for c, n in (("name", "names"), ("price", "prices"),
                                                          ("currency", "currencies"), ("product_url", "urls"))}
    part["prices"] = part["prices"].cast("array<double>")
    return r.select("store", "platform", "total_found", *[c.alias(n) for n, c in part.items()], "error")


@query("C11_select_join", f"""WITH {_EXP},
sel AS (SELECT DISTINCT product_url FROM allrows WHERE in_stock
        UNION SELECT 'https://gone.example.com/p/' || CAST(pid AS VARCHAR) FROM b WHERE pid % 97 = 0),
firsts AS (SELECT product_url, name, price, currency FROM (
             SELECT *, row_number() OVER (PARTITION BY product_url ORDER BY store, source_rank, page, ordinal) AS rn FROM allrows) t
           WHERE rn = 1)
SELECT s.product_url, f.name, f.price, coalesce(f.currency, 'USD') AS currency FROM sel s LEFT JOIN firsts f USING (product_url)""",
       ("catalog",))
def c11(m):
    """C11 + D15: selected URLs (a set: every in-stock discovered product plus
    URLs no longer in any catalog) joined to their first discovered row."""
    cat = _norm(m)
    chosen = cat.filter(F.col("in_stock")).select("product_url")
    gone = m.catalog.filter(F.col("pid") % 97 == 0).select(
        F.concat(F.lit("https://gone.example.com/p/"), F.col("pid").cast("string")).alias("product_url"))
    return CT.select_join(chosen.unionByName(gone), cat)


@query("F8_handler_fallback")
def f8h(m):
    """F8 across all handlers: Shopify (products.json, then storefront),
    WooCommerce (store API, then REST), then the generic HTML handler (cards,
    else JSON-LD) for stores that only serve pages."""
    from ..sources.landed import listing_pages
    landed = dict(_landed(m))
    landed["generic_html"] = listing_pages(m.catalog)
    return CT.discover(landed).select("store", "source_rank", "name", "price", "currency")
