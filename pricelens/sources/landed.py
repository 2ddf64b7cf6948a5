"""Landed catalog pages built from the ``part`` table (test stand-ins).

Each part row becomes a product of one of six stores (``pid % 6``); stores
0-2 serve products.json, store 1 also a storefront GraphQL fallback, store 3
storefront only, store 4 the Woo Store API and store 5 Woo REST.  Pages hold
50 products.  The builders only serialise rows into the documented payload
shapes (with their edge cases); all parsing is done by ``catalog``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 50


def _base(parts: DataFrame) -> DataFrame:
    return (parts.withColumn("s", F.col("pid") % 6)
            .withColumn("store", F.concat(F.lit("https://store"), F.col("s").cast("string"), F.lit(".example.com")))
            .withColumn("seq", (F.col("pid") / 6).cast("bigint"))
            .withColumn("page", (F.col("seq") / PAGE).cast("bigint"))
            .withColumn("handle", F.concat(F.replace(F.col("name"), F.lit(" "), F.lit("-")), F.lit("-"), F.col("pid").cast("string")))
            .withColumn("price_s", F.col("price").cast("decimal(10,2)").cast("string")))


def _pages(items: DataFrame, wrap) -> DataFrame:
    g = (items.groupBy("store", "page")
         .agg(F.array_sort(F.collect_list(F.struct("seq", "js"))).alias("a")))
    body = F.array_join(F.transform("a", lambda x: x["js"]), ",")
    return g.select("store", "page", wrap(body).alias("payload"))


def shopify_json_pages(parts: DataFrame) -> DataFrame:
    b = _base(parts).filter(F.col("s").isin(0, 1, 2))
    img = F.when(F.col("pid") % 3 == 0, F.array()).otherwise(
        F.array(F.struct(F.concat(F.lit("https://cdn.example.com/"), F.col("pid").cast("string"), F.lit(".jpg")).alias("src"))))
    variants = F.when(F.col("pid") % 13 == 0, F.array()).otherwise(F.array(
        F.struct((F.col("pid") * 10).alias("id"), F.col("price_s").alias("price"), F.col("sku"), F.col("in_stock").alias("available")),
        F.struct((F.col("pid") * 10 + 1).alias("id"), F.lit("0.01").alias("price"), F.col("sku"), F.lit(True).alias("available"))))
    common = [F.col("pid").alias("id"), F.col("name").alias("title"), F.col("handle"),
              F.concat(F.lit("<p>"), F.col("name"), F.lit("</p>")).alias("body_html"), F.col("product_type"), img.alias("images")]
    tags_arr = F.col("tags").alias("tags")
    tags_str = F.array_join(F.col("tags"), ", ").alias("tags")
    js = (F.when((F.col("pid") % 17 == 0) & (F.col("pid") % 2 == 0), F.to_json(F.struct(*common, tags_arr)))
          .when(F.col("pid") % 17 == 0, F.to_json(F.struct(*common, tags_str)))
          .when(F.col("pid") % 2 == 0, F.to_json(F.struct(*common, tags_arr, variants.alias("variants"))))
          .otherwise(F.to_json(F.struct(*common, tags_str, variants.alias("variants")))))
    return _pages(b.withColumn("js", js), lambda body: F.concat(F.lit('{"products":['), body, F.lit("]}")))


def storefront_pages(parts: DataFrame) -> DataFrame:
    b = _base(parts).filter(F.col("s").isin(1, 3))
    node = F.struct(
        F.col("name").alias("title"), F.col("handle"), F.col("name").alias("description"),
        F.col("product_type").alias("productType"), F.col("tags"),
        F.struct(F.struct(F.col("price_s").alias("amount"),
                          F.when(F.col("pid") % 5 == 0, F.lit("CAD")).alias("currencyCode")).alias("minVariantPrice")).alias("priceRange"),
        F.struct(F.array(F.struct(F.struct(F.concat(F.lit("https://cdn.example.com/"), F.col("pid").cast("string"),
                                                    F.lit(".png")).alias("url")).alias("node"))).alias("edges")).alias("images"),
        F.struct(F.array(F.struct(F.struct(F.concat(F.lit("gid://v/"), F.col("pid").cast("string")).alias("id"),
                                           F.col("in_stock").alias("availableForSale"), F.col("sku")).alias("node"))).alias("edges"))
        .alias("variants"))
    js = F.to_json(F.struct(node.alias("node")))
    err = (F.col("page") % 5 == 4)
    pages = _pages(b.withColumn("js", js), lambda body: F.concat(
        F.lit('{"data":{"products":{"edges":['), body, F.lit("]}}}")))
    return pages.withColumn("payload", F.when(err, F.concat(F.lit('{"errors":"throttled",'), F.substring("payload", 2, 1 << 30)))
                            .otherwise(F.col("payload")))


def woo_store_pages(parts: DataFrame) -> DataFrame:
    b = _base(parts).filter(F.col("s") == 4)
    unit = F.when(F.col("pid") % 11 == 0, F.lit(0)).otherwise(F.lit(2))
    amount = F.when(unit == 0, F.round("price").cast("bigint")).otherwise(F.round(F.col("price") * 100).cast("bigint")).cast("string")
    x = F.struct(
        F.col("pid").alias("id"), F.col("name"), F.col("handle").alias("slug"),
        F.when(F.col("pid") % 4 == 0, F.lit("")).otherwise(F.concat(F.col("store"), F.lit("/shop/"), F.col("handle"))).alias("permalink"),
        F.col("sku"), F.when(F.col("pid") % 3 == 0, F.lit("")).otherwise(F.col("name")).alias("description"),
        F.concat(F.lit("short "), F.col("name")).alias("short_description"),
        F.when(F.col("pid") % 7 != 1, F.col("in_stock")).alias("is_in_stock"),
        F.struct(amount.alias("price"), F.when(F.col("pid") % 5 == 0, F.lit("EUR")).otherwise(F.lit("USD")).alias("currency_code"),
                 unit.alias("currency_minor_unit")).alias("prices"),
        F.array(F.struct(F.concat(F.lit("https://img.example.com/"), F.col("pid").cast("string")).alias("src"))).alias("images"),
        F.transform("tags", lambda t: F.struct(t.alias("name"))).alias("categories"))
    return _pages(b.withColumn("js", F.to_json(x)), lambda body: F.concat(F.lit("["), body, F.lit("]")))


def woo_rest_pages(parts: DataFrame) -> DataFrame:
    b = _base(parts).filter(F.col("s") == 5)
    x = F.struct(
        F.col("pid").alias("id"), F.col("name"), F.col("handle").alias("slug"), F.lit("").alias("permalink"),
        F.col("sku"), F.col("name").alias("description"), F.lit("").alias("short_description"),
        F.col("price_s").alias("price"), F.col("in_stock"),
        F.array(F.struct(F.concat(F.lit("https://img.example.com/"), F.col("pid").cast("string")).alias("src"))).alias("images"),
        F.array(F.struct(F.try_element_at("tags", F.lit(1)).alias("name"))).alias("categories"),
        F.array(F.struct(F.col("sku").alias("name")), F.struct(F.lit("").alias("name"))).alias("tags"))
    return _pages(b.withColumn("js", F.to_json(x)), lambda body: F.concat(F.lit("["), body, F.lit("]")))


def landed_catalog(parts: DataFrame) -> dict[str, DataFrame]:
    return {"shopify_json": shopify_json_pages(parts), "shopify_storefront": storefront_pages(parts),
            "woo_store": woo_store_pages(parts), "woo_rest": woo_rest_pages(parts)}


# --- landed HTML (J5-J8 stand-ins) -------------------------------------------------

def _money(col, sym):
    return F.concat(F.lit(sym), F.format_number(col, 2))


def product_pages(parts: DataFrame) -> DataFrame:
    """One product page per part (url, page_id, html) in eight markup styles:
    Shopify theme, WooCommerce, itemprop, meta tag, data-price, a zero price
    before the real one, no price at all, and a Naira price."""
    pid = F.col("pid")
    k = pid % 8
    url = F.concat(F.lit("https://shop"), (pid % 4).cast("string"), F.lit(".example.com/item/"), pid.cast("string"))
    p = F.col("price")
    body = (F.when(k == 0, F.concat(F.lit('<html><head><script src="//cdn.shopify.com/s/t.js"></script></head><body>'
                                         '<h1>'), F.col("name"), F.lit('</h1><div class="price__current"><span class="money">'),
                                    _money(p, "$"), F.lit("</span></div>")))
            .when(k == 1, F.concat(F.lit('<html><body class="woocommerce"><h1>'), F.col("name"),
                                   F.lit('</h1><p class="price"><span class="woocommerce-Price-amount amount"><bdi>'),
                                   _money(p, "£"), F.lit("</bdi></span></p>")))
            .when(k == 2, F.concat(F.lit('<html><body><span itemprop="price" content="'), p.cast("decimal(10,2)").cast("string"),
                                   F.lit('">'), F.format_number(p, 2), F.lit(" €</span>")))
            .when(k == 3, F.concat(F.lit('<html><head><meta property="product:price:amount" content="'),
                                   p.cast("decimal(10,2)").cast("string"), F.lit('"></head><body>')))
            .when(k == 4, F.concat(F.lit('<html><body><div data-price="1">Now only '), _money(p, "C$"), F.lit("</div>")))
            .when(k == 5, F.concat(F.lit('<html><body><span class="price">$0.00</span><span class="price">'),
                                   _money(p, "$"), F.lit("</span>")))
            .when(k == 6, F.lit("<html><body><p>Call us for a quote</p>"))
            .otherwise(F.concat(F.lit('<html><body><div class="product-price">₦'), F.format_number(p * 100, 0), F.lit("</div>"))))
    return parts.select(pid.alias("page_id"), url.alias("url"), F.concat(body, F.lit("</body></html>")).alias("html"))


def listing_pages(parts: DataFrame, per_page: int = 8) -> DataFrame:
    """Catalog listing pages: groups of parts rendered as product cards in
    three styles; every fifth page has a single card plus a JSON-LD ItemList
    (so the card parser must fall through to JSON-LD)."""
    g = (F.col("pid") / per_page).cast("bigint")
    style = g % 5
    href = F.concat(F.lit("/products/"), F.replace(F.col("name"), F.lit(" "), F.lit("-")), F.lit("-"), F.col("pid").cast("string"))
    card = (F.when(style == 1, F.concat(
                F.lit('<div class="product"><span itemprop="name">'), F.col("name"), F.lit('</span><a href="'), href,
                F.lit('">more</a><div class="offer"><meta itemprop="priceCurrency" content="EUR"><span itemprop="price" content="'),
                F.col("price").cast("decimal(10,2)").cast("string"), F.lit('">see price</span></div><img src="/i/'),
                F.col("pid").cast("string"), F.lit('.png"></div>')))
            .otherwise(F.concat(
                F.lit('<div class="product-card"><h3 class="product-card__title">'), F.col("name"),
                F.lit('</h3><a href="'), href, F.lit('">view</a><div class="product-card__image"><img data-src="//img.example.com/'),
                F.col("pid").cast("string"), F.lit('.jpg"></div><span class="price">'), _money(F.col("price"), "£"),
                F.lit("</span></div>"))))
    ld_item = F.to_json(F.struct(F.lit("ListItem").alias("@type"), F.struct(
        F.lit("Product").alias("@type"), F.col("name").alias("name"), href.alias("url"),
        F.array(F.concat(F.lit("https://img.example.com/"), F.col("pid").cast("string"))).alias("image"),
        F.col("sku").alias("sku"),
        F.struct(F.col("price").cast("decimal(10,2)").cast("string").alias("price"), F.lit("GBP").alias("priceCurrency")).alias("offers")
    ).alias("item")))
    rows = parts.select(g.alias("page_id"), style.alias("style"), "pid", card.alias("card"), ld_item.alias("ld"))
    agg = rows.groupBy("page_id", "style").agg(F.array_sort(F.collect_list(F.struct("pid", "card", "ld"))).alias("a"))
    cards_html = F.array_join(F.transform("a", lambda x: x["card"]), "")
    single = F.try_element_at(F.col("a"), F.lit(1))["card"]
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"ItemList","itemListElement":['),
                  F.array_join(F.transform("a", lambda x: x["ld"]), ","), F.lit("]}</script>"))
    html = F.when(F.col("style") == 4, F.concat(F.lit("<html><head>"), ld, F.lit("</head><body>"), single, F.lit("</body></html>"))) \
        .otherwise(F.concat(F.lit("<html><body><div class='grid'>"), cards_html, F.lit("</div></body></html>")))
    url = F.concat(F.lit("https://list.example.com/collections/all?page="), F.col("page_id").cast("string"))
    return agg.select("page_id", url.alias("url"), html.alias("html"))
