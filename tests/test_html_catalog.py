"""HTML and catalog operators on small hand-made pages / payloads."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from pricelens.operators import html as HT
from pricelens.sources import catalog as CT

PAGES = [
    (1, "https://s.example.com/p/1",
     '<html><script src="https://cdn.shopify.com/x.js"></script><body><span class="price">$5.00</span>'
     '<div class="price__current"><span class="money">$0.00</span><span class="money">$12.50</span></div></body></html>'),
    (2, "https://g.example.com/p/2",
     '<html><head><meta property="product:price:amount" content="19.99"></head><body><p>none</p></body></html>'),
    (3, "https://g.example.com/p/3", "<html><body><p>no price here</p></body></html>"),
    (5, "https://g.example.com/p/5",
     '<html><head><meta itemprop="price" content="7.00"></head><body><span class="amount">$8.00</span></body></html>'),
    (4, "https://w.example.com/p/4",
     '<html><body class="woocommerce"><p class="price"><del><span class="amount">£20</span></del>'
     '<ins><span class="amount">£15</span></ins></p></body></html>'),
]


def _pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_element_table(spark):
    e = HT.html_elements(_pages(spark)).filter("page_id = 1").collect()
    money = [r for r in e if "money" in r["classes"]]
    assert [r["text"] for r in money] == ["$0.00", "$12.50"]
    assert all("price__current" in [a["classes"] for a in r["ancestors"]][-1] for r in money)
    html_el = [r for r in e if r["tag"] == "html"][0]
    assert html_el["text"] == "$5.00$0.00$12.50"   # script text excluded


def test_page_price_cascade(spark):
    got = {r["page_id"]: (r["price"], r["currency"]) for r in HT.page_price(_pages(spark)).collect()}
    assert got[1] == (Decimal("12.5000"), "USD")     # platform selectors first, zero skipped
    assert got[2] == (Decimal("19.9900"), "USD")     # meta content
    assert got[3] == (None, "USD")
    assert got[4] == (Decimal("15.0000"), "GBP")
    assert got[5] == (Decimal("8.0000"), "USD")      # [itemprop='price'] on a meta reads its (empty) text     # '.price ins .amount' before '.price .amount'


def test_scrape_result(spark):
    targets = spark.createDataFrame([(1, "s.example.com/p/1"), (2, "http://g.example.com/p/2"), (3, "https://10.1.2.3/x"),
                                     (4, "https://g.example.com/p/3")], "competitor_id long, url string")
    got = {r["competitor_id"]: r for r in HT.scrape_result(targets, _pages(spark)).collect()}
    assert got[1]["status"] == "success" and got[1]["price"] == Decimal("12.5000")
    assert got[2]["status"] == "failed" and got[2]["error_message"].startswith("HTTP is not secure")
    assert got[3]["error_message"] == "Private or internal URLs are not allowed"
    assert got[4]["error_message"] == HT.FAIL_MESSAGE and got[4]["currency"] == "USD"


def test_cards_and_json_ld(spark):
    cards = ('<div class="product-card"><h3 class="product-card__title">A</h3><a href="/a">x</a>'
             '<img data-src="/a.png"><span class="price">€1,00</span></div>'
             '<div class="product-card"><h2>B</h2>'
             '<span itemprop="price" content="2.5">x</span><meta itemprop="priceCurrency" content="CHF"></div>'
             # an empty title: the heading fallback finds that same empty h3 first -> no product
             '<div class="product-card"><h3 class="product-card__title"></h3><h2>X</h2></div>')
    ld = json.dumps({"@type": "ItemList", "itemListElement": [
        {"item": {"@type": "Product", "name": "C", "url": "/c", "image": {"url": "https://i/c.png"},
                  "offers": [{"price": 3, "priceCurrency": "GBP"}]}},
        {"name": "", "offers": {"price": "1"}}]})
    one_card = ('<script type="application/ld+json">' + ld + '</script><script type="application/ld+json">{bad</script>'
                '<div class="product-card"><h3 class="product-card__title">Solo</h3></div>')
    pages = _pages(spark, [(10, "https://shop.example.com/c/", "<html><body>" + cards + "</body></html>"),
                           (11, "https://shop.example.com/d", "<html><head>" + one_card + "</head></html>")])
    got = sorted((r["page_id"], r["name"], r["price"], r["currency"], r["product_url"], r["image_url"], r["source"])
                 for r in HT.generic_catalog(pages).collect())
    assert got == [
        (10, "A", Decimal("100.0000"), "EUR", "https://shop.example.com/a", "https://shop.example.com/a.png", "cards"),
        (10, "B", Decimal("2.5000"), "CHF", "", None, "cards"),
        (11, "C", Decimal("3.0000"), "GBP", "https://shop.example.com/c", "https://i/c.png", "json_ld"),
    ]


def _shopify_page(spark, products):
    return spark.createDataFrame([("https://st.example.com", 0, json.dumps({"products": products}))],
                                 "store string, page long, payload string")


def test_shopify_shapes(spark):
    prods = [
        {"id": 1, "title": "T1", "handle": "t1", "tags": ["a", " b ", ""], "variants": [{"id": 11, "price": "9.50", "available": True}]},
        {"id": 2, "title": "T2", "handle": "t2", "tags": "x, y,,", "variants": []},
        {"id": 3, "title": "T3", "handle": "t3", "tags": "z", "images": [{"src": "https://i/3"}]},
    ]
    got = {r["name"]: r for r in CT.shopify_products_json(_shopify_page(spark, prods)).collect()}
    assert set(got) == {"T1", "T3"}                      # empty variants list drops the product
    assert got["T1"]["tags"] == ["a", " b ", ""] and got["T1"]["price"] == Decimal("9.5000") and got["T1"]["in_stock"]
    assert got["T3"]["price"] is None and got["T3"]["in_stock"] is False and got["T3"]["image_url"] == "https://i/3"
    assert got["T1"]["product_url"] == "https://st.example.com/products/t1"
    assert got["T3"]["tags"] == ["z"]


def test_woo_minor_units_and_storefront_errors(spark):
    woo = [{"id": 1, "name": "W", "slug": "w", "permalink": "", "prices": {"price": "1999", "currency_minor_unit": 2},
            "categories": [{"name": "c1"}, {"name": ""}]}]
    df = spark.createDataFrame([("https://w.example.com", 0, json.dumps(woo))], "store string, page long, payload string")
    r = CT.woo_store_api(df).first()
    assert r["price"] == Decimal("19.9900") and r["currency"] == "USD" and r["in_stock"] is True
    assert r["tags"] == ["c1"] and r["product_url"] == "https://w.example.com/product/w"
    err = spark.createDataFrame([("https://s", 0, '{"errors": "x", "data": {"products": {"edges": [{"node": {"title": "n"}}]}}}')],
                                "store string, page long, payload string")
    assert CT.shopify_storefront(err).count() == 0


def test_keyword_and_fallback(spark):
    rows = spark.createDataFrame(
        [("s1", 1, 0, "Red Ring", None, None, None), ("s1", 2, 0, "Blue Bolt", None, None, None),
         ("s2", 2, 0, "Green Gear", "gears", ["metal"], "shiny")],
        "store string, source_rank int, ordinal long, name string, product_type string, tags array<string>, description string")
    assert sorted(r["name"] for r in CT.first_match_source(rows).collect()) == ["Green Gear", "Red Ring"]
    assert [r["name"] for r in CT.keyword_filter(rows, "METAL ring").collect()] == ["Red Ring", "Green Gear"]
    assert CT.keyword_filter(rows, "  ").count() == 3
