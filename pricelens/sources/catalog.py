"""Catalog sources (A2-A5) normalised to one product table (G1), plus the
discovery operators on it (B5, B6, F6, F8, F10, C11, D15, D16).

Landed payloads are rows ``(store, page, payload)`` - one JSON document per
fetched page (G2: a folder of pages is one multi-file scan).  Every
normaliser is ``DataFrame -> DataFrame`` with the unified schema; a registry
maps source kinds to normalisers and their fallback rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..config import materialize
from ..functions.price import minor_units
from ..functions.text import keyword_match, py_strip
from ..functions.url import url_join

S = T.StringType()
_IMG = T.ArrayType(T.StructType([T.StructField("src", S)]))
_NAMES = T.ArrayType(T.StructType([T.StructField("name", S)]))

SHOPIFY_JSON = T.StructType([T.StructField("products", T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", S), T.StructField("handle", S),
    T.StructField("body_html", S), T.StructField("product_type", S), T.StructField("tags", S),
    T.StructField("images", _IMG),
    T.StructField("variants", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("price", S), T.StructField("sku", S),
        T.StructField("available", T.BooleanType())])))])))])

_EDGES = lambda node: T.StructType([T.StructField("edges", T.ArrayType(T.StructType([T.StructField("node", node)])))])
STOREFRONT = T.StructType([
    T.StructField("errors", S),
    T.StructField("data", T.StructType([T.StructField("products", _EDGES(T.StructType([
        T.StructField("title", S), T.StructField("handle", S), T.StructField("description", S),
        T.StructField("productType", S), T.StructField("tags", T.ArrayType(S)),
        T.StructField("priceRange", T.StructType([T.StructField("minVariantPrice", T.StructType([
            T.StructField("amount", S), T.StructField("currencyCode", S)]))])),
        T.StructField("images", _EDGES(T.StructType([T.StructField("url", S)]))),
        T.StructField("variants", _EDGES(T.StructType([
            T.StructField("id", S), T.StructField("availableForSale", T.BooleanType()), T.StructField("sku", S)])))])))]))])

WOO_STORE = T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", S), T.StructField("slug", S),
    T.StructField("permalink", S), T.StructField("sku", S), T.StructField("description", S),
    T.StructField("short_description", S), T.StructField("is_in_stock", T.BooleanType()),
    T.StructField("prices", T.StructType([T.StructField("price", S), T.StructField("currency_code", S),
                                          T.StructField("currency_minor_unit", T.IntegerType())])),
    T.StructField("images", _IMG), T.StructField("categories", _NAMES)]))

WOO_REST = T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", S), T.StructField("slug", S),
    T.StructField("permalink", S), T.StructField("sku", S), T.StructField("description", S),
    T.StructField("short_description", S), T.StructField("price", S), T.StructField("in_stock", T.BooleanType()),
    T.StructField("images", _IMG), T.StructField("categories", _NAMES), T.StructField("tags", _NAMES)]))


def _nonempty(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull() & (x != ""))


def _names(arr: Column) -> Column:
    """array<struct<name>> -> non-empty names."""
    return _nonempty(F.transform(F.coalesce(arr, F.array()), lambda x: x["name"]))


def tags_of(raw: Column) -> Column:
    """Tags given as a JSON array (kept as is) or as a comma string
    (split, trimmed, empty parts dropped)."""
    arr = F.from_json(raw, T.ArrayType(S))
    split = _nonempty(F.transform(F.split(raw, ","), lambda x: py_strip(x)))
    return F.when(F.trim(raw).startswith("["), arr).otherwise(split)


def _price(s: Column) -> Column:
    return F.when(s.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), F.trim(s).try_cast("decimal(18,4)"))


def _unified(store, rank, page, ordinal, name, price, currency, image, url, platform, variant, sku, in_stock,
             ptype, tags, desc) -> list[Column]:
    return [store.alias("store"), F.lit(rank).cast("int").alias("source_rank"),
            page.cast("bigint").alias("page"), ordinal.cast("bigint").alias("ordinal"),
            name.alias("name"), price.cast("decimal(18,4)").alias("price"), currency.alias("currency"),
            image.alias("image_url"), url.alias("product_url"), F.lit(platform).alias("platform"),
            variant.cast("string").alias("variant_id"), sku.alias("sku"), in_stock.alias("in_stock"),
            ptype.alias("product_type"), tags.alias("tags"), desc.alias("description")]


def shopify_products_json(pages: DataFrame) -> DataFrame:
    """A2: products.json pages.  First image, first variant's price / id /
    sku / available; url = store + /products/ + handle; USD; no variants key
    -> price null and out of stock; an *empty* variants list drops the row."""
    p = pages.select("store", "page", F.from_json("payload", SHOPIFY_JSON).alias("j"))
    e = p.select("store", "page", F.posexplode("j.products").alias("pos", "x"))
    e = e.filter(F.col("x.variants").isNull() | (F.size("x.variants") > 0))
    v = F.try_element_at(F.col("x.variants"), F.lit(1))
    has_v = F.col("x.variants").isNotNull()
    return e.select(*_unified(
        F.col("store"), 1, F.col("page"), F.col("pos"), F.col("x.title"), _price(v["price"]), F.lit("USD"),
        F.try_element_at(F.col("x.images"), F.lit(1))["src"],
        url_join(F.col("store"), F.concat(F.lit("/products/"), F.coalesce(F.col("x.handle"), F.lit("")))), "shopify",
        F.when(has_v, v["id"]), v["sku"], F.when(has_v, F.coalesce(v["available"], F.lit(False))).otherwise(F.lit(False)),
        F.col("x.product_type"), tags_of(F.col("x.tags")), F.col("x.body_html")))


def shopify_storefront(pages: DataFrame) -> DataFrame:
    """A3: storefront GraphQL pages; a payload with ``errors`` yields nothing."""
    p = pages.select("store", "page", F.from_json("payload", STOREFRONT).alias("j")).filter(F.col("j.errors").isNull())
    e = p.select("store", "page", F.posexplode("j.data.products.edges").alias("pos", "x"))
    n = F.col("x.node")
    v = F.try_element_at(n["variants"]["edges"], F.lit(1))["node"]
    mvp = n["priceRange"]["minVariantPrice"]
    return e.select(*_unified(
        F.col("store"), 2, F.col("page"), F.col("pos"), n["title"], _price(mvp["amount"]),
        F.coalesce(mvp["currencyCode"], F.lit("USD")), F.try_element_at(n["images"]["edges"], F.lit(1))["node"]["url"],
        url_join(F.col("store"), F.concat(F.lit("/products/"), n["handle"])), "shopify", v["id"], v["sku"],
        F.coalesce(v["availableForSale"], F.lit(False)), n["productType"], F.coalesce(n["tags"], F.array().cast("array<string>")),
        n["description"]))


def woo_store_api(pages: DataFrame) -> DataFrame:
    """A4: Woo Store API; price in minor units / 10^currency_minor_unit."""
    # an answer that is no list (an error object) has no products
    p = pages.filter(_is_list(F.col("payload"))).select("store", "page", F.from_json("payload", WOO_STORE).alias("j"))
    e = p.select("store", "page", F.posexplode("j").alias("pos", "x"))
    x = F.col("x")
    url = F.coalesce(F.when(x["permalink"] != "", x["permalink"]),
                     F.concat(F.col("store"), F.lit("/product/"), x["slug"]))
    desc = F.coalesce(F.when(x["description"] != "", x["description"]), x["short_description"])
    return e.select(*_unified(
        F.col("store"), 3, F.col("page"), F.col("pos"), x["name"],
        minor_units(x["prices"]["price"], x["prices"]["currency_minor_unit"]),
        F.coalesce(x["prices"]["currency_code"], F.lit("USD")), F.try_element_at(x["images"], F.lit(1))["src"], url, "woocommerce",
        x["id"], x["sku"], F.coalesce(x["is_in_stock"], F.lit(True)), F.lit(None).cast("string"),
        _names(x["categories"]), desc))


def woo_rest_api(pages: DataFrame) -> DataFrame:
    """A5: Woo REST v3/v2; price string as is, USD, tags = categories ++ tags."""
    # an answer that is no list (an error object) has no products
    p = pages.filter(_is_list(F.col("payload"))).select("store", "page", F.from_json("payload", WOO_REST).alias("j"))
    e = p.select("store", "page", F.posexplode("j").alias("pos", "x"))
    x = F.col("x")
    url = F.coalesce(F.when(x["permalink"] != "", x["permalink"]),
                     F.concat(F.col("store"), F.lit("/product/"), x["slug"]))
    desc = F.coalesce(F.when(x["description"] != "", x["description"]), x["short_description"])
    return e.select(*_unified(
        F.col("store"), 4, F.col("page"), F.col("pos"), x["name"], _price(x["price"]), F.lit("USD"),
        F.try_element_at(x["images"], F.lit(1))["src"], url, "woocommerce", x["id"], x["sku"],
        F.coalesce(x["in_stock"], F.lit(True)), F.lit(None).cast("string"),
        F.concat(_names(x["categories"]), _names(x["tags"])), desc))


def _origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)


def generic_html(pages: DataFrame) -> DataFrame:
    """Generic handler (last in the fallback order): landed HTML pages
    (page_id, url, html) -> product cards, or JSON-LD products when no card
    selector succeeds (J6 / J7).  The store is the page's origin; products of
    this handler are in stock unless stated (the model default)."""
    from ..operators.html import generic_catalog
    g = generic_catalog(pages).join(pages.select("page_id", "url"), "page_id")
    return g.select(*_unified(
        _origin(F.col("url")), 5, F.col("page_id"), F.col("ordinal"), F.col("name"), F.col("price"),
        F.col("currency"), F.col("image_url"), F.col("product_url"), "custom", F.lit(None).cast("string"), F.col("sku"),
        F.lit(True), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(None).cast("string")))


NORMALISERS = {
    "shopify_json": shopify_products_json,
    "shopify_storefront": shopify_storefront,
    "woo_store": woo_store_api,
    "woo_rest": woo_rest_api,
    "generic_html": generic_html,
}


def normalise(landed: dict[str, DataFrame]) -> DataFrame:
    """G1: every landed source through its normaliser, unioned by name."""
    out = None
    for kind, df in landed.items():
        n = NORMALISERS[kind](df)
        out = n if out is None else out.unionByName(n, allowMissingColumns=True)
    return out


# --- which source counts, decided before products are parsed --------------------------------

_COUNTS = {"shopify_json": "products array<struct<variants:array<struct<id:string>>>>",
           "shopify_storefront": "errors string, data struct<products:struct<edges:array<struct<node:struct<title:string>>>>>",
           "woo_store": "array<struct<name:string>>", "woo_rest": "array<struct<name:string>>"}


def _is_list(payload: Column) -> Column:
    return F.ltrim(payload).startswith("[")


def page_headers(landed: dict[str, DataFrame]) -> DataFrame:
    """The response log: (store, source_rank, page, answered, n) of every landed
    page: whether the endpoint answered in its form, and how many products the
    page gives.  Only the products array is looked at, no product is parsed.
    HTML pages (last in the order) are not counted: n is null."""
    out = None
    for rank, kind in enumerate(NORMALISERS, 1):
        if kind not in landed:
            continue
        if kind == "generic_html":
            h = landed[kind].select(_origin(F.col("url")).alias("store"), F.col("page_id").cast("bigint").alias("page"),
                                    F.lit(True).alias("answered"), F.lit(None).cast("int").alias("n"))
        else:
            j = landed[kind].select("store", F.col("page").cast("bigint").alias("page"), "payload",
                                    F.from_json("payload", _COUNTS[kind]).alias("j"))
            if kind == "shopify_json":
                answered = F.col("j.products").isNotNull()
                n = F.size(F.filter("j.products", lambda x: x["variants"].isNull() | (F.size(x["variants"]) > 0)))
            elif kind == "shopify_storefront":
                answered = F.col("j.errors").isNull() & F.col("j.data.products.edges").isNotNull()
                n = F.size("j.data.products.edges")
            else:
                answered = _is_list(F.col("payload")) & F.col("j").isNotNull()
                n = F.size("j")
            h = j.select("store", "page", F.coalesce(answered, F.lit(False)).alias("answered"), n.alias("n"))
            h = h.withColumn("n", F.when(F.col("answered"), F.col("n")).otherwise(0))
        h = h.select("store", F.lit(rank).alias("source_rank"), "page", "answered", F.col("n").cast("bigint").alias("n"))
        out = h if out is None else out.unionByName(h)
    return out


def choose_sources(headers: DataFrame) -> DataFrame:
    """F8: (store, source_rank) by the fetchers' order.  A Shopify endpoint
    counts if it gave a product.  A WooCommerce store is one where some endpoint
    gave a product; of its endpoints the first that answered with a list counts,
    even an empty one.  Any other store is read from its HTML pages."""
    of = lambda r, c: F.when(F.col("source_rank") == r, F.col(c))
    per = headers.groupBy("store").agg(
        *[F.coalesce(F.sum(of(r, "n")), F.lit(0)).alias(f"n{r}") for r in (1, 2, 3, 4)],
        F.coalesce(F.max(of(3, "answered")), F.lit(False)).alias("store_api"),
        F.max(F.col("source_rank") == 5).alias("html"))
    woo = (F.col("n3") > 0) | (F.col("n4") > 0)
    rank = (F.when(F.col("n1") > 0, 1).when(F.col("n2") > 0, 2).when(woo & F.col("store_api"), 3).when(woo, 4)
            .when(F.col("html"), 5))
    return per.select("store", rank.alias("source_rank")).filter(F.col("source_rank").isNotNull())


def discover(landed: dict[str, DataFrame], max_fetch: int | None = None, log: DataFrame | None = None) -> DataFrame:
    """F8 (and F6's fetch budget) before G1: the response log decides each
    store's source and, with ``max_fetch``, the pages that a fetcher reads until
    it has seen that many rows (whole pages; a running sum over the log, one
    row a page).  Only these pages are parsed, once.  ``log``: a response log
    that is stored already; else it is taken from the pages and written, as
    several branches read it."""
    headers = materialize(page_headers(landed), "response_log") if log is None else log
    read = headers.join(choose_sources(headers), ["store", "source_rank"])
    if max_fetch is not None:
        before = F.sum("n").over(Window.partitionBy("store").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
        read = read.withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < max_fetch)
    out = None
    for rank, kind in enumerate(NORMALISERS, 1):
        if kind not in landed:
            continue
        own, pages = read.filter(F.col("source_rank") == rank).select("store", "page"), landed[kind]
        if kind == "generic_html":
            pages = pages.withColumn("__store", _origin(F.col("url")))
            pages = pages.join(own.select(F.col("store").alias("__store")).distinct(), "__store", "left_semi").drop("__store")
        else:
            pages = pages.join(own, ["store", "page"], "left_semi")
        n = NORMALISERS[kind](pages)
        out = n if out is None else out.unionByName(n, allowMissingColumns=True)
    return out


def first_match_source(catalog: DataFrame) -> DataFrame:
    """F8 over rows without a response log (``discover`` reads one): per store
    the rows of the best-ranked source that produced any row.  The per-store
    minimum is an aggregate joined back, not a window over the store's rows."""
    best = catalog.groupBy("store").agg(F.min("source_rank").alias("__best"))
    return (catalog.join(best, "store").filter(F.col("source_rank") == F.col("__best")).drop("__best"))


def keyword_filter(catalog: DataFrame, keyword: str | None) -> DataFrame:
    """Keep rows where any keyword word occurs in name / type / tags /
    description (case-insensitive)."""
    cols = [F.col("name"), F.col("product_type"), F.array_join(F.coalesce("tags", F.array()), " "), F.col("description")]
    return catalog.filter(keyword_match(cols, keyword))


def stock_filter(catalog: DataFrame, mode: str = "all") -> DataFrame:
    """All / in_stock / out_of_stock."""
    if mode == "in_stock":
        return catalog.filter(F.col("in_stock"))
    if mode == "out_of_stock":
        return catalog.filter(~F.col("in_stock"))
    return catalog


def fetch_filter_limit(catalog: DataFrame, keyword: str | None, limit: int,
                       max_fetch: int | None = None) -> DataFrame:
    """the keyword filter, then per store the first ``limit`` rows in
    source order (page, position): a constant bound, so a map-side
    WindowGroupLimit.  With ``max_fetch`` only as many whole pages of a store
    count as a fetcher reads until it has seen that many rows; the pages are
    chosen by a running sum over the pages' row counts, never over the rows."""
    if max_fetch is not None:
        pages = catalog.groupBy("store", "page").agg(F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(Window.partitionBy("store").orderBy("page")
                                   .rowsBetween(Window.unboundedPreceding, -1))
        read = (pages.withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < max_fetch)
                .select("store", "page"))
        catalog = catalog.join(read, ["store", "page"], "left_semi")
    w = Window.partitionBy("store").orderBy("page", "ordinal")
    return (keyword_filter(catalog, keyword).withColumn("rank_in_store", F.row_number().over(w))
            .filter(F.col("rank_in_store") <= limit))


def single_product(catalog: DataFrame) -> DataFrame:
    """the first product found per store."""
    return fetch_filter_limit(catalog, None, 1)


def distinct_urls(selected: DataFrame) -> DataFrame:
    """The set of selected URLs."""
    return selected.select("product_url").dropDuplicates(["product_url"])


def select_join(selected: DataFrame, catalog: DataFrame) -> DataFrame:
    """C11: chosen URLs looked up in the discovered rows (first match by
    store / source order; missing -> price null, USD)."""
    first = (catalog.groupBy("product_url")
             .agg(F.min_by(F.struct("name", "price", "currency"), F.struct("store", "source_rank", "page", "ordinal")).alias("r")))
    return (distinct_urls(selected).join(first, "product_url", "left")
            .select("product_url", F.col("r.name").alias("name"), F.col("r.price").alias("price"),
                    F.coalesce(F.col("r.currency"), F.lit("USD")).alias("currency")))


def discovery_result(catalog: DataFrame, keyword: str | None = None, limit: int = 50,
                     errors: DataFrame | None = None, max_fetch: int | None = None, decided: bool = False) -> DataFrame:
    """Per store platform, total_found and the product array, after the
    keyword filter and request limit (F6) - so each store's array holds at most
    ``limit`` products - and a truncated error.  ``decided``: the catalog holds
    the rows of each store's source only (``discover``)."""
    if not 1 <= limit <= C.MAX_TRACK_ITEMS:
        raise ValueError("limit must be within 1..5000")
    catalog = fetch_filter_limit(catalog if decided else first_match_source(catalog), keyword, limit, max_fetch)
    g = catalog.groupBy("store").agg(
        F.min("platform").alias("platform"), F.count(F.lit(1)).alias("total_found"),
        F.array_sort(F.collect_list(F.struct("page", "ordinal", "name", "price", "currency", "product_url"))).alias("products"))
    if errors is not None:
        g = g.join(errors.select("store", F.left(F.col("error"), F.lit(C.ERROR_TEXT_MAX)).alias("error")), "store", "full")
    return g


def write_landed_pages(pages: DataFrame, path: str) -> None:
    """Land fetched pages as files: one folder per store, one file per page
    (the fetcher's output layout)."""
    (pages.select(F.regexp_extract("store", r"^https?://([^/]+)", 1).alias("host"), "page", "payload")
     .repartition("host", "page")
     .write.mode("overwrite").partitionBy("host", "page").text(path))


def read_landed_pages(spark, path: str) -> DataFrame:
    """Every landed page of every store in one multi-file scan; store and
    page number come from the file path (partition columns), the document is
    the whole file."""
    df = spark.read.option("wholetext", True).text(path)
    return df.select(F.concat(F.lit("https://"), F.col("host")).alias("store"), F.col("page").cast("bigint").alias("page"),
                     F.col("value").alias("payload"))
