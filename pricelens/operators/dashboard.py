"""Dashboard and list reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .history import ts_lit
from .series import collect_chunks, rank_within_buckets


def pending_list(details: DataFrame, limit: int | None = None) -> DataFrame:
    """unsent alerts per user newest first with position and total.
    With ``limit`` (the UI shows 5) only the first rows per user are ranked,
    which Spark turns into a map-side WindowGroupLimit; whole lists are ranked
    by time buckets, so a hot user's list is spread over many tasks.  The
    total is always an aggregate."""
    rows = details.filter(~F.col("included_in_digest"))
    totals = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    order = [F.col("detected_at").desc(), F.col("id").desc()]
    if limit is None:
        ranked = rank_within_buckets(rows, "user_id", "detected_at", order, "list_pos")
    else:
        ranked = (rows.withColumn("list_pos", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
                  .filter(F.col("list_pos") <= limit))
    return ranked.join(totals, "user_id")


def dashboard_stats(users: DataFrame, products: DataFrame, competitors: DataFrame, pending: DataFrame,
                    insights: DataFrame, as_of, days: int = C.RECENT_ALERT_DAYS) -> DataFrame:
    """Per user #products (inactive too), #competitors, #alerts in the last
    ``days`` (sent or not) and #insights; four grouped counts joined on users."""
    prod = products.select(F.col("id").alias("product_id"), "user_id")
    n_prod = prod.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_products"))
    n_comp = (competitors.select("product_id").join(prod, "product_id")
              .groupBy("user_id").agg(F.count(F.lit(1)).alias("total_competitors")))
    recent = pending.filter(F.col("detected_at") >= ts_lit(as_of) - F.make_dt_interval(F.lit(days)))
    n_alert = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts_this_week"))
    n_ins = (insights.select("product_id").join(prod, "product_id")
             .groupBy("user_id").agg(F.count(F.lit(1)).alias("total_insights")))
    out = users.select("user_id")
    for t in (n_prod, n_comp, n_alert, n_ins):
        out = out.join(t, "user_id", "left")
    return out.fillna(0, ["total_products", "total_competitors", "alerts_this_week", "total_insights"])


def competitor_count(products: DataFrame, competitors: DataFrame) -> DataFrame:
    """Competitors per product, 0 kept."""
    c = competitors.groupBy("product_id").agg(F.count(F.lit(1)).alias("competitor_count"))
    return (products.select(F.col("id").alias("product_id"), "user_id", "product_name", "created_at")
            .join(c, "product_id", "left").fillna(0, ["competitor_count"]))


def top_per_group(df: DataFrame, group: str, order_cols: list, n: int, pos: str = "pos") -> DataFrame:
    """Newest ``n`` rows per group.  The constant bound lets Spark apply
    a map-side WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order_cols)
    return df.withColumn(pos, F.row_number().over(w)).filter(F.col(pos) <= n)


def product_competitors(products: DataFrame, competitors: DataFrame) -> DataFrame:
    """One row per product with its competitors as an ordered array
    (empty array kept).  A product's competitor list is bounded by the
    tracking request limit, so the collected array per group is bounded."""
    c = competitors.select("product_id", F.struct("created_at", "id", "url", "retailer_name",
                                                  "alert_threshold_percent").alias("c"))
    g = c.groupBy("product_id").agg(F.array_sort(F.collect_list("c")).alias("competitors"))
    return (products.join(g.withColumnRenamed("product_id", "id"), "id", "left")
            .withColumn("competitors", F.coalesce("competitors", F.array().cast(g.schema["competitors"].dataType))))


def product_list(products: DataFrame, competitors: DataFrame, user_id=None, limit: int | None = None) -> DataFrame:
    """F7 (+B1, B2, C1, D14): active products newest first with competitors[]
    and the total per user; ``limit`` ranks only the first rows per user
    (map-side WindowGroupLimit) before competitors are attached, whole lists
    are ranked by time buckets."""
    p = products.filter(F.col("is_active"))
    if user_id is not None:
        p = p.filter(F.col("user_id") == F.lit(user_id))
    totals = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    order = [F.col("created_at").desc(), F.col("id").desc()]
    if limit is None:
        ranked = rank_within_buckets(p, "user_id", "created_at", order, "list_pos")
    else:
        ranked = (p.withColumn("list_pos", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
                  .filter(F.col("list_pos") <= limit))
    return product_competitors(ranked, competitors).join(totals, "user_id")


def owned_competitors(competitors: DataFrame, products: DataFrame) -> DataFrame:
    """Competitors with their owner (inner join on product)."""
    return competitors.join(products.select(F.col("id").alias("product_id"), "user_id", "product_name"), "product_id")


def no_insight_today(products: DataFrame, insights: DataFrame, as_of, force_regenerate: bool = False) -> DataFrame:
    """Products without an insight since UTC midnight (all with
    ``force_regenerate``)."""
    if force_regenerate:
        return products
    today = insights.filter(F.col("generated_at") >= F.date_trunc("day", ts_lit(as_of))).select(
        F.col("product_id").alias("id"))
    return products.join(today, "id", "left_anti")


def scrape_worklist(competitors: DataFrame, products: DataFrame) -> DataFrame:
    """Competitors of active products (all users)."""
    active = products.filter(F.col("is_active")).select(F.col("id").alias("product_id"))
    return competitors.join(active, "product_id", "left_semi")


def scrape_success_rate(price_history: DataFrame, competitors: DataFrame | None = None) -> DataFrame:
    """Success share per UTC day (and per domain when competitors are given)."""
    from ..functions.url import domain_of
    d = price_history.withColumn("day", F.to_date("scraped_at"))
    keys = ["day"]
    if competitors is not None:
        d = d.join(competitors.select(F.col("id").alias("competitor_id"), domain_of(F.col("url"), "lower").alias("domain")),
                   "competitor_id")
        keys = ["day", "domain"]
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"),
                                F.count_if(F.col("scrape_status") == "success").alias("successes"),
                                F.avg((F.col("scrape_status") == "success").cast("int")).alias("success_rate"))


def _runs(price_history: DataFrame, competitors: DataFrame) -> DataFrame:
    """Every scrape with its run: the product and the UTC day."""
    from ..functions.url import retailer_or_domain
    comp = competitors.select(F.col("id").alias("competitor_id"), "product_id",
                              retailer_or_domain(F.col("retailer_name"), F.col("url"), "no_www").alias("retailer"))
    return price_history.join(comp, "competitor_id").withColumn("run_day", F.to_date("scraped_at"))


def run_results(price_history: DataFrame, competitors: DataFrame, size: int = C.CHUNK_ITEMS) -> DataFrame:
    """The results of scrape runs (retailer name or domain without
    'www.', by competitor) in numbered chunks of at most ``size``: (product_id,
    run_day, chunk, results)."""
    price = F.col("price").cast("string").alias("price")
    res = F.struct("competitor_id", "retailer", price, "currency", F.col("scrape_status").alias("status"), "error_message")
    return collect_chunks(_runs(price_history, competitors), ["product_id", "run_day"], F.col("competitor_id"),
                          [F.col(c) for c in ("retailer", "price", "currency", "scrape_status", "error_message")],
                          res, "results", size)


def run_progress(price_history: DataFrame, competitors: DataFrame, size: int = C.CHUNK_ITEMS) -> DataFrame:
    """Progress of scrape runs; a run is one product's scrapes of one UTC
    day.  total = the product's competitors, completed = competitors
    processed in the run (any status), failed_items = failed ones, status =
    'completed' once every competitor was processed else 'scraping', and the
    per-competitor results, a row for each chunk of at most ``size``."""
    total = competitors.groupBy("product_id").agg(F.count(F.lit(1)).alias("total"))
    g = _runs(price_history, competitors).groupBy("product_id", "run_day").agg(
        F.count_distinct("competitor_id").alias("completed"),
        F.count_if(F.col("scrape_status") == "failed").alias("failed_items"))
    return (g.join(total, "product_id").join(run_results(price_history, competitors, size), ["product_id", "run_day"])
            .withColumn("status", F.when(F.col("completed") >= F.col("total"), "completed").otherwise("scraping")))


def recent_activity(pending: DataFrame, products: DataFrame, competitors: DataFrame, n: int = 10) -> DataFrame:
    """the ``n`` newest alerts per user (sent or not) as activity rows:
    product name ('Unknown' without a product row), the store's raw
    retailer name ('Unknown' only without a competitor row), and prices /
    change with 0 shown as missing."""
    top = top_per_group(pending, "user_id", [F.col("detected_at").desc(), F.col("id").desc()], n)
    p = products.select(F.col("id").alias("product_id"), "product_name", F.lit(True).alias("__p"))
    c = competitors.select(F.col("id").alias("competitor_id"), "retailer_name", F.lit(True).alias("__c"))
    j = top.join(p, "product_id", "left").join(c, "competitor_id", "left")
    nz = lambda col: F.when(F.col(col) != 0, F.col(col))
    return j.select(
        "id", "user_id", F.col("alert_type").alias("type"),
        F.when(F.col("__p"), F.col("product_id")).alias("product_id"),
        F.when(F.col("__p"), F.col("product_name")).otherwise(F.lit("Unknown")).alias("product_name"),
        F.when(F.col("__c"), F.col("retailer_name")).otherwise(F.lit("Unknown")).alias("retailer"),
        nz("old_price").alias("old_price"), nz("new_price").alias("new_price"),
        nz("price_change_percent").alias("change_percent"), "detected_at", "pos")
