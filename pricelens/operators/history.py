"""Price-history reads: filters (B*), previous / latest price (E1, E2), series
statistics (D2-D5, D9, D11), first/last and indexed series (E6, E7), last-N
points (E3) and history pages (F5).

Inputs follow ``pricelens.schemas``.  All functions are lazy DataFrame
transformations; ``as_of`` is always explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .series import collect_chunks, lag_within_buckets, time_bucket


def ts_lit(value) -> Column:
    """A UTC wall-clock timestamp literal (timestamp_ntz)."""
    return F.lit(str(value)).cast("timestamp_ntz")


# --- B: predicates ---------------------------------------------------------------

def success_price(df: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """Successful scrapes with a price; chart/insight paths also drop 0."""
    cond = (F.col("scrape_status") == "success") & F.col("price").isNotNull()
    if zero_is_missing:
        cond = cond & (F.col("price") != 0)
    return df.filter(cond)


def last_n_days(df: DataFrame, as_of, days: int = C.DEFAULT_HISTORY_DAYS, ts: str = "scraped_at") -> DataFrame:
    """Rows with ``ts >= as_of - days``."""
    if not 1 <= days <= 365:
        raise ValueError("days must be within 1..365")
    return df.filter(F.col(ts) >= ts_lit(as_of) - F.make_dt_interval(F.lit(days)))


def since_midnight(df: DataFrame, as_of, ts: str = "scraped_at") -> DataFrame:
    """Rows since UTC midnight of ``as_of``."""
    return df.filter(F.col(ts) >= F.date_trunc("day", ts_lit(as_of)))


def owned_history(price_history: DataFrame, competitors: DataFrame, products: DataFrame, user_id) -> DataFrame:
    """The rows a user may read (semi joins through competitor -> product)."""
    mine = products.filter(F.col("user_id") == F.lit(user_id)).select(F.col("id").alias("product_id"))
    comps = competitors.join(mine, "product_id", "left_semi").select(F.col("id").alias("competitor_id"))
    return price_history.join(comps, "competitor_id", "left_semi")


# --- E1: previous successful price ----------------------------------------------

def with_previous_price(price_history: DataFrame, bucket_unit: str = "day") -> DataFrame:
    """For every successful non-null observation, the previous successful
    non-null (price, currency) of the same competitor, ordered by
    (scraped_at, id).  Adds ``old_price``, ``old_currency``."""
    ok = success_price(price_history)
    out = lag_within_buckets(ok, "competitor_id", ["scraped_at", "id"], ["price", "currency"],
                             prefix="__p_", bucket_unit=bucket_unit)
    return out.withColumnRenamed("__p_price", "old_price").withColumnRenamed("__p_currency", "old_currency")


# --- E2: latest observation of any status ---------------------------------------

def latest_observation(price_history: DataFrame) -> DataFrame:
    """Most recent row per competitor regardless of status (partial
    aggregation with ``max_by``; skewed competitors are combined map-side)."""
    cols = [c for c in price_history.columns if c != "competitor_id"]
    return (price_history.groupBy("competitor_id")
            .agg(F.max_by(F.struct(*cols), F.struct("scraped_at", "id")).alias("r"))
            .select("competitor_id", "r.*"))


def latest_price_display(competitors: DataFrame, price_history: DataFrame) -> DataFrame:
    """E2 (display): latest row per competitor shown as '$' + price (success
    with a non-zero price), 'Failed' (any other row) or 'Pending...' (none)."""
    latest = latest_observation(price_history).select(
        F.col("competitor_id").alias("id"), F.col("price").alias("latest_price"),
        F.col("currency").alias("latest_currency"), F.col("scrape_status").alias("latest_status"),
        F.col("scraped_at").alias("latest_scraped_at"))
    out = competitors.select("id", "product_id", "url").join(latest, "id", "left")
    return out.withColumn(
        "display",
        F.when(F.col("latest_status").isNull(), F.lit("Pending..."))
         .when((F.col("latest_status") == "success") & F.coalesce(F.col("latest_price") != 0, F.lit(False)),
               F.concat(F.lit("$"), F.col("latest_price").cast("decimal(12,2)").cast("string")))
         .otherwise(F.lit("Failed")))


# --- D2 / D3 / D4 / D9 / D11: chart statistics ------------------------------------

def competitor_stats(competitors: DataFrame, price_history: DataFrame, as_of,
                     days: int = C.DEFAULT_HISTORY_DAYS) -> DataFrame:
    """D2 (+D9, D3 counts): per competitor over the window: average / min / max /
    current (= last success) / first / change %, variance, points.  Price 0 is
    treated as missing (chart path).  Competitors without rows are kept."""
    win = last_n_days(price_history, as_of, days)
    ok = F.col("scrape_status").eqNullSafe("success") & F.col("price").isNotNull() & (F.col("price") != 0)
    okp = F.when(ok, F.col("price"))
    order = F.struct("scraped_at", "id")
    agg = win.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("data_points"),
        F.count(okp).alias("success_points"),
        F.sum(okp).alias("sum_price"),
        F.min(okp).alias("min_price"),
        F.max(okp).alias("max_price"),
        F.max_by(okp, F.when(ok, order)).alias("current_price"),
        F.min_by(okp, F.when(ok, order)).alias("first_price"),
        F.var_pop(okp.cast("double")).alias("price_variance"),
        F.min("scraped_at").alias("first_seen"),
        F.max("scraped_at").alias("last_seen"),
    )
    out = (competitors.select(F.col("id").alias("competitor_id"), "product_id", "url", "retailer_name", "created_at")
           .join(agg, "competitor_id", "left"))
    return (out
            .withColumn("data_points", F.coalesce("data_points", F.lit(0)))
            .withColumn("average_price", F.col("sum_price").cast("double") / F.col("success_points"))
            .withColumn("price_change_percent",
                        F.when(F.col("first_price") > 0,
                               ((F.col("current_price") - F.col("first_price")) * 100).cast("double")
                               / F.col("first_price").cast("double")))
            .drop("sum_price"))


def product_range(price_history: DataFrame, competitors: DataFrame, as_of,
                  days: int = C.DEFAULT_HISTORY_DAYS) -> DataFrame:
    """D3: per product the earliest / latest timestamp and the number of rows
    (failed ones too) in the window."""
    win = last_n_days(price_history, as_of, days)
    comp = competitors.select(F.col("id").alias("competitor_id"), "product_id")
    return (win.join(comp, "competitor_id")
            .groupBy("product_id")
            .agg(F.min("scraped_at").alias("date_range_start"),
                 F.max("scraped_at").alias("date_range_end"),
                 F.count(F.lit(1)).alias("total_data_points")))


def product_summary(stats: DataFrame) -> DataFrame:
    """Per product the lowest window minimum and its competitor, the
    highest window maximum (must exceed 0) and its competitor - strict
    comparisons, so the first competitor in list order (created_at, id) wins
    ties - the number of competitors, the number of points and the average
    change = sum of non-null changes / all competitors (1 when there are none)."""
    name = F.coalesce(F.col("competitor_name"), F.col("competitor_id").cast("string"))
    low_key = F.when(F.col("min_price").isNotNull(), F.struct(F.col("min_price"), F.col("created_at"), F.col("competitor_id")))
    # highest: larger maximum wins, earlier competitor wins ties
    high_key = F.when(F.col("max_price") > 0, F.struct(-F.col("max_price"), F.col("created_at"), F.col("competitor_id")))
    return stats.groupBy("product_id").agg(
        F.min("min_price").alias("lowest_price"),
        F.min_by(name, low_key).alias("lowest_competitor"),
        F.max(F.when(F.col("max_price") > 0, F.col("max_price"))).alias("highest_price"),
        F.min_by(name, high_key).alias("highest_competitor"),
        F.count(F.lit(1)).alias("competitor_count"),
        F.sum("data_points").alias("total_points"),
        (F.coalesce(F.sum("price_change_percent"), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1)))
        .alias("avg_change_percent"),
    )


def series_points(price_history: DataFrame, as_of, days: int = C.DEFAULT_HISTORY_DAYS,
                  size: int = C.CHUNK_ITEMS) -> DataFrame:
    """Chart points {timestamp, id, price, currency, status} per competitor
    and UTC day, failures kept as gaps (price null), in numbered chunks of at
    most ``size`` points however often a competitor is scraped in a day; a
    chart concatenates them in (``day``, ``chunk``) order (``chart_points`` does
    that for a bounded set of competitors)."""
    win = last_n_days(price_history, as_of, days).withColumn("day", F.to_date("scraped_at"))
    pt = F.struct(F.col("scraped_at").alias("timestamp"), F.col("id"),
                  F.when(F.col("price") != 0, F.col("price")).alias("price"),
                  F.col("currency"), F.col("scrape_status").alias("status"))
    return collect_chunks(win, ["competitor_id", "day"], time_bucket(F.col("scraped_at"), "hour"),
                          [F.col("scraped_at"), F.col("id")], pt, "data_points", size)


def chart_points(series: DataFrame, competitor_ids: DataFrame) -> DataFrame:
    """Assemble the full ordered array for the competitors of one chart
    (the API edge: a product's competitors over a bounded window)."""
    s = series.join(competitor_ids.select("competitor_id"), "competitor_id", "left_semi")
    g = s.groupBy("competitor_id").agg(F.array_sort(F.collect_list(F.struct("day", "chunk", "data_points"))).alias("d"))
    return g.select("competitor_id", F.flatten(F.transform("d", lambda x: x["data_points"])).alias("data_points"))


# --- E3 / E6 / E7 / F5 ------------------------------------------------------------

def last_n_points(price_history: DataFrame, n: int = C.LAST_N_POINTS) -> DataFrame:
    """The newest ``n`` successful points per competitor, with ``pos`` 1..n
    ascending.  The filter on a constant rank lets Spark insert a map-side
    WindowGroupLimit, so a hot competitor sends at most ``n`` rows per map task."""
    ok = success_price(price_history, zero_is_missing=True)
    w = Window.partitionBy("competitor_id").orderBy(F.col("scraped_at").desc(), F.col("id").desc())
    top = ok.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    w2 = Window.partitionBy("competitor_id").orderBy("scraped_at", "id")
    return top.withColumn("pos", F.row_number().over(w2)).drop("__rn")


def first_last(price_history: DataFrame, as_of, days: int = C.DEFAULT_HISTORY_DAYS) -> DataFrame:
    """First and last successful price per competitor in the window."""
    ok = success_price(last_n_days(price_history, as_of, days), zero_is_missing=True)
    order = F.struct("scraped_at", "id")
    return ok.groupBy("competitor_id").agg(F.min_by("price", order).alias("first_price"),
                                           F.max_by("price", order).alias("last_price"))


def indexed_series(price_history: DataFrame, as_of, days: int = C.DEFAULT_HISTORY_DAYS) -> DataFrame:
    """Each successful point's change in % against the first point of the
    window (row form of D2's change).  First prices come from an aggregate and
    are joined back, so no per-competitor window is needed."""
    ok = success_price(last_n_days(price_history, as_of, days), zero_is_missing=True)
    first = first_last(price_history, as_of, days).select("competitor_id", "first_price")
    return (ok.join(first, "competitor_id")
            .withColumn("change_vs_first",
                        F.when(F.col("first_price") > 0,
                               ((F.col("price") - F.col("first_price")) * 100).cast("double")
                               / F.col("first_price").cast("double"))))


def history_page(price_history: DataFrame, competitors: DataFrame, product_id=None,
                 limit: int = C.DEFAULT_PAGE_LIMIT, offset: int = 0) -> DataFrame:
    """F5 + D14: newest-first page of a product's rows and the exact total.
    With ``product_id=None`` pages are ranked within every product (no global
    window), which is the vectorised form of the per-product endpoint."""
    comp = competitors.select(F.col("id").alias("competitor_id"), "product_id")
    if product_id is not None:
        comp = comp.filter(F.col("product_id") == F.lit(product_id))
    rows = price_history.join(comp, "competitor_id", "inner")
    w = Window.partitionBy("product_id").orderBy(F.col("scraped_at").desc(), F.col("id").desc())
    # a constant upper bound on row_number lets Spark limit each product map-side
    ranked = rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= offset + limit)
    page = ranked.filter(F.col("__rn") > offset).withColumn("row_pos", F.col("__rn") - 1).drop("__rn")
    totals = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("total"))
    return page.join(totals, "product_id")


# --- D5: per-competitor insight features -------------------------------------------

def insight_features(price_history: DataFrame, competitors: DataFrame, as_of,
                     days: int = C.INSIGHT_ANALYSIS_DAYS, n_points: int = C.LAST_N_POINTS) -> DataFrame:
    """Per competitor with >= 1 successful non-zero price in the window:
    count, average (half-even, 2 decimals), min, max, first, current and the
    last ``n_points`` points (ascending).  ``total_competitors`` counts the
    competitors of the product that have such prices."""
    win = last_n_days(price_history, as_of, days)
    ok = success_price(win, zero_is_missing=True)
    order = F.struct("scraped_at", "id")
    stats = ok.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("price_count"),
        F.sum("price").alias("__sum"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("current_price"))
    pts = (last_n_points(win, n_points)
           .groupBy("competitor_id")
           .agg(F.array_sort(F.collect_list(F.struct("pos", "scraped_at", "price", "currency"))).alias("price_history")))
    comp = competitors.select(F.col("id").alias("competitor_id"), "product_id",
                              F.coalesce(F.when(F.col("retailer_name") != "", F.col("retailer_name")),
                                         F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)).alias("competitor"),
                              F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1).alias("domain"))
    out = (stats.join(comp, "competitor_id").join(pts, "competitor_id", "left")
           .withColumn("average_price", F.bround(F.col("__sum") / F.col("price_count"), 2).cast("decimal(12,2)"))
           .drop("__sum"))
    per_product = stats.select("competitor_id").join(comp, "competitor_id").groupBy("product_id").agg(
        F.count(F.lit(1)).alias("total_competitors"))
    return out.join(per_product, "product_id").withColumn("analysis_period_days", F.lit(days))


def price_variance(price_history: DataFrame, as_of, days: int = C.DEFAULT_HISTORY_DAYS) -> DataFrame:
    """Population variance of successful non-zero prices per competitor,
    from exact decimal moments: (n*sum(x^2) - sum(x)^2) / n^2."""
    ok = success_price(last_n_days(price_history, as_of, days), zero_is_missing=True)
    g = ok.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("s1"),
                                        F.sum(F.col("price") * F.col("price")).alias("s2"))
    return g.select("competitor_id",
                    ((F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")
                     / (F.col("n") * F.col("n")).cast("double")).alias("price_variance"))
