"""Insight operators.

The application hands per-competitor features (D5) to an external model and
asks for weekly cycles, trends, anomalies and price position.  Here those
analyses are deterministic aggregates.  Statistics are built from exact
decimal moments (n, sum x, sum x^2, ...) so partial aggregation can combine
any number of map-side partials of a hot competitor; only the final ratio is
floating point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..config import materialize
from ..functions.text import confidence as conf_of
from ..functions.text import fmt_decimal, insight_type, sanitize_insight
from .history import last_n_days, success_price, ts_lit


# fixed values: weekday names in dayofweek() order (1 = Sunday)
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def _window_ok(history: DataFrame, as_of, days: int) -> DataFrame:
    return success_price(last_n_days(history, as_of, days), zero_is_missing=True)


def day_moments(history: DataFrame, as_of, days: int = C.INSIGHT_ANALYSIS_DAYS) -> DataFrame:
    """Per competitor and weekday (1 = Sunday) the exact moments of time x
    (minutes since the window's start) and price y, and the latest price: all
    that M1, M2 and M4 need, in one pass over the history."""
    start = ts_lit(as_of) - F.make_dt_interval(F.lit(days))
    ok = (_window_ok(history, as_of, days).withColumn("x", F.timestamp_diff("MINUTE", start, F.col("scraped_at")))
          .withColumn("weekday", F.dayofweek("scraped_at")))
    at = F.struct("scraped_at", "id")
    return ok.groupBy("competitor_id", "weekday").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").cast("decimal(38,0)").alias("sx"), F.sum("price").alias("sy"),
        F.sum(F.col("x").cast("decimal(38,0)") * F.col("x")).alias("sxx"),
        F.sum(F.col("x").cast("decimal(20,0)") * F.col("price")).alias("sxy"),
        F.sum(F.col("price") * F.col("price")).alias("syy"),
        F.max(at).alias("at"), F.max_by("price", at).alias("latest"))


def weekly_cycle(history: DataFrame | None, as_of, days: int = C.INSIGHT_ANALYSIS_DAYS,
                 moments: DataFrame | None = None) -> DataFrame:
    """M1: mean price per weekday (1 = Sunday) and its ratio to the
    competitor's overall mean."""
    per_day = (moments if moments is not None else day_moments(history, as_of, days)).select(
        "competitor_id", "weekday", F.col("n").alias("n_d"), F.col("sy").alias("s_d"))
    overall = per_day.groupBy("competitor_id").agg(F.sum("n_d").alias("n"), F.sum("s_d").alias("s"))
    j = per_day.join(overall, "competitor_id")
    return j.select("competitor_id", "weekday", "n_d",
                    (F.col("s_d").cast("double") / F.col("n_d")).alias("avg_price"),
                    F.when(F.col("s") != 0, (F.col("s_d") * F.col("n")).cast("double") / (F.col("s") * F.col("n_d")).cast("double"))
                    .alias("ratio_to_mean"))


def trend(history: DataFrame | None, as_of, days: int = C.INSIGHT_ANALYSIS_DAYS,
          moments: DataFrame | None = None) -> DataFrame:
    """M2: least-squares slope (price per day) and r^2 per competitor."""
    m = (moments if moments is not None else day_moments(history, as_of, days)).groupBy("competitor_id").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("sx", "sy", "sxx", "sxy", "syy")])
    num = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double")
    denx = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")
    deny = (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")).cast("double")
    return m.select("competitor_id", "n",
                    F.when(denx != 0, num / denx * F.lit(1440.0)).alias("slope_per_day"),
                    F.when((denx != 0) & (deny != 0), (num / denx) * (num / deny)).alias("r2"))


def anomalies(history: DataFrame, as_of, days: int = C.INSIGHT_ANALYSIS_DAYS, k: int = 2,
              moments: DataFrame | None = None) -> DataFrame:
    """M3: points whose |z| exceeds ``k``.  The test is exact:
    (n*x - S1)^2 > k^2 * (n*S2 - S1^2); z itself is reported as a double."""
    ok = _window_ok(history, as_of, days)
    if moments is None:
        g = ok.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("s1"),
                                            F.sum(F.col("price") * F.col("price")).alias("s2"))
    else:
        g = moments.groupBy("competitor_id").agg(F.sum("n").alias("n"), F.sum("sy").alias("s1"), F.sum("syy").alias("s2"))
    j = ok.join(g, "competitor_id")
    dev = F.col("n") * F.col("price") - F.col("s1")
    var_n = F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")
    return (j.filter((var_n > 0) & (dev * dev > F.lit(k * k) * var_n))
            .select("id", "competitor_id", "price", "scraped_at",
                    (dev.cast("double") / F.sqrt(var_n.cast("double"))).alias("z")))


def price_position(history: DataFrame | None, competitors: DataFrame, as_of, days: int = C.INSIGHT_ANALYSIS_DAYS,
                   moments: DataFrame | None = None) -> DataFrame:
    """M4: each competitor's current price against the product's mean of
    current prices: % difference and rank (1 = cheapest)."""
    if moments is None:
        cur = _window_ok(history, as_of, days).groupBy("competitor_id").agg(
            F.max_by("price", F.struct("scraped_at", "id")).alias("current_price"))
    else:
        cur = moments.groupBy("competitor_id").agg(F.max_by("latest", "at").alias("current_price"))
    c = cur.join(competitors.select(F.col("id").alias("competitor_id"), "product_id"), "competitor_id")
    p = c.groupBy("product_id").agg(F.count(F.lit(1)).alias("pn"), F.sum("current_price").alias("ps"))
    j = c.join(p, "product_id")
    w = Window.partitionBy("product_id").orderBy("current_price")
    return j.select("product_id", "competitor_id", "current_price",
                    ((F.col("current_price") * F.col("pn") - F.col("ps")) * 100).cast("double").alias("__num"),
                    F.col("ps").cast("double").alias("__den"),
                    F.rank().over(w).alias("price_rank"), F.col("pn").alias("competitors")) \
        .withColumn("pct_vs_mean", F.when(F.col("__den") != 0, F.col("__num") / F.col("__den"))).drop("__num", "__den")


def insight_rows(history: DataFrame, competitors: DataFrame, products: DataFrame, insights: DataFrame, as_of,
                 days: int = C.INSIGHT_ANALYSIS_DAYS, force_regenerate: bool = False,
                 max_rows: int = C.MAX_INSIGHTS_PER_PRODUCT, max_text: int = 200) -> DataFrame:
    """M5 (+E8, H8, I7, I8, C8): rule-based insight rows per product from
    M1 (cheapest weekday), M2 (trend), M3 (anomaly counts) and M4 (cheapest
    competitor) - at most ``max_rows`` per product, only for products without
    an insight today (unless forced).  M1, M2 and M4 come from one table of
    moments, written once (a row per competitor and weekday); only M3 reads
    the history again."""
    from .dashboard import no_insight_today
    from ..functions.url import retailer_or_domain
    names = competitors.select(F.col("id").alias("competitor_id"), "product_id",
                               retailer_or_domain(F.col("retailer_name"), F.col("url")).alias("cname"))
    moments = materialize(day_moments(history, as_of, days), "day_moments")
    tr = trend(None, as_of, days, moments).join(names, "competitor_id").filter(F.col("slope_per_day").isNotNull())
    t_rows = tr.select("product_id", "competitor_id", F.lit("pattern").alias("type"),
                       F.concat(F.col("cname"), F.lit(": prices trending "),
                                F.when(F.col("slope_per_day") < 0, "down").otherwise("up"), F.lit(" by "),
                                fmt_decimal(F.abs("slope_per_day").cast("decimal(30,10)"), 2), F.lit(" per day")).alias("text"),
                       F.coalesce(F.col("r2"), F.lit(0.0)).alias("raw_conf"))
    an = anomalies(history, as_of, days, moments=moments).groupBy("competitor_id").agg(F.count(F.lit(1)).alias("k")).join(names, "competitor_id")
    a_rows = an.select("product_id", "competitor_id", F.lit("ALERT").alias("type"),
                       F.concat(F.col("cname"), F.lit(": "), F.col("k").cast("string"), F.lit(" unusual price points")).alias("text"),
                       F.lit(0.75).alias("raw_conf"))
    pp = price_position(None, competitors, as_of, days, moments).join(names.drop("product_id"), "competitor_id")
    p_rows = pp.filter(F.col("price_rank") == 1).select(
        "product_id", "competitor_id", F.lit("recommendation").alias("type"),
        F.concat(F.col("cname"), F.lit(" is the cheapest, "),
                 fmt_decimal(F.abs(F.col("pct_vs_mean")).cast("decimal(30,10)"), 1), F.lit("% below the average")).alias("text"),
        F.lit(0.9).alias("raw_conf"))
    # M1: a competitor's cheapest weekday, when it is more than 2 % below its mean
    wd = F.array(*[F.lit(d) for d in WEEKDAYS])
    wc = weekly_cycle(None, as_of, days, moments)
    cheap = (wc.filter(F.col("ratio_to_mean") < 0.98).groupBy("competitor_id")
             .agg(F.min_by(F.struct("weekday", "ratio_to_mean"), F.struct("ratio_to_mean", "weekday")).alias("c"))
             .join(names, "competitor_id"))
    w_rows = cheap.select(
        "product_id", "competitor_id", F.lit("pattern").alias("type"),
        F.concat(F.col("cname"), F.lit(": cheapest on "), F.get(wd, F.col("c.weekday") - 1), F.lit(" ("),
                 fmt_decimal(((F.lit(1.0) - F.col("c.ratio_to_mean")) * 100).cast("decimal(30,10)"), 1),
                 F.lit("% below its average)")).alias("text"),
        F.lit(0.6).alias("raw_conf"))
    rows = t_rows.unionByName(a_rows).unionByName(p_rows).unionByName(w_rows)
    todo = no_insight_today(products, insights, as_of, force_regenerate).select(F.col("id").alias("product_id"))
    rows = rows.join(todo, "product_id", "left_semi")
    w = Window.partitionBy("product_id").orderBy(F.col("raw_conf").desc(), F.col("type"), F.col("competitor_id"))
    top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_rows)
    # generated texts are kept to ``max_text`` characters, then validated like any
    # generator's output (H8 allows up to 500)
    short = F.when(F.char_length("text") > max_text, F.concat(F.substring("text", 1, max_text - 3), F.lit("..."))).otherwise(F.col("text"))
    return top.select("product_id", "rank", insight_type(F.col("type")).alias("insight_type"),
                      sanitize_insight(short).alias("insight_text"),
                      conf_of(F.col("raw_conf")).alias("confidence_score"))


INSIGHT_JSON = T.StructType([T.StructField("insights", T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("confidence", T.StringType())])))])


def validate_insights(raw: DataFrame, max_rows: int = C.MAX_INSIGHTS_PER_PRODUCT) -> DataFrame:
    """M6 (+E8, H8, I7, I8): (product_id, payload JSON) from any generator ->
    validated rows: first ``max_rows`` per payload, type normalised, text sanitised,
    confidence checked and rounded."""
    p = raw.select("product_id", F.from_json("payload", INSIGHT_JSON).alias("j"))
    e = p.select("product_id", F.posexplode(F.coalesce(F.col("j.insights"), F.array())).alias("pos", "x"))
    e = e.filter(F.col("pos") < max_rows)
    return e.select("product_id", "pos", insight_type(F.col("x.type")).alias("insight_type"),
                    sanitize_insight(F.coalesce(F.col("x.text"), F.lit(""))).alias("insight_text"),
                    conf_of(F.col("x.confidence")).alias("confidence_score"))


def insights_append(rows: DataFrame, as_of) -> DataFrame:
    """A10: validated insights as ``insights`` rows."""
    return rows.select("product_id", "insight_text", "insight_type", F.col("confidence_score").cast("decimal(3,2)"),
                       ts_lit(as_of).alias("generated_at"))
