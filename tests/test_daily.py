"""The composed daily cycle on the model tables."""

from pyspark.sql import functions as F

from pricelens.plans import daily as D
from pricelens.sources.landed import product_pages


def _tables(model):
    return {"users": model.users, "products": model.products, "competitors": model.competitors,
            "price_history": model.price_history, "user_alert_settings": model.user_alert_settings,
            "pending_alerts": model.pending_alerts}


def test_scrape_and_detect(spark, model):
    t = _tables(model)
    pages = product_pages(model.catalog)
    # competitors point at the landed product page of "their" part
    t["competitors"] = t["competitors"].withColumn(
        "url", F.concat(F.lit("https://shop"), (F.col("id") % 4).cast("string"), F.lit(".example.com/item/"),
                        (F.col("id") - F.col("id") % 4 + F.col("id") % 4).cast("string")))
    out = D.scrape_and_detect(t, pages, "2024-01-31 02:00:00", checkpoint=True)
    new = out["new_history"].collect()
    active = t["competitors"].join(model.products.filter("is_active").select(F.col("id").alias("product_id")),
                                   "product_id", "left_semi").count()
    assert len(new) == active                       # nothing scraped yet on the 31st
    assert len({r["id"] for r in new}) == len(new)
    ok = [r for r in new if r["scrape_status"] == "success"]
    assert ok and all(r["price"] is not None and r["price"] > 0 for r in ok)
    dec = out["decisions"].collect()
    assert all(r["id"] in {x["id"] for x in ok} for r in dec)
    assert out["new_pending"].count() <= len(dec)
    import tempfile
    root = tempfile.mkdtemp(prefix="daily-")
    D.write_daily(out, root + "/history", root + "/alerts", "2024-01-31")
    D.write_daily(out, root + "/history", root + "/alerts", "2024-01-31")   # rerun: same result
    assert spark.read.parquet(root + "/history").count() == len(new)


def test_digest_and_cleanup(spark, model):
    t = _tables(model)
    out = D.digest_run(t, None, "2024-01-31 00:00:00")
    msgs = out["messages"].collect()
    assert msgs and all(m["alerts_mailed"] <= 50 for m in msgs)
    delivery = out["due"].select("user_id", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    done = D.digest_run(t, delivery, "2024-01-31 00:00:00")
    due_users = [r["user_id"] for r in out["due"].collect()]
    left = done["pending_alerts"].filter(~F.col("included_in_digest") & F.col("user_id").isin(due_users)).count()
    assert left == 0
    kept = D.cleanup(t, "2024-01-31 00:00:00").count()
    assert kept < model.pending_alerts.count()


def test_string_keys(spark, model):
    """The daily cycle with UUID-style string keys."""
    t = _tables(model)
    for name, cols in {"products": ["id", "user_id"], "competitors": ["id", "product_id"],
                       "price_history": ["id", "competitor_id"], "users": ["user_id"],
                       "user_alert_settings": ["user_id"],
                       "pending_alerts": ["id", "user_id", "product_id", "competitor_id"]}.items():
        df = t[name]
        for c in cols:
            df = df.withColumn(c, F.concat(F.lit("k-"), F.col(c).cast("string")))
        t[name] = df
    t["competitors"] = t["competitors"].withColumn(
        "url", F.concat(F.lit("https://shop0.example.com/item/"), F.lit("4")))
    out = D.scrape_and_detect(t, product_pages(model.catalog), "2024-01-31 02:00:00")
    new = out["new_history"].collect()
    assert new and all(isinstance(r["id"], str) and len(r["id"]) == 64 for r in new)
    assert out["decisions"].count() >= 0
