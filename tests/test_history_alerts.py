"""History and alert operators: worked examples and invariants."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from pricelens.operators import alerts as A
from pricelens.operators import history as H

PH_SCHEMA = ("id long, competitor_id long, price decimal(10,2), currency string, scraped_at timestamp_ntz, "
             "scrape_status string, error_message string")


def _ph(spark, rows):
    return spark.createDataFrame(rows, PH_SCHEMA)


def test_worked_example_price_drop(spark):
    ph = _ph(spark, [(1, 7, Decimal("99.99"), "USD", datetime(2024, 1, 15, 10), "success", None),
                     (2, 7, Decimal("89.99"), "USD", datetime(2024, 1, 16, 10), "success", None)])
    comps = spark.createDataFrame([(7, 1, Decimal("10.00"))], "id long, product_id long, alert_threshold_percent decimal(5,2)")
    prods = spark.createDataFrame([(1, 5)], "id long, user_id long")
    d = {r["id"]: r for r in A.detect_changes(ph, comps, prods).collect()}
    assert d[1]["reason"] == "first" and d[1]["alert_type"] is None
    assert d[2]["alert_type"] == "price_drop"
    assert d[2]["price_change_percent"] == Decimal("-10.00")


def test_previous_price_skips_failures_across_days(spark):
    rows = [(1, 1, Decimal("10"), "USD", datetime(2024, 1, 1, 5), "success", None),
            (2, 1, None, "USD", datetime(2024, 1, 2, 5), "failed", "timeout"),
            (3, 1, Decimal("0"), "USD", datetime(2024, 1, 4, 5), "success", None),
            (4, 1, Decimal("12"), "USD", datetime(2024, 1, 4, 6), "success", None),
            (5, 1, Decimal("13"), "EUR", datetime(2024, 1, 9, 6), "success", None)]
    out = {r["id"]: (r["old_price"], r["old_currency"]) for r in H.with_previous_price(_ph(spark, rows)).collect()}
    assert out == {1: (None, None), 3: (Decimal("10.00"), "USD"), 4: (Decimal("0.00"), "USD"), 5: (Decimal("12.00"), "USD")}


def test_last_n_points(spark):
    rows3 = [(i, 1, Decimal(10 + i), "USD", datetime(2024, 1, 1 + i), "success", None) for i in range(3)]
    rows12 = [(100 + i, 2, Decimal(10 + i), "USD", datetime(2024, 1, 1 + i), "success", None) for i in range(12)]
    out = H.last_n_points(_ph(spark, rows3 + rows12), 10).collect()
    c1 = sorted((r["pos"], r["id"]) for r in out if r["competitor_id"] == 1)
    c2 = sorted((r["pos"], r["id"]) for r in out if r["competitor_id"] == 2)
    assert [i for _, i in c1] == [0, 1, 2]
    assert [i for _, i in c2] == list(range(102, 112))


def test_cap_and_settings_invariants(model):
    settings = A.settings_with_defaults(model.users, model.user_alert_settings)
    dec = A.alert_decision(model.detections, settings, existing_pending=None)
    rows = dec.collect()
    per_user = {}
    for r in rows:
        if r["alert_created"] and r["alert_type"] != "currency_changed":
            per_user[r["user_id"]] = per_user.get(r["user_id"], 0) + 1
    assert per_user and max(per_user.values()) <= 100
    s = {r["user_id"]: r for r in settings.collect()}
    for r in rows:
        if r["alert_created"] and r["alert_type"] == "price_drop":
            assert s[r["user_id"]]["alert_price_drop"] and s[r["user_id"]]["email_enabled"]
        if r["alert_type"] in ("price_drop", "price_increase") and r["price_change_percent"] is not None \
                and r["price_change_percent"] != 0:
            assert (r["price_change_percent"] < 0) == (r["alert_type"] == "price_drop")


def test_cap_is_sequential(spark):
    # 3 existing unsent alerts, cap 5: of 4 candidates (currency in the middle) the
    # first two price alerts pass, the currency alert passes, the last price one fails
    cand = spark.createDataFrame(
        [(1, 9, "price_drop", datetime(2024, 1, 1, 1)), (2, 9, "price_increase", datetime(2024, 1, 1, 2)),
         (3, 9, "currency_changed", datetime(2024, 1, 1, 3)), (4, 9, "price_drop", datetime(2024, 1, 1, 4))],
        "id long, user_id long, alert_type string, detected_at timestamp_ntz") \
        .withColumn("price_change_percent", F.lit(Decimal("-12.00")).cast("decimal(12,2)")) \
        .withColumn("old_currency", F.lit("USD")).withColumn("new_currency", F.lit("USD"))
    existing = spark.createDataFrame([(10 + i, 9, False) for i in range(3)], "id long, user_id long, included_in_digest boolean")
    settings = spark.createDataFrame([(9, True, True, True, True)],
                                     "user_id long, email_enabled boolean, alert_price_drop boolean, alert_price_increase boolean, has_settings boolean")
    got = {r["id"]: r["alert_created"] for r in A.alert_decision(cand, settings, existing, cap=5).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_digest_cap(model):
    due = A.users_due_for_digest(model.user_alert_settings, model.pending_alerts, model.users, "2024-01-31 00:00:00")
    det = A.alert_details(model.pending_alerts, model.products, model.competitors)
    rows = A.digest_alerts(det, due)
    per = rows.filter("mailed").groupBy("user_id").count().collect()
    assert all(r["count"] <= 50 for r in per)
    msgs = A.digest_messages(rows).collect()
    for m in msgs:
        assert m["alerts_mailed"] == min(50, m["alerts_count"])
        assert len(m["subject"]) <= 200


def test_competitor_stats_keeps_empty_competitors(model):
    s = H.competitor_stats(model.competitors, model.price_history, "2024-01-31 00:00:00", 30)
    total = model.competitors.count()
    assert s.count() == total
    assert s.filter("data_points = 0").count() > 0


def test_price_csv_export(spark, model, tmp_path):
    import csv
    import glob
    from pricelens.operators import maintenance as MT
    rows = MT.price_csv_rows(model.price_history, model.competitors)
    out = str(tmp_path / "csv")
    MT.write_price_csv(rows, out)
    files = [f for f in glob.glob(out + "/product_id=*/month=*/*.csv") if "part-" in f]
    assert files
    with open(files[0], newline="") as fh:
        data = list(csv.reader(fh))
    assert data[0] == ["Date", "Time", "Competitor", "Price", "Currency", "Status", "Error"]
    stamps = [r[0] + " " + r[1] for r in data[1:]]
    assert stamps == sorted(stamps, reverse=True)            # newest first
    failed = [r for r in data[1:] if r[5] == "failed"]
    assert all(r[3] == "" and r[6] == "timeout" for r in failed)  # missing price -> empty cell


def test_chart_points_and_list_limits(spark, model):
    from pricelens.operators import dashboard as DB
    series = H.series_points(model.price_history, "2024-01-31 00:00:00", 30)
    ids = model.competitors.filter(F.col("id") < 3).select(F.col("id").alias("competitor_id"))
    chart = {r["competitor_id"]: r["data_points"] for r in H.chart_points(series, ids).collect()}
    raw = model.price_history.filter((F.col("competitor_id") < 3)
                                     & (F.col("scraped_at") >= F.lit("2024-01-01").cast("timestamp_ntz")))
    for cid, pts in chart.items():
        want = sorted((r["scraped_at"], r["id"]) for r in raw.filter(F.col("competitor_id") == cid).collect())
        assert [(p["timestamp"], p["id"]) for p in pts] == want      # whole window, ascending across days
    det = A.alert_details(model.pending_alerts, model.products, model.competitors)
    full = DB.pending_list(det)
    top = DB.pending_list(det, limit=5)
    assert top.groupBy("user_id").count().agg(F.max("count")).first()[0] <= 5
    totals = lambda df: sorted(tuple(r) for r in df.select("user_id", "total").distinct().collect())
    assert totals(top) == totals(full)          # the total counts every unsent alert, not just the page
    pl = DB.product_list(model.products, model.competitors, limit=2).collect()
    assert all(r["list_pos"] <= 2 for r in pl)


def test_lists_of_any_length_come_in_chunks(spark):
    """A competitor scraped 10,000 times in a day."""
    from pricelens.operators import dashboard as DB
    from pricelens.operators import maintenance as MT
    h = spark.range(10_000).select(
        "id", F.lit(1).cast("bigint").alias("competitor_id"), (F.col("id") % 90).cast("decimal(10,2)").alias("price"),
        F.lit("USD").alias("currency"),
        (F.lit("2024-01-30 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 8)).alias("scraped_at"),
        F.lit("success").alias("scrape_status"), F.lit(None).cast("string").alias("error_message"))
    comp = spark.createDataFrame([(1, 5, "https://www.a.com/x", None, 10.0)],
                                 "id long, product_id long, url string, retailer_name string, alert_threshold_percent double"
                                 ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = sorted(H.series_points(h, "2024-01-31 00:00:00", 30, size=300).collect(), key=lambda r: r.chunk)
    assert [r.chunk for r in rows] == list(range(34)) and max(len(r.data_points) for r in rows) == 300
    assert [p.id for r in rows for p in r.data_points] == list(range(10_000))
    runs = sorted(DB.run_results(h, comp, size=999).collect(), key=lambda r: r.chunk)
    assert sum(len(r.results) for r in runs) == 10_000 and max(len(r.results) for r in runs) == 999
    assert [p.price for r in runs for p in r.results] == [str(p) for p in sorted(r.price for r in h.collect())]
    products = spark.createDataFrame([(5, 1, "p")], "id long, user_id long, product_name string")
    docs = MT.chart_documents(products, comp, h, "2024-01-31 00:00:00", size=500).filter("part = 'points'").collect()
    assert len(docs) == 20 and max(len(d.document) for d in docs) < 80_000


def test_price_csv_is_one_file_a_product_and_month(spark, tmp_path):
    """Folders, names and contents are those of Spark's own writer; there is
    one file in each and nothing beside it, an older export goes, and no more
    tasks list the folders than a shuffle has."""
    import glob
    import os
    from pricelens.operators import maintenance as MT
    odd = ["a/b=c:d%e", "it's [x]^{y}", "", None, "é 日", 'q"#*?\\', *(f"p{i}" for i in range(60))]
    cells = [None, "", "a,b", 'say "x"', "two\nlines", "x\r\ny", " lead ", "\\"]
    rows = [(p, f"2024-0{m}-01 00:00:{n:02d}" if m else None, 100 * i + 10 * m + n, cells[(i + n) % 8], cells[(i + m) % 8])
            for i, p in enumerate(odd) for m in (0, 1, 2) for n in range(3)]
    rows = spark.createDataFrame(rows, "product_id string, t string, __id long, Competitor string, Error string").select(
        "product_id", F.col("t").cast("timestamp_ntz").alias("__ts"), "__id", F.substring("t", 1, 10).alias("Date"),
        F.substring("t", 12, 8).alias("Time"), "Competitor", F.lit("1.5").alias("Price"), F.lit("USD").alias("Currency"),
        F.lit("success").alias("Status"), "Error")
    own, spark_s = str(tmp_path / "own"), str(tmp_path / "spark")
    MT.write_price_csv(rows.limit(5), own)
    MT.write_price_csv(rows, own)
    (rows.replace("", None, ["product_id"]).withColumn("month", F.substring("Date", 1, 7)).repartition(1)
     .sortWithinPartitions("product_id", "month", F.col("__ts").desc(), F.col("__id").desc()).drop("__ts", "__id")
     .write.partitionBy("product_id", "month").option("header", True).option("escape", '"').option("emptyValue", "").csv(spark_s))

    def contents(path):
        return sorted((os.path.relpath(os.path.dirname(f), path), sorted(open(f, newline="").read().splitlines()))
                      for f in glob.glob(path + "/*/*/part-*.csv"))

    assert contents(own) == contents(spark_s)
    every = [f for d, _, files in os.walk(own) for f in files]
    assert len(every) == len(contents(own)) + 1 and "_SUCCESS" in every       # before: a checksum file for each
    MT.write_price_csv(rows.withColumn("product_id", F.floor(F.col("__id") / 100)), own)
    spark.sparkContext.setJobGroup("csv-list", "")
    back = MT.read_price_csv(spark, own)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("csv-list") for s in tracker.getJobInfo(j).stageIds]
    assert stages and all(s.numTasks <= 4 for s in stages)                     # before: one for each product
    assert back.select("product_id").distinct().count() == len(odd)


def test_price_csv_of_no_rows(spark, model, tmp_path):
    from pricelens.operators import maintenance as MT
    out = f"file://{tmp_path}/none"
    MT.write_price_csv(MT.price_csv_rows(model.price_history.limit(0), model.competitors), out)
    assert MT.read_price_csv(spark, out).collect() == []
