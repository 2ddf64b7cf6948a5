"""The daily scrape -> alert -> digest cycle composed from the operators.

``scrape_and_detect`` is the 02:00 job: worklist of active products (C9),
minus competitors already observed today (C7), scraped from landed pages
(J8), appended as history rows (A7), then change detection (E1 + I2) against
each competitor's last successful price, settings (C5) and the pending cap
(E4 / I3).  The history is read only as a per-competitor aggregate (partial
aggregation), never re-windowed in full.  ``digest_run`` is the hourly job
(C6 -> E5 -> H14 / H15 -> K11) and ``cleanup`` the 03:00 one (K6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import cut_lineage
from ..operators import alerts as A
from ..operators import dashboard as DB
from ..operators import history as H
from ..operators import html as HT
from ..operators import maintenance as MT


def scrape_and_detect(tables: dict[str, DataFrame], landed_pages: DataFrame, as_of,
                      checkpoint: bool = False) -> dict[str, DataFrame]:
    """Returns ``new_history`` (rows to append), ``decisions`` and
    ``new_pending`` (alerts to append)."""
    comps, prods, hist = tables["competitors"], tables["products"], tables["price_history"]
    work = DB.scrape_worklist(comps, prods)
    done = H.since_midnight(hist, as_of).select(F.col("competitor_id").alias("id"))
    todo = work.join(done, "id", "left_anti").select(F.col("id").alias("competitor_id"), "url")
    res = HT.scrape_result(todo, landed_pages)
    now = H.ts_lit(as_of)
    # ids are a deterministic function of (scrape day, competitor): one
    # observation per competitor and day, and a recomputed task (executor
    # loss, retry) produces the very same ids
    day = F.unix_date(F.to_date(now)).cast("bigint")
    if dict(res.dtypes)["competitor_id"] == "string":      # UUID-style keys
        new_id = F.sha2(F.concat_ws("|", F.col("competitor_id"), day.cast("string")), 256)
    else:
        new_id = F.when(F.col("competitor_id") < F.lit(1 << 32), day * F.lit(1 << 32) + F.col("competitor_id")).otherwise(
            F.raise_error(F.lit("competitor_id too large for an integer key; use string keys")).cast("bigint"))
    new_rows = res.select(new_id.alias("id"), "competitor_id", "price",
                          "currency", now.alias("scraped_at"), F.col("status"), F.col("error_message").alias("error"))
    new_hist = MT.append_prices(new_rows, as_of)
    if checkpoint:
        new_hist = cut_lineage(new_hist)   # scraped results are reused twice below
    # previous successful price: one row per competitor from the stored history
    last = (H.success_price(hist).groupBy("competitor_id")
            .agg(F.max_by(F.struct("id", "price", "currency", "scraped_at", "scrape_status", "error_message"),
                          F.struct("scraped_at", "id")).alias("r"))
            .select("competitor_id", "r.*"))
    ids = new_hist.select("id")
    det = A.detect_changes(last.unionByName(new_hist.select(*last.columns)), comps, prods).join(ids, "id", "left_semi")
    settings = A.settings_with_defaults(tables["users"], tables["user_alert_settings"])
    decisions = A.alert_decision(det, settings, existing_pending=tables["pending_alerts"])
    return {"new_history": new_hist, "decisions": decisions, "new_pending": A.new_pending_alerts(decisions)}


def digest_run(tables: dict[str, DataFrame], delivery: DataFrame | None, as_of) -> dict[str, DataFrame]:
    """Users due -> their alerts (first 50 mailed) -> subject and body; with a
    delivery result, the updated pending alerts, settings and history rows."""
    due = A.users_due_for_digest(tables["user_alert_settings"], tables["pending_alerts"], tables["users"], as_of)
    det = A.alert_details(tables["pending_alerts"], tables["products"], tables["competitors"])
    rows = A.digest_alerts(det, due)
    out = {"due": due, "rows": rows, "messages": A.digest_messages(rows)}
    if delivery is not None:
        p, s, h, ids = A.finish_digest(tables["pending_alerts"], tables["user_alert_settings"], delivery, rows, as_of)
        out.update({"pending_alerts": p, "user_alert_settings": s, "alert_history": h, "alert_history_ids": ids})
    return out


def cleanup(tables: dict[str, DataFrame], as_of) -> DataFrame:
    """K6: pending alerts kept after the daily purge."""
    return A.cleanup_alerts(tables["pending_alerts"], as_of)


def write_daily(out: dict[str, DataFrame], history_path: str, alerts_path: str, run_id: str) -> None:
    """Persist one daily run idempotently: history rows by (scrape date, run)
    and new pending alerts by (detection date, run), both with dynamic
    partition overwrite - a rerun replaces its own partitions only."""
    MT.write_history(out["new_history"], history_path, run_id)
    spark = out["new_pending"].sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        (out["new_pending"].withColumn("detect_date", F.to_date("detected_at")).withColumn("run", F.lit(run_id))
         .write.mode("overwrite").partitionBy("detect_date", "run").parquet(alerts_path))
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)
