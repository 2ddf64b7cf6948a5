"""Change detection and alert digests.

I2 classify_change, I3 alert_decision (with C5 settings and E4 pending cap),
C4 alert details, C6 users due for a digest, E5 digest cap, D6/D8/D12 counts,
K11 finishing a digest run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as TX
from .history import ts_lit, with_previous_price


# fixed values: the messages that users see
MSG_EMAIL_OFF = "User has disabled email alerts"
MSG_DROP_OFF = "User has disabled price drop alerts"
MSG_INCREASE_OFF = "User has disabled price increase alerts"
MSG_CURRENCY = "Currency changed: %s → %s"
MSG_FULL = "User has too many pending alerts (%s)"
MSG_CREATED = "Alert created: %s of %s%%"


def pct_change(old: Column, new: Column) -> Column:
    """(new-old)*100/old as an exact decimal; null when old is 0 or null.
    Multiplying before dividing keeps every digit of the quotient."""
    return ((new - old) * 100) / F.when(old != 0, old)


def classify_change(old_price: Column, new_price: Column, old_currency: Column, new_currency: Column,
                    threshold: Column, checked: Column | None = None) -> Column:
    """Alert type of one observation given the previous successful one.

    first observation -> null; currency differs -> 'currency_changed';
    old 0 -> null; change % <= -threshold -> 'price_drop'; >= threshold ->
    'price_increase'; else |diff| >= 5.00 -> by sign; else null.  The
    threshold tests are division-free: pct <= -t  <=>  diff*100 <= -t*old
    (old > 0; the inequality flips for negative old)."""
    diff = new_price - old_price
    lhs = diff * 100
    t_old = threshold * old_price
    drop = F.when(old_price > 0, lhs <= -t_old).otherwise(lhs >= -t_old)
    rise = F.when(old_price > 0, lhs >= t_old).otherwise(lhs <= t_old)
    kind = (F.when(old_price.isNull(), F.lit(None))
            .when(old_currency != new_currency, F.lit("currency_changed"))
            .when(old_price == 0, F.lit(None))
            .when(drop, F.lit("price_drop"))
            .when(rise, F.lit("price_increase"))
            .when(F.abs(diff) >= F.lit(C.MIN_SIGNIFICANT_CHANGE), F.when(diff < 0, "price_drop").otherwise("price_increase"))
            .otherwise(F.lit(None)))
    if checked is not None:
        kind = F.when(checked, kind)
    return kind


def change_reason(old_price: Column, old_currency: Column, new_currency: Column, kind: Column) -> Column:
    """Why an observation did or did not produce an alert candidate."""
    return (F.when(old_price.isNull(), F.lit("first"))
            .when(old_currency != new_currency, F.lit("currency_changed"))
            .when(old_price == 0, F.lit("previous_zero"))
            .when(kind.isNull(), F.lit("below_threshold"))
            .otherwise(kind))


def detect_changes(price_history: DataFrame, competitors: DataFrame, products: DataFrame) -> DataFrame:
    """E1 + I2 over the whole history: one row per successful observation with a
    non-zero price (the reference only checks truthy new prices), with previous
    price, change %, alert type (null = no alert) and reason.

    Competitors and products are dimension tables joined after the per-row
    work; AQE broadcasts them when their measured size is small."""
    obs = with_previous_price(price_history).filter(F.col("price") != 0)
    comp = competitors.select(F.col("id").alias("competitor_id"), "product_id",
                              F.col("alert_threshold_percent").alias("threshold_percent"))
    prod = products.select(F.col("id").alias("product_id"), "user_id")
    d = obs.join(comp, "competitor_id").join(prod, "product_id")
    kind = classify_change(F.col("old_price"), F.col("price"), F.col("old_currency"), F.col("currency"),
                           F.col("threshold_percent"))
    pct = pct_change(F.col("old_price"), F.col("price"))
    return (d.select(
        F.col("id"), F.col("user_id"), F.col("product_id"), F.col("competitor_id"),
        kind.alias("alert_type"),
        change_reason(F.col("old_price"), F.col("old_currency"), F.col("currency"), kind).alias("reason"),
        F.col("old_price"), F.col("price").alias("new_price"),
        F.when(F.col("old_currency") == F.col("currency"), F.bround(pct, 2)).cast("decimal(12,2)")
         .alias("price_change_percent"),
        F.col("threshold_percent"),
        F.col("old_currency"), F.col("currency").alias("new_currency"),
        F.col("scraped_at").alias("detected_at")))


# --- C5: settings with defaults ---------------------------------------------------

def settings_with_defaults(users: DataFrame, settings: DataFrame) -> DataFrame:
    """Every user with effective settings; no row means everything enabled."""
    s = settings.select("user_id", "email_enabled", "alert_price_drop", "alert_price_increase",
                        "digest_frequency_hours", "last_digest_sent_at",
                        F.lit(True).alias("has_settings"))
    out = users.select("user_id").join(s, "user_id", "left")
    return out.select(
        "user_id",
        F.coalesce("email_enabled", F.lit(True)).alias("email_enabled"),
        F.coalesce("alert_price_drop", F.lit(True)).alias("alert_price_drop"),
        F.coalesce("alert_price_increase", F.lit(True)).alias("alert_price_increase"),
        F.coalesce("digest_frequency_hours", F.lit(C.DEFAULT_DIGEST_HOURS)).alias("digest_frequency_hours"),
        "last_digest_sent_at",
        F.coalesce("has_settings", F.lit(False)).alias("has_settings"))


# --- I3 / E4: decisions with settings and the pending cap ------------------------

def alert_decision(candidates: DataFrame, settings: DataFrame, existing_pending: DataFrame | None = None,
                   cap: int = C.MAX_PENDING_ALERTS_PER_USER, bucket: str = "hour") -> DataFrame:
    """Settings (C5) and the per-user pending cap (E4) applied to a batch
    of change detections.  Adds ``alert_created`` and ``message``.

    The sequential rule: candidates come in the order (detected_at, id); a
    price alert is rejected when the user then has ``cap`` or more unsent
    alerts; a currency alert is always created and counts.  Until the cap is
    reached every candidate that passes the settings is created, so with e
    existing alerts the candidate at position max(cap - e, 0) is the first one
    that meets a full list: one cutoff (detected_at, id) per user, taken from
    the user's first cap + 1 candidates (a constant bound on row_number, which
    Spark turns into a map-side WindowGroupLimit).  From the cutoff on only
    currency alerts are created, so the count that a rejected candidate sees is
    max(e, cap) plus the currency alerts since the cutoff.  These are counted
    per (user, ``bucket`` of time) and summed over the buckets before, so that
    no window holds all candidates of a user."""
    s = settings.select("user_id", "email_enabled", "alert_price_drop", "alert_price_increase", "has_settings")
    c = candidates.filter(F.col("alert_type").isNotNull()).join(s, "user_id", "left")
    has = F.coalesce(F.col("has_settings"), F.lit(False))
    is_cur = F.col("alert_type") == "currency_changed"
    blocked = (F.when(is_cur | ~has, F.lit(None))
               .when(~F.col("email_enabled"), F.lit(MSG_EMAIL_OFF))
               .when((F.col("alert_type") == "price_drop") & ~F.col("alert_price_drop"), F.lit(MSG_DROP_OFF))
               .when((F.col("alert_type") == "price_increase") & ~F.col("alert_price_increase"), F.lit(MSG_INCREASE_OFF)))
    c = c.withColumn("__blocked", blocked)

    # one row per user: e and the cutoff
    w = Window.partitionBy("user_id").orderBy("detected_at", "id")
    firsts = (c.filter(F.col("__blocked").isNull()).select("user_id", "id", "detected_at")
              .withColumn("__pos", F.row_number().over(w)).filter(F.col("__pos") <= cap + 1))
    if existing_pending is not None:
        firsts = firsts.join(existing_pending.filter(~F.col("included_in_digest"))
                             .groupBy("user_id").agg(F.count(F.lit(1)).alias("__existing")), "user_id", "left")
    else:
        firsts = firsts.withColumn("__existing", F.lit(0))
    e = F.coalesce(F.col("__existing"), F.lit(0))
    cut = (firsts.filter(F.col("__pos") - 1 == F.greatest(F.lit(cap) - e, F.lit(0)))
           .select("user_id", F.greatest(e, F.lit(cap)).alias("__full"),
                   F.struct("detected_at", "id").alias("__cut")))
    out = (c.join(cut, "user_id", "left")
           .withColumn("__over", F.coalesce(F.col("__blocked").isNull()
                                            & (F.struct("detected_at", "id") >= F.col("__cut")), F.lit(False)))
           .withColumn("__b", F.date_trunc(bucket, "detected_at")))
    # currency alerts from the cutoff up to each row: earlier buckets, then this one
    cur = F.when(F.col("__over") & is_cur, 1).otherwise(0)
    wb = Window.partitionBy("user_id", "__b").orderBy("detected_at", "id")
    here = F.sum(cur).over(wb.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("__here", here).withColumn("__last", F.lead(F.lit(1)).over(wb).isNull())
    per_bucket = (out.filter("__last")
                  .select("user_id", "__b", (F.coalesce("__here", F.lit(0)) + cur).alias("n")))
    before = per_bucket.select("user_id", "__b", F.sum("n").over(
        Window.partitionBy("user_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    out = out.join(before, ["user_id", "__b"], "left")
    seen = F.col("__full") + F.coalesce("__before", F.lit(0)) + F.coalesce("__here", F.lit(0))
    created = F.col("__blocked").isNull() & (is_cur | ~F.col("__over"))
    pct_txt = TX.fmt_decimal(F.abs(F.col("price_change_percent")), 2)
    msg = (F.when(F.col("__blocked").isNotNull(), F.col("__blocked"))
           .when(is_cur, F.format_string(MSG_CURRENCY, "old_currency", "new_currency"))
           .when(F.col("__over"), F.format_string(MSG_FULL, seen.cast("string")))
           .otherwise(F.format_string(MSG_CREATED, "alert_type", pct_txt)))
    return (out.withColumn("alert_created", created).withColumn("message", msg)
            .drop("__blocked", "__full", "__cut", "__over", "__b", "__here", "__last", "__before", "email_enabled",
                  "alert_price_drop", "alert_price_increase", "has_settings"))


def new_pending_alerts(decisions: DataFrame) -> DataFrame:
    """Created decisions as ``pending_alerts`` rows (A7-style append frame)."""
    return (decisions.filter("alert_created")
            .select("id", "user_id", "product_id", "competitor_id", "alert_type", "old_price", "new_price",
                    "price_change_percent", "threshold_percent", "old_currency", "new_currency",
                    F.lit(False).alias("included_in_digest"), "detected_at"))


# --- C4 / F9: alert details --------------------------------------------------------

def alert_details(pending: DataFrame, products: DataFrame, competitors: DataFrame) -> DataFrame:
    """C4: pending alerts with product name ('Unknown') and store name
    ('Unknown Store'), via two left joins."""
    p = products.select(F.col("id").alias("product_id"), F.col("product_name"))
    c = competitors.select(F.col("id").alias("competitor_id"), F.col("retailer_name"), F.col("url"))
    return (pending.join(p, "product_id", "left").join(c, "competitor_id", "left")
            .withColumn("product_name", F.coalesce(F.col("product_name"), F.lit("Unknown")))
            .withColumn("competitor_name",
                        F.coalesce(F.when(F.col("retailer_name") != "", F.col("retailer_name")),
                                   F.lit("Unknown Store"))))


def pending_counts(pending: DataFrame) -> DataFrame:
    """Unsent alerts per user."""
    return (pending.filter(~F.col("included_in_digest"))
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("pending_count")))


def users_due_for_digest(settings: DataFrame, pending: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """C6 + I6: enabled settings rows whose last digest is unset or at least
    ``digest_frequency_hours`` before ``as_of``, having >= 1 unsent alert, with
    the user's e-mail.  Users without a settings row never get a digest."""
    now = ts_lit(as_of)
    freq = F.coalesce(F.col("digest_frequency_hours"), F.lit(C.DEFAULT_DIGEST_HOURS))
    due = (settings.filter(F.col("email_enabled"))
           .filter(F.col("last_digest_sent_at").isNull()
                   | (F.timestamp_diff("SECOND", F.col("last_digest_sent_at"), now) >= freq * 3600))
           .select("user_id", freq.alias("digest_frequency_hours")))
    return (due.join(pending_counts(pending), "user_id")
            .join(users.select("user_id", "email"), "user_id"))


def digest_alerts(pending_details: DataFrame, due: DataFrame, cap: int = C.MAX_DIGEST_ALERTS) -> DataFrame:
    """E5 + E9: the unsent alerts of due users, newest first, numbered; only the
    first ``cap`` are mailed (``mailed``).  All rows are returned because the
    run marks every pending alert, mailed or not.

    The numbers come from each user's ``cap`` newest alerts (a constant bound:
    map-side WindowGroupLimit).  They go back to the alerts by user and id as
    one small map per user, so the alerts are not shuffled by id."""
    rows = pending_details.filter(~F.col("included_in_digest")).join(due.select("user_id"), "user_id", "left_semi")
    w = Window.partitionBy("user_id").orderBy(F.col("detected_at").desc(), F.col("id").desc())
    top = (rows.select("id", "user_id", "detected_at").withColumn("line_no", F.row_number().over(w))
           .filter(F.col("line_no") <= cap).groupBy("user_id")
           .agg(F.map_from_entries(F.collect_list(F.struct("id", "line_no"))).alias("__top")))
    return (rows.join(top, "user_id", "left").withColumn("line_no", F.col("__top")[F.col("id")])
            .withColumn("mailed", F.col("line_no").isNotNull()).drop("__top"))


def digest_messages(digest_rows: DataFrame) -> DataFrame:
    """D8 + H14 + H15: per user the counts and the mail subject and body, in
    one aggregation: the body collects only the mailed lines (null lines are
    skipped), so the collected array per user is bounded by
    ``MAX_DIGEST_ALERTS``."""
    line = TX.digest_line(F.col("line_no"), F.col("product_name"), F.col("competitor_name"),
                          F.col("alert_type"), F.col("price_change_percent"), F.col("old_price"),
                          F.col("new_price"), F.lit(C.DEFAULT_CURRENCY))
    g = digest_rows.groupBy("user_id").agg(
        F.count_if(F.col("alert_type") == "price_drop").alias("drops"),
        F.count_if(F.col("alert_type") == "price_increase").alias("increases"),
        F.count(F.lit(1)).alias("alerts_count"),
        F.count_if("mailed").alias("alerts_mailed"),
        F.array_sort(F.collect_list(F.when(F.col("mailed"), F.struct("line_no", line.alias("line"))))).alias("__l"))
    return (g.withColumn("body", F.when(F.col("alerts_mailed") > 0,
                                        F.array_join(F.transform("__l", lambda x: x["line"]), "\n\n")))
            .withColumn("alerts_mailed", F.when(F.col("alerts_mailed") > 0, F.col("alerts_mailed")))
            .withColumn("subject", TX.digest_subject(F.col("drops"), F.col("increases")))
            .drop("__l"))


def finish_digest(pending: DataFrame, settings: DataFrame, delivery: DataFrame, digest_rows: DataFrame,
                  as_of) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """K11 (+K5, A9, D12): apply a delivery result (user_id, success, error) to
    the tables.  On success every pending alert of the digest is marked
    included and last_digest_sent_at = as_of; a history row is written either
    way.  Returns (new pending, new settings, alert_history rows, history
    alerts): the last has a row (user_id, digest_sent_at, alert_id) for each
    alert of a digest, as a user's list has no bound."""
    now = ts_lit(as_of)
    d = delivery.select("user_id", F.col("success").alias("__ok"), F.col("error").alias("__err"))
    sent_ids = (digest_rows.select("id", "user_id").join(d.filter("__ok"), "user_id", "left_semi")
                .select("id", F.lit(True).alias("__mark")))
    new_pending = (pending.join(sent_ids, "id", "left")
                   .withColumn("included_in_digest", F.col("included_in_digest") | F.coalesce("__mark", F.lit(False)))
                   .drop("__mark"))
    new_settings = (settings.join(d.filter("__ok").select("user_id", F.lit(True).alias("__sent")), "user_id", "left")
                    .withColumn("last_digest_sent_at",
                                F.when(F.col("__sent"), now).otherwise(F.col("last_digest_sent_at")))
                    .withColumn("updated_at", F.when(F.col("__sent"), now).otherwise(F.col("updated_at")))
                    .drop("__sent"))
    per_user = digest_rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts_count"),
                                                  F.count_if("mailed").alias("alerts_mailed"))
    history = (per_user.join(d, "user_id")
               .select("user_id", now.alias("digest_sent_at"), F.col("alerts_count").cast("int"),
                       "alerts_mailed",
                       F.when(F.col("__ok"), "sent").otherwise("failed").alias("email_status"),
                       F.when(~F.col("__ok"), F.coalesce(F.col("__err"), F.lit("Unknown error"))).alias("error_message")))
    ids = digest_rows.join(d.select("user_id"), "user_id", "left_semi").select(
        "user_id", now.alias("digest_sent_at"), F.col("id").alias("alert_id"))
    return new_pending, new_settings, history, ids


def digest_batch_totals(history_rows: DataFrame) -> DataFrame:
    """Total / sent / failed of one digest run."""
    return history_rows.agg(F.count(F.lit(1)).alias("total"),
                            F.count_if(F.col("email_status") == "sent").alias("sent"),
                            F.count_if(F.col("email_status") == "failed").alias("failed"))


def cleanup_alerts(pending: DataFrame, as_of, days: int = C.CLEANUP_PENDING_AFTER_DAYS) -> DataFrame:
    """K6: drop included alerts older than ``days``; returns the kept table."""
    cutoff = ts_lit(as_of) - F.make_dt_interval(F.lit(days))
    return pending.filter(~(F.col("included_in_digest") & (F.col("detected_at") < cutoff)))
