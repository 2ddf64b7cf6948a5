"""Table maintenance as "next version of the table" DataFrames (K1-K10) and
append frames (A7, A9, A10).  With a lakehouse format each of these becomes a
MERGE; here the caller writes the returned frame to a new path / partition.
"""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import ship_package
from ..functions.text import escape_name
from ..functions.url import domain_of
from ..schemas import CONSTRAINTS, ROW_KEYS
from .history import ts_lit


# --- K1: track products -----------------------------------------------------------

def track_products(items: DataFrame, as_of) -> dict[str, DataFrame]:
    """K1 (+C10, B16): a tracking request = one group of selected catalog rows
    (request_id, user_id, group_name, threshold, ordinal, url, price,
    currency).  Produces the product (one per valid request), its competitors
    (domain as retailer name) and the initial prices (non-null prices only),
    all derived from the same rows, so no positional zip is needed: a
    competitor's id is a deterministic function of (request, ordinal).
    Requests violating the limits (1..5000 items, name 1..255 characters,
    threshold 0..100) are reported in ``rejected``."""
    now = ts_lit(as_of)
    per_req = items.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("user_id").alias("user_id"),
        F.min("group_name").alias("group_name"), F.min("threshold").alias("threshold"))
    name = F.col("group_name")          # stored as given (escaping applies to updates)
    bad = (F.when((F.col("n_items") < 1) | (F.col("n_items") > C.MAX_TRACK_ITEMS), F.lit("items must be 1..5000"))
           .when((F.char_length(name) < 1) | (F.char_length(name) > 255), F.lit("name must be 1..255 characters"))
           .when(~F.col("threshold").between(0, 100), F.lit("threshold must be within 0..100")))
    checked = per_req.withColumn("error", bad)
    ok = checked.filter(F.col("error").isNull())
    products = ok.select(F.col("request_id").alias("id"), "user_id", name.alias("product_name"),
                         F.lit(True).alias("is_active"), now.alias("created_at"), now.alias("updated_at"))
    it = items.join(ok.select("request_id"), "request_id", "left_semi")
    # (request, ordinal) packed into one key: an integer for integer keys, a
    # digest for string (UUID-style) keys
    if dict(items.dtypes)["request_id"] == "string":
        comp_id = F.sha2(F.concat_ws("|", F.col("request_id"), F.col("ordinal").cast("string")), 256)
    else:
        fits = (F.col("request_id") < F.lit(1 << 31)) & (F.col("ordinal") < F.lit(1 << 32))
        comp_id = F.when(fits, F.col("request_id") * F.lit(1 << 32) + F.col("ordinal")).otherwise(
            F.raise_error(F.lit("request_id or ordinal too large for an integer key; use string keys")).cast("bigint"))
    competitors = it.select(comp_id.alias("id"), F.col("request_id").alias("product_id"), "url",
                            domain_of(F.col("url"), "lower").alias("retailer_name"),
                            F.col("threshold").cast("decimal(5,2)").alias("alert_threshold_percent"),
                            F.lit(C.DEFAULT_CURRENCY).alias("expected_currency"), now.alias("created_at"))
    wide = F.coalesce(F.abs("price") > C.MAX_PRICE, F.lit(False))
    prices = it.filter(F.col("price").isNotNull()).select(
        comp_id.alias("id"), comp_id.alias("competitor_id"), F.when(~wide, F.col("price")).cast("decimal(10,2)").alias("price"),
        F.coalesce("currency", F.lit(C.DEFAULT_CURRENCY)).alias("currency"), now.alias("scraped_at"),
        F.when(wide, F.lit("failed")).otherwise(F.lit("success")).alias("scrape_status"),
        F.when(wide, F.lit(C.PRICE_TOO_LARGE)).alias("error_message"))
    summary = ok.select("request_id", F.col("n_items").alias("products_added"))
    stored = it.groupBy("request_id").agg(F.count("price").alias("prices_stored"))
    summary = summary.join(stored, "request_id", "left").fillna(0, ["prices_stored"])
    return {"products": products, "competitors": competitors, "price_history": prices,
            "summary": summary, "rejected": checked.filter(F.col("error").isNotNull())}


def _last_given(patch: DataFrame, key: str, fields: list[str], order: str | None) -> DataFrame:
    """One row per key: for each field the last value that is not null, in the
    order of the column ``order`` (without one, or on ties, the largest)."""
    seq = F.col(order) if order else F.lit(0)
    return patch.groupBy(key).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(seq.alias("seq"), F.col(f).alias("v")))).alias(f)
        for f in fields])


# --- K2 / K3 ----------------------------------------------------------------------

def update_products(products: DataFrame, patch: DataFrame, as_of,
                    order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """K2: partial update (product_name, is_active); a patch row with no field
    is an error; updated rows get updated_at = as_of (the trigger).  Several
    patches of a product apply in the order of the column ``order``.
    Returns (new products, errors)."""
    p = patch.withColumnsRenamed({"product_name": "__name", "is_active": "__active"})
    empty = p.filter(F.col("__name").isNull() & F.col("__active").isNull())
    valid = _last_given(p.filter(F.col("__name").isNotNull() | F.col("__active").isNotNull()), "id",
                        ["__name", "__active"], order)
    out = (products.join(valid.withColumn("__hit", F.lit(True)), "id", "left")
           .withColumn("product_name", F.coalesce(escape_name(F.col("__name")), F.col("product_name")))
           .withColumn("is_active", F.coalesce(F.col("__active"), F.col("is_active")))
           .withColumn("updated_at", F.when(F.col("__hit"), ts_lit(as_of)).otherwise(F.col("updated_at")))
           .drop("__name", "__active", "__hit"))
    return out, empty.select("id", F.lit("No fields to update").alias("error"))


def soft_delete(products: DataFrame, ids: DataFrame) -> DataFrame:
    """K3: mark products inactive (rows are kept); repeated ids count once."""
    d = ids.select("id").distinct().withColumn("__del", F.lit(True))
    return (products.join(d, "id", "left")
            .withColumn("is_active", F.when(F.col("__del"), F.lit(False)).otherwise(F.col("is_active")))
            .drop("__del"))


# --- K4 ---------------------------------------------------------------------------

def delete_accounts(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """K4: delete users' products and cascade to competitors, history,
    insights, alerts and tracking jobs; delete their settings and pending
    alerts.  Each cascade is a left anti join on the parent's removed keys
    (semi-joined key sets, never collected lists)."""
    u = users.select("user_id")
    out = dict(tables)
    gone_products = tables["products"].join(u, "user_id", "left_semi").select("id")
    out["products"] = tables["products"].join(u, "user_id", "left_anti")
    out["competitors"] = tables["competitors"].join(
        gone_products.withColumnRenamed("id", "product_id"), "product_id", "left_anti")
    gone_comp = tables["competitors"].join(out["competitors"].select("id"), "id", "left_anti").select("id")
    out["price_history"] = tables["price_history"].join(gone_comp.withColumnRenamed("id", "competitor_id"),
                                                        "competitor_id", "left_anti")
    out["insights"] = tables["insights"].join(gone_products.withColumnRenamed("id", "product_id"), "product_id", "left_anti")
    pa = tables["pending_alerts"].join(u, "user_id", "left_anti")
    pa = pa.join(gone_products.withColumnRenamed("id", "product_id"), "product_id", "left_anti")
    out["pending_alerts"] = pa.join(gone_comp.withColumnRenamed("id", "competitor_id"), "competitor_id", "left_anti")
    out["user_alert_settings"] = tables["user_alert_settings"].join(u, "user_id", "left_anti")
    if "tracking_jobs" in tables:
        out["tracking_jobs"] = tables["tracking_jobs"].join(
            gone_products.withColumnRenamed("id", "product_group_id"), "product_group_id", "left_anti")
    # the identity (users) and the digest history stay: only account data goes
    return out


# --- K7 / K8: currency acceptance ---------------------------------------------------

def accept_currency(competitors: DataFrame, pending: DataFrame, acceptances: DataFrame,
                    order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """K7: (competitor_id, currency) -> expected_currency updated and every
    currency_changed alert of that competitor dismissed (marked included).  Of
    several acceptances the last in the order of the column ``order`` counts."""
    a = _last_given(acceptances.withColumnsRenamed({"competitor_id": "id", "currency": "__cur"}), "id", ["__cur"], order)
    comps = (competitors.join(a, "id", "left")
             .withColumn("expected_currency", F.coalesce("__cur", "expected_currency")).drop("__cur"))
    hit = a.select(F.col("id").alias("competitor_id"), F.lit(True).alias("__acc"))
    pend = (pending.join(hit, "competitor_id", "left")
            .withColumn("included_in_digest",
                        F.col("included_in_digest") | (F.coalesce("__acc", F.lit(False)) & (F.col("alert_type") == "currency_changed")))
            .drop("__acc"))
    return comps, pend


def accept_all_currencies(competitors: DataFrame, pending: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K8: for the given users every unsent currency_changed alert with a new
    currency is accepted: the competitor takes the currency of its latest
    such alert (the sequential loop's last write) and the alerts are marked.
    Returns (competitors, pending, per-user updated_count)."""
    sel = (pending.join(users.select("user_id"), "user_id", "left_semi")
           .filter((F.col("alert_type") == "currency_changed") & ~F.col("included_in_digest")
                   & F.col("new_currency").isNotNull()))
    latest = sel.groupBy("competitor_id").agg(
        F.max_by("new_currency", F.struct("detected_at", "id")).alias("currency"))
    a = latest.select(F.col("competitor_id").alias("id"), F.col("currency").alias("__cur"))
    comps = (competitors.join(a, "id", "left")
             .withColumn("expected_currency", F.coalesce("__cur", "expected_currency")).drop("__cur"))
    marked = sel.select("id", F.lit(True).alias("__m"))
    pend = (pending.join(marked, "id", "left")
            .withColumn("included_in_digest", F.col("included_in_digest") | F.coalesce("__m", F.lit(False)))
            .drop("__m"))
    counts = (users.select("user_id").join(sel.groupBy("user_id").agg(F.count(F.lit(1)).alias("updated_count")),
                                           "user_id", "left").fillna(0, ["updated_count"]))
    return comps, pend, counts


# --- K9 -----------------------------------------------------------------------------

def upsert_settings(settings: DataFrame, patch: DataFrame, as_of, order: str | None = None) -> DataFrame:
    """K9: partial settings update; users without a row get the defaults
    (enabled, 24 h, both alert kinds) overlaid with the patch.  Several patches
    of a user apply in the order of the column ``order``."""
    fields = ["email_enabled", "digest_frequency_hours", "alert_price_drop", "alert_price_increase"]
    defaults = {"email_enabled": F.lit(True), "digest_frequency_hours": F.lit(C.DEFAULT_DIGEST_HOURS),
                "alert_price_drop": F.lit(True), "alert_price_increase": F.lit(True)}
    p = _last_given(patch, "user_id", fields, order)
    p = p.select("user_id", *[F.col(f).alias("p_" + f) for f in fields], F.lit(True).alias("__p"))
    j = settings.withColumn("__s", F.lit(True)).join(p, "user_id", "full")
    now = ts_lit(as_of)
    cols = [F.col("user_id")]
    for f in fields:
        cols.append(F.coalesce(F.col("p_" + f), F.col(f), defaults[f]).alias(f))
    cols += [F.col("last_digest_sent_at"),
             F.coalesce(F.col("created_at"), now).alias("created_at"),
             F.when(F.col("__p"), now).otherwise(F.col("updated_at")).alias("updated_at")]
    return j.select(*cols)


# --- K10 ----------------------------------------------------------------------------

def _row_rules() -> dict[str, list[tuple[str, Column]]]:
    """Per table the CHECK rules: (rule, condition that a row breaks)."""
    return {
        "price_history": [("price_history.scrape_status", ~F.col("scrape_status").isin("success", "failed"))],
        "insights": [("insights.insight_type", ~F.col("insight_type").isin(*C.INSIGHT_TYPES)),
                     ("insights.confidence_score", ~F.col("confidence_score").between(0, 1))],
        "pending_alerts": [("pending_alerts.alert_type", ~F.col("alert_type").isin(*C.ALERT_TYPES))],
        "alert_history": [("alert_history.email_status", ~F.col("email_status").isin("pending", "sent", "failed"))],
        "competitors": [("competitors.alert_threshold_percent", ~F.col("alert_threshold_percent").between(0, 100))],
        "tracking_jobs": [("tracking_jobs.status", ~F.col("status").isin(*C.JOB_STATUSES))],
    }


def _constraints(t: dict[str, DataFrame]) -> dict[str, dict]:
    """Per given table its rules on columns that it has: conditions on a row
    alone, parents by referring column, columns that may not repeat."""
    checks, out = _row_rules(), {}
    for table, c in CONSTRAINTS.items():
        if table not in t:
            continue
        has = set(t[table].columns)
        out[table] = {
            "row": [(f"{table}.{col}_not_null", F.col(col).isNull()) for col in c["not_null"] if col in has]
            + [r for r in checks.get(table, []) if r[0].split(".")[1] in has],
            "references": {col: parent for col, parent in c["references"].items() if col in has and parent in t},
            "unique": [col for col in c.get("unique", ()) if col in has]}
    return out


def constraint_violations(t: dict[str, DataFrame]) -> DataFrame:
    """(rule, key) of every row that breaks a NOT NULL, CHECK, foreign-key
    or UNIQUE rule of the schema; the key is the row's id as text (the user for
    settings).  One scan of each table checks all its rules, with the keys of
    all its parents joined to it; a rule counts where its table, column and
    parent are given."""
    parts = []
    for table, rules in _constraints(t).items():
        key = ROW_KEYS.get(table, "id")
        row, d = list(rules["row"]), t[table]
        for col, parent in rules["references"].items():
            keys = t[parent].select(F.col(ROW_KEYS.get(parent, "id")).alias(f"__{col}")).distinct()
            d = d.join(keys.withColumn(f"__has_{col}", F.lit(True)), F.col(col) == F.col(f"__{col}"), "left")
            row.append((f"{table}.{col}_fk", F.col(col).isNotNull() & F.col(f"__has_{col}").isNull()))
        broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in row]))
        parts.append(d.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key")))
        for col in rules["unique"]:
            parts.append(t[table].groupBy(col).count().filter((F.col("count") > 1) & F.col(col).isNotNull())
                         .select(F.lit(f"{table}.{col}_unique").alias("rule"), F.col(col).cast("string").alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def constraint_report(t: dict[str, DataFrame]) -> DataFrame:
    """Number of violations per rule, rules without any included."""
    names = [n for table, r in _constraints(t).items()
             for n in (*(name for name, _ in r["row"]), *(f"{table}.{c}_fk" for c in r["references"]),
                       *(f"{table}.{c}_unique" for c in r["unique"]))]
    found = constraint_violations(t)
    every = found.sparkSession.createDataFrame([(n,) for n in names], "rule string")
    return (every.join(found.groupBy("rule").agg(F.count(F.lit(1)).alias("n")), "rule", "left")
            .select("rule", F.coalesce("n", F.lit(0)).alias("violations")))


# --- A7 / A8 / A12 --------------------------------------------------------------------

def append_prices(results: DataFrame, as_of, zero_is_missing: bool = True) -> DataFrame:
    """Scrape results (competitor_id, price, currency, status, error) as
    price_history rows.  The scrape path stores a falsy price (null or 0) as
    NULL; the tracking path keeps 0 (``zero_is_missing=False``).  A price that
    the column cannot hold makes the row a failed one that says so."""
    price = F.col("price")
    if zero_is_missing:
        price = F.when(price != 0, price)
    wide = F.coalesce(F.abs(price) > C.MAX_PRICE, F.lit(False))
    price = F.when(~wide, price)
    return results.select(
        F.col("id"), "competitor_id", price.cast("decimal(10,2)").alias("price"),
        F.coalesce("currency", F.lit(C.DEFAULT_CURRENCY)).alias("currency"),
        F.coalesce(F.col("scraped_at"), ts_lit(as_of)).alias("scraped_at"),
        F.when(wide, F.lit("failed")).otherwise(F.col("status")).alias("scrape_status"),
        F.when(wide, F.lit(C.PRICE_TOO_LARGE)).otherwise(F.col("error")).alias("error_message"))


def write_history(df: DataFrame, path: str, run_id: str) -> None:
    """A7 sink: history partitioned by UTC scrape date (partition pruning for
    the day / window filters) and by the writing run.  Partitions are
    overwritten dynamically, so a rerun of the same run (after a failure)
    replaces exactly its own output and never duplicates rows; other runs'
    partitions of the same day are untouched."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        (df.withColumn("scrape_date", F.to_date("scraped_at")).withColumn("run", F.lit(run_id))
           .write.mode("overwrite").partitionBy("scrape_date", "run").parquet(path))
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def price_csv_rows(price_history: DataFrame, competitors: DataFrame) -> DataFrame:
    """The export table: Date, Time, Competitor, Price, Currency, Status,
    Error, newest first per product (the order column is kept for sorting)."""
    from ..functions.url import retailer_or_domain
    c = competitors.select(F.col("id").alias("competitor_id"), "product_id",
                           retailer_or_domain(F.col("retailer_name"), F.col("url"), "export").alias("Competitor"))
    j = price_history.join(c, "competitor_id")
    return j.select(
        "product_id", F.col("scraped_at").alias("__ts"), F.col("id").alias("__id"),
        F.date_format("scraped_at", "yyyy-MM-dd").alias("Date"), F.date_format("scraped_at", "HH:mm:ss").alias("Time"),
        "Competitor", F.regexp_replace(F.col("price").cast("string"), "0$", "").alias("Price"),
        F.col("currency").alias("Currency"), F.col("scrape_status").alias("Status"),
        F.col("error_message").alias("Error"))


_CSV = {"escape": '"', "emptyValue": ""}
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _store(path: str):
    """The file system of a folder's address, and its path there.  A path
    without a scheme is a mounted folder that driver and executors share."""
    path = re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _folder(name: str, value) -> str:
    """A partition's folder, named and escaped as Spark does."""
    text = "" if value is None else str(value)
    return f"{name}=" + (re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", text) or _NO_VALUE)


def _write_csv_files(path: str, header: str):
    """A file for each run of rows (product_id, month, line) of one product and
    month.  It is written under a hidden name, so that a task that is lost or
    runs twice leaves no part of a file, and its last name is the same for
    every attempt."""
    def run(batches):
        fs, base = _store(path)
        name = f"part-{TaskContext.get().partitionId():05d}.csv"
        key = out = at = hidden = None
        n = 0

        def close():
            out.close()
            if fs.get_file_info(f"{at}/{name}").type == pafs.FileType.NotFound:
                fs.move(hidden, f"{at}/{name}")
            else:                              # another attempt's: the same rows
                fs.delete_file(hidden)

        for b in batches:
            ids, months = b.column("product_id"), b.column("month")
            first = _starts(ids, months)
            for s, e in zip(first, [*first[1:], b.num_rows]):
                own = ids[s].as_py(), months[s].as_py()
                if own != key:
                    if out is not None:
                        close()
                    key, n = own, n + 1
                    at = f"{base}/{_folder('product_id', own[0])}/{_folder('month', own[1])}"
                    hidden = f"{at}/.{name}-{uuid.uuid4().hex}"
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(hidden, compression=None)
                    out.write(header.encode())
                out.write("".join(f"{line}\n" for line in b.column("line").slice(s, e - s).to_pylist()).encode())
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])
    return run


def _starts(*columns: pa.Array) -> list[int]:
    """Where rows begin whose values differ from those of the row before."""
    new = np.arange(len(columns[0])) == 0
    for c in columns:
        number = c.dictionary_encode("encode").indices.to_numpy()
        new[1:] |= number[1:] != number[:-1]
    return np.flatnonzero(new).tolist()


def write_price_csv(rows: DataFrame, path: str) -> None:
    """A8 sink: a folder per product and month, so that no task holds a whole
    product; a header, newest first; empty strings stay quoted-empty and nulls
    are empty cells.  Spark makes the lines; the tasks write them through Arrow's
    file systems, as a file is too small to bear the cost of Spark's own writer
    (at local paths, a process for each folder and file) and of a commit that
    moves files one after the other.  ``_SUCCESS`` marks a whole export."""
    ship_package(rows.sparkSession)
    cells = [c for c in rows.columns if c not in ("product_id", "__ts", "__id")]
    # an empty name's folder is that of no value
    named = {"product_id": F.col("product_id"), "month": F.substring("Date", 1, 7)}
    named = {c: F.when(x.cast("string") != "", x) for c, x in named.items()}
    lines = (rows.withColumns(named).repartition("product_id", "month")
             .sortWithinPartitions("product_id", "month", F.col("__ts").desc(), F.col("__id").desc())
             .select("product_id", "month", F.to_csv(F.struct(*cells), _CSV).alias("line")))
    fs, base = _store(path)
    if fs.get_file_info(base).type != pafs.FileType.NotFound:
        fs.delete_dir(base)
    fs.create_dir(base, recursive=True)
    try:
        lines.mapInArrow(_write_csv_files(path, ",".join(cells) + "\n"), "files bigint").agg(F.sum("files")).first()
    except BaseException:
        fs.delete_dir(base)
        raise
    with fs.open_output_stream(f"{base}/_SUCCESS", compression=None):
        pass


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """The exported files as one table.  Folders are listed by as many tasks as
    a shuffle has, not by one each."""
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    prev = spark.conf.get(tasks)
    spark.conf.set(tasks, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        return spark.read.option("header", True).option("escape", '"').schema(
            "Date string, Time string, Competitor string, Price string, Currency string, Status string, Error string, "
            "product_id bigint, month string").csv(path)
    finally:
        spark.conf.set(tasks, prev)


def product_documents(products: DataFrame, competitors: DataFrame) -> DataFrame:
    """One nested JSON document per product (product + competitors[])."""
    from .dashboard import product_competitors
    pc = product_competitors(products, competitors)
    return pc.select("id", F.to_json(F.struct("id", "user_id", "product_name", "is_active", "created_at",
                                              "competitors")).alias("document"))


def chart_documents(products: DataFrame, competitors: DataFrame, price_history: DataFrame, as_of,
                    days: int = C.DEFAULT_HISTORY_DAYS, size: int = C.CHUNK_ITEMS) -> DataFrame:
    """The chart document of every product as JSON parts of bounded size:
    one ``product`` part (name, date range, number of points and competitors),
    a ``competitor`` part each (name, url, statistics) and a ``points`` part
    for each competitor, day and chunk (``series_points``).  (product_id, part,
    competitor_id, day, chunk, document); in this order the parts make up the
    whole document."""
    from ..functions.url import retailer_or_domain
    from .history import competitor_stats, product_range, series_points
    none = [F.lit(None).cast("date").alias("day"), F.lit(None).cast("bigint").alias("chunk")]
    key = competitors.schema["id"].dataType
    rng = product_range(price_history, competitors, as_of, days)
    n = competitors.groupBy("product_id").agg(F.count(F.lit(1)).alias("competitor_count"))
    p = (products.select(F.col("id").alias("product_id"), "product_name").join(rng, "product_id", "left")
         .join(n, "product_id", "left").fillna(0, ["total_data_points", "competitor_count"]))
    head = p.select("product_id", F.lit("product").alias("part"), F.lit(None).cast(key).alias("competitor_id"), *none,
                    F.to_json(F.struct("product_id", "product_name", "date_range_start", "date_range_end",
                                       "total_data_points", "competitor_count")).alias("document"))
    stats = competitor_stats(competitors, price_history, as_of, days)
    comp = stats.select("product_id", F.lit("competitor").alias("part"), "competitor_id", *none, F.to_json(F.struct(
        "competitor_id", retailer_or_domain(F.col("retailer_name"), F.col("url")).alias("competitor_name"), "url",
        "average_price", "min_price", "max_price", "current_price", "price_change_percent")).alias("document"))
    owner = competitors.select(F.col("id").alias("competitor_id"), "product_id")
    points = series_points(price_history, as_of, days, size).join(owner, "competitor_id")
    pts = points.select("product_id", F.lit("points").alias("part"), "competitor_id", "day", "chunk",
                        F.to_json(F.struct("data_points")).alias("document"))
    return head.unionByName(comp).unionByName(pts)
