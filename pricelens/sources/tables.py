"""Sources: application tables (A1) and the model tables built over the test
parquet (see FIXTURES.md §2).

``load_table`` reads a stored application table with its fixed schema (column
pruning and filters are pushed into the parquet scan by Catalyst).
``ModelTables`` maps the generic test tables onto the application's schema so
every operator runs on data whose volume grows with the scale factor.  The
mapping only renames / recasts columns; it does none of an operator's work.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import table_schemas

AS_OF = "2024-01-31 00:00:00"          # fixed evaluation time of the model tables
INCLUDED_BEFORE = "2024-01-15 00:00:00"


def load_table(spark: SparkSession, path: str, table: str, key=T.StringType()) -> DataFrame:
    """A1: scan a stored table with its fixed schema (no inference)."""
    return spark.read.schema(table_schemas(key)[table]).parquet(path)


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(s: str):
    return F.lit(s).cast("timestamp_ntz")


class ModelTables:
    """Lazily built model tables over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_raw(self.spark, self.sf_dir, name)

    @cached_property
    def users(self) -> DataFrame:
        """User 0 and one user per four suppliers: grows with the scale factor."""
        s = self.raw("supplier").select(F.col("s_suppkey").cast("bigint").alias("k"))
        ids = (s.filter(F.col("k") == 0).select(F.col("k").alias("user_id"))
               .unionByName(s.filter(F.col("k") % 4 == 0).select((F.col("k") / 4 + 1).cast("bigint").alias("user_id"))))
        return ids.select("user_id", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com"))
                          .alias("email"))

    @cached_property
    def products(self) -> DataFrame:
        """One tracked product (group) per supplier: grows with the scale factor."""
        sp = self.raw("supplier")
        created = _ntz("2023-12-01 00:00:00") + F.make_dt_interval(F.lit(0), F.col("s_suppkey") % 720)
        # user 0 is hot: a third of all products
        k = F.col("s_suppkey").cast("bigint")
        owner = F.when(k % 3 == 0, F.lit(0).cast("bigint")).otherwise((k - k % 4) / 4 + 1).cast("bigint")
        return sp.select(F.col("s_suppkey").cast("bigint").alias("id"),
                         owner.alias("user_id"),
                         F.col("s_name").alias("product_name"),
                         (F.col("s_suppkey") % 5 != 0).alias("is_active"),
                         created.alias("created_at"), created.alias("updated_at"))

    @cached_property
    def competitors(self) -> DataFrame:
        """Customers as tracked URLs, spread over the products round-robin
        (product = custkey modulo the number of products)."""
        c = self.raw("customer")
        # the number of products as a scalar subquery (no join)
        n = self.raw("supplier").agg(F.count(F.lit(1))).scalar()
        return c.select(
            F.col("c_custkey").cast("bigint").alias("id"),
            (F.col("c_custkey") % n).cast("bigint").alias("product_id"),
            F.concat(F.lit("https://www."), F.lower("c_mktsegment"), F.lit(".example.com/p/"),
                     F.col("c_custkey").cast("string")).alias("url"),
            F.when(F.col("c_custkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("retailer_name"),
            (F.lit(5) * (F.lit(1) + F.col("c_custkey") % 4)).cast("decimal(5,2)").alias("alert_threshold_percent"),
            F.lit("USD").alias("expected_currency"),
            (_ntz("2023-12-15 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("c_custkey") % 1000))
            .alias("created_at"))

    @cached_property
    def price_history(self) -> DataFrame:
        e = self.raw("events")
        failed = F.col("event_type") == "error"
        k = F.get_json_object("props", "$.k").cast("bigint")
        return e.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("competitor_id"),
            F.when(~failed, F.col("value").cast("decimal(10,2)")).alias("price"),
            F.when(k % 25 == 0, F.lit("EUR")).otherwise(F.lit("USD")).alias("currency"),
            F.col("ts").cast("timestamp_ntz").alias("scraped_at"),
            F.when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("scrape_status"),
            F.when(failed, F.lit("timeout")).alias("error_message"))

    @cached_property
    def user_alert_settings(self) -> DataFrame:
        """Four users in five have settings; frequencies, switches and last
        digests (never, ten hours ago, three days ago) vary by the user's id."""
        k = F.col("user_id")
        return self.users.filter(k % 5 != 4).select(
            "user_id",
            (k % 7 != 3).alias("email_enabled"),
            F.when(k % 10 == 3, 24).when(k % 5 == 0, 6).when(k % 5 == 1, 1).when(k % 5 == 2, 8).otherwise(48).cast("int")
             .alias("digest_frequency_hours"),
            (k % 6 != 1).alias("alert_price_drop"),
            (k % 6 != 2).alias("alert_price_increase"),
            F.when(k % 3 == 1, _ntz("2024-01-30 14:00:00")).when(k % 3 == 2, _ntz("2024-01-28 00:00:00"))
             .alias("last_digest_sent_at"),
            _ntz("2023-12-01 00:00:00").alias("created_at"),
            _ntz("2023-12-01 00:00:00").alias("updated_at"))

    @cached_property
    def detections(self) -> DataFrame:
        from ..operators.alerts import detect_changes
        return detect_changes(self.price_history, self.competitors, self.products)

    @cached_property
    def pending_alerts(self) -> DataFrame:
        d = self.detections.filter(F.col("alert_type").isNotNull())
        return d.select("id", "user_id", "product_id", "competitor_id", "alert_type", "old_price", "new_price",
                        "price_change_percent", "threshold_percent", "old_currency", "new_currency",
                        (F.col("detected_at") < _ntz(INCLUDED_BEFORE)).alias("included_in_digest"),
                        "detected_at")

    @cached_property
    def alert_history(self) -> DataFrame:
        p = self.pending_alerts.withColumn("__d", F.to_date("detected_at"))
        g = p.groupBy("user_id", "__d").agg(F.count(F.lit(1)).cast("int").alias("alerts_count"))
        failed = F.dayofmonth("__d") % 7 == 0
        return g.select(
            (F.col("user_id") * 1000 + F.dayofyear("__d")).alias("id"), "user_id",
            (F.col("__d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))).alias("digest_sent_at"),
            "alerts_count",
            F.when(failed, F.lit("failed")).otherwise(F.lit("sent")).alias("email_status"),
            F.when(failed, F.lit("smtp error")).alias("error_message"))

    @cached_property
    def insights(self) -> DataFrame:
        kinds = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(t).alias("t"), F.lit(c).cast("decimal(3,2)").alias("c"))
                          for i, t, c in ((0, "pattern", "0.50"), (1, "alert", "0.75"), (2, "recommendation", "1.00"))])
        p = self.products.select("id", "product_name", F.explode(kinds).alias("x"))
        return p.select(
            (F.col("id") * 10 + F.col("x.k")).alias("id"), F.col("id").alias("product_id"),
            F.concat(F.col("x.t"), F.lit(" insight for "), F.col("product_name")).alias("insight_text"),
            F.col("x.t").alias("insight_type"), F.col("x.c").alias("confidence_score"),
            (_ntz(AS_OF) - F.make_dt_interval(F.lit(0), F.col("id") % 48)).alias("generated_at"))

    @cached_property
    def catalog(self) -> DataFrame:
        """Flat product rows from ``part`` (the payload builders wrap these)."""
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("pid"), F.col("p_name").alias("name"),
            F.col("p_retailprice").alias("price"), F.col("p_type").alias("product_type"),
            F.col("p_brand").alias("sku"), (F.col("p_size") % 7 != 0).alias("in_stock"),
            F.split(F.col("p_type"), " ").alias("tags"), F.col("p_size").alias("size"))

    @cached_property
    def bench_history(self) -> DataFrame:
        """Large aggregate-only history from ``lineitem``."""
        li = self.raw("lineitem")
        # unit price in exact integer cents, rounded half-up
        unit_cents = F.expr("(2 * cast(round(l_extendedprice * 100) as bigint) + cast(l_quantity as bigint)) "
                            "div (2 * cast(l_quantity as bigint))")
        return li.filter(F.col("l_quantity") > 0).select(
            F.col("l_suppkey").alias("competitor_id"),
            (unit_cents.cast("decimal(12,0)") / 100).cast("decimal(10,2)").alias("price"),
            F.col("l_shipdate").cast("timestamp_ntz").alias("scraped_at"),
            F.col("l_orderkey"), F.col("l_linenumber"))


def model_price_history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model price history as a stream over the events file(s)."""
    from ..streaming.jobs import price_stream
    raw = price_stream(spark, sf_dir, read_raw(spark, sf_dir, "events").schema, glob="events*.parquet")
    failed = F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k").cast("bigint")
    return raw.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("competitor_id"),
        F.when(~failed, F.col("value").cast("decimal(10,2)")).alias("price"),
        F.when(k % 25 == 0, F.lit("EUR")).otherwise(F.lit("USD")).alias("currency"),
        F.col("ts").cast("timestamp_ntz").alias("scraped_at"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("scrape_status"),
        F.when(failed, F.lit("timeout")).alias("error_message"))
