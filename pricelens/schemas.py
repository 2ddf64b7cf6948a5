"""Spark schemas of the application tables (A1).

Keys are typed by ``key``: the application uses UUID strings, the model tables
built from the test parquet use integers; every operator is agnostic to it.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
PERCENT = T.DecimalType(5, 2)
WIDE_PERCENT = T.DecimalType(12, 2)   # DECIMAL(5,2) overflows above 999.99 %
CONFIDENCE = T.DecimalType(3, 2)
CATALOG_PRICE = T.DecimalType(18, 4)
TS = T.TimestampNTZType()             # UTC wall clock


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


def table_schemas(key: T.DataType = T.StringType()) -> dict[str, T.StructType]:
    S = T.StringType()
    return {
        "users": T.StructType([_f("user_id", key, False), _f("email", S)]),
        "products": T.StructType([
            _f("id", key, False), _f("user_id", key), _f("product_name", S),
            _f("is_active", T.BooleanType()), _f("created_at", TS), _f("updated_at", TS)]),
        "competitors": T.StructType([
            _f("id", key, False), _f("product_id", key), _f("url", S), _f("retailer_name", S),
            _f("alert_threshold_percent", PERCENT), _f("expected_currency", S), _f("created_at", TS)]),
        "price_history": T.StructType([
            _f("id", key, False), _f("competitor_id", key), _f("price", MONEY), _f("currency", S),
            _f("scraped_at", TS), _f("scrape_status", S), _f("error_message", S)]),
        "insights": T.StructType([
            _f("id", key, False), _f("product_id", key), _f("insight_text", S), _f("insight_type", S),
            _f("confidence_score", CONFIDENCE), _f("generated_at", TS)]),
        "tracking_jobs": T.StructType([
            _f("id", key, False), _f("user_id", key), _f("product_group_id", key),
            _f("total_items", T.IntegerType()), _f("completed_items", T.IntegerType()),
            _f("failed_items", T.IntegerType()), _f("status", S), _f("created_at", TS), _f("updated_at", TS)]),
        "pending_alerts": T.StructType([
            _f("id", key, False), _f("user_id", key), _f("product_id", key), _f("competitor_id", key),
            _f("alert_type", S), _f("old_price", MONEY), _f("new_price", MONEY),
            _f("price_change_percent", WIDE_PERCENT), _f("threshold_percent", PERCENT),
            _f("old_currency", S), _f("new_currency", S), _f("included_in_digest", T.BooleanType()),
            _f("detected_at", TS)]),
        "user_alert_settings": T.StructType([
            _f("user_id", key, False), _f("email_enabled", T.BooleanType()),
            _f("digest_frequency_hours", T.IntegerType()), _f("alert_price_drop", T.BooleanType()),
            _f("alert_price_increase", T.BooleanType()), _f("last_digest_sent_at", TS),
            _f("created_at", TS), _f("updated_at", TS)]),
        "alert_history": T.StructType([
            _f("id", key, False), _f("user_id", key), _f("digest_sent_at", TS),
            _f("alerts_count", T.IntegerType()), _f("email_status", S), _f("error_message", S)]),
        # the alerts of a history row, one row each: a digest's list has no bound
        "alert_history_ids": T.StructType([_f("user_id", key), _f("digest_sent_at", TS), _f("alert_id", key)]),
    }


# What the application's schema demands of each table beyond its column types:
# columns that may not be null, columns that refer to a parent's key, columns
# that may not repeat.  (CHECK rules are in ``operators.maintenance``.)
CONSTRAINTS = {
    "products": {"not_null": ("user_id", "product_name"), "references": {"user_id": "users"}},
    "competitors": {"not_null": ("product_id", "url"), "references": {"product_id": "products"}},
    "price_history": {"not_null": ("competitor_id", "scrape_status"), "references": {"competitor_id": "competitors"}},
    "insights": {"not_null": ("product_id", "insight_text", "insight_type", "confidence_score"),
                 "references": {"product_id": "products"}},
    "tracking_jobs": {"not_null": ("user_id", "total_items"),
                      "references": {"user_id": "users", "product_group_id": "products"}},
    "pending_alerts": {"not_null": ("user_id", "product_id", "competitor_id", "alert_type"),
                       "references": {"user_id": "users", "product_id": "products", "competitor_id": "competitors"}},
    "user_alert_settings": {"not_null": ("user_id",), "references": {"user_id": "users"}, "unique": ("user_id",)},
    "alert_history": {"not_null": ("user_id", "alerts_count"), "references": {"user_id": "users"}},
}
# the column that names a row (and that others refer to), where it is not ``id``
ROW_KEYS = {"users": "user_id", "user_alert_settings": "user_id"}


# unified catalog row (DiscoveredProduct)
CATALOG_ROW = T.StructType([
    _f("store", T.StringType()), _f("source_rank", T.IntegerType()),
    _f("page", T.LongType()), _f("ordinal", T.LongType()),
    _f("name", T.StringType()), _f("price", CATALOG_PRICE), _f("currency", T.StringType()),
    _f("image_url", T.StringType()), _f("product_url", T.StringType()), _f("platform", T.StringType()),
    _f("variant_id", T.StringType()), _f("sku", T.StringType()), _f("in_stock", T.BooleanType()),
    _f("product_type", T.StringType()), _f("tags", T.ArrayType(T.StringType())),
    _f("description", T.StringType()),
])
