"""Skew-safe "previous row" for long per-key series.

A plain ``lag(...).over(partitionBy(key).orderBy(t))`` sends every row of a
key to one task.  When one competitor holds a large share of the history that
task becomes the straggler.  ``lag_within_buckets`` partitions the window by
``(key, time bucket)`` instead and repairs the first row of every bucket with
the last row of the nearest earlier non-empty bucket.  Those last rows are
flagged by the same window (``lead`` is null), giving a summary of one row
per (key, bucket) - small even for hot keys - that reuses the one exchange of
the input.  The result is identical to the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(ts: Column, unit: str = "day") -> Column:
    return F.date_trunc(unit, ts)


def lag_within_buckets(df: DataFrame, key: str, order: list[str], values: list[str],
                       prefix: str = "prev_", bucket_unit: str = "day",
                       ts_col: str | None = None) -> DataFrame:
    """Add ``prefix + v`` = value of the previous row of the same key for each v.

    ``order`` is the total order inside a key (first column is the timestamp
    used for bucketing unless ``ts_col`` names another one); ties must be
    broken by the caller by including a unique column.
    """
    ts_col = ts_col or order[0]
    b = "__bucket"
    d = df.withColumn(b, time_bucket(F.col(ts_col), bucket_unit))
    w = Window.partitionBy(key, b).orderBy(*order)
    for v in values:
        d = d.withColumn(prefix + v, F.lag(v).over(w))
    d = (d.withColumn("__first_in_bucket", F.row_number().over(w) == 1)
          .withColumn("__last_in_bucket", F.lead(F.lit(1)).over(w).isNull()))

    # one row per (key, bucket): the bucket's last row, flagged by the same
    # window - no second scan and no sort-based aggregate; both branches
    # share the (key, bucket) exchange of the history
    last = d.filter(F.col("__last_in_bucket")).select(key, b, F.struct(*[F.col(v) for v in values]).alias("__last"))
    # carry the previous bucket's last row forward: one row per bucket, so the
    # per-key window here is over bucket count, not row count
    wb = Window.partitionBy(key).orderBy(b)
    carry = last.select(key, b, F.lag("__last").over(wb).alias("__carry"))
    out = d.join(carry, [key, b], "left")
    for v in values:
        out = out.withColumn(
            prefix + v,
            F.when(F.col("__first_in_bucket"), F.col("__carry").getField(v)).otherwise(F.col(prefix + v)))
    return out.drop(b, "__first_in_bucket", "__last_in_bucket", "__carry")


def rank_by_buckets(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], pos: str,
                    descending: bool = False) -> DataFrame:
    """Position of every row in its key's list without a window over all rows
    of a key: a position inside the row's bucket, plus the rows in the buckets
    before, summed over the buckets' counts (one row per key and bucket)."""
    b = "__bucket"
    d = df.withColumn(b, bucket)
    counts = d.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    by_bucket = F.col(b).desc() if descending else F.col(b)
    before = counts.select(*keys, b, F.coalesce(F.sum("__n").over(
        Window.partitionBy(*keys).orderBy(by_bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    here = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order))
    return (d.withColumn("__here", here).join(before, [*keys, b])
            .withColumn(pos, F.col("__before") + F.col("__here")).drop(b, "__here", "__before"))


def rank_within_buckets(df: DataFrame, key: str, ts_col: str, order: list[Column], pos: str,
                        descending: bool = True, bucket_unit: str = "hour") -> DataFrame:
    """``rank_by_buckets`` by time, newest (or oldest) first."""
    return rank_by_buckets(df, [key], time_bucket(F.col(ts_col), bucket_unit), order, pos, descending)


def collect_chunks(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], item: Column, name: str,
                   size: int) -> DataFrame:
    """(keys, chunk, ``name``): each key's ordered list in numbered arrays of at
    most ``size`` items, whatever the list's length."""
    ranked = rank_by_buckets(df, keys, bucket, order, "__pos")
    at = F.col("__pos") - 1
    return (ranked.groupBy(*keys, (at / size).cast("bigint").alias("chunk"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("__pos").alias("pos"), item.alias("item")))).alias("__list"))
            .select(*keys, "chunk", F.transform("__list", lambda x: x["item"]).alias(name)))
