"""Scale-motivated properties: the skew-safe lag equals the plain window on
any data (ties included) and on a history where one key holds a third of all
rows; history writes are idempotent per run."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelens.operators.maintenance import write_history
from pricelens.operators.series import lag_within_buckets

T0 = datetime(2024, 1, 1)


def _plain(df):
    w = Window.partitionBy("k").orderBy("ts", "id")
    return df.withColumn("prev_v", F.lag("v").over(w))


def _rows(df):
    return sorted(tuple(r) for r in df.select("id", "prev_v").collect())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 200), st.integers(-50, 50)), min_size=1, max_size=60))
def test_bucketed_lag_equals_plain(spark, rows):
    data = [(i, k, T0 + timedelta(hours=h), v) for i, (k, h, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k long, ts timestamp_ntz, v long")
    got = lag_within_buckets(df, "k", ["ts", "id"], ["v"], prefix="prev_")
    assert _rows(got) == _rows(_plain(df))


def test_hot_key_history(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    # one supplier receives a third of all rows
    base = li.select(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_shipdate"),
                     F.col("l_quantity"))
    df = base.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
                     F.when(F.col("l_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_suppkey")).alias("k"),
                     F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
                     F.col("l_quantity").cast("long").alias("v")).dropDuplicates(["id"])
    hot = df.filter("k = 0").count() / df.count()
    assert hot > 0.3
    got = lag_within_buckets(df, "k", ["ts", "id"], ["v"], prefix="prev_")
    assert _rows(got) == _rows(_plain(df))
    # the hot key is spread over many (key, day) window partitions
    assert df.filter("k = 0").select(F.to_date("ts")).distinct().count() > 100


def test_history_write_is_idempotent(spark, model, tmp_path):
    out = str(tmp_path / "history")
    day = model.price_history.filter(F.to_date("scraped_at") == F.lit("2024-01-05").cast("date"))
    n = day.count()
    write_history(day, out, "daily")
    write_history(day, out, "daily")          # rerun after a failure
    write_history(day.limit(3), out, "manual")
    back = spark.read.parquet(out)
    assert back.filter("run = 'daily'").count() == n
    assert back.count() == n + 3


def test_hot_key_spread_over_partitions(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    df = li.select(F.when(F.col("l_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_suppkey")).alias("k"),
                   F.to_date("l_shipdate").alias("day"))
    n = df.count()

    def largest_share(*cols):
        sizes = (df.repartition(64, *cols).groupBy(F.spark_partition_id().alias("p")).count()
                 .agg(F.max("count")).first()[0])
        return sizes / n

    by_key = largest_share("k")               # the plain window's partitioning
    by_key_day = largest_share("k", "day")    # lag_within_buckets' partitioning
    assert by_key > 0.3
    assert by_key_day < 0.05
