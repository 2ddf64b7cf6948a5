"""Streams equal their batch twins."""

import random
import uuid
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricelens.operators.alerts import detect_changes
from pricelens.sources.tables import model_price_history_stream
from pricelens.streaming import alert_stream
from pricelens.streaming import jobs as S
from pricelens.streaming.alert_stream import last_revision, run_alerts
from pricelens.streaming.commits import Attempt, CommittedTables, commit_tables

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_stream_alerts_equal_batch(spark, model, tmp_path):
    tables = run_alerts(model_price_history_stream(spark, SF), model.competitors, model.products, str(tmp_path))
    cols = ["id", "alert_type", "old_price", "price_change_percent"]
    assert _rows(last_revision(tables.read("alerts")), cols) == _rows(model.detections, cols)


def test_daily_window_equal_batch(spark, model, tmp_path):
    s = S.daily_price_window_stream(model_price_history_stream(spark, SF))
    got, _ = S.run_windows(s, ["window_start", "competitor_id"], str(tmp_path))
    cols = ["competitor_id", "n", "min_price", "max_price"]
    assert _rows(got, cols) == _rows(S.daily_price_window(model.price_history), cols)


def test_daily_dedup_one_per_day(spark, model):
    s = S.daily_dedup_stream(model_price_history_stream(spark, SF))
    got = S.run_to_table(s.select("competitor_id", "day", "id"), f"t_l1_{uuid.uuid4().hex[:6]}")
    batch = S.daily_dedup(model.price_history)
    assert got.count() == batch.count()
    assert got.groupBy("competitor_id", "day").count().filter("count > 1").count() == 0


def test_idempotent_sink_replay(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    w = S.idempotent_sink(str(tmp_path / "out"))
    w(df, 0)
    w(df, 0)   # replay of the same batch
    w(df.limit(2), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_late_data_is_counted(spark):
    import __spark_entry__ as E
    rows = E.queries()["L5_late_data"](spark, SF).collect()
    assert sum(r.late for r in rows if r.batch == 0) == 0
    assert sum(r.late for r in rows if r.batch >= 2) > 0


HISTORY = "id {0}, competitor_id {0}, price decimal(10,2), currency string, scraped_at timestamp_ntz, scrape_status string"
BASE = datetime(2024, 1, 1)


def _dimensions(spark, competitors, key="bigint"):
    comp = spark.createDataFrame([(c, 1, Decimal(5)) for c in competitors],
                                 f"id {key}, product_id int, alert_threshold_percent decimal(5,2)")
    return comp, spark.createDataFrame([(1, 7)], "id int, user_id int")


def _feed(spark, tmp_path, arrivals, key="bigint", **options):
    """Each list of (id, key, price, second) as one arriving file; the tables."""
    schema = HISTORY.format(key)
    path = str(tmp_path / "in")
    frames = [spark.createDataFrame([(i, c, Decimal(p), "USD", BASE + timedelta(seconds=s), "success")
                                     for i, c, p, s in rows], schema) for rows in arrivals]
    comp, prod = _dimensions(spark, {r[1] for rows in arrivals for r in rows}, key)
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
        tables = run_alerts(spark.readStream.schema(schema).parquet(path), comp, prod, str(tmp_path / "out"), **options)
    return tables


def _answers(tables):
    return {r.id: (None if r.old_price is None else float(r.old_price), r.alert_type)
            for r in last_revision(tables.read("alerts")).collect()}


@pytest.mark.parametrize("key,ids", [("bigint", (1, 2, 3, 4)), ("string", ("a", "b", "c", "d"))])
def test_late_observation_takes_its_place(spark, tmp_path, key, ids):
    """Prices 100, 50, then a late 98 between them, then 50."""
    c = ids[0]
    got = _answers(_feed(spark, tmp_path, [[(ids[0], c, "100", 0), (ids[1], c, "50", 100)], [(ids[2], c, "98", 50)],
                                           [(ids[3], c, "50", 200)]], key))
    assert got == {ids[0]: (None, None), ids[2]: (100.0, None), ids[1]: (98.0, "price_drop"), ids[3]: (50.0, None)}


def test_late_observation_finds_its_predecessor_days_ago(spark, tmp_path):
    """The late row is the only one of its day: its predecessor is days before,
    the row that it gets behind it days after."""
    day = 86400
    got = _answers(_feed(spark, tmp_path, [[(1, 1, "100", 0), (2, 1, "50", 100 * day), (3, 1, "60", 101 * day)],
                                           [(4, 1, "10", 10 * day), (5, 2, "7", 5 * day)]]))
    assert got == {1: (None, None), 4: (100.0, "price_drop"), 2: (10.0, "price_increase"), 3: (50.0, "price_increase"),
                   5: (None, None)}


def _batch_answers(spark, rows, comp, prod, key="bigint"):
    h = spark.createDataFrame([(i, c, Decimal(p), "USD", BASE + timedelta(seconds=s), "success") for i, c, p, s in rows],
                              HISTORY.format(key))
    return {r.id: (None if r.old_price is None else float(r.old_price), r.alert_type)
            for r in detect_changes(h, comp, prod).collect()}


@pytest.mark.parametrize("compact_every", [50, 2])
def test_hot_competitor_and_rows_of_any_age_equal_the_batch(spark, tmp_path, compact_every):
    """A competitor with a third of all rows; rows arrive in any order, one of
    them 90 days late, another before all others."""
    rnd = random.Random(4)
    rows = [(i, 0 if i % 3 == 0 else rnd.randint(1, 40), str(rnd.randint(1, 30)), rnd.randint(2, 95 * 24) * 3600)
            for i in range(900)]
    rows = list({(r[1], r[3]): r for r in rows}.values())
    newest = max(r[3] for r in rows)
    late = [(5000, 0, "11", newest - 90 * 86400 + 7), (5001, 0, "12", 1), (5002, 3, "13", 1)]
    by_time = sorted(rows, key=lambda r: r[3])
    mixed = by_time[400:]
    rnd.shuffle(mixed)
    arrivals = [by_time[:300], by_time[300:400], mixed[:150], mixed[150:], late]
    tables = _feed(spark, tmp_path, arrivals, compact_every=compact_every)
    comp, prod = _dimensions(spark, {r[1] for r in rows})
    assert _answers(tables) == _batch_answers(spark, rows + late, comp, prod)
    assert tables.read("history").count() == len(rows) + len(late)


def test_hot_competitor_is_spread_over_its_buckets(spark):
    """The windows of a batch are keyed by competitor and bucket: a competitor
    with all rows is dealt over many tasks."""
    h = spark.range(4000).select(
        "id", (F.col("id") >= 0).cast("bigint").alias("competitor_id"), F.lit(5).cast("decimal(10,2)").alias("price"),
        F.lit("USD").alias("currency"), F.timestamp_seconds(F.col("id") * 3600).alias("scraped_at"),
        F.lit(None).cast("struct<price:decimal(10,2),currency:string>").alias("tail"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = alert_stream._on_time(h, "day").select(F.spark_partition_id().alias("p"), "id").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2000


def test_a_batch_that_dies_between_two_tables_is_not_seen(spark, tmp_path, monkeypatch):
    first = [(1, 1, "100", 0), (2, 1, "50", 100)]
    tables = _feed(spark, tmp_path, [first])
    more = [(3, 1, "40", 50), (4, 1, "30", 300)]
    write = Attempt.write

    def dies(self, table, rows, **more):
        if table == "alerts":
            raise RuntimeError("lost")
        return write(self, table, rows, **more)

    monkeypatch.setattr(Attempt, "write", dies)
    with pytest.raises(Exception):
        _feed(spark, tmp_path, [more])
    # the history folder of the dead attempt is there, and nobody reads it
    assert len(list((tmp_path / "out" / "history" / "batch=1").iterdir())) == 1
    assert {r.id for r in tables.read("history").collect()} == {1, 2} and set(_answers(tables)) == {1, 2}
    monkeypatch.undo()
    comp, prod = _dimensions(spark, {1})
    schema = HISTORY.format("bigint")
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    tables = run_alerts(source(), comp, prod, str(tmp_path / "out"))
    assert sorted(r.id for r in tables.read("history").collect()) == [1, 2, 3, 4]
    want = _batch_answers(spark, first + more, comp, prod)
    assert _answers(tables) == want and tables.read("alerts").count() == 5      # row 2 came out again
    # the same batches once more, as after a lost checkpoint: nothing doubles
    run_alerts(source(), comp, prod, str(tmp_path / "out"))
    assert tables.read("history").count() == 4 and _answers(tables) == want


def test_committed_tables(spark, tmp_path):
    tables = CommittedTables(spark, str(tmp_path / "root"))
    assert tables.read("a") is None and tables.latest("a", ["k"]) is None and not tables.committed(0)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v int")
    for number, parts in enumerate([{"a": rows((1, 1), (2, 1)), "b": rows((9, 9))}, {"a": rows((2, 2))}]):
        commit_tables(tables, lambda _: parts)(None, number)
        commit_tables(tables, lambda _: parts)(None, number)                 # run again
    assert sorted(tuple(r) for r in tables.read("a").collect()) == [(1, 1, 0), (2, 1, 0), (2, 2, 1)]
    assert sorted(tuple(r) for r in tables.latest("a", ["k"]).collect()) == [(1, 1), (2, 2)]
    assert sorted(tuple(r) for r in tables.read("a", before=1).collect()) == [(1, 1, 0), (2, 1, 0)]
    compacted = tables.attempt(2)
    compacted.write("a", tables.latest("a", ["k"]), replaces=True)
    assert tables.read("a").count() == 3                                     # not committed yet
    compacted.commit()
    assert sorted(tuple(r) for r in tables.read("a").collect()) == [(1, 1, 2), (2, 2, 2)]
    assert tables.read("b").count() == 1 and tables.attempt(2) is None


def test_closed_windows_leave_the_state(spark, tmp_path):
    """One file a day: the state holds the windows that the watermark has not
    passed, and a batch writes only the windows that it changed."""
    path, schema = str(tmp_path / "in"), HISTORY.format("bigint")
    rows = []
    for d in range(12):
        new = [(d * 10 + c, c, Decimal(c + d), "USD", BASE + timedelta(days=d, hours=c), "success") for c in range(5)]
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(path)
        s = S.daily_price_window_stream(spark.readStream.schema(schema).parquet(path))
        got, progress = S.run_windows(s, ["window_start", "competitor_id"], str(tmp_path / "out"))
    state = progress[-1]["stateOperators"][0]["numRowsTotal"]
    assert state <= 3 * 5                       # of 12 days' windows
    assert got.count() == 60
    written = CommittedTables(spark, str(tmp_path / "out")).read("windows").groupBy("batch").count().collect()
    assert max(r["count"] for r in written) == 5
    want = S.daily_price_window(spark.createDataFrame(rows, schema))
    assert _rows(got, ["competitor_id", "n", "min_price"]) == _rows(want, ["competitor_id", "n", "min_price"])


def test_digest_window_stream_equals_batch_and_forgets(spark, tmp_path):
    schema = "user_id int, detected_at timestamp_ntz, alert_type string"
    settings = spark.createDataFrame([(1, 8), (2, 1), (3, 48), (4, 0)], "user_id int, digest_frequency_hours int")
    rows, path = [], str(tmp_path / "in")
    for d in range(15):
        # each arrival holds alerts up to a day late
        new = [(u, BASE + timedelta(days=d) - timedelta(hours=h), "price_drop") for u in (1, 2, 3, 4, 5) for h in range(0, 24, 7)]
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(path)
        s = S.digest_window_stream(spark.readStream.schema(schema).parquet(path), settings)
        got, progress = S.run_windows(s, ["user_id", "freq", "window_start"], str(tmp_path / "out"))
    want = S.digest_window(spark.createDataFrame(rows, schema), settings)
    cols = ["user_id", "freq", "window_start", "alerts", "drops"]
    assert _rows(got, cols) == _rows(want, cols)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < want.count() / 2


def test_digest_windows_of_any_frequency(spark):
    base = datetime(2024, 1, 1)
    alerts = spark.createDataFrame([(u, base + timedelta(hours=h), "price_drop") for u in (1, 2, 3, 4) for h in range(0, 96, 5)],
                                   "user_id int, detected_at timestamp_ntz, alert_type string")
    settings = spark.createDataFrame([(1, 8), (2, 1), (3, 48), (4, 0)], "user_id int, digest_frequency_hours int")
    got = S.digest_window(alerts, settings).groupBy("user_id", "freq").agg(
        F.sum("alerts").alias("n"), F.count(F.lit(1)).alias("windows")).collect()
    assert {(r.user_id, r.freq, r.n) for r in got} == {(1, 8, 20), (2, 1, 20), (3, 48, 20), (4, 24, 20)}
    assert {r.user_id: r.windows for r in got} == {1: 12, 2: 20, 3: 3, 4: 4}    # 48-hour windows start on even days since 1970


def test_out_of_order_arrivals_are_one_batch_each(spark, model):
    """However many files an arrival comes in, the stream takes three batches."""
    import os

    import __spark_entry__ as E
    from pricelens.config import ensure_checkpoint_dir
    folder = f"{ensure_checkpoint_dir(spark)}/stream_tables"
    known = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "200")
    try:
        got = E.queries()["L2_stream_alerts_out_of_order"](spark, SF)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    (own,) = (f for f in os.listdir(folder) if f not in known and f.startswith("l2o-"))
    assert len([f for f in os.listdir(f"{folder}/{own}/commits") if f.startswith("batch=")]) == 3
    cols = ["id", "alert_type", "new_price"]
    want = sorted((r.id, r.alert_type, float(r.new_price)) for r in model.detections.select(*cols).collect())
    assert [*map(tuple, _rows(got, cols))] == want
