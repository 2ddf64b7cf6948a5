"""Fixed values and session helpers.

The constants below are the behavioural limits of the monitored application;
results depend on them, so they are kept verbatim and in one place.
"""

from __future__ import annotations

import os
import re
import tempfile
from decimal import Decimal

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import SparkSession

# --- fixed values (must equal the reference application's limits) -----------
MIN_SIGNIFICANT_CHANGE = Decimal("5.00")   # absolute change that alerts below threshold
MAX_PENDING_ALERTS_PER_USER = 100          # unsent price alerts per user
CLEANUP_PENDING_AFTER_DAYS = 7             # included alerts older than this are purged
MAX_DIGEST_ALERTS = 50                     # alerts mailed per digest
LAST_N_POINTS = 10                         # points handed to insight generation
MAX_INSIGHTS_PER_PRODUCT = 5
MAX_INSIGHT_TEXT = 500
MAX_TRACK_ITEMS = 5000
DEFAULT_THRESHOLD_PERCENT = Decimal("10.00")
DEFAULT_DIGEST_HOURS = 24
DEFAULT_HISTORY_DAYS = 30
DEFAULT_PAGE_LIMIT = 100
ERROR_TEXT_MAX = 200
RECENT_ALERT_DAYS = 7
INSIGHT_ANALYSIS_DAYS = 30
INSIGHT_TYPES = ("pattern", "alert", "recommendation")
ALERT_TYPES = ("price_drop", "price_increase", "currency_changed")
DEFAULT_CURRENCY = "USD"
JOB_STATUSES = ("pending", "processing", "completed", "failed")
MAX_PRICE = Decimal("99999999.99")         # what the price column can hold
PRICE_TOO_LARGE = "Price does not fit the price column"


CHUNK_ITEMS = 1000                         # items of one array where a list has no bound of its own


# session settings for a large cluster (hundreds of TB, ~1000 executors):
# many initial shuffle partitions that AQE coalesces to ~256 MB each, 256 MB
# scan splits, skew splitting for partitions 5x the median and > 512 MB, and a
# broadcast threshold that AQE checks against *measured* sizes.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.task.maxFailures": "8",
    "spark.speculation": "true",
}


def build_session(master: str | None = None, app_name: str = "pricelens",
                  shuffle_partitions: int | None = None, extra: dict | None = None,
                  cluster: bool = False) -> SparkSession:
    """A session configured the way the library expects.

    * AQE on: coalesces tiny shuffles, splits skewed join partitions and turns
      joins whose *measured* build side is small into broadcast joins.
    * UTC session time zone: day boundaries (``scraped today``, daily windows)
      are UTC days.
    * UI off: no HTTP server is started.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.ansi.enabled": "false",
    }
    if cluster:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name shared storage.  Only a session whose
    master is local (one machine) may leave it unset; it then gets a scratch
    folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="pricelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        spark.sparkContext.setCheckpointDir(path)
    except PySparkNotImplementedError:  # a session type without SparkContext: tables and streams still use `path`
        pass
    return path


def cut_lineage(df):
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df, name: str):
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back: a columnar, lineage-free copy for results that several
    branches reuse (re-reads prune columns and survive executor loss)."""
    import uuid
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:10]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``pricelens`` importable in executor Python workers (needed by the
    few operators that run Python there: the HTML tokeniser, the stateful
    alert stream and foreachBatch sinks).  The package is zipped once per
    session and distributed with ``addPyFile``."""
    import zipfile
    key = spark.conf.get("spark.app.id", None) or id(spark)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="pricelens-pyfiles-"), "pricelens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    try:
        context = spark.sparkContext
    except PySparkNotImplementedError:  # sessions without a SparkContext (e.g. Connect) ship artifacts instead
        spark.addArtifacts(zpath, pyfile=True)
    else:
        context.addPyFile(zpath)
    _SHIPPED.add(key)
