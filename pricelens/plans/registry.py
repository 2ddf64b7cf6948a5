"""Named queries over the model tables: one per operator of the inventory.

Each entry is (spark builder, oracle SQL or None).  The builder takes
(spark, sf_dir) and returns a DataFrame; decimal outputs are cast to
double at the very end so both engines hand back the same bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.model_sql import with_models
from ..sources.tables import AS_OF, ModelTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def doubles(df: DataFrame) -> DataFrame:
    """Normalise output types: decimals -> double, 8/16/32-bit integers ->
    bigint (top level only), so both engines hand back the same types."""
    def norm(f):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(f.name).cast("bigint").alias(f.name)
        return F.col(f.name)
    return df.select(*[norm(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, models: tuple[str, ...] = ()):
    def deco(fn: Callable[[ModelTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return doubles(fn(ModelTables(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_models(sql, *models)
        return fn
    return deco


def _load_all():
    # import for side effects: each module registers its queries
    from . import q_history, q_alerts, q_dashboard, q_scalars, q_stream, q_catalog, q_maint, q_insights, q_html, q_more  # noqa: F401


_load_all()
