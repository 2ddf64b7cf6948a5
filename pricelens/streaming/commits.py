"""Several tables that a stream's batches reach together.

A batch writes each table's rows into a folder of its own attempt; when all are
written, one small commit record names them.  Readers list the records and
read the folders named there, so a batch shows up in all its tables at once,
the folders of an attempt that died are never read, and a batch that has a
record is not written again.  One stream writes to a root at a time.

A commit may state that a folder replaces all earlier folders of its table
(a compacted copy).  All reading and writing goes through Spark, so the root
may be in any store that it reaches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG = "attempt string, table string, folder string, replaces boolean, columns string, batch bigint"


class CommittedTables:
    """Tables under ``root``; only what a commit record names is read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # the folder exists, empty, before anyone lists it
        spark.createDataFrame([], _LOG).drop("batch").write.mode("append").parquet(f"{self.root}/commits")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/commits")

    def committed(self, number: int) -> bool:
        return bool(self._log().where(F.col("batch") == number).take(1))

    def entries(self, before: int | None = None) -> dict[str, list]:
        """Per table its records in order, from the last that replaces the
        others; a record per batch and table, no rows of the tables."""
        log = self._log().orderBy("batch")
        out: dict[str, list] = {}
        for r in (log if before is None else log.where(F.col("batch") < before)).toLocalIterator():
            if r["replaces"]:
                out[r["table"]] = []
            out.setdefault(r["table"], []).append(r)
        return out

    def read(self, table: str, before: int | None = None, entries: dict | None = None) -> DataFrame | None:
        """The committed rows with their batch number; None before the first commit."""
        known = (self.entries(before) if entries is None else entries).get(table)
        if not known:
            return None
        schema = T.StructType.fromJson(_json(known[-1]["columns"]))
        out = None
        # one scan: the batch is part of the folder's name
        base = f"{self.root}/{table}"
        wide = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType())])
        out = (self.spark.read.schema(wide).option("basePath", base)
               .parquet(*[f"{base}/{r['folder']}" for r in known]).drop("attempt"))
        return out

    def latest(self, table: str, keys: list[str], before: int | None = None) -> DataFrame | None:
        """Of the rows with equal ``keys`` the one of the newest batch."""
        rows = self.read(table, before)
        if rows is None:
            return None
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row"))
                .select(*keys, "__row.*"))

    def attempt(self, number: int) -> Attempt | None:
        """A place to write a batch to; None if the batch is there already."""
        return None if self.committed(number) else Attempt(self, number)


class Attempt:
    """One try at writing a batch."""

    def __init__(self, tables: CommittedTables, number: int):
        self.tables, self.number, self.name = tables, number, uuid.uuid4().hex[:12]
        self.records: list[tuple] = []

    def write(self, table: str, rows: DataFrame, replaces: bool = False, partition_by: tuple = ()) -> DataFrame:
        """Write rows of a table, seen by readers after ``commit``; returns them as read back."""
        folder = f"batch={self.number}/attempt={self.name}"
        path = f"{self.tables.root}/{table}/{folder}"
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        self.records.append((self.name, table, folder, replaces, rows.schema.json()))
        return self.tables.spark.read.schema(rows.schema).parquet(path)

    def commit(self) -> None:
        """One record file for all tables of the batch: the moment they appear."""
        schema = T.StructType([f for f in T._parse_datatype_string(_LOG).fields if f.name != "batch"])
        (self.tables.spark.createDataFrame(self.records, schema).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.tables.root}/commits/batch={self.number}"))


def _json(text: str) -> dict:
    import json
    return json.loads(text)


def commit_tables(tables: CommittedTables, parts):
    """foreachBatch writer: ``parts(batch)`` gives {table: rows}, which appear
    together; a batch that is run again is not written twice."""
    def write(batch: DataFrame, number: int) -> None:
        attempt = tables.attempt(number)
        if attempt is None:
            return
        for table, rows in parts(batch).items():
            attempt.write(table, rows)
        attempt.commit()
    return write


def upsert_windows(tables: CommittedTables, table: str = "windows"):
    """foreachBatch writer for streams in update mode: a batch writes only the
    windows that it changed; ``tables.latest(table, keys)`` reads each
    window's newest row."""
    return commit_tables(tables, lambda batch: {table: batch})
