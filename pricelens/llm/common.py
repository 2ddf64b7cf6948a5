"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ensure_checkpoint_dir, materialize, ship_package

FILE, ROW = "src_file", "src_row"
ARROW_ROWS = 512                 # rows handed to a Python worker at once: bounds its memory with long texts


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and bound the Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the shared folder of spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a table into the shared folder and read it back (cuts lineage)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_locator(df: DataFrame, cols) -> DataFrame:
    meta = df.metadataColumn("_metadata")
    return df.select(*cols, meta["file_path"].alias(FILE), meta["row_index"].alias(ROW))


def filed(df: DataFrame) -> DataFrame:
    """``df`` itself, if it is a plain file scan, else a copy of it written to
    the shared folder: every row has a file and a position in it, which a
    retry reproduces."""
    try:
        _with_locator(df, []).schema
        return df
    except AnalysisException:
        return materialize(df, "filed")


def located(df: DataFrame, *cols) -> DataFrame:
    """``cols`` of ``df`` with the row's locator: the file and the position in
    it.  What is no plain file scan is written first (only ``cols``)."""
    try:
        out = _with_locator(df, cols)
        out.schema
    except AnalysisException:
        written = materialize(df.select(*cols), "located")
        out = _with_locator(written, [written[f"`{c}`"] for c in written.columns])
    return out


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> list:
    """The two columns an operator reads, under fixed names, so that other
    columns of the frame may have any name."""
    return [docs[id_col].alias("doc_id"), docs[text_col].alias("text")]


def texts(batch, name: str = "text") -> list[str]:
    """The text column of an Arrow batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def grouped(docs: list[str], size: int = 1 << 21):
    """The texts in groups of about ``size`` characters, in order."""
    own, n = [], 0
    for d in docs:
        own.append(d)
        n += len(d)
        if n >= size:
            yield own
            own, n = [], 0
    if own:
        yield own


def gathered(batches, size: int = 8 << 20):
    """Arrow batches joined to about ``size`` bytes each."""
    own, n = [], 0
    for b in batches:
        own.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            own, n = [], 0
    if any(b.num_rows for b in own):
        yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]


def hand_back() -> None:
    """Give the system the memory that this worker has freed.  Workers are
    reused: what their allocators hold on to stays beside the JVM, stage after
    stage."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):                             # glibc
        libc.malloc_trim(0)


class Recent(dict):
    """``make(key)`` with a memory of recent answers: of the last ``keep``
    different keys at least, and twice that at most."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


# --- token hashes of whole batches of texts -----------------------------------------------------

_SPACE, _WORD, _SYMBOL = 0, 1, 2
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = _WORD
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def token_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens of the texts, in order, and for each token
    its text's number.  Tokens are runs of letters, digits and bytes above
    ASCII, and runs of other visible ASCII characters."""
    buf = np.frombuffer(b" ".join(docs), np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    kind = _CLASS[buf]
    first = np.empty(len(buf), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    # texts are joined by one space, so a token never spans two of them
    at = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    place = np.arange(len(buf)) - at[run]
    power = np.ones(int(place.max()) + 1, np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = _BASE
        power = np.cumprod(power, dtype=np.uint64)
        sums = np.add.reduceat((buf.astype(np.uint64) + np.uint64(1)) * power[place], at)
        token = kind[at] != _SPACE
        hashes = mix(sums[token])
    ends = np.cumsum([len(d) + 1 for d in docs])
    return hashes, np.searchsorted(ends, at[token], side="right")


def doc_mod(col="doc_id"):
    """crc32 of the id as text, modulo 5: 0 marks the held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents outside the
    held-out fifth, in the order of a hash of the id.  ``docs`` has doc_id and
    text.  Several labels of a document: the largest counts; several rows of a
    document: the least text.  The ids are at most ``bound`` rows, so that the
    join's small side has a fixed bound."""
    ids = (labels.select(labels["doc_id"].alias("doc_id"), labels[label].alias("y"))
           .where("doc_id is not null and y is not null").where(doc_mod() != 0)
           .groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    return (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"))
