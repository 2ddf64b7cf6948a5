"""Logistic regression trained by follow-the-regularised-leader updates.

Shared by the two classifiers.  Examples are sparse rows (indices, values)
over ``2 ** bits`` hashed features plus one bias.  Training runs on shards: a
bounded sample is dealt over ``shards`` tasks by a hash of the document, each
makes its own FTRL-proximal passes, and the weights are averaged.  Texts become
feature lists in the tasks that read them; a shard holds at most ``2 ** bits``
numbers a document, never a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, texts


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    epochs: int = 3
    shards: int = 6


class Ftrl:
    """FTRL-proximal with per-coordinate learning rates."""

    def __init__(self, s: Settings):
        self.s = s
        self.z = np.zeros((1 << s.bits) + 1)          # the last is the bias
        self.n = np.zeros((1 << s.bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, s = self.z[at], self.s
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """``at`` has no index twice."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def train(sample: DataFrame, features, s: Settings) -> np.ndarray:
    """Weights (float32, the last one is the bias) from ``sample`` (doc_id,
    text, y).  ``features(texts)`` gives (indices, values) for each text.
    Without any row all weights are zero.  The result has a fixed length, so
    it may be handed to every task."""
    size = (1 << s.bits) + 1
    kind = sample.schema["doc_id"].dataType.simpleString()

    def featured(batches):
        """Texts become feature lists where they are read: shards get no texts.
        A list is the bytes of its numbers; values that are all 1 are left out."""
        for b in batches:
            at, x = [], []
            for group in grouped(texts(b)):
                for own, values in features(group):
                    at.append(own.astype(np.int32).tobytes())
                    x.append(None if (values == 1).all() else values.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(at, pa.binary()),
                                              pa.array(x, pa.binary())], ["doc_id", "y", "at", "x"])

    def shard(table):
        ids, rows = table.column("doc_id").to_pylist(), table.column("y").to_pylist()
        own = sorted(range(len(ids)), key=lambda k: (str(ids[k]), rows[k]))
        rows = [rows[k] for k in own]
        at, x = ([table.column(c)[k].as_py() for k in own] for c in ("at", "x"))
        del table

        def example(k):
            places = np.frombuffer(at[k], np.int32)
            values = np.ones(len(places)) if x[k] is None else np.frombuffer(x[k], np.float32)
            return np.append(places, size - 1), np.append(values, 1.0)

        order = np.random.default_rng(7)
        model = Ftrl(s)
        for _ in range(s.epochs):
            for k in order.permutation(len(rows)):
                model.update(*example(k), rows[k])
        w = model.weights()
        live = np.flatnonzero(w)
        # the row at -1 counts the shard's documents
        return pa.table({"at": pa.array(np.append(-1, live)), "w": pa.array(np.append(1.0, w[live])),
                         "rows": pa.array(np.full(len(live) + 1, len(rows)), pa.int64())})

    made = sample.select("doc_id", "text", "y").mapInArrow(featured, f"doc_id {kind}, y int, at binary, x binary")
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(s.shards)))
    # shards hold as good as equal numbers of documents; each counts by its size
    parts = (dealt.groupBy("shard").applyInArrow(shard, "at bigint, w double, rows bigint")
             .groupBy("at").agg(F.sum(F.col("w") * F.col("rows")).alias("w")))
    out, total = np.zeros(size), 0.0
    for r in parts.toLocalIterator():
        if r["at"] < 0:
            total = r["w"]
        else:
            out[r["at"]] = r["w"]
    return (out / max(total, 1.0)).astype(np.float32)


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
