"""Operator 3, quality classifier: hashed word n-grams, logistic regression
by FTRL, scored as sparse dot products.

Tokens are runs of letters and digits and runs of other visible characters;
a token equal to the one before counts as a repeat mark.  All 1- to
3-grams of the whole text are hashed into 2 ** bits features, whose value is
the gram's share of the text's grams.  A text's margin is the dot product of
these sparse values with the weights, computed for a batch of texts at once
from the grams' weights.

Trained on at most ``sample_rows`` labelled rows outside the held-out fifth
(crc32 of the id, modulo 5, is 0 for held-out rows), in the order of a hash of
the id.  Labels, language, source and id are no inputs of a score.

A null or empty text has no grams: its score is the bias alone.  Without any
label every score is 0.5.  Repeated rows get equal scores, an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_mod, grouped, id_and_text, labelled_sample, mix, prepare, texts, token_hashes
from .ftrl import Settings, probability, train

SETTINGS = Settings(bits=18, alpha=2.0, beta=0.1, l1=0.02, l2=0.1, epochs=3, shards=2)
SAMPLE_ROWS = 12_000
THRESHOLD = 0.3
SCALE = 8.0                 # shares of grams are small; this brings them near 1
_REPEAT = np.uint64(0x5EED5EED5EED5EED)
_K2, _K3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def grams(docs: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all 1- to 3-grams and the text that each is from."""
    h, doc = token_hashes([d.encode() for d in docs])
    if len(h) > 1:
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
        h = np.where(again, _REPEAT, h)
    same2, same3 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    two = mix(h[:-1] * _K2 + h[1:])
    three = mix(two[:-1] * _K3 + h[2:])
    at = np.concatenate([h, two[same2], three[same3]]) >> np.uint64(64 - bits)
    return at.astype(np.int64), np.concatenate([doc, doc[1:][same2], doc[2:][same3]])


def features(bits: int):
    def of(docs: list[str]):
        at, doc = grams(docs, bits)
        for k in range(len(docs)):
            own, n = np.unique(at[doc == k], return_counts=True)
            yield own, n * (SCALE / max(1, n.sum()))
    return of


def margins(docs: list[str], w: np.ndarray, bits: int) -> np.ndarray:
    at, doc = grams(docs, bits)
    n = np.bincount(doc, minlength=len(docs))
    return SCALE * np.bincount(doc, w[at], minlength=len(docs)) / np.maximum(n, 1) + w[-1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", s: Settings = SETTINGS,
        sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    return train(labelled_sample(docs, labels, label, sample_rows), features(s.bits), s)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   s: Settings = SETTINGS, sample_rows: int = SAMPLE_ROWS,
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(*id_and_text(docs, id_col, text_col))
    w = spark.sparkContext.broadcast(fit(docs, labels, s=s, sample_rows=sample_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            m = [margins(g, w.value, s.bits) for g in grouped(texts(b))]
            score = probability(np.concatenate(m)) if m else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return (docs.mapInArrow(run, f"doc_id {kind}, score double")
            .select("doc_id", F.coalesce(doc_mod() == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
