"""Operator 12, language identification by hyperdimensional profiles.

Every letter, and the gap between words, has a random vector of ``dims``
elements of +1 and -1, made from its code point by a hash.  A run of three
symbols abc is bound into one vector, the product of a's vector permuted twice
(rotated by two places), b's permuted once and c's.  A text's profile is the
bundle (sum) of the vectors of all runs of its lower-cased text, brought to
length ``UNIT`` in whole numbers.  A language's prototype is the sum of its
documents' profiles; a text gets the language whose prototype has the largest
cosine with its profile, ties the least name.  The score is that cosine, 0
where it is negative.

Prototypes are learned from every document with a language outside the
held-out quarter (crc32 of the id as text, modulo 4, is 2); profiles are whole
numbers, so that the sums do not depend on the order of rows.  A task hands on
one sum per language, and Spark adds these up element by element.  Tasks get
prototypes in blocks of ``BLOCK`` languages, with a running best from block to
block, so any number of languages is exact.

A null text, and one without a letter, is ``und`` with score 0; so is every text
if there is nothing to learn from.  A prototype or profile of length 0 has
cosine 0 with anything.  Repeated rows count as often as they occur and get equal answers; a null id
is not held out.  Empty and very long texts need nothing special, an empty
table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prepare, texts

DIMS = 1024
UNIT = 1000                  # length of a document's profile in a prototype
BLOCK = 512                  # languages compared at once
KNOWN = 1 << 14              # vectors of runs kept in a task
STEP = 4096                  # runs bundled at once
UNKNOWN = "und"
_GAP = 0
_SHIFT = np.uint64(21)       # a code point has 21 bits


def held_out(col="doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(4096)
def _vector(symbol: int, dims: int) -> np.ndarray:
    words = np.arange(-(-dims // 64), dtype=np.uint64)
    with np.errstate(over="ignore"):
        bits = np.unpackbits(mix(mix(words + np.uint64(1)) + np.uint64(symbol + 1)).view(np.uint8))[:dims]
    return (1 - 2 * bits.astype(np.int8)).astype(np.int8)


def bound(run: int, dims: int) -> np.ndarray:
    """The vector of a run of three symbols."""
    a, b, c = run >> 42, run >> 21 & 0x1FFFFF, run & 0x1FFFFF
    return np.roll(_vector(a, dims), 2) * np.roll(_vector(b, dims), 1) * _vector(c, dims)


class Runs:
    """Vectors of the runs seen lately, one row each."""

    def __init__(self, dims: int, keep: int = KNOWN):
        self.dims, self.keep = dims, keep
        self.rows = np.empty((keep + STEP, dims), np.int8)
        self.at: dict[int, int] = {}

    def vectors(self, runs: list[int]) -> np.ndarray:
        if len(self.at) > self.keep:
            self.at.clear()
        at = self.at
        for r in runs:
            if r not in at:
                self.rows[len(at)] = bound(r, self.dims)
                at[r] = len(at)
        return self.rows[[at[r] for r in runs]]


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters as code points, anything between them as one gap;
    empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, where = np.unique(codes, return_inverse=True)
    letter = np.array([chr(k).isalpha() for k in kinds.tolist()], bool)[where] if len(codes) else np.empty(0, bool)
    if not letter.any():
        return np.empty(0, np.uint64)
    codes = np.where(letter, codes, _GAP)
    keep = letter | np.concatenate([[True], letter[:-1]])
    codes = codes[keep]
    return np.concatenate([[_GAP] * int(codes[0] != _GAP), codes, [_GAP] * int(codes[-1] != _GAP)]).astype(np.uint64)


def profile(text: str, runs: Runs) -> np.ndarray | None:
    """The bundle of a text's runs; None without a letter."""
    s = symbols(text)
    if not len(s):
        return None
    keys, n = np.unique((s[:-2] << _SHIFT << _SHIFT) | (s[1:-1] << _SHIFT) | s[2:], return_counts=True)
    out = np.zeros(runs.dims)
    for at in range(0, len(keys), STEP):
        vectors = runs.vectors(keys[at:at + STEP].tolist())
        # float32 sums are exact up to 2**24 runs; longer texts are summed in float64
        kind = np.float32 if n.sum() < 1 << 24 else np.float64
        out += n[at:at + STEP].astype(kind) @ vectors.astype(kind)
    return out


def prototypes(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """lang, at, value (long): the summed profiles of the documents (doc_id,
    text, lang) that may be learned from, element by element."""
    def run(batches):
        runs, sums = Runs(dims), {}
        for b in batches:
            for text, lang in zip(texts(b), b.column("lang").to_pylist()):
                own = profile(text, runs)
                size = 0 if own is None else float(np.sqrt(own @ own))
                if own is None:
                    continue
                total = sums.setdefault(lang, np.zeros(dims, np.int64))
                if size:
                    total += np.rint(own * (UNIT / size)).astype(np.int64)
                if len(sums) == BLOCK:                     # a bounded number of languages is held
                    yield _sums(sums)
                    sums = {}
        if sums:
            yield _sums(sums)

    learned = docs.where(F.col("lang").isNotNull() & ~held_out()).select("text", "lang")
    return (learned.mapInArrow(run, "lang string, values array<bigint>")
            .select("lang", F.posexplode("values").alias("at", "value"))
            .groupBy("lang", "at").agg(F.sum("value").alias("value")))


def _sums(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    size = len(next(iter(sums.values())))
    flat = pa.array(np.concatenate(list(sums.values())))
    at = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * size)
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.ListArray.from_arrays(at, flat)],
                                      ["lang", "values"])


def _blocks(learned: DataFrame, dims: int):
    """(names, matrix of unit prototypes) of at most BLOCK languages each, by name."""
    names, rows = [], []
    for r in learned.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v")).orderBy(
            "lang").toLocalIterator():
        v = np.array([x["value"] for x in r["v"]], float)
        size = np.sqrt(v @ v)
        names.append(r["lang"])
        rows.append(v / size if size else v)
        if len(names) == BLOCK:
            yield names, np.array(rows)
            names, rows = [], []
    if names:
        yield names, np.array(rows)


def _compare(names: list[str], unit, dims: int):
    """Take the best language of a block, if it beats the best so far."""
    def run(batches):
        runs = Runs(dims)
        for b in batches:
            best, score = b.column("lang_pred").to_pylist(), b.column("score").to_pylist()
            for k, text in enumerate(texts(b)):
                own = profile(text, runs)
                if own is None:
                    continue
                size = np.sqrt(own @ own)
                cosine = unit.value @ own / size if size else np.zeros(len(names))
                at = int(cosine.argmax())
                if best[k] is None or cosine[at] > score[k]:
                    best[k], score[k] = names[at], float(cosine[at])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text"), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "text", "lang_pred", "score"])
    return run


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                dims: int = DIMS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang_pred"),
                       F.lit(None).cast("double").alias("score"))
    for names, unit in _blocks(prototypes(docs, dims), dims):
        rows = rows.mapInArrow(_compare(names, spark.sparkContext.broadcast(unit), dims),
                               f"doc_id {kind}, text string, lang_pred string, score double")
    return rows.select("doc_id", held_out().alias("held_out"),
                       F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
                       F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))).alias("score"))
