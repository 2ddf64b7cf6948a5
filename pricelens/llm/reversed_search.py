"""Operator 13, ranked lexical search turned round: the items are indexed, the
documents stream past.

An inverted index over the items' terms (term -> items, repeats) is broadcast.
A first pass counts, per task, the documents and terms of the collection and in
how many documents each indexed term occurs; Spark adds these up.  A second
pass runs each document's term counts through the index, adds up its scores
for all items at once and keeps the ``k`` best documents of each item in a heap
of bounded size.  The tasks' heaps are merged in two steps, first by groups
of tasks, then by item, so no task gets the heaps of all tasks.

The items are dealt into blocks whose index holds at most ``postings``
(term, item) pairs; blocks are made smaller until this holds or a block has
one item, whose terms come from one cell of the table.  Every block sees every
document, so the ranking does not depend on the blocks.

Terms are the maximal runs of ASCII letters, digits and characters above ASCII,
with A-Z lower-cased.  Scores are whole numbers: weight w of a term is
floor(1000 * ln((2N + 2) / (2 df + 1))), and a document's score the sum of
w * ((10**9 * tf) div (1000 * tf + 8 * m)) over the item's terms, repeats
included, with m = 25 + (75 * n * N) div L.

Null texts have no terms.  An item without terms, or one that no document
matches, has no rows.  Rows of equal item_id (null among them) are one item
with the terms of all.  Each row of ``docs`` is a document, also if its id
occurs again; equal scores go by doc_id, null last.  Empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, run_dir, save, texts

TOP = 10
POSTINGS = 1 << 20           # (term, item) pairs of an index that is broadcast
CELLS = 1 << 22              # scores (documents times items) held at once
MERGERS = 64                 # groups of tasks whose heaps are merged first

# a byte that is no part of a term becomes a space, A-Z become lower case
_BYTES = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
               for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item, term, reps: how often each term occurs in an item."""
    kind = items.schema["item"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, term, n = [], [], []
            for k, text in enumerate(texts(b)):
                own = Counter(terms(text))
                at += [k] * len(own)
                term += own.keys()
                n += own.values()
            yield pa.RecordBatch.from_arrays(
                [b.column("item").take(pa.array(at, pa.int64())), pa.array(term, pa.binary()), pa.array(n, pa.int64())],
                ["item", "term", "reps"])

    return (items.mapInArrow(run, f"item {kind}, term binary, reps bigint")
            .groupBy("item", "term").agg(F.sum("reps").alias("reps")))


class Index:
    """term -> number; per number the items (as numbers) and their repeats."""

    def __init__(self, rows):
        self.items: list = []
        number, self.terms = {}, {}
        found = []
        for r in rows:
            if r["item"] not in number:
                number[r["item"]] = len(self.items)
                self.items.append(r["item"])
            found.append((self.terms.setdefault(bytes(r["term"]), len(self.terms)), number[r["item"]], r["reps"]))
        found.sort()
        term, self.item, self.reps = (np.array(c, np.int64) for c in zip(*found))
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))


def _count(index):
    """Per task: n documents and terms (at -1, -2), and documents per indexed term."""
    def run(batches):
        known, df = index.value.terms, None
        n = size = 0
        for b in batches:
            df = np.zeros(len(known), np.int64) if df is None else df
            for text in texts(b):
                own = terms(text)
                if own:
                    n, size = n + 1, size + len(own)
                    df[[known[t] for t in set(own) if t in known]] += 1
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()),
                                              pa.array([n, size, *df[at].tolist()], pa.int64())], ["at", "n"])
    return run


def statistics(docs: DataFrame, index, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, documents per indexed term."""
    found = docs.select("text").mapInArrow(_count(index), "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    df, total = np.zeros(size, np.int64), {-1: 0, -2: 0}
    for r in found.toLocalIterator():                      # at most one row per indexed term
        if r["at"] < 0:
            total[r["at"]] = r["n"]
        else:
            df[r["at"]] = r["n"]
    return total[-1], total[-2], df


class Heaps:
    """The ``k`` best documents of every item: highest score, then least id, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.heap = k, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)             # a score must be this high to get in

    def offer(self, scores: np.ndarray, ids: list) -> None:
        """``scores`` of documents (rows) for items (columns)."""
        at, item = np.nonzero((scores >= self.least) & (scores > 0))
        for d, i, s in zip(at.tolist(), item.tolist(), scores[at, item].tolist()):
            own = self.heap[i]
            entry = (s, ids[d] is not None, -(ids[d] or 0))
            if len(own) < self.k:
                heapq.heappush(own, entry)
            elif entry > own[0]:
                heapq.heapreplace(own, entry)
            if len(own) == self.k:
                self.least[i] = own[0][0]

    def rows(self):
        for i, own in enumerate(self.heap):
            for score, known, at in own:
                yield i, -at if known else None, score


def _score(index, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Per task: its documents streamed through the index, the heaps at the end."""
    def run(batches):
        x = index.value
        known, items = x.terms, len(x.items)
        step = max(1, CELLS // items)
        heaps = Heaps(items, k)
        for b in batches:
            all_ids, all_texts = b.column("doc_id").to_pylist(), texts(b)
            for first in range(0, len(all_texts), step):
                ids, part = all_ids[first:first + step], all_texts[first:first + step]
                doc, term, tf, m = [], [], [], np.zeros(len(part), np.int64)
                for d, text in enumerate(part):
                    own = terms(text)
                    if not own:
                        continue
                    m[d] = 25 + 75 * len(own) * n_docs // n_terms
                    for t, n in Counter(own).items():
                        at = known.get(t)
                        if at is not None:
                            doc.append(d)
                            term.append(at)
                            tf.append(n)
                scores = np.zeros((len(part), items), np.int64)
                doc, term, tf = (np.array(c, np.int64) for c in (doc, term, tf))
                own = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                ends = np.searchsorted(doc, np.arange(len(part) + 1))
                for d in range(len(part)):
                    row = scores[d]
                    for t, s in zip(term[ends[d]:ends[d + 1]].tolist(), own[ends[d]:ends[d + 1]]):
                        a, z = x.start[t], x.start[t + 1]
                        row[x.item[a:z]] += s * x.reps[a:z]
                heaps.offer(scores, ids)
        rows = list(heaps.rows())
        task = TaskContext.get().partitionId()
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64()),
                 pa.array([task % MERGERS] * len(rows), pa.int32())], ["item", "doc_id", "score", "merger"])
    return run


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _dealt(found: DataFrame, postings: int) -> tuple[DataFrame, int]:
    """The items' terms with a block number, and how many blocks there are."""
    total, items = found.agg(F.count(F.lit(1)), F.count_distinct(F.struct("item"))).first()
    blocks = max(1, math.ceil(total / postings))
    while True:
        # the null item is hashed apart from any number
        key = F.pmod(F.xxhash64(F.col("item").isNull(), "item"), F.lit(blocks))
        largest = found.groupBy(key.alias("b")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= postings or blocks >= 64 * max(1, items):
            return found.withColumn("block", key), blocks
        blocks *= 2


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", k: int = TOP,
                   postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    items = items.select(items[item_col].alias("item"), items[item_text_col].alias("text"))
    kind = items.schema["item"].dataType
    found, blocks = _dealt(save(item_terms(items), f"{run_dir(spark, 'search')}/terms"), postings)
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        rows = found.where(F.col("block") == block).select("item", "term", "reps").collect()   # at most `postings`
        if not rows:
            continue
        own = Index(rows)
        index = spark.sparkContext.broadcast(own)
        n_docs, n_terms, df = statistics(docs, index, len(own.terms))
        if not n_docs:
            continue
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        heaps = docs.mapInArrow(_score(index, weight, n_docs, n_terms, k),
                                "item bigint, doc_id bigint, score bigint, merger int")
        best = _best(_best(heaps, ["merger", "item"], k).drop("rank"), ["item"], k)
        names = spark.createDataFrame(list(enumerate(own.items)), f"item bigint, item_id {kind.simpleString()}")
        out = out.unionByName(best.join(F.broadcast(names), "item")
                              .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def sql(docs: str = "documents", items: str = "benchmark") -> str:
    """DuckDB SQL for ``lexical_search`` (item ids must not repeat)."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    return f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all({lower('text')}, '{pattern}')) AS term FROM {docs}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
asked AS (SELECT item_id, unnest(regexp_extract_all({lower('text')}, '{pattern}')) AS term FROM {items}),
reps AS (SELECT item_id, term, count(*) AS reps FROM asked GROUP BY item_id, term),
scored AS (
  SELECT r.item_id, tf.doc_id,
    CAST(sum(r.reps * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * s.n * nd) // nt)))) AS BIGINT) AS score
  FROM reps r JOIN tf USING (term) JOIN weights w USING (term) JOIN size s ON s.doc_id = tf.doc_id, total GROUP BY 1, 2),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
