"""Operator 9, SimHash near-dedup with pigeonring filtering.

Fingerprints: words are runs of anything but ASCII white space, A-Z
lower-cased; every shingle of ``width`` consecutive words (all words, if
fewer), repeats included, is hashed by XXH64 (UTF-8, seed 42); a bit of the
64-bit fingerprint is set if it is set in over half the hashes.  A text
without words has fingerprint zero and is linked like any other.

Links: two fingerprints link at ``max_bits`` or fewer differing bits.  The 64
bits are cut into a ring of m = max_bits + 1 segments.  By the pigeonring
principle, if the segments' differences sum to at most t, then some segment
starts a chain in which every l consecutive segments together differ by at
most l * t / m.  Candidates share an index key made of the start segment
(which must agree, as t / m < 1) and the next one with one bit masked (the
two may differ by at most 2t/m < 2, so by one bit).  Longer chains are then
checked in growing order, each against its proportional budget, and only
pairs with a full chain reach the Hamming check of all 64 bits.

Equal fingerprints are one node.  Rows are sorted by key inside each
partition and pairs are formed inside a run of equal keys, in blocks of
numpy arrays; a run longer than ``block`` fingerprints is dealt out again as
pairs of blocks over many tasks, so that no key is cut or capped.  A pair is
taken only under its first common key, and each run hands on a spanning
forest of its links, not all pairs.  Components are found by alternating
large-star and small-star steps, each written to the shared folder.

Null text counts as empty, and a null doc_id is never the smallest of a
component unless all are null.  Repeated rows share a fingerprint.  An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, id_and_text, located, prepare, run_dir, save, texts

SEED = 42
WIDTH, MAX_BITS, BLOCK = 4, 4, 4096


def shingles(text: str, width: int) -> list[bytes]:
    words = text.encode().lower().split()       # bytes: A-Z and ASCII white space only
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: str, width: int = WIDTH) -> int:
    own = shingles(text, width)
    total, n, step = np.zeros(64, np.int64), len(own), 1 << 16
    for at in range(0, n, step):
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own[at:at + step]), ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, locator and fp (the fingerprint's bits as a signed long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = [_signed(fingerprint(t, width)) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(FILE), b.column(ROW),
                                              pa.array(fp, pa.int64())], ["doc_id", FILE, ROW, "fp"])

    return docs.mapInArrow(run, f"doc_id {kind}, {FILE} string, {ROW} bigint, fp bigint")


class Ring:
    """The ring of segments of a 64-bit fingerprint, for a bit distance."""

    def __init__(self, max_bits: int):
        self.t, self.m = max_bits, max_bits + 1
        cuts = [64 * i // self.m for i in range(self.m + 1)]
        self.shift = [64 - c for c in cuts[1:]]
        self.size = [b - a for a, b in zip(cuts, cuts[1:])]
        self.masks = [np.uint64(((1 << s) - 1) << at) for s, at in zip(self.size, self.shift)]

    def keys(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start segment and each masked bit of the next: the key's
        number and bits; shape (keys, fingerprints)."""
        ids, vals = [], []
        for i in range(self.m):
            j = (i + 1) % self.m
            both = fp & (self.masks[i] | self.masks[j])
            for bit in range(self.size[j]):
                ids.append(len(ids))
                vals.append(both & ~np.uint64(1 << (self.shift[j] + bit)))
        return np.array(ids, np.int16), np.array(vals, np.uint64)

    def starts(self, key: np.ndarray) -> np.ndarray:
        """The start segment of each key number."""
        return np.searchsorted(np.cumsum([self.size[(i + 1) % self.m] for i in range(self.m)]), key, side="right")

    def linked(self, x: np.ndarray, start: int, key: np.ndarray) -> np.ndarray:
        """Which pairs with difference ``x``, met under ``key`` (with this
        start segment), pass the chain from the start, differ in at most t
        bits, and have no earlier key in common."""
        at, total = np.arange(len(x)), np.zeros(len(x), np.uint8)
        for step in range(self.m):                   # chains of 1..m segments; m segments are the Hamming check
            total = total + np.bitwise_count(x[at] & self.masks[(start + step) % self.m])
            ok = total <= (step + 1) * self.t // self.m
            at, total = at[ok], total[ok]
            if not len(at):
                break
        out = np.zeros(len(x), bool)
        if len(at):
            out[at] = self._first_key(x[at]) == key[at]
        return out

    def _first_key(self, x: np.ndarray) -> np.ndarray:
        """The number of the first key that a pair with this difference shares
        and whose chain it passes."""
        first = np.full(x.shape, 1 << 14, np.int64)
        base = 0
        for i in range(self.m):
            j = (i + 1) % self.m
            ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.uint8)
            for step in range(self.m):
                total = total + np.bitwise_count(x & self.masks[(i + step) % self.m])
                ok &= total <= (step + 1) * self.t // self.m
            d = x & self.masks[j]
            # with no difference every masked bit fits, so the first; else the differing bit
            low = np.where(d == 0, 0, np.bitwise_count(d - (d != 0)).astype(np.int64) - self.shift[j])
            first = np.where(ok & (first == 1 << 14), base + low, first)
            base += self.size[j]
        return first


class Forest:
    """Union-find over fingerprints; ``add`` keeps only links that join."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for u, v in zip(a.tolist(), b.tolist()):
            p, q = self.top(u), self.top(v)
            if p != q:
                self.parent[q] = p
                self.links.append((u, v))


def compare(forest: Forest, ring: Ring, key: int, a: np.ndarray, b: np.ndarray | None = None) -> None:
    """Add the links under ``key`` inside ``a``, or between ``a`` and ``b``,
    a bounded number of pairs at a time."""
    start = int(ring.starts(np.array([key]))[0])
    width = max(1, (1 << 20) // max(1, len(a if b is None else b)))
    for lo in range(0, len(a), width):
        part = a[lo:lo + width]
        rest = a[lo:] if b is None else b
        x = (part[:, None] ^ rest[None, :]).reshape(-1)
        hit = np.flatnonzero(ring.linked(x, start, np.full(len(x), key)) & (x != 0))
        i, j = hit // len(rest), hit % len(rest)
        if b is None:
            i, j = i[j > i], j[j > i]
        forest.add(part[i], rest[j])


def compare_runs(forest: Forest, ring: Ring, no: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> None:
    """Add the links inside all runs of equal (no, bits)."""
    new = np.concatenate([[True], (no[1:] != no[:-1]) | (bits[1:] != bits[:-1])])
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    first = np.flatnonzero(new)
    for r in np.flatnonzero(size > _SHORT):
        compare(forest, ring, int(no[first[r]]), fp[first[r]:first[r] + size[r]])
    at = np.flatnonzero((size[run] > 1) & (size[run] <= _SHORT))
    step = 1
    while len(at):
        at = at[at + step < len(run)]
        at = at[run[at + step] == run[at]]
        x, starts = fp[at] ^ fp[at + step], ring.starts(no[at])
        for s in range(ring.m):
            own = at[starts == s]
            hit = own[ring.linked(x[starts == s], s, no[own])]
            forest.add(fp[hit], fp[hit + step])
        step += 1


_LINK = "key_no smallint, bits bigint, fp bigint, blk bigint, u bigint, v bigint"
_SHORT = 32                # runs up to this length are compared by whole-array shifts
_CHUNK = 1 << 16           # rows of sorted input handled at once


def _edges(pairs: list[tuple[int, int]]):
    """Two Arrow arrays with the links, u < v, as signed longs."""
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    both.sort(axis=1)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _index_rows(max_bits: int):
    ring = Ring(max_bits)

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids, vals = ring.keys(fp)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, len(fp))), pa.array(vals.reshape(-1).view(np.int64)),
                 pa.array(np.tile(fp.view(np.int64), len(ids)))], ["key_no", "bits", "fp"])
    return run


def _column(b, name, kind):
    return b.column(name).to_numpy(zero_copy_only=False).astype(kind)


def _sorted_runs(max_bits: int, block: int):
    """Over rows sorted by (key_no, bits): links inside each run of equal
    keys; the rows of a run longer than ``block`` come out with the number of
    their block, to be compared elsewhere."""
    ring = Ring(max_bits)

    def linked_rows(forest):
        u, v = _edges(forest.links)
        n = len(u)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int16()), *[pa.nulls(n, pa.int64())] * 3, u, v],
                                          ["key_no", "bits", "fp", "blk", "u", "v"])

    def late_rows(no, bits, fp, blk):
        n = len(fp)
        return pa.RecordBatch.from_arrays(
            [pa.array(no), pa.array(bits), pa.array(fp.view(np.int64)), pa.array(np.full(n, blk, np.int64)),
             *[pa.nulls(n, pa.int64())] * 2], ["key_no", "bits", "fp", "blk", "u", "v"])

    def run(batches):
        held, n, blk = [], 0, 0        # rows not yet handled; blocks of the first run that were handed on

        def chunk(last):
            """Handle all whole runs among the held rows; the last run stays open unless ``last``."""
            nonlocal held, n, blk
            no, bits, fp = (np.concatenate(x) for x in zip(*held))
            cuts = np.concatenate([[0], np.flatnonzero((no[1:] != no[:-1]) | (bits[1:] != bits[:-1])) + 1, [len(no)]])
            lo, hi = 0, len(no) if last else int(cuts[-2])
            if blk and hi:             # the rest of a run whose first blocks are gone
                lo = int(cuts[1])
                yield late_rows(no[:lo], bits[:lo], fp[:lo], blk)
                blk = 0
            sizes = np.diff(cuts)
            long = [(int(cuts[r]), int(cuts[r + 1])) for r in np.flatnonzero(sizes > block)
                    if lo <= cuts[r] and cuts[r + 1] <= hi]
            for s, e in long:
                for k, at in enumerate(range(s, e, block)):
                    to = min(e, at + block)
                    yield late_rows(no[at:to], bits[at:to], fp[at:to], k)
            keep = np.ones(len(no), bool)
            keep[:lo] = keep[hi:] = False
            for s, e in long:
                keep[s:e] = False
            if keep.any():
                forest = Forest()
                compare_runs(forest, ring, no[keep], bits[keep], fp[keep])
                if forest.links:
                    yield linked_rows(forest)
            while len(no) - hi > block:
                to = hi + block
                yield late_rows(no[hi:to], bits[hi:to], fp[hi:to], blk)
                hi, blk = to, blk + 1
            held, n = [(no[hi:], bits[hi:], fp[hi:])], len(no) - hi

        for b in batches:
            if b.num_rows:
                held.append((_column(b, "key_no", np.int16), _column(b, "bits", np.int64),
                             _column(b, "fp", np.int64).view(np.uint64)))
                n += b.num_rows
                if n >= _CHUNK + block:
                    yield from chunk(False)
        if held:
            yield from chunk(True)
    return run


def _block_pairs(max_bits: int):
    ring = Ring(max_bits)

    def run(key, table):
        k, lo, hi = int(key[0].as_py()), key[2].as_py(), key[3].as_py()
        fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        blk = table.column("blk").to_numpy()
        found = Forest()
        compare(found, ring, k, fp[blk == lo], None if lo == hi else fp[blk == hi])
        u, v = _edges(found.links)
        return pa.table({"u": u, "v": v})
    return run


def links(nodes: DataFrame, folder: str, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(u, v) with u < v: links between the distinct fingerprints ``nodes``
    (column fp) that connect all that differ by at most ``max_bits`` bits."""
    spark = nodes.sparkSession
    keyed = nodes.mapInArrow(_index_rows(max_bits), "key_no smallint, bits bigint, fp bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = save(keyed.repartition(parts, "key_no", "bits").sortWithinPartitions("key_no", "bits")
                 .mapInArrow(_sorted_runs(max_bits, block), _LINK), f"{folder}/runs")
    out = found.where("u is not null").select("u", "v")
    late = found.where("fp is not null").select("key_no", "bits", "fp", "blk")
    if late.take(1):
        blocks = late.groupBy("key_no", "bits").agg(F.max("blk").alias("last"))
        pairs = (late.join(blocks, ["key_no", "bits"])
                 .select("key_no", "bits", "fp", "blk", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
                 .withColumns({"lo": F.least("blk", "other"), "hi": F.greatest("blk", "other")}))
        more = pairs.groupBy("key_no", "bits", "lo", "hi").applyInArrow(_block_pairs(max_bits), "u bigint, v bigint")
        out = out.unionByName(more)
    return save(out.distinct(), f"{folder}/links")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root): for every node of the links (u, v), the smallest node
    that it reaches.  Alternating star contraction: large-star hangs each
    node's larger neighbours on its smallest neighbour, small-star its smaller
    ones, until every link points at a root."""
    step, before = 0, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        large = save(large.where("u <> v"), f"{folder}/large-{step}")          # u > v
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        small = save(small.where("u <> v"), f"{folder}/small-{step}")
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges, before, step = small.select(F.col("v").alias("u"), F.col("u").alias("v")), now, step + 1


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                  max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal
    digits), component_id (smallest doc_id reachable), kept (one row of each
    component: the smallest doc_id, then locator) and the row's locator."""
    spark = docs.sparkSession
    prepare(spark)
    folder = run_dir(spark, "simhash")
    rows = save(fingerprints(located(docs, *id_and_text(docs, id_col, text_col)), width), f"{folder}/fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", FILE, ROW)
    nodes = save(rows.groupBy("fp").agg(F.min(order).alias("first")), f"{folder}/nodes")
    roots = components(links(nodes.select("fp"), folder, max_bits, block), folder)
    rooted = (nodes.join(roots, nodes["fp"] == roots["node"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    by_fp = rooted.join(best, "root").select("fp", "best")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.doc_id").alias("component_id"),
        ((F.col(FILE) == F.col(f"best.{FILE}")) & (F.col(ROW) == F.col(f"best.{ROW}"))).alias("kept"), FILE, ROW)
