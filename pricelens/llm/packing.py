"""Operator 4, best-fit packing, certified by lower bounds.

Tokenising: a document's ids (byte-level BPE) and one separator id are cut
into pieces of ``capacity`` ids from the end, so that only the first piece of
a longer document may be shorter; others stay whole.

Packing: pieces are dealt by a hash of their content over partitions of about
``target`` pieces (their number grows with the data), and each partition is
packed by best-fit decreasing.  Dual feasible functions over its length
histogram give a lower bound on its number of sequences: U(eps) (long pieces
count whole, short ones not at all) followed by u(k) (lengths rounded to
k-ths).  A partition whose number equals its bound is certified.  Partitions
with a gap release the pieces of all sequences that are not full; certified
ones release only those of their emptiest sequence, if it is not full, as it
is what the bound's rounding left open.  The released pieces are dealt anew,
over fewer and (for the first rounds) wider partitions and by another hash, and
packed again, round by round.  The same bound over the lengths of all pieces
certifies the whole.  Where the rounds end above it, the certified partitions
release all their open sequences too, until the bound is reached or two rounds
in a row save no sequence.  A round that saves nothing is dropped: the one
before stands.

The dealing knows a piece's id, place, length and checksum, and the position of
its row in its file, which spreads repeated rows; not the file's name.  So the
same files under another path are packed alike.

Tokens are written once; rounds move lengths and locators only.  A partition
that is lost is packed again with the same result: its rows are sorted first.

Null text counts as empty: one piece, the separator alone.  Repeated rows are
packed each.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, gathered, hand_back, id_and_text, located, prepare, run_dir, save, texts

TOKENIZER = "byte_bpe_50k.json"
CAPACITY, SEPARATOR, TARGET, MAX_K = 2048, 0, 20_000, 24
WIDER = 3                      # each of the first rounds doubles the pieces of a partition, so often at most
KEEP = 200_000                 # words after which the older half of a worker's memory of ids goes
BATCH = 4 << 20                # bytes of text that a worker tokenises at once
PARTS = 1 << 14                # parts of texts that one call of the tokenizer encodes
_CUT = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n\S))")
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"\A{_SPACE}|{_SPACE}\z|{_SPACE}{_SPACE}"   # Arrow's syntax; the characters of Python's \s
_WORD = r"\A(?P<letters>\n?\p{L}+)(?P<signs>[!-&(-/:-@\[-`{-~]*)\z"   # all ASCII signs but the apostrophe


# --- tokens -------------------------------------------------------------------------------------
def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for
    themselves, all other bytes for the characters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}


class Tokens:
    """Ids by ``tokenizers``.  The byte-level pattern always starts a new token
    at a single space between two visible characters, and makes a single line
    feed between two a token of its own, so texts are cut there into words: a
    word has a space before it or begins with its line feed.  Most words are
    letters, with signs behind them or not, which the pattern cuts there and
    nowhere else: different letters are remembered without their signs, and
    those that were not met lately go to the vocabulary's merges in one text, a
    line feed behind each part.  All other new words go through the whole
    tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True          # their strings in a text are ordinary text
        self.letters = byte_letters()
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = Split(chr(self.letters[10]), "isolated")
        (self.line_feed,) = self._encode(["\n"])[0]
        # of words (of letters: without signs behind them): those met lately, and those met before them
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for k in range(0, len(texts), PARTS)
                for e in self.whole.encode_batch_fast(texts[k:k + PARTS], add_special_tokens=False)]

    def _merged(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that the pattern leaves whole.  An encoding takes
        far more memory than its ids, so a call gets a bounded number of parts."""
        return [ids for k in range(0, len(parts), PARTS) for ids in self._merged_at_once(parts[k:k + PARTS])]

    def _merged_at_once(self, parts: list[str]) -> list[bytes]:
        text = ("\n".join(parts) + "\n").encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * np.flatnonzero(ids == self.line_feed)
        if len(ends) != len(parts):
            raise ValueError("a line feed between parts is not a token of its own")
        raw = ids.tobytes()
        return list(map(raw.__getitem__, map(slice, [0, *(ends[:-1] + 4).tolist()], ends.tolist())))

    def _learn(self, words: list[str]) -> None:
        """A word met lately keeps its ids; the memory's older half goes when
        the newer one is full, so words that come back stay."""
        if len(self.words) > KEEP:
            self.older, self.words = self.words, {}
        plain, heads, other = [], [], []
        for w in itertools.filterfalse(self.words.__contains__, words):
            if (ids := self.older.get(w)) is not None:
                self.words[w] = ids
            elif w.isalpha():
                plain.append(w)
            elif w[:1] == "\n" and w[1:].isalpha():
                heads.append(w)
            else:
                other.append(w)
        ids = self._merged([" " + w for w in plain] + [w[1:] for w in heads])
        line_feed = self.line_feed.tobytes()
        self.words.update(zip(plain, ids))
        self.words.update((w, line_feed + x) for w, x in zip(heads, ids[len(plain):]))
        whole = self._encode([w if w[:1] == "\n" else " " + w for w in other])
        self.words.update(zip(other, (x.tobytes() for x in whole)))

    def _ids(self, words: pa.Array) -> list[bytes]:
        """The ids of different words: those of the letters, then of the signs."""
        found = pc.extract_regex(words, _WORD)
        letters = pc.coalesce(pc.struct_field(found, "letters"), words).dictionary_encode()
        signs = pc.coalesce(pc.struct_field(found, "signs"), "").dictionary_encode()
        known, tails = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (letters, signs))
        self._learn(known)
        tail = dict(zip(filter(None, tails), self._merged([t for t in tails if t]))) | {"": b""}
        first = np.array([*map(self.words.__getitem__, known), None], object)[letters.indices.to_numpy()]
        return (first + np.array([*map(tail.__getitem__, tails), None], object)[signs.indices.to_numpy()]).tolist()

    def many(self, docs: list[str]) -> list[np.ndarray]:
        """The ids of each text.  A batch's words are numbered by Arrow, so each
        different word is looked up once, and the ids are put together by numpy.
        A text's first word gets a line feed, whose id goes again; where spaces
        stand side by side or at an end, it goes through the whole tokenizer."""
        whole = pa.array(docs, pa.string())
        odd = pc.match_substring_regex(whole, _ODD).to_numpy(zero_copy_only=False)
        lines = pc.replace_substring(whole.filter(pa.array(~odd)), "\n", " \n")
        plain = pc.split_pattern(pc.binary_join_element_wise("\n", lines, ""), " ")
        other = [_CUT.split(d) for d, o in zip(docs, odd) if o]
        firsts = self._encode([words[0] for words in other])
        lists = pa.concat_arrays([plain, pa.array([words[1:] for words in other], plain.type)])
        order = np.argsort(odd, kind="stable")       # the text of each list
        coded = lists.values.dictionary_encode()
        ids = self._ids(coded.dictionary)
        number = coded.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        base = np.cumsum(size) - size
        count = size[number]
        out = np.concatenate([[0], np.cumsum(count)])
        kind = np.int32 if max(out[-1], size.sum()) < 1 << 31 else np.int64
        at = np.repeat((base[number] - out[:-1]).astype(kind), count)
        at += np.arange(out[-1], dtype=kind)
        flat = np.frombuffer(b"".join(ids), "<u4")[at]
        ends = out[lists.offsets.to_numpy()].tolist()
        result = [None] * len(docs)
        for n, (k, s, e) in enumerate(zip(order.tolist(), ends, ends[1:])):
            result[k] = flat[s + 1:e] if n < len(plain) else np.concatenate([firsts[n - len(plain)], flat[s:e]])
        return result


@functools.lru_cache(1)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = (len(ids) - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, len(ids), capacity))]


def pieces(docs: DataFrame, path: str, capacity: int, separator: int) -> DataFrame:
    """doc_id, locator, piece, start, length, ids_crc32, ids of every piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tokens = tokens_of(path)
        end = np.array([separator], "<u4")
        for b in gathered(batches, BATCH):
            src, piece, start, length, crc, flat = [], [], [], [], [], []
            for k, ids in enumerate(tokens.many(texts(b))):
                ids = np.concatenate([ids, end])
                flat.append(ids)
                for n, (s, size) in enumerate(cut(ids, capacity)):
                    src.append(k)
                    piece.append(n)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(ids[s:s + size].tobytes()))
            src = pa.array(src, pa.int64())
            values = pa.array(np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32))
            at = pa.array(np.cumsum([0, *length]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(src), b.column(FILE).take(src), b.column(ROW).take(src),
                 pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.ListArray.from_arrays(at, values)],
                ["doc_id", FILE, ROW, "piece", "start", "length", "ids_crc32", "ids"])
            del b, ids, flat, src, values, at
            hand_back()

    return docs.mapInArrow(run, f"doc_id {kind}, {FILE} string, {ROW} bigint, piece int, start bigint, length bigint, "
                                "ids_crc32 bigint, ids array<int>")


# --- bounds and packing -------------------------------------------------------------------------
def lower_bound(lengths: np.ndarray, capacity: int, max_k: int = MAX_K) -> int:
    """``histogram_bound`` of some lengths."""
    return histogram_bound(np.bincount(lengths, minlength=capacity + 1)[:capacity + 1], capacity, max_k)


def histogram_bound(count: np.ndarray, capacity: int, max_k: int = MAX_K) -> int:
    """The largest bound of the dual feasible functions u(k) after U(eps), in
    whole numbers: u(k) is counted in 1 / (k * capacity) sequences.  ``count``
    has the number of pieces of each length up to the capacity."""
    count = count.astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    eps = np.arange(0, capacity // 2 + 1)
    large = count[::-1].cumsum()[::-1]                     # pieces of at least so many ids
    over = np.concatenate([large, [0]])[capacity - eps + 1]   # longer than capacity - eps
    best = 0
    for k in range(0, max_k + 1):
        if k == 0:                                         # u(0): the length itself
            value, one = x, capacity
        else:
            scaled = (k + 1) * x
            value, one = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity), k * capacity
        total = np.concatenate([[0], (count * value).cumsum()])
        middle = total[capacity - eps + 1] - total[eps]    # lengths from eps to capacity - eps
        best = max(best, int((-(-(middle + over * one) // one)).max()))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, longest first, ties in the given order;
    each goes where it leaves the least room."""
    seq, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]      # sequences by free ids
    free = 0                                                       # bit r: some sequence has r free
    n = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fit = free >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            s = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, s = capacity, n
            n += 1
        seq[k], offset[k] = s, capacity - r
        if r > size:
            room[r - size].append(s)
            free |= 1 << r - size
    return seq, offset


_PACKED = ("doc_id {0}, " + f"{FILE} string, {ROW} bigint, " + "piece int, start bigint, length bigint, "
           "ids_crc32 bigint, part bigint, seq bigint, offset bigint, fill bigint, used bigint, bound bigint, "
           "open boolean, gap boolean")
_ITEM = ["doc_id", FILE, ROW, "piece", "start", "length", "ids_crc32"]


def _pack_part(capacity: int):
    def run(table):
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "length", "ids_crc32", ROW, FILE)])
        lengths = table.column("length").to_numpy()
        seq, offset = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(seq, lengths).astype(np.int64)
        used, bound = len(fill), lower_bound(lengths, capacity)
        open_seq = fill < capacity
        gap = open_seq.copy()
        if used == bound:
            gap[:] = False
            gap[np.argmin(fill)] = fill.min() < capacity
        n = len(lengths)
        for name, x in (("seq", seq), ("offset", offset), ("fill", fill[seq]), ("used", np.full(n, used)),
                        ("bound", np.full(n, bound)), ("open", open_seq[seq]), ("gap", gap[seq])):
            table = table.append_column(name, pa.array(x))
        return table
    return run


def _sequences(placed: DataFrame) -> int:
    return placed.where("offset = 0").count()


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def pack(items: DataFrame, folder: str, capacity: int, target: int) -> DataFrame:
    """The items with sequence_id and offset, after all rounds."""
    kind = items.schema["doc_id"].dataType.simpleString()
    lengths = items.groupBy("length").count().collect()          # at most one row per length up to the capacity
    counts = np.zeros(capacity + 1, np.int64)
    for r in lengths:
        counts[r["length"]] = r["count"]
    bound = histogram_bound(counts, capacity)
    settled, total = [], 0                     # frames whose sequences stay, and how many these are
    number, failed, release = 0, 0, "gap"
    todo = standing = floor = None
    while bound:
        source = items if todo is None else todo
        parts = max(1, math.ceil(source.count() / (target << min(number, WIDER))))
        deal = F.xxhash64("doc_id", "piece", "length", "ids_crc32", ROW, F.lit(number))
        dealt = source.withColumn("part", F.pmod(deal, F.lit(parts)))
        packed = save(dealt.groupBy("part").applyInArrow(_pack_part(capacity), _PACKED.format(kind)),
                      f"{folder}/round-{number}")
        packed = packed.withColumn("sequence_id", F.lit(number) * F.lit(1 << 56) + F.col("part") * F.lit(1 << 24)
                                   + F.col("seq"))
        # sequences of this round in all, and those whose pieces are dealt again
        used, opened = packed.where("offset = 0").agg(
            F.count(F.lit(1)), F.sum(F.col(release).cast("long"))).first()
        if floor is None or used < floor:
            settled.append(packed.where(f"not {release}"))
            standing, total, floor, failed = packed.where(release), total + used - opened, opened, 0
            todo = standing.select(*_ITEM)
        else:                                  # no sequence saved: the round before stands
            failed += 1
        number += 1
        if total + floor <= bound or (release == "open" and (failed == 2 or parts == 1 or floor < 2)):
            break
        if release == "gap" and (failed or parts == 1 or floor < 2):
            # nobody with a gap is left to exchange with: the certified ones open too
            open_now = [*(f.where("open") for f in settled), standing.where("open")]
            settled = [*(f.where("not open") for f in settled), standing.where("not open")]
            standing, release, failed = _union(open_now), "open", 0
            floor, total = _sequences(standing), total + floor
            total -= floor
            if floor < 2:
                break
            todo = standing.select(*_ITEM)
    if not settled:
        return items.limit(0).select(*_ITEM, F.lit(0).cast("long").alias("sequence_id"),
                                     F.lit(0).cast("long").alias("offset"))
    return _union([f.select(*_ITEM, "sequence_id", "offset") for f in (*settled, standing)])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   capacity: int = CAPACITY, separator: int = SEPARATOR, target: int = TARGET,
                   with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, locator, piece, start, length, ids_crc32,
    sequence_id, offset[, ids]."""
    spark = docs.sparkSession
    prepare(spark)
    folder = run_dir(spark, "packing")
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    cutted = save(pieces(located(docs, *id_and_text(docs, id_col, text_col)), path, capacity, separator),
                  f"{folder}/pieces")
    placed = pack(cutted.select(*_ITEM), folder, capacity, target)
    if not with_ids:
        return placed
    return placed.join(cutted.select(FILE, ROW, "piece", "ids"), [FILE, ROW, "piece"])
