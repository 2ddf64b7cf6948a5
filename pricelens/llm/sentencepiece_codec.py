"""Operator 7, SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a text once; at each position
its output links name every piece that ends there, and each relaxes the best
score of the position (Viterbi over the sum of the pieces' scores).  Ties go
to the piece that starts first.  A character that no piece covers takes the
unknown score (ten below the lowest) and becomes byte pieces.

Spaces are written as U+2581 and one is put in front, as the model says.  No
piece holds U+2581 behind another character, so the best path of a text is the
best paths of its words, one after the other; recent words are kept, so that
a frequent one is decoded once.  (Where a vocabulary has such a piece, texts
go through the automaton whole.)

Decoding joins pieces and bytes, writes U+2581 as a space and takes the first
one away.  Null text counts as empty: no ids.  Repeated rows get equal ids;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import Recent, id_and_text, prepare, texts

MODEL = "piece_bpe_32k.model"
MARK = "▁"
KEEP = 200_000                    # words whose ids are kept in a worker


class Codec:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces))
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {i: sp.get_score(i) for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_of = {i: v for v, i in self.byte.items()}
        self.unk, self.unknown = sp.unk_id(), min(self.score.values()) - 10
        self.control = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.machine = ahocorasick.Automaton()
        for i in plain:
            self.machine.add_word(self.pieces[i], (i, len(self.pieces[i]), self.score[i]))
        self.machine.make_automaton()
        self.by_word = not any(MARK in self.pieces[i].lstrip(MARK) for i in plain)
        self._ids = Recent(lambda word: np.array(self.path(word), "<u4").tobytes(), KEEP).__getitem__

    def path(self, text: str) -> list[int]:
        """Ids of the best path; ``text`` is escaped already."""
        n = len(text)
        best, via = [0.0] + [None] * n, [None] * (n + 1)
        found = self.machine.iter(text)
        nxt = next(found, None)
        for end in range(n):
            top, how = None, None
            while nxt is not None and nxt[0] == end:
                piece, size, score = nxt[1]
                got = best[end + 1 - size] + score
                # output links go from the longest piece down: on ties the earliest start stays
                if top is None or got > top:
                    top, how = got, (end + 1 - size, piece)
                nxt = next(found, None)
            got = best[end] + self.unknown
            if (how is None or how[0] != end) and (top is None or got > top):
                top, how = got, (end, self.unk)
            best[end + 1], via[end + 1] = top, how
        out, at = [], n
        while at:
            start, piece = via[at]
            if piece == self.unk and self.byte:
                out += [self.byte[b] for b in reversed(text[start:at].encode())]
            else:
                out.append(piece)
            at = start
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        escaped = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return np.array(self.path(escaped), "<u4")
        words = escaped.split(MARK)[1:]
        if "" in words:                                   # runs of spaces may be one piece: keep them together
            return np.frombuffer(b"".join(map(self._ids, re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", escaped))), "<u4")
        return np.frombuffer(b"".join(map(self._ids, [MARK + w for w in words])), "<u4")

    def decode(self, ids) -> str:
        out, raw = [], []
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(bytes(raw).decode(errors="replace"))
                raw = []
            if i not in self.control:
                out.append(self.pieces[i])
        if raw:
            out.append(bytes(raw).decode(errors="replace"))
        text = "".join(out)
        return (text[1:] if text.startswith(MARK) else text).replace(MARK, " ")


@functools.lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def sp_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids."""
    prepare(docs.sparkSession)
    path, kind = model or public_tokenizers.path(MODEL), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = [c.encode(t) for t in texts(b)]
            at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "ids"])

    return docs.select(*id_and_text(docs, id_col, text_col)).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def sp_decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of its ids, and
    ``ids_crc32`` of the ids as little-endian unsigned 32-bit numbers."""
    prepare(encoded.sparkSession)
    path = model or public_tokenizers.path(MODEL)
    at = encoded.columns.index(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches):
        c = codec(path)
        for b in batches:
            rows = [np.array(x or [], "<u4") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([c.decode(x.tolist()) for x in rows], pa.string()),
                 pa.array([zlib.crc32(x.tobytes()) for x in rows], pa.int64())],
                [*b.schema.names, "decoded", "ids_crc32"])

    return encoded.mapInArrow(run, schema + ", decoded string, ids_crc32 bigint")


def sp_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  model: str | None = None) -> DataFrame:
    """Encode, then decode the ids, and compare with the text: one row per row
    of ``docs`` with doc_id, ids, ids_crc32, round_trip.  The whole text passes
    to the encoding and the decoding side by side, so no join is needed."""
    spark = docs.sparkSession
    prepare(spark)
    path, kind = model or public_tokenizers.path(MODEL), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for b in batches:
            own = texts(b)
            ids = [c.encode(t) for t in own]
            at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                 pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                 pa.array([c.decode(x.tolist()) == t for x, t in zip(ids, own)], pa.bool_())],
                ["doc_id", "ids", "ids_crc32", "round_trip"])

    return docs.select(*id_and_text(docs, id_col, text_col)).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, ids_crc32 bigint, round_trip boolean")
