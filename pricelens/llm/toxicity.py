"""Operator 6, toxicity: noisy-channel deobfuscation, then scoring.

Writers hide words by leetspeak ("1d10t"), spacing ("i d i o t", "i.d.i.o.t")
and repetition ("iiidiooot").  The channel: each written character may stand
for several intended ones (a digit or sign for itself or for a letter, a
separator beside a single letter for nothing, a run of equal letters for one or
two).  A character language model of order 4, counted over *all* texts of the
table, says which intended text is likely.  Viterbi decoding over the lattice of intended characters, with the
model's last three characters as state, gives the restored text; only spans
that look obfuscated have more than one path, all others stand as written.

The restored text is scored by a logistic regression (FTRL) over the presence
of its words.  It learns from at most ``sample_rows`` labelled rows outside
the held-out fifth (crc32 of the id, modulo 5, is 0 for held-out rows), in
the order of a hash of the id; labels, language, source and id are no inputs
of a score.

Null text counts as empty; an empty text's score is the bias alone.  Without
labels every score is 0.5.  Repeated rows get equal scores, an empty table an
empty result.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, doc_mod, grouped, id_and_text, labelled_sample, prepare, texts, token_hashes
from .ftrl import Settings, probability, train

SETTINGS = Settings(bits=20, alpha=2.0, beta=1.0, l1=8.0, l2=0.0, epochs=6, shards=1)
SAMPLE_ROWS = 12_000
THRESHOLD = 0.5

# --- character language model ------------------------------------------------------------------
ORDER, SYMBOLS = 4, 28                       # symbols: 0 word boundary, 1-26 letters, 27 other letters
EVEN = 0.5                                   # share of the model in which all symbols are as likely
_OTHER = 27


def _symbol(c: str) -> int:
    low = c.lower()
    plain = unicodedata.normalize("NFKD", low)[:1]
    if "a" <= plain <= "z":
        return ord(plain) - 96
    return _OTHER if c.isalpha() else 0


_LOW = np.array([_symbol(chr(i)) for i in range(0x250)], np.uint8)


def symbols(text: str) -> np.ndarray:
    """The text's symbols; a run of non-letters is one boundary."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(code), _OTHER, np.uint8)
    low = code < len(_LOW)
    out[low] = _LOW[code[low]]
    out = np.concatenate([[0], out, [0]])
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def gram_counts(docs: list[str]) -> np.ndarray:
    """Counts of all 4-grams of symbols, as a dense array of 28 ** 4."""
    s = symbols("\n".join(docs)).astype(np.int64)
    at = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
    return np.bincount(at, minlength=SYMBOLS ** ORDER)


def char_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts: each task sums its own counts first, so the
    shuffle holds at most 28 ** 4 rows a task."""
    def run(batches):
        total = np.zeros(SYMBOLS ** ORDER, np.int64)
        for b in batches:
            total += gram_counts(texts(b))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """log P(symbol | three symbols before), interpolated over the orders."""

    def __init__(self, counts: np.ndarray):
        c = counts.astype(np.float64).reshape((SYMBOLS,) * ORDER)
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for k in range(1, ORDER + 1):
            own = c.sum(axis=tuple(range(ORDER - k))) if k < ORDER else c
            total = own.sum(axis=-1, keepdims=True)
            kinds = (own > 0).sum(axis=-1, keepdims=True)
            p = (own + kinds * p) / np.maximum(total + kinds, 1) + (total == 0) * p      # Witten-Bell
        # a writer's words need not be the corpus's: no letter is ever out of the question
        self.log = np.log((1 - EVEN) * p + EVEN / SYMBOLS).astype(np.float32)


def fit_model(docs: DataFrame) -> np.ndarray:
    counts = np.zeros(SYMBOLS ** ORDER, np.int64)      # at most 28 ** 4 rows reach the driver
    for r in char_counts(docs).toLocalIterator():
        counts[r["gram"]] = r["n"]
    return CharModel(counts).log


# --- the channel ----------------------------------------------------------------------------------
# What a written character may stand for, besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz",
        "#": "abcdefghijklmnopqrstuvwxyz", "%": "abcdefghijklmnopqrstuvwxyz"}
_SIGN, _LETTER, _SEPARATOR, _BLANK = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in LEET]] = _SIGN
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[[ord(c) for c in "._-~/"]] = _SEPARATOR
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
# What parts words; '(' opens one and may be a letter inside it.
_OPEN, _CLOSE = b" \t\n\r\x0b\x0c\"',;:()[]{}<>?", b" \t\n\r\x0b\x0c\"',;:)[]{}<>?"
_STARTS, _ENDS = np.zeros(256, bool), np.zeros(256, bool)
_STARTS[[*_OPEN]] = True
_ENDS[[*_CLOSE, *b".!"]] = True
_WIDE = re.compile(rb"\xe2\x80[\x80-\xaf]|\xc2[\xa0\xab\xbb]")      # typographic quotes, dashes and blanks part words too
_FIRST = np.zeros(256, bool)
_FIRST[[*range(48, 58), *map(ord, "@$!|")]] = True
_LAST = np.zeros(256, bool)
_LAST[[*range(48, 58), ord("$"), ord("@")]] = True
_JOINS, _MONEY = np.zeros(256, bool), np.zeros(256, bool)      # a joined word may start or end by these signs
_JOINS[[*b"-_/"]] = True
_MONEY[[*b"$@"]] = True
_ONE = rb"[A-Za-z0-9@$!|+(]"
_SPACED = re.compile(rb"%s(?:[ ._\-~/*]{1,3}%s){2,}(?![A-Za-z0-9\x80-\xff])" % (_ONE, _ONE))
_LETTERS = re.compile(rb"[A-Za-z]")
LONG = 256                      # answers for longer words are not kept
KEY = 16                        # shorter words are no keys
_STRETCHED = re.compile(rb"([A-Za-z])(?:(?i:\1)){3,}")
_ADDRESS = re.compile(rb"(?:(?<=[A-Za-z0-9]):|(?<![^\s\"'(=])(?=//[\w-]+\.))//[^\s\"'<>()\[\]{},;]*+|"
                      rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++\.[A-Za-z]{2,}[\w.-]*+")
_SIGNS = b"!.-_|#*%&$"
_SWAP, _DROP, _MERGE = -1.0, -2.0, -0.7                   # log weights of the channel's moves
_SELDOM = -3.0                                            # digits that seldom stand for letters
_KEPT_DIGIT, _KEPT_SIGN, _KEPT_OTHER = -1.5, -9.0, -1.0   # digits, $ and @, other signs as written


def suspicious(buf: np.ndarray) -> np.ndarray:
    """Positions (in UTF-8 bytes) that touch an obfuscated word: a sign
    between letters, before the first or after the last one; a letter three
    times in a row, three doubled letters in a row, or two that are a word;
    single letters with separators between them."""
    kind = _KIND[buf]
    letter, sign = kind == _LETTER, kind == _SIGN
    pad = lambda a, k: np.concatenate([a[k:], np.zeros(k, a.dtype)])
    start = np.concatenate([[True], _STARTS[buf[:-1]]])
    l1, l2, l3, l4 = (pad(letter, k) for k in (1, 2, 3, 4))
    s1, s2, s3 = (pad(sign, k) for k in (1, 2, 3))
    hit = letter & s1 & (l2 | (s2 & (l3 | (s3 & l4))))
    hit |= start & _FIRST[buf] & (l1 | (s1 & l2))
    end = np.concatenate([_ENDS[buf], np.ones(4, bool)])
    last = _LAST[buf]
    hit |= letter & pad(last, 1) & (end[2:len(buf) + 2] | (pad(last, 2) & end[3:len(buf) + 3]))
    join, money = np.concatenate([[False], _JOINS[buf], np.zeros(3, bool)]), _MONEY[buf]
    hit |= join[:len(buf)] & money & (l1 | (s1 & l2))
    hit |= letter & pad(money, 1) & (join[3:len(buf) + 3] | (pad(money, 2) & join[4:len(buf) + 4]))
    low = buf | 32
    twice = letter & (buf < 128) & (low == pad(low, 1)) & l1
    hit |= twice & pad(twice, 1)
    hit |= twice & pad(twice, 2) & (pad(twice, 4) | (start & end[4:]))
    sep = kind == _SEPARATOR
    hit |= letter & pad(sep, 1) & l2 & pad(sep, 3) & l4
    # three single characters, each at most three separators from the next
    apart = (kind == _SEPARATOR) | (kind == _BLANK) | (buf == 42)
    one = ((letter & (buf < 128)) | sign) & (buf != 42)
    alone = np.flatnonzero(one & np.concatenate([[True], apart[:-1]]) & np.concatenate([apart[1:], [True]]))
    near = np.diff(alone) <= 4
    chain = alone[:-2][near[:-1] & near[1:]] if len(alone) > 2 else alone[:0]
    hit[chain] = True
    return np.flatnonzero(hit)


def _options(c: str) -> list[tuple[int, str, float]]:
    """(symbol, text, weight) that a written character may stand for: a digit or
    sign for itself, which bounds a word, or for a letter."""
    if c in LEET:
        cost = _SWAP if len(LEET[c]) < 3 else _SWAP - np.log(26.0)
        cost += _SELDOM * (c in "2689")
        return [(0, c, _KEPT_DIGIT if c.isdigit() else _KEPT_SIGN if c in "$@" else _KEPT_OTHER), *((ord(x) - 96, x, cost) for x in LEET[c])]
    s = _symbol(c)
    return [(s, c, 0.0)] if s else []


def key(word: bytes) -> bool:
    """Hexadecimal, or base64: capitals, small letters and digits that change often."""
    if len(word) < KEY:
        return False
    changes = len(re.findall(rb"[a-z](?![a-z])|[A-Z](?![A-Z])|[0-9](?![0-9])", word))
    return bool(re.match(rb"(?:0[xX])?[0-9a-fA-F]+\Z", word)
                or (re.search(rb"[0-9]", word) and re.search(rb"[a-z]", word[1:]) and re.search(rb"[A-Z]", word[1:])
                    and 5 * changes > 2 * len(word)))


def doubled(word: str) -> bool:
    """Whether a word's letters are doubled throughout, so that a pair may
    stand for one letter: all, or three at least and two of three."""
    runs = [m.end() - m.start() for m in re.finditer(r"(.)\1*", word, re.S)]
    n = sum(k > 1 for k in runs)
    return n > 1 and (n == len(runs) or n > 2 and 3 * n >= 2 * len(runs))


def _joined(runs: list[str]) -> set[int]:
    """The separators that may stand for nothing: those beside a letter or sign
    that stands alone between separators."""
    cuts = [-1, *(k for k, r in enumerate(runs) if not _options(r[0])), len(runs)]
    return {cuts[k] for k in range(1, len(cuts) - 1) if 2 in (cuts[k] - cuts[k - 1], cuts[k + 1] - cuts[k])}


def decode(span: str, model: np.ndarray) -> str:
    """The likeliest intended text of a span: exact Viterbi over the lattice.
    A state is the last three symbols and, inside a run of three or more equal
    letters, or two in a word that is doubled throughout, how many of them were taken."""
    span = span.lower()
    runs = [m.group() for m in re.finditer(r"(.)\1*", span, re.S)]
    pairs = {k for w in re.finditer(r"[^\W\d_]+", span) if doubled(w[0]) for k in range(*w.span())}
    joined = _joined(runs)
    paths = {((0, 0, 0), 0): (0.0, None)}               # (last symbols, taken) -> score, history
    at = 0
    for n, written in enumerate(runs):
        c = written[0]
        long = c.isalpha() and (len(written) >= 3 or len(written) == 2 and at in pairs)
        at += len(written)
        if long:
            written = written[:3]                       # more equal letters change no weight
        options = _options(c)
        for k in range(len(written)):
            then: dict = {}

            def relax(state, score, history):
                if state not in then or score > then[state][0]:
                    then[state] = (score, history)

            for (ctx, taken), (score, history) in paths.items():
                if c == "*" or n in joined:                                  # a separator stands for nothing
                    relax((ctx, 0), score + _DROP, history)
                if not options:                                              # or for itself, which bounds a word
                    if ctx[2]:
                        relax(((ctx[1], ctx[2], 0), 0), score + model[ctx[0], ctx[1], ctx[2], 0], (c, history))
                    else:
                        relax((ctx, 0), score, (c, history))
                    continue
                if long and k:                                               # one more of the same letter
                    relax((ctx, taken), score + _MERGE, history)
                    if taken >= 2:
                        continue
                for s, out, weight in options:
                    if s == 0 and ctx[2] == 0:                               # a run of non-letters is one boundary
                        relax((ctx, 1), score + weight, (out, history))
                        continue
                    relax(((ctx[1], ctx[2], s), taken + 1 if long and k else 1),
                          score + weight + model[ctx[0], ctx[1], ctx[2], s], (out, history))
            paths = then
        if long:
            best: dict = {}
            for (ctx, _), path in paths.items():
                if (ctx, 0) not in best or path[0] > best[ctx, 0][0]:
                    best[ctx, 0] = path
            paths = best
    last = max(((score + (model[ctx[0], ctx[1], ctx[2], 0] if ctx[2] else 0.0), history)
                for (ctx, _), (score, history) in paths.items()), key=lambda x: x[0])
    out, history = [], last[1]
    while history:
        out.append(history[0])
        history = history[1]
    return "".join(reversed(out))


def _trimmed(word: bytes) -> bytes:
    """A word without the signs that close a sentence."""
    return word.rstrip(_SIGNS if word[-3:] in (b"$$$", b"***", b"%%%", b"###") else b"!.-_|")


class Restorer:
    """Replaces obfuscated spans; keeps recent answers, so that a frequent
    span is decoded once."""

    def __init__(self, model: np.ndarray, keep: int = 50_000):
        def whole(span: bytes) -> bytes:
            written = span.decode(errors="replace")
            text = decode(written, model)
            return span if text == written.lower() else text.encode()      # nothing was hidden

        known = Recent(whole, keep).__getitem__
        # very long words are not kept: their answers have no bound
        self.decoded = lambda span: known(span) if len(span) < LONG else whole(span)

    def spans(self, buf: bytes, first: int, end: int, at: list[int]):
        """(start, end, restored) of the obfuscated spans of one text, which is
        buf[first:end], around the suspicious positions.  Addresses and keys
        stand as written; any other word with such a position is decoded whole,
        however long it is."""
        out = []
        if buf.find(b"//", first, end) >= 0 or buf.find(b"@", first, end) >= 0:
            out = [m.span() for m in _ADDRESS.finditer(buf, first, end)]
        out.append((end, end))
        done, i = first, 0
        for k in at:
            while out[i][1] <= k:
                i += 1
            if k < done or k >= out[i][0]:
                continue
            low, high = max(done, out[i - 1][1] if i else first), out[i][0]
            if (m := _SPACED.match(buf, k, high)) and len(_LETTERS.findall(m.group())) >= 2:
                yield k, m.end(), self.decoded(m.group())
                done = m.end()
                continue
            s, e = k, k
            while s > low and buf[s - 1] not in _OPEN:
                s -= 1
            while e < high and buf[e] not in _CLOSE:
                e += 1
            done = e
            raw = _trimmed(buf[s:e])
            word = _STRETCHED.sub(rb"\1\1\1", raw)
            if len(word) > 1 and not key(word):
                yield s, s + len(raw), self.decoded(word)

    def many(self, docs: list[str]) -> list[str]:
        """All texts with their obfuscated spans restored."""
        raw = [d.encode() for d in docs]
        joined = b"\n".join(raw)
        flat = _WIDE.sub(lambda m: b" " * len(m[0]), joined)
        at = suspicious(np.frombuffer(flat, np.uint8)) if joined else np.empty(0, np.int64)
        ends = np.cumsum([len(r) + 1 for r in raw])
        cut = np.searchsorted(at, np.concatenate([[0], ends]))
        out = list(docs)
        for k in np.flatnonzero(np.diff(cut)):
            first, end = int(ends[k]) - 1 - len(raw[k]), int(ends[k]) - 1
            parts, done = [], first
            for s, e, text in self.spans(flat, first, end, at[cut[k]:cut[k + 1]].tolist()):
                parts += [joined[done:s], text]
                done = e
            out[k] = b"".join([*parts, joined[done:end]]).decode(errors="replace")
        return out


# --- scoring -----------------------------------------------------------------------------------------
def word_rows(docs: list[str], bits: int):
    """The features present in each text: hashes of its words, lower-cased."""
    h, doc = token_hashes([d.lower().encode() for d in docs])
    return (h >> np.uint64(64 - bits)).astype(np.int64), doc


def margins(docs: list[str], w: np.ndarray, bits: int) -> np.ndarray:
    at, doc = word_rows(docs, bits)
    live = w[at] != 0
    pairs = np.unique(np.stack([doc[live], at[live]]), axis=1)
    return np.bincount(pairs[0], w[pairs[1]], minlength=len(docs)) + w[-1]


def features(model: np.ndarray, bits: int):
    restore = Restorer(model)

    def of(docs: list[str]):
        at, doc = word_rows(restore.many(docs), bits)
        for k in range(len(docs)):
            own = np.unique(at[doc == k])
            yield own, np.ones(len(own))
    return of


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", s: Settings = SETTINGS,
        sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The character model of all texts, and the weights."""
    model = fit_model(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)     # 28 ** 4 floats
    weights = train(labelled_sample(docs, labels, label, sample_rows),
                    lambda rows: features(held.value, s.bits)(rows), s)
    return model, weights


def scored(docs: DataFrame, cols: list[str], model: np.ndarray, w: np.ndarray, s: Settings,
           with_text: bool = False) -> DataFrame:
    """``cols`` of ``docs`` (which has a column text) and the score[, restored text]."""
    both = docs.sparkSession.sparkContext.broadcast((model, w))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols) + ", tox_score double"
    schema += ", restored string" * with_text

    def run(batches):
        restore = Restorer(both.value[0])
        for b in batches:
            plain, m = [], []
            for own in grouped(texts(b)):
                own = restore.many(own)
                m.append(margins(own, both.value[1], s.bits))
                plain += own
            score = probability(np.concatenate(m)) if m else np.empty(0)
            out = [b.column(c) for c in cols] + [pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(plain, pa.string())] if with_text else []),
                                             [*cols, "tox_score"] + ["restored"] * with_text)

    return docs.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    s: Settings = SETTINGS, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD,
                    with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted[, restored]."""
    prepare(docs.sparkSession)
    docs = docs.select(*id_and_text(docs, id_col, text_col))
    out = scored(docs, ["doc_id"], *fit(docs, labels, s=s, sample_rows=sample_rows), s, with_text)
    return out.select("doc_id", F.coalesce(doc_mod() == 0, F.lit(False)).alias("held_out"),
                      F.col("tox_score").alias("score"),
                      (F.col("tox_score") >= threshold).cast("int").alias("predicted"),
                      *["restored"] * with_text)
