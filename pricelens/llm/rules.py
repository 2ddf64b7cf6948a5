"""Operator 10, quality rules: line labelling by a linear-chain CRF.

Every line with a word is described by a few binary features (signs, capitals,
digits, length, ending, repeats, an earlier equal line, the words of licence
and site lines).  A conditional random field with two states, content and
boilerplate, scores the whole sequence of a text's lines; Viterbi decoding
marks each line, and a text is kept if its content lines hold at least
``share`` of its characters.  The field is trained here: by gradient ascent on
the sequences' log-likelihood (forward-backward) over at most ``sample_rows``
labelled texts outside the held-out fifth, in the order of a hash of the id,
whose lines count as content in texts of quality 1 and as boilerplate in texts
of quality 0.  The sample is dealt over ``shards`` tasks, whose parameters are
averaged.

Base rules (contract): counts of words, characters, signs, repeated lines and
words in repeated 3-word windows; a text fails with fewer than 50 words or
more than half of its words in repeated windows.

Null text counts as empty: no words, so it fails.  Without labels all lines
count as content.  Repeated rows get equal results; an empty table gives an
empty result.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, labelled_sample, prepare, texts

SIGNS = "#*$%&|<>"
SAMPLE_ROWS, SHARDS, SHARE, STEPS = 4_000, 4, 0.5, 60
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SITE = ("copyright", "license", "licence", "all rights reserved", "cookie", "subscribe", "click here", "sign in",
         "log in", "privacy", "terms of use", "terms of service", "permission is", "warrant")
_SPACE = " \t\n\x0b\x0c\r"
N_FEATURES = 17


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    signs = sum(map(text.count, SIGNS))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        k = len(number)
        if k < 1 << 20:
            window = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
        else:                                              # too many words for one product: number the pairs
            _, pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
            window = pair[:-1] * k + ids[2:]
        order = np.sort(window)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(window, twice))
            hit = np.zeros(n, bool)
            hit[at] = hit[at + 1] = hit[at + 2] = True
            repeat = int(hit.sum())
    return n, chars, signs, dup, repeat


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Binary features of each line with a word, and the lines' characters."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        size = sum(map(len, words))
        n = len(words)
        signs = sum(map(line.count, SIGNS))
        again = sum(map(eq, words, words[1:]))
        digits = sum(map(line.count, "0123456789"))
        low = line.lower()
        rows.append((True, signs == 0, 0 < signs <= 0.02 * size, 0.02 * size < signs <= 0.1 * size,
                     signs > 0.1 * size, n > 2 and line.isupper(), line.count("!") > 0.05 * size, digits > 0.3 * size,
                     n <= 2, 2 < n <= 6, n >= 12, words[-1][-1] in ".!?:", line in seen, 4 * again > n,
                     n >= 8 and 2 * len(set(words)) < n, any(map(low.__contains__, _SITE)), size > 14 * n))
        sizes.append(size)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, N_FEATURES), np.array(sizes, np.int64)


class Field:
    """A two-state linear-chain field: state 0 boilerplate, 1 content."""

    def __init__(self, flat: np.ndarray | None = None):
        flat = np.zeros(2 * N_FEATURES + 6) if flat is None else flat
        self.flat = flat
        self.emit = flat[:2 * N_FEATURES].reshape(N_FEATURES, 2)
        self.move = flat[2 * N_FEATURES:2 * N_FEATURES + 4].reshape(2, 2)
        self.start = flat[2 * N_FEATURES + 4:]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best states (Viterbi); ties go to content."""
        if not len(x):
            return np.empty(0, np.int64)
        e = (x @ self.emit).tolist()
        (aa, ab), (ba, bb) = self.move.tolist()
        a, b = e[0][0] + self.start[0], e[0][1] + self.start[1]
        back = []
        for ea, eb in e[1:]:
            pa_, pb = b + ba >= a + aa, b + bb >= a + ab
            back.append((pa_, pb))
            a, b = max(a + aa, b + ba) + ea, max(a + ab, b + bb) + eb
        out = [int(b >= a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return np.array(out[::-1])


def _gradient(flat: np.ndarray, groups) -> np.ndarray:
    """Mean gradient of the log-likelihood over groups of (features padded to
    one length, mask, state of the text)."""
    f, grad, total = Field(flat), np.zeros_like(flat), 0
    emit, move, start = grad[:2 * N_FEATURES].reshape(N_FEATURES, 2), np.zeros((2, 2)), np.zeros(2)
    for x, live, y in groups:
        d, n = live.shape
        e = x @ f.emit
        alpha, beta = np.zeros((d, n, 2)), np.zeros((d, n, 2))
        alpha[:, 0] = f.start + e[:, 0]
        for k in range(1, n):
            step = np.logaddexp.reduce(alpha[:, k - 1, :, None] + f.move, axis=1) + e[:, k]
            alpha[:, k] = np.where(live[:, k, None], step, alpha[:, k - 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        for k in range(n - 2, -1, -1):
            step = np.logaddexp.reduce(f.move + (e[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(live[:, k + 1, None], step, 0.0)
        p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        gold = np.eye(2)[y][:, None, :] * live[:, :, None]
        emit += np.einsum("dnf,dns->fs", x, gold - p)
        start += (gold[:, 0] - p[:, 0]).sum(axis=0)
        pair = np.exp(alpha[:, :-1, :, None] + f.move + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
        pair *= live[:, 1:, None, None]
        steps = live[:, 1:].sum(axis=1)
        for s in (0, 1):
            move[s, s] += steps[y == s].sum()
        move -= pair.sum(axis=(0, 1))
        total += d
    grad[2 * N_FEATURES:2 * N_FEATURES + 4] = move.reshape(-1)
    grad[2 * N_FEATURES + 4:] = start
    return grad / max(1, total)


PADDED = 1 << 15                 # lines of a group of training texts, padding included


def fit_field(rows: list[tuple[str, int]], steps: int = STEPS, l2: float = 1e-3) -> np.ndarray:
    """Parameters for texts with the state of all their lines."""
    seqs = [(line_features(t)[0], y) for t, y in rows]
    seqs = sorted(((x, y) for x, y in seqs if len(x)), key=lambda s: len(s[0]))
    groups, at = [], 0
    while at < len(seqs):
        # texts of like length, padded to the longest one: at most 64, and at most PADDED lines in all
        many = 1
        while many < 64 and at + many < len(seqs) and (many + 1) * len(seqs[at + many][0]) <= PADDED:
            many += 1
        part, at = seqs[at:at + many], at + many
        n = max(len(x) for x, _ in part)
        x = np.zeros((len(part), n, N_FEATURES))
        live = np.zeros((len(part), n), bool)
        for k, (own, _) in enumerate(part):
            x[k, :len(own)], live[k, :len(own)] = own, True
        groups.append((x, live, np.array([int(y > 0) for _, y in part])))
    flat = np.zeros(2 * N_FEATURES + 6)
    if not groups:
        return flat
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, steps + 1):
        g = _gradient(flat, groups) - l2 * flat
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        flat = flat + 0.2 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return flat


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS,
        shards: int = SHARDS) -> np.ndarray:
    """Average of the shards' parameters, by their rows; a few dozen numbers."""
    def shard(table):
        rows = sorted(zip(table.column("text").to_pylist(), table.column("y").to_pylist()),
                      key=lambda r: (r[0] or "", r[1]))
        flat = fit_field([(t or "", y) for t, y in rows])
        return pa.table({"flat": pa.array([flat.tolist()], pa.list_(pa.float64())),
                         "n": pa.array([len(rows)], pa.int64())})

    parts = (labelled_sample(docs, labels, label, sample_rows)
             .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
             .groupBy("shard").applyInArrow(shard, "flat array<double>, n bigint").collect())
    if not parts:
        return np.zeros(2 * N_FEATURES + 6)
    return np.average([p["flat"] for p in parts], axis=0, weights=[p["n"] for p in parts])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  share: float = SHARE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the five counts, base_failed, kept,
    content_lines (a string of C and B, a letter per line with a word),
    content_share, n_lines."""
    prepare(docs.sparkSession)
    docs = docs.select(*id_and_text(docs, id_col, text_col))
    flat, kind = fit(docs, labels, sample_rows=sample_rows), docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        field = Field(flat)
        for b in batches:
            counts, marks, shares = [], [], []
            for t in texts(b):
                counts.append(base_counts(t))
                x, size = line_features(t)
                state = field.decode(x)
                marks.append("".join("BC"[s] for s in state))
                shares.append(float(size[state == 1].sum() / size.sum()) if len(size) else 0.0)
            cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *cols, pa.array(marks, pa.string()), pa.array(shares, pa.float64())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_lines",
                 "content_share"])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words")
                                               > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (docs.mapInArrow(run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, "
                                 "n_dup_lines bigint, n_repeat_words bigint, content_lines string, content_share double")
            .withColumn("n_lines", F.length("content_lines").cast("bigint")).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("content_share") >= share))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "content_lines", "content_share", "n_lines"))
