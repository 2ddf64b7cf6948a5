"""Operator 5, secret scans: fixed patterns plus a token-efficiency test.

Ordinary words and names take few tokens of a byte-pair vocabulary, random
strings many.  A run of ``shortest`` or more characters with letters and fewer
characters a token under a tiktoken vocabulary than ``limit`` asks of its
length (``ratio`` from 16 characters on, less for shorter runs, whose ratios
spread wider; less for letters of one case alone, as long words of natural
languages need) is reported as kind ``random``, by itself where a label stands before it (cut at
``=``; at ``_``, ``-`` and ``/`` if the whole run takes few tokens), unless it is a known digest or identifier: a
hexadecimal string of a digest's length (MD5, SHA-1, SHA-2), a labelled digest
(``sha256-...``), a UUID, a part of an address (URL path, e-mail, host), or a
number or date with separators.  An address is a whole match around the run:
a host and path behind ``://``, ``name@host.tld``, or a lower-case dotted host
whose labels take few tokens; a dot beside a run makes none, nor does a user's
password before the host or a query behind the path.  The fixed patterns
(kinds ``assign``, ``access``, ``hex``) always stay.

Spans are code points, end exclusive, of the whole match.  Null text counts as
empty and has no span.  Repeated rows get equal results; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import itertools
import re

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import Recent, id_and_text, prepare, texts

# --- fixed values: the patterns of the base scan ------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")          # runs are maximal: shorter ones fail
KINDS = ("assign", "access", "hex", "random")

VOCABULARY = "byte_bpe_50k.tiktoken"
RATIO, SHORTEST, LETTERS = 1.9, 8, 1.75
SURE = 16                                   # from this length on a ratio spreads little
STEP, LETTERS_SHORT, LETTERS_STEP = 0.04, 1.6, 0.05      # limits below it: measured, see the README
KNOWN_RUNS = 1 << 16                        # runs whose number of tokens is kept in a task
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|"
                     r"[0-9a-fA-F]{128}|(?:md5|sha1|sha224|sha256|sha384|sha512)[-=:_][A-Za-z0-9+/=]+)\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_NUMBER = re.compile(r"[0-9+/_=-]*[A-Z]?[0-9+/_=-]*\Z")
_WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/][A-Za-z]+|[-_/][0-9]+)+\Z")
_URL = re.compile(r"""(?<=[A-Za-z0-9])://(?:[^\s/?#"'<>@]*+@)?([^\s?#"'<>()\[\]{}|\\^`,;]++)""")
_AT = re.compile(r"@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}")
_NAME = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_HOST = re.compile(r"""(?<![\w.@-])((?:[a-z0-9-]{1,63}+\.)+[a-z]{2,63})(?![\w@-])(?:[:/][^\s?#"'<>()\[\]{}|\\^`,;]*+)?""")
_PIECE = re.compile(r"[^=]+=*")
_PLAIN = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)=*\Z")
LABEL = 8                                   # shorter labels of a host hold too little to be weighed


@functools.lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(8)
def _runs(shortest: int) -> tuple[re.Pattern, re.Pattern]:
    """Runs, and parts of runs, of at least so many characters."""
    return re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % shortest), re.compile(r"[^/_=-]{%d,}" % shortest)


@functools.lru_cache(KNOWN_RUNS)
def _counted(enc: tiktoken.Encoding, run: str) -> int:
    return len(enc.encode_ordinary(run))


def n_tokens(enc: tiktoken.Encoding, run: str) -> int:
    """How many tokens a run takes; recent answers for short runs are kept."""
    return _counted(enc, run) if len(run) < 64 else len(enc.encode_ordinary(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def limit(run: str, ratio: float) -> float:
    """The characters a token below which a run of its length is random."""
    short = max(0, SURE - len(run))
    if _PLAIN.match(run):
        return min(ratio, LETTERS_SHORT - LETTERS_STEP * short if short else LETTERS)
    return ratio - STEP * short


def cheap(run: str, enc: tiktoken.Encoding, ratio: float) -> bool:
    return len(run) >= limit(run, ratio) * n_tokens(enc, run)


def addresses(text: str, enc: tiktoken.Encoding, ratio: float) -> tuple[list[int], list[int]]:
    """Starts of the hosts with their paths and of the e-mail addresses, in
    order, and for each the furthest end of all up to it."""
    out, taken, done = [], [], 0
    for m in _URL.finditer(text):
        out.append(m.span(1))
        taken.append(m.span())                    # what stands before the host is no e-mail's name
    for m in _AT.finditer(text):
        if not any(a <= m.start() < b for a, b in taken[bisect.bisect(taken, (m.start(), len(text))) - 1:][:1]):
            # a local part has 64 characters at most
            name = _NAME.search(text[max(done, m.start() - 64):m.start()])[0]
            if name:
                out.append((m.start() - len(name), m.end()))
        done = m.end()
    for m in _HOST.finditer(text):
        if all(len(label) < LABEL or cheap(label, enc, ratio) for label in m[1].split(".")):
            out.append(m.span())
    out.sort()
    return [a for a, _ in out], list(itertools.accumulate((b for _, b in out), max))


def identifier(run: str) -> bool:
    """A digest, a UUID, or a number or date."""
    return bool(_DIGEST.match(run) or _UUID.match(run) or _NUMBER.match(run))


def known(run: str) -> bool:
    """An identifier, or words with separators."""
    return bool(identifier(run) or _WORDS.match(run))


def is_random(run: str, enc: tiktoken.Encoding, ratio: float) -> bool:
    """Whether a run is no digest or identifier and takes many tokens.  A
    slash may be a digit of base64 or part a path, whose parts are words: what
    stands between slashes is weighed without them and without what is known.
    More than a slash in four characters is a list."""
    if known(run) or cheap(run, enc, ratio):
        return False
    if "/" not in run:
        return True
    parts = [p for p in run.split("/") if p and not known(p)]
    return (4 * run.count("/") <= len(run)
            and sum(map(len, parts)) < limit(run, ratio) * sum(n_tokens(enc, p) for p in parts))


def random_parts(text: str, s: int, e: int, enc: tiktoken.Encoding, ratio: float, shortest: int):
    """(start, end) of the random strings of a run without its labels: of each
    piece between equals signs all, or the parts that are random by themselves."""
    if identifier(text[s:e]):
        return
    for piece in _PIECE.finditer(text, s, e):
        run = piece[0]
        if len(run) < shortest or not re.search("[A-Za-z]", run):
            continue
        if is_random(run, enc, ratio):
            yield piece.span()
        elif not identifier(run):
            for m in _runs(shortest)[1].finditer(text, *piece.span()):
                if m[0] != run and re.search("[A-Za-z]", m[0]) and is_random(m[0], enc, ratio):
                    yield m.span()


def random_spans(text: str, enc: tiktoken.Encoding, ratio: float, base: list[tuple[int, int, int]],
                 shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    out, found = [], None
    for m in _runs(shortest)[0].finditer(text):
        s, e = m.span()
        while e > s and text[s] in "+/_=-":
            s += 1
        while e > s and text[e - 1] in "+/_-":
            e -= 1
        if e - s < shortest or any(a <= s and e <= b for a, _, b in base):
            continue
        for s, e in random_parts(text, s, e, enc, ratio, shortest):
            if any(a <= s and e <= b for a, _, b in base):
                continue
            found = addresses(text, enc, ratio) if found is None else found
            k = bisect.bisect(found[0], s)
            if not k or found[1][k - 1] < e:
                out.append((s, 3, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each span (overlapping ones together) replaced."""
    out, done = [], 0
    for s, _, e in sorted(spans):
        if s >= done:
            out += [text[done:s], mark]
        done = max(done, e)
    return "".join(out) + text[done:]


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def scanner(path: str, ratio: float, shortest: int = SHORTEST):
    enc = encoding(path)

    def scan(text: str):
        base = base_spans(text)
        return base, sorted(base + random_spans(text, enc, ratio, base, shortest))
    return scan


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                ratio: float = RATIO, shortest: int = SHORTEST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex,
    n_random, base_spans, base_sha256, spans."""
    prepare(docs.sparkSession)
    path, kind = _path(vocabulary), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scan = scanner(path, ratio, shortest)
        for b in batches:
            found = [scan(t) for t in texts(b)]
            counts = [pa.array([sum(k == n for _, k, _ in every) for _, every in found], pa.int64()) for n in range(4)]
            base = [joined(x) for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array(base, pa.string()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                 pa.array([joined(x) for _, x in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "base_sha256", "spans"])

    return docs.select(*id_and_text(docs, id_col, text_col)).mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_spans string, "
             "base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, ratio: float = RATIO,
           length_col: str | None = None, shortest: int = SHORTEST) -> DataFrame:
    """All rows and columns of ``docs``, every span of the text replaced by
    ``[secret]``; the length in ``length_col``, if named, follows.  Texts
    without a span, null texts included, stay as they are."""
    prepare(docs.sparkSession)
    path, schema = _path(vocabulary), docs.schema
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(length_col) if length_col else None

    def run(batches):
        scan = scanner(path, ratio, shortest)
        for b in batches:
            cols = list(b.columns)
            old = cols[at].to_pylist()
            new = [t and redacted(t, scan(t)[1]) for t in old]
            cols[at] = pa.array(new, cols[at].type)
            if size_at is not None:
                size = cols[size_at].to_pylist()
                cols[size_at] = pa.array([len(n) if n != o else s for n, o, s in zip(new, old, size)],
                                         cols[size_at].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, schema)
