"""Operator 2, URL filters: a bit-parallel wildcard automaton.

Glob rules (``*``: any characters, ``?``: one, anything else: itself) are
packed into one bit mask of as many 64-bit words as needed, a bit per rule
position.  For every byte value a mask says which positions accept it.  All
rules run at once over a URL: shift the set of live positions by one, keep
those that accept the byte, keep live stars.  Numpy arrays hold the live sets
of a whole batch of URLs, so that one step advances all rules in all URLs.

A URL is canonical as host + path: the host is what stands after the first
``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path is the
rest up to ``?``, ``#`` or the end.  Null, or no ``://``: both are empty.

Rules (host, path, verdict) fit a host and its subdomains, if the path starts
with the rule's; each becomes two globs, and the longest rule that matches
wins.  Without a rule the method's own globs decide: the verdict of the
longest that matches, else ``allow``.  Repeated rows get equal verdicts; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

# --- fixed values: the rules of the query ----------------------------------
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))
# globs over host + path for URLs without a rule: pages that hold no prose of their own
GLOBS = (("*/cgi-bin/*", "block"), ("*/wp-admin/*", "block"), ("*/login*", "block"), ("*/cart/*", "block"),
         ("*casino-*", "block"), ("*adult-*", "block"), ("*free-bets*", "block"), ("*spam-*", "block"))

_HOST = re.compile(r"://([^/?#]*)([^?#]*)")
_UPPER = {c: c + 32 for c in range(65, 91)}


def canonical(url: str | None) -> tuple[str, str]:
    m = _HOST.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


class Automaton:
    """Multiword Shift-And over all globs."""

    def __init__(self, globs: list[str]):
        self.globs = [re.sub(r"\*+", "*", g).encode() for g in globs]
        steps = [[c for c in g if c != 42] for g in self.globs]       # one bit for each character that is no star
        self.first = np.cumsum([0, *(len(s) + 1 for s in steps)])      # and one in front: the start of the glob
        self.words = max(1, -(-int(self.first[-1]) // 64))
        self.accept = np.zeros((256, self.words), np.uint64)
        self.start, self.loop = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.end = []
        for g, at in zip(self.globs, self.first):
            bit = int(at)
            self._set(self.start, bit)
            for c in g:
                if c == 42:
                    self._set(self.loop, bit)                          # a live bit here stays live
                    continue
                bit += 1
                for v in range(256) if c == 63 else [c]:
                    self._set(self.accept[v], bit)
            self.end.append((bit // 64, np.uint64(1 << bit % 64)))

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << bit % 64)

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """For each URL and glob: does the whole URL match?"""
        out = np.zeros((len(urls), len(self.globs)), bool)
        size = np.array([len(u) for u in urls])
        order = np.argsort(-size, kind="stable")                       # long ones first: the live part is a prefix
        buf = np.frombuffer(b"".join(urls), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)[:-1]])[order] if len(urls) else size
        size = size[order]
        live = np.tile(self.start, (len(urls), 1))
        for step in range(int(size[0]) if len(urls) else 0):
            n = int(np.searchsorted(-size, -step, side="left"))        # URLs longer than step
            now = live[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)               # carry into the next word
            live[:n] = (moved & self.accept[buf[at[:n] + step]]) | (now & self.loop)
        for k, (word, bit) in enumerate(self.end):
            out[order, k] = live[:, word] & bit != 0
        return out


def rule_globs(rules) -> list[str]:
    """Two globs for each rule: the host itself and its subdomains."""
    return [g for host, path, _ in rules for g in (f"{host}{path}*", f"*.{host}{path}*")]


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
                 globs=GLOBS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, glob."""
    prepare(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    name = [h + p for h, p, _ in rules]
    by_size = sorted(range(len(rules)), key=lambda k: -len(name[k]))
    glob_by_size = sorted(range(len(globs)), key=lambda k: -len(globs[k][0]))

    def run(batches):
        # the host and the path are joined by a byte that no URL holds, so that a rule's host ends where the host does
        hosts = Automaton([g.replace("/", "\0/", 1) for g in rule_globs(rules)])
        own = Automaton([g for g, _ in globs])
        for b in batches:
            parts = [canonical(u) for u in b.column("url").to_pylist()]
            fits = hosts.matches([f"{h}\0{p}".encode() for h, p in parts]).reshape(len(parts), -1, 2).any(axis=2)
            found = own.matches([f"{h}{p}".encode() for h, p in parts])
            rule = [next((k for k in by_size if row[k]), None) for row in fits]
            glob = [next((k for k in glob_by_size if row[k]), None) for row in found]
            verdict = [rules[r][2] if r is not None else globs[g][1] if g is not None else "allow"
                       for r, g in zip(rule, glob)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), pa.array([h for h, _ in parts], pa.string()),
                 pa.array([p for _, p in parts], pa.string()),
                 pa.array([None if r is None else name[r] for r in rule], pa.string()),
                 pa.array(verdict, pa.string()),
                 pa.array([None if g is None else globs[g][0] for g in glob], pa.string())],
                ["page_id", "host", "path", "rule", "verdict", "glob"])

    return pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url")).mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string, glob string")


def sql(rules=RULES, globs=GLOBS) -> str:
    """The same verdicts as DuckDB SQL over ``pages``."""
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
            for h, p, _ in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    rule = " ".join(f"WHEN {f} THEN '{h + p}'" for f, (h, p, _) in
                    zip(fits, sorted(rules, key=lambda r: -len(r[0] + r[1]))))
    verdict = " ".join(f"WHEN rule = '{h + p}' THEN '{v}'" for h, p, v in rules)
    ordered = sorted(globs, key=lambda g: -len(g[0]))
    glob = " ".join(f"WHEN (host || path) GLOB '{g}' THEN '{g}'" for g, _ in ordered)
    own = " ".join(f"WHEN \"glob\" = '{g}' THEN '{v}'" for g, v in ordered)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://')
                       THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM cut),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {glob} END AS "glob" FROM parts)
SELECT page_id, host, path, rule, CASE {verdict} {own} ELSE 'allow' END AS verdict, "glob" FROM ruled"""
