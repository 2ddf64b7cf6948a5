"""Operator 11, conversation structure repair: iterative-deepening A*.

A conversation is put into the shape ``(s?(ua)+)?`` of role initials by the
cheapest edits of its rows, taken by turn (nulls first; rows of one turn by
role, then by the text's SHA-256):

    D  delete the row, 3; required of blank and duplicate rows
    I  insert an empty text of the user or assistant, 2
    K  keep the row, 0
    R  rerole the row to user or assistant, 2

A truncated row that is not deleted costs 1 more.  Of the cheapest ways the one
whose letters are least in ASCII order is the answer: a depth-first search
takes the edits in that order under a bound on the cost, and the bound rises to
the least cost that the failed search could not rule out, until a path is
accepted.  The sum of what the remaining rows cost at least is the search's
estimate; a failed (row, role) state keeps the cost proven for it, so no state
is tried again with less to spend.

A long conversation is searched in segments of ``SEGMENT`` rows, from the last
to the first: each segment gives the exact cost from every role state to the
end, which is what leaving the segment before it costs.  One walk forward
then takes each segment's first cheapest path.  The answer is that of one
search over all rows, and the work grows with the number of rows.

No task holds a conversation's texts.  The first pass carries 32-byte digests
instead of texts and holds one byte a row; the second streams the sorted texts
past the edits.  A conversation's edits are one string by definition, and so is
what its digest covers, so its rows stream through one task.

Nulls count as one space (in the id of the damage too); a null id is a
conversation of its own.  An empty role has no initial: such a row is deleted
or reroled.  Equal rows of one turn are each other's duplicates.  Empty and
very long texts are like any other, an empty table gives an empty result, and
columns beside the four that are named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

SEGMENT = 64                 # rows searched at once
HELD = 4 << 20               # characters of text in a batch that is handed on
SPACES = " \t\n\x0b\x0c\r"
ROLES = {2: "user", 3: "assistant"}
# states: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a; what an initial leads to
_STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_NEXT = (2, 2, 3, 2)                             # state behind an inserted or reroled row
_END = (0, 4, 2, 0)                              # cost of the inserts that complete the shape
_PLAIN, _TRUNCATED, _DELETE = 0, 1, 2
_INITIALS = "sua"
_LEAST = (0, 1, 3)                               # the least that a row costs


def code(initial: str, kind: int) -> int:
    """A row as one byte: its role's initial and whether it is truncated or to be deleted."""
    return ((_INITIALS.index(initial) if initial and initial in _INITIALS else 3) << 2) | kind


@lru_cache(None)
def _moves(row: int, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """(edit, rows taken, state, cost) in ASCII order."""
    initial, kind = row >> 2, row & 3
    out = [("D", 1, state, 3), ("I", 0, _NEXT[state], 2)]
    if kind != _DELETE:
        extra = int(kind == _TRUNCATED)
        kept = _STEP[_INITIALS[initial]].get(state) if initial < 3 else None
        if kept is not None:
            out.append(("K", 1, kept, extra))
        out.append(("R", 1, _NEXT[state], 2 + extra))
    return tuple(out)


class _Search:
    """Cheapest edits of some rows, where ``leave`` is the cost of what follows
    in each state."""

    def __init__(self, rows: bytes, leave: tuple[int, ...]):
        self.rows, self.leave = rows, leave
        self.rest = [min(leave)]
        for r in reversed(rows):
            self.rest.append(self.rest[-1] + _LEAST[r & 3])
        self.rest.reverse()
        self.failed: dict[tuple[int, int], int] = {}      # state -> cost that is proven to be needed
        self.found: dict[int, tuple[int, str, int]] = {}

    def need(self, at: int, state: int) -> int:
        return self.failed.get((at, state), self.rest[at])

    def _descend(self, at: int, state: int, budget: int, path: list) -> bool:
        if self.need(at, state) > budget:
            return False
        if at == len(self.rows):
            if self.leave[state] <= budget:
                path.append(state)
                return True
            self.failed[at, state] = self.leave[state]
            return False
        least = None
        for edit, taken, after, cost in _moves(self.rows[at], state):
            if cost <= budget and self._descend(at + taken, after, budget - cost, path):
                path.append(edit)
                return True
            known = cost + self.need(at + taken, after)
            least = known if least is None else min(least, known)
        self.failed[at, state] = least
        return False

    def from_state(self, state: int) -> tuple[int, str, int]:
        """(cost to the end, edits, state behind the rows)."""
        if state not in self.found:
            path: list = []
            bound = self.need(0, state)
            while not self._descend(0, state, bound, path):
                bound = self.failed[0, state]
            self.found[state] = bound, "".join(reversed(path[1:])), path[0]
        return self.found[state]


@lru_cache(1024)
def _searched(rows: bytes, leave: tuple[int, ...]) -> _Search:
    return _Search(rows, leave)


def repair(rows: bytes) -> tuple[int, str]:
    """(cost, edits) of a conversation of ``code`` bytes."""
    leave = [_END]
    starts = range(0, len(rows), SEGMENT)
    for at in reversed(starts[1:]):
        search = _searched(rows[at:at + SEGMENT], leave[-1])
        leave.append(tuple(search.from_state(s)[0] for s in range(4)))
    cost, edits, state = None, [], 0
    for at in starts:
        total, path, state = _searched(rows[at:at + SEGMENT], leave.pop()).from_state(state)
        cost = total if cost is None else cost
        edits.append(path)
    if not rows:
        return 0, ""
    return cost, "".join(edits) + "I" * (_END[state] // 2)


# --- the rows -----------------------------------------------------------------------------------

def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, present: the rows with reproducible faults by
    crc32 of ``id:turn`` modulo 20 (0 dropped, 1 emptied, 2 without ``.!?``, 3
    twice, 4 of the user).  A dropped row stays with ``present`` false, so that
    its conversation is not forgotten."""
    c = conversations
    part = [F.coalesce(c[name].cast("string"), F.lit(" ")) for name in (id_col, turn_col)]
    rows = c.select(c[id_col].alias("conv_id"), c[turn_col].cast("bigint").alias("turn"),
                    F.coalesce(c[role_col], F.lit(" ")).alias("role"), F.coalesce(c[text_col], F.lit(" ")).alias("text"),
                    (F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20).alias("how"))
    how = F.col("how")
    rows = rows.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(how.isin(0, 1), "").when(how == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (how != 0).alias("present"), F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.drop("col")


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str,
          present_col: str | None) -> DataFrame:
    c = conversations
    text = F.coalesce(c[text_col], F.lit(" "))
    return c.select(c[id_col].alias("conv_id"), c[turn_col].cast("bigint").alias("turn"),
                    F.coalesce(c[role_col], F.lit(" ")).alias("role"), text.alias("text"),
                    F.unhex(F.sha2(text, 256)).alias("digest"),
                    (c[present_col] if present_col else F.lit(True)).alias("present"))


def _order(*before: str) -> list:
    return [F.asc_nulls_first("conv_id"), *before, F.asc_nulls_first("turn"), "role", "digest"]


_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _records(batches, *cols):
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in cols))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every
    conversation of ``_rows``; no text leaves its scan."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    seen = Window.partitionBy("conv_id", "role", "digest", "present").orderBy(F.asc_nulls_first("turn"))
    light = (rows.select("conv_id", "turn", "role", "digest", "present", (trimmed == "").alias("blank"),
                         (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
             .repartition("conv_id")
             .withColumn("fault", F.when(F.col("blank"), 1).when(F.row_number().over(seen) > 1, 2)
                         .when(F.col("truncated"), 3).otherwise(0))
             .sortWithinPartitions(*_order())
             .select("conv_id", "present", "turn", F.substring("role", 1, 1).alias("initial"), "fault"))

    def run(batches):
        out = []
        records = _records(batches, "conv_id", "present", "turn", "initial", "fault")
        for conv, group in groupby(records, itemgetter(0)):
            coded, count, turns, illegal = bytearray(), [0, 0, 0, 0], [], 0
            distinct, before = 0, None
            for _, present, turn, initial, fault in group:
                if not present:
                    continue
                count[fault] += 1
                coded.append(code(initial, (_PLAIN, _DELETE, _DELETE, _TRUNCATED)[fault]))
                if before is not None and before + initial not in ("su", "ua", "au"):
                    illegal += 1
                before = initial
                if turn is not None and (not turns or turn != turns[1]):
                    turns = [turns[0] if turns else turn, turn]
                    distinct += 1
            cost, audit = repair(bytes(coded))
            gaps = turns[1] - turns[0] + 1 - distinct if turns else 0
            out.append((conv, gaps, *count[1:], illegal, cost, audit))
            if len(out) == 1000:
                yield _batch(out, fields)
                out = []
        if out:
            yield _batch(out, fields)

    schema = f"conv_id {kind}, " + ", ".join(f"{f} bigint" for f in _FACTS[:-1]) + ", audit string"
    fields = _arrow(rows.select("conv_id"), [(f, pa.int64()) for f in _FACTS[:-1]] + [("audit", pa.string())])
    return light.mapInArrow(run, schema)


def _arrow(ids: DataFrame, more: list) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    first = to_arrow_schema(ids.schema).field(0)
    return pa.schema([pa.field("conv_id", first.type), *(pa.field(n, t) for n, t in more)])


def _batch(rows: list, fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def _stream(rows: DataFrame) -> DataFrame:
    """For every conversation, in one partition and one after the other: a row
    with ``seq`` 0 that holds its facts, then its repaired rows."""
    found = faults(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    texts = rows.where("present").select("conv_id", F.lit(1).alias("has"), "turn", "role", "digest", "text",
                                         *[F.lit(None).cast(found.schema[f].dataType).alias(f) for f in _FACTS])
    heads = found.select("conv_id", F.lit(0).alias("has"), F.lit(None).cast("bigint").alias("turn"),
                         F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"),
                         F.lit(None).cast("string").alias("text"), *_FACTS)
    both = (heads.unionByName(texts).repartition("conv_id")
            .sortWithinPartitions(*_order("has")).drop("turn", "digest"))
    more = [("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
            *((f, pa.int64()) for f in _FACTS[:-1]), ("audit", pa.string())]
    fields = _arrow(rows.select("conv_id"), more)
    none = (None,) * len(_FACTS)

    def edited(group, conv):
        """The repaired rows of one conversation."""
        _, _, _, _, *facts = next(group)
        yield conv, 0, None, None, None, *facts
        edits, state, seq = iter(facts[-1]), 0, 0
        for _, _, role, text, *_ in group:
            for edit in edits:
                if edit == "D":
                    break
                state = _STEP[role[0]][state] if edit == "K" else _NEXT[state]
                seq += 1
                if edit == "I":
                    yield conv, seq, edit, ROLES[state], "", *none
                    continue
                yield conv, seq, edit, role if edit == "K" else ROLES[state], text, *none
                break
        for edit in edits:                               # inserted behind the last row
            state, seq = _NEXT[state], seq + 1
            yield conv, seq, edit, ROLES[state], "", *none

    def run(batches):
        out, held = [], 0
        records = _records(batches, "conv_id", "has", "role", "text", *_FACTS)
        for conv, group in groupby(records, itemgetter(0)):
            for row in edited(group, conv):
                out.append(row)
                held += len(row[4] or "") + len(row[-1] or "")
                if len(out) == 1000 or held > HELD:
                    yield _batch(out, fields)
                    out, held = [], 0
        if out:
            yield _batch(out, fields)

    schema = (f"conv_id {kind}, seq bigint, edit string, role string, text string, "
              + ", ".join(f"{f} bigint" for f in _FACTS[:-1]) + ", audit string")
    return both.mapInArrow(run, schema)


def repair_conversations(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, seq (from 1), edit, role, text."""
    prepare(conversations.sparkSession)
    rows = _rows(conversations, id_col, turn_col, role_col, text_col, present_col)
    return _stream(rows).where("seq > 0").select("conv_id", "seq", "edit", "role", "text")


def repair_report(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, and the SHA-256 of the repaired ``role:text`` lines."""
    prepare(conversations.sparkSession)
    rows = _rows(conversations, id_col, turn_col, role_col, text_col, present_col)
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = _arrow(rows.select("conv_id"), [*((f, pa.int64()) for f in _FACTS[:-1]), ("audit", pa.string()),
                                             ("repaired_sha256", pa.string())])

    def run(batches):
        out = []
        for conv, group in groupby(_records(batches, "conv_id", "seq", "role", "text", *_FACTS), itemgetter(0)):
            _, _, _, _, *facts = next(group)
            digest = hashlib.sha256()
            for _, seq, role, text, *_ in group:
                digest.update(("\n" if seq > 1 else "").encode() + f"{role}:{text}".encode())
            out.append((conv, *facts, digest.hexdigest()))
            if len(out) == 1000:
                yield _batch(out, fields)
                out = []
        if out:
            yield _batch(out, fields)

    schema = (f"conv_id {kind}, " + ", ".join(f"{f} bigint" for f in _FACTS[:-1])
              + ", audit string, repaired_sha256 string")
    return _stream(rows).mapInArrow(run, schema)


# --- the same in SQL: the least (cost, edits) of every role state, row by row ----------------------

def sql(table: str = "conversations") -> str:
    """DuckDB SQL for ``repair_report(damage(table))``.  A state's best way is
    one string, its cost in 12 digits before its edits, so that ``least``
    takes the cheapest and of these the first in ASCII order."""
    def add(way, cost, edit):
        return f"lpad(CAST(CAST(left({way}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({way}, 13) || '{edit}'"

    # after inserts: i0..i3 from w0..w3
    closed = f"""w0 AS i0, w1 AS i1,
  least(w2, {add('w0', 2, 'I')}, {add('w1', 2, 'I')}, {add('w3', 2, 'I')}) AS i2,
  least(w3, {add('w2', 2, 'I')}, {add('w0', 4, 'II')}, {add('w1', 4, 'II')}) AS i3"""
    late = "CASE WHEN fault = 3 THEN 1 ELSE 0 END"
    keep = lambda way, initial, cost, edit: (
        f"CASE WHEN fault IN (0, 3) AND {initial} THEN {add(way, f'({cost} + {late})', edit)} END")
    kept = lambda way, initial: keep(way, f"initial = '{initial}'", 0, "K")
    again = lambda way: keep(way, "true", 2, "R")
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                   lambda x: CAST(ascii(x) AS BIGINT)) AS chars FROM {table}),
hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(chars,
    lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
      WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS how FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN how = 1 THEN '' WHEN how = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN how = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE how <> 0),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
marked AS (
  SELECT conv_id, turn, role, text, pos, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN trimmed = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id),
ways AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, lpad('0', 12, '0') AS w0, CAST(NULL AS VARCHAR) AS w1,
    CAST(NULL AS VARCHAR) AS w2, CAST(NULL AS VARCHAR) AS w3 FROM {table}
  UNION ALL
  SELECT conv_id, pos, {add('i0', 3, 'D')},
    least({add('i1', 3, 'D')}, {kept('i0', 's')}),
    least({add('i2', 3, 'D')}, {kept('i0', 'u')}, {kept('i1', 'u')}, {kept('i3', 'u')}, {again('i0')}, {again('i1')}, {again('i3')}),
    least({add('i3', 3, 'D')}, {kept('i2', 'a')}, {again('i2')})
  FROM (SELECT w.conv_id, m.pos, m.initial, m.fault, {closed}
        FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1) t),
last AS (SELECT conv_id, least(i0, i3) AS way FROM (
  SELECT w.conv_id, {closed} FROM ways w LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.pos = coalesce(f.n, 0)) t),
edits AS (
  SELECT conv_id, unnest(string_split(substr(way, 13), '')) AS edit, generate_subscripts(string_split(substr(way, 13), ''), 1) AS k
  FROM last WHERE length(way) > 12),
numbered AS (
  SELECT conv_id, edit, k, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS pos,
    sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS seq FROM edits),
joined AS (
  SELECT n.conv_id, n.edit, n.seq, m.role, m.text,
    max(CASE WHEN n.seq = 1 AND n.edit = 'K' AND m.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS head
  FROM numbered n LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM n.conv_id AND m.pos = n.pos AND n.edit <> 'I'
  WHERE n.edit <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (seq - head) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY seq) AS repaired FROM joined GROUP BY conv_id)
SELECT l.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(f.blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(f.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(f.truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(f.illegal, 0) AS BIGINT) AS illegal, CAST(left(l.way, 12) AS BIGINT) AS cost,
  substr(l.way, 13) AS audit, sha256(coalesce(r.repaired, '')) AS repaired_sha256
FROM last l LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM l.conv_id
LEFT JOIN lines r ON r.conv_id IS NOT DISTINCT FROM l.conv_id"""
