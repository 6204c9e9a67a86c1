"""Repair of the structure of conversations with the fewest edits, on a bidirectional tight-arc DAG.

A conversation's rows, in order, and the states of an automaton for what a conversation may be (an
opening system turn or none, then user and assistant by turns; or nothing at all) span a graph: a node is
a row reached and a state, an arc an edit. The least cost from the start to every node and from every node
to an end tell which arcs are tight, that is, lie on a cheapest path. A frontier of nodes then walks the
tight arcs: at every step the least letter that leaves it, until an end is in it. That is the first of all
cheapest audits by alphabet.

Spark orders the rows of a conversation once and writes them down with their places. What the graph needs
of a row is one byte, so a conversation of any length is decided from its bytes alone; its audit then goes
ahead of its rows, which stream past it to be edited, one at a time and never gathered. Rows that repeat
each other are found by Spark across tasks, not by a set in one.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import crc32_sql, cut, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: What a row that stays costs besides where it was cut short.
TRUNCATED_COST = 1
#: States of the automaton: nothing yet, after an opening system turn, after a user's, after an assistant's.
START, OPENED, ASKED, ANSWERED = range(4)
ENDS = (START, ANSWERED)
#: Initials that lead on from each state, and to which.
STEPS = ({"s": OPENED, "u": ASKED}, {"u": ASKED}, {"a": ANSWERED}, {"u": ASKED})
#: Roles that a row may be given.
GIVEN = {"u": "user", "a": "assistant"}
#: Faults of a row, the first of which counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = frozenset(["su", "ua", "au"])
#: Conversations of up to so many rows, as bytes, whose repairs a worker remembers; most share a few shapes.
SHORT, REMEMBERED = 64, 1 << 14
#: Characters that make no text by themselves: [\\x20\\x09-\\x0D].
_BLANKS = " \t\n\x0b\x0c\r"
_UNREACHED = 1 << 60

Arc = tuple[str, int, int, int]


def arcs_of(initial: str, fault: int) -> tuple[tuple[Arc, ...], ...]:
    """For each state the edits of a row: (letter, cost, rows taken, state after)."""
    out: list[tuple[Arc, ...]] = []
    for state, steps in enumerate(STEPS):
        arcs: list[Arc] = [(INSERT, COSTS[INSERT], 0, to) for i, to in steps.items() if i in GIVEN]
        arcs.append((DELETE, COSTS[DELETE], 1, state))
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            arcs += [(REROLE, COSTS[REROLE] + more, 1, to) for i, to in steps.items() if i in GIVEN]
            if initial in steps:
                arcs.append((KEEP, COSTS[KEEP] + more, 1, steps[initial]))
        out.append(tuple(arcs))
    return tuple(out)


_AT_END = tuple(tuple(arc for arc in arcs if not arc[2]) for arcs in arcs_of("", BLANK))


def row_code(initial: str, fault: int) -> int:
    """All that the graph asks of a row, as one byte."""
    return "sua".find(initial or "-") + 1 << 2 | fault


#: The arcs of every code.
_ARCS = {row_code(initial, fault): arcs_of(initial, fault) for initial in ("s", "u", "a", "-") for fault in range(4)}


def _settle(costs: list[int], forward: bool) -> list[int]:
    """Costs at a row once insertions have run their course; more than one for each state never pays."""
    for _ in STEPS:
        for state, arcs in enumerate(_AT_END):
            for _, cost, _, to in arcs:
                a, b = (state, to) if forward else (to, state)
                costs[b] = min(costs[b], costs[a] + cost)
    return costs


def costs_to(codes: bytes) -> array:
    """Least costs from the start to (row, state), four for each row and four for the end."""
    here = _settle([0, *[_UNREACHED] * 3], True)
    out = array("q", here)
    for code in codes:
        there = [_UNREACHED] * 4
        for state, arcs in enumerate(_ARCS[code]):
            for _, cost, taken, to in arcs:
                if taken and here[state] + cost < there[to]:
                    there[to] = here[state] + cost
        here = _settle(there, True)
        out.extend(here)
    return out


def costs_from(codes: bytes) -> array:
    """Least costs from (row, state) to an end, in the order of costs_to()."""
    here = _settle([0 if state in ENDS else _UNREACHED for state in range(4)], False)
    back = array("q", here[::-1])
    for code in reversed(codes):
        there = [min(cost + here[to] for _, cost, taken, to in arcs if taken) for arcs in _ARCS[code]]
        here = _settle(there, False)
        back.extend(here[::-1])
    back.reverse()
    return back


def audit_of(codes: bytes) -> tuple[int, str]:
    """The least cost of a repair and the first audit by alphabet that has it."""
    ahead, behind = costs_to(codes), costs_from(codes)
    least, n = behind[START], len(codes)
    letters: list[str] = []
    frontier = {(0, START)}
    while not any(row == n and state in ENDS for row, state in frontier):
        leaving: dict[str, set[tuple[int, int]]] = {}
        for row, state in frontier:
            for letter, cost, taken, to in _ARCS[codes[row]][state] if row < n else _AT_END[state]:
                if ahead[4 * row + state] + cost + behind[4 * (row + taken) + to] == least:
                    leaving.setdefault(letter, set()).add((row + taken, to))
        letters.append(min(leaving))
        frontier = leaving[letters[-1]]
    return least, "".join(letters)


_remembered = functools.lru_cache(REMEMBERED)(audit_of)


def repair_of(codes: bytes) -> tuple[int, str]:
    """audit_of(), looked up where a conversation is short."""
    return _remembered(codes) if len(codes) <= SHORT else audit_of(codes)


class Editor:
    """Rows edited by an audit as they come; what is inserted comes out where it belongs."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _given(self) -> str:
        """The role that a row gets here: there is one for each state."""
        initial = next(i for i in STEPS[self.state] if i in GIVEN)
        self.state = STEPS[self.state][initial]
        return GIVEN[initial]

    def inserted(self) -> Iterator[tuple[str, str]]:
        """What the audit inserts before the next row."""
        while self.audit.startswith(INSERT, self.at):
            self.at += 1
            yield self._given(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What becomes of the next row, after what is inserted before it."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == KEEP:
            self.state = STEPS[self.state][role[0]]
            yield role, text
        elif letter == REROLE:
            yield self._given(), text


@dataclass
class _Seen:
    """What is known of a conversation as its rows pass: a byte of each row, and counts."""

    codes: bytearray
    counts: list[int]
    turns: int = 0
    first: int | None = None
    last: int | None = None
    before: str | None = None
    illegal: int = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.codes.append(row_code(initial, fault))
        self.counts[fault] += 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn

    def told(self, key: int) -> dict:
        cost, audit = repair_of(bytes(self.codes))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return dict(zip(_DECIDED, (key, gaps, *self.counts[BLANK:], self.illegal, cost, audit), strict=True))


_DECIDED = ("conv_", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
_DECIDED_ARROW = pa.schema([(n, pa.string() if n in ("audit", "conv_") else pa.int64()) for n in _DECIDED])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order by conversation, whose texts are not among them, the counts and the audit of each conversation."""
    key, seen = None, None
    for batch in batches:
        told = []
        for conv, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seen is None or conv != key:
                if seen is not None:
                    told.append(seen.told(key))
                key, seen = conv, _Seen(bytearray(), [0] * 4)
            if fault is not None:  # else the row only says that there is such a conversation
                seen.add(turn, initial, fault)
        if told:
            yield pa.RecordBatch.from_pylist(told, _DECIDED_ARROW)
    if seen is not None:
        yield pa.RecordBatch.from_pylist([seen.told(key)], _DECIDED_ARROW)


def _edited(batches: Iterator[pa.RecordBatch], each: Callable[[str, Iterator[tuple[str, str]]], Iterator[tuple]]) -> Iterator[list[tuple]]:
    """For each batch of rows, of which a conversation's first is its audit, what `each` makes of the edited rows of a conversation."""

    def rows() -> Iterator[tuple | None]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield None

    source, out = rows(), []
    waiting: list[tuple] = []

    def pulled() -> tuple | None:
        return waiting.pop() if waiting else next(source, StopIteration)

    def one(key: str, audit: str) -> Iterator[tuple[str, str]]:
        editor = Editor(audit)
        while (row := pulled()) is not StopIteration:
            if row is None:
                continue
            if row[0] != key:
                waiting.append(row)
                break
            if row[3] is not None:  # but for one that only says that there is such a conversation
                yield from editor.row(row[2], row[3])
        yield from editor.inserted()

    while (row := pulled()) is not StopIteration:
        if row is None:
            continue
        for made in each(row[0], one(row[0], row[3])):
            out.append(made)
            if len(out) >= 1024:
                yield out
                out = []
    if out:
        yield out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digest(key: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        h = hashlib.sha256()
        for i, (role, text) in enumerate(rows):
            h.update(("\n" * (i > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        yield key, h.hexdigest()

    for made in _edited(batches, digest):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made, strict=True)], ["conv_", "repaired_sha256"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def numbered(key: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        yield from ((key, i, role, text) for i, (role, text) in enumerate(rows))

    for made in _edited(batches, numbered):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_", "turn", "role", "text"])


def _placed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, there: Column | None) -> DataFrame:
    """The rows with their places in their conversations, written down once.

    Conversations go by their ids as text, a null one by none. Only rows of one conversation are put in
    order together, by a sort that Spark spills.
    """
    cast = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    is_row = F.lit(True) if there is None else F.coalesce(there, F.lit(False))
    plain = rows.select(
        F.concat(F.lit("="), F.col(conv_col).cast("string")).alias("conv_"),
        F.when(is_row, F.col(turn_col).cast("long")).alias("turn_"),
        F.when(is_row, cast(role_col)).alias("role_"),
        F.when(is_row, cast(text_col)).alias("text_"),
    ).withColumn("conv_", F.coalesce("conv_", F.lit("")))
    order = Window.partitionBy("conv_").orderBy(F.col("turn_").asc_nulls_first(), "role_", "text_")
    return cut(plain.withColumn("place_", F.row_number().over(order).cast("long")))


def _faulty(placed: DataFrame) -> DataFrame:
    """conv_, place_, turn_, initial_ and fault_ of every row; a null fault for what is none."""
    bare = F.rtrim("text_", F.lit(_BLANKS))
    rows = placed.select(
        "conv_",
        "place_",
        "turn_",
        F.left("role_", F.lit(1)).alias("initial_"),
        F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND).alias("own_"),
        # the length parts role from text, so that no two pairs are written alike
        F.when(F.col("text_").isNotNull(), F.sha2(F.concat_ws(":", F.length("role_"), "role_", "text_"), 256)).alias("digest_"),
    )
    earlier = F.row_number().over(Window.partitionBy("conv_", "digest_").orderBy("place_")) > 1
    fault = F.when(F.col("digest_").isNull(), None).when(F.col("own_") == BLANK, BLANK).when(earlier, DUPLICATE).otherwise(F.col("own_"))
    return rows.withColumn("fault_", fault.cast("long")).select("conv_", "place_", "turn_", "initial_", "fault_")


def _decided(placed: DataFrame) -> DataFrame:
    codes = _faulty(placed).repartition("conv_").sortWithinPartitions("conv_", "place_").select("conv_", "turn_", "initial_", "fault_")
    return codes.mapInArrow(_decide, "conv_ string, " + ", ".join(f"{n} long" for n in _DECIDED[1:-1]) + ", audit string")


def _with_audits(placed: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows in order by conversation, before each conversation's its audit."""
    none = F.lit(None).cast("string")
    both = placed.select("conv_", "place_", "role_", "text_").unionByName(decided.select("conv_", F.lit(0).cast("long").alias("place_"), none.alias("role_"), F.col("audit").alias("text_")))
    return both.repartition("conv_").sortWithinPartitions("conv_", "place_")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, null turns first, and where turns are equal by role and then text. A row is
    blank without a character other than [\\x20\\x09-\\x0D], else a duplicate if role and text stood
    earlier in its conversation, else truncated if its last such character is none of `.!?`. gaps: turns
    missing between the least and the greatest. illegal: neighbours whose roles' initials are not su, ua
    or au. audit: the letters of the cheapest edits in order, of several the first by alphabet. A row that
    stays costs nothing (K) or 2 where its role changes (R), and 1 more if truncated; a row that goes
    costs 3 (D), as blank rows and duplicates must; an empty turn put in costs 2 (I).

    A null role or text counts as one space. Rows with a null conversation are one conversation.
    Rows that repeat each other are duplicates. there: false or null for rows that only name a conversation
    and are none themselves; one without other rows has zeros, an empty audit and the digest of nothing.
    Other columns are not read. An empty table gives an empty result. The digest is of a conversation's
    repaired rows as `role:text` joined by newlines, and so, whatever the plan, of a stream in one task.
    """
    placed = _placed(rows, conv_col, turn_col, role_col, text_col, there)
    decided = cut(_decided(placed))
    digests = _with_audits(placed, decided).mapInArrow(_digests, "conv_ string, repaired_sha256 string")
    kind = rows.schema[conv_col].dataType
    conv = F.when(F.col("conv_") != "", F.substr("conv_", F.lit(2))).cast(kind).alias(conv_col)
    return decided.join(digests, "conv_").select(conv, *_DECIDED[1:], "repaired_sha256")


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of every conversation after its repair, with turns from 0 on; see repair()."""
    placed = _placed(rows, conv_col, turn_col, role_col, text_col, None)
    out = _with_audits(placed, _decided(placed)).mapInArrow(_written, "conv_ string, turn long, role string, text string")
    conv = F.when(F.col("conv_") != "", F.substr("conv_", F.lit(2))).cast(rows.schema[conv_col].dataType).alias(conv_col)
    return out.select(conv, F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the faults that a checksum of conversation and turn gives them, and `there`: false for those that are dropped."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", told("conv_id"), told("turn"))) % 20
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    out = rows.withColumn("f", fault).select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), (F.col("f") != 0).alias("there"), F.explode(F.sequence(F.lit(1), F.when(F.col("f") == 3, 2).otherwise(1))).alias("nth"))
    return out.drop("nth")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repair() over the whole conversations table after damage. Nulls are one space, in the checksum too."""
    return repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), there=F.col("there"))


def _letter_sql(state: str, initial: str) -> str:
    """SQL for the state that a role's initial leads to; null where it leads nowhere."""
    moves = [(a, i, b) for a, steps in enumerate(STEPS) for i, b in steps.items()]
    return "CASE " + " ".join(f"WHEN {state} = {a} AND {initial} = '{i}' THEN {b}" for a, i, b in moves) + " END"


#: By another way: costs to the end alone, row by row from the last, then the letters one by one.
OP12_SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS f FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS nth FROM src WHERE f <> 0
), numbered AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM hurt
), r AS (
  SELECT *, left(role, 1) AS x, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM numbered
), sized AS (
  SELECT c, count(*) AS n FROM r GROUP BY c
), arcs AS (
  SELECT c, i, s, unnest([{{'l': 'D', 'k': 3, 't': s}}]
      || CASE WHEN fault IN (1, 2) THEN [] ELSE [{{'l': 'R', 'k': 2 + CASE WHEN fault = 3 THEN 1 ELSE 0 END, 't': {_letter_sql("s", "CASE WHEN s = 2 THEN 'a' ELSE 'u' END")}}}] END
      || CASE WHEN fault IN (1, 2) OR ({_letter_sql("s", "x")}) IS NULL THEN [] ELSE [{{'l': 'K', 'k': CASE WHEN fault = 3 THEN 1 ELSE 0 END, 't': {_letter_sql("s", "x")}}}] END) AS arc
  FROM r, (SELECT unnest([0, 1, 2, 3]) AS s)
), best AS (
  SELECT c, i, s, arc.t AS t, min(arc.k) AS k FROM arcs GROUP BY ALL
), tables AS (
  SELECT c, i, list({{'s': s, 't': t, 'k': k}}) AS ways FROM best GROUP BY c, i
), back AS (
  SELECT c, n AS i, [0, 4, 2, 0] AS b FROM sized
  UNION ALL
  SELECT c, i, [least(b[1], b[3] + 2), least(b[2], b[3] + 2), least(b[3], b[4] + 2), least(b[4], b[3] + 2)] AS b FROM (
    SELECT c, i, [least(b[1], b[4] + 4), least(b[2], b[4] + 4), least(b[3], b[4] + 2), least(b[4], b[3] + 2)] AS b FROM (
      SELECT t.c, t.i, list_transform([0, 1, 2, 3], lambda s: list_min(list_transform(list_filter(t.ways, lambda w: w.s = s), lambda w: w.k + back.b[w.t + 1]))) AS b
      FROM back JOIN tables t ON t.c = back.c AND t.i = back.i - 1
    )
  )
), walk AS (
  SELECT c, CAST(0 AS BIGINT) AS i, 0 AS s, '' AS audit, n, b[1] AS due, [] :: VARCHAR[] AS made, CAST(NULL AS VARCHAR) AS stop FROM sized JOIN back USING (c) WHERE back.i = 0
  UNION ALL
  SELECT c, i + CASE WHEN l = 'I' THEN 0 ELSE 1 END, t, audit || l, n, due - k,
         CASE l WHEN 'D' THEN made WHEN 'K' THEN list_append(made, role || ':' || text) WHEN 'R' THEN list_append(made, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || text) ELSE list_append(made, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END) END, NULL
  FROM (
    SELECT walk.*, r.role, r.text, a.l, a.k, a.t, row_number() OVER (PARTITION BY walk.c ORDER BY a.l) AS first_letter
    FROM walk
    JOIN (SELECT c, i, s, arc.l AS l, arc.k AS k, arc.t AS t FROM arcs UNION ALL SELECT c, i, s, 'I', 2, CASE WHEN s = 2 THEN 3 ELSE 2 END FROM back, (SELECT unnest([0, 1, 2, 3]) AS s)) a ON a.c = walk.c AND a.i = walk.i AND a.s = walk.s
    JOIN back ON back.c = walk.c AND back.i = walk.i + CASE WHEN a.l = 'I' THEN 0 ELSE 1 END AND a.k + back.b[a.t + 1] = walk.due
    LEFT JOIN r ON r.c = walk.c AND r.i = walk.i
    WHERE NOT (walk.i = walk.n AND walk.s IN (0, 3))
  ) WHERE first_letter = 1
), done AS (
  SELECT c, audit, array_to_string(made, chr(10)) AS repaired FROM walk WHERE i = n AND s IN (0, 3)
), faults AS (
  SELECT c, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (i > 0 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(x) OVER (PARTITION BY c ORDER BY i) AS before FROM r) GROUP BY c
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(back.b[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS c FROM conversations) k
LEFT JOIN faults USING (c) LEFT JOIN done USING (c) LEFT JOIN back ON back.c = k.c AND back.i = 0
"""
