"""Repairs against a search of all edits, cheapest first."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from broadsheet.llm import conversation_repair as cr
from broadsheet.llm.common import table
from broadsheet.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
BLANK, GOOD = " \t\n\x0b\x0c\r", re.compile(r"(s?(ua)+)?")


def could_be(initials):
    """Whether initials begin something that is allowed."""
    return any(GOOD.fullmatch(initials + end) for end in ("", "a", "ua"))


def brute(rows):
    """(cost, audit, repaired) of rows (role, text, fault): all edits by cost and then audit, until one is right."""
    heap = [(0, "", 0, ())]
    while True:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join((r or "-")[0] for r, _ in out)
        if i == len(rows) and GOOD.fullmatch(initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        new = [(2, "I", i, (g, "")) for g in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            new.append((3, "D", i + 1, None))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                new += [(2 + more, "R", i + 1, (g, text)) for g in ("user", "assistant")] + [(0 + more, "K", i + 1, (role, text))]
        for k, letter, j, row in new:
            after = (*out, row) if row else out
            if could_be("".join((r or "-")[0] for r, _ in after)) and len(after) <= 2 * len(rows) + 2:
                heapq.heappush(heap, (cost + k, audit + letter, j, after))


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def expected(rows):
    """Of (turn, role, text) after damage, what repair() says of them."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = faults_of([r[1:] for r in rows])
    turns = [t for t, *_ in rows if t is not None]
    cost, audit, text = brute([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(150))
def test_cheapest_audits(seed):
    r = random.Random(seed)
    rows = [(r.choice(["system", "user", "assistant", "tool", ""]), f"t{k}.", r.choice([None, None, None, "blank", "duplicate", "truncated"])) for k in range(r.randint(0, 6))]
    code = {None: cr.SOUND, "blank": cr.BLANK, "duplicate": cr.DUPLICATE, "truncated": cr.TRUNCATED}
    cost, audit = cr.audit_of(bytes(cr.row_code(role[:1], code[f]) for role, _, f in rows))
    editor = cr.Editor(audit)
    out = [made for role, text, _ in rows for made in editor.row(role, text)] + list(editor.inserted())
    assert (cost, audit, "\n".join(f"{a}:{b}" for a, b in out)) == brute(rows)


def test_long_conversations_take_time_in_proportion():
    codes = bytes(cr.row_code("ua"[k % 2], cr.SOUND) for k in range(40_000))
    assert cr.repair_of(codes) == (0, "K" * 40_000)


ODD = {
    1: [(0, "system", "s."), (1, "user", "q?"), (2, "assistant", "a.")],
    2: [(5, "user", "q"), (7, "user", "q"), (7, "user", "q"), (9, "assistant", " \t\n")],
    3: [(None, None, None), (None, "user", "x."), (3, "user", None), (3, "assistant", "é "), (3, "assistant", "a!")],
    4: [(0, "", "x"), (1, "usher", "x. "), (2, "assistant", "long " * 30000 + ".")],
    None: [(None, "user", "a.b"), (2, "assistant", "c.")],
    6: [(k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(300)],
}


def test_odd_tables(spark):
    rows = [(c, *r, "x", "x", "x") for c, rs in ODD.items() for r in rs]
    table_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place_ string, audit string, conv_ string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in cr.repair(table_).collect()}
    want = {c: expected(rs) for c, rs in ODD.items() if c != 6} | {6: (0, 0, 0, 0, 0, 0, "K" * 300, hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in ODD[6]).encode()).hexdigest())}
    assert got == want
    made = cr.repaired(table_).orderBy("conv_id", "turn").collect()
    for c, rs in ODD.items():
        text = "\n".join(f"{r.role}:{r.text}" for r in made if r.conv_id == c)
        assert hashlib.sha256(text.encode()).hexdigest() == got[c][-1]
    assert cr.repair(table_.limit(0)).count() == cr.repaired(table_.limit(0)).count() == 0


def test_ids_that_are_texts_and_rows_that_are_none(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 0, "user", "q?", False), ("", 1, "user", "q?", True), ("b=", 1, "user", "q?", None)], "conv_id string, turn int, role string, text string, there boolean")
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r)[1:] for r in cr.repair(rows, there=F.col("there")).collect()}
    assert got == {"a": none, "b=": none, "": (0, 0, 0, 0, 0, 2, "KI", hashlib.sha256(b"user:q?\nassistant:").hexdigest())}


def test_query_by_hand(spark):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, SF).collect()}
    convs = {}
    for r in table(spark, SF, "conversations").collect():
        f = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role = "user" if f == 4 else r.role
        text = "" if f == 1 else re.sub("[.!?]", "", r.text) if f == 2 else r.text
        convs.setdefault(r.conv_id, []).extend([(r.turn, role, text)] * {0: 0, 3: 2}.get(f, 1))
    assert got == {c: expected(rows) for c, rows in convs.items()}
