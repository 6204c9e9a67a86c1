"""Fingerprints against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import syncmers
from broadsheet.llm.common import table
from broadsheet.llm.registry import QUERIES
from broadsheet.llm.syncmers import FACTORS, PRIME

SF = "/root/testdata/sf0.001"


def mixed(*numbers):
    return sum(n * f for n, f in zip(numbers, FACTORS, strict=False)) % PRIME


def anchors(text):
    """(place, number) of every anchor."""
    words = (text or "").encode().split()
    h = [zlib.crc32(w) for w in words]
    if 0 < len(h) < 5:
        return [(0, mixed(zlib.crc32(b" ".join(words)), len(h)))]
    m = [mixed(a, b) for a, b in zip(h, h[1:], strict=False)]
    out = []
    for i in range(len(h) - 4):
        inner = m[i : i + 4]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, mixed(m[i], m[i + 2], h[i + 4])))
    return out


def records(text):
    found = anchors(text)
    return [n * 16 + (found[k + 1][0] - p if k + 1 < len(found) else 0) for k, (p, n) in enumerate(found)]


def printed(text):
    return "".join(f"{a:09x}" for a in records(text))


def likeness(a, b):
    a, b = set(records(a)), set(records(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """beside_next() of rows in their order."""
    out = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(text), printed(edited), likeness(text, edited), likeness(text, after)))
    return out


def test_anchors_are_dense_and_free_of_context(spark):
    r = random.Random(5)
    words = [str(r.randrange(400)) for _ in range(3000)]
    places = [p for p, _ in anchors(" ".join(words))]
    assert max(b - a for a, b in zip(places, places[1:], strict=False)) <= syncmers.K - syncmers.S
    one, other = " ".join(words[:200]), " ".join([*words[2000:2007], *words[:200]])
    a, b = (row.f for row in spark.createDataFrame([(one,), (other,)], "t string").select(syncmers.anchors(F.col("t")).alias("f")).collect())
    assert a == records(one) and b[-len(a) :] == a


ODD = [(None, "no id and a text of seven words"), (1, None), (2, ""), (3, " \t\n"), (5, "a"), (6, "the same text as another one here"), (7, "the same text as another one here"), (8, "日本 é\U0001f600 x y " * 4), (9, "w " * 50), (11, "long text " * 30000)]


@pytest.mark.parametrize("partitions", [1, 4])
def test_odd_tables(spark, partitions):
    rows = ODD + [(20 + k, f"text number {k} of several that follow") for k in range(40)]
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, id_ string, key string").repartition(partitions)
    got = sorted(map(tuple, syncmers.beside_next(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == expected(rows)
    assert sorted((r.doc_id or -1, r.fingerprint) for r in syncmers.fingerprints(docs).collect()) == sorted((i or -1, printed(t)) for i, t in rows)
    assert syncmers.beside_next(docs.limit(0)).count() == 0
    assert [tuple(r) for r in syncmers.beside_next(docs.filter("doc_id = 5")).collect()] == expected([(5, "a")])


def test_rows_that_share_an_id(spark):
    rows = [(1, "first of all these texts"), *[(2, f"many texts under one id, this is {k % 30}") for k in range(90)], (3, "last of all these texts")]
    got = syncmers.beside_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, printed(t)) for i, t in rows)
    # each row is the next one of exactly one other, and rows that repeat each other stand together
    assert sum(r.near_next == 1.0 for r in got) >= 60 and len(got) == len(rows)


def test_query_by_hand(spark):
    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    got = sorted(map(tuple, QUERIES["op11_document_fingerprints"](spark, SF).collect()))
    assert got == expected(rows)
    near = sorted(r[5] for r in got if r[1] > 400)
    assert near[len(near) // 2] > 0.5 and sorted(r[6] for r in got)[len(got) // 2] < 0.1
