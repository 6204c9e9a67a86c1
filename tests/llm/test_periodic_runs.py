"""Periodic runs against a search of every start, end and period."""

import hashlib
import random
import zlib

import pytest

from broadsheet.llm import periodic_runs
from broadsheet.llm.common import table
from broadsheet.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words):
    """(start, length, period) of all runs: for each period what stays periodic, unless it does so with a smaller one."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 3 + 1):
        start = None
        for i in range(n - q + 1):
            same = i + q < n and words[i] == words[i + q]
            if same and start is None:
                start = i
            elif not same and start is not None:
                length = i - start + q
                if length >= max(24, 3 * q) and (start, length) not in seen:
                    seen.add((start, length))
                    out.append((start, length, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_definition(words):
    """The same from the definition: every stretch, its smallest period, and whether a neighbour prolongs it."""
    n, out = len(words), []
    for a in range(n):
        for b in range(a + 24, n + 1):
            q = next(q for q in range(1, b - a + 1) if words[a : b - q] == words[a + q : b])
            if b - a >= 3 * q and not (a and words[a - 1] == words[a - 1 + q]) and not (b < n and words[b] == words[b - q]):
                out.append((a, b - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def told(words):
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(range(len(runs)), key=lambda k: (runs[k][1] / runs[k][2], -runs[k][0], -runs[k][2])) if runs else None
    return len(words), runs, best, " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(seed):
    r = random.Random(seed)
    words = []
    for _ in range(r.randint(0, 4)):
        words += [r.choice("ab")] * r.choice([0, 1, 30]) + [r.choice("abc") for _ in range(r.randint(1, 9))] * r.choice([1, 3, 4, 9])
    return words[:90]


@pytest.mark.parametrize("seed", range(60))
def test_search_by_definition(seed):
    words = random_words(seed)
    found = periodic_runs.smallest_periods(periodic_runs.stretches(periodic_runs.numbered([w.encode() for w in words]), 1, len(words)))
    assert [tuple(map(int, r)) for r in zip(*found, strict=True)] == by_definition(words) == brute(words)


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 30), (4, "x " * 30), (4, "x " * 30), (4, "y z " * 20), (5, "lone"), (6, "a b c " * 7 + "a"), (7, "日本 é x " * 9), (8, " ".join(map(str, range(700))) + " w" * 40)]


@pytest.mark.parametrize("lags", [None, 1, 7])
def test_odd_tables(spark, lags):
    rows = ODD + [(100 + k, " ".join(random_words(k))) for k in range(20)]
    docs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, text string, id_ string, runs string, row_ string").repartition(3)
    out = periodic_runs.periodic_runs(docs, lags=lags).collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest, r.collapsed) for r in out), key=repr)
    split = lambda t: [w.decode() for w in (t or "").encode().split()]
    assert got == sorted(((i, *told(split(t))) for i, t in rows), key=repr)
    assert periodic_runs.periodic_runs(docs.limit(0), lags=lags).count() == 0


def test_long_text_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 1000)
    words = [str(k % 300) for k in range(1200)] + [str(k) for k in range(1000, 2000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs, lags=50).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 1200, 300)] and got[1].collapsed.split() == words[:300] + words[1200:] and got[2].runs == []


def edited(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_query_by_hand(spark):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    docs = [r for r in table(spark, SF, "documents").collect() if len(r.text or "") < 9000]
    assert len(docs) > 150
    for d in docs:
        n, runs, best, collapsed = told(edited(d.doc_id, d.text))
        r = got[d.doc_id]
        start, length, period = runs[best] if runs else (None,) * 3
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), start, length, period, 1000 * length // period if runs else None)
        assert r.collapsed_sha256 == digest(collapsed) and r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))
