"""Winnowing against a search for every window, on either way of joining."""

import hashlib
import random

import pytest

from broadsheet.llm.decontaminate import SPAN, Index, clean, decontaminate, measure, words_of

DOCS = "doc_id long, text string, item string, key string, n_words string"


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w = words_of(text)
        hit, ids = set(), set()
        for item, item_text in items:
            theirs = words_of(item_text)
            n = min(SPAN, len(theirs))
            windows = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids.add("" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def random_tables(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "é", "7", "Ab", "日本"])
    text = lambda n: "".join(word() + r.choice([" ", "-", "\n", ", "]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 5, 9, 10, 11, 14, 30]))) for i in range(8)] + [(3, text(12)), (None, text(11)), (9, None)]
    docs = []
    for i in range(60):
        t = text(r.randint(0, 25))
        if r.random() < 0.6:
            w = r.choice(items)[1] or ""
            t += w[: r.randint(0, len(w))] + text(r.randint(0, 5)) + w.upper()
        docs.append((i, t))
    return docs + [(None, docs[3][1]), (5, None), (6, ""), (7, docs[7][1]), (7, docs[7][1]), (8, "a b " * 5000)], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bound", [1 << 30, -1])
def test_as_brute_force(spark, seed, bound):
    docs, items = random_tables(seed)
    d = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate(d, b, broadcast_bytes=bound).collect()), key=repr)
    assert got == brute(docs, items)


@pytest.mark.parametrize("bound", [1 << 30, -1])
def test_empty_tables(spark, bound):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.contaminated) for r in decontaminate(d, b, broadcast_bytes=bound).collect()) == [(1, 3, False), (2, 0, False)]
    assert decontaminate(d.limit(0), b.union(spark.createDataFrame([(1, "a")], "item_id long, text string")), broadcast_bytes=bound).collect() == []


@pytest.mark.parametrize("bound", [1 << 30, -1])
def test_clean(spark, bound):
    docs, items = random_tables(5)
    d = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], "doc_id long, text string, hit_key_ string, copies_ string, key string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    left = clean(d, b, broadcast_bytes=bound)
    assert left.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(((i, t) for (i, t) in docs if not brute([(i, t)], items)[0][-1]), key=repr)
    assert clean(d.limit(0), b, broadcast_bytes=bound).collect() == []
    assert clean(d, b.limit(0), broadcast_bytes=bound).count() == len(docs)


@pytest.mark.parametrize("bound", [1 << 30, -1])
def test_a_third_of_all_rows_are_copies_of_a_text_that_is_hit(spark, bound):
    docs, items = random_tables(1)
    hot = next(t for _, t in items if t and len(t.split()) > 9) + " and more"
    docs = docs + [(50_000 + i, hot) for i in range(len(docs) // 2)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate(d, b, broadcast_bytes=bound).collect()), key=repr)
    assert got == brute(docs, items) and sum(g[0] is not None and g[0] >= 50_000 and g[-1] for g in got) == len(docs) // 3


def test_repeated_words_take_no_longer():
    import time

    import pyarrow as pa

    text = "a b " * 10_000
    began = time.perf_counter()
    found = measure(Index([1], [text]), pa.array([text, "b a " * 4, "a b a"]))
    assert time.perf_counter() - began < 1
    assert [x.tolist() for x in found[:3]] == [[20_000, 8, 3], [20_000, 0, 0], [1, 0, 0]]
