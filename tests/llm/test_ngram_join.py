"""The heavy-light join against all pairs of sets of words."""

import random

import numpy as np
import pytest

from broadsheet.llm import ngram_join
from broadsheet.llm.components import components
from broadsheet.llm.ngram_join import boundary, differ, bitmap, jaccard_join, linked, n_subsets, subsets


def words_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")


def brute(docs):
    sets = []
    for _, text in docs:
        w = [x for x in words_of(text) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    text = lambda k: [r.choice("abcdefghij") + r.choice("klmnopq") for _ in range(k)]
    passage, docs = text(40), []
    bases = [text(k) for k in (1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 20, 30, 60, 150, 400)]
    for i in range(n):
        w = list(r.choice(bases)) if r.random() < 0.8 else text(r.randint(0, 60))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            if w:
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1])] = r.choice([[], text(1)])
        if r.random() < 0.2:
            w += passage
        docs.append((1000 - i, r.choice([" ", "\n", "  "]).join(x.upper() if r.random() < 0.1 else x for x in w)))
    return docs + [(2000, None), (2001, ""), (2002, " \t\n"), (None, docs[5][1]), (7, docs[9][1]), (7, docs[10][1]), (7, docs[10][1])]


@pytest.mark.parametrize("short,block,small", [(48, 512, None), (3, 5, None), (48, 512, 0), (2, 4, 12)])
def test_as_all_pairs(spark, monkeypatch, short, block, small):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    if small is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda mean: small)
    docs = corpus(short, 260)
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, node string, n string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(d).collect()), key=repr)
    assert got == brute(docs)


def test_lists_too_long_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HUGE", 3)
    docs = corpus(11, 260)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(d).collect()), key=repr)
    assert got == brute(docs)


def test_words_made_to_meet(spark):
    """Words that any polynomial modulo a power of two hashes alike: Thue-Morse and its complement."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    turned = morse.translate({97: "b", 98: "a"})
    docs = [(1, f"{morse} two three four five"), (2, f"{turned} two three four five"), (3, morse[:100] + " x"), (4, turned[:100] + " x")]
    got = {r.doc_id: (r.component_id, r.n_links, r.n_shingles) for r in jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: (i, 0, 1) for i in (1, 2, 3, 4)}


def test_hashes_tell_words_apart():
    from broadsheet.llm.hashing import LETTERS, hash_words
    from broadsheet.llm.shingles import IN_WORD

    r = random.Random(3)
    words = sorted({"".join(r.choice("ab\u00e9") for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 255, 256, 257, 700]))) for _ in range(3000)})
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    one, two = (hash_words(raw, np.array([0, len(raw)]), IN_WORD, LETTERS, k)[0] for k in (0, 5))
    assert len(set(one.tolist())) == len(words) and not set(one.tolist()) & set(two.tolist())
    again = hash_words(np.frombuffer(words[7].upper().encode() if words[7].isascii() else words[7].encode(), np.uint8), np.array([0, len(words[7].encode())]), IN_WORD, LETTERS)[0]
    assert again[0] == one[7]


def test_one_of_each(spark):
    docs = corpus(4, 150) + [(None, "alone with no id at all"), (None, "alone with no id at all"), (None, "another one that has no id"), (50, "same id but other words here"), (50, "the same id but not linked at all with it")]
    d = spark.createDataFrame([(i, t, f"c{k}", "x", "y") for k, (i, t) in enumerate(docs)], "doc_id long, text string, id_ string, digest string, set_ string").repartition(3)
    left = ngram_join.one_of_each(d)
    assert left.columns == d.columns
    got = left.collect()
    want = brute(docs)
    assert sorted((r.doc_id for r in got if r.doc_id is not None and words_of(r.text) != [""]), key=repr).count(50) == 2
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in ([x for x in words_of(t) if x] for _, t in docs)]
    left_sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in ([x for x in words_of(r.text) if x] for r in got)]
    assert sum(not s for s in left_sets) == sum(not s for s in sets)
    linked_sets = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and linked_sets(sets[i], sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert sum(bool(s) for s in left_sets) == len({root(i) for i, s in enumerate(sets) if s})
    assert {r.doc_id for r in got if r.doc_id is not None} == {c for d, n, c in want if c is not None and (d == c)}
    assert ngram_join.one_of_each(d.limit(0)).collect() == []


@pytest.mark.parametrize("short,block", [(48, 512), (3, 5)])
def test_links_as_all_pairs(spark, monkeypatch, short, block):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = corpus(short + 1, 260)
    sets = []
    for _, text in docs:
        w = [x for x in words_of(text) if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    want = []
    for i, (doc_id, _) in enumerate(docs):
        others = [s for j, s in enumerate(sets) if j != i and sets[i] and 100 * len(sets[i] & s) >= 80 * len(sets[i] | s)]
        same = [d for (d, _), s in zip(docs, sets) if s == sets[i] and d is not None] if sets[i] else [doc_id]
        want.append((doc_id, min(same, default=None), len(others), others.count(sets[i]) + 1))
    assert any(n > size for _, _, n, size in want)
    got = jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.group_size) for r in got), key=repr) == sorted(want, key=repr)


def test_ids_sent_or_joined(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SENT_IDS", -1)
    docs = corpus(9, 150)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(docs)


@pytest.mark.parametrize("sent", [400_000, -1])
def test_one_id_before_a_third_of_all_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(ngram_join, "SENT_IDS", sent)
    r = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    near = [" ".join(w if r.random() > 0.01 else f"x{r.randint(0, 9)}" for w in base) for _ in range(60)]
    docs = [(7, t) for t in near] + [(7, near[0])] * 30 + corpus(3, 90)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(((g.doc_id, g.n_shingles, g.component_id) for g in jaccard_join(df).collect()), key=repr)
    assert got == brute(docs)
    # a text is found again by id and text, so that no row of an id meets another's
    keys = ngram_join._rows(df, "doc_id", "text").select("key_").distinct().count()
    assert keys == len({(d, t) for d, t in docs})


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_list_over_batches():
    import pyarrow as pa

    r = random.Random(4)
    rows = [(5, i, 10 + i // 4500 * 20, 0) for i in range(9000)] + [(h, x, 10, 0) for h, x in {(r.randrange(6, 900), r.randrange(60)) for _ in range(4000)}] + [(901, 1, 10, 0), (901, 2, 10, 0)]
    rows.sort(key=lambda x: (x[0], x[2]))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 700])], ["h", "node", "n", "at"]) for i in range(0, len(rows), 700)]
    # nodes of the long list are told from those of short ones, so that its two sizes stay apart
    shifted = [b.set_column(1, "node", pa.array([x + 100_000 * (h != 5) for x, h in zip(b["node"].to_pylist(), b["h"].to_pylist())])) for b in batches]
    found = {(a, b) for out in ngram_join.scan_lists(iter(shifted)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in found:
        up[root(a)] = root(b)
    assert len({root(i) for i in range(4500)}) == len({root(i) for i in range(4500, 9000)}) == 1 and root(0) != root(8999)
    by_list = {}
    for h, node, _, _ in rows:
        by_list.setdefault(h, set()).add(node + 100_000 * (h != 5))
    for h, nodes in by_list.items():
        if h != 5 and len(nodes) <= ngram_join.SHORT:
            assert all((a, b) in found for a in nodes for b in nodes if a < b)


def test_bitmap_never_rejects_a_link():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 1 << 63, r.integers(0, 200), dtype=np.uint64)]))
        if len(b):
            overlap = len(np.intersect1d(a, b))
            assert differ(bitmap(a), bitmap(b)) <= len(a) + len(b) - 2 * overlap
            assert not linked(overlap, len(a), len(b)) or 9 * differ(bitmap(a), bitmap(b)) <= len(a) + len(b)


def test_subsets_and_boundary():
    a = np.arange(100, 110, dtype=np.uint64)
    assert len(subsets(a)) == n_subsets(10) == 1 + 10 + 45
    assert set(subsets(a[1:]).tolist()) & set(subsets(a).tolist())
    assert boundary(1.0) < boundary(100.0) <= ngram_join.LARGEST_SMALL


@pytest.mark.parametrize("hub", [50_000, 3])
def test_components(spark, monkeypatch, hub):
    from broadsheet.llm import components as module

    monkeypatch.setattr(module, "HUB", hub)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(r.randrange(300, 900), r.randrange(300, 900)) for _ in range(250)] + [(5, 5)] + [(1000, i) for i in range(1001, 1100)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def _long_list(n_passages, near):
    """Texts of a passage that all have and prose of their own, and `near` of them in near copies too."""
    r = random.Random(17)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = []
    for i in range(n_passages):
        own = [f"w{r.randrange(10**6)}" for _ in range(70)]
        docs.append((len(docs), f"{passage} {' '.join(own)}"))
        if i < near:
            docs.append((len(docs), f"{passage} {' '.join(own[:-1])}"))
    return docs


def test_members_of_a_long_list_are_tied_only_where_bitmaps_allow(spark, monkeypatch):
    import numpy as np

    # an order that knows nothing of how common a shingle is, as that of cells that are full
    monkeypatch.setattr(ngram_join, "in_order", lambda tokens, cells: np.sort(tokens))
    docs, seen = _long_list(120, 4), []
    in_blocks = ngram_join.in_blocks
    monkeypatch.setattr(ngram_join, "in_blocks", lambda clusters, nodes: seen.append(sorted(r["count"] for r in clusters.groupBy("cluster").count().collect())) or in_blocks(clusters, nodes))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(docs)
    assert seen == [[2, 2, 2, 2]]


@pytest.mark.parametrize("most", [1 << 22, 500])
def test_ties_lose_no_link(most):
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    sets, early = [], []
    for base in range(6):
        whole = r.integers(0, 1 << 63, 150, np.uint64)
        for _ in range(40):
            sets.append(np.unique(np.r_[whole[r.random(150) < 0.97][: r.integers(90, 150)], r.integers(0, 1 << 63, r.integers(0, 12), np.uint64)]))
            early.append(bool(r.random() < 0.7))
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    rows = [(5, i, len(sets[i]), early[i], ngram_join.bitmap(sets[i])) for i in order]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 70])], ["h", "node", "n", "early", "map"]) for i in range(0, len(rows), 70)]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for out in ngram_join.tie_lists(iter(batches), most):
        for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist()):
            up[root(a)] = root(b)
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            small = min((len(sets[k]), k) for k in (i, j))[1]
            if (early[small] or len(sets[i]) == len(sets[j]) and early[i] | early[j]) and ngram_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                links += 1
                assert root(i) == root(j)
    assert links > 100
    if most > 500:
        assert len({root(i) for i in range(len(sets))}) >= 6
