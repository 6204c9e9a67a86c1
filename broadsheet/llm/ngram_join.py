"""N-gram Jaccard join, heavy and light by size.

Documents with equal sets are one node. A link of Jaccard 0.8 means an overlap of four ninths of both
sizes together. Small sets are found by enumerating their subsets of the sizes that an overlap can
have: linked sets share one. Large sets are found by scanning inverted lists: shingles are ordered by
how often the corpus has them, rarest first, and linked sets share one among the first few of each. The
size at which lists become cheaper than subsets is computed from the counts.

Pairs from short lists are checked by a bitmap that never rejects a link. Members of a long list are tied
to each other where sizes, places and bitmaps allow a link, with one tie for each member; lists whose bitmaps
are too much for a task are tied by sizes and places alone, and lists so long that no task should read one by
aggregation. What hangs together is then compared in full, in blocks of bounded size of sets that are not too
different in size; the blocks of a large group are larger, so that what is dealt out does not grow with its square. A block gives back the links that make its components, and for every node
the number of documents it is linked with there: every link is counted, though no step writes out all
pairs of a group. The work on a group of n near copies is that of n * n / 2 comparisons, spread over blocks.

Words are hashed under a key that is drawn for each run, and sets are told apart by 128 bits, so that
neither chance nor a text made for it joins documents that share nothing.
"""

from __future__ import annotations

import functools
import itertools
import math
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import cut, lookup, own_name, table
from broadsheet.llm.components import components
from broadsheet.llm.shingles import sets_of

#: Words of a shingle.
WORDS = 5
#: Cells that shingles are counted in, and parts that the counts are added up in. Shingles that share a
#: cell share a count; any order gives the same links, so that this only moves work.
CELLS, SEGMENTS = 1 << 20, 256
#: Members of a list up to which its pairs are written out.
SHORT = 48
#: No set beyond this size is enumerated; it has 1,160 subsets.
LARGEST_SMALL = 19
#: Bytes of bitmaps of a long list up to which its members are tied by them.
MAPS = 1 << 22
#: Nodes of a block at most, about, and their tokens; and how many times as many in a group of more than DEALT blocks.
BLOCK, BLOCK_TOKENS, DEALT, LARGER = 128, 2_000_000, 16, 8
#: Sets are in one band or in neighbouring ones if they can be linked: 1.26 is beyond 1 / 0.8.
BAND = 1.26
#: A list of more members than this, by the count of its cell, is tied by aggregation.
HUGE = 65_536
#: So many ids are sent to all workers; more are joined by a shuffle.
SENT_IDS = 400_000
#: Shingles that a task counts together, and sets that it knows it has reported.
COUNTED, REMEMBERED = 1 << 21, 1 << 18


def linked(overlap: int, a: int, b: int) -> bool:
    """100 * intersection >= 80 * union."""
    return 100 * overlap >= 80 * (a + b - overlap)


def n_subsets(size: int) -> int:
    """Subsets that an overlap of a set of this size with a linked one can be."""
    return sum(math.comb(size, d) for d in range(size // 5 + 1))


def boundary(mean_list: float) -> int:
    """The largest size whose subsets cost less than scanning its lists of this mean length."""
    best = 0
    for size in range(1, LARGEST_SMALL + 1):
        if n_subsets(size) > max(1, size - -(-size * 4 // 5) + 1) * max(mean_list, 1.0) * 4:
            break
        best = size
    return best


def subsets(tokens: np.ndarray) -> np.ndarray:
    """A signature of every subset that an overlap can be."""
    mixed = tokens * np.uint64(0x9FB21C651E98DF25)
    mixed ^= mixed >> np.uint64(31)
    whole, n = mixed.sum(dtype=np.uint64), len(tokens)
    out = []
    with np.errstate(over="ignore"):
        for d in range(n // 5 + 1):
            for gone in itertools.combinations(range(n), d):
                out.append((whole - mixed[list(gone)].sum(dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n - d))
    return np.array(out, np.uint64)


def bitmap(tokens: np.ndarray) -> bytes:
    """The parity of tokens in each of a number of cells that grows with the set."""
    cells = 1 << max(9, int(4 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differ(a: bytes, b: bytes) -> int:
    """A lower bound of how many tokens are in one set alone. A larger map is folded to the smaller's cells."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def cell_counts(df: DataFrame, tokens_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How many of the tokens that `tokens_of` finds in batches of `df` fall into each of CELLS cells.

    Each task counts for itself and sends its cells in SEGMENTS parts, which are added up one by one, so
    that neither a task nor the driver holds more than the cells once.
    """

    size = CELLS // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held, n = np.zeros(CELLS, np.int64), [], 0
        for tokens in itertools.chain.from_iterable(map(tokens_of, batches)):
            held.append(tokens)
            n += len(tokens)
            if n >= COUNTED:
                cells += np.bincount(cell_of(np.concatenate(held)), minlength=CELLS)
                held, n = [], 0
        if held:
            cells += np.bincount(cell_of(np.concatenate(held)), minlength=CELLS)
        if cells.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SEGMENTS)), pa.array([narrow(part) for part in np.split(cells, SEGMENTS)], pa.binary())], ["part", "cells"])

    def narrow(part: np.ndarray) -> bytes:
        """In as few bytes a cell as the largest needs."""
        return part.astype(np.min_scalar_type(int(part.max()))).tobytes()

    def wide(part: bytes) -> np.ndarray:
        return np.frombuffer(part, f"u{len(part) // size}").astype(np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch["part"].to_pylist(), batch["cells"], strict=True):
                sums[part] = sums.get(part, 0) + wide(cells.as_py())
        for part, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([narrow(cells)], pa.binary())], ["part", "cells"])

    schema = "part long, cells binary"
    total = np.zeros(CELLS, np.int64)
    for row in df.mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():  # CELLS numbers
        total[row["part"] * size : (row["part"] + 1) * size] = wide(bytes(row["cells"]))
    return total


def counted(docs: DataFrame, key: int) -> tuple[np.ndarray, float]:
    """How many shingles fall into each cell, and about how long the list of a shingle is."""
    seen: set[bytes] = set()

    def tokens_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, digest, tokens in sets_of(batch.column(0), WORDS, key):
            if digest and digest not in seen:
                if len(seen) < REMEMBERED:
                    seen.add(digest)
                yield tokens

    total = cell_counts(docs.select("text_"), tokens_of)
    n = int(total.sum())
    # what a cell holds beside a shingle's own list is the mean of all cells
    return total, max(1.0, float((total.astype(np.float64) ** 2).sum()) / max(n, 1) - n / CELLS)


def cell_of(tokens: np.ndarray) -> np.ndarray:
    """The cell that a shingle is counted in."""
    return (tokens >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def in_order(tokens: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Tokens by the count of their cells, the least first, ties by their own value."""
    return tokens[np.lexsort((tokens, cells[cell_of(tokens)]))]


def described(docs: DataFrame, cells: np.ndarray, small: int, key: int) -> DataFrame:
    """doc_id, key_, n, digest, map, prefix and subsets of every row; the last three once for each set and task."""
    counts = docs.sparkSession.sparkContext.broadcast(cells.astype(np.uint32) if cells.max(initial=0) < 1 << 32 else cells)  # CELLS numbers

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            n, digests, maps, first, subs = [], [], [], [], []
            for _, digest, tokens in sets_of(batch.column(2), WORDS, key):
                n.append(len(tokens))
                digests.append(digest)
                if not digest or digest in seen:
                    maps.append(None)
                    first.append(None)
                    subs.append(None)
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(digest)
                maps.append(bitmap(tokens))
                # small sets meet large ones in lists, where the sizes allow it
                as_list = len(tokens) > small or 5 * len(tokens) >= 4 * (small + 1)
                first.append(in_order(tokens, counts.value)[: len(tokens) - -(-len(tokens) * 4 // 5) + 1].view(np.int64) if as_list else None)
                subs.append(subsets(tokens).view(np.int64) if len(tokens) <= small else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(maps, pa.binary()), pa.array(first, longs), pa.array(subs, longs)], ["doc_id", "key_", "n", "digest", "map", "prefix", "subsets"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "key_", "text_").mapInArrow(describe, f"doc_id {kind}, key_ string, n long, digest binary, map binary, prefix array<long>, subsets array<long>")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists, and the row of each."""
    size = np.asarray(lists.value_lengths().fill_null(0))
    return np.asarray(lists.flatten()).view(np.uint64), np.repeat(np.arange(len(lists)), size)


def posted(tokens: DataFrame, heavy: bool, lists: np.ndarray) -> DataFrame:
    """(h, node, n, at) of every token that a node is listed under: at is its place, -1 for a subset.

    lists: members by cell, of which those of one list are a part; heavy says which tokens are wanted, those
    whose cell stands out by more than HUGE or the others.
    """
    sent = tokens.sparkSession.sparkContext.broadcast(lists - int(lists.mean()) > HUGE)  # CELLS bits

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for column, places in ((2, True), (3, False)):
                h, row = _flat(batch.column(column))
                at = np.arange(len(row)) - np.searchsorted(row, row) if places else np.full(len(row), -1)
                take = sent.value[cell_of(h)] == heavy
                yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (h.view(np.int64), node[row], n[row], at)], ["h", "node", "n", "at"])

    return tokens.select("node", "n", "prefix", "subsets").mapInArrow(post, "h long, node long, n long, at long")


def is_early(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a set can be the smaller one of a link whose first common shingle, or subset, is at this place."""
    return at <= n - -(-8 * n // 9)


def runs(node: np.ndarray, n: np.ndarray, at: np.ndarray, root: int | None = None, last: int = 0) -> tuple[np.ndarray, int]:
    """For members of one list in order of size, the first of those that hang together, and the size of the last early one.

    An early member hangs together with all that follow as far as their sizes allow a link with it; two that
    are not early are not linked by this list. root and last go on from a run before.
    """
    # sizes are in order, and so the last early one is the largest
    early = np.maximum.accumulate(np.r_[last, np.where(is_early(n, at), n, 0)])
    new = 5 * early[:-1] < 4 * n
    if root is None:
        new[0] = True
    begin = np.maximum.accumulate(np.where(new, np.arange(len(node)), -1))
    return np.where(begin >= 0, node[begin], root if root is not None else 0), int(early[-1])


#: What a row of scan_lists() is: a pair (a, b) that may be linked, one that is tied, or node a of long list b, which is early or not.
PAIR, TIE, LATE, EARLY = range(4)


def scan_lists(batches: Iterator[pa.RecordBatch], short: int = SHORT, tie: bool = True) -> Iterator[pa.RecordBatch]:
    """From postings (h, node, n, at) in order of h and n: (a, b, kind), pairs of short lists, and ties of long ones.

    Without `tie` the members of long lists are given out instead, for tie_lists(). Of lists without an early member there is neither.
    """
    none = [np.zeros(0, np.int64)] * 4
    held = none
    tied: tuple[int, int, int] | None = None  # of a long list that goes on: h, the first of its open run, the size of its last early member

    def given(a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(kind.astype(np.int8))], ["a", "b", "kind"])

    def written(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
        keep = a != b
        a, b = a[keep], b[keep]
        return given(np.minimum(a, b), np.maximum(a, b), np.full(len(a), kind))

    def of_long(h: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, first: np.ndarray, whole: bool = False) -> pa.RecordBatch:
        if tie:
            return written(node, first, TIE)
        early = is_early(n, at)
        some = slice(None) if early.any() or not whole else slice(0)
        return given(node[some], h[some], np.where(early, EARLY, LATE)[some])

    for batch in itertools.chain(batches, [None]):
        rows = [np.concatenate(x) for x in zip(held, [np.asarray(batch.column(i)) for i in range(4)], strict=True)] if batch is not None else held
        if not len(rows[0]):
            continue
        if tied and rows[0][0] == tied[0]:
            end = int(np.searchsorted(rows[0], tied[0], "right"))
            first, early = runs(*(x[:end] for x in rows[1:]), *tied[1:])
            yield of_long(*(x[:end] for x in rows), first)
            tied = (tied[0], int(first[-1]), early)
            rows = [x[end:] for x in rows]
            if not len(rows[0]):
                held = none
                continue
        h, node, n, at = rows
        last = len(h) if batch is None else int(np.searchsorted(h, h[-1], "left"))
        if batch is not None and len(h) - last > 4096:  # one list so long that it is not held
            first, early = runs(node[last:], n[last:], at[last:])
            yield of_long(h[last:], node[last:], n[last:], at[last:], first)
            tied, held = (int(h[last]), int(first[-1]), early), none
        else:
            held = [x[last:] for x in rows]
        h, node, n, at = (x[:last] for x in rows)
        if not last:
            continue
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[begin, len(h)])
        for length in np.unique(size[size > 1]):
            of = begin[size == length]
            if length > short:
                for low in of:
                    of_list = [x[low : low + length] for x in (h, node, n, at)]
                    yield of_long(*of_list, runs(*of_list[1:])[0], whole=True)
                continue
            left, right = np.triu_indices(length, 1)
            x, y = (of[:, None] + left).ravel(), (of[:, None] + right).ravel()  # x is not the larger
            need = -(-4 * (n[x] + n[y]) // 9)
            near = 5 * n[x] >= 4 * n[y]
            inside = is_early(n[x], at[x])
            # what may be common: before this place, and from it on
            room = np.minimum(at[x], at[y]) + np.minimum(n[x] - at[x], n[y] - at[y])
            take = near & ((at[x] < 0) | (at[y] < 0) | inside & (room >= need))
            if take.any():
                yield written(node[x[take]], node[y[take]], PAIR)


def tied_by_maps(n: np.ndarray, early: np.ndarray, maps: list[bytes]) -> list[tuple[int, int]]:
    """For members of one list in order of size, places (i, j) that make the groups of those whose sizes, places and bitmaps allow links."""
    lengths = np.array([len(m) for m in maps])
    low, high = np.searchsorted(n, -(-4 * n // 5), "left"), np.searchsorted(n, 5 * n // 4, "right")
    out = []
    for length in np.unique(lengths):
        # sizes that allow a link have maps of one length or of two that follow each other
        some = np.flatnonzero((lengths == length) | (lengths == 2 * length) & (low < np.searchsorted(lengths, length, "right")))
        bits = np.empty((len(some), length), np.uint8)
        for k, i in enumerate(some):
            m = np.frombuffer(maps[i], np.uint8)
            bits[k] = m if len(m) == length else m[:length] ^ m[length:]
        words, size, first = bits.view(np.uint64), n[some], early[some]
        left = np.ones(len(some), bool)
        for k in range(len(some)):
            if not left[k]:
                continue
            left[k], reached = False, [k]
            while reached:
                i = reached.pop()
                begin, end = np.searchsorted(some, (low[some[i]], high[some[i]]))
                to = begin + np.flatnonzero(left[begin:end])
                # the smaller one of a pair is early; of equal sizes either may count as the smaller
                to = to[np.where(size[to] < size[i], first[to], first[i] | first[to] & (size[to] == size[i]))]
                to = to[9 * np.bitwise_count(words[to] ^ words[i]).sum(axis=1, dtype=np.int64) <= size[to] + size[i]]
                left[to] = False
                out += [(some[i], some[j]) for j in to]
                reached += to.tolist()
    return out


def tie_lists(batches: Iterator[pa.RecordBatch], most: int = MAPS) -> Iterator[pa.RecordBatch]:
    """From members (h, node, n, early, map) of long lists in order of h and n: ties (a, b), one for each member at most and length of map.

    A list of more than `most` bytes of maps is tied as it comes, by sizes and places; see runs().
    """
    held: list[tuple[int, int, bool, bytes]] = []
    h, weight, root, last = None, 0, None, 0

    def by_runs() -> list[tuple[int, int]]:
        nonlocal root, last
        node, n, early = (np.array(x) for x in list(zip(*held, strict=True))[:3])
        first, last = runs(node, n, np.where(early, -1, n), root, last)
        root = int(first[-1])
        return list(zip(node.tolist(), first.tolist(), strict=True))

    def done() -> pa.RecordBatch:
        found = []
        if root is not None and held:
            found = by_runs()
        elif len(held) > 1:
            node, n, early, maps = zip(*held, strict=True)
            found = [(node[i], node[j]) for i, j in tied_by_maps(np.array(n), np.array(early), list(maps))]
        found = [(min(x), max(x)) for x in found if x[0] != x[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], ["a", "b"])

    for batch in batches:
        for of, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != h:
                yield done()
                held, h, weight, root, last = [], of, 0, None, 0
            held.append(tuple(member))
            weight += len(member[3])
            if weight > most:
                found = by_runs()
                yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.int64()) for f in (min, max)], ["a", "b"])
                held, weight = [], 0
    yield done()


def aggregated(heavy: DataFrame) -> DataFrame:
    """Ties (a, b) between members of lists that no task should read whole, band by band, where one of them is early."""
    early = F.col("at") <= F.col("n") - F.ceil(8 * F.col("n") / 9)
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND))
    listed = heavy.select("node", early.alias("early"), F.explode(F.array(F.xxhash64("h", band), F.xxhash64("h", band + 1))).alias("list"))
    first = listed.groupBy("list").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members"), F.max("early").alias("early")).filter("early")
    return lookup(listed, first, "list", "members", ["first"]).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bitmaps do not rule out a link."""
    for batch in batches:
        a, b, na, nb, ma, mb = (c.to_pylist() for c in batch.columns)
        keep = [9 * differ(x, y) <= i + j for i, j, x, y in zip(na, nb, ma, mb, strict=True)]
        at = [i for i, k in enumerate(keep) if k]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in at], pa.int64()), pa.array([b[i] for i in at], pa.int64())], ["a", "b"])


def forest(nodes: list[int], sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between nodes marked left and nodes marked right, as many as make their components; and for
    every node the copies of all others that it is linked with. The marks are equal or have no node in common."""
    up = list(range(len(nodes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    sizes = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    by_token, begin = owner[order], np.searchsorted(token[order], np.arange(token.max() + 2))
    ends, out = np.cumsum(sizes), []
    total, across = np.zeros(len(sets), np.int64), not (left & right).any()
    for i in np.flatnonzero(left):
        mine = token[ends[i] - sizes[i] : ends[i]]
        low, length = begin[mine], begin[mine + 1] - begin[mine]
        shared = length > 1
        low, length = low[shared], length[shared]
        if not len(low):
            continue
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        overlap = np.bincount(by_token[np.repeat(low, length) + step], minlength=len(sets))
        to = right & (100 * overlap >= 80 * (sizes[i] + sizes - overlap))
        to[i] = False
        total[i] += copies[to].sum()
        if across:
            total[to] += copies[i]
        for j in np.flatnonzero(to):
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((nodes[i], nodes[j]))
    return out, total


_OF_BLOCKS = "cluster long, low_band int, low int, high_band int, high int"


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks the links (a, b, null) that make its components, and the links of each node, (a, null, linked).

    Rows are (cluster, low_band, low, high_band, high, band, block, node, copies, set) in order of the first five.
    """

    def links(rows: list[tuple[tuple[int, int], int, int, bytes]], low: tuple[int, int], high: tuple[int, int]) -> pa.RecordBatch:
        once = {node: (at, copies, tokens) for at, node, copies, tokens in rows}
        nodes = sorted(once)
        left, right = (np.array([once[x][0] == at for x in nodes]) for at in (low, high))
        copies = np.array([once[x][1] for x in nodes])
        found, total = forest(nodes, [np.frombuffer(once[x][2], np.uint64) for x in nodes], copies, left, right)
        some = np.flatnonzero(total)
        a, b = [x for x, _ in found] + [nodes[i] for i in some], [y for _, y in found] + [None] * len(some)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(found) + total[some].tolist(), pa.int64())], ["a", "b", "linked"])

    held, key = [], None
    for batch in batches:
        for *of, band, block, node, copies, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != key:
                if len(held) > 1:
                    yield links(held, tuple(key[1:3]), tuple(key[3:5]))
                held, key = [], of
            held.append(((band, block), node, copies, tokens))
    if len(held) > 1:
        yield links(held, tuple(key[1:3]), tuple(key[3:5]))


def in_blocks(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, cluster, band and block of every node, and the numbers of blocks in its band and in those beside it."""
    banded = clusters.join(nodes.select("node", "n", "copies", "first_key", "digest"), "node").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int"))
    sizes = banded.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
    nodes_of = F.greatest(F.lit(BLOCK), F.least(F.col("members") / DEALT, F.lit(BLOCK * LARGER)))
    blocks = F.ceil(F.greatest(F.col("members") / nodes_of, F.col("tokens") / BLOCK_TOKENS)).cast("int")
    # a band for every quarter of size: a cluster has few
    by_cluster = sizes.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("band", blocks.alias("blocks")))).alias("blocks"), F.sum("members").alias("members"))
    told = lookup(cut(banded), by_cluster, "cluster", "members", ["blocks"])
    here = lambda step: F.coalesce(F.try_element_at("blocks", F.col("band") + step), F.lit(0))
    return told.select("node", "cluster", "band", "copies", "first_key", "digest", F.pmod(F.xxhash64("node"), here(0)).cast("int").alias("block"), here(-1).alias("before"), here(0).alias("own"), here(1).alias("after"))


def dealt(sets: DataFrame) -> DataFrame:
    """Every set once for each pair of blocks that it is compared in: with those of its band, and of the bands beside it."""
    to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda low_band, low, high_band, high: F.struct(low_band.alias("low_band"), low.alias("low"), high_band.alias("high_band"), high.alias("high"))
    band, block = F.col("band"), F.col("block")
    pairs = F.concat(
        F.transform(to("own"), lambda j: pair(band, F.least(block, j), band, F.greatest(block, j))),
        F.transform(to("after"), lambda j: pair(band, block, band + 1, j)),
        F.transform(to("before"), lambda j: pair(band - 1, j, band, block)),
    )
    return sets.select("cluster", F.explode(pairs).alias("pair"), "band", "block", "node", "copies", "tokens").select("cluster", "pair.*", "band", "block", "node", "copies", "tokens")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids and texts, and a key to find a row again: its id, if it has one, and a hash of its text, as an id may stand before many texts."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text_"), F.concat_ws("|", F.col(id_col).cast("string"), F.hex(F.xxhash64(text))).alias("key_"))


def _joined(docs: DataFrame, id_col: str, text_col: str, key: int) -> DataFrame:
    """doc_id, n, digest, root, component, class, copies and links of every row; root tells components apart, where no row has an id too."""
    rows = _rows(docs, id_col, text_col)
    cells, mean = counted(rows, key)
    small = boundary(mean)
    sets = cut(described(rows, cells, small, key).withColumn("row", F.monotonically_increasing_id()))
    of_set = sets.filter("n > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_")).alias("least"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.max("map").alias("map"), F.min(F.when(F.col("map").isNotNull(), F.col("row"))).alias("row")
    )
    nodes = cut(of_set.select("digest", F.col("least.doc_id").alias("first_id"), F.col("least.key_").alias("first_key"), "n", "copies", "map", "row", F.monotonically_increasing_id().alias("node")))
    # tokens move once, from the row of each set that has them
    tokens = sets.filter("map is not null").select("row", "prefix", "subsets").join(nodes.select("row", "node", "n"), "row")
    lists = cell_counts(sets.select("prefix", "subsets"), lambda batch: (_flat(batch.column(i))[0] for i in range(2)))
    found = cut(posted(tokens, False, lists).repartition("h").sortWithinPartitions("h", "n").mapInArrow(functools.partial(scan_lists, short=SHORT, tie=False), "a long, b long, kind byte").distinct())
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("map").alias(f"m{x}"))
    pairs = found.filter(F.col("kind") == PAIR).select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ma", "mb")
    # a list that went on over batches may name a member twice
    members = found.filter(F.col("kind") != PAIR).groupBy(F.col("b").alias("h"), F.col("a").alias("node")).agg(F.max("kind").alias("kind"))
    in_lists = members.join(nodes.select("node", "n", "map"), "node").select("h", "node", "n", (F.col("kind") == EARLY).alias("early"), "map")
    ties = in_lists.repartition("h").sortWithinPartitions("h", "n").mapInArrow(functools.partial(tie_lists, most=MAPS), "a long, b long").distinct()
    ties = ties.unionByName(pairs.mapInArrow(alike, "a long, b long"))
    if (lists - int(lists.mean()) > HUGE).any():
        ties = ties.unionByName(aggregated(posted(tokens, True, lists)))
    clusters = components(ties).withColumnRenamed("root", "cluster")
    wanted = cut(in_blocks(clusters, nodes))
    few = wanted.count() <= SENT_IDS
    named = wanted.withColumnRenamed("first_key", "key_")
    texts = rows.select("key_", "text_")
    # rows that repeat each other share a key, which may be hot
    texts = texts.join(F.broadcast(named), "key_") if few else lookup(texts, named, "key_", "copies", [c for c in named.columns if c != "key_"]).filter("node is not null")
    texts = texts.select("cluster", "band", "block", "before", "own", "after", "node", "copies", "digest", "text_")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # rows may repeat each other
        for batch in batches:
            node, digests = batch.column(6).to_pylist(), batch.column(8).to_pylist()
            at, tokens = [], []
            for i, digest, t in sets_of(batch.column(9), WORDS, key):
                if digest == digests[i] and node[i] not in sent:  # an id may stand before other texts too
                    if len(sent) < REMEMBERED:
                        sent.add(node[i])
                    at.append(i)
                    tokens.append(t.tobytes())
            took = batch.select(["cluster", "band", "block", "before", "own", "after", "node", "copies"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(tokens, pa.binary())], [*took.schema.names, "tokens"])

    full = texts.mapInArrow(again, "cluster long, band int, block int, before int, own int, after int, node long, copies long, tokens binary")
    key_of = [c.split(" ")[0] for c in _OF_BLOCKS.split(", ")]
    compared = cut(dealt(full).repartition(*key_of).sortWithinPartitions(*key_of).mapInArrow(compare, "a long, b long, linked long"))
    roots = components(compared.filter("b is not null").select("a", "b"))
    linked_with = compared.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    least = roots.join(nodes.select("node", "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("component"), F.count(F.lit(1)).alias("members"))
    named = lookup(roots, least, "root", "members", ["component"]).select("node", "root", "component")
    links = (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links")
    groups = nodes.join(named, "node", "left").join(linked_with, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), F.coalesce("component", "first_id").alias("component"), F.col("first_id").alias("class"), "copies", links)
    return lookup(sets.select("doc_id", "n", "digest"), groups, "digest", "copies", ["root", "component", "class", "copies", "links"])


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: int | None = None) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, class_id, group_size and n_links.

    class_id is the smallest id of the rows with an equal set, and group_size their number; n_links is the
    number of other rows that a row is linked with, those with an equal set among them.

    A-Z are lower-cased; words are runs of characters outside [\\x20\\x09-\\x0D]; a text of fewer than
    WORDS words has its whole sequence as one shingle. Null texts and texts without words have no shingle
    and are linked with nothing: their component_id and class_id are their own id, as for null ids without links.
    Shingles are compared by 64-bit hashes under `key`, which is drawn if it is not given, and sets by 128
    bits. Rows that share an id are documents of their own. Other columns are not read. An empty table gives
    an empty result.
    """
    got = _joined(docs, id_col, text_col, secrets.randbits(64) if key is None else key)
    return got.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("class", "doc_id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of `docs` the row with the smallest id, with all its columns.

    Rows without shingles are components of their own and stay. A row without an id stays where no row with
    one is linked with it. Where rows of a component share the smallest id, one of them stays: the one whose
    set comes first, and of rows with equal sets any one. See jaccard_join().
    """
    key = secrets.randbits(64)
    got = _joined(docs, id_col, text_col, key)
    name, of_set, mark, nth = (own_name(docs, x) for x in ("id_", "set_", "digest_", "nth_"))
    stay = cut(got.filter(F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(name), F.col("digest").alias(of_set), "root"))
    same_id = F.col(id_col).eqNullSafe(F.col(name))
    if stay.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs.join(stay.select(name), same_id, "left_semi")

    @F.pandas_udf("binary")
    def digest_of(texts: pd.Series) -> pd.Series:
        return pd.Series([d for _, d, _ in sets_of(pa.array(texts, pa.string()), WORDS, key)], dtype=object)

    marked = docs.withColumn(mark, digest_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    full, empty = stay.filter(F.col(of_set).isNotNull()), stay.filter(F.col(of_set).isNull())
    chosen = full.groupBy(name, "root").agg(F.min(of_set).alias(of_set)).select(name, of_set).unionByName(empty.select(name, of_set).distinct())
    left = marked.join(chosen, same_id & F.col(mark).eqNullSafe(F.col(of_set)), "left_semi")
    filled = left.filter(F.col(mark).isNotNull()).withColumn(nth, F.row_number().over(Window.partitionBy(id_col, mark).orderBy(F.lit(1)))).filter(F.col(nth) == 1).drop(nth)
    return filled.unionByName(left.filter(F.col(mark).isNull())).drop(mark)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_join() over the whole documents table."""
    return jaccard_join(table(spark, sf_dir, "documents"))


#: All pairs of documents that share a shingle: for tables of a size that bears it.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS line, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT line, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM d
), n AS (
  SELECT line, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS whole FROM s GROUP BY line
), met AS (
  SELECT a.line AS a, b.line AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.line <> b.line GROUP BY a.line, b.line
), links AS (
  SELECT a, b FROM met JOIN n x ON x.line = a JOIN n y ON y.line = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach(line, other) AS (
  SELECT line, line FROM n UNION SELECT reach.line, links.b FROM reach JOIN links ON links.a = reach.other
), component AS (
  SELECT reach.line, min(d.doc_id) AS component_id FROM reach JOIN d ON d.line = other GROUP BY reach.line
), linked AS (
  SELECT a AS line, count(*) AS n_links FROM links GROUP BY a
), class AS (
  SELECT line, min(doc_id) OVER (PARTITION BY whole) AS class_id, count(*) OVER (PARTITION BY whole) AS group_size FROM n JOIN d USING (line)
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(class_id, doc_id) AS class_id, coalesce(group_size, 1) AS group_size, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (line) LEFT JOIN component USING (line) LEFT JOIN class USING (line) LEFT JOIN linked USING (line)
"""
