"""Benchmark decontamination by winnowing.

Of every W consecutive hashes of K words the least is kept as a fingerprint. A span of W + K - 1 words
that a document shares with a benchmark item is such a window in both, so both keep the same hash at
the same place in it: no shared span of that length goes unseen. Fingerprints are joined, and each meeting
is extended to the left and to the right: every window of the document that the meeting may lie in is
looked up among the benchmark's, once however many meetings it has, and compared word by word.

The benchmark is small as a rule and then goes to every worker, after its size is checked; beyond
BROADCAST_BYTES fingerprints and windows meet in shuffles instead. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.common import cut, lookup, own_name, table
from broadsheet.llm.hashing import LETTERS, chunks, gram_hashes, hash_words

#: Words of a window; an item of fewer words is one window.
SPAN = 10
#: A benchmark of at most so many bytes of text is sent to the workers whole.
BROADCAST_BYTES = 16 << 20

#: Bits of the filter that texts must pass before they move; its size does not depend on the data.
FILTER_BITS = 1 << 27

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BYTES = np.arange(256, dtype=np.uint8)
_IN_WORD = (_BYTES >= 0x80) | (_BYTES >= 0x30) & (_BYTES <= 0x39) | (_BYTES >= 0x61) & (_BYTES <= 0x7A) | (_BYTES >= 0x41) & (_BYTES <= 0x5A)


def words_of(text: str | None) -> list[str]:
    """The words of a text, A-Z lower-cased."""
    return WORD.findall(text.translate(LOWER)) if text else []


def plan(span: int) -> tuple[int, int]:
    """K and W for spans of so many words."""
    k = (span + 1) // 2
    return k, span - k + 1


def fingerprints(words: np.ndarray, begins: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the kept hashes of k words, of all windows of w of them that lie within one text."""
    n = len(words) - k - w + 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(words, k)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    whole = text[:n] == text[k + w - 2 : k + w - 2 + n]
    at = np.flatnonzero(whole)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    # the last of equal ones: nothing but the window's own words decides
    best, value = at.copy(), grams[at]
    for j in range(1, w):
        other = grams[at + j]
        less = other <= value
        best[less], value[less] = at[less] + j, other[less]
    place = np.unique(best)
    return place, grams[place]


def around(place: np.ndarray, begins: np.ndarray, span: int) -> np.ndarray:
    """Where the windows of `span` words begin that a fingerprint at one of these places can be kept for, each once."""
    w = plan(span)[1]
    text = np.searchsorted(begins, place, "right") - 1
    starts = place[:, None] - np.arange(w)[None, :]
    inside = (starts >= begins[text][:, None]) & (starts + span <= begins[text + 1][:, None])
    return np.unique(starts[inside])


class Index:
    """Fingerprints and windows of benchmark items, and their words for comparison."""

    def __init__(self, ids: Sequence[object], texts: Sequence[str | None]) -> None:
        self.ids = ["" if i is None else str(i) for i in ids]
        once: dict[str, str] = {}  # a word that many items have is kept and sent once
        self.words = [[once.setdefault(w, w) for w in words_of(t)] for t in texts]
        self.spans = sorted({min(len(x), SPAN) for x in self.words if x})
        # a key under which no two different windows have one hash
        self.key = next(key for key in itertools.count() if self._read(texts, key))

    def _read(self, texts: Sequence[str | None], key: int) -> bool:
        self.of: dict[int, tuple[np.ndarray, ...]] = {}
        for span in self.spans:
            marks, windows, others, items, places = [], [], [], [], []
            for item, text in enumerate(texts):
                if not self.words[item] or min(len(self.words[item]), SPAN) != span:
                    continue
                raw = np.frombuffer((text or "").encode(), np.uint8)
                bounds = np.array([0, len(raw)])
                hashes, begins = hash_words(raw, bounds, _IN_WORD, LETTERS, key)
                marks.append(fingerprints(hashes, begins, *plan(span))[1])
                windows.append(gram_hashes(hashes, span))
                others.append(gram_hashes(hash_words(raw, bounds, _IN_WORD, LETTERS, ~key)[0], span))
                items.append(np.full(len(windows[-1]), item))
                places.append(np.arange(len(windows[-1])))
            window, other, item, place = map(np.concatenate, (windows, others, items, places))
            order = np.lexsort((item, window))
            window, other, item, place = (x[order] for x in (window, other, item, place))
            if ((window[1:] == window[:-1]) & (other[1:] != other[:-1])).any():
                return False
            once = np.r_[True, (window[1:] != window[:-1]) | (item[1:] != item[:-1])]  # an item that repeats a window has it once
            self.of[span] = (np.unique(np.concatenate(marks)), window[once], item[once], place[once])
        return True

    def found(self, span: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For hashes of windows the first and last entry that have them."""
        known = self.of[span][1]
        return np.searchsorted(known, windows, "left"), np.searchsorted(known, windows, "right")


def covered(runs: Sequence[tuple[int, int]]) -> int:
    """Words in any of the runs."""
    n = reached = 0
    for low, high in sorted(runs):
        n += max(0, high - max(low, reached))
        reached = max(reached, high)
    return n


def digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


NOTHING = digest(set())
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType())]


def measure(index: Index, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """n_words, n_hit, n_items and items_sha256 of each text."""
    n_words, n_hit, n_items = (np.zeros(len(texts), np.int64) for _ in range(3))
    shas = [NOTHING] * len(texts)
    for low, high, data, bounds in chunks(texts):
        hashes, begins = hash_words(data, bounds, _IN_WORD, LETTERS, index.key)
        n_words[low:high] = np.diff(begins)
        runs: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        words: dict[int, list[str]] = {}
        for span in index.spans:
            known, _, item_of, place_of = index.of[span]
            place, value = fingerprints(hashes, begins, *plan(span))
            starts = around(place[np.isin(value, known)], begins, span)
            if not len(starts):
                continue
            first, last = index.found(span, gram_hashes(hashes, span)[starts])
            some = np.flatnonzero(last > first)
            seen: dict[int, set[int]] = {}
            for start, entry, end in zip(starts[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                row = int(np.searchsorted(begins, start, "right")) - 1
                mine = words.get(row) or words.setdefault(row, words_of(texts[low + row].as_py()))
                at, theirs, there = start - int(begins[row]), index.words[item_of[entry]], int(place_of[entry])
                if mine[at : at + span] == theirs[there : there + span]:
                    runs.setdefault(row, []).append((at, at + span))
                    if entry not in seen.setdefault(row, set()):
                        seen[row].add(entry)
                        items.setdefault(row, set()).update(item_of[entry:end].tolist())
        for row, of_row in runs.items():
            ids = {index.ids[i] for i in items[row]}
            n_hit[low + row], n_items[low + row], shas[low + row] = covered(of_row), len(ids), digest(ids)
    return n_words, n_hit, n_items, shas


def _near(docs: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    """Documents against an index that every worker holds: one pass, no shuffle."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, n_items, shas = measure(sent.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(shas, pa.string())], [id_col, *(f.name for f in _FOUND)])

    return rows.mapInArrow(search, T.StructType([rows.schema.fields[0], *_FOUND]))


def _key(text_col: str) -> Column:
    """What a text goes by where fingerprints meet in a shuffle, so that copies are compared once."""
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def _window_digest(words: Sequence[str]) -> bytes:
    """What windows are compared by in a shuffle; no word has a blank."""
    return hashlib.sha256(" ".join(words).encode()).digest()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = {min(len(words_of(t)), SPAN) for t in batch.column(1).to_pylist()} - {0}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(spans), pa.int32())], ["span"])


def _bit(key: str) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 12), 16, 10).cast("long"), F.lit(FILTER_BITS))


def passing(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `texts` (key, text_) whose key may be in `keys`, by a bitmap of FILTER_BITS that every worker gets: no text moves."""
    page = 1 << 15  # bits of one of Spark's bitmaps
    pages = keys.select(_bit("key").alias("bit")).groupBy(F.floor(F.col("bit") / page).alias("page")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(page))).alias("bits"))
    filled = np.zeros((FILTER_BITS // page, page // 8), np.uint8)
    for r in pages.toLocalIterator():
        filled[r["page"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(filled.ravel())  # FILTER_BITS

    def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.asarray(batch.column(2))
            yield batch.select(["key", "text_"]).filter(pa.array((sent.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))

    return texts.select("key", "text_", _bit("key").alias("bit")).mapInArrow(let_through, "key string, text_ string")


def _met(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """key, low, high and window of every window that a text shares with an item, and the items' windows, for a benchmark too large to send about.

    Only fingerprints leave the documents at first. Texts move where one of theirs is known, each once, and
    of these only the windows around such a fingerprint go on.
    """
    theirs = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text_"))
    spans = [r["span"] for r in theirs.mapInArrow(_sizes, "span int").distinct().collect()]  # SPAN values at most

    def kept(batches: Iterator[pa.RecordBatch], only_own: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in chunks(batch.column(1)):
                hashes, begins = hash_words(data, bounds, _IN_WORD, LETTERS)
                for span in spans:
                    place, value = fingerprints(hashes, begins, *plan(span))
                    row = np.searchsorted(begins, place, "right") - 1
                    if only_own:
                        own = np.minimum(np.diff(begins), SPAN)[row] == span
                        row, value = row[own], value[own]
                    pairs = np.unique(np.rec.fromarrays([row, value]))
                    take = pa.array(pairs.f0 + low)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(pairs.f1.view(np.int64)), pa.array(np.full(len(take), span, np.int32))], ["key", "value", "span"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := words_of(text):
                    span = min(len(words), SPAN)
                    found = sorted({_window_digest(words[i : i + span]) for i in range(len(words) - span + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found)), pa.array(found, pa.binary())], ["item", "window"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, values in zip(*(batch.column(i) for i in range(3)), strict=True):
                words, met = words_of(text.as_py()), {(v["span"], v["value"]) for v in values.as_py()}
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                hashes, begins = hash_words(raw, np.array([0, len(raw)]), _IN_WORD, LETTERS)
                for span in sorted({s for s, _ in met}):
                    place, value = fingerprints(hashes, begins, *plan(span))
                    known = np.array([v for s, v in met if s == span], np.int64).view(np.uint64)
                    starts = around(place[np.isin(value, known)], begins, span)
                    out = [pa.array([key.as_py()] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(starts + span, pa.int64()), pa.array([_window_digest(words[i : i + span]) for i in starts.tolist()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(out, ["key", "low", "high", "window"])

    schema = "key string, value long, span int"
    texts = docs.select(_key(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"))
    ours = texts.mapInArrow(lambda b: kept(b, False), schema).distinct().withColumn("mark", F.xxhash64("value", "span"))
    known = theirs.mapInArrow(lambda b: kept(b, True), schema).groupBy(F.xxhash64("value", "span").alias("mark")).agg(F.count(F.lit(1)).alias("items_"))
    of_text = lookup(cut(ours), cut(known), "mark", "items_", ["items_"]).filter("items_ is not null").groupBy("key").agg(F.collect_set(F.struct("span", "value")).alias("values"), F.lit(True).alias("met"))
    of_text = cut(of_text)
    # copies of a text leave their task once, as they are grouped before they meet anything
    moved = passing(texts, of_text).groupBy("key").agg(F.first("text_").alias("text_"))
    mine = moved.join(of_text, "key").select("key", "text_", "values").mapInArrow(near, "key string, low long, high long, window binary")
    of_items = cut(theirs.mapInArrow(windows, "item string, window binary").distinct())
    had = of_items.groupBy("window").agg(F.count(F.lit(1)).alias("items_"))
    return lookup(cut(mine), cut(had), "window", "items_", ["items_"]).filter("items_ is not null").drop("items_"), of_items


def _far(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """Documents against a benchmark too large to send about."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for low, high, data, bounds in chunks(batch.column(2)):
                n[low:high] = np.diff(hash_words(data, bounds, _IN_WORD, LETTERS)[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], [id_col, "key", "n_words"])

    met, of_items = _met(docs, items, text_col, item_col, item_text)
    met = cut(met)
    reached = F.max("high").over(Window.partitionBy("key").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    hit = met.select("key", F.greatest(F.lit(0), F.col("high") - F.greatest("low", F.coalesce(reached, F.lit(0)))).alias("more")).groupBy("key").agg(F.sum("more").alias("n_hit"))
    ids = met.select("key", "window").distinct().join(of_items, "window").select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    rows = docs.select(F.col(id_col), _key(text_col).alias("key"), F.col(text_col).cast("string").alias("text_"))
    counted = cut(rows.mapInArrow(count, T.StructType([rows.schema.fields[0], T.StructField("key", T.StringType()), T.StructField("n_words", T.LongType())])))
    copies = counted.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    found = hit.join(ids, "key").join(copies, "key").select("key", "copies", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    none = F.lit(0).cast("long")
    return lookup(counted, cut(found), "key", "copies", ["n_hit", "n_items", "items_sha256"]).select(
        id_col, "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.lit(NOTHING)).alias("items_sha256")
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, n_items, items_sha256 and contaminated.

    A window is SPAN consecutive words of an item, or all of an item that has fewer; a word of a
    document inside any occurrence of a window is hit. Null and empty texts have no words; items
    without words hit nothing; items that share an id count once, and a null id is written as nothing.
    Repeated rows and null ids of documents come back as they are. Other columns are not read. An empty
    benchmark leaves every document clean.
    """
    index = small_index(items, item_col, item_text, broadcast_bytes)
    got = _near(docs, index, id_col, text_col) if index else _far(docs, items, id_col, text_col, item_col, item_text)
    return got.withColumn("contaminated", F.col("n_hit") > 0)


def small_index(items: DataFrame, item_col: str, item_text: str, broadcast_bytes: int) -> Index | None:
    """The index of a benchmark whose texts are within `broadcast_bytes`, else None."""
    bench = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text_"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text_") + 16), F.lit(0)).alias("n")).first()["n"]
    if size > broadcast_bytes:
        return None
    rows = bench.collect()  # of a checked size
    return Index([r["item"] for r in rows], [r["text_"] for r in rows])


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of `docs` that no benchmark item hits, with all their columns; see decontaminate().

    Null and empty texts stay, and all rows where the benchmark is empty; repeated rows stay or go together.
    """
    index = small_index(items, item_col, item_text, broadcast_bytes)
    if index is None:
        key = own_name(docs, "hit_key_")
        marked = docs.withColumn(key, _key(text_col))
        met, _ = _met(docs, items, text_col, item_col, item_text)
        hit = cut(met.select(F.col("key").alias(key)).distinct())
        copies = marked.select(key).join(hit, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("copies_"))
        of = own_name(docs, "copies_")
        return lookup(marked, cut(copies.withColumnRenamed("copies_", of)), key, of, [of]).filter(F.col(of).isNull()).drop(key, of)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("long")
    def hits(texts: pd.Series) -> pd.Series:
        return pd.Series(measure(sent.value, pa.array(texts, pa.string()))[1])

    return docs.filter(hits(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == 0)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decontaminate() over the whole documents and benchmark tables."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS line, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i, w FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM bw
), lengths AS (
  SELECT DISTINCT n FROM windows
), dw AS (
  SELECT line, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n
), hits AS (
  SELECT line, i, dw.n AS n, item_id FROM dw JOIN windows ON windows.n = dw.n AND array_to_string(list_slice(w, i, i + dw.n - 1), ' ') = win
), hit_words AS (
  SELECT line, count(DISTINCT p) AS n_hit FROM (SELECT line, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY line
), hit_items AS (
  SELECT line, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT line, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY line
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (line) LEFT JOIN hit_items USING (line)
"""
