"""Fingerprints of documents by closed syncmers, with DataFrame functions only.

A k-mer is K words in a row. It is an anchor if the least of its inner sequences of S words lies at either
of its edges. Whether it is depends on its own words alone, so the same words are anchors in every text
that has them, wherever they stand; and of any K - S + 1 k-mers in a row at least one is an anchor. A
fingerprint is a text's anchors in order, each with its distance in words to the next one, so that what
two texts have in common is matched by content and by place, without regard to what stands before it.

Words are numbered by crc32 and sequences by a polynomial of those numbers, in whole numbers below a prime.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.common import crc32_sql, table

#: Words of a k-mer, and of the inner sequences of which the least decides.
K, S = 5, 2
#: What numbers are taken by, and multiplied by: any three products of these fit 63 bits.
PRIME = 4_294_967_291
FACTORS = (433_494_437, 387_420_489, 479_001_599)
#: Hexadecimal digits of an anchor: eight of its number, one of its distance to the next, 0 for the last.
DIGITS = 9
#: Stretches of documents in order, for each partition of a shuffle; a stretch is put in order by one task.
STRETCHES = 4
#: What parts words: [\x20\x09-\x0D].
_BLANKS = " \t\n\x0b\x0c\r"


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with its argument computed once."""
    return F.transform(F.array(x), body)[0]


def _mixed(*numbers: Column) -> Column:
    return F.pmod(sum((n * f for n, f in zip(numbers, FACTORS, strict=False)), F.lit(0)), F.lit(PRIME))


def _from(xs: Column, first: int, n: Column) -> Column:
    """`n` elements from the place `first` on, counted from 0."""
    return F.slice(xs, F.lit(first + 1), n)


def anchors(text: Column) -> Column:
    """The anchors of a text in order, each as its number * 16 + its distance to the next one in words.

    A text of fewer than K words, but not none, has one anchor, which is all of it. A null text has none.
    """
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))

    def of_words(w: Column) -> Column:
        short = F.array(_mixed(F.crc32(F.array_join(w, " ")), F.size(w).cast("long")) * 16)
        return F.when(F.size(w) < K, short).otherwise(_let(F.transform(w, F.crc32), of_numbers))

    def of_numbers(h: Column) -> Column:
        inner = F.zip_with(_from(h, 0, F.size(h) - 1), _from(h, 1, F.size(h) - 1), lambda a, b: _mixed(a, b))
        return _let(F.struct(h.alias("h"), inner.alias("m")), of_inner)

    def of_inner(x: Column) -> Column:
        h, m = x["h"], x["m"]
        n = F.size(h) - (K - 1)
        least = lambda i, j: F.zip_with(_from(m, i, n), _from(m, j, n), lambda a, b: F.least(a, b))
        edge, middle = least(0, K - S), least(1, K - S - 1)
        chosen = F.filter(F.transform(F.zip_with(edge, middle, lambda e, i: e <= i), lambda is_one, i: F.when(is_one, i)), lambda i: i.isNotNull())
        return _let(F.struct(h.alias("h"), m.alias("m"), chosen.alias("p")), spelled_out)

    def spelled_out(x: Column) -> Column:
        number = lambda p: _mixed(F.get(x["m"], p), F.get(x["m"], p + S), F.get(x["h"], p + (K - 1)))
        return F.transform(x["p"], lambda p, i: number(p) * 16 + F.coalesce(F.get(x["p"], i + 1) - p, F.lit(0)))

    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(_let(F.split(bare, f"[{_BLANKS}]+"), of_words))


def fingerprint(found: Column) -> Column:
    """Anchors as text, DIGITS hexadecimal digits each, which SQL and other programs can compare."""
    return F.lower(F.array_join(F.transform(found, lambda a: F.lpad(F.hex(a), DIGITS, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Anchors that two texts share, with their distances, over those that either has; 1 where both have none."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """Rows of (id_, text_, guest) and the window in which the row after each is the next document.

    Documents are ordered by id, null ids first, then by what their texts hash to; rows that repeat each
    other by their number. Where each of some thousand stretches of that order begins is found from the
    ids and hashes alone, by a range shuffle; texts are then shuffled once. The first row of a stretch
    also goes as a guest to the end of the stretch before it, so that no row lacks its neighbour and no
    task sees more than a stretch, however many rows share an id.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).alias("a"), F.xxhash64(text).alias("b"), F.monotonically_increasing_id().alias("c"))
    rows = docs.select(F.col(id_col).alias("id_"), text.alias("text_"), key.alias("key"))
    n = STRETCHES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    begins = rows.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    # one row for each stretch; no more than partitions times STRETCHES
    firsts = [r["text"] for r in begins.orderBy("key").select(F.to_json("key", {"ignoreNullFields": "false"}).alias("text")).collect()]
    kind = T.ArrayType(T.ArrayType(rows.schema["key"].dataType))
    # looked up in two steps: in which group of stretches, and then in which of the group
    size = max(1, math.isqrt(len(firsts)))
    groups = F.from_json(F.lit(json.dumps([[json.loads(t) for t in firsts[i : i + size]] for i in range(0, len(firsts), size)])), kind)
    upto = lambda begin: begin <= F.col("key")
    group = F.size(F.filter(F.transform(groups, lambda g: g[0]), upto)) - 1
    in_group = F.filter(F.get(groups, F.col("group")), upto)
    placed = rows.withColumn("group", group).withColumn("begun", in_group).withColumn("stretch", F.col("group") * size + F.size("begun") - 1)
    own = F.struct(F.col("stretch").alias("stretch"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("stretch") - 1, F.lit(max(1, len(firsts)))).alias("stretch"), F.lit(True).alias("guest"))
    is_first = F.element_at("begun", -1) == F.col("key")
    dealt = placed.select("id_", "text_", "key", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    return dealt.select("id_", "text_", "key", "to.stretch", "to.guest"), Window.partitionBy("stretch").orderBy("guest", "key")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_chars, fingerprint, n_anchors.

    A null text counts as empty, and its fingerprint is empty. Equal texts have equal fingerprints. Null
    ids and repeated rows come back as they are; other columns are not read; an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), F.length(text).cast("long").alias("n_chars"), anchors(text).alias("found_"))
    return rows.select(id_col, "n_chars", fingerprint(F.col("found_")).alias("fingerprint"), F.size("found_").cast("long").alias("n_anchors"))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprints() of every document and of its edited text, and how alike they and the next document are.

    The edited text has its last quarter, rounded down to code points, taken off and as many code points
    of the next document's beginning, or all of it, put there. The next document is that of the next id;
    null ids come first, rows that share an id follow each other by what their texts hash to, and after
    the last comes the first. A single document is its own next. Null texts count as empty. Other columns
    are not read. An empty table gives an empty result. `docs` is read twice and must be the same each time,
    as a table is.
    """
    rows, order = _in_order(docs, id_col, text_col)
    quarter = F.floor(F.length("text_") / 4).cast("int")
    edited = F.concat(F.left("text_", F.length("text_") - quarter), F.left(F.coalesce("next_text", F.lit("")), quarter))
    found = (
        rows.withColumn("next_text", F.lead("text_").over(order))
        .withColumn("edited", edited)
        .select("id_", "key", "stretch", "guest", F.length("text_").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), anchors(F.col("text_")).alias("own"), F.when(~F.col("guest"), anchors(F.col("edited"))).alias("other"))
        .withColumn("next", F.lead("own").over(order))
        .filter(~F.col("guest"))
    )
    return found.select(
        F.col("id_").alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """beside_next() over the whole documents table."""
    return beside_next(table(spark, sf_dir, "documents"))


#: Joined by windows over positions instead of arrays.
OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS after, first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS first,
         coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id FROM documents
), e AS (
  SELECT *, left(text, length(text) - length(text) // 4) || left(coalesce(after, first), length(text) // 4) AS edited FROM d
), texts AS (
  SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e
), split AS (
  SELECT doc_id, kind, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), words AS (
  SELECT doc_id, kind, unnest(range(len(w))) AS i, unnest(w) AS word FROM split
), numbers AS (
  SELECT word, {crc32_sql("word")} AS h FROM (SELECT DISTINCT word FROM words)
), m AS (
  SELECT *, (h * {FACTORS[0]} + lead(h) OVER t * {FACTORS[1]}) % {PRIME} AS m FROM words JOIN numbers USING (word) WINDOW t AS (PARTITION BY doc_id, kind ORDER BY i)
), grams AS (
  SELECT doc_id, kind, i, (m * {FACTORS[0]} + lead(m, 2) OVER t * {FACTORS[1]} + lead(h, 4) OVER t * {FACTORS[2]}) % {PRIME} AS number,
         least(m, lead(m, 3) OVER t) <= least(lead(m, 1) OVER t, lead(m, 2) OVER t) AND lead(h, 4) OVER t IS NOT NULL AS chosen
  FROM m WINDOW t AS (PARTITION BY doc_id, kind ORDER BY i)
), found AS (
  SELECT doc_id, kind, i, number * 16 + coalesce(lead(i) OVER (PARTITION BY doc_id, kind ORDER BY i) - i, 0) AS a FROM grams WHERE chosen
  UNION ALL
  SELECT doc_id, kind, 0, (({crc32_sql("array_to_string(w, ' ')")} * {FACTORS[0]} + len(w) * {FACTORS[1]}) % {PRIME}) * 16 FROM split WHERE len(w) BETWEEN 1 AND 4
), prints AS (
  SELECT doc_id, kind, string_agg(printf('%09x', CAST(a AS BIGINT)), '' ORDER BY i) AS print, list(DISTINCT a) AS anchors FROM found GROUP BY doc_id, kind
), held AS (
  SELECT doc_id, kind, coalesce(print, '') AS print, coalesce(anchors, []) AS anchors FROM split LEFT JOIN prints USING (doc_id, kind)
), near AS (
  SELECT e.doc_id, o.print AS fingerprint, x.print AS edited_fingerprint, o.anchors AS a, x.anchors AS b, y.anchors AS c
  FROM e JOIN held o ON o.doc_id = e.doc_id AND o.kind = 0 JOIN held x ON x.doc_id = e.doc_id AND x.kind = 1 JOIN held y ON y.doc_id = e.next_id AND y.kind = 0
)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a, c)) AS DOUBLE) / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next
FROM e JOIN near USING (doc_id)
"""
