"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

A value that many owners hold, or many repositories of one owner, is an example that was copied about;
one that a single owner holds in few repositories, and that looks drawn at random, may be live. Spans are
found document by document; hashes of their values are counted over the whole corpus by distinct owners,
which are sources, and by distinct repositories, which are documents of different text, so that a copy
of a page does not make its secrets any more public.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import cut, lookup, table

_KEY = "(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which they are listed. The first three are the base; a match of the last is a
#: span only if the frequency of its value speaks for it.
KINDS = ("assign", "access", "hex", "random")
#: The look-behind only spares tries that must fail, as a run is taken from its first character.
PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "random": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}",
}
#: Code points that an assigned value must have.
LEAST_VALUE = 6
#: From so many owners on, a value is a widely copied example.
EXAMPLE_OWNERS = 3
#: From so many repositories on it is one too, whoever owns them.
EXAMPLE_REPOS = 20
#: Different characters from which on a value looks drawn at random.
LEAST_LETTERS = 8
#: Stands on both sides of a match while positions are taken; no pattern admits it or its stand-in.
MARK, STAND_IN = "\ue000", "\ue001"


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches of `pattern`, as (length, match or null) in turn; null without a match."""
    cut_up = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    return F.when(text.rlike(pattern), F.transform(cut_up, lambda p, i: F.struct(F.length(p).alias("n"), F.when(i % 2 == 1, p).alias("match"))))


def looks_random(value: Column) -> Column:
    """Enough different characters, a digit among them."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_LETTERS) & value.rlike("[0-9]")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: row_id and the id of every row of `docs`.

    spans: row_id, kind, start, end (code points, end exclusive), value_sha256, n_owners, n_repos and
    verdict (example, shared or live). A null text counts as empty; null owners count as one owner.
    Ids, null or not, do not matter to the counts. Other columns are not read; rows that repeat each
    other are scanned each for itself but are one repository.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), MARK, STAND_IN)
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), text.alias("text_"))
    # numbered and written once, without the texts
    rows = cut(found.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "owner", F.md5("text_").alias("repo"), *(pieces(F.col("text_"), PATTERNS[k]).alias(k) for k in KINDS)))
    of_kind = [rows.filter(F.col(k).isNotNull()).select("row_id", "repo", "owner", F.lit(i).alias("rank"), F.posexplode(k).alias("at", "piece")) for i, k in enumerate(KINDS)]
    laid = of_kind[0]
    for more in of_kind[1:]:
        laid = laid.unionByName(more)
    along = Window.partitionBy("row_id", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    match = F.col("piece.match")
    value = F.when(F.col("rank") == 0, F.regexp_extract(match, _ASSIGN, 1)).otherwise(match)
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    spans = (
        laid.withColumn("end", F.sum("piece.n").over(along))
        .filter(match.isNotNull())
        .select("row_id", "repo", "owner", "rank", (F.col("end") - F.col("piece.n")).alias("start"), "end", value.alias("value"))
        .filter((F.col("rank") != 0) | (F.length("value") >= LEAST_VALUE))
        .filter((F.col("rank") != 3) | mixed)
        .select("row_id", "repo", "owner", "rank", "start", "end", F.sha2("value", 256).alias("value_sha256"), looks_random(F.col("value")).alias("random"))
    )
    spans = cut(spans)
    # counted in steps, so that a value which everybody holds is never one task's rows
    owned = (
        spans.groupBy("value_sha256", "owner", "repo")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("value_sha256", "owner")
        .agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
        .groupBy("value_sha256")
        .agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_spans"))
    )
    judged = lookup(spans, owned, "value_sha256", "n_spans", ["n_owners", "n_repos"])
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    verdict = F.when(copied, "example").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("shared")
    names = F.array(*map(F.lit, KINDS))
    judged = judged.withColumn("verdict", verdict).filter((F.col("rank") != 3) | (F.col("verdict") == "live"))
    return rows.select("row_id", F.col("doc_id").alias(id_col)), judged.select("row_id", "rank", names[F.col("rank")].alias("kind"), "start", "end", "value_sha256", "n_owners", "n_repos", "verdict")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per row of `docs`: id, counts of the base kinds, base_sha256, spans, n_live, n_example, most_owners and most_repos.

    The last two are the most owners and repositories that any value of the row's spans has, 0 without any.

    Spans are written kind:start:end and joined by commas, by start and then kind. Without any, the
    counts are 0, spans is empty and base_sha256 the digest of nothing. See scan() for nulls and
    repeated rows. An empty table gives an empty result.
    """
    rows, spans = scan(docs, id_col, text_col, owner_col, example_owners, example_repos)
    told = spans.select("row_id", "rank", "verdict", "n_owners", "n_repos", F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("text")).alias("span"))
    one = told.groupBy("row_id").agg(
        *(F.count_if(F.col("rank") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.count_if(F.col("verdict") == "live").alias("n_live"),
        F.count_if(F.col("verdict") == "example").alias("n_example"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
        F.array_sort(F.collect_list("span")).alias("all"),
    )
    joined = lambda a: F.array_join(F.transform(a, lambda s: s["text"]), ",")
    base = F.filter("all", lambda s: s["rank"] < 3)
    got = rows.join(one.withColumns({"base": joined(base), "spans": joined(F.col("all"))}), "row_id", "left")
    count = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return got.select(id_col, count("n_assign"), count("n_access"), count("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), count("n_live"), count("n_example"), count("most_owners"), count("most_repos"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_secrets() over the whole documents table."""
    return find_secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    # the contract's patterns, written out again so that a slip in one of them shows
    key = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    assign = key + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    one = lambda rank, pattern: rf"SELECT row_id, {rank} AS rank, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)) AS parts FROM d"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, '') AS owner, translate(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents
), cut AS (
  {one(0, assign)}
  UNION ALL {one(1, 'AKIA[A-Z0-9]{16,}')}
  UNION ALL {one(2, '[0-9a-f]{24,}')}
  UNION ALL {one(3, '[A-Za-z0-9+/_-]{32,}')}
), laid AS (
  SELECT row_id, rank, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM cut WHERE len(parts) > 1
), placed AS (
  SELECT *, CAST(sum(length(part)) OVER (PARTITION BY row_id, rank ORDER BY place) AS BIGINT) AS stop FROM laid
), valued AS (
  SELECT row_id, rank, stop - length(part) AS start, stop, CASE WHEN rank = 0 THEN regexp_extract(part, '{assign}', 1) ELSE part END AS value
  FROM placed WHERE place % 2 = 0
), spans AS (
  SELECT row_id, owner, t, rank, start, stop, value,
         len(list_distinct(string_split(value, ''))) >= {LEAST_LETTERS} AND regexp_matches(value, '[0-9]') AS random
  FROM valued JOIN d USING (row_id)
  WHERE (rank <> 0 OR length(value) >= {LEAST_VALUE})
    AND (rank <> 3 OR regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]'))
), owned AS (
  SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT owner || chr(0) || t) AS n_repos FROM spans GROUP BY value
), judged AS (
  SELECT row_id, rank, start, n_owners, n_repos, ['assign', 'access', 'hex', 'random'][rank + 1] || ':' || start || ':' || stop AS told,
         CASE WHEN n_owners >= {EXAMPLE_OWNERS} OR n_repos >= {EXAMPLE_REPOS} THEN 'example' WHEN n_owners = 1 AND random THEN 'live' ELSE 'shared' END AS verdict
  FROM spans JOIN owned USING (value)
), one AS (
  SELECT row_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(told, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(told, ',' ORDER BY start, rank) AS spans,
         count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example, max(n_owners) AS most_owners, max(n_repos) AS most_repos
  FROM judged WHERE rank < 3 OR verdict = 'live' GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN one USING (row_id)
"""


OP9_SQL = _sql()
