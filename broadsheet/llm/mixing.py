"""Mixing sources to target weights by temperature, with DataFrame functions only.

The share of a source's tokens is raised to an exponent between 0 (all sources alike) and 1 (as they
are). The exponent is bisected until the mixture meets a target entropy, but never below the one at which
the most repeated source would be repeated too often. The weights are then realised as a budget of tokens for each source,
which it spends on permutations of its blocks: pass after pass over all its documents, each pass in an
order of its own, the last one broken off where the budget ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import cut, lookup, table

#: A source's documents are passed over at most so many times.
REPEATS = 4.0
#: Exponents that one step looks at; each step narrows the bracket so many times.
SECTIONS = 64
#: Steps; SECTIONS to this power is the fineness.
STEPS = 3
#: Tokens and documents of a block, at most, about. A source has as many blocks as it takes.
BLOCK_TOKENS = 100_000
BLOCK_DOCS = 20_000
#: Digits of a block's turn by which blocks stand on shelves, so that their places are added up in two steps.
SHELF = 3
#: Rows that repeat each other are one row with a number until the end, and are written out by so many.
COPIES_AT_ONCE = 100_000
SEED = 17


@dataclass(frozen=True)
class Target:
    """What the exponent is bisected for: the least entropy in bits, if one is given, within the most repetitions.

    An entropy that would take more repetitions is not met; the limit holds.
    """

    entropy: float | None = None
    repeats: float = REPEATS


def tokens_of(text: Column) -> Column:
    """Tokens as mixing counts them: runs of characters other than white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def exponent(sources: DataFrame, target: Target, budget: int | None = None) -> float:
    """The exponent nearest to 1 that has the target's entropy, or the least within its repetitions if that is greater.

    Without an entropy it is the least within the repetitions; 1 where not even that is within them. As the
    exponent falls, entropy rises and so does the repetition of the smallest source. `sources` has a row
    per source with its tokens. A step tries SECTIONS exponents for either bound in one aggregation.
    """
    sized = sources.filter("tokens > 0").select(F.log(F.col("tokens").cast("double")).alias("log_"))
    ends = sized.agg(F.max("log_").alias("top"), F.min("log_").alias("least")).first()
    top, least = ends["top"], ends["least"]
    if top is None:
        return 1.0
    limit = math.log(target.repeats) + 1e-12
    brackets = {"repeats": (0.0, 1.0)} | ({"entropy": (0.0, 1.0)} if target.entropy is not None else {})
    found: dict[str, float] = {}
    for _ in range(STEPS):
        tries = {k: [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)] for k, (low, high) in brackets.items()}
        grid = sized.select("log_", F.explode(F.array(*map(F.lit, sorted({a for t in tries.values() for a in t})))).alias("a"))
        e = F.exp(F.col("a") * (F.col("log_") - F.lit(top)))
        sums = {r["a"]: (r["z"], r["s"]) for r in grid.groupBy("a").agg(F.sum(e).alias("z"), F.sum(e * F.col("a") * (F.col("log_") - F.lit(top))).alias("s")).collect()}
        for bound, at in tries.items():
            step = at[1] - at[0]
            if bound == "entropy":
                good = [a for a in at if (math.log(sums[a][0]) - sums[a][1] / sums[a][0]) / math.log(2) >= target.entropy - 1e-9]
                found[bound] = max(good, default=0.0)
                brackets[bound] = (found[bound], min(at[-1], found[bound] + step))
            else:
                spent = {a: math.log(budget) - math.log(sums[a][0]) if budget else top for a in at}
                good = [a for a in at if a * (least - top) + spent[a] - least <= limit]
                found[bound] = min(good, default=1.0)
                brackets[bound] = (max(at[0], found[bound] - step), found[bound])
    return max(found.values())


def spread(counted: DataFrame, copies: str, nth: str) -> DataFrame:
    """Each row as often as `copies` says, numbered from 0 by `nth`; a number too great for one task is dealt out first."""
    few = counted.filter(F.col(copies) <= COPIES_AT_ONCE).withColumn(nth, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    lots = counted.filter(F.col(copies) > COPIES_AT_ONCE).withColumn("lot_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPIES_AT_ONCE))))
    first = F.col("lot_") * COPIES_AT_ONCE
    many = lots.repartition(*counted.columns, "lot_").withColumn(nth, F.explode(F.sequence(first, F.least(first + COPIES_AT_ONCE, F.col(copies)) - 1))).drop("lot_")
    return few.unionByName(many)


def mix(docs: DataFrame, target: Target = Target(), budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mixture as a list of visits: id, source, n_tokens, epoch, block, place, weight, exponent.

    A row is one visit of a training run to one document; a source's visits by (epoch, place) are what is
    read of it. `budget` is the tokens of the whole mixture; without one it is the least that carries
    every source through all its documents once. A budget is used up by the document that reaches it.
    Documents without tokens cost nothing and go with the pass they stand in. A null source counts as
    the empty one, a null text as empty; null ids stay null. Rows that repeat each other are documents
    of their own. Other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # used twice, so that texts are read once; rows that repeat each other are counted before they are shuffled
    rows = cut(
        docs.select(
            F.col(id_col).alias("id_"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_"),
            tokens_of(text).alias("n_tokens"),
            F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text))).alias("row_key"),
        )
        .groupBy("id_", "source_", "n_tokens", "row_key")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    sources = cut(rows.groupBy("source_").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("docs")))
    a = exponent(sources, target, budget)
    logs = F.log(F.greatest("tokens", F.lit(1)).cast("double"))
    top = sources.agg(F.max(logs).alias("top")).first()["top"] or 0.0
    share = F.when(F.col("tokens") > 0, F.exp(F.lit(a) * (logs - F.lit(top)))).otherwise(0.0)
    whole = sources.agg(F.sum(share).alias("z")).first()["z"] or 1.0
    spent = float(budget) if budget is not None else math.exp(top) * whole
    to_spend = F.round(share / F.lit(whole) * F.lit(spent)).cast("long")
    planned = sources.select(
        "source_",
        "tokens",
        F.round(share / F.lit(whole), 6).alias("weight"),
        # a pass that is due is not missed by the rounding of logarithms
        (to_spend if budget is not None else F.greatest(to_spend, "tokens")).alias("to_spend"),
        "docs",
        F.ceil(F.greatest(F.lit(1) / BLOCK_TOKENS, F.col("tokens") / BLOCK_TOKENS, F.col("docs") / BLOCK_DOCS)).cast("long").alias("blocks"),
    ).withColumn("passes", F.greatest(F.lit(1), F.ceil(F.col("to_spend") / F.greatest("tokens", F.lit(1)))).cast("int"))
    told = lookup(rows, planned, "source_", "docs", ["tokens", "weight", "to_spend", "passes", "blocks"])
    # a copy beyond the first has a key of its own, so that copies fall into different blocks
    nth = spread(told, "copies", "nth").withColumn("key", F.when(F.col("nth") == 0, F.col("row_key")).otherwise(F.md5(F.concat_ws("|", "row_key", "nth"))))
    number = F.conv(F.substring("key", 1, 12), 16, 10).cast("long")
    visits = nth.select("id_", "source_", "n_tokens", "key", "weight", "to_spend", "tokens", F.pmod(number, "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("epoch"))
    # places in a pass: those of its shelves, those of the blocks on a shelf, and those within each block
    turn = F.md5(F.concat_ws("|", F.lit(seed), "source_", "epoch", "block"))
    blocks = visits.groupBy("source_", "epoch", "block").agg(F.sum("n_tokens").alias("in_block"), F.count(F.lit(1)).alias("docs_in_block")).withColumn("turn", turn).withColumn("shelf", F.left("turn", F.lit(SHELF)))
    shelves = blocks.groupBy("source_", "epoch", "shelf").agg(F.sum("in_block").alias("in_shelf"), F.sum("docs_in_block").alias("docs_in_shelf"))
    none = F.lit(0).cast("long")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), none)
    by_shelf, by_turn = Window.partitionBy("source_", "epoch").orderBy("shelf"), Window.partitionBy("source_", "epoch", "shelf").orderBy("turn")
    shelves = shelves.select("source_", "epoch", "shelf", summed("in_shelf", by_shelf).alias("tokens_to_shelf"), summed("docs_in_shelf", by_shelf).alias("docs_to_shelf"))
    placed_blocks = blocks.join(shelves, ["source_", "epoch", "shelf"]).select(
        "source_", "epoch", "block", (F.col("tokens_to_shelf") + summed("in_block", by_turn)).alias("tokens_before"), (F.col("docs_to_shelf") + summed("docs_in_block", by_turn)).alias("docs_before")
    )
    along = Window.partitionBy("source_", "epoch", "block").orderBy(F.md5(F.concat_ws("|", "key", "epoch")), "n_tokens")
    placed = visits.join(placed_blocks, ["source_", "epoch", "block"]).withColumns(
        {
            "spent": summed("n_tokens", along) + F.col("tokens_before") + F.col("epoch") * F.col("tokens"),
            "place": F.coalesce(F.count(F.lit(1)).over(earlier(along)), none) + F.col("docs_before"),
        }
    )
    due = (F.col("spent") < F.col("to_spend")) | (F.col("n_tokens") == 0) & (F.col("spent") <= F.col("to_spend"))
    return placed.filter(due).select(F.col("id_").alias(id_col), F.col("source_").alias(source_col), "n_tokens", "epoch", "block", "place", "weight", F.lit(a).alias("exponent"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() over the whole documents table: every document at least once, a source at most REPEATS times over."""
    return mix(table(spark, sf_dir, "documents"))


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS nth, md5(concat_ws('|', {SEED}, doc_id, md5(coalesce(text, '')))) AS row_key
  FROM documents
), s AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM d GROUP BY source
), fit AS (
  SELECT ln(max(tokens)) AS top,
         greatest(0.0, CASE WHEN max(tokens) = min(tokens) THEN 0.0 ELSE ceil((1 - ln({REPEATS}) / (ln(max(tokens)) - ln(min(tokens)))) * {SECTIONS**STEPS}) / {SECTIONS**STEPS}.0 END) AS a
  FROM s WHERE tokens > 0
), shares AS (
  SELECT source, tokens, docs, a, top, CASE WHEN tokens > 0 THEN exp(a * (ln(greatest(tokens, 1)) - top)) ELSE 0.0 END AS share FROM s, fit
), plan AS (
  SELECT source, tokens, a, round(share / sum(share) OVER (), 6) AS weight, greatest(CAST(round(share * exp(top)) AS BIGINT), tokens) AS to_spend,
         CAST(ceil(greatest(1 / {BLOCK_TOKENS}.0, tokens / {BLOCK_TOKENS}.0, docs / {BLOCK_DOCS}.0)) AS BIGINT) AS blocks
  FROM shares
), visits AS (
  SELECT *, CAST(('0x' || substr(key, 1, 12)) AS BIGINT) % blocks AS block, unnest(generate_series(0, greatest(CAST(ceil(to_spend / CAST(greatest(tokens, 1) AS DOUBLE)) AS BIGINT), 1) - 1)) AS epoch
  FROM (SELECT *, CASE WHEN nth = 0 THEN row_key ELSE md5(row_key || '|' || nth) END AS key FROM d) JOIN plan USING (source)
), turns AS (
  SELECT *, md5(concat_ws('|', {SEED}, source, epoch, block)) AS turn, md5(concat_ws('|', key, epoch)) AS along FROM visits
), placed AS (
  SELECT *, coalesce(sum(n_tokens) OVER w, 0) + epoch * tokens AS spent, row_number() OVER w - 1 AS place
  FROM turns WINDOW w AS (PARTITION BY source, epoch ORDER BY turn, along, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, block, place, weight, a AS exponent
FROM placed WHERE spent < to_spend OR n_tokens = 0 AND spent <= to_spend
"""
