"""The language of a page, from its tags and from its text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.plans.dialect import SPARK, found

# ---- fixed values: where a page says its language, the first that is found ----
_DC = r'(?is)<meta[^>]* (?:name|property)=.dc\.language.[^>]* content="([^"]+)"'
_HTTP = r'(?is)<meta[^>]* (?:http-equiv)=.Content-Language.[^>]* content="([^"]+)"'
_HTML = r'(?is)<html[^>]* (?:xml:lang|lang)="([^"]+)"'
# ---- end of fixed values ----
#: Trigrams of a model that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Different trigrams kept of each language.
TRIGRAMS = 3000


def from_tags(page: Any, on: Any = SPARK) -> Any:
    """What a page says of itself: dc.language, then Content-Language, then the html element."""
    return on.first_given(*(found(page, p, 1, on) for p in (_DC, _HTTP, _HTML)))


def pick(said: Any, guessed: Any, on: Any = SPARK) -> Any:
    """The longer of two that agree; the guess where they don't, as pages are often set up wrongly."""
    agree = on.case((on.starts(guessed, said), guessed), (on.starts(said, guessed), said), other=guessed)
    return on.case((on.absent(said), guessed), (on.absent(guessed), said), other=agree)


def short_code(code: Any, on: Any = SPARK) -> Any:
    """The first two letters."""
    return on.left(code, on.lit(2))


# ---- the language of a text, by how likely its trigrams are in each language ----

_LETTERS = regex.compile(r"\p{L}+")
#: Parts into which the trigrams of one language are dealt before they are ranked.
_DEALT = 64


def _trigrams(text: str) -> np.ndarray:
    """Every three characters that stand together in a word with a blank at either end, as numbers of 21 bits a character."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    one, two, three = c[:-2], c[1:-1], c[2:]
    return (one << 42 | two << 21 | three)[two != 32]


def _number(gram: str) -> int:
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


@dataclass(frozen=True)
class Model:
    """Log probabilities: a row for each trigram that is kept of any language, in order, a column for each language."""

    languages: tuple[str, ...]
    grams: np.ndarray
    logs: np.ndarray
    unknown: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str | None, float | None, float]]) -> Model:
        """From (language, trigram, log, unknown) of model_table()."""
        rows = list(rows)
        unknown = {lang: u for lang, _, _, u in rows}
        names = tuple(sorted(unknown))
        grams = sorted({_number(g) for _, g, _, _ in rows if g is not None})
        place, column = {g: i for i, g in enumerate(grams)}, {lang: j for j, lang in enumerate(names)}
        none = np.array([unknown[lang] for lang in names], float)
        logs = np.tile(none, (len(grams), 1)) if names else np.zeros((0, 0))
        for lang, gram, log, _ in rows:
            if gram is not None:
                logs[place[_number(gram)], column[lang]] = log
        return cls(names, np.array(grams, np.int64), logs, none)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"\p{L}+"), 0)


def _grams(word: Column) -> Column:
    """The trigrams of a word with a blank at either end: as many as it has letters. Letters are looked up in an array, as a text is read from its start each time."""
    letters = lambda w: F.split(F.concat(F.lit(" "), w, F.lit(" ")), "")
    at = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))
    return F.transform(F.array(letters(word)), at)[0]


def _first_of_each(df: DataFrame, by: str, order: Sequence[Column], item: str, k: int) -> DataFrame:
    """The `k` first rows of each value of `by`: first of each part of them, then of what is left, so that no task ranks all of one value."""
    part = F.pmod(F.xxhash64(item), F.lit(_DEALT))
    for keys in ([F.col(by), part], [F.col(by)]):
        df = df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank_") <= k).drop("rank_")
    return df


def model_table(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, log and unknown: the TRIGRAMS most common trigrams of each language, and what any other one counts for.

    All texts count whole, as tables: different words of each language, then their trigrams, so that a hot
    language is added up before it is shuffled. A log is that of the share of a trigram, each of the kept
    and of as many unknown ones counted once more. A language without a letter has one row with a null gram.
    Rows without a language teach nothing; null texts have no letters.
    """
    rows = texts.filter(F.col(lang_col) != "").select(F.col(lang_col).alias("lang"), _words(F.col(text_col)).alias("words"))
    words = rows.select("lang", F.explode_outer("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    grams = words.select("lang", "n", F.explode_outer(F.when(F.col("word").isNotNull(), _grams(F.col("word")))).alias("gram")).groupBy("lang", "gram").agg(F.sum(F.when(F.col("gram").isNotNull(), F.col("n")).otherwise(0)).alias("n"))
    totals = grams.groupBy("lang").agg((F.sum("n") + TRIGRAMS).cast("double").alias("total"))
    kept = _first_of_each(grams.filter(F.col("gram").isNotNull()), "lang", [F.desc("n"), F.asc("gram")], "gram", TRIGRAMS)
    # a row for each language, which are few
    told = totals.join(kept, "lang", "left")
    return told.select("lang", "gram", F.when(F.col("gram").isNotNull(), F.log((F.col("n") + 1) / F.col("total"))).alias("log"), (-F.log("total")).alias("unknown"))


def guessed(texts: DataFrame, model: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`key` and language of every row of `texts`, by tables alone; keys must differ. Null for a text without letters; ties go to the first code.

    The model is read three times, and so had better be a table that is written. Trigrams meet its own, which are broadcast if BROADCAST_ROWS at most and shuffled to otherwise,
    and are added up by text and language where they are before they are shuffled.
    """
    gains = model.filter(F.col("gram").isNotNull()).groupBy("gram").agg(F.collect_list(F.struct("lang", (F.col("log") - F.col("unknown")).alias("gain"))).alias("gains"))
    few = gains.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    words = texts.select(F.col(key).alias("key_"), F.explode(_words(F.col(text_col))).alias("word"))
    grams = words.select("key_", F.explode(_grams(F.col("word"))).alias("gram"))
    met = grams.join(F.broadcast(gains) if few else gains, "gram").select("key_", F.explode("gains").alias("g"))
    sums = met.groupBy("key_", "g.lang").agg(F.sum("g.gain").alias("gain")).groupBy("key_").agg(F.map_from_entries(F.collect_list(F.struct("lang", "gain"))).alias("gains"))
    # one row, with as many entries as there are languages
    known = model.groupBy("lang").agg(F.first("unknown").alias("unknown")).agg(F.array_sort(F.collect_list(F.struct("lang", "unknown"))).alias("known"))
    letters = F.length(F.regexp_replace(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"\P{L}+", "")).cast("long")
    rows = texts.select(F.col(key).alias("key_"), letters.alias("n")).join(sums, "key_", "left").crossJoin(F.broadcast(known))
    gain = lambda k: F.coalesce(F.try_element_at(F.col("gains"), k["lang"]), F.lit(0.0))
    scores = F.transform("known", lambda k: F.struct((-F.round(gain(k) + F.col("n") * k["unknown"], 6)).alias("score"), k["lang"].alias("lang")))
    return rows.select(F.col("key_").alias(key), F.when(F.col("n") > 0, F.array_min(scores)["lang"]).alias("language"))


def train(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model for from_text(), from all rows and whole texts; see model_table().

    TRIGRAMS rows of each language come to the driver.
    """
    table = model_table(texts, text_col, lang_col)
    return Model.of((r["lang"], r["gram"], r["log"], r["unknown"]) for r in table.collect())


def classify_all(model: Model, texts: Sequence[str | None]) -> list[str | None]:
    """The likeliest language of each text; null for one without letters. Ties go to the first code."""
    each = [_trigrams(t or "") for t in texts]
    sizes = np.array([len(g) for g in each], np.int64)
    if not model.languages or not sizes.sum():
        return [None] * len(each)
    grams = np.concatenate(each)
    score = sizes[:, None] * model.unknown
    if len(model.grams):
        at = np.minimum(np.searchsorted(model.grams, grams), len(model.grams) - 1)
        known = np.flatnonzero(model.grams[at] == grams)
        row = np.repeat(np.arange(len(each)), sizes)[known]
        for j in range(len(model.languages)):
            score[:, j] += np.bincount(row, model.logs[at[known], j] - model.unknown[j], len(each))
    best = np.argmax(np.round(score, 6), axis=1)
    return [model.languages[b] if n else None for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]


def classify(model: Model, text: str | None) -> str | None:
    """classify_all() of one text."""
    return classify_all(model, [text])[0]


def from_text(text: Column, model: Model) -> Column:
    """classify() as a column. Texts come in rows, of which a worker holds a hundred, and not in Arrow batches, which hold ten thousand."""

    @F.udf("string", useArrow=False)
    def guess(one: str | None) -> str | None:
        return classify(model, one)

    return guess(text)
