"""Toxicity by compression distance, and quality by compressed size, with zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm import zdict
from broadsheet.llm.common import cut, table


@dataclass(frozen=True)
class Task:
    """What a classifier learns and from how much.

    rows: labelled rows of each kind at most, the only bound on what is learnt from. teach: the fifths of
    them, by a hash of the text, that make the kind's dictionary; the others calibrate. dictionary: bytes of
    each, and of the segments that it is trained in.
    """

    label: str
    normal: str
    measure: str
    rows: tuple[int, int]
    teach: tuple[int, int]
    dictionary: tuple[tuple[int, int], tuple[int, int]]
    folds: int
    held: int
    prior: float


TOXICITY = Task(label="toxic", normal="words", measure="distances", rows=(6000, 4000), teach=(1, 4), dictionary=((3 << 20, zdict.WINDOW), (1 << 16, 12)), folds=5, held=0, prior=0.1)
QUALITY = Task(label="quality", normal="raw", measure="sizes", rows=(4000, 4000), teach=(4, 4), dictionary=((1 << 15, 16), (1 << 15, 16)), folds=3, held=1, prior=0.9)
#: Windows that one trainer is given at most, on the driver too; more are trained in parts on the workers first.
AT_ONCE = 1 << 18
#: Bytes in front of a dictionary's text, at most, that are tables.
_TABLES = 1024


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; that of an empty text for a null."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def dictionary(pieces: DataFrame, size: int, segment: int) -> bytes:
    """A dictionary trained on all windows of `pieces`.

    As long as they are more than AT_ONCE, they are dealt out by hash to as many trainers as it takes, on
    the workers, and what these pick, a half of it at most, goes on as windows. So the windows that come to
    the driver are bounded, and yet every one of them has been given to a trainer.
    """
    picked = min(max(2 * size, 1 << 20), AT_ONCE * zdict.WINDOW // 2)

    def train_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> pa.RecordBatch:
            text = zdict.trained(held, picked, segment)[_TABLES:]
            cut_up = [text[i : i + zdict.WINDOW] for i in range(0, len(text), zdict.WINDOW)]
            return pa.RecordBatch.from_arrays([pa.array(cut_up, pa.binary())], ["piece"])

        for batch in batches:
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != part and held:
                    yield done()
                    held = []
                part = k
                held.append(piece)
        if held:
            yield done()

    while (n := pieces.count()) > AT_ONCE:
        parts = -(-2 * n // AT_ONCE)
        dealt = pieces.select(F.pmod(F.xxhash64("piece"), F.lit(parts)).alias("part"), "piece").repartition("part").sortWithinPartitions("part", "piece")
        pieces = cut(dealt.mapInArrow(train_part, "piece binary"))
    return zdict.trained([bytes(r["piece"]) for r in pieces.orderBy(F.xxhash64("piece"), "piece").collect()], size, segment)  # AT_ONCE windows


def learn(docs: DataFrame, labels: DataFrame, task: Task, id_col: str = "doc_id", text_col: str = "text") -> zdict.Model:
    """A model from a bounded sample: of each label the `rows` first by a hash of the id, outside the held-out fold.

    Texts of the sample are whole and stay on the workers. Those that teach are cut into windows, all of
    which make the dictionaries; see dictionary(). The others are measured on the workers, and a few
    numbers of each come to calibrate. What is drawn does
    not depend on how the tables are laid out. Rows with null ids or labels teach nothing; of an id
    labelled twice the larger label counts, and of an id that several documents bear the least text.
    Without labels the model gives every text the prior.
    """
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(task.label).isin(0, 1) & (fold(id_col, task.folds) != task.held))
        .groupBy(F.col(id_col).alias("id_"))
        .agg(F.max(task.label).cast("int").alias("label_"))
    )
    count = {r["label_"]: r["n"] for r in known.groupBy("label_").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [known.filter(F.col("label_") == k).orderBy(F.xxhash64("id_"), "id_").limit(n) for k, n in enumerate(task.rows)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # sum(rows) ids at most
    texts = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    sample = cut(texts.join(chosen, "id_").groupBy("id_", "label_").agg(F.min("text_").alias("text_")).select("label_", "text_"))
    normal = zdict.NORMAL[task.normal]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = normal(text or "")
                if zdict.teaches(b, task.teach[label]) and (pieces := sorted(set(zdict.windows(b)))):
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(pieces), pa.int32()), pa.array(pieces, pa.binary())], ["label_", "piece"])

    pieces = sample.mapInArrow(cut_up, "label_ int, piece binary").distinct()
    pieces = cut(pieces)
    zero, one = (dictionary(pieces.filter(F.col("label_") == k).select("piece"), *made) for k, made in enumerate(task.dictionary))
    model = zdict.Model(task.normal, task.measure, zero, one)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of the dictionaries' size

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(label, normal(text or "")) for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [(label, zdict.digest(b), zdict.MEASURES[task.measure](sent.value, b)) for label, b in rows if not zdict.teaches(b, task.teach[label])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 3, (pa.int32(), pa.binary(), pa.list_(pa.float64())), strict=True)], ["label_", "key", "x"])

    seen = {bytes(r["key"]): r for r in sample.mapInArrow(measure, "label_ int, key binary, x array<double>").orderBy("key", "label_").collect()}  # a few numbers of each row
    return zdict.calibrated(model, [r["x"] for r in seen.values()], [r["label_"] for r in seen.values()], (count.get(0, 0), count.get(1, 0)), task.prior)


def scored(docs: DataFrame, model: zdict.Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of `docs`, score and predicted. Null texts count as empty."""
    rows = docs.select(*(F.col(c) for c in keep), F.col(text_col).cast("string").alias("text_"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of the dictionaries' size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [zdict.score(sent.value, t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*keep, "score", "predicted"])

    more = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return rows.mapInArrow(judge, T.StructType([*rows.schema.fields[: len(keep)], *more]))


def classify(docs: DataFrame, labels: DataFrame, task: Task, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, held_out, score (higher: label 1 likelier) and predicted.

    Scores come from the whole text alone. Null texts and texts without words have the score of an empty
    one; repeated rows and null ids come back as they are; other columns are not read.
    """
    model = learn(docs, labels, task, id_col, text_col)
    return scored(docs, model, [id_col], text_col).select(id_col, (fold(id_col, task.folds) == task.held).alias("held_out"), "score", "predicted")


def keep_zeros(docs: DataFrame, labels: DataFrame, task: Task, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted as label 1, with all their columns; see classify().

    Texts reach Python in rows, of which a worker holds a hundred, and not in Arrow batches, which hold ten thousand.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, task, id_col, text_col))

    @F.udf("double", useArrow=False)
    def scores(text: str) -> float:
        return zdict.score(sent.value, text)

    return docs.filter(scores(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) < 0.5)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify() for toxicity over the whole documents table."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TOXICITY)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify() for quality over the whole documents table."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), QUALITY)
