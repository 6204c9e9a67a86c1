"""From the documents to a training mixture: toxicity, exact and near duplicates, benchmarks, mixing.

Every stage works on all rows that the one before kept, and all but the last return rows as they came,
with all their columns. An empty table stays one. Columns other than doc_id, text and source are not
read, whatever their names; null texts count as empty throughout.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import classify, decontaminate, dedup_exact, mixing, ngram_join
from broadsheet.llm.common import cut, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learnt from the labels, does not reject.

    Empty and null texts have the score of a text without toxic windows and stay as those do. Repeated
    rows and rows without an id are each judged by their text.
    """
    return classify.keep_zeros(docs, table(spark, sf_dir, "labels"), classify.TOXICITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one that exact de-duplication keeps: the longest, then the smallest id.

    Empty and null texts are one group, of which one stays; null ids come last; of rows alike in id and
    text one stays.
    """
    return dedup_exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by Jaccard 0.8 on five-word shingles the one with the smallest id.

    Texts without words are linked with nothing and stay. A row without an id goes where one with an id
    is linked with it; of rows that share the smallest id one stays.
    """
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item.

    Texts without words and all texts where the benchmark is empty stay. Repeated rows are judged alike.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The visits of the mixture to the documents that are left, each at least once.

    A null source is the empty one; documents without tokens cost nothing and are visited all the same;
    repeated rows are visited each for itself.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the toxicity stage; tests hold the others against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each is written to the shared folder and read by the next, and removed after that.

    The visits of the last one, which have no texts, are written to the checkpoint folder, so that nothing reads
    what the stage before wrote any more.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        here = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            _remove(spark, before)
        before = here
    mixture = cut(STAGES[-1][1](spark, docs, sf_dir))
    _remove(spark, folder)
    return mixture
