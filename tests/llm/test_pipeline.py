"""Each stage of the pipeline on what the stage before kept, against plain Python."""

import hashlib
import pathlib

import corpus_pipeline
from broadsheet.llm import classify, zdict
from broadsheet.llm.common import shared_folder, table
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_ngram_join import brute as linked

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.collect()
    model = classify.learn(docs, table(spark, SF, "labels"), classify.TOXICITY)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        after = out.collect()
        ids = sorted(r.doc_id for r in after)
        if name == "toxicity":
            expected = [r.doc_id for r in before if zdict.score(model, r.text) < 0.5]
        elif name == "exact_dedup":
            best = {}
            for r in before:
                key = hashlib.sha256("".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r").encode()).digest()
                best.setdefault(key, []).append((-len(r.text or ""), r.doc_id))
            expected = [min(v)[1] for v in best.values()]
        elif name == "ngram_join":
            expected = [d for d, _, c in linked([(r.doc_id, r.text) for r in before]) if d == c]
        else:
            bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            expected = [h[0] for h in hits([(r.doc_id, r.text) for r in before], bench) if not h[-1]]
        assert ids == sorted(expected), name
        docs, before = spark.createDataFrame(after, docs.schema), after
    visits = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert {v.doc_id for v in visits} == {r.doc_id for r in before}
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, visits))
    assert not list(pathlib.Path(shared_folder(spark)).glob("pipeline-*/*"))


ODD = [(1, None, "a"), (2, "", "b"), (3, " \t\n", None), (None, "some text that has no id", "a"), (4, "the same text as another row", "a"), (4, "the same text as another row", "a"), (5, "long " * 20000, "b"), (6, "é\U0001f600 日本 \x00 x", "a"), (4, "the same id over another text", "c")]
#: For each stage the rows of ODD that stay, by their place; of rows 0 to 2 and of 4 and 5 any one.
STAY = {"toxicity": set(range(9)), "exact_dedup": {3, 6, 7, 8}, "ngram_join": {0, 1, 2, 3, 6, 7, 8}, "decontamination": set(range(9))}
EITHER = {"exact_dedup": [{0, 1, 2}, {4, 5}], "ngram_join": [{4, 5}]}


def test_stages_on_odd_tables(spark):
    extra = ["id_", "digest", "set_", "key", "hit_key_", "copies_", "text_sha256", "copy_rank", "label_", "row_id"]
    schema = "doc_id long, text string, source string, nth int, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(*r, k, *["x"] * len(extra)) for k, r in enumerate(ODD)], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        left = {r.nth for r in out.collect()}
        either = EITHER.get(name, [])
        assert left - set().union(*either) == STAY[name] and all(len(left & e) == 1 for e in either), name
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.collect() == []
    visits = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert len([v for v in visits if v.epoch == 0]) == len(ODD)
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), SF).collect() == []


def test_toxicity_sends_texts_in_rows_and_keeps_one_model(spark):
    from broadsheet.llm import classify, zdict

    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} text") for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    plan = classify.keep_zeros(docs, labels, classify.TOXICITY)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    for text in (b" one two", b" three four"):
        assert zdict.compressors("sizes", text, text) is zdict.compressors("sizes", text, text)
    assert len(zdict._KEPT) == 1
