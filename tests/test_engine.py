"""Records, queries against SQL, sources and streams."""

import datetime as dt
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from broadsheet.functions import languages
from broadsheet.operators import queries, relational
from broadsheet.plans.extract import extract
from broadsheet.sources import pages as sources
from broadsheet.streaming.dedup import dedup_stream, hourly_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(queries.SQL[name])
    assert sorted(rel.columns) == columns
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in df.select(*columns).collect()) == key(rel.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_queries_without_sql_by_hand(spark):
    """Those that SQL cannot express, from the pages' own markup."""
    import html
    import re

    pages = {r.page_id: r for r in queries._pages(spark, SF).collect()}
    plain = lambda t: " ".join(html.unescape(re.sub("<[^>]*>", " ", t)).split())
    for r in queries.content_blocks(spark, SF).collect():
        inner = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        assert r.method == "main_element" and (r.status == "too_short" or " ".join(r.text.split()) == plain(inner))
    for r in queries.raw_text(spark, SF).collect():
        body = re.sub(r"(?s)<(script|style|head|noscript)\b.*?</\1>", " ", pages[r.page_id].html)
        assert set(plain(re.sub(r"<header>[^<]*", "", body)).split()) <= set(r.text.split())
    stats = {(r.text_extraction_method, r.extract_status): r.n for r in queries.method_stats(spark, SF).collect()}
    assert sum(stats.values()) == len(pages) and {m for m, _ in stats} == {"main_element"}
    assert queries.extract_flagship(spark, SF).filter("language is null or article_title is null").count() == 0


def test_url_queries_read_no_pages_and_run_no_python(spark):
    plan = queries.QUERIES["dedup_url"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
    plan = queries.QUERIES["extract_native"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan  # "Arrow" alone is part of names of references


def test_overrides_and_defaults(spark):
    p = spark.createDataFrame([(1, "https://bit.ly/x1", "<p>short</p>"), (2, None, None)], "page_id long, url string, html string")
    out = {r.page_id: r for r in extract(p, dt.datetime(2024, 1, 1), defaults={"language": F.lit("en"), "article_title": F.lit("T")}).collect()}
    assert out[1].extract_status == "too_short" and out[1].is_shortened and out[1].language == "en" and out[1].article_title == "T"
    assert out[2].extract_status == "failed" and out[2].normalized_url is None and out[2].unique_url_hash is None
    assert extract(p, dt.datetime(2024, 1, 1), drop_failed=True).count() == 0
    with pytest.raises(ValueError):
        extract(p, dt.datetime(2024, 1, 1), overrides={"nothing": F.lit(1)})


def test_what_is_given_is_not_built(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("built though it is given")

    from broadsheet.functions import content, dates, domains, titles

    for module, name in ((domains, "canonical_domain"), (content, "content"), (content, "canonical_url"), (dates, "publication_date"), (titles, "from_html")):
        monkeypatch.setattr(module, name, never)
    p = spark.createDataFrame([(1, "http://a.com/x", "<p>y</p>")], "page_id long, url string, html string")
    given = {"canonical_domain": F.lit("d"), "text_content": F.lit("few"), "canonical_url": F.lit("u"), "publication_date": F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz"), "article_title": F.lit("t")}
    got = extract(p, dt.datetime(2024, 1, 1), overrides=given, drop_failed=True).collect()
    assert [(r.canonical_domain, r.text_content, r.text_extraction_method, r.extract_status) for r in got] == [("d", "few", "overriden", "ok")]


def test_title_of_the_extractor_and_language_of_the_text(spark):
    docs = spark.createDataFrame([("aaa bbb ccc " * 50, "xx"), ("ddd eee fff " * 50, "yy")], "text string, lang string")
    p = spark.createDataFrame([(1, "http://a.com/x", "<article><h1><b>From</b> the text</h1>" + "<p>ddd eee fff, ddd eee fff, ddd eee fff.</p>" * 9 + "</article>")], "page_id long, url string, html string")
    got = extract(p, dt.datetime(2024, 1, 1), language_model=languages.train(docs), other_metadata=True).first()
    assert (got.language, got.article_title, got.other.raw_title) == ("yy", "From the text", "From the text")


def test_flagship_learns_from_all_documents(spark, tmp_path):
    """One text decides, of more than a thousand, the digest of which is among the last."""
    late = next(t for t in ("ddd eee fff " * 50 + str(i) for i in range(999)) if hashlib.md5(t.encode()).hexdigest() > "f")
    docs = [(f"aaa bbb {i}", "xx") for i in range(1000)] + [(late, "xx"), ("ggg hhh", "yy")]
    spark.createDataFrame(docs, "text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    page = (1, "http://a.com/x", "<article>" + "<p>ddd eee fff, ddd eee fff, ddd eee fff.</p>" * 9 + "</article>")
    spark.createDataFrame([page], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [r.language for r in queries.extract_flagship(spark, str(tmp_path)).collect()] == ["xx"]


def test_errors_raise(spark):
    p = spark.createDataFrame([(1, "http://a.com/x", "<p>short</p>")], "page_id long, url string, html string")
    with pytest.raises(Exception, match="too_short"):
        extract(p, dt.datetime(2024, 1, 1), errors="raise").collect()


def test_stage_counts(spark):
    records, seen = relational.stage_counts(queries.QUERIES["extract_flagship"](spark, SF))
    n = records.count()
    assert seen.get["total"] == n == 50 and seen.get["title"] == n and seen.get["pub_date"] == 0


def test_sql_functions(spark):
    relational.register(spark)
    queries._pages(spark, SF).createOrReplaceTempView("pages")
    got = spark.sql("select normalize_url(url) a, url_hash(url) b, is_homepage_url(url) c, title_from_html(html) d, normalize_title(title_from_html(html)) e, language_from_tags(html) f, feed_url(url) g, raw_text(html) h from pages").collect()
    p = queries._pages(spark, SF)
    from broadsheet.functions import languages, titles, urls

    t = titles.from_html(F.col("html"))
    want = p.select(urls.normalize(F.col("url")), urls.url_hash(F.col("url")), urls.is_homepage(F.col("url")), t, titles.normalize_title(t), languages.from_tags(F.col("html")), urls.feed_normalize(F.col("url"))).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(map(tuple, want))


def test_first_of_each_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, k string")
    assert sorted(r.id for r in relational.first_of_each(df, "k", "id").collect()) == [1, 3, 4]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('http://a/"x",y', "en", "2020-01-01", 'A "title",\nin lines')], sources.TRUTH)
    sources.write_csv(df, str(tmp_path / "t"))
    assert sources.read_truth(spark, str(tmp_path / "t")).collect() == df.collect()


def test_lines_and_mining(spark, tmp_path):
    (tmp_path / "t.txt").write_text("see 'http://a.b/c' and \"http://a.b/d.jpeg\"\nhttp://a.b/c")
    assert [r.url for r in relational.mined_urls(sources.read_lines(spark, str(tmp_path / "t.txt"))).collect()] == ["http://a.b/c"]


def test_streams(spark, tmp_path):
    rows = [(1, "http://www.a.com/x?ref=1"), (2, "http://a.com/x"), (3, "http://b.com/y"), (4, None), (5, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("seen", F.lit(dt.datetime(2024, 1, 1)))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made, mode, expected in (("kept", dedup_stream(stream, "seen"), "append", 4), ("hours", hourly_counts(stream, "seen"), "complete", 4)):
        query = made.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
        assert spark.table(name).count() == expected


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pages_reach_python_in_rows_and_not_in_large_batches(spark):
    plan = queries.extract_flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
