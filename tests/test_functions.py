"""URL, title, language and date functions against fixed values: results that must come out to the letter."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from broadsheet.functions import content, dates, domains, languages, text, titles, urls
from broadsheet.operators import queries, relational


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def check(spark, f, pairs):
    got = values(spark, f, [a for a, _ in pairs])
    assert got == [b for _, b in pairs]


def test_normalize_url(spark):
    check(
        spark,
        urls.normalize,
        [
            ("https://upstract.com/x/fdf95bf448e1f2a8", "http://upstract.com/x/fdf95bf448e1f2a8"),
            ("https://upstract.com/x/fdf95bf448e1f2a8?ref=rss", "http://upstract.com/x/fdf95bf448e1f2a8"),
            ("http://http://www.al-monitor.com/pulse", "http://al-monitor.com/pulse"),
            ("http:/www.mysite.com/", "http://mysite.com/"),
            ("//www.mysite.com/", "http://mysite.com/"),
            ("http:\\\\www.mysite.com/", "http://mysite.com/"),
            ("https://www.gpo.gov:/fdsys/pkg/PL", "http://gpo.gov/fdsys/pkg/pl"),
            ("http://newsmachete.com?page=2", "http://newsmachete.com/?page=2"),
            ("http://cnn.COM/my-story", "http://cnn.com/my-story"),
            ("https://www.youtube.com/watch?v=aFCO6WidGVM", "http://youtube.com/watch?v=aFCO6WidGVM"),
            ("http://fake.com/article?foo=123&baz=321", "http://fake.com/article?baz=321&foo=123"),
            ("http://fake.com/article?utm_foo=123&baz=321", "http://fake.com/article?baz=321"),
            ("http://fake.com/article?foo=123&UTM_baz=321", "http://fake.com/article?foo=123"),
            ("https://do.ma.in:442/what/ever", "http://do.ma.in/what/ever"),
            ("http://do.ma.in:80/what/ever", "http://do.ma.in/what/ever"),
            ("http://10.2.3.4/hello/world.html", "http://10.2.3.4/hello/world.html"),
            # what the patterns do at their edges
            ("http://media.com/a.html", "http://com/a.html"),
            ("http://media.com/a", "http://media.com/a"),
            ("http://a.com/b///", "http://a.com/b//"),
            ("http://a.com//b//c", "http://a.com//b/c"),
            ("http://a.com/?sort=1&PHPSESSID=2&sortPHPSESSID=3", "http://a.com/?phpsessid=2&sort=1&sortphpsessid=3"),
            ("http://x.nytimes.com/a?hp=1&b=2", "http://x.nytimes.com/a?b=2"),
            ("http://a.com/?nk=zz&x=1", "http://a.com/?nk=zz&x=1"),
            ("http://bash.org/?244321=", "http://bash.org/?244321"),
            ("https://archive.is/a/b1/http://x.org/Y", "http://x.org/y"),
            (" http://a.com/b c ", "http://a.com/b%20c"),
            ("", None),
            (None, None),
        ],
    )


def test_hash_is_of_the_normal_form(spark):
    import hashlib

    assert values(spark, urls.url_hash, ["https://www.a.com/x?ref=1", None]) == [hashlib.sha256(b"http://a.com/x").hexdigest(), None]


def test_youtube(spark):
    check(
        spark,
        urls.youtube,
        [
            ("http://m.youtube.com/watch?v=aB&t=1", "https://www.youtube.com/watch?v=aB"),
            ("https://www.youtube.com/embed/X1?rel=0", "https://www.youtube.com/watch?v=X1"),
            ("https://www.youtube.com/channel/C?x=1", "https://www.youtube.com/channel/C"),
            ("https://www.youtube.com/user/U?x=1", "https://www.youtube.com/user/U?x=1"),
            ("http://a.com/", "http://a.com/"),
        ],
    )


def test_canonical_domain(spark):
    check(
        spark,
        domains.canonical_domain,
        [
            ("https://observers.france24.com/en/20190826-mexico-x", "france24.com"),
            ("https://www.bizjournals.com/bizjournals/news/2022/06/02/x.html", "bizjournals.com"),
            ("https://www.kenya-today.com/media/x#comments", "kenya-today.com"),
            ("https://datatherapy.wordpress.com/2019/03/13/x/", "datatherapy.wordpress.com"),
            ("https://wordpress.com/blog/2022/05/19/x/", "wordpress.com"),
            ("https://www-example-com.cdn.ampproject.org/c/www.example.com/amp/doc.html", "www.example.com"),
            ("https://147.182.248.18/2022/09/16/x/", "147.182.248.18"),
            ("http://www.gov.cn/", "gov.cn"),
            ("http://wwf.or.jp/", "wwf.or.jp"),
            ("http://wwf.org.br/", "wwf.org.br"),
            ("https://www.sydney.edu.au", "sydney.edu.au"),
            ("https://travel.gc.ca", "travel.gc.ca"),
            ("http://rn.gov.br/", "rn.gov.br"),
            ("http://www.ma.gov.br/", "ma.gov.br"),
            ("http://example.com/x.tumblr.com", ".example.com"),
        ],
    )


def test_public_suffix(spark):
    check(spark, domains.public_suffix, [("a.b.co.uk", "co.uk"), ("x.y.ck", "y.ck"), ("www.ck", "ck"), ("a.www.ck", "ck"), ("localhost", None), ("com", "com"), ("a.city.kawasaki.jp", "kawasaki.jp"), ("comx", None)])


def test_predicates(spark):
    check(
        spark,
        urls.is_homepage,
        [(f"http://www.nytimes.com{p}", True) for p in ("", "/", "///", "/en", "/en/", "/ES/", "/global/", "/" + "a" * 17 + "/", "/" + "a" * 17)]
        + [(f"http://www.nytimes.com{p}", False) for p in ("/oKyFAMiZMbU", "/" + "a" * 18, "/a1")]
        + [("https://bit.ly/my-url", False), (" https://www.letras.com.br/banda-n-drive/eden ", False), (None, None), ("no host", None)],
    )
    check(
        spark,
        urls.is_shortened,
        [("https://bit.ly/my-url", True), ("https://wapo.st/4FGH5Re3", True), ("http://nyti.ms/4K9g6u", True), ("https://bbc.uk/news", True), ("https://bit.ly/", False), ("https://thekenyatimes.com/counties/kisumu-issuance/", False), (None, None)],
    )
    check(spark, urls.is_non_news, [("tiktok.com", True), ("en.Wikipedia.org", True), ("cnn.com", False), ("nottiktok.com", False), (None, None)])


def test_all_shorteners(spark):
    assert len(set(urls.SHORTENERS)) == 429
    hosts = ["4sq.com", "alturl.com", "binged.it", "0rz.tw", "migre.me", "snipurl.com"]
    check(spark, urls.is_shortened, [(f"http://{h}/a-b", True) for h in hosts] + [("http://shorturls.example/a-b", False)])
    check(spark, urls.is_homepage, [(f"http://{h}/ab", False) for h in hosts])
    df = spark.createDataFrame([(h.upper(),) for h in hosts] + [("example.com",)], "host string")
    assert sorted(r.host for r in relational.only_shortened(df, F.col("host")).collect()) == sorted(h.upper() for h in hosts)


def test_feed(spark):
    check(
        spark,
        urls.feed_normalize,
        [
            ("https://Aaa.Bbb/ccc?a=1&c=3&b=2#z", "http://aaa.bbb/ccc?a=1&b=2&c=3#z"),
            ("http://aaA.bbB:80/ccc?c=3&b=2&a=1#Z", "http://aaa.bbb/ccc?a=1&b=2&c=3#z"),
            ("https://aaA.bbB:443/ccc?c=3&b=2&a=1#Z", "http://aaa.bbb/ccc?a=1&b=2&c=3#z"),
            ("http://aaA.bbB:123/ccc?c=3&b=2&a=1#Z", "http://aaa.bbb:123/ccc?a=1&b=2&c=3#z"),
            ("http://peoplesdailyng.com/feed/", "http://peoplesdailyng.com/feed"),
            ("https://www.peoplesdailyng.com/feed", "http://peoplesdailyng.com/feed"),
            ("a.b/c", "://a.b/c"),
            ("http://a.b/c;x=1", "http://a.b/c"),
        ],
    )


def test_normalize_title(spark):
    check(
        spark,
        titles.normalize_title,
        [
            ("This is my <b>awesome article</b>", "this is my awesome article"),
            ("  This is my <b>awesome article</b>", "this is my awesome article"),
            ("My article - My Media", "my article - my media"),
            ("Washington Post - My article about something awesome that happened", "washington post - my article about something awesome that happened"),
            ("AT&T deal & more", "at deal more"),
            ("!?x" + "y" * 2000, "x" + "y" * 1023),
            (None, None),
        ],
    )
    assert values(spark, lambda c: titles.normalize_title(c, null_as_none=True), [None]) == ["none"]


SHORT, LONG, LONGER = "Short name", "A part that is long enough", "Another part that is long enough too"


def test_affixes(spark):
    check(
        spark,
        titles.without_affixes,
        [
            (SHORT, SHORT),
            (f"{LONG} - {SHORT}", LONG),
            (f"{LONG} | {LONGER}", LONG),
            (f"{SHORT} : {LONG}", f" {LONG}"),
            (f"{SHORT} - Other name", f"{SHORT} "),
            (f"{LONG} - {SHORT} - {SHORT}", LONG),
            (f"{LONG} | {SHORT} | {LONGER}", LONG),
            (f"{LONG} | {LONGER} | {SHORT}", f"{LONG} | {LONGER}"),
            (f"{SHORT} | {LONG} | {SHORT}", f"{SHORT} | {LONG} "),
            (f"{LONG} : {LONGER} - {SHORT} - {SHORT}", f"{LONG} : {LONGER}"),
            ("19 characters, no 20 - a", "19 characters, no 20"),
        ],
    )


def test_title_from_html(spark):
    long = "A title that is long enough to be one"
    check(
        spark,
        titles.from_html,
        [
            (f'<meta property="og:title" content="{long} - Media">', long),
            (f"<meta property='og:title' content='{long}'>", long),
            (f'<meta content="{long}" property="og:title"><title>x</title>', "x"),
            (f'<meta name="title" content="short"><title>{long}</title>', long),
            (f"<title> | Home | {long}</title>", long),
            (f"<title>News | {long}</title><h1><b>{long}</b></h1>", long),
            ("<h1>Only &amp; h1</h1>", "Only & h1"),
            ("<p>", None),
            (None, None),
        ],
    )


def test_languages(spark):
    check(
        spark,
        languages.from_tags,
        [
            ('<meta NOT_name="dc.language" content="es" />', None),
            ('<meta name="dc.language" content="es" />', "es"),
            ('<meta https-equiv="Content-Language" content="ko"/>', None),
            ('<meta data-rh="true" http-equiv="Content-Language" content="ko"/>', "ko"),
            ('<html dc:lang="es">', None),
            ('<html lang="es">', "es"),
            ('<html xml:lang="es">', "es"),
            ('<html lang="en" xml:lang="fr">', "fr"),
        ],
    )
    rows = [("pt-br", "pt", "pt-br"), ("en", "zh", "zh"), ("es", "es", "es"), (None, "zh", "zh"), ("zh", None, "zh"), (None, None, None), ("EN-us", "en", "en")]
    df = spark.createDataFrame(rows, "a string, b string, c string").select(languages.pick(F.col("a"), F.col("b")).alias("got"), "c")
    assert all(r.got == r.c for r in df.collect())


def test_language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = languages.train(docs.filter("doc_id % 2 = 0"))
    rows = docs.filter("doc_id % 2 = 1 and length(text) > 100").collect()
    assert sum(languages.classify(model, r.text) == r.lang for r in rows) > 0.95 * len(rows)
    assert languages.classify(model, "") is None and languages.classify(model, None) is None


def test_language_by_tables_as_by_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 3"), (-4, "日本" * 2000), (-5, "Été, ÇA va? the the")], "doc_id long, text string")
    texts = docs.select("doc_id", "text").unionByName(odd)
    table = languages.model_table(docs)
    model = languages.Model.of(map(tuple, table.select("lang", "gram", "log", "unknown").collect()))
    want = {r.doc_id: languages.classify(model, r.text) for r in texts.collect()}
    got = {r.doc_id: r.language for r in languages.guessed(texts, table, "doc_id").collect()}
    assert got == want and [want[k] for k in (-1, -2, -3)] == [None] * 3
    assert languages.guessed(texts.limit(0), table, "doc_id").count() == 0
    assert {r.language for r in languages.guessed(odd, languages.model_table(docs.limit(0)), "doc_id").collect()} == {None}


def test_model_counts_all_texts(spark):
    df = spark.createDataFrame([("a", "ab")] * 3 + [("b", "b" * 50), ("b", None), ("c", "1 2"), (None, "x"), ("", "x")], "lang string, text string")
    got = {(r.lang, r.gram): (round(2.718281828459045 ** r.log * (3000 + n)) if r.gram else None) for r in languages.model_table(df).collect() for n in [{"a": 6, "b": 50}.get(r.lang, 0)]}
    assert got == {("a", " ab"): 4, ("a", "ab "): 4, ("b", " bb"): 2, ("b", "bbb"): 49, ("b", "bb "): 2, ("c", None): None}


def test_language_model_of_all_languages_and_whole_texts(spark):
    df = spark.createDataFrame([(f"l{i:03}", "aaa bbb " * 600 if i != 230 else "aaa " * 1200 + "zyx " * 2000) for i in range(231)] + [(None, "x"), ("", "x")], "lang string, text string")
    model = languages.train(df)
    assert len(model.languages) == 231 and languages.classify(model, "zyx zyx") == "l230"
    nothing = languages.train(df.limit(0))
    assert languages.classify(nothing, "abc") is None


def test_trained_model_counts_all_rows(spark):
    df = spark.createDataFrame([("a", f"ab {i}") for i in range(900)] + [("a", "ab 0")] * 3, "lang string, text string")
    model = languages.train(df)
    assert [round(float(2.718281828459045 ** x) * (3000 + 2 * 903)) for x in model.logs[:, 0]] == [904, 904]


@pytest.mark.parametrize(
    "page,url,expected",
    [
        ("", "http://a.com/2021/04/30/x", dt.datetime(2021, 4, 30)),
        ("", "http://a.com/2021/13/30/x", None),
        ("", "http://a.com/201912/x", None),
        ("", "http://a.com/2021123/x", None),
        ("", "http://a.com/20211203/x", dt.datetime(2021, 12, 3)),
        ("", "http://a.com/n/2021-4-3-story", dt.datetime(2021, 4, 3)),
        ('<meta property="article:published_time" content="2022-06-01T10:00:00Z">', "http://a.com/", dt.datetime(2022, 6, 1)),
        ('<p>30 March 2022</p>', "http://a.com/", dt.datetime(2022, 3, 30)),
        ("<h2>Nov. 29, 2021</h2>", "http://a.com/", dt.datetime(2021, 11, 29)),
        ("<footer>&copy; 3 May 2021</footer><p>Copyright 4 May 2020</p>", "http://a.com/", None),
        (None, None, None),
    ],
)
def test_dates(spark, page, url, expected):
    df = spark.createDataFrame([(page, url)], "h string, u string")
    assert df.select(dates.publication_date(F.col("h"), F.col("u"))).first()[0] == expected
    capped = dates.publication_date(F.col("h"), F.col("u"), F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz"), F.lit(dt.datetime(2023, 1, 1)).cast("timestamp_ntz"))
    assert df.select(capped).first()[0] == dt.datetime(2023, 1, 1)


def test_strip_tags_native_and_by_parser(spark):
    well = ["a <b>c</b> &copy d <!-- x > y --> e", "<p>x<br/>y</p>", "a < b > c", "", "no tags"]
    assert values(spark, text.strip_tags, well)[1:] == values(spark, text.strip_tags_exact, well)[1:]
    broken = {
        "a &copy b <b>x</b>": "a &copy; b x",
        "&amp;&#38;&#x26 &": "&amp;&#38;&#x26; &",
        "<script>var a = 1</script><style>b {}</style>": "var a = 1b {}",
        "a < b > c": "a < b > c",
        "a <b": "a <b",
        "x<!-- c -- > d --><b title='a>b' id=\"<i>\">y</b>": "xy",
        "<<b>b>script<</i>/p>": "script",
        "<!DOCTYPE html><?xml?>t": "t",
        "a<br": "a<br",
        "<b>" * 3000 + "<" * 300 + "x": "<" * 300 + "x",
    }
    assert {t: text.without_tags(t) for t in broken} == broken
    assert values(spark, text.unescape_exact, ["&eacute;&#65;", None]) == ["éA", None]


def test_strip_tags_exact_as_its_sql_where_references_run_into_what_follows(spark, tmp_path):
    pages = [
        (1, "<title>The &amp; &a</title><style>p{margin:0}</style>"),
        (2, "<title>Ver &amp</title><style>p{margin:0}</style>"),
        (3, "<li>the &am</li><li>Of### and &copy 2020 &eacute; &#39 &#x27;</li>"),
        (4, None),
    ]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = dict(map(tuple, queries.strip_tags_exact(spark, str(tmp_path)).collect()))
    with duckdb.connect() as other:
        other.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert got == dict(other.execute(queries.SQL["strip_tags_exact"]).fetchall())
    assert got[1] == "The & &ap;{margin:0}" and got[2] == "Ver &ampp;{margin:0}" and "&amOf###;" in got[3]


def test_references_as_python_resolves_them(spark):
    import html

    odd = ["a &eacute;&Eacute; b", "&#233;&#xE9;&#XE9;", "&#150;&#128;", "&#0;&#xD800;&#1114112;", "&amp;amp; &lt;b&gt;", "&nosuch; & &;", "&NotEqualTilde;", "x&#128512;y", "no reference", "&apos;&quot;&#39;", "", "&#x27;s"]
    check(spark, text.unescape, [(t, html.unescape(t)) for t in odd] + [(None, None)])


def test_content():
    words = "word " * 45
    page = f"<nav><a href=1>{words}</a></nav><p>{words}</p><footer>{words}</footer>"
    assert content.extract_one(page, content.EXTRACTORS[2:])[:3] == (words.strip(), content.BLOCK_CLASSIFIER, content.OK)
    assert content.extract_one("<p>" + "word " * 20 + "</p>", content.EXTRACTORS[2:])[1:3] == (content.BLOCK_CLASSIFIER, content.TOO_SHORT)
    assert content.extract_one("")[1:3] == (content.FAILED, content.FAILED) == content.extract_one(None)[1:3]
    assert content.extract_one("<p>few</p>" * 90)[1] == content.PARAGRAPHS
    assert "x " in content.by_raw_text(content.Page("<header><p>x</p></header>"))
    assert content.by_raw_text(content.Page("<header>x</header>")) == ""


def test_chain_of_extractors():
    sentence = "This is a sentence, with commas, that is long enough to be one of an article."
    article = "".join(f"<p>{sentence}</p>" for _ in range(5))
    want = "\n".join([sentence] * 5)
    menu = "<ul>" + "<li><a href=/>A link of the menu</a></li>" * 9 + "</ul>"
    by = lambda page: content.extract_one(page)[:2]
    assert by(f"<body>{menu}<article>{menu}{article}</article><div><p>{sentence} Elsewhere.</p></div></body>") == (want, content.MAIN_ELEMENT)
    assert by(f'<body>{menu}<div itemprop="articleBody">{article}</div></body>') == (want, content.MAIN_ELEMENT)
    assert by(f"<body>{menu}<div><div>{article}</div></div><div><p>{sentence}</p></div></body>") == (want, content.SCORED)
    assert content.by_sentences(content.Page(f"<div>Menu</div><div>x</div>{article}<p>x</p><p>{sentence}</p><div>a</div><div>b</div><p>{sentence}</p>")) == "\n".join([sentence] * 6)
    assert content.extract_one("<article><br></article><span>plain</span>")[1] == content.RAW_TEXT
    assert content.extract_one("<noscript>" + "only here " * 40 + "</noscript>")[1:3] == (content.BARE, content.OK)
    found = content.extract_one(f'<h1>The <b>title</b></h1><article><img src="a.png" alt="x">{article}<img src=b.png></article>', with_images=True)
    assert found == (want, content.MAIN_ELEMENT, content.OK, "The title", "a.png")
    assert content.extract_one("<title> A  b </title><p>x")[3] == "A b"
    assert [name for name, _ in content.EXTRACTORS] == [content.MAIN_ELEMENT, content.SCORED, content.BLOCK_CLASSIFIER, content.SENTENCES, content.PARAGRAPHS, content.RAW_TEXT, content.BARE]


def test_canonical_url(spark):
    check(
        spark,
        content.canonical_url,
        [("<link rel='canonical' href='https://www.example.com/sample-page' />", "https://www.example.com/sample-page"), ("<meta property='og:url' content='https://www.example.com/sample-page' />", "https://www.example.com/sample-page"), ("<p>", None)],
    )
