"""Queries on spellings, responses and metadata of pages, each with SQL of its own, written by hand.

What the tables lack is derived from the pages' columns, in one of several ways by page_id; the SQL knows
what each of them must come to.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import dates, domains, hosts, linked_data, text, urls
from broadsheet.plans.dialect import DUCK
from broadsheet.plans.extract import extract
from broadsheet.sources import charsets
from broadsheet.sources import pages as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _chosen(values: Sequence[str]) -> Column:
    """One of the values for each page."""
    return F.get(F.array(*map(F.lit, values)), (F.col("page_id") % len(values)).cast("int"))


def _chosen_sql(values: Sequence[str]) -> str:
    return f"[{', '.join(map(DUCK.lit, values))}][page_id % {len(values)} + 1]"


def _id() -> Column:
    return F.col("page_id").cast("string")


_HOST = "regexp_extract(url, '://([^/?#:]*)', 1)"

# ---- fixed values: spellings and what the standards make of them ----
_PERCENT = (
    ("%7Euser/%2d%5F", "~user/-_"),
    ("a%2fb%3f", "a%2Fb%3F"),
    ("caf%c3%a9", "caf%C3%A9"),
    ("café", "caf%C3%A9"),
    ("CAF%C3%89", "CAF%C3%89"),
    ("100%", "100%"),
    ("%zz%4", "%zz%4"),
    ("%%41", "%%41"),
    ("%4%31", "%4%31"),
    ("%e9t%e9", "%E9t%E9"),
    ("a b\"<>|", "a%20b%22%3C%3E%7C"),
    ("(x)[y]*'!$&+,;=:@", "(x)[y]*'!$&+,;=:@"),
    ("%E2%82%AC%f0%9f%98%80", "%E2%82%AC%F0%9F%98%80"),
    ("日?q=本&r=%E6%9C%AC", "%E6%97%A5?q=%E6%9C%AC&r=%E6%9C%AC"),
)
#: As they compare once letters are lower-cased.
_PERCENT_ALIKE = (("%41%62c", "abc"), ("CAF%C3%89", "café"), ("%C3%a9", "É"), ("x%2Fy", "x%2fy"), ("a%2E%2e/b", "a../b"))
_DOTS = (
    ("@/b/c/./../../g", "@/g"),
    ("@/content=5/../6", "@/6"),
    ("@/a/..", "@/"),
    ("@/a/.", "@/a/"),
    ("../../@", "@"),
    ("@/..a/b../.c", "@/..a/b../.c"),
    ("@/a//../b", "@/a/b"),
    ("@/./x?y=/../z", "@/x?y=/../z"),
    ("@/.../x", "@/.../x"),
    ("@/x", "@/x"),
)
_LABELS = (
    ("münchen", "xn--mnchen-3ya"),
    ("MÜNCHEN", "xn--mnchen-3ya"),
    ("münchen", "xn--mnchen-3ya"),
    ("bücher", "xn--bcher-kva"),
    ("日本語", "xn--wgv71a119e"),
    ("правда", "xn--80aafi6cg"),
    ("παράδειγμα", "xn--hxajbheg2az3al"),
    ("한국", "xn--3e0b707e"),
    ("plain", "plain"),
)
# ---- end of fixed values ----
_SPOKEN = {"xn--mnchen-3ya": "münchen", "xn--3e0b707e": "한국"}


def url_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent-encoding in normal form, and once more; and whether two spellings of a URL have one hash."""
    at = F.concat(F.lit("http://x.org/"), _id(), F.lit("/"))
    one, other = (F.concat(at, _chosen([pair[i] for pair in _PERCENT_ALIKE])) for i in (0, 1))
    rows = _pages(spark, sf_dir).select("page_id", urls.percent(F.concat(at, _chosen([spelled for spelled, _ in _PERCENT]))).alias("normal"), (urls.url_hash(one) == urls.url_hash(other)).alias("alike"))
    return rows.select("page_id", "normal", urls.percent(F.col("normal")).alias("again"), "alike")


def url_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without segments of dots, of pages' own URLs too, which have none."""
    spelled = F.concat(F.lit("/"), F.replace(_chosen([spelled for spelled, _ in _DOTS]), F.lit("@"), _id()))
    return _pages(spark, sf_dir).select("page_id", urls.without_dots(F.concat(F.lit("http://x"), spelled)).alias("path"), urls.without_dots(F.col("url")).alias("own"), urls.normalize(F.concat(F.lit("http://"), urls.host(F.col("url")), F.lit("/a/%2E%2e/b/"), _id())).alias("normal"))


def international_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts in letters and in ASCII: either from the other, and the normal form and domain of both spellings."""
    label, known = (_chosen([pair[i] for pair in _LABELS]) for i in (0, 1))
    url = lambda name: F.concat(F.lit("https://www."), name, F.lit(".com/"), _id())
    rows = _pages(spark, sf_dir).select("page_id", label.alias("label"), known.alias("known"))
    # both spellings go through one expression
    both = F.transform(F.array(url(F.col("label")), url(F.col("known"))), lambda u: F.struct(urls.normalize(u).alias("normal"), domains.canonical_domain(u).alias("domain")))
    suffixed = domains.canonical_domain(F.concat(F.lit("http://www.x"), _id(), F.lit(".рф/a")))
    rows = rows.select("page_id", hosts.to_ascii(F.concat("label", F.lit("。example"))).alias("ascii"), hosts.to_unicode(F.col("known")).alias("letters"), both.alias("both"), suffixed.alias("suffixed"))
    return rows.select("page_id", "ascii", "letters", F.col("both")[0]["normal"].alias("normal"), F.col("both")[1]["normal"].alias("normal_of_ascii"), F.col("both")[0]["domain"].alias("domain"), F.col("both")[1]["domain"].alias("domain_of_ascii"), "suffixed")


QUERIES |= {"url_percent": url_percent, "url_dots": url_dots, "international_hosts": international_hosts}
_KNOWN = _chosen_sql([known for _, known in _LABELS])
SQL["url_percent"] = f"SELECT page_id, normal, normal AS again, true AS alike FROM (SELECT page_id, 'http://x.org/' || page_id || '/' || {_chosen_sql([normal for _, normal in _PERCENT])} AS normal FROM pages)"
SQL["url_dots"] = f"""
SELECT page_id, 'http://x/' || replace({_chosen_sql([path for _, path in _DOTS])}, '@', CAST(page_id AS VARCHAR)) AS path, url AS own,
       'http://' || regexp_replace({_HOST}, '^(m|www|blog|news)[.]', '') || '/b/' || page_id AS normal FROM pages
"""
SQL["international_hosts"] = f"""
SELECT page_id, known || '.example' AS ascii, {_chosen_sql([_SPOKEN.get(known, letters) for letters, known in _LABELS])} AS letters, 'http://' || known || '.com/' || page_id AS normal,
       'http://' || known || '.com/' || page_id AS normal_of_ascii, known || '.com' AS domain, known || '.com' AS domain_of_ascii, 'x' || page_id || '.xn--p1ai' AS suffixed
FROM (SELECT page_id, {_KNOWN} AS known FROM pages)
"""


# ---- responses as servers send them ----

#: What stands in the pages' place in bodies of other character sets, each in a set that has its letters.
_SPOKEN_IN = (
    ("shift_jis", "日本の首相は月曜日、東京で記者会見を開き、新しい経済政策について説明した。"),
    ("euc_jp", "この記事では、東京の新しい図書館とその本について説明しています。"),
    ("gb18030", "中国政府星期一宣布新的经济政策，专家认为这将影响全球市场的发展。"),
    ("big5", "台灣總統星期一在台北宣布新的經濟政策，專家認為這將影響全球市場的發展。"),
    ("euc_kr", "한국 정부는 월요일 서울에서 새로운 경제 정책을 발표했다고 밝혔다."),
    ("windows-1251", "Правительство в понедельник объявило о новой экономической политике."),
    ("koi8-r", "Министр сообщил журналистам, что переговоры продолжатся завтра."),
    ("windows-1253", "Η ελληνική κυβέρνηση ανακοίνωσε τη Δευτέρα νέα οικονομική πολιτική."),
    ("windows-1250", "Rząd ogłosił w poniedziałek nową politykę gospodarczą, która może zmienić życie wielu ludzi."),
    ("windows-1252", "Le gouvernement français a annoncé lundi une politique économique très attendue."),
    ("utf-8", "Où est-ce que ça mène ? 日本 и Россия."),
    ("utf-16", "Texte à deux octets, 日本."),
)
_SETS = len(_SPOKEN_IN)
_LINKS = (
    ('<http://a.org/x?a=1,2>; rel="original", <http://b.org/t>; rel="timemap"; type="application/link-format"', "http://a.org/x?a=1,2"),
    ('<http://b.org/t>; rel=timegate , <http://a.org/y>;title="one, <two>; rel=\\"none\\""; REL="Latest-Version ORIGINAL"', "http://a.org/y"),
    ('<http://a.org/first>; rel="first memento"; rel="original", <http://b.org>; rev=original', None),
    ("not a link", None),
)


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' bytes in twelve character sets, declared wrongly or not at all, decoded from the bytes; UTF-8 is believed where it is declared."""
    spoken = F.get(F.array(*(F.unhex(F.lit(spoken.encode(name).hex())) for name, spoken in _SPOKEN_IN)), (F.col("page_id") % _SETS).cast("int"))
    of_page = F.regexp_replace("html", "[^\\x00-\\x7f]", "")
    # in text of two bytes a character the page's own letters must be so too
    wide = F.when(F.col("page_id") % _SETS == _SETS - 1, F.concat(spoken, F.substr(F.encode(of_page, "UTF-16LE"), F.lit(1)))).otherwise(F.concat(F.encode(of_page, "UTF-8"), spoken))
    kind = F.when(F.col("page_id") % 3 == 0, F.lit("text/html; charset=ISO-8859-1")).when(F.col("page_id") % 3 == 1, F.lit("Text/HTML"))
    link = _chosen([value for value, _ in _LINKS])
    headers = F.map_filter(F.map_from_arrays(F.array(F.lit("Content-Type"), F.lit("LINK"), F.lit("Memento-Datetime")), F.array(kind, link, F.when(F.col("page_id") % 5 != 0, F.lit("x")))), lambda _, v: v.isNotNull())
    made = _pages(spark, sf_dir).select("page_id", "url", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"), headers.alias("headers"), wide.alias("body"))
    out = sources.fetched_raw(made).select("page_id", "charset", "final_url", F.sha2("html", 256).alias("html_sha256"), F.length("html").cast("long").alias("n_chars"))
    believed = _pages(spark, sf_dir).select("page_id", charsets.decode(F.encode("html", "ISO-8859-1"), F.lit('"UTF-8"')).alias("d"))
    return out.join(believed.select("page_id", F.col("d.charset").alias("believed")), "page_id")


QUERIES["raw_responses"] = raw_responses
_SPOKEN_SQL = _chosen_sql([spoken for _, spoken in _SPOKEN_IN])
_OWN_SQL = "regexp_replace(html, '[^\\x00-\\x7f]', '', 'g')"
_ORIGINALS = "[" + ", ".join("NULL" if url is None else DUCK.lit(url) for _, url in _LINKS) + f"][page_id % {len(_LINKS)} + 1]"
SQL["raw_responses"] = f"""
SELECT page_id, {_chosen_sql([name for name, _ in _SPOKEN_IN])} AS charset, CASE WHEN page_id % 5 <> 0 THEN coalesce({_ORIGINALS}, url) ELSE url END AS final_url,
       sha256(html) AS html_sha256, length(html) AS n_chars, 'utf-8' AS believed
FROM (SELECT page_id, url, CASE WHEN page_id % {_SETS} = {_SETS - 1} THEN {_SPOKEN_SQL} || {_OWN_SQL} ELSE {_OWN_SQL} || {_SPOKEN_SQL} END AS html FROM pages WHERE page_id % 7 <> 0)
"""


# ---- linked data and dates in tags ----

#: Linked data in several shapes; ~ stands for the page's id. Beside each what it tells: title, authors, image, day published, type.
_LINKED = (
    ('{"@type": "NewsArticle", "headline": "News &amp; more ~", "author": {"@type": "Person", "name": "Ann ~"}, "image": "http://i/~.png", "datePublished": "2021-04-30T10:00:00Z"}', "News & more ~", "Ann ~", "http://i/~.png", "2021-04-30", "NewsArticle"),
    ('[{"@type": "Organization", "name": "O"}, {"@type": ["CreativeWork", "BlogPosting"], "name": "Blog ~", "author": [{"name": "A"}, "B ~", {"name": "A"}], "image": [{"url": "http://i/1~"}, "x"], "dateCreated": "Fri, 30 Apr 2021 10:00:00 GMT"}]', "Blog ~", "A|B ~", "http://i/1~", "2021-04-30", "CreativeWork"),
    ('{"@context": "https://schema.org", "@graph": [{"@type": "WebPage", "name": "The page"}, {"@type": "Article", "headline": "Graph ~", "author": [{"@id": "#a"}, {"@id": "#nobody"}], "image": {"@id": "#i"}, "datePublished": "20210430"}, {"@id": "#a", "@type": "Person", "name": "Al ~"}, {"@id": "#i", "url": "http://i/g~"}]}', "Graph ~", "Al ~", "http://i/g~", "2021-04-30", "Article"),
    ('{"@type": "WebPage", "name": "outer", "mainEntity": {"@graph": [{"@type": "http://schema.org/Report", "headline": "Deep ~", "image": {"contentUrl": "c~"}, "datePublished": "April 30, 2021"}]}}', "Deep ~", None, "c~", "2021-04-30", "http://schema.org/Report"),
    ('{"@type": "NewsArticle", "headline": "broken ~", </script><script type="application/ld+json">//<![CDATA[\n{"@type": "Article", "headline": "Second ~", "author": "C"};//]]>', "Second ~", "C", None, None, "Article"),
    ('{"@type": "WebPage", "name": "Only a page ~", "image": []}', "Only a page ~", None, None, None, "WebPage"),
    ('"a text"', None, None, None, None, None),
    ('{"name": "of no type", "@graph": 7}', None, None, None, None, None),
)


def _linked_page(rest: Column) -> Column:
    return F.concat(F.lit('<SCRIPT data-x="1" type="application/ld+json">'), F.replace(_chosen([shape[0] for shape in _LINKED]), F.lit("~"), _id()), F.lit("</SCRIPT>"), rest)


def linked_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What linked data says of articles, in lists, graphs and by reference, among broken scripts; and of the pages as they are, which have none."""
    rows = _pages(spark, sf_dir).select("page_id", linked_data.article(_linked_page(F.col("html"))).alias("a"), linked_data.article(F.col("html")).isNull().alias("none_"))
    return rows.select("page_id", "a.title", F.array_join("a.authors", "|").alias("authors"), "a.image", dates.day_of(F.col("a.published")).alias("published"), "a.type", "none_")


def record_of_linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a page that has no tags but linked data: its title, date, authors and image are from there."""
    made = _pages(spark, sf_dir).withColumn("html", _linked_page(text.strip_tags(F.col("html"))))
    out = extract(made.withColumn("url", F.lit("http://x.org/a")), dt.datetime(2025, 1, 1), overrides={"text_content": F.lit("x")}, other_metadata=True)
    return out.select("page_id", "article_title", "publication_date", F.array_join("other.authors", "|").alias("authors"), "other.top_image_url", "other.raw_title")


def pub_date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in tags as servers and editors write them."""
    day = F.date_add(F.lit("2020-02-27").cast("date"), (F.col("page_id") % 400).cast("int"))
    written = [F.date_format(day, f) for f in ("EEE, dd MMM yyyy 10:11:12 'GMT'", "yyyyMMdd", "yyyyMMdd'T'101112", "MMMM d, yyyy", "d.M.yyyy", "yyyy/M/d 10:00", "yyyy-MM-dd'T'10:00:00.000+02:00", "EEEE, d MMMM yyyy")]
    value = F.get(F.array(*written), (F.col("page_id") % len(written)).cast("int"))
    tag = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta name="pubdate" content="soon"><meta property="article:published_time" content="'), value, F.lit('">')))
    tag = tag.when(F.col("page_id") % 3 == 1, F.concat(F.lit('<meta content=" '), value, F.lit("\" name='date'>"))).otherwise(F.concat(F.lit("<time class=x datetime='"), value, F.lit("'>")))
    return _pages(spark, sf_dir).select("page_id", dates.publication_date(F.concat(tag, F.col("html")), F.col("url")).alias("date"), dates.from_tags(F.col("html")).isNull().alias("none_"))


QUERIES |= {"linked_metadata": linked_metadata, "record_of_linked_data": record_of_linked_data, "pub_date_forms": pub_date_forms}


def _told_sql(i: int) -> str:
    values = ", ".join("NULL" if shape[i] is None else DUCK.lit(shape[i]) for shape in _LINKED)
    return f"replace(CAST([{values}][page_id % {len(_LINKED)} + 1] AS VARCHAR), '~', CAST(page_id AS VARCHAR))"


SQL["linked_metadata"] = f"SELECT page_id, {_told_sql(1)} AS title, {_told_sql(2)} AS authors, {_told_sql(3)} AS image, CAST({_told_sql(4)} AS TIMESTAMP) AS published, {_told_sql(5)} AS type, true AS none_ FROM pages"
SQL["record_of_linked_data"] = f"SELECT page_id, {_told_sql(1)} AS article_title, CAST({_told_sql(4)} AS TIMESTAMP) AS publication_date, {_told_sql(2)} AS authors, {_told_sql(3)} AS top_image_url, {_told_sql(1)} AS raw_title FROM pages"
SQL["pub_date_forms"] = "SELECT page_id, CAST(DATE '2020-02-27' + CAST(page_id % 400 AS INTEGER) AS TIMESTAMP) AS date, true AS none_ FROM pages"
