"""Character sets found in bytes, and Link headers."""

import pytest
from pyspark.sql import functions as F

from broadsheet.sources import charsets
from broadsheet.sources import pages as sources

SENTENCES = {
    "shift_jis": "日本の首相は月曜日、東京で記者会見を開き、新しい経済政策について説明した。",
    "euc_jp": "日本の首相は月曜日、東京で記者会見を開き、新しい経済政策について説明した。",
    "gb18030": "中国政府星期一宣布新的经济政策，专家认为这将影响全球市场的发展。",
    "big5": "台灣總統星期一在台北宣布新的經濟政策，專家認為這將影響全球市場的發展。",
    "euc_kr": "한국 정부는 월요일 서울에서 새로운 경제 정책을 발표했다고 밝혔다.",
    "windows-1251": "Правительство России в понедельник объявило о новой экономической политике.",
    "koi8-r": "Правительство России в понедельник объявило о новой экономической политике.",
    "iso8859-5": "Правительство России в понедельник объявило о новой экономической политике.",
    "windows-1252": "Le gouvernement français a annoncé lundi une nouvelle politique économique très attendue.",
    "windows-1250": "Rząd ogłosił w poniedziałek nową politykę gospodarczą, która może zmienić życie wielu ludzi.",
    "windows-1253": "Η ελληνική κυβέρνηση ανακοίνωσε τη Δευτέρα νέα οικονομική πολιτική.",
    "windows-1254": "Türkiye hükümeti pazartesi günü yeni ekonomi politikasını açıkladı, değişiklikler bekleniyor.",
    "windows-1255": "ממשלת ישראל הודיעה ביום שני על מדיניות כלכלית חדשה",
    "utf-8": "Où est-ce que ça mène ?",
    "iso2022_jp": "日本の首相は",
    "utf-16-le": "plain text é",
    "utf-16-be": "plain text",
}


@pytest.mark.parametrize("name", sorted(SENTENCES))
def test_detected(name):
    for text in (SENTENCES[name], "<html><p class='x'>" * 40 + SENTENCES[name], SENTENCES[name] + " tag " * 3000):
        assert charsets.detect(text.encode(name)) == name
        assert charsets.decoded(text.encode(name), "iso-8859-1") == (text, name)


@pytest.mark.parametrize("text", ["Die größte Überraschung für Bürger: Straßen müssen schöner werden", "El niño comió en la montaña según informó la policía", "Året var godt for båden på søen", "déjà vu", "Müller", "“quote” – dash…"])
def test_western_text(text):
    assert charsets.decoded(text.encode("windows-1252"), None)[0] == text


def test_what_is_declared_and_odd_bodies(spark):
    rows = [
        ("é".encode("latin-1"), "utf-8", "�", "utf-8"),
        ("é".encode("latin-1"), "utf-16", "é", "windows-1252"),
        (b"\xef\xbb\xbfx", None, "x", "utf-8"),
        (b"", None, "", "ascii"),
        (None, "utf-8", None, None),
        ("日本".encode()[:-1], None, "日�", "utf-8"),
        ("ab\n".encode("utf-16"), "ascii", "ab\n", "utf-16"),
        (("x" * 200_000 + "é").encode("latin-1"), "ISO-8859-1", "x" * 200_000 + "é", "windows-1252"),
        ("ok é".encode(), "latin-1", "ok é", "utf-8"),
    ]
    df = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(rows)], "k int, body binary, declared string")
    got = df.select("k", charsets.decode(F.col("body"), F.col("declared")).alias("d")).select("k", "d.*").orderBy("k").collect()
    assert [(r.html, r.charset) for r in got] == [r[2:] for r in rows]
    assert df.limit(0).select(charsets.decode(F.col("body"), F.col("declared"))).count() == 0


def test_links(spark):
    value = '<http://a/x,y;z>; rel="prev  NEXT"; title="a, <b>; \\"c\\""; rel=up;title*=UTF-8\'\'d, ,<b>;anchor, junk <c> ; REL = self'
    got = spark.range(1).select(sources.links(F.lit(value)).alias("l"), sources.links(F.lit(None).cast("string")).alias("n"), sources.linked(F.lit(value), "Next").alias("next"), sources.linked(F.lit(value), "up").alias("up"), sources.linked(F.lit(value), "self").alias("own")).first()
    assert [(x.url, x.rel, x.parameters) for x in got.l] == [
        ("http://a/x,y;z", ["prev", "next"], {"rel": "prev  NEXT", "title": 'a, <b>; "c"', "title*": "UTF-8''d"}),
        ("b", [], {"anchor": ""}),
        ("c", ["self"], {"rel": "self"}),
    ]
    assert (got.n, got.next, got.up, got.own) == ([], "http://a/x,y;z", None, "c")


def test_long_headers_take_time_in_proportion(spark):
    value = '<http://a>; rel="x"; title="' + "q" * 200_000
    assert spark.range(1).select(sources.linked(F.lit(value), "x").alias("u")).first().u == "http://a"


def test_raw_responses(spark):
    rows = [
        ("http://asked", 200, {"CONTENT-TYPE": "text/html;charset='utf-8'", "Memento-DateTime": "x", "link": '<http://o>; rel="original timegate"'}, b"a", "http://led"),
        ("http://asked", 200, {"Link": "<http://o>; rel=original"}, b"b", "http://led"),
        ("http://asked", 200, {"memento-datetime": "x"}, b"c", None),
        ("http://asked", 200, {"content-type": "image/png"}, b"d", None),
        ("http://asked", 500, {}, b"e", None),
        ("http://asked", 200, None, None, None),
    ]
    df = spark.createDataFrame(rows, "url string, status int, headers map<string,string>, body binary, led string")
    got = {(r.html, r.charset, r.final_url) for r in sources.fetched_raw(df, final="led").collect()}
    assert got == {("a", "utf-8", "http://o"), ("b", "ascii", "http://led"), ("c", "ascii", "http://asked"), (None, None, "http://asked")}
