"""International hosts, percent-encoding and dot segments, against Python's codecs and the standards' cases."""

import random
import unicodedata
from urllib.parse import quote, unquote_to_bytes

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from broadsheet.functions import domains, encoding, hosts, urls
from broadsheet.plans.dialect import DUCK, SPARK


def values(spark, f, inputs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r.v for r in rows.select("k", f(F.col("x")).alias("v")).orderBy("k").collect()]


def random_labels():
    r = random.Random(7)
    kinds = ["aé", "abcüñ-1", "日本語テスト", "한국어", "русский", "xyz\U0001f600ß", "עברית", "ếệ", "ά"]
    made = ["".join(r.choice(r.choice(kinds)) for _ in range(r.randint(1, 14))) for _ in range(250)]
    return [unicodedata.normalize("NFC", x) for x in [*made, "münchen", "faß", "правда", "a-é-b", "éééé", "x" * 50 + "é", "é" * 40]]


def test_bootstring_both_ways(spark):
    labels = random_labels()
    coded = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels]
    assert values(spark, hosts.to_ascii, labels) == coded
    assert values(spark, hosts.to_unicode, coded) == labels
    taken_apart = [unicodedata.normalize("NFD", x).upper() + "。EXAMPLE．org" for x in labels]
    folded = [unicodedata.normalize("NFC", x.upper().lower()) for x in labels]
    want = [("xn--" + x.encode("punycode").decode() if not x.isascii() else x) + ".example.org" for x in folded]
    assert [b for a, b in zip(taken_apart, values(spark, hosts.to_ascii, taken_apart), strict=True)] == want


def test_labels_that_stand_for_nothing_stay(spark):
    odd = ["xn--", "xn--a", "xn--99999999999", "xn--zzzzzzzzzzzzzzzzzzzz", "xn--é", "xn--a_b", "", None, "a..b", "xn--mnchen-3ya.xn--.de", "XN--MNCHEN-3YA.DE"]
    got = values(spark, hosts.to_unicode, odd)
    assert got[2:5] == odd[2:5] and got[5:9] == odd[5:9] and got[9] == "münchen.xn--.de" and got[10] == "münchen.de"
    assert values(spark, hosts.to_ascii, [None, "", "PLAIN.com", "é..com"]) == [None, "", "PLAIN.com", "xn--9ca..com"]


def random_urls():
    r = random.Random(3)
    parts = ["%41", "%7e", "%2F", "%2f", "%C3%A9", "%c3", "%", "%4", "%%41", "%3", "%34", "é", "a", "/", "..", ".", "/../", "/./", "?q=", "[", "]", "'", " ", '"', "|", "%E2%80%A8", "%e2%82%ac", "%F0%9F%98%80", "\U0001f600", "%ED%A0%80", "\n", "&", "="]
    return ["http://h.com/" + "".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(1500)] + ["", None, "no host/%41 ../x", "http://h.com", "http://h.com?%41"]


@pytest.mark.parametrize("form", [encoding.decoded, encoding.encoded, encoding.without_dots])
def test_forms_in_both_engines_and_twice(spark, form):
    inputs = random_urls()
    once = values(spark, lambda c: SPARK.form(c, form()), inputs)
    assert values(spark, lambda c: SPARK.form(c, form()), once) == once
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"k": range(len(inputs)), "x": inputs}))
    assert [r[0] for r in con.sql(f"SELECT {DUCK.form('x', form())} FROM t ORDER BY k").fetchall()] == once


def test_percent_changes_no_meaning(spark):
    inputs = [u for u in random_urls() if u and u.startswith("http")]
    for u, v in zip(inputs, values(spark, urls.percent, inputs), strict=True):
        assert v.isascii() and unquote_to_bytes(v) == unquote_to_bytes(u)
        if "%" not in u:
            assert v == quote(u, safe=":/?#[]@!$&'()*+,;=~")


def test_dot_segments_of_the_standard(spark):
    cases = {"/b/c/g": "/b/c/g", "/b/c/./g": "/b/c/g", "/b/c/g/": "/b/c/g/", "/b/c/.": "/b/c/", "/b/c/./": "/b/c/", "/b/c/..": "/b/", "/b/c/../": "/b/", "/b/c/../g": "/b/g", "/b/c/../..": "/", "/b/c/../../g": "/g", "/b/c/../../../g": "/g", "/b/c/../../../../g": "/g", "/./g": "/g", "/../g": "/g", "/b/c/g.": "/b/c/g.", "/b/c/..g": "/b/c/..g", "/b/c/./g/.": "/b/c/g/", "/b/c/g;x=1/../y": "/b/c/y", "/b/c/g?y/../x": "/b/c/g?y/../x"}
    assert values(spark, urls.without_dots, ["http://a" + c for c in cases]) == ["http://a" + c for c in cases.values()]


def test_spellings_of_one_page_have_one_form(spark):
    alike = [
        ("https://www.MÜNCHEN.de/Straße", "http://xn--mnchen-3ya.de/stra%c3%9fe"),
        ("http://münchen.de/a/../b", "http://münchen.de/%62"),
        ("http://x.org/a%2eb/%7Euser", "http://x.org/a.b/~user"),
        ("http://x.org/p?utm%5Fsource=1&b=%41", "http://x.org/p?b=a"),
        ("http://user@bücher.example/x", "http://user@xn--bcher-kva.example/x"),
        ("http://x.org/%C3%89", "http://x.org/é"),
    ]
    assert values(spark, urls.normalize, [a for a, _ in alike]) == values(spark, urls.normalize, [b for _, b in alike])
    got = values(spark, urls.normalize, ["https://www.youtube.com/watch?v=a%42%2f", "http://x.org/a%2Fb", "http://x.org/a/b", "http://x.org/100%"])
    assert got == ["http://youtube.com/watch?v=aB%2F", "http://x.org/a%2Fb", "http://x.org/a/b", "http://x.org/100%"]
    assert values(spark, urls.normalize, got) == got
    assert values(spark, domains.canonical_domain, ["http://www.пример.рф/x", "http://a.xn--e1afmkfd.xn--p1ai", "http://sub.münchen.co.uk"]) == ["xn--e1afmkfd.xn--p1ai"] * 2 + ["xn--mnchen-3ya.co.uk"]
