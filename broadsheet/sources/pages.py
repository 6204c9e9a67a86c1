"""Tables of pages: from responses, Parquet, CSV and text, and back to CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.sources import charsets

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "language", "publish_date", "title")])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Pages; a query that needs no html reads none."""
    return spark.read.parquet(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header of what pages are known to hold."""
    return spark.read.csv(path, schema=TRUTH, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, quotes doubled."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files by lines."""
    return spark.read.text(path)


def header(headers: Column, name: str) -> Column:
    """The value of a header, whatever letters its name is written in; null without one."""
    return F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"]


#: RFC 8288: a target, its parameters, and the name and value of a parameter, which may be quoted and then hold anything.
_PARAMETER = r"\s*;\s*[^\s=;,\"]+(?:\s*=\s*(?:\"(?:[^\"\\]|\\.)*+\"|[^\s;,\"]*+))?"
_LINK = rf"<([^>]*+)>((?:{_PARAMETER})*+)"
_PARTS = r";\s*([^\s=;,\"]+)(?:\s*=\s*(?:\"((?:[^\"\\]|\\.)*+)\"|([^\s;,\"]*+)))?"


def links(value: Column) -> Column:
    """The links of a Link header: url, the relations it is of, in small letters, and all its parameters by name.

    Of parameters of one name the first counts. An empty array for null and for what is no link.
    """

    def link(url: Column, parameters: Column) -> Column:
        get = lambda i: F.regexp_extract_all(parameters, F.lit(_PARTS), i)
        plain = F.transform(get(2), lambda quoted: F.regexp_replace(quoted, r"\\(.)", "$1"))
        pairs = F.zip_with(F.transform(get(1), F.lower), F.zip_with(plain, get(3), lambda a, b: F.concat(a, b)), lambda n, v: F.struct(n.alias("name"), v.alias("value")))
        first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["name"] == p["name"]))
        relations = F.get(F.filter(first, lambda p: p["name"] == "rel"), F.lit(0))["value"]
        return F.struct(url.alias("url"), F.filter(F.split(F.lower(F.coalesce(relations, F.lit(""))), r"\s+"), lambda r: r != "").alias("rel"), F.map_from_entries(first).alias("parameters"))

    each = lambda i: F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(_LINK), i)
    return F.zip_with(each(1), each(2), link)


def linked(value: Column, relation: str) -> Column:
    """The first target of a relation in a Link header; null without one."""
    return F.get(F.filter(links(value), lambda link: F.array_contains(link["rel"], relation.lower())), F.lit(0))["url"]


def fetched_raw(responses: DataFrame, status: str = "status", headers: str = "headers", body: str = "body", final: str | None = None, url: str = "url") -> DataFrame:
    """Responses that are pages, from nothing but what a server sent: with html, charset, and final_url.

    Kept are those of status 200 whose content type is html or is not told. The charset is that of the
    content type if it is UTF-8, and otherwise found in the bytes. final_url: of an archived page the
    original, which its Link header names; else `final`, where redirects led; else the URL as asked for.
    Headers' names may be written in any letters. A null body has neither html nor charset.
    """
    kind = header(F.col(headers), "content-type")
    # the charset is a parameter of the content type, perhaps in quotes
    declared = F.nullif(F.regexp_extract(kind, r"(?i);\s*charset\s*=\s*[\"']?([^\s;\"']+)", 1), F.lit(""))
    page = (F.col(status) == 200) & F.coalesce(F.contains(F.lower(kind), F.lit("text/html")), F.lit(True))
    archived = header(F.col(headers), "memento-datetime").isNotNull()
    original = F.when(archived, linked(header(F.col(headers), "link"), "original"))
    told = F.coalesce(original, F.col(final) if final else F.lit(None).cast("string"), F.col(url))
    out = responses.filter(page).withColumn("decoded_", charsets.decode(F.col(body), declared)).withColumn("final_url", told)
    return out.withColumn("html", F.col("decoded_.html")).withColumn("charset", F.col("decoded_.charset")).drop("decoded_")


def fetched(responses: DataFrame, status: str = "status", headers: str = "headers", body: str = "body", charset: str = "charset") -> DataFrame:
    """Responses that are pages, with their html decoded by a charset that is given for each; see fetched_raw() for others.

    Kept are those of status 200 whose content type is html or is not told. Bytes are decoded by the
    given charset, or as UTF-8.
    """
    kind = F.try_element_at(headers, F.lit("content-type"))
    known = F.upper(charset).isin("UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "ISO-8859-1", "US-ASCII")
    html = F.when(known & (F.upper(charset) != "UTF-8"), _decoded(F.col(body), F.col(charset))).otherwise(F.col(body).cast("string"))
    return responses.filter((F.col(status) == 200) & F.coalesce(F.contains(F.lower(kind), F.lit("text/html")), F.lit(True))).withColumn("html", html)


def _decoded(body: Column, charset: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in ("UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "ISO-8859-1", "US-ASCII"):
        out = F.when(F.upper(charset) == name, F.decode(body, name)).otherwise(out)
    return out


def final_url(headers: Column, original: Column, response: Column, url: Column) -> Column:
    """Where a page was: an archived one's original, else where redirects led, else as asked for."""
    return F.coalesce(F.when(F.map_contains_key(headers, F.lit("memento-datetime")), original), response, url)


def cache_name(url: Column) -> Column:
    """The file that a cached page is kept in."""
    return F.concat(F.lit("cached-"), F.regexp_replace(F.replace(url, F.lit('"'), F.lit("")), r"[^\p{L}\p{N}_]+", ""))
