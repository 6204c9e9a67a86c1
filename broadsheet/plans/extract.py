"""The record of a page: one projection over a table of pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import broadsheet
from broadsheet.functions import content, dates, domains, languages, linked_data, titles, urls

#: Fields that an override or a default may be given for.
OVERRIDES = ("canonical_domain", "publication_date", "text_content", "article_title", "language", "canonical_url")
DEFAULTS = ("publication_date", "article_title", "language")


def extract(
    pages: DataFrame,
    as_of: dt.datetime,
    url_col: str = "url",
    html_col: str = "html",
    final_url_col: str | None = None,
    overrides: Mapping[str, Column] | None = None,
    defaults: Mapping[str, Column] | None = None,
    other_metadata: bool = False,
    language_model: languages.Model | None = None,
    drop_failed: bool = False,
    errors: str = "status",
) -> DataFrame:
    """The columns of `pages` but the page itself, and the record of each page.

    An override replaces an extractor when the plan is built, so that its work is never in the plan; one
    that is null counts. A default stands in where nothing was found. A page whose text is too short or
    missing keeps its row, with extract_status saying so, unless `drop_failed`; with errors="raise" it fails
    the query instead.
    """
    given, fallback = dict(overrides or {}), dict(defaults or {})
    if unknown := [*(set(given) - set(OVERRIDES)), *(set(fallback) - set(DEFAULTS))]:
        raise ValueError(f"no override or default for {', '.join(sorted(unknown))}")
    page, url = F.col(html_col), F.col(final_url_col or url_col)
    keep = [c for c in pages.columns if c not in (html_col,)]

    def either(name: str, build: Callable[[], Column]) -> Column:
        """What is given, or what is built only if nothing is, or the default where that finds nothing."""
        if name in given:
            return given[name]
        return F.coalesce(build(), fallback[name]) if name in fallback else build()

    def read_language() -> Column:
        said = languages.from_tags(page)
        return languages.pick(said, languages.from_text(text, language_model)) if language_model else said

    def read_date() -> Column:
        return dates.publication_date(page, url, F.lit(dates.latest(as_of)).cast("timestamp_ntz"), linked=F.col("_linked.published"))

    # each in a projection of its own, so that what others build on is computed once
    df = pages.withColumn("normalized_url", urls.normalize(url))
    none = F.lit(None).cast("string")
    if "text_content" in given:
        # a text that is given is taken as it is, however short
        df = df.withColumn("_content", F.struct(given["text_content"].cast("string").alias("text"), F.lit(content.GIVEN).alias("method"), F.lit(content.OK).alias("status"), none.alias("title"), none.alias("image")))
    else:
        df = df.withColumn("_content", content.content(page, with_images=other_metadata))
    df = df.withColumn("_linked", linked_data.article(page))
    text = F.col("_content.text")
    df = df.withColumns({"_title": either("article_title", lambda: titles.from_html(page, F.coalesce("_content.title", "_linked.title"))), "_language": either("language", read_language)})
    fields = {
        "original_url": F.col(url_col),
        "final_url": url,
        "normalized_url": F.col("normalized_url"),
        "unique_url_hash": F.sha2("normalized_url", 256),
        "canonical_domain": either("canonical_domain", lambda: domains.canonical_domain(url, normal=F.col("normalized_url"))),
        "canonical_url": either("canonical_url", lambda: content.canonical_url(page)),
        "publication_date": either("publication_date", read_date).cast("timestamp_ntz"),
        "language": languages.short_code(F.col("_language")),
        "full_language": F.col("_language"),
        "text_extraction_method": F.col("_content.method"),
        "article_title": F.col("_title"),
        "normalized_article_title": titles.normalize_title(F.col("_title"), null_as_none=True),
        "text_content": text,
        "is_homepage": urls.is_homepage(F.col(url_col)),
        "is_shortened": urls.is_shortened(F.col(url_col)),
        "extract_status": F.col("_content.status"),
        "version": F.lit(broadsheet.__version__),
    }
    if other_metadata:
        meta_image = F.nullif(F.regexp_extract(page, r"(?is)<meta[^>]*property=.og:image.[^>]* content=[\"']([^\"']+)", 1), F.lit(""))
        fields["other"] = F.struct(
            F.coalesce("_content.title", titles.title_tag(page), "_linked.title").alias("raw_title"),
            dates.from_tags(page, F.col("_linked.published")).alias("raw_publish_date"),
            F.coalesce("_content.image", meta_image, "_linked.image").alias("top_image_url"),
            F.coalesce("_linked.authors", content.authors(F.regexp_extract(page, r"(?is)<meta[^>]*name=.author.[^>]* content=[\"']([^\"']+)", 1))).alias("authors"),
        )
    out = df.select(*(c for c in keep if c not in fields), *(v.alias(k) for k, v in fields.items()))
    if errors == "raise":
        failed = F.raise_error(F.concat(F.lit("no text in "), F.coalesce("original_url", F.lit("a page without a URL")), F.lit(": "), F.col("extract_status")))
        out = out.withColumn("extract_status", F.when(F.col("extract_status") == content.OK, F.col("extract_status")).otherwise(failed.cast("string")))
    return out.filter(F.col("extract_status") == content.OK) if drop_failed else out
