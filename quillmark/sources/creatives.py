"""From raw cards and frames of a page to ads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text, urls

#: Lines and titles that say nothing.
BOILERPLATE = ("ad", "ads by google", "why this ad?", "x", "i")
JUNK_TITLES = ("click here", "learn more", "read more", "ad", "ads", "sponsored", "advertisement", "adchoices")


def _first(a: Column, n: int = 1) -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(n)), F.lit(""))


def _or(c: Column, other: Column) -> Column:
    return F.when(c != "", c).otherwise(other)


def parsed_cards(cards: DataFrame, own_domain: str, network: str, now: Column) -> DataFrame:
    """Ads from cards (sponsored, title, description, advertiser, raw_text, landing_url, image_url, page_url).

    Cards that aren't sponsored, lead to the publisher or have no usable title
    go.  What a card lacks is taken from its raw lines: the first is the title,
    one like ``Brand|Sponsored`` names the advertiser, the second describes.
    """
    landing = urls.landing_page(F.col("landing_url"))
    lines = text.lines(F.col("raw_text"))
    branded = F.filter(F.col("lines"), lambda x: F.contains(x, F.lit("|")) & F.contains(F.lower(x), F.lit("sponsored")))
    second = _first(F.col("lines"), 2)
    brand = F.trim(F.substring_index(_first(branded), "|", 1))
    read = cards.withColumns({"landing": landing, "lines": lines})
    read = read.withColumn("host", urls.domain(F.col("landing"))).where(F.coalesce("sponsored", F.lit(False)) & ~F.endswith("host", F.lit(own_domain)))
    read = read.withColumns({
        "headline": _or(text.clean(F.col("title")), _first(F.col("lines"))),
        "brand": text.clean_advertiser(_or(text.clean(F.col("advertiser")), brand)),
        "about": _or(text.clean(F.col("description")), F.when(F.contains(F.lower(second), F.lit("sponsored")), "").otherwise(second)),
    })
    kept = read.where(~text.is_junk(F.col("headline"), F.col("host"), JUNK_TITLES))
    return kept.select(
        text.ad_id(F.col("headline"), F.col("brand"), F.col("host")).alias("id"), F.col("headline").alias("title"), F.col("about").alias("description"), F.col("brand").alias("advertiser"),
        F.col("landing").alias("landing_url"), F.col("host").alias("domain"), F.coalesce("image_url", F.lit("")).alias("image_url"), F.lit(network).alias("network"), F.col("page_url").alias("source_page"), now.alias("scraped_at"),
    )


def parsed_frames(frames: DataFrame, network: str, now: Column, not_in_domain: str = "google") -> DataFrame:
    """Ads from frames (text, links, alts, page_url): the first outward link, headline and up to three lines more."""
    targets = F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda u: urls.click_target(u))
    outward = F.filter(targets, lambda u: u.startswith("http") & ~F.contains(urls.domain(u), F.lit(not_in_domain)))
    lines = F.filter(text.lines(F.col("text")), lambda x: ~F.lower(x).isin(*BOILERPLATE))
    alts = F.coalesce("alts", F.array().cast("array<string>"))
    read = frames.withColumns({"targets": outward, "lines": lines, "alt": alts}).where((F.size("targets") > 0) | (F.size("lines") > 0))
    read = read.withColumn("landing", F.when(F.size("targets") > 0, urls.landing_page(_first(F.col("targets")))).otherwise("")).withColumn("host", urls.domain(F.col("landing")))
    read = read.withColumns({"headline": text.clean(_or(_first(F.col("lines")), F.when(F.size("lines") > 0, "").otherwise(_first(F.col("alt"))))), "about": text.clean(_or(F.array_join(F.slice("lines", 2, 3), " "), F.array_join("alt", " ")))})
    kept = read.where(~text.is_junk(F.col("headline"), F.col("host"), JUNK_TITLES))
    return kept.select(
        text.ad_id(F.col("headline"), F.lit(""), F.col("host")).alias("id"), F.col("headline").alias("title"), F.col("about").alias("description"), F.col("host").alias("advertiser"),
        F.col("landing").alias("landing_url"), F.col("host").alias("domain"), F.lit("").alias("image_url"), F.lit(network).alias("network"), F.col("page_url").alias("source_page"), now.alias("scraped_at"),
    )


def public_ads(library: DataFrame, networks: list[str]) -> DataFrame:
    """What customers see: the advertiser's name or else its domain, and links without tracking.

    A search network's link leads to a page of results and not to the
    advertiser, so its ads show neither domain nor link.
    """
    hidden = F.coalesce(F.col("domain").isin(*networks), F.lit(False))
    shown = lambda c: F.when(hidden, "").otherwise(c)
    name = _or(text.clean_advertiser(F.col("advertiser")), F.coalesce("domain", F.lit("")))
    return library.select("id", "title", "description", name.alias("advertiser"), shown(F.col("domain")).alias("domain"), shown(urls.landing_page(F.col("landing_url"))).alias("landing_url"), "category", "first_seen", "last_seen")


def report_rows(public: DataFrame) -> DataFrame:
    """The eight columns of the report, dates as days."""
    day = lambda c: F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, 10)
    names = {"category": "Category", "title": "Headline", "description": "Description", "advertiser": "Advertiser", "domain": "Website", "landing_url": "Link"}
    return public.select(*[F.col(c).alias(n) for c, n in names.items()], day("first_seen").alias("First seen"), day("last_seen").alias("Last seen"))


def write_report(rows: DataFrame, path: str) -> None:
    """CSV with a header behind a byte-order mark, in as many files as there are partitions, each with both."""
    first, *rest = rows.columns
    rows.withColumnRenamed(first, "﻿" + first).toDF("﻿" + first, *rest).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row, as ``body``."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("body"))
