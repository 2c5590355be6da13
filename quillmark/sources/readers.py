"""Sources of raw ads: tables, CSV, JSON, crawled pages; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINING = "title string, description string, advertiser string, domain string, category string, source string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, all columns text, quoted line breaks allowed."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(TRAINING).csv(path)


def ads_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def section_urls(sections: Column, base: str) -> Column:
    return F.when(sections.startswith("http"), sections).otherwise(F.concat(F.lit(base), sections))


def links(html: Column, most: int = 5) -> Column:
    """Targets of the first links of a page."""
    return F.slice(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'<a [^>]*href="([^"]*)"'), 1), 1, most)


def cards(pages: DataFrame) -> DataFrame:
    """One row for each ad block of a page: its place, text and whether it is marked as one."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<div class="ad">([^<]*)</div>'), 1)
    return pages.select("page_id", F.posexplode(found).alias("place", "title"))


def data_url(c: Column, most: int | None = None) -> Column:
    """The bytes of a base64 data URL; null if it isn't one or has more than ``most`` bytes."""
    held = F.try_to_binary(F.try_element_at(F.split(c, ",", 2), F.lit(2)), F.lit("base64"))
    if most is None:
        return held
    # four characters hold three bytes: a longer one isn't decoded
    return F.transform(F.array(F.when(F.length(c) <= 4 * (most + 3) / 3 + 200, held)), lambda b: F.when(F.octet_length(b) <= most, b))[0]


def write_report(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_library(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
