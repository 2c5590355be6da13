"""Filters, counts and rankings over the ad library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.session import scratch


def seen_between(ts: Column, first: str | None, last: str | None) -> Column:
    """From the first day to one second before the end of the last, both optional."""
    met = F.lit(True)
    if first:
        met = met & (ts >= F.lit(first).cast("timestamp_ntz"))
    if last:
        met = met & (ts < F.lit(f"{last} 23:59:59").cast("timestamp_ntz"))
    return met


def matches(columns: list[str], query: str) -> Column:
    """Substring search over several columns, blind to the case of A-Z alone; ``%`` and ``_`` of the query are wildcards, a backslash is itself."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = "%" + query.replace("\\", "\\\\").translate(str.maketrans(upper, lower)) + "%"
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.translate(c, upper, lower).like(pattern), F.lit(False))
    return found


def by_group(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, sum and mean for each group, largest first, ties by name."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"), F.round(F.avg(value), 2).alias("mean")).orderBy(F.desc("n"), key)


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"), F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(whole)).select(key, "n", F.round(F.col("n") / F.col("whole"), 6).alias("share"), F.round(F.col("n") / F.col("most"), 6).alias("share_of_most"))  # one row


def one_last(df: DataFrame, last: Column, order: list[Column]) -> DataFrame:
    """An ordering with the rows that meet ``last`` behind all others, each part in that order."""
    return df.orderBy(last, *order)


def strength(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "strong").when(confidence >= 0.5, "good").otherwise("possible")


def reading(quality: Column) -> Column:
    return F.when(quality >= 0.75, "Good").when(quality >= 0.5, "Partial").otherwise("Poor")


def preset_start(today: Column) -> dict[str, Column]:
    """The first day of each preset; all end today, which counts."""
    return {name: F.date_sub(today, days - 1) for name, days in (("today", 1), ("week", 7), ("month", 30))}


def fresh(at: Column, now: Column, seconds: int) -> Column:
    """Whether something is younger than so many seconds."""
    return F.coalesce(F.timestamp_diff("SECOND", at, now) < seconds, F.lit(False))


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 24) -> DataFrame:
    """One page of an ordering, the page number held within what there is; a top-k, not a sort of the whole."""
    pages = max(1, -(-df.count() // size))
    at = min(max(page, 1), pages)
    return df.orderBy(*order).offset((at - 1) * size).limit(size)


class Pages:
    """All pages of an ordering with a unique last key, each read from the few parts that hold it.

    Rows are dealt once into ranges of the ordering and written; how many each
    range has (``parts`` numbers) tells where a page lies, so the last page costs
    no more than the first.
    """

    def __init__(self, df: DataFrame, order: list[Column], size: int = 24, parts: int = 64):
        self.order, self.size, self.columns = order, size, df.columns
        path = scratch(df.sparkSession, "pages")
        df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(path)
        self.rows = df.sparkSession.read.schema(df.withColumn("__part", F.lit(0)).schema).parquet(path)
        self.counts = sorted((r["__part"], r["n"]) for r in self.rows.groupBy("__part").agg(F.count("*").alias("n")).collect())
        self.pages = max(1, -(-sum(n for _, n in self.counts) // size))

    def parts_of(self, page: int) -> tuple[list[int], int]:
        """The parts that hold a page, and how many of their rows come before it."""
        first = (min(max(page, 1), self.pages) - 1) * self.size
        held, before, at = [], 0, 0
        for part, n in self.counts:
            if at + n > first and at < first + self.size:
                held.append(part)
                before = before if len(held) > 1 else first - at
            at += n
        return held, before

    def page(self, page: int) -> DataFrame:
        """One page, its number held within what there is."""
        held, before = self.parts_of(page)
        return self.rows.where(F.col("__part").isin(held)).drop("__part").orderBy(*self.order).offset(before).limit(self.size)


def prediction_subset(told: DataFrame, *keys: str) -> DataFrame:
    """What a caller sees of an answer."""
    return told.select(*keys, "category", "confidence", "alternatives")


def has_image(url: Column) -> Column:
    return F.coalesce(url != "", F.lit(False))


def day_label(c: Column) -> Column:
    """An ISO time as ``02 Jan 2024``; empty if it isn't one."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "dd MMM yyyy"), F.lit(""))


def network_listing(advertiser: Column, domain: Column, networks: list[str]) -> Column:
    """Whether a search network advertises itself: its domain, and no name or the domain's own."""
    bare = F.regexp_replace(F.lower(text.clean_advertiser(advertiser)), "[^a-z0-9]", "")
    return F.coalesce(domain, F.lit("")).isin(*networks) & ((bare == "") | F.contains(F.replace(domain, F.lit("."), F.lit("")), bare))


def showcase(ads: DataFrame, last_category: str, most: int = 8) -> DataFrame:
    """The latest ad with an image of each category, those of ``last_category`` behind all others, ``most`` in all."""
    shown = ads.where(has_image(F.col("image_url")))
    others = [c for c in ads.columns if c not in ("category", "last_seen", "times_seen", "id")]
    best = shown.groupBy("category").agg(F.max_by(F.struct("id", "last_seen", "times_seen", *others), F.struct("last_seen", "times_seen", "id")).alias("top"))
    return best.select("category", "top.*").select(*ads.columns).orderBy(F.col("category") == last_category, F.desc("last_seen"), F.desc("times_seen"), "id").limit(most)


def scan_counters(ads: DataFrame) -> DataFrame:
    """One row: ads of a scan whose headline was read, whose category is good or better, and the others."""
    sure = F.coalesce(F.col("certainty") >= 0.5, F.lit(False))
    return ads.agg(F.count_if(F.length(text.clean(F.col("headline"))) > 2).alias("recognised"), F.count_if(sure).alias("categorised"), F.count_if(~sure).alias("uncertain"))


def latest_per(df: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each group in an ordering, by a grouped maximum rather than a sort."""
    return df.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("top")).select(key, *[F.col(f"top.{c}").alias(c) for c in columns])
