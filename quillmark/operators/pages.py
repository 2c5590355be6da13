"""Text read on pages: readable lines, headline and description, clusters of lines, evidence; and a vision model's responses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text

#: Signs of advertisements and of news in a text, and in scanned classified pages.
AD_CUES = [
    r"\b\d{10}\b", r"\b\d{5}\s?\d{5}\b", r"\b1800[\s-]?\d{3}", r"(?:www\.|https?://|\.com\b|\.in\b|\.org\b)", r"@\w",
    r"₹\s?\d", r"\brs\.?\s?\d", r"\b\d+\s?%\s?(?:off|सूट|सवलत)", r"\b(?:offer|sale|discount|book now|call|contact|visit|apply|admissions?|enrol|register|toll[- ]free|helpline|limited period|emi|interest|scheme|launch)\b",
    r"(?:संपर्क|सवलत|ऑफर|बुकिंग|नोंदणी|प्रवेश|योजना|व्याज|ठेव|आजच|फोन|कॉल|खरेदी|विक्री|उपलब्ध|मोफत|सेल)", r"(?:public notice|tender|e-auction|auction|notice is hereby|सूचना|निविदा|लिलाव|जाहीर)",
]
NEWS_CUES = [
    r"लोकमत न्यूज नेटवर्क", r"(?:प्रतिनिधी|वृत्तसंस्था|वार्ताहर)\s*[:/]", r"\b(?:pti|ani|ians)\b", r"^(?:new delhi|mumbai|pune|nagpur|kolkata|chennai|bengaluru|hyderabad|thiruvananthapuram|washington)\s*[:,]",
    r"\b(?:said|told reporters|according to|officials said|the minister)\b", r"(?:नवी दिल्ली|मुंबई|पुणे|नागपूर)\s*:", r"(?:म्हणाले|सांगितले|असे ते म्हणाले|यांनी सांगितले)",
]
CLASSIFIED = [
    r"\b\d{10}\b", r"\b\d{5}\s\d{5}\b", r"\bph[:\.]?\s*\d+", r"\bmob[:\.]?\s*\d+", r"contact\s*(us|at)?[:\.]?", r"\bwanted\b", r"\brequired\b", r"\bfor sale\b", r"\bto let\b", r"\brent\b", r"\bbhk\b", r"\boffers?\b",
    r"\bdiscount\b", r"\b₹\d+", r"rs\.?\s*\d+", r"\bwalk-in\b", r"\bvacancy\b", r"\bsituation vacant\b", r"\bmatrimonial\b", r"\bbride\b", r"\bgroom\b", r"\bname change\b", r"\bpublic notice\b", r"\btender\b",
    r"\badmission\b", r"\bapply now\b", r"\blakhs?\b", r"\bcrores?\b", r"www\.", r"\.com\b", "@",
]
REPORTING = [
    r"\b[a-z\s]+(correspondent|reporter)\b", r"\b(said|told|added|announced|according to)\b", r"\b(police|government|minister|chief minister|pm|president)\b", r"\bnew delhi[:\s]", r"\bmumbai[:\s]", r"\bpune[:\s]", r"\bnagpur[:\s]",
    r"\bpti\b", r"\bpress trust\b", r"\bnews network\b", r"\beditorial\b",
]


def is_ad(c: Column) -> Column:
    """Whether a read text is an advertisement rather than news; in doubt it is."""
    low = F.lower(F.coalesce(c, F.lit("")))
    counted = F.struct(text.cue_count(low, CLASSIFIED).alias("ads"), text.cue_count(low, REPORTING).alias("news"))
    return F.transform(F.array(counted), lambda n: ~(((n["news"] > n["ads"]) & (n["ads"] <= 1)) | ((n["news"] >= 3) & (n["ads"] <= 2))))[0]


def evidence(c: Column) -> Column:
    """(ads, news): how many signs of advertisements and of news a read block's text has."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.struct(text.cue_count(low, AD_CUES, by_line=True).alias("ads"), text.cue_count(low, NEWS_CUES, by_line=True).alias("news"))


def composed(lines: DataFrame, key: str) -> DataFrame:
    """For each block (key) of read lines (line, text, conf, x, y, h) its headline, description and full text; blocks without readable lines have empty ones.

    The headline is up to three lines of at least 75 % of the tallest, in bands
    of the tallest height; the rest follows in bands of half of it.
    """
    good = lines.where(text.readable(F.col("text"), F.col("conf")))
    by_size = Window.partitionBy(key).orderBy(F.desc("h"), "y", "line", "text")
    ranked = good.withColumns({"top": F.max("h").over(Window.partitionBy(key)), "rank": F.row_number().over(by_size)})
    head = (F.col("h") >= 0.75 * F.col("top")) & (F.col("rank") <= 3)
    band = F.when(head, F.bround(F.col("y") / F.greatest(F.lit(1.0), F.col("top")))).otherwise(F.bround(F.col("y") / F.greatest(F.lit(8.0), F.col("top") * 0.5)))
    marked = ranked.select(key, "text", "x", "y", "line", head.alias("head"), band.alias("band"))
    joined = lambda found: F.array_join(F.transform(F.array_sort(found), lambda e: e["text"]), " ")
    place = F.struct("band", "x", "line", "text")
    blocks = marked.groupBy(key).agg(joined(F.collect_list(F.when(F.col("head"), place))).alias("h"), joined(F.collect_list(F.when(~F.col("head"), place))).alias("d"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "line", "text"))), lambda e: e["text"]), "\n").alias("full_text"))
    texts = blocks.select(key, F.substring("h", 1, 160).alias("headline"), F.substring("d", 1, 600).alias("description"), "full_text")
    every = lines.select(key).distinct().join(texts, key, "left")
    return every.select(key, *[F.coalesce(c, F.lit("")).alias(c) for c in ("headline", "description", "full_text")])


def quality(lines: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """How surely each block was read, by length of text: confidence, and the share of readable lines."""
    size = F.length("text")
    kept = F.when(text.readable(F.col("text"), F.col("conf")), size).otherwise(0)
    whole = F.greatest(F.sum(size), F.lit(1))
    return lines.groupBy(key).agg(F.round(0.65 * F.sum(F.col("conf") * size) / whole + 0.35 * F.sum(kept) / whole, digits).alias("quality"))


def cluster_summary(lines: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """For each cluster of read lines (line, text, conf, x1, y1, x2, y2): headline, description, mean confidence and bounding box, from the top."""
    said = lines.where((F.col("conf") > 0.15) & (F.trim("text") != ""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(((F.col("y1") + F.col("y2")) / 2).alias("at"), "line", text.clean(F.col("text")).alias("text")))), lambda e: e["text"])
    found = said.groupBy(*keys).agg(ordered.alias("lines"), F.round(F.avg("conf"), digits).alias("confidence"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return found.select(*keys, F.get("lines", F.lit(0)).alias("headline"), F.array_join(F.slice("lines", 2, 10**6), " ").alias("description"), F.array_join("lines", "\n").alias("full_text"), "confidence", "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


def line_clusters(lines: DataFrame) -> DataFrame:
    """Read lines (page, line, x1, y1, x2, y2, height of the page) with the cluster of their page, from 0.

    From the top, a line joins the earliest cluster with a line close above it
    (centres within 2.5 times 2 % of the height, 30 pixels at least) that it
    overlaps or nearly overlaps sideways.  Lines without width open clusters of
    their own; rows without a page go.  A task holds the lines within reach alone.
    """
    wanted = T.StructType([*lines.schema.fields, T.StructField("cluster", T.IntegerType())])
    columns = lines.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, above, opened = None, [], 0
        for batch in batches:
            found = []
            for here, top, bottom, left, right, height in zip(*(batch[c].tolist() for c in ("page", "y1", "y2", "x1", "x2", "height")), strict=True):
                if here != page:
                    page, above, opened = here, [], 0
                middle, reach = (top + bottom) / 2, 2.5 * max(0.02 * height, 30)
                above = [line for line in above if line[0] >= middle - reach]  # rows come from the top
                joined = opened
                for _, a, b, cluster in above:
                    narrow = min(b - a, right - left)
                    if narrow > 0 and min(b, right) - max(a, left) > -0.3 * narrow:
                        joined = min(joined, cluster)
                opened += joined == opened
                above.append((middle, left, right, joined))
                found.append(joined)
            yield batch[columns].assign(cluster=found)

    dealt = lines.where("page is not null").repartition("page").sortWithinPartitions("page", (F.col("y1") + F.col("y2")) / 2, "line")
    return dealt.mapInPandas(run, wanted)


def reindexed(ads: DataFrame, page: str, *ties: str) -> DataFrame:
    """Ads numbered from 0 on each page, in bands of 40 pixels from the top, then from the left."""
    order = Window.partitionBy(page).orderBy(F.floor(F.col("y1") / 40), "x1", "y1", *ties)
    return ads.withColumn("ad_index", F.row_number().over(order) - 1)


RESPONSE = "refusal string, ads array<struct<box:array<double>,headline:string,description:string,advertiser:string,language:string,category:string,category_confidence:double,legibility:double,publisher_promotion:boolean>>"


def parsed_responses(responses: DataFrame, categories: list[str]) -> DataFrame:
    """Ads of a vision model's JSON responses (page, width, height, body), scaled from 0..1000 to the page and numbered.

    A body that isn't JSON or refuses has one row with ``error`` and no ad; ads
    with a category beyond the list, without four numbers or without area go.
    """
    read = responses.withColumn("r", F.from_json("body", RESPONSE))
    error = F.when(F.col("r").isNull() | (F.col("r.ads").isNull() & F.col("r.refusal").isNull()), "unreadable").when(F.col("r.refusal").isNotNull(), "refused")
    each = read.select("page", "width", "height", error.alias("error"), F.explode_outer(F.when(error.isNull(), F.col("r.ads"))).alias("ad"))
    at = lambda i: F.get("ad.box", F.lit(i))
    side = lambda i: F.when(at(i).isNotNull(), F.least(F.greatest(at(i), F.lit(0.0)), F.lit(1000.0)))
    scaled = lambda i, length: F.bround(side(i) * F.col(length) / 1000).cast("int")
    area = (side(2) > side(0)) & (side(3) > side(1))
    boxed = each.select("page", "error", "ad", area.alias("area"), scaled(0, "width").alias("x1"), scaled(1, "height").alias("y1"), scaled(2, "width").alias("x2"), scaled(3, "height").alias("y2"))
    valid = (F.size("ad.box") == 4) & F.col("area") & F.col("ad.category").isin(*categories)
    kept = boxed.where(F.col("error").isNotNull() | F.coalesce(valid, F.lit(False)))
    held = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    said = lambda c, n: F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, n)
    shown = kept.select(
        "page", "error", "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), said("ad.headline", 160).alias("headline"), said("ad.description", 600).alias("description"), said("ad.advertiser", 120).alias("advertiser"),
        F.col("ad.category").alias("category"), held("ad.category_confidence").alias("category_confidence"), F.round(held("ad.legibility"), 3).alias("quality"), F.coalesce("ad.publisher_promotion", F.lit(False)).alias("publisher_promotion"),
    )
    return reindexed(shown, "page")


def answer_key(files: DataFrame) -> DataFrame:
    """(page, ans, optional, box, category, label, also_ok) of answer keys in JSON (body)."""
    schema = "pages map<string,struct<ads:array<struct<box:array<int>,category:string,label:string,also_ok:array<string>>>,optional:array<struct<box:array<int>,label:string>>>>"
    pages = files.select(F.explode(F.from_json("body", schema)["pages"]).alias("page", "p"))
    ads = pages.select("page", F.posexplode("p.ads").alias("ans", "a")).select("page", "ans", F.lit(False).alias("optional"), "a.box", "a.category", "a.label", "a.also_ok")
    more = pages.select("page", F.posexplode("p.optional").alias("ans", "a")).select("page", "ans", F.lit(True).alias("optional"), "a.box", F.lit(None).cast("string").alias("category"), "a.label", F.lit(None).cast("array<string>").alias("also_ok"))
    return ads.unionByName(more)
