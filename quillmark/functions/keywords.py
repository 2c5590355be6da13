"""Keyword rules over a lexicon of any size, without a pattern for each keyword and row.

A text is split into distinct words once; only keywords whose first word occurs
are looked at, and only phrases and keywords beyond ASCII go to a pattern.  A
small lexicon is written into the plan (``keyword_hits``); a large one is a table
that words are joined with (``table_hits``).  Both find the same.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import keyword_pattern

HIT = "struct<category:int,place:int,keyword:string,weight:double,pattern:string>"


def _entry(category: int, place: int, keyword: str) -> Column:
    whole = keyword.isascii() and re.fullmatch(r"\w+", keyword)
    pattern = F.lit(None) if whole else F.lit(keyword_pattern(keyword))
    values = [F.lit(category).alias("category"), F.lit(place).alias("place"), F.lit(keyword).alias("keyword"), F.lit(1 + 0.5 * (len(keyword.split()) - 1)).alias("weight"), pattern.cast("string").alias("pattern")]
    return F.struct(*values)


def keyword_hits(c: Column, lexicon: dict[str, list[str]]) -> Column:
    """The keywords that occur: (category, place, keyword, weight, pattern), in the order of the lexicon; categories by number.

    ASCII keywords match whole words, others the start of a word.  A keyword
    weighs 1, and half more for each further word.  Null texts have none.
    """
    by_word: dict[str, list[Column]] = {}
    others = []
    for i, keywords in enumerate(lexicon.values()):
        for place, keyword in enumerate(keywords):
            words = re.findall(r"\w+", keyword.lower())
            if keyword.isascii() and words and keyword[0].isalnum():
                by_word.setdefault(words[0], []).append(_entry(i, place, keyword))
            else:
                others.append(_entry(i, place, keyword))
    text = F.coalesce(c, F.lit(""))
    met = lambda e: e["pattern"].isNull() | F.regexp_like(text, e["pattern"])
    none = F.array().cast(f"array<{HIT}>")
    found = none
    if by_word:
        known = F.create_map(*[x for word, entries in by_word.items() for x in (F.lit(word), F.array(*entries))])
        words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))
        starts = F.array_intersect(words, F.array(*map(F.lit, by_word)))
        found = F.filter(F.flatten(F.transform(starts, lambda w: F.element_at(known, w))), met)
    if others:
        beyond = F.filter(F.array(*others), met)
        if not any(e.isascii() and not e[0].isalnum() for ks in lexicon.values() for e in ks):
            beyond = F.when(text.rlike(r"[^\x00-\x7F]"), beyond)
        found = F.concat(found, F.coalesce(beyond, none))
    return F.array_sort(found)


LEXICON = "category int, place int, keyword string, weight double, pattern string, first string, starts boolean"
#: A lexicon of at most so many keywords is broadcast; a larger one is shuffled.
BROADCAST_KEYWORDS = 200_000


def lexicon_table(spark: SparkSession, lexicon: dict[str, list[str]]) -> DataFrame:
    """The lexicon as rows: what ``keyword_hits`` tells of a keyword, the word or two neighbouring words to find it by, and whether words that only start so do."""
    rows = []
    for i, keywords in enumerate(lexicon.values()):
        for place, keyword in enumerate(keywords):
            low = keyword.lower()
            runs = list(re.finditer(r"\w+", low))
            open_ = not low.isascii() and bool(runs) and runs[-1].end() == len(low)  # its last word may go on
            exact = runs[:-1] if open_ else runs
            first = " ".join(m[0] for m in exact[:2]) or (runs[0][0] if runs else "")
            starts = open_ and not exact
            whole = low.isascii() and first == low and len(runs) == 1
            rows.append((i, place, keyword, 1 + 0.5 * (len(keyword.split()) - 1), None if whole else keyword_pattern(keyword), first, starts))
    return spark.createDataFrame(rows, LEXICON)


def table_hits(docs: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``docs`` with ``hits`` as ``keyword_hits`` gives them, the lexicon being a table; ``key`` must be unique.

    Distinct words and pairs of neighbouring words are joined with those that
    keywords start with; words beyond ASCII also by their beginnings, as long as
    such keywords' are.  What was met is grouped back, and phrases and keywords
    beyond ASCII are confirmed in the text.
    """
    size, longest = lexicon.agg(F.count("*"), F.coalesce(F.max(F.when(F.col("starts"), F.length("first"))), F.lit(0))).first()
    side = F.broadcast(lexicon) if size <= BROADCAST_KEYWORDS else lexicon
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    pairs = lambda t: F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    run = F.array(F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    found = F.transform(run, lambda t: F.array_distinct(F.concat(F.array(F.lit("")), t, pairs(t))))[0]
    words = docs.select(F.col(key).alias("__key"), F.explode(found).alias("word"))
    beginnings = F.when(F.col("word").rlike(r"[^\x00-\x7F]") & (F.lit(longest) > 0), F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest))), lambda n: F.substring("word", F.lit(1), n))).otherwise(F.array("word"))
    parts = words.select("__key", "word", F.explode(F.array_union(F.array("word"), beginnings)).alias("first"))
    entry = F.struct("category", "place", "keyword", "weight", "pattern").cast(HIT)
    met = parts.join(side, "first").where((F.col("first") == F.col("word")) | F.col("starts")).groupBy("__key").agg(F.collect_set(entry).alias("__met"))
    both = docs.join(met, docs[key] == F.col("__key"), "left")
    said = F.coalesce(F.col(text), F.lit(""))
    confirmed = F.filter("__met", lambda e: e["pattern"].isNull() | F.regexp_like(said, e["pattern"]))
    return both.withColumn("hits", F.array_sort(F.coalesce(confirmed, F.array().cast(f"array<{HIT}>")))).drop("__key", "__met")


def rule_scores(hits: Column, categories: int) -> Column:
    """For each category its share of the weights of all hits; zeros if there are none."""
    weight = lambda kept: F.aggregate(kept, F.lit(0.0), lambda s, e: s + e["weight"])

    def shares(found: Column) -> Column:
        raw = F.transform(F.sequence(F.lit(0), F.lit(categories - 1)), lambda i: weight(F.filter(found, lambda e: e["category"] == i)))
        return F.transform(F.array(weight(found)), lambda total: F.transform(raw, lambda r: F.when(total == 0, 0.0).otherwise(r / total)))[0]

    return F.transform(F.array(hits), shares)[0]  # the search behind ``hits`` runs once


def _of(category: int):
    return lambda e: e["category"] == category


def hits_by_category(hits: Column, names: list[str]) -> Column:
    """Map from the categories that have hits to their keywords."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.transform(F.filter(hits, _of(k)), lambda e: e["keyword"]).alias("value")) for k, n in enumerate(names)])
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))
