"""URL functions on columns; none throws on a malformed address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = ["utm_", "fbclid", "gclid", "ref$"]
#: What keys of ad networks start with; a ``$`` ends the key.
AD_TRACKING = ["utm_", "tbl", "taboola", "gclid", "fbclid", "dclid", "msclkid", "clickid", "click_id", "campaign", "site", "platform", "thumbnail", "title", "cpc", "pubid", "adid", "ad_id", "creative", "placement", "network", "source", "ref$"]


def domain(url: Column) -> Column:
    """Lower-case authority without ``www.``; port and user stay; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def with_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))


def strip_tracking(url: Column, prefixes: list[str] = TRACKING) -> Column:
    """Without tracking parameters and fragment; the others keep order and spelling.

    A prefix that ends in ``$`` must be the whole key.
    """
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pattern = "(?i)^(" + "|".join(p[:-1] + "(=|$)" if p.endswith("$") else p for p in prefixes) + ")"
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(pattern)), "&")
    path = F.regexp_replace(bare, r"\?.*$", "")
    return F.when(kept == "", path).otherwise(F.concat(path, F.lit("?"), kept))


def parameter(url: Column, names: list[str]) -> Column:
    """The first of these query parameters that there is, decoded; null if there is none."""
    found = [F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{n}=([^&#]*)", 1), F.lit("")) for n in names]
    return F.try_url_decode(F.coalesce(*found))


def landing_page(url: Column, prefixes: list[str] = AD_TRACKING) -> Column:
    """The page that a URL leads to: no tracking keys, no fragment; keys and values are decoded, compared and encoded anew."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pattern = "(?i)^(" + "|".join(p[:-1] + "$" if p.endswith("$") else p for p in prefixes) + ")"
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: p != "")
    split = F.transform(pairs, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    kept = F.array_join(F.transform(F.filter(split, lambda e: ~e["k"].rlike(pattern)), lambda e: F.concat(coded(e["k"]), F.lit("="), coded(e["v"]))), "&")
    path = F.regexp_replace(bare, r"\?.*$", "")
    return F.when(kept == "", path).otherwise(F.concat(path, F.lit("?"), kept))


def click_target(url: Column, names: tuple[str, ...] = ("adurl", "url", "dest")) -> Column:
    """Where a click URL leads: the first of these parameters that is an http address, or the URL itself."""
    query = F.concat(F.lit("?"), F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""), r"\?(.*)$", 1))
    found = [F.try_url_decode(F.nullif(F.regexp_extract(query, rf"[?&]{n}=([^&]+)", 1), F.lit(""))) for n in names]
    return F.coalesce(*[F.when(f.startswith("http"), f) for f in found], url)
