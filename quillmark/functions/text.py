"""Text functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore without combining marks, as explicit classes that Java and RE2 read alike.
WORD_CHAR = r"[\p{L}\p{N}_]"


def clean(c: Column) -> Column:
    """White-space runs as one blank, none at the ends; null as empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}]+", " "), r"^ | $", "")


def clean_advertiser(c: Column) -> Column:
    """Without the suffix that search networks append."""
    return F.regexp_replace(clean(c), r"(?i)[\s\p{Z}]*\|[\s\p{Z}]*(search[\s\p{Z}]*ads?|sponsored).*$", "")


def ad_id(title: Column, advertiser: Column, domain: Column) -> Column:
    """Identity of an ad: 16 hex digits over its normalised title, advertiser and domain."""
    return F.substring(F.sha1(F.concat_ws("|", F.lower(clean(title)), F.lower(clean(advertiser)), F.coalesce(domain, F.lit("")))), 1, 16)


def domain_tokens(domain: Column, stop: tuple[str, ...] = ("www", "com", "in", "co", "net", "org")) -> Column:
    """Parts of a domain but for the usual ones; repeated parts stay."""
    return F.filter(F.split(F.lower(F.coalesce(domain, F.lit(""))), r"[.\-_/]+"), lambda t: ~t.isin(*stop) & (t != ""))


def advertiser_key(domain: Column, name: Column, networks: list[str]) -> Column:
    """Who advertises: the domain; on a search network or without a domain also the name."""
    bare = F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")
    who = F.regexp_replace(F.lower(clean(name)), r" ?\|.*$", "")
    return F.when(bare.isin(*networks) | (bare == ""), F.concat(bare, F.lit(":"), who)).otherwise(bare)


def build_text(title: Column, description: Column, advertiser: Column, domain: Column) -> Column:
    """The text that the classifier reads."""
    parts = F.array(*[F.coalesce(c, F.lit("")) for c in (title, description, advertiser)], F.array_join(domain_tokens(domain), " "))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")


def initials(c: Column) -> Column:
    """First letters of the first two words in capitals, a bullet if there are none."""
    words = F.slice(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0), 1, 2)
    found = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(found == "", F.lit("•")).otherwise(found)


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def tokens(c: Column) -> Column:
    """Words of two characters or more; apostrophes and ® may stand inside."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"{WORD_CHAR}[\p{{L}}\p{{N}}_'®]*{WORD_CHAR}"), 0)


def trigrams(c: Column) -> Column:
    """All sequences of three characters; shorter texts have none."""
    # taken out of single characters, since finding a place in a long text takes as long as the text before it
    three = lambda t: F.when(F.size(t) >= 3, F.transform(F.sequence(F.lit(0), F.size(t) - 3), lambda i: F.concat(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(F.split(c, "")), three)[0]


def word_grams(c: Column) -> Column:
    """Words, and pairs of neighbouring words with a blank between them."""
    pairs = lambda t: F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(tokens(c)), lambda t: F.concat(t, pairs(t)))[0]


def char_grams(c: Column, low: int = 2, high: int = 5) -> Column:
    """Sequences of ``low`` to ``high`` characters inside the words, each word with a blank before and behind it."""
    words = F.filter(F.split(clean(F.lower(c)), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    of_size = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))
    return F.flatten(F.transform(padded, lambda w: F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))), lambda n: of_size(w, n)))))


def marked_terms(terms: Column) -> Column:
    """(term, first): the terms sorted, the first of each marked, so that rows with a term are counted without grouping by row."""
    marked = lambda s: F.transform(s, lambda t, i: F.struct(t.alias("term"), ((i == 0) | (t != F.get(s, i - 1))).alias("first")))
    return F.transform(F.array(F.array_sort(terms)), marked)[0]


#: What ``\\d``, ``\\s`` and ``\\w`` stand for in any script, as parts of a class.
_CLASSES = {"d": r"\p{Nd}", "s": r"\s\x1c-\x1f\x85\p{Z}", "w": WORD_CHAR[1:-1]}


def unicode_pattern(pattern: str) -> str:
    """A pattern whose digits, blanks, words and word edges are those of all scripts; combining marks are no word characters."""

    def read(m: re.Match) -> str:
        code = m[1] or m[2]
        if code == "b":
            return f"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"
        return _CLASSES[code] if m[1] else f"[{_CLASSES[code]}]"

    def bare(m: re.Match) -> str:  # a class as a whole, or one character outside
        return re.sub(r"\\([dsw])", read, m[0]) if m[0].startswith("[") else re.sub(r"()\\([bdsw])", read, m[0])

    return re.sub(r"\[(?:\\.|[^\]\\])*\]|\\.|[^\[\\]", bare, pattern)


def cue_count(c: Column, patterns: list[str], by_line: bool = False) -> Column:
    """How many of the patterns occur; ``^`` and ``$`` stand for the ends of lines if ``by_line``."""
    return sum((c.rlike(("(?md)" if by_line else "") + unicode_pattern(p)).cast("int") for p in patterns), F.lit(0))


def keyword_pattern(keyword: str) -> str:
    """ASCII keywords match whole words, others the start of a word."""
    edge = rf"[^{WORD_CHAR[1:-1]}]"
    quoted = "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in keyword.lower())
    return rf"(?iu)(?:^|{edge}){quoted}" + (rf"(?:$|{edge})" if keyword.isascii() else "")


def is_junk(title: Column, domain: Column, generic: tuple[str, ...]) -> Column:
    t = F.lower(clean(title))
    return (t == "") | t.isin(*generic) | (t == F.lower(F.coalesce(domain, F.lit("")))) | (F.length(t) < 4)


def name_in_domain(name: Column, domain: Column) -> Column:
    """Whether a name, reduced to a-z and 0-9, is part of the domain so reduced; an empty name isn't."""
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    return (bare(name) != "") & F.contains(bare(domain), bare(name))


def character_counts(c: Column) -> list[Column]:
    """Letters, digits, and the signs of money and shares."""
    body = F.coalesce(c, F.lit(""))
    return [F.regexp_count(body, F.lit(p)).alias(n) for n, p in (("letters", r"\p{L}"), ("digits", r"\p{Nd}"), ("signs", "[₹%]"))]


def readable(c: Column, confidence: Column) -> Column:
    """A read line worth keeping: confident, with words or long numbers, and little else."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), " ", "")
    letters, digits, signs = character_counts(body)
    return (confidence >= 0.3) & ((letters >= 2) | (digits >= 6)) & (letters + digits + signs >= 0.6 * F.greatest(F.length(body), F.lit(1)))


def snapshot_key(section: Column) -> Column:
    """A section's path as one word; ``home`` for the front page."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.coalesce(section, F.lit("")), "^/+|/+$", ""), "/", "-"), F.lit("")), F.lit("home"))
