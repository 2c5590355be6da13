"""I-Match fingerprints of documents.

The lexicon holds the terms whose document frequency lies in a band.  It is cut
into randomised subsets; a text's fingerprint hashes, for each subset, the
sorted distinct terms of the text in it.  Edits that miss a subset's terms
leave its hash as it was, so two texts are alike in the share of equal hashes.

How thin a subset is follows the text: one with n terms in the lexicon keeps a
share of 2**-floor(log2(n)) of each subset, so that a hash covers one or two
terms whatever the length; the next thinner share is hashed too, for texts
whose n lies just beyond a power of two.

DataFrame functions only.  The band starts at a share of the documents, so the
lexicon has at most (mean distinct terms) / share entries at any corpus size;
beyond ``broadcast_terms`` it is joined by shuffling instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.store import materialize

SEPARATORS = r"[^\p{L}\p{N}]+"
SUBSETS = 16
DEEPEST = 14


@dataclass(frozen=True)
class Band:
    """Terms in at least max(2, ``low`` of the documents) and at most ``high`` of them (2 at least)."""

    low: float = 0.002
    high: float = 0.1
    broadcast_terms: int = 200_000


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != ""))


def lexicon(texts: DataFrame, band: Band = Band()) -> DataFrame:
    """The terms of the band, as ``term``."""
    n = texts.count()
    counted = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.where((F.col("df") >= F.lit(max(2.0, band.low * n))) & (F.col("df") <= F.lit(max(2.0, band.high * n)))).select("term")


def draws(term: Column) -> Column:
    """For each subset 16 random bits of the term, as a number; they follow from the term, so no row carries them."""
    bits = F.concat(F.md5(F.concat(F.lit("a"), term)), F.md5(F.concat(F.lit("b"), term)))
    return _bind(bits, lambda b: F.array(*[F.conv(F.substring(b, 4 * k + 1, 4), 16, 10).cast("int") for k in range(SUBSETS)]))


def _bind(value: Column, use):
    """``use(value)`` with the value computed once: as the only element of an array that is transformed."""
    return F.transform(F.array(value), use)[0]


def _hashes(entries: Column) -> Column:
    """For each subset the hash of its terms, ``-`` for none; entries are (draw, subset, term) in the order of terms."""

    def one(k: Column) -> Column:
        own = F.transform(F.filter(entries, lambda e: e["subset"] == k), lambda e: e["term"])
        return _bind(F.array_join(own, " "), lambda joined: F.when(joined == "", "-").otherwise(F.substring(F.md5(joined), 1, 8)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one), ".")


def _write(s: Column) -> Column:
    """The fingerprint of (found, level, limit)."""

    def below(t: Column) -> Column:
        entries = F.transform(draws(t["term"]), lambda d, k: F.struct(d.alias("draw"), k.alias("subset"), t["term"].alias("term")))
        return F.filter(entries, lambda e: e["draw"] < s["limit"])

    def both(entries: Column) -> Column:
        thinner = F.filter(entries, lambda e: e["draw"] * 2 < s["limit"])
        return F.concat_ws(";", s["level"].cast("string"), _hashes(entries), _bind(thinner, _hashes))

    # most terms are in none of the thinned subsets: their least draw tells
    some = F.filter(s["found"], lambda t: t["least"] < s["limit"])
    return _bind(F.flatten(F.transform(some, below)), both)


def _fingerprint(found: Column, everything: Column) -> Column:
    """``level;hashes;hashes one level thinner``, or the hash of all terms where the lexicon has none of them.

    ``found`` has (term, least draw) of the text's lexicon terms, sorted.
    """

    def levelled(f: Column) -> Column:
        level = F.least(F.lit(DEEPEST), F.floor(F.log2(F.size(f) + F.lit(0.5))).cast("int"))
        return _bind(F.struct(f.alias("found"), level.alias("level")), limited)

    def limited(s: Column) -> Column:
        limit = F.pow(F.lit(2.0), F.lit(16) - s["level"]).cast("int")
        return _bind(F.struct(s["found"].alias("found"), s["level"].alias("level"), limit.alias("limit")), _write)

    return _bind(found, lambda f: F.when(F.size(f) == 0, F.concat(F.lit("terms;"), everything)).otherwise(levelled(f)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets that either text has terms in, at the thinner text's level."""
    x, y = F.split(a, ";"), F.split(b, ";")
    of = lambda p: F.try_element_at(p, F.lit(1)).try_cast("int")
    top = F.greatest(of(x), of(y))
    pick = lambda p: F.split(F.when(of(p) == top, F.try_element_at(p, F.lit(2))).otherwise(F.try_element_at(p, F.lit(3))), r"\.")
    pairs = F.filter(F.arrays_zip(pick(x).alias("p"), pick(y).alias("q")), lambda e: (e["p"] != "-") | (e["q"] != "-"))
    share = F.transform(F.array(pairs), lambda e: F.when(F.size(e) == 0, 0.0).otherwise(F.size(F.filter(e, lambda h: h["p"] == h["q"])) / F.greatest(F.size(e), F.lit(1))))[0]
    comparable = of(x).isNotNull() & of(y).isNotNull() & (F.abs(of(x) - of(y)) <= 1)
    return F.when(a == b, 1.0).when(comparable, share).otherwise(0.0)


def fingerprints(texts: DataFrame, keys: list[str], columns: dict[str, str], words: DataFrame, broadcast: bool) -> DataFrame:
    """``keys`` and, for each text column, its SHA-256 and a fingerprint; ``columns`` maps text columns to the names of their fingerprints.

    ``keys`` must tell rows apart.
    """
    names = list(columns)
    # a text's terms and, as entries more, the hash of all of them and the text's digest: computed once, before rows are multiplied
    digests = F.array(*[F.struct(F.lit(2 * len(names) + i).alias("of"), F.sha2(c, 256).alias("term")) for i, c in enumerate(names)])
    each = F.concat(*[_bind(terms(F.col(c)), _entries(i, len(names))) for i, c in enumerate(names)], digests)
    rows = texts.select(*keys, F.explode(each).alias("e")).select(*keys, "e.of", "e.term")
    known = words.select("term", F.array_min(draws(F.col("term"))).alias("least"))
    joined = rows.join(F.broadcast(known) if broadcast else known, "term", "left").where(F.col("least").isNotNull() | (F.col("of") >= len(names)))
    found = [F.sort_array(F.collect_list(F.when(F.col("of") == i, F.struct("term", "least")))).alias(f"found_{i}") for i in range(len(names))]
    whole = [F.max(F.when(F.col("of") == len(names) + i, F.col("term"))).alias(f"all_{i}") for i in range(len(names))]
    sums = [F.max(F.when(F.col("of") == 2 * len(names) + i, F.col("term"))).alias(f"{c}_sha256") for i, c in enumerate(names)]
    grouped = joined.groupBy(*keys).agg(*whole, *sums, *found)
    return grouped.select(*keys, *[f"{c}_sha256" for c in names], *[_fingerprint(F.col(f"found_{i}"), F.col(f"all_{i}")).alias(columns[c]) for i, c in enumerate(names)])


def _entries(i: int, columns: int):
    """From the terms found in text column ``i`` to (of, term) of each, and of the hash of all of them."""

    def entries(found: Column) -> Column:
        everything = F.struct(F.lit(columns + i).alias("of"), F.md5(F.array_join(F.sort_array(found), " ")).alias("term"))
        return F.concat(F.transform(found, lambda t: F.struct(F.lit(i).alias("of"), t.alias("term"))), F.array(everything))

    return entries


def with_next(rows: DataFrame, buckets: int) -> DataFrame:
    """(rk, next_rk, doc_id, n_chars, n) in ascending (doc_id, rk), the last followed by the first.

    Rows are range-partitioned; the followers across partitions come from a
    table of one row for each partition.
    """
    ranged = materialize(rows.repartitionByRange(buckets, "doc_id", "rk").withColumn("bucket", F.spark_partition_id()), "ordered")
    inside = ranged.withColumn("next_rk", F.expr("lead(rk) over (partition by bucket order by doc_id, rk)"))
    firsts = ranged.groupBy("bucket").agg(F.min_by("rk", F.struct(F.col("doc_id").isNotNull(), "doc_id", "rk")).alias("first_rk"))
    follow = firsts.select("bucket", F.expr("coalesce(lead(first_rk) over (order by bucket), first_value(first_rk) over (order by bucket))").alias("after"))
    return inside.join(F.broadcast(follow), "bucket").select("rk", F.coalesce("next_rk", "after").alias("next_rk"), "doc_id", "n_chars", "n")


def edited_fingerprints(docs: DataFrame, band: Band = Band(), rows_per_bucket: int = 4096, most_buckets: int = 4000) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text), of its edited text, and their likeness.

    The edited text has the last quarter of the code points replaced by the
    first as many of the next document in ascending (doc_id, content).  Null
    texts count as empty; a text without terms has the fingerprint of no terms.
    Rows that are equal throughout follow one another.  Rows without an id come
    first.  Further columns are ignored; no rows give no rows.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), body)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), key.alias("rk"))
    unique = materialize(texts.select("doc_id", "rk", F.length("text").cast("long").alias("n_chars")).groupBy("doc_id", "rk", "n_chars").agg(F.count("*").alias("n")), "rows")
    total = unique.count()
    if unique.where("n > 1").limit(1).count():  # rows that are repeated throughout
        texts = texts.dropDuplicates(["rk"])
    words = materialize(lexicon(docs.select(body.alias("text")), band), "lexicon")
    small = words.count() <= band.broadcast_terms
    order = with_next(unique, max(1, min(most_buckets, total // rows_per_bucket)))
    own = ["rk", "next_rk", "doc_id", "n_chars"]
    links = order.select(*own, F.lit(1).cast("long").alias("copies")).union(order.where("n > 1").select("rk", F.col("rk").alias("next_rk"), "doc_id", "n_chars", F.col("n") - 1))
    links = materialize(links.groupBy(*own).agg(F.sum("copies").alias("copies")), "followers")
    # one exchange of the texts serves both joins: first a text sends its head to the row before it, then it meets the head
    # of the row after it; terms are grouped where the texts lie, without another exchange
    bodies = texts.select("rk", "text")
    before = links.select(F.col("rk").alias("before_rk"), F.col("next_rk").alias("rk"), "doc_id", "n_chars", "copies")
    heads = bodies.join(before, "rk").select(F.col("before_rk").alias("rk"), F.col("rk").alias("next_rk"), "doc_id", "n_chars", "copies", F.expr("substring(text, 1, cast(n_chars div 4 as int))").alias("head"))
    pairs = bodies.join(heads, "rk").withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"), "head"))
    prints = fingerprints(pairs, [*own, "copies"], {"text": "fingerprint", "edited": "edited_fingerprint"}, words, small)
    prints = materialize(prints, "fingerprints")
    following = prints.select(F.col("rk").alias("next_rk"), F.col("fingerprint").alias("next_fingerprint")).dropDuplicates(["next_rk"])
    out = prints.join(following, "next_rk").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")
