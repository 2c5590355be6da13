from pyspark.sql import functions as F

from quillmark.functions import text, urls


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_clean_collapses_unicode_blanks(spark):
    assert one(spark, " a \t b \n", text.clean) == "a b"
    assert one(spark, None, text.clean) == ""


def test_keyword_at_the_start_of_a_devanagari_word(spark):
    hit = lambda s, k: one(spark, s, lambda c: c.rlike(text.keyword_pattern(k)))
    assert hit("नवी घरे", "घर") and not hit("नवघरे", "घर")
    assert hit("Best-loan offer", "loan") and not hit("loaned", "loan")


def test_tokens_split_at_vowel_signs(spark):
    assert one(spark, "नवी मुंबईत घरे", text.tokens) == ["नव", "बईत", "घर"]


def test_tracking_is_stripped(spark):
    assert one(spark, "http://a.b/c?utm_x=1&id=7&ref=q&refer=z#top", urls.strip_tracking) == "http://a.b/c?id=7&refer=z"
    assert one(spark, None, urls.strip_tracking) == ""


def test_domain_of_malformed_urls(spark):
    assert one(spark, "https://www.A.com:80/x", urls.domain) == "a.com:80"
    assert one(spark, "nonsense", urls.domain) == ""


def test_initials_and_lines(spark):
    assert one(spark, "acme widgets ltd", text.initials) == "AW"
    assert one(spark, "", text.initials) == "•"
    assert one(spark, " a \r\n\n b", text.lines) == ["a", "b"]
