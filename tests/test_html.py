"""Cards and frames of pages, with nested and broken markup."""

import pytest
from pyspark.sql import functions as F

from quillmark.sources import creatives, html

CARD = """<html><head><title>not seen</title><script>var a = "<div class='videoCube trc_spotlight_item'>";</script></head><body>
<div class="other videoCube trc_spotlight_item syndicatedItem"><a class=x href='/click?utm_source=1&amp;id=7' title="t"><span style="background-image: url('https://img.in/a.jpg')"></span>
<img src="/later.png"></a><div class="item-label"><span class="video-title  big">Great &amp; good<br>offer</span></div><p class="my-description">Two
  lines<p>Brand<b> name</b>|Sponsored</p><span class="branding-inner">Brand</span></div>
<div class="videoCube trc_spotlight_item"><img SRC="pic.png"><div>Only <i>raw</i></div><ul><li>one<li>two</ul></div>
<div class="videoCube">no card</div>"""


def rows(spark, *pages):
    return spark.createDataFrame([(k, "https://news.example/a/b", p) for k, p in enumerate(pages)], "page_id long, url string, html string")


def test_cards_have_nested_parts(spark):
    first, second = sorted(html.cards(rows(spark, CARD)).collect(), key=lambda r: r.place)
    assert (first.sponsored, first.title, first.description, first.advertiser) == (True, "Great & good\noffer", "Two lines", "Brand")
    assert (first.landing_url, first.image_url) == ("https://news.example/click?utm_source=1&id=7", "https://img.in/a.jpg")
    assert first.raw_text.splitlines() == ["Great & good", "offer", "Two lines", "Brand name|Sponsored", "Brand"]
    assert (second.sponsored, second.title, second.landing_url, second.image_url) == (False, "", "", "https://news.example/a/pic.png")
    assert second.raw_text.splitlines() == ["Only raw", "one", "two"]


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<div class='videoCube trc_spotlight_item", "</div></div>", "<!-- <div class='videoCube trc_spotlight_item'></div> -->", "<![if x]><p>"])
def test_pages_without_cards(spark, page):
    assert html.cards(rows(spark, page)).collect() == []


def test_unclosed_nested_and_repeated_cards(spark):
    inner = "<div class='videoCube trc_spotlight_item'><b class='video-title'>inner</b></div>"
    page = f"<div class='trc_spotlight_item videoCube'><b class='video-title'>outer</b>{inner}{inner} tail"
    got = [(r.place, r.title, r.raw_text) for r in html.cards(rows(spark, page)).orderBy("place").collect()]
    assert got == [(0, "outer", "outer\ninner\ninner\ntail"), (1, "inner", "inner"), (2, "inner", "inner")]
    deep = "<div>" * 5000 + "<p class='videoCube trc_spotlight_item'>x"
    assert html.cards(rows(spark, deep)).first().raw_text == "x"


def test_a_page_that_fails_is_a_row(spark, monkeypatch):
    def broken(self, data):
        raise ValueError("bad page")

    monkeypatch.setattr(html.Reader, "handle_data", broken)
    reader, error = html._read("<p>x", "", html.CardRules())
    assert error == "ValueError: bad page" and reader.cards == []


def test_cards_become_ads(spark):
    found = html.cards(rows(spark, CARD)).where("error is null")
    ads = creatives.parsed_cards(found.drop("page_id"), "news.example", "N", F.lit("t")).collect()
    assert ads == []  # the only sponsored one leads to the publisher
    other = CARD.replace("href='/click", "href='https://www.shop.in/click")
    (ad,) = creatives.parsed_cards(html.cards(rows(spark, other)).drop("page_id"), "news.example", "N", F.lit("t")).collect()
    assert (ad.title, ad.description, ad.advertiser, ad.domain, ad.landing_url, ad.source_page) == ("Great & good offer", "Two lines", "Brand", "shop.in", "https://www.shop.in/click?id=7", "https://news.example/a/b")


def test_frames_become_ads(spark):
    page = "<body><p>Ad</p><a href='http://google.com/c?adurl=https%3A%2F%2Fwww.b.in%2F'>Good headline</a><div>second<br/>third</div><img alt='pic'><img alt=''></body>"
    (frame,) = html.frames(rows(spark, page)).collect()
    assert (frame.text, frame.links, frame.alts, frame.error) == ("Ad\nGood headline\nsecond\nthird", ["http://google.com/c?adurl=https%3A%2F%2Fwww.b.in%2F"], ["pic"], None)
    (ad,) = creatives.parsed_frames(html.frames(rows(spark, page)).drop("page_id"), "N", F.lit("t")).collect()
    assert (ad.title, ad.description, ad.domain) == ("Good headline", "second third", "b.in")
    assert html.frames(rows(spark, None)).first().text == ""
