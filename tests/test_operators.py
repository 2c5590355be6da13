"""Prediction, library state, cards, pages and boxes: edge cases and plain Python versions."""

import datetime
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import keywords, text, urls
from quillmark.operators import library, pages, predict, reports, spatial
from quillmark.sources import creatives, readers

DAY = lambda d: datetime.datetime(2024, 1, d)
ADS = "id long, title string, description string, advertiser string, domain string, lexical array<double>, semantic array<double>"
LEXICON = {"money": ["loan", "home loan", "e-auction"], "homes": ["घर", "home"], "rest": []}


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_keywords(spark):
    hits = lambda t: [e["keyword"] for e in one(spark, t, "string", lambda c: keywords.keyword_hits(c, LEXICON))]
    assert hits("A Home Loan, now") == ["loan", "home loan", "home"]
    assert hits("homeloan loans") == [] and hits(None) == [] and hits("") == []
    assert hits("an E-Auction") == ["e-auction"]
    assert hits("घरांसाठी") == ["घर"] and hits("कघर") == [] and hits("x-घर") == ["घर"]
    shares = one(spark, "home loan", "string", lambda c: keywords.rule_scores(keywords.keyword_hits(c, LEXICON), 3))
    assert shares == [2.5 / 3.5, 1 / 3.5, 0.0]


@pytest.mark.parametrize("limit", [keywords.BROADCAST_KEYWORDS, 0])
def test_a_lexicon_as_a_table_finds_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(keywords, "BROADCAST_KEYWORDS", limit)
    lexicon = {"a": ["loan", "home loan", "e-auction", "Emi", "₹", "#1 rated", "loan"], "b": ["घर", "गृह कर्ज", "home", "é", "ℓ-x"], "c": []}
    said = ["A Home Loan, now", "homeloan loans", None, "", "an E-Auction", "घरांसाठी", "कघर", "x-घर", "गृह कर्जे", "गृहकर्ज", "EMI ₹ 5", "the #1 rated home", "home  loan", "home\nloan", "étude", "Été", "été é", "emi_x", "aℓ-x ℓ-x", "loan " * 3000]
    docs = spark.createDataFrame(list(enumerate(said)), "id long, text string").withColumn("keyword", F.lit("clash"))
    got = {r.id: r.hits for r in keywords.table_hits(docs, "id", "text", keywords.lexicon_table(spark, lexicon)).collect()}
    expected = {r.id: r.hits for r in docs.select("id", keywords.keyword_hits(F.col("text"), lexicon).alias("hits")).collect()}
    assert got == expected and len(got) == len(said)
    plain = lambda k: rf"(?<!\w){re.escape(k)}" + (r"(?!\w)" if k.isascii() else "")
    assert {i: [e.keyword for e in hits] for i, hits in got.items()} == {i: [k for ks in lexicon.values() for k in ks if re.search(plain(k), t or "", re.I)] for i, t in enumerate(said)}
    assert keywords.table_hits(docs.limit(0), "id", "text", keywords.lexicon_table(spark, lexicon)).collect() == []


def test_pages_of_an_ordering(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 11).alias("a"), "id")
    pages = reports.Pages(rows, [F.desc("a"), F.col("id")], 24, 16)
    expected = sorted(((k * 37 % 11, k) for k in range(1000)), key=lambda r: (-r[0], r[1]))
    assert pages.pages == 42
    for n in (1, 2, 20, 42, 99, -3):
        at = min(max(n, 1), 42) - 1
        assert [tuple(r) for r in pages.page(n).collect()] == expected[at * 24 : at * 24 + 24]
    assert len(pages.parts_of(42)[0]) == 1
    assert reports.Pages(rows.limit(0), [F.col("id")]).page(1).count() == 0


def test_small_reports(spark):
    import base64

    assert [one(spark, v, "string", reports.day_label) for v in ("2024-01-02T03:04:05", "x", None, "")] == ["02 Jan 2024", "", "", ""]
    url = "data:image/png;base64," + base64.b64encode(b"x" * 100).decode()
    read = lambda v, most=None: one(spark, v, "string", lambda c: readers.data_url(c, most))
    assert read(url) == read(url, 100) == b"x" * 100 and read(url, 99) is None and read(url, 10) is None and read("no", 10) is None and read(None, 10) is None
    listing = lambda name: one(spark, name, "string", lambda c: reports.network_listing(c, F.lit("search.net.com"), ["search.net.com"]))
    assert [listing(n) for n in ("", None, "Search Net", "Shop | Search Ads", "Shoe Shop")] == [True, True, True, False, False]
    counted = reports.scan_counters(spark.createDataFrame([("ab ", 0.5), ("abc", 0.8), (None, None), ("long", 0.49)], "headline string, certainty double")).first()
    assert tuple(counted) == (2, 2, 2)


def test_predict(spark):
    ads = spark.createDataFrame([(1, "", None, "", "", [0.2, 0.5, 0.3], None), (2, "home", "", "b", "b.com", [0.4, 0.4, 0.2], [0.4, 0.4, 0.2]), (3, "plain", "", "", "c.com", [0.34, 0.33, 0.33], None), (4, "plain", "", "", "d.com", [0.0, 0.1, 0.9], None)], ADS)
    memory = spark.createDataFrame([("d.com", [1.0, 0.0, 0.0])], "memory_key string, remembered array<double>")
    got = {r.id: r for r in predict.predict_many(ads, LEXICON, memory, ["net.com"]).collect()}
    assert (got[1].category, got[1].method, got[1].needs_review, got[1].alternatives, got[1].certainty) == ("Sponsored Stories", "empty", True, [], None)
    assert (got[2].category, got[2].confidence, got[2].method, got[2].matched_keywords) == ("homes", 0.58, "semantic+rules", ["home"])
    assert got[3].needs_review and got[3].method == "lexical" and [a.category for a in got[3].alternatives] == ["money", "rest", "homes"]
    assert (got[4].category, got[4].confidence, got[4].method) == ("money", 0.5, "lexical+advertiser")
    after = predict.remember(memory, spark.createDataFrame([("d.com", "rest", 2), ("d.com", "homes", 1), ("e", "money", 1)], "memory_key string, category string, ts long"), list(LEXICON))
    assert sorted((r.memory_key, r.remembered) for r in after.collect()) == [("d.com", [0.0, 0.0, 1.0]), ("e", [1.0, 0.0, 0.0])]
    assert predict.predict_many(ads.limit(0), LEXICON, memory, []).count() == 0


def test_calibration_separates(spark):
    rng = random.Random(1)
    rows = [((t := rng.random()), t * rng.random(), int(rng.random() < t)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, r int")
    certainty = predict.fit_calibration(df, "a", "b", "r")
    high, low = df.select(certainty(F.lit(0.95), F.lit(0.01)), certainty(F.lit(0.1), F.lit(0.09))).first()
    assert high > 0.8 > 0.3 > low
    assert predict.fit_calibration(df.limit(10), "a", "b", "r") is None and predict.fit_calibration(df.where("r = 1"), "a", "b", "r") is None


def test_calibration_is_the_balanced_regression(spark):
    """Against Newton's steps on the weighted likelihood with the penalty of a two-class softmax."""
    rng = random.Random(2)
    rows = [((t := 0.3 + 0.7 * rng.random()), t * rng.random(), int(rng.random() < 0.91)) for _ in range(600)]
    x = np.array([[np.log((t + 1e-4) / (1 - t + 1e-4)), np.log((t + 1e-4) / (1 - t + 1e-4)) - np.log((s + 1e-4) / (1 - s + 1e-4)), t - s] for t, s, _ in rows])
    y = np.array([r for _, _, r in rows])
    x = np.column_stack([(x - x.mean(0)) / (x.std(0) + 1e-6), np.ones(len(x))])
    w, penalty = np.where(y == 1, 300 / y.sum(), 300 / (600 - y.sum())), np.diag([0.5, 0.5, 0.5, 0])
    theta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ theta))
        theta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (p - y)) + penalty @ theta)
    df = spark.createDataFrame(rows, "a double, b double, r int")
    got = [r[0] for r in df.select(predict.fit_calibration(df, "a", "b", "r")(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-x @ theta)), atol=1e-4) and 0.4 < np.mean(got) < 0.65
    plain = [r[0] for r in df.select(predict.fit_calibration(df, "a", "b", "r", balanced=False)(F.col("a"), F.col("b"))).collect()]
    assert abs(np.mean(plain) - y.mean()) < 0.01


def test_library_keeps_all_columns(spark):
    schema = "id long, first_seen timestamp_ntz, last_seen timestamp_ntz, times_seen long, title string, category string, confidence double, method string, needs_review int, manual_label int"
    before = spark.createDataFrame([(1, DAY(1), DAY(2), 3, "old", "x", 1.0, "manual", 0, 1)], schema)
    batch = spark.createDataFrame([(1, 1, DAY(5), "new", "y", 0.2), (2, 3, DAY(6), "b", "z", 0.4), (2, 2, DAY(7), "a", "z", 0.3)], "id long, seq long, ts timestamp_ntz, title string, category string, confidence double")
    got = sorted(tuple(r) for r in library.merge(before, batch).collect())
    assert got == [(1, DAY(1), DAY(5), 4, "old", "x", 1.0, "manual", 0, 1), (2, DAY(7), DAY(7), 1, "a", "z", 0.3, None, None, 0)]
    merged = library.merge(before, batch)
    done = library.labelled(merged, spark.createDataFrame([(2, "p", 1), (2, "q", 1), (9, "r", 1)], "id long, category string, ts long"))
    assert sorted((r.id, r.category, r.confidence, r.method, r.manual_label) for r in done.collect()) == [(1, "x", 1.0, "manual", 1), (2, "q", 1.0, "manual", 1)]
    answers = spark.createDataFrame([(1, "n", 0.5, "lexical", True), (2, "n", 0.5, "lexical", True)], "id long, category string, confidence double, method string, needs_review boolean")
    assert sorted((r.id, r.category, r.needs_review) for r in library.reclassified(merged, answers).collect()) == [(1, "x", 0), (2, "n", 1)]


def test_runs(spark):
    events = spark.createDataFrame([(1, DAY(1), None, None, None), (1, DAY(2), 5, 2, None), (2, DAY(3), None, None, None), (2, DAY(4), 0, 0, None), (3, DAY(5), None, None, None)], "run long, at timestamp_ntz, found long, new long, error string")
    runs = library.runs_log(events)
    assert {r.run: r.status for r in runs.collect()} == {1: "success", 2: "failed", 3: "running"}
    now = F.lit("2024-01-02 07:00:00").cast("timestamp_ntz")
    assert library.due(runs, now, 6).first().due and not library.due(runs, now, 8).first().due
    assert library.due(runs.limit(0), now, 8).first().due


def test_urls_and_names(spark):
    page = lambda u: one(spark, u, "string", urls.landing_page)
    assert page("https://a.in/x?utm_s=1&id=7&tblci=q&t%69tle=z&b=%20c*~#f") == "https://a.in/x?id=7&b=+c%2A~"
    assert page("https://a.in/?ref=1&refer=2&e") == "https://a.in/?refer=2&e=" and page(None) == ""
    target = lambda u: one(spark, u, "string", urls.click_target)
    assert target("http://g/c?adurl=https%3A%2F%2Fb.in%2F") == "https://b.in/" and target("http://g/c?adurl=x&dest=http://c/") == "http://c/" and target("http://g/") == "http://g/"
    name = lambda n: one(spark, n, "string", text.clean_advertiser)
    assert [name(n) for n in ("Co | Search Ads", "Co|searchad", "Co  |  Sponsored x", "Co | Other", None)] == ["Co", "Co", "Co", "Co | Other", ""]
    assert one(spark, "/a/b/", "string", text.snapshot_key) == "a-b" and one(spark, "/", "string", text.snapshot_key) == "home"


def test_cards_and_frames(spark):
    schema = "sponsored boolean, title string, description string, advertiser string, raw_text string, landing_url string, image_url string, page_url string"
    rows = [(True, "", "", "", "Great offer\nBrand|Sponsored\nCTA", "https://www.shop.in/x?utm_a=1", None, "p"), (False, "Some title", "", "", "", "https://a.in", "", "p"), (True, "Some title", "", "", "", "https://me.example", "", "p"), (True, "Ad", "", "", "", "https://a.in", "", "p"), (None, None, None, None, None, None, None, None)]
    got = creatives.parsed_cards(spark.createDataFrame(rows, schema), "me.example", "N", F.lit("t")).collect()
    assert [(r.title, r.advertiser, r.description, r.domain, r.landing_url, r.image_url) for r in got] == [("Great offer", "Brand", "", "shop.in", "https://www.shop.in/x", "")]
    frames = [("Ad\nGood headline\nsecond", ["http://google.com/c?adurl=https%3A%2F%2Fwww.b.in%2F"], None, "p"), ("", [], ["Alternative text"], "p"), (None, None, None, "p"), ("", ["https://c.in/"], ["Alternative text", "more"], "p")]
    got = creatives.parsed_frames(spark.createDataFrame(frames, "text string, links array<string>, alts array<string>, page_url string"), "N", F.lit("t")).collect()
    assert sorted((r.title, r.description, r.domain) for r in got) == [("Alternative text", "Alternative text more", "c.in"), ("Good headline", "second", "b.in")]


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("i", "T, \"q\"", "", "Co | Search Ads", "net.com", "https://net.com/?utm_a=1", "c", "2024-01-02T03", None)], "id string, title string, description string, advertiser string, domain string, landing_url string, category string, first_seen string, last_seen string")
    creatives.write_report(creatives.report_rows(creatives.public_ads(rows, ["net.com"])).coalesce(1), str(tmp_path / "r"))
    body = next((tmp_path / "r").glob("*.csv")).read_text(encoding="utf-8").splitlines()
    assert body[0] == "﻿Category,Headline,Description,Advertiser,Website,Link,First seen,Last seen" and body[1].startswith('c,"T, ""q""",') and ",Co," in body[1] and "2024-01-02" in body[1]


def test_networks_show_neither_domain_nor_link(spark):
    schema = "id string, title string, description string, advertiser string, domain string, landing_url string, category string, first_seen string, last_seen string"
    rows = [("a", "t", "", "", "net.com", "https://net.com/?q=1", "c", "", ""), ("b", "t", "", None, "shop.in", "https://shop.in/?utm_a=1&p=2", "c", "", ""), ("c", "t", "", "Co", None, None, "c", "", "")]
    got = {r.id: (r.advertiser, r.domain, r.landing_url) for r in creatives.public_ads(spark.createDataFrame(rows, schema), ["net.com"]).collect()}
    assert got == {"a": ("net.com", "", ""), "b": ("shop.in", "shop.in", "https://shop.in/?p=2"), "c": ("Co", None, "")}


@pytest.mark.parametrize("said", ["ph: १२ rs ५००", "९८७६५ ४३२१० said", "x said y", "संपर्क 98765 43210 www.a.in ₹ 500", "नवी दिल्ली : म्हणाले", "pune: x\nmumbai: y", "call\u00a0now 20 % off", "का said", "saidका", "a.in b", "@क", "1800\u2009123", ""])
def test_cues_are_those_of_all_scripts(spark, said):
    row = spark.createDataFrame([(said,)], "c string").select(pages.evidence(F.col("c")).alias("e"), text.cue_count(F.lower("c"), pages.CLASSIFIED).alias("a"), text.cue_count(F.lower("c"), pages.REPORTING).alias("n")).first()
    count = lambda ps, flags=0: sum(bool(re.search(p, said.lower(), flags)) for p in ps)
    assert (row.e.ads, row.e.news, row.a, row.n) == (count(pages.AD_CUES, re.M), count(pages.NEWS_CUES, re.M), count(pages.CLASSIFIED), count(pages.REPORTING))


def test_composed_text(spark):
    lines = spark.createDataFrame([(1, 1, "small first", 0.9, 0.0, 0.0, 10.0), (1, 2, "BIG SALE", 0.9, 5.0, 20.0, 40.0), (1, 3, "--- ...", 0.2, 0.0, 70.0, 10.0), (1, 4, "98765 43210", 0.8, 0.0, 90.0, 10.0), (2, 1, ".", 0.9, 0.0, 0.0, 9.0)], "b long, line int, text string, conf double, x double, y double, h double")
    got = {r.b: r for r in pages.composed(lines, "b").collect()}
    assert (got[1].headline, got[1].description, got[1].full_text) == ("BIG SALE", "small first 98765 43210", "small first\nBIG SALE\n98765 43210")
    assert (got[2].headline, got[2].full_text) == ("", "")
    marks = {r.b: r.quality for r in pages.quality(lines, "b").collect()}
    assert 0 < marks[2] < marks[1] < 1
    for said, expected in (("the minister said in a reporter told police", False), ("sale offer 9876543210", True), ("", True)):
        assert one(spark, said, "string", pages.is_ad) is expected


def test_responses(spark):
    body = '{"ads": [{"box": [500, 250, 1000, 500], "category": "c", "headline": " h "}, {"box": [5, 5, 5, 9], "category": "c"}, {"box": null, "category": "c"}, {"box": [1, 1, 2, 2], "category": "no"}]}'
    rows = spark.createDataFrame([(1, 600, 900, body), (2, 1, 1, '{"refusal": "no"}'), (3, 1, 1, "{"), (4, 1, 1, None), (5, 1, 1, '{"ads": []}')], "page long, width int, height int, body string")
    got = {r.page: r for r in pages.parsed_responses(rows, ["c"]).collect()}
    assert (got[1].x1, got[1].y1, got[1].w, got[1].h, got[1].headline, got[1].ad_index) == (300, 225, 300, 225, "h", 0)
    assert {p: r.error for p, r in got.items() if p > 1} == {2: "refused", 3: "unreadable", 4: "unreadable"}


def area(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def shared(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


BOX = "page long, det long, x1 long, y1 long, x2 long, y2 long"


def boxes(rng, n, pages_):
    corner = lambda: (rng.randrange(80), rng.randrange(80))
    return [(p, k, x, y, x + rng.randrange(0, 60), y + rng.randrange(0, 60)) for p in range(pages_) for k in range(n) for x, y in [corner()]]


@pytest.mark.parametrize("rule", ["nested", "duplicates"])
def test_boxes_that_go(spark, rule):
    rows = boxes(random.Random(4), 25, 6)
    expected = []
    for _, page in itertools.groupby(rows, key=lambda r: r[0]):
        kept = []
        for r in sorted(page, key=lambda r: (-area(r[2:]), r[1])):
            b, own = r[2:], area(r[2:])
            if rule == "nested":
                gone = any(shared(b, k[2:]) >= 0.7 * max(1, own) or area(k[2:]) >= 0.6 * 5000 and shared(b, k[2:]) >= 0.5 * max(1, own) for k in kept)
            else:
                gone = any(shared(b, k[2:]) >= 0.8 * own and shared(b, k[2:]) >= 0.6 * area(k[2:]) for k in kept)
            if not gone:
                kept.append(r)
        expected += kept
    df = spark.createDataFrame(rows, BOX)
    got = spatial.without_nested(df, 5000) if rule == "nested" else spatial.without_duplicates(df)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    disjoint = spark.createDataFrame([(1, 1, 0, 0, 9, 9), (1, 2, 50, 50, 50, 60)], BOX)
    assert spatial.without_nested(disjoint).count() == 2


def test_evaluation_in_the_order_of_listing(spark):
    rng = random.Random(5)
    found, key = boxes(rng, 12, 5), boxes(rng, 8, 5)
    extra = boxes(rng, 3, 5)
    match = lambda d, g: (shared(d, g) / u if (u := area(d) + area(g) - shared(d, g)) else 0) >= 0.3 or (g[0] <= (d[0] + d[2]) / 2 <= g[2] and g[1] <= (d[1] + d[3]) / 2 <= g[3] and area(d) >= 0.25 * area(g))
    hits = wrong = right = 0
    for page in range(5):
        dets, ans, more = ([r for r in rows if r[0] == page] for rows in (found, key, extra))
        used = set()
        for g in ans:
            hit = next((d for d in dets if d[1] not in used and match(d[2:], g[2:])), None)
            if hit:
                used.add(hit[1])
                hits += 1
                right += hit[1] % 3 == g[1] % 3 or hit[1] % 3 == 1
        wrong += sum(d[1] not in used and not any(match(d[2:], o[2:]) for o in ans + more) for d in dets)
    kind = lambda c: F.concat(F.lit("c"), (F.col(c) % 3).cast("string"))
    dets = spark.createDataFrame(found, BOX).withColumns({"category": kind("det"), "quality": F.lit(0.5), "confidence": F.lit(0.25)})
    named = BOX.replace("det", "ans")
    answers = spark.createDataFrame(key, named).withColumns({"category": kind("ans"), "also_ok": F.array(F.lit("c1"))})
    got = spatial.evaluation(dets, answers, spark.createDataFrame(extra, named)).first()
    assert (got.found, got["of"], got.false_positives, got.category_ok, got.quality) == (hits, len(key), wrong, right, 0.5)
