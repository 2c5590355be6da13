"""Grams, the lexical model, clusters of lines, cells and scan decisions on fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F
from same import assert_same

from quillmark.functions import text
from quillmark.operators import lexical, pages, spatial
from quillmark.plans import catalogue, classify, scans  # noqa: F401 - they register their queries

SF = "/root/testdata/sf0.001"


def padded_grams(c):
    return [w[i : i + n] for w in (f" {x} " for x in (c or "").lower().split()) for n in range(2, 6) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("c", ["The cat's a Cat", "", "x", None, "  a  bc ", "été €5", "word " * 2000])
def test_grams(spark, c):
    row = spark.createDataFrame([(c,)], "c string").select(text.word_grams(F.col("c")).alias("w"), text.char_grams(F.col("c")).alias("g")).first()
    words = re.findall(r"\w[\w'®]*\w", (c or "").lower())
    assert row.w == words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    assert sorted(row.g) == sorted(padded_grams(c))


def test_lexical_model_learns_and_scatters(spark):
    rows = spark.createDataFrame([(k, ("buy cheap shoes " if k % 2 else "minister said today ") + f"n{k}", "shop" if k % 2 else "news") for k in range(40)], "id long, body string, label string")
    fitted = lexical.fit(rows, "id", F.col("body"), "label", slots=512, rounds=30)
    asked = spark.createDataFrame([(1, "cheap shoes"), (2, "the minister"), (3, ""), (4, None), (5, "unknown")], "id long, body string")
    got = {r.id: r.lexical for r in fitted.scores(asked, "id", F.col("body"), ["news", "never", "shop"]).collect()}
    assert len(got) == 5 and all(abs(sum(s) - 1) < 1e-9 and s[1] == 0 for s in got.values())
    assert got[1][2] > 0.7 and got[2][0] > 0.7
    assert got[3] == got[4]


def test_cross_validation_holds_groups_out(spark):
    rows = [(k, f"{'loan credit bank' if k % 2 else 'shirt shoe dress'} w{k % 5}", "", f"b{k // 4}", f"b{k // 4}.example", "money" if k % 2 else "fashion") for k in range(60)]
    ads = spark.createDataFrame(rows, "id long, title string, description string, advertiser string, domain string, actual string")
    answers = lexical.cross_validated(ads, "id", "domain", {"money": ["loan"], "fashion": ["shirt"]}, [], folds=2, slots=256, rounds=15).cache()
    assert answers.groupBy("known").count().where("count = 60").count() == 2
    assert answers.where("not known and method like '%advertiser%'").count() == 0 < answers.where("known and method like '%advertiser%'").count()
    report = lexical.validation_report(answers).first()
    assert report.accuracy == report.macro_f1 == 1.0


def clusters_by_hand(lines, height):
    reach, found = 2.5 * max(0.02 * height, 30), []
    for line in sorted(lines, key=lambda r: ((r[2] + r[4]) / 2, r[0])):
        for c in found:
            if any(abs((line[2] + line[4]) - (m[2] + m[4])) / 2 <= reach and min(line[3] - line[1], m[3] - m[1]) > 0 and min(line[3], m[3]) - max(line[1], m[1]) > -0.3 * min(line[3] - line[1], m[3] - m[1]) for m in c):
                c.append(line)
                break
        else:
            found.append([line])
    return {m[0]: i for i, c in enumerate(found) for m in c}


def test_line_clusters(spark):
    rng = random.Random(5)
    lines = [(i, x := rng.randrange(600), y := rng.randrange(2000), x + rng.choice([0, 20, 90, 200]), y + rng.randrange(8, 40)) for i in range(80)]
    df = spark.createDataFrame([("p", 2000, *line) for line in lines], "page string, height int, line int, x1 int, y1 int, x2 int, y2 int")
    assert {r.line: r.cluster for r in pages.line_clusters(df).collect()} == clusters_by_hand(lines, 2000)
    assert pages.line_clusters(df.limit(0)).count() == 0


def test_cells_and_decisions(spark):
    cells = spark.createDataFrame([(1, i, 10.0 * i, 5.0) for i in range(6)], "page long, cell int, cx double, cy double")
    box = lambda *b: spark.createDataFrame([(1, *b)], "page long, x1 long, y1 long, x2 long, y2 long")
    got = {r.cell: (r.label, r.weight) for r in spatial.cell_labels(cells, box(0, 0, 20, 10), box(15, 0, 40, 10)).collect()}
    assert got == {0: (1, 1), 1: (1, 1), 2: (1, 1), 3: (0, 0), 4: (0, 0), 5: (0, 1)}
    assert spatial.training_cells(spatial.cell_labels(cells, box(0, 0, 20, 10), box(15, 0, 40, 10)), 3).count() == 3
    blocks = spark.createDataFrame([(0.6, 0, 0, "h", "words", 0.5), (0.9, 0, 2, "h", "words", 0.5), (0.6, 3, 0, "", "words", 0.5), (0.95, 3, 0, "h", "a b", 0.01)], "layout double, ads int, news int, headline string, full_text string, page_share double")
    assert [(round(r.score, 6), r.is_ad, r.likelihood) for r in spatial.decided(blocks).collect()] == [(0.6, True, 0.6), (0.3, False, 0.5), (0.54, True, 0.54), (0.0, False, 0.5)]


@pytest.mark.parametrize("side, columns, rows", [(24, 20, 20), (7, 62, 3), (10.5, 5, 9), (0.1, 31, 50)])
def test_counts_of_grid_cells_are_those_of_their_labels(spark, side, columns, rows):
    rng = random.Random(columns)
    some = lambda n: [(rng.randrange(4), x := rng.choice([None, *range(0, 480, 6)]), y := rng.randrange(-30, 480), (x or 0) + rng.choice([-5, 0, 12, 24, 90, 600]), y + rng.choice([0, 24, 77, 500])) for _ in range(n)]
    answers, optional = (spark.createDataFrame([*some(9), (9, 900, 900, 950, 950)], "page long, x1 long, y1 long, x2 long, y2 long") for _ in range(2))
    cells = answers.union(optional).select("page").distinct().crossJoin(spark.range(columns * rows).withColumnRenamed("id", "cell")).selectExpr("page", "cell", f"(cell % {columns} + 0.5d) * {side}d as cx", f"(floor(cell / {columns}) + 0.5d) * {side}d as cy")
    wanted = spatial.cell_labels(cells, answers, optional).groupBy("page").agg(F.sum("label").alias("positive"), F.count_if(F.col("weight") == 0).alias("ignored"))
    assert sorted(spatial.grid_counts(answers, optional, side, columns, rows).collect()) == sorted(wanted.collect())


def test_cells_of_a_grid_are_no_rows(spark):
    plan = catalogue.QUERIES["cell_labels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["word_grams", "char_grams", "scan_decision", "cell_labels"])
def test_oracles(spark, duck, name):
    assert_same(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", ["line_clusters", "scanned_ads"])
def test_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
