import pytest
from same import assert_same

from quillmark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    assert_same(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_greedy_assignment_uses_each_box_once(spark):
    rows = catalogue.QUERIES["greedy_assignment"](spark, SF).collect()
    assert len({(r.page, r.det) for r in rows}) == len(rows) == len({(r.page, r.ans) for r in rows})


def test_nested_boxes_go(spark):
    from quillmark.operators import spatial

    found = spark.createDataFrame([(1, 1, 0, 0, 900, 900), (1, 2, 100, 100, 300, 200), (1, 3, 905, 0, 995, 300), (2, 1, 0, 0, 5, 5)], "page long, det long, x1 long, y1 long, x2 long, y2 long")
    assert sorted((r.page, r.det) for r in spatial.without_nested(found).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_softmax_learns(spark):
    from quillmark.operators import model

    at = {0: (1.0, 0.0), 1: (-0.5, 0.9), 2: (-0.5, -0.9)}
    rows = spark.createDataFrame([(k, [at[k % 3][0] + k % 7 / 50, at[k % 3][1] - k % 5 / 50], k % 3) for k in range(90)], "id long, v array<double>, label int")
    scored = model.softmax_scores(model.softmax_fit(rows, "v", "label", 8.0), rows, "v").collect()
    assert all(abs(sum(r.scores) - 1) < 1e-9 and r.scores.index(max(r.scores)) == r.label for r in scored)
