import pytest
from same import assert_same

from quillmark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    assert_same(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])
