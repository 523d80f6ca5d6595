import pytest

from tests.oracle import check
from wavegrid.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_oracle(spark, name):
    assert check(spark, DATA, QUERIES[name], ORACLES[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
