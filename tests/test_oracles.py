import pytest

from compare import assert_same
from volspark.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(name, spark, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", ["e6_har_ridge", "r13_bocpd", "q7_contextual_bandit", "c18_lookback_search", "x2_online_positions"])
def test_rows_without_oracle(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
