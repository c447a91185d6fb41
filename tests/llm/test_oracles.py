"""Queries of the training-data operators that SQL can state, against that SQL."""

import pytest

from chainscope.llm.queries import ORACLES, QUERIES
from tests.harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    problems, n, _ = compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name])
    assert not problems and n > 0, problems
