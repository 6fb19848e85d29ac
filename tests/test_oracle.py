"""Every registered query against its SQL twin, on the smallest tables."""

import oracle
import pytest

from engram import plans

QUERIES, ORACLES = plans.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        _, _, problems = oracle.compare(df, con, ORACLES[name])
        assert not problems, problems
    else:
        assert len(df.collect()) > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
