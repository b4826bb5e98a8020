"""Every query of the reference's operators against its SQL."""

import pytest

from docketry.plans.registry import ORACLES, QUERIES
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"o47_coverage"}


def test_entry(spark):
    import __spark_entry__

    assert "o11_shopping" in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).count() > 0


def test_coverage_query_against_plain_code(spark):
    from docketry.functions.text import common_subsequence

    rows = QUERIES["o47_coverage"](spark, DATA).collect()
    assert rows and all(0 <= r.coverage <= 1 for r in rows)
    assert common_subsequence("a b c d".split(), "b x d a".split()) == 2
    assert common_subsequence([], ["a"]) == 0
