"""Every query of the library against its SQL."""

import oracle
import pytest

from beaconlake import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    oracle.same(spark, catalogue.queries()[name], SQL[name])


def test_without_sql(spark):
    assert set(catalogue.queries()) - set(SQL) == {"ser_permutation", "pas_scores"}
