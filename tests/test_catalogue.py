import pytest

from kvlake.plans import catalogue
from oracle import assert_same

DATA = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, DATA), catalogue.ORACLE[name], DATA)
