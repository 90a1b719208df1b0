import pytest

from kvlake.llm import catalogue
from oracle import assert_same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, DATA), catalogue.ORACLE[name], DATA)
