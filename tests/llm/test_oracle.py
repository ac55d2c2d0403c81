import pytest

from lectern.llm.queries import ORACLE, QUERIES
from tests.test_oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE[name])
