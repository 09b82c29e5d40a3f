import pytest
from oracle import TESTDATA, compare

import __spark_entry__ as entry

Q, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, Q[name], SQL[name], f"{TESTDATA}/sf0.001")
