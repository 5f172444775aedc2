"""The operators that SQL can express against their SQL, over the smallest tables."""

import duckdb
import pytest

from gistmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found = queries.queries()[name](spark, SF).toPandas()
    plain = con.sql(queries.oracle_sql()[name]).df()[list(found.columns)]
    assert sorted(map(tuple, found.values.tolist())) == sorted(map(tuple, plain.values.tolist()))
