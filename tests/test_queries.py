"""Every raster query against its SQL on the same tables."""

import pytest
from conftest import DATA, rows_of

from pixelweave import queries as raster


@pytest.mark.parametrize("name", sorted(raster.queries()))
def test_query_matches_sql(spark, sql, name):
    got = raster.queries()[name](spark, DATA).toPandas()
    want = sql.execute(raster.oracle_sql()[name]).df()
    got_names, got_rows = rows_of(got)
    want_names, want_rows = rows_of(want)
    assert got_names == want_names
    assert len(got_rows) == len(want_rows)
    assert got_rows == want_rows


def test_every_query_has_sql():
    assert set(raster.queries()) == set(raster.oracle_sql())
