import os

import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables not here")
def test_flagship(spark):
    df = driver.entry(spark)
    rows = df.collect()
    assert len(rows) == 40 * 12 and {r["rank"] for r in rows} == set(range(12))
    assert all(r.kept for r in rows if r["rank"] == 0)
