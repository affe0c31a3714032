"""Every registered raster query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from pixelloom.plans import queries as plans


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("%.6g" % r[i] if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    df = plans.queries()[name](spark, sf)
    found = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_full_params_of_a_constant_band_equal_sql(spark, sf, tmp_path):
    """Half is exact, so the SQL's pivot is 0 whatever the order of its sums, and no rounding error."""
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * replace (0.5e0 as l_discount) from '{sf}/lineitem.parquet'")
    c.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    df = plans.queries()["global_full_params"](spark, str(tmp_path))
    found = c.execute(plans.oracle_sql()["global_full_params"])
    want = plain(found.fetchall(), [d[0] for d in found.description])
    assert plain(df.collect(), df.columns) == want and sum("nan" in row for row in want) == 3
