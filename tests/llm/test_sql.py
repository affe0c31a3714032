"""The registered queries that have SQL, against DuckDB."""

import glob
import os

import duckdb
import pytest

from pixelloom.llm import oracles, quality, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.queries()[name](spark, sf)
    found = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda cols: sorted(range(len(cols)), key=lambda i: cols[i])
    plain = lambda rows, cols: sorted(tuple("%.6g" % r[i] if isinstance(r[i], float) else str(r[i]) for i in order(cols)) for r in rows)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), names)


def test_null_groups_of_quality(spark, prose):
    """Null languages and sources are groups of their own."""
    rows = [(i, prose(60 + i % 30, i), None if i % 2 else "en", None if i % 3 else "s") for i in range(160)] + [(500, " ".join(w + "#$%" for w in prose(60, 1).split()), None, None)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(out) == 161 and all(out[i].kept and out[i].distance2 is not None for i in range(160)) and not out[500].kept
