"""Every registered query of the structure engine against its SQL."""

import duckdb
import pytest

from spanforge import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df):
    cols = sorted(df.columns)
    return df[cols].astype(str).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf_dir, db, name):
    got = Q.queries()[name](spark, sf_dir).toPandas()
    assert name == "block_scan" or len(got)
    if name in Q.oracle_sql():
        want = db.execute(Q.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got).equals(plain(want))


def test_entry_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
