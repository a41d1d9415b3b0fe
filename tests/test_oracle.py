"""Every query gives the rows of its SQL on the smallest tables."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, name, query, sql):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = query(spark, SF).toPandas(), c.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def names():
    from strandsift.queries import oracle_sql

    return sorted(oracle_sql())


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", names())
def test_rows(spark, name):
    from strandsift import queries as q

    compare(spark, name, q.queries()[name], q.oracle_sql()[name])
