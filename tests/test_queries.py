import duckdb
import pytest

from feedelta import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in q._TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found, names):
    """Sorted rows as text, columns by name."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


def test_every_query_has_sql():
    assert q.Q.keys() == q.O.keys()


@pytest.mark.parametrize("name", sorted(q.Q))
def test_query_equals_sql(spark, con, name):
    got, want = q.Q[name](spark, SF), con.execute(q.O[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8
    assert set(q.Q) <= set(e.queries())
