"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from barloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [[None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order] for r in values]
    return sorted(clean, key=lambda r: repr([round(v, 2) + 0.0 if isinstance(v, float) else v for v in r]))


def alike(a, b):
    """Equal, but for the last rounded digit of doubles."""
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-4)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows(map(tuple, df.collect()), df.columns), rows(cur.fetchall(), columns)
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want) if not all(map(alike, g, w))] == []


def test_stream_of_paths_equals_batch(spark):
    q = registry.queries()
    assert sorted(map(tuple, q["stream_path_state"](spark, SF).collect())) == sorted(map(tuple, q["path_state"](spark, SF).collect()))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
