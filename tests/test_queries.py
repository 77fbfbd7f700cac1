"""Every query with SQL gives the rows that DuckDB gives for that SQL."""

import decimal

import duckdb
import pytest

from tallyframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    told = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall()), key=repr)
    assert got == want


def test_queries_without_sql(spark):
    """Their columns are tested against plain code elsewhere; here, that every row comes."""
    for name, source in (("blanked_code", "conversations"), ("top_level_parts", "part")):
        assert catalog.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"blanked_code", "top_level_parts", "difflib_residual", "alignment_residual", "instruction_residuals"}


def test_entry_points():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
