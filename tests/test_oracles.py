import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = entry.queries()[name](spark, SF)
    theirs = duck.sql(entry.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a = sorted([[plain(r[c]) for c in columns] for r in ours.collect()], key=repr)
    b = sorted([[plain(dict(zip(theirs.columns, r, strict=True))[c]) for c in columns] for r in theirs.fetchall()], key=repr)
    assert a == b


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
