import pytest

from corvine.llm import queries
from tests.test_oracles import SF, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    ours, theirs = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a = sorted([[plain(r[c]) for c in columns] for r in ours.collect()], key=repr)
    assert a == sorted([[plain(dict(zip(theirs.columns, r, strict=True))[c]) for c in columns] for r in theirs.fetchall()], key=repr)
