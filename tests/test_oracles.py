"""Every query with SQL against that SQL in another engine, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from codexlake.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


def shown(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    told = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(told.columns)
    rows = lambda all_, names: sorted(tuple(shown(dict(zip(names, r, strict=True))[c]) for c in columns) for r in all_)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(told.fetchall(), told.columns)
