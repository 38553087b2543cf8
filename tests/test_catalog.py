"""Every query of the catalogue against its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from wayfold.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return int(v)
    return float(v) if type(v).__name__ in ("float", "Decimal") else v


def same(a, b):
    return a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    want = db.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()]
    # rounded numbers sort alike on both sides but for the last digit
    key = lambda r: tuple((v is None, round(v, 3) if isinstance(v, float) else str(v)) for v in r)
    exact = lambda r: tuple((v is None, str(v)) for v in r)
    assert len(found) == len(want)
    if sorted(found, key=exact) != sorted(want, key=exact):
        for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
            assert all(map(same, a, b)), (a, b)
