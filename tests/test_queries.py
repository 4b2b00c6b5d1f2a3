"""Every registered query against its oracle SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from glyphmeter.plans import registry

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{float(v):.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in found), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    got = rows(df.columns, df.collect())
    want = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    expected = rows(columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-9) if all(isinstance(x, float) for x in a + b) else all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9) for x, y in zip(a, b, strict=True))
