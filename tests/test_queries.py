"""Every registered query of the library against its SQL oracle."""

from pathlib import Path

import duckdb
import pytest

from strandline.plans import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "shape", ()):
        return str([plain(x) for x in value])
    return int(value) if isinstance(value, bool) else value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        want = rows(rel.columns, rel.fetchall())
        assert sorted(df.columns) == sorted(rel.columns)
        assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
