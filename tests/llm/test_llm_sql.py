"""Every query of the package against its SQL on the smallest test tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from spanline.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "N"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def canon(cols, rows):
    ix = sorted(range(len(cols)), key=cols.__getitem__)
    return sorted("|".join(norm(r[i]) for i in ix) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    r = con.execute(SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon(df.columns, [tuple(x) for x in df.collect()]) == canon(cols, r.fetchall())
