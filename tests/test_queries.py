"""Every query against its SQL, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quarry.plans.catalogue import QUERIES, SQL

DATA = os.environ.get("QUARRY_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return round(float(v), 9) if isinstance(v, float) else str(v)

    return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        for c in set(got.columns) & set(want.columns):  # whole numbers that pandas made fractions for nulls
            if pd.api.types.is_float_dtype(got[c]) != pd.api.types.is_float_dtype(want[c]):
                got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0
