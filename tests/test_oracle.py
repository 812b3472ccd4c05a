"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from parlance import registry

SF = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("conversations", "documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    got = _sorted(registry.queries()[name](spark, SF).toPandas())
    if name not in SQL:
        assert len(got) > 0
        return
    want = _sorted(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=2e-6)
