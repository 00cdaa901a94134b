"""Every query of the package against its SQL twin in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from pulsegrid import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    return x.item() if hasattr(x, "item") else x


def rows(df):
    out = [tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(out, key=lambda r: [(str(type(x).__name__ in ("int", "float")), float(x) if isinstance(x, (int, float)) else 0.0, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_no_nested_loops(spark, sf_dir):
    """Range joins are planned as equi-joins."""
    for name in ("restrict_points_to_periods", "period_select_with_duplicates", "intersect_periods_raw", "correlogram_counts", "within_ranges_matrix", "nearest_samples_map"):
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
