"""Catalogue queries against DuckDB on the smallest tables, a few of each kind (the driver compares all of them)."""

import os

import duckdb
import pytest

from lakeglass import catalog

DIR = "/root/testdata/sf0.001"
NAMES = ["flt_or", "qry_group_agg", "kpi_metrics", "abc_rows", "histogram", "ts_week", "ts_gapfill", "rfm_customers", "cohort_matrix", "churn_summary", "forecast_holt", "clean_ffill", "correlation"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), c.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(plain_rows(got), key=key) == sorted(plain_rows(want), key=key)


def plain_rows(d):
    import pandas as pd

    return [tuple(None if pd.isna(x) else round(float(x), 2) if hasattr(x, "__float__") else str(x) for x in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False)]
