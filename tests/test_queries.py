"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from driftline.plans.catalogue import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Windows that are too long for the smallest tables leave nothing to compare; draws take long, and test_robust.py and test_draws.py have their operators.
SLOW = {"walk_forward", "walk_forward_rate", "walk_forward_sign", "block_bootstrap", "seed_stability", "sup_t_band", "ladder_trend", "stationary_bootstrap", "reality_check", "joint_null", "auc_bootstrap"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    df = entry.entry(spark)
    assert {"target", "accuracy"} <= set(df.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
