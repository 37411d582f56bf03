"""Stationary resamples, the check of the best, joint nulls, weighted areas and regressions against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.functions import normal
from driftline.operators import inference, models, resample


def blocks(spark, n, draws, block, kind, seed=12345):
    return resample.circular_starts(spark.createDataFrame([(n,)], "n long"), draws, block, kind, seed).toPandas()


def rows_by_draw(st, n):
    return {d: np.concatenate([np.arange(a, b) % n for a, b in zip(g["start"], g["stop"])]) for d, g in st.groupby("draw")}


@pytest.mark.parametrize("kind", ["restart", "geometric"])
def test_stationary_blocks(spark, kind):
    n, block = 300, 20
    st = blocks(spark, n, 400, block, kind)
    rows = rows_by_draw(st, n)
    assert len(rows) == 400 and all(len(r) == n for r in rows.values())
    assert st["start"].between(0, n - 1).all() and ((st["stop"] - st["start"]) >= 1).all() and (st["stop"] > n).any()
    # Blocks have the mean length, all rows are drawn alike, and a block's start tells nothing of its length.
    per = st.groupby("draw").size()
    assert abs(per.mean() - (1 + (n - 1) / block)) < 0.6
    used = np.bincount(np.concatenate(list(rows.values())), minlength=n)
    assert abs(used.reshape(10, -1).sum(1) / used.sum() - 0.1).max() < 0.02
    size = (st["stop"] - st["start"]).to_numpy()
    assert abs(np.corrcoef(st["start"], size)[0, 1]) < 0.05
    # Geometric: the chance to go on does not depend on how long a block is.
    assert abs((size > 10).mean() - (1 - 1 / block) ** 10) < 0.04 and abs((size > 30).mean() - (1 - 1 / block) ** 30) < 0.04


@pytest.mark.parametrize("kind", ["restart", "geometric"])
def test_sums_over_circular_blocks(spark, kind):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 61))
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "t": np.arange(61), "x": x, "y": y}))
    rows = rows_by_draw(blocks(spark, 61, 50, 7, kind, 3), 61)
    got = resample.block_sums(df, ["g"], ["x", "y"], 50, 7, 3, kind).collect()
    assert len(got) == 50
    for r in got:
        assert abs(r["x"] - x[rows[r["draw"]]].sum()) < 1e-9 and abs(r["y"] - y[rows[r["draw"]]].sum()) < 1e-9
    m = resample.mean(df, ["g"], "x", 50, 7, 3, kind).head()
    lo, hi = np.percentile([x[r].mean() for r in rows.values()], [2.5, 97.5])
    assert abs(m["lo"] - lo) < 1e-9 and abs(m["hi"] - hi) < 1e-9


def test_unknown_blocks(spark):
    with pytest.raises(ValueError):
        resample.circular_starts(spark.createDataFrame([(9,)], "n long"), 2, 3, "other")
    with pytest.raises(ValueError):
        resample.circular_starts(spark.createDataFrame([(9,)], "n long"), 2, 1, "geometric")


def test_scrambled_numbers_are_the_same_in_arrays(spark):
    want = [r[0] for r in spark.range(300).select(resample.scrambled(F.col("id") * 1_000_003, 77)).collect()]
    assert resample.scrambled_array(np.arange(300) * 1_000_003, 77).tolist() == want
    st = resample.starts(spark.createDataFrame([(103,)], "n long"), 9, 10, 4).orderBy("draw", "b").collect()
    rows = resample.rows_drawn(103, np.arange(9), 10, 4)
    for d in range(9):
        assert rows[d].tolist() == [i for r in st if r["draw"] == d for i in range(r["start"], r["stop"])]


def lrv(x, band):
    e = x - x.mean()
    return e @ e / len(x) + 2 * sum((1 - k / (band + 1)) * (e[k:] @ e[:-k]) / len(x) for k in range(1, min(band, len(x) - 1) + 1))


def test_bartlett_is_the_weighted_sum_of_lag_products():
    rng = np.random.default_rng(1)
    Z = rng.normal(size=(5, 40)).cumsum(1)
    for band in (0, 1, 7, 39, 60):
        assert np.allclose(inference.bartlett(Z, band), [lrv(z, band) for z in Z])


def test_check_of_the_best_by_plain_loops(spark):
    rng = np.random.default_rng(4)
    D = rng.normal(size=(150, 4)) + [0.1, 0.0, -0.1, -3.0]
    rows = [("g", f"m{m}", t, float(D[t, m])) for m in range(4) for t in range(150)]
    got = inference.reality_check(spark.createDataFrame(rows, "g string, model string, t int, d double"), ["g"], 60, 12).head()
    mean = D.mean(0)
    keep = [mean[m] >= -math.sqrt(lrv(D[:, m], 12)) * math.sqrt(2 * math.log(math.log(150))) / math.sqrt(150) for m in range(4)]
    every, some, top = 0, 0, math.sqrt(150) * mean.max()
    for sel in rows_by_draw(blocks(spark, 150, 60, 12, "restart", 7), 150).values():
        b = D[sel].mean(0)
        every += max(math.sqrt(150) * (b - mean)) >= top
        some += max(math.sqrt(150) * (b[m] - mean[m] * keep[m]) for m in range(4)) >= top
    assert keep == [True, True, True, False] and got["kept"] == 3 and got["models"] == 4 and 0 < every < 60
    assert abs(got["p_reality"] - every / 60) < 1e-12 and abs(got["p_spa"] - some / 60) < 1e-12 and abs(got["statistic"] - top) < 1e-9


def test_joint_null_by_plain_loops(spark):
    """Three rules on the same draws; groups differ in length, strong cells are hits, short ones don't fail."""
    rng = np.random.default_rng(5)
    cells = [(f"c{g}{i}", rng.normal(size=n).cumsum() * 0.1 + rng.normal(size=n) + (1.5 if i == 0 else 0.0), 3 + i, 2.4) for g, n in enumerate((80, 131, 17)) for i in range(3)]
    df = spark.createDataFrame([(c, [float(v) for v in x], b, v) for c, x, b, v in cells], "cell_id string, series array<double>, bandwidth int, critical_value double")
    draws = 60
    got = {r["rule"]: r for r in inference.joint_null(df, draws, 15, 8).collect()}

    def absolute(seed):
        out = {}
        for c, x, band, _ in cells:
            rows = resample.rows_drawn(len(x), np.arange(draws), inference.whole_blocks(len(x), 15, band), seed)
            z = x - x.mean()
            out[c] = np.array([abs(z[r].mean()) / math.sqrt(lrv(z[r], band) / len(x)) for r in rows])
        return out

    t, other = absolute(8), absolute(8 + 7777)
    seen = {c: abs(x.mean()) / math.sqrt(lrv(x, b) / len(x)) for c, x, b, _ in cells}
    for rule, limit in {"A": lambda c, v: inference.Z95, "B": lambda c, v: v, "C": lambda c, v: np.percentile(other[c], 95)}.items():
        hits = sum((t[c] > limit(c, v)).astype(int) for c, _, _, v in cells)
        real = sum(seen[c] > limit(c, v) for c, _, _, v in cells)
        r = got[rule]
        assert r["cells"] == 9 and r["hits"] == real >= 2 and abs(r["null_mean"] - hits.mean()) < 1e-9 and abs(r["p"] - (1 + (hits >= real).sum()) / (draws + 1)) < 1e-12
        assert (r["bound"] is None) == bool((hits >= real).any())
    # The third rule is right in size by construction; the others are not.
    assert abs(got["C"]["null_mean"] / 9 - 0.05) < 0.05


def test_blocks_end_after_the_band():
    for n in (17, 80, 131, 2357):
        for band in (3, 12):
            x = inference.whole_blocks(n, 60, band)
            assert min(60, n // 4) <= x <= n and (n % x == 0 or n % x > band)


def test_fixed_band_exceeds_the_normal(spark):
    r = spark.range(1).select(inference.fixed_band(F.lit(1000), F.lit(0)).alias("a"), inference.fixed_band(F.lit(100), F.lit(24)).alias("b")).head()
    assert abs(r["a"] - 1.96296) < 1e-4 and 2.6 < r["b"] < 2.8


def area(y, f):
    pos, neg = f[y == 1], f[y == 0]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


def test_weighted_areas_are_areas_of_drawn_rows(spark):
    rng = np.random.default_rng(6)
    n, block, draws = 70, 9, 40
    y = (rng.random(n) < 0.4).astype(int)
    own, cross = np.round(y + rng.normal(size=n), 1), np.round(2 * y + rng.normal(size=n), 1)
    df = spark.createDataFrame([("g", t, int(y[t]), float(own[t]), float(cross[t])) for t in range(n)] + [("g", n, None, 1.0, 2.0), ("short", 0, 1, 1.0, 1.0)], "g string, t int, y int, own double, cross double")
    got = resample.area_difference(df, ["g"], draws, block, 3).collect()
    diff = [area(y[r], cross[r]) - area(y[r], own[r]) for r in resample.rows_drawn(n, np.arange(draws), block, 3)]
    assert len(got) == 1 and got[0]["n"] == n and got[0]["draws"] == draws
    assert abs(got[0]["own"] - area(y, own)) < 1e-12 and abs(got[0]["cross"] - area(y, cross)) < 1e-12
    assert abs(got[0]["lo"] - np.percentile(diff, 2.5)) < 1e-12 and abs(got[0]["hi"] - np.percentile(diff, 97.5)) < 1e-12
    assert np.isnan(resample.weighted_area(np.ones(5), np.arange(5.0), np.ones((1, 5)))).all()


def test_least_squares_with_long_run_errors(spark):
    rng = np.random.default_rng(8)
    n, band = 90, 6
    x = rng.normal(size=n).cumsum()
    y = 1 - 0.4 * x + rng.normal(size=n).cumsum() * 0.3
    rows = [("g", t, float(x[t]), float(y[t])) for t in range(n)] + [("g", n, None, 1.0)]
    got = models.ols_hac(spark.createDataFrame(rows, "g string, t int, x double, y double"), ["g"], "x", "y", band).head()
    A = np.column_stack([np.ones(n), x])
    inv = np.linalg.inv(A.T @ A)
    b = inv @ A.T @ y
    s = A * (y - A @ b)[:, None]
    M = s.T @ s + sum((1 - k / (band + 1)) * (s[k:].T @ s[:-k] + s[:-k].T @ s[k:]) for k in range(1, band + 1))
    se = np.sqrt(np.diag(inv @ M @ inv))
    assert got["n"] == n and np.allclose([got["intercept"], got["slope"], got["intercept_se"], got["slope_se"]], [*b, *se])


def test_normal_tail_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    zs = [0.0, 0.3, -1.96, 3.4999, 3.5, 6.0, -9.5]
    want = [math.erfc(abs(z) / math.sqrt(2)) for z in zs]
    got = [duckdb.sql(f"SELECT {normal.two_sided_sql('z')} FROM (SELECT {z}::double AS z)").fetchall()[0][0] for z in zs]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-300)
    sp = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal.two_sided(F.col("z"))).collect()]
    assert np.allclose(sp, want, rtol=1e-9, atol=1e-300)
