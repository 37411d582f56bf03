"""Filters, correlation structure, damaged series, regimes of another series and other scales, against plain loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.functions import features, frames
from driftline.operators import breaks, filters, models, panel, scoring, walkforward
from driftline.params import Params

DAY = dt.date(2020, 1, 1)


def latent(seed, n=260):
    rng = np.random.default_rng(seed)
    f = np.zeros(n)
    for t in range(1, n):
        f[t] = 0.9 * f[t - 1] + rng.normal()
    a = f + rng.normal(size=n) * 0.8
    a[rng.random(n) < 0.05] = np.nan
    return a


def long_rows(spark, data):
    rows = [(s, t, None if np.isnan(v) else float(v)) for s, a in data.items() for t, v in enumerate(a)]
    return spark.createDataFrame(rows, "series_id string, t int, a double").repartition(3)


def moments(x):
    x = x[np.isfinite(x)]
    v, n = x - x.mean(), len(x)
    g = [v @ v / n, v[1:] @ v[:-1] / n, v[2:] @ v[:-2] / n]
    phi = min(max(g[2] / g[1], 0.0), 0.999)
    level = max(g[1] / phi if phi > 1e-9 else 0.0, 1e-12)
    return phi, level * (1 - phi * phi), max(g[0] - level, 1e-9)


def filtered(a, phi, q, r):
    x, p, out = 0.0, q / max(1 - phi * phi, 1e-6), []
    for v in a:
        x, p = phi * x, phi * phi * p + q
        if np.isfinite(v):
            k = p / (p + r)
            x, p = x + k * (v - x), (1 - k) * p
        out.append(x)
    return np.array(out)


def test_vintages_and_states_against_loops(spark):
    data = {"u": latent(1), "v": latent(2, 200), "w": latent(3, 40)}
    df = long_rows(spark, data)
    got = {(r["series_id"], r["made"]): r for r in filters.vintages(df, 60, 70).collect()}
    assert set(got) == {("u", 60), ("u", 130), ("u", 200), ("v", 60), ("v", 130)}
    for (s, made), r in got.items():
        assert np.allclose([r["phi"], r["q"], r["r"]], moments(data[s][:made]), atol=1e-9) and r["n"] == np.isfinite(data[s][:made]).sum()
    live = {(r["series_id"], r["t"]): r for r in filters.live_states(df, 60, 70, 2).collect()}
    assert set(live) == {(s, t) for s in "uv" for t in range(62, len(data[s]))}
    paths = {k: filtered(data[k[0]], *moments(data[k[0]][: k[1]])) for k in got}
    for (s, t), r in live.items():
        made = max(m for k, m in got if k == s and m <= t - 2)
        assert r["made"] == made and abs(r["state"] - paths[s, made][t]) < 1e-9


def test_filter_tracks_the_state(spark):
    rng = np.random.default_rng(4)
    f = np.zeros(3000)
    for t in range(1, 3000):
        f[t] = 0.95 * f[t - 1] + rng.normal()
    a = f + 3 * rng.normal(size=3000)
    df = long_rows(spark, {"s": a})
    p = filters.vintages(df, 2999, 5000).head()
    assert abs(p["phi"] - 0.95) < 0.03 and 6 < p["r"] < 12
    s = filters.states(df, filters.vintages(df, 1500, 5000)).toPandas().sort_values("t")["state"].to_numpy()
    assert ((s - f)[1500:] ** 2).mean() < 0.6 * ((a - f)[1500:] ** 2).mean()
    assert filters.live_states(df.limit(0), 10, 10, 1).count() == 0


def test_structure_stability_against_loops(spark):
    rng = np.random.default_rng(6)
    n, k, win, gap, least = 120, 4, 30, 10, 15
    X = rng.normal(size=(n, 1)) + rng.normal(size=(n, k)) * [0.5, 1, 1.5, 2]
    X[rng.random((n, k)) < 0.04] = np.nan
    rows = [("g", t, f"s{i}", None if np.isnan(X[t, i]) else float(X[t, i])) for t in range(n) for i in range(k)]
    got = {r["t"]: r for r in scoring.structure_stability(spark.createDataFrame(rows, "g string, t int, series_id string, a double"), ["g"], win, gap, least).collect()}
    upper = np.triu_indices(k, 1)

    def corr_at(end):
        if end < win:
            return None
        W = X[end - win : end]
        W = W[np.isfinite(W).all(1)]
        return np.corrcoef(W, rowvar=False)[upper] if len(W) >= least else None

    want = {t: np.corrcoef(corr_at(t), corr_at(t - gap))[0, 1] for t in range(n) if corr_at(t) is not None and t >= gap and corr_at(t - gap) is not None}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[t]["stability"] - v) < 1e-8 and got[t]["pairs"] == 6 for t, v in want.items())


def test_leave_one_out_against_refits(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=9)
    y = 2 * x + rng.normal(size=9) + 1
    df = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in range(9)] + [(9, None, 1.0)], "id int, x double, y double")
    got = {r["id"]: r for r in scoring.leave_one_out(df, "x", "y").collect()}
    A = np.column_stack([np.ones(9), x])
    hat = np.diag(A @ np.linalg.inv(A.T @ A) @ A.T)
    assert len(got) == 9
    for i in range(9):
        m = np.arange(9) != i
        b, a = np.polyfit(x[m], y[m], 1)
        assert np.allclose([got[i]["without"], got[i]["slope"], got[i]["crossing"], got[i]["leverage"]], [np.corrcoef(x[m], y[m])[0, 1], b, -a / b, hat[i]])


def bars_of(spark, data):
    rows = [(s, DAY + dt.timedelta(days=d), c * 0.99, c * 1.02, c * 0.97, c) for s, xs in data.items() for d, c in xs]
    return spark.createDataFrame(rows, "series_id string, date date, open double, high double, low double, close double")


def test_splice_is_scaled_and_carried(spark):
    b = bars_of(spark, {"x": [(d, 100.0 + d) for d in range(10)], "y": [(d, 10.0 + d * d) for d in (3, 4, 6, 9)]})
    got = breaks.spliced(b.where("series_id = 'x'").withColumn("tag", F.lit("k")), b.where("series_id = 'y'"), F.floor(F.col("n") / 2)).orderBy("date").collect()
    other = {3: 19.0, 4: 26.0, 5: 26.0, 6: 46.0, 7: 46.0, 8: 46.0, 9: 91.0}
    scale = 104.0 / 26.0
    assert [r["close"] for r in got[:5]] == [100.0 + d for d in range(5)]
    assert all(abs(got[d]["close"] - other[d] * scale) < 1e-9 and abs(got[d]["high"] - other[d] * 1.02 * scale) < 1e-9 and got[d]["tag"] == "k" for d in range(5, 10))
    first = breaks.spliced(b.where("series_id = 'x'"), b.where("series_id = 'y'"), F.lit(2)).orderBy("date").collect()
    assert abs(first[2]["close"] - 19.0 * 101.0 / 19.0) < 1e-9  # before the other begins its first value is carried back
    same = breaks.spliced(b.where("series_id = 'x'"), b.where("series_id = 'none'"), F.lit(2))
    assert {r["close"] for r in same.collect()} == {100.0 + d for d in range(10)}


def test_smoothing_is_undone(spark):
    rng = np.random.default_rng(3)
    true = rng.normal(size=200) * 0.05
    r = np.zeros(200)
    for t in range(200):
        r[t] = 0.6 * (r[t - 1] if t else 0.0) + 0.4 * true[t]
    rows = [("m", DAY + dt.timedelta(days=31 * t), float(r[t])) for t in range(200)] + [("few", DAY + dt.timedelta(days=31 * t), float(r[t])) for t in range(10)]
    d = breaks.desmoothed(spark.createDataFrame(rows, "series_id string, month date, r double"), 150).toPandas().sort_values("month")
    m = d[d["series_id"] == "m"]
    rho = np.corrcoef(r[:149], r[1:150])[0, 1]
    assert np.allclose(m["rho"], rho) and abs(rho - 0.6) < 0.15
    assert np.allclose(m["sharp"].iloc[1:], (r[1:] - rho * r[:-1]) / (1 - rho)) and np.isnan(m["sharp"].iloc[0])
    assert np.corrcoef(m["sharp"].iloc[1:], true[1:])[0, 1] > 0.97
    assert (d[d["series_id"] == "few"]["rho"] == 0).all()


def test_seasonal_placebo_against_loops(spark):
    rng = np.random.default_rng(2)
    n = 140
    x = rng.normal(size=n)
    x[rng.random(n) < 0.1] = np.nan
    month = (np.arange(n) // 2) % 12 + 1
    idx = [t for t in range(60, 135) if t % 9 != 4]
    pos = {t: j for j, t in enumerate(idx)}
    rows = [("g", t, int(month[t]), None if np.isnan(x[t]) else float(x[t]), pos.get(t)) for t in range(n)]
    df = spark.createDataFrame(rows, "target string, t int, month int, x double, j long")
    got = {r["t"]: r["placebo"] for r in breaks.seasonal_placebo(df, 12).collect()}

    def mean(m, upto):
        v = x[:upto][(month[:upto] == m) & np.isfinite(x[:upto])]
        return v.mean() if len(v) >= 3 else None

    assert len(got) == n
    for t in range(n):
        refit = idx[pos[t] - pos[t] % 12] if t in pos else idx[0]
        want = mean(month[t], refit)
        assert (got[t] is None) == (want is None) and (want is None or abs(got[t] - want) < 1e-12)


def test_another_series_as_of_the_row_before(spark):
    v = spark.createDataFrame([("o", DAY + dt.timedelta(days=d), float(d)) for d in range(0, 30, 2)] + [("t", DAY + dt.timedelta(days=d), 0.0) for d in range(30)], "series_id string, date date, a double")
    cal = v.where("series_id = 't'").select(F.col("series_id").alias("target"), "date")
    s = panel.second_series(v, "o", cal)
    got = {r["t"]: r["v"] for r in s.collect()}
    assert got[0] is None and got[1] == 0.0 and got[2] == 0.0 and got[3] == 2.0 and got[29] == 28.0
    g = {r["t"]: r for r in panel.rungs(s, {"high": 0.5, "top": 0.9}, 10, 4).collect()}
    assert g[3]["high"] is None and g[13]["high"] and g[13]["top"] and not g[13]["base"] and not g[12]["top"]


def test_losses_on_other_scales(spark):
    rng = np.random.default_rng(1)
    n = 60
    y, f = rng.normal(size=(2, n)) * 0.5
    m0, mh, bv = np.exp(rng.normal(size=(3, n)) * 0.2)
    df = spark.createDataFrame(pd.DataFrame({"target": "g", "arm": "own", "delta": 0, "t": np.arange(n), "y": y, "f": f, "m0": m0, "mh": mh, "bench_var": bv}))
    s = scoring.smear(df, 20, 1)
    sm = {r["t"]: r["smear"] for r in s.collect()}
    want = [np.exp(y - f)[max(0, t - 21) : t - 1].mean() if t > 1 else 1.0 for t in range(n)]
    assert np.allclose([sm[t] for t in range(n)], want)
    r = scoring.scale_losses(s).head()
    v, h = np.exp(y), np.exp(f) * want
    assert np.allclose([r["qlike"], r["mse"], r["natural"], r["unweighted"]], [(v / h - np.log(v / h) - 1).mean(), ((v - h) ** 2).mean(), ((v * mh - h * m0) ** 2).mean(), ((v * mh - h * mh) ** 2).mean()])
    assert np.isclose(r["natural_skill"], 1 - ((v * mh - h * m0) ** 2).sum() / ((v * mh - bv * m0) ** 2).sum()) and np.isclose(r["qlike_skill"], 1 - (v / h - np.log(v / h) - 1).sum() / (v / bv - np.log(v / bv) - 1).sum())


def test_slow_measure_and_late_peers(spark):
    df = spark.createDataFrame([("s", t, math.exp(t / 10), 2.0 + t, [float(t)]) for t in range(40)], "series_id string, t int, short double, long double, peers array<double>")
    w = frames.ordered("series_id")
    m = features.measures(F.col("short"), F.col("long"), w, 9, 5)
    got = df.select("t", *[c.alias(k) for k, c in m.items()], features.gapped(F.col("peers"), w, 3).alias("late"), features.gapped(F.col("peers"), w, 0).alias("now")).orderBy("t").collect()
    assert got[3]["slow"] is None and abs(got[20]["slow"] - math.log(22 / 18)) < 1e-12 and abs(got[20]["level"] - 1.6) < 1e-12
    assert got[2]["late"] is None and got[5]["late"] == [2.0] and got[5]["now"] == [5.0]


@pytest.mark.parametrize("n", [1, 3])
def test_few_points(spark, n):
    r = scoring.leave_one_out(spark.createDataFrame([(i, float(i), 1.0) for i in range(n)], "id int, x double, y double"), "x", "y").collect()
    assert len(r) == n and all(x["without"] is None for x in r)


def ragged_loop(obs, par, delta):
    """The filter as textbook updates, one origin and one series at a time."""
    z = (obs - par["mu"]) / par["sd"]

    def step(x, p, row, cols):
        x, p = par["phi"] * x, par["phi"] ** 2 * p + par["q"]
        for i in cols:
            if np.isfinite(row[i]):
                k = p * par["lam"][i] / (par["lam"][i] ** 2 * p + par["r"][i])
                x, p = x + k * (row[i] - par["lam"][i] * x), (1 - k * par["lam"][i]) * p
        return x, p

    states, x, p = [], 0.0, par["q"] / (1 - par["phi"] ** 2)
    for row in z:
        x, p = step(x, p, row, range(z.shape[1]))
        states.append((x, p))
    out = np.full(len(z), np.nan)
    for t in range(delta, len(z)):
        x, p = states[t - delta]
        for u in range(t - delta + 1, t + 1):
            x, p = step(x, p, z[u], range(1, z.shape[1]))
        out[t] = x
    return out


def factor_data(n=220):
    rng = np.random.default_rng(12)
    g = np.zeros(n)
    for t in range(1, n):
        g[t] = 0.9 * g[t - 1] + rng.normal()
    X = g[:, None] * [1, 0.8, 1.2, 0.6] + rng.normal(size=(n, 4))
    X[rng.random((n, 4)) < 0.03] = np.nan
    return X


def test_ragged_factor_against_textbook_updates(spark):
    X = factor_data()
    par = models.factor_parameters(X)
    for d in (0, 1, 7):
        assert np.allclose(models.kalman(X, par, d), ragged_loop(X, par, d), equal_nan=True, atol=1e-9)
    val = lambda v: None if np.isnan(v) else float(v)
    rows = spark.createDataFrame([("g", t, [val(X[t, 0])], [val(v) for v in X[t, 1:]]) for t in range(len(X))], "target string, t int, own array<double>, peers array<double>")
    got = {(r["delta"], r["t"]): r for r in filters.factor_states(rows, (0, 3), 80, 50, 2, least=60).collect()}
    for d in (0, 3):
        for t in range(len(X)):
            made = max([m for m in (80, 130, 180) if m <= t - d - 2], default=None)
            assert ((d, t) in got) == (made is not None)
            if made:
                assert got[d, t]["made"] == made and abs(got[d, t]["state"] - ragged_loop(X, models.factor_parameters(X[:made]), d)[t]) < 1e-9
    frozen = {(r["delta"], r["t"]): r["state"] for r in filters.factor_states(rows, (3,), 80, None, 2, least=60).collect()}
    want = ragged_loop(X, models.factor_parameters(X[:80]), 3)
    assert len(frozen) == len(X) - 3 and all(abs(v - want[t]) < 1e-9 for (_, t), v in frozen.items())
    assert filters.factor_states(rows, (0,), 80, 50, 2, least=500).count() == 0


def test_rows_with_a_delay_each_are_walked_as_they_are(spark):
    p = Params(horizon=1, median=5, train=60, val=20, refit=10, delays=(0, 2), min_train=30)
    a = np.nan_to_num(latent(8, 200))
    rows = spark.createDataFrame([("g", t, [float(a[t])], [0.0], float(a[t + 1]) if t < 199 else None, 0.0) for t in range(200)], "target string, t int, own array<double>, peers array<double>, y double, bench double")
    one = {(r["delta"], r["t"]): r["f"] for r in walkforward.walk(rows, p, arms=("own",)).collect()}
    two = {(r["delta"], r["t"]): r["f"] for r in walkforward.walk(walkforward.stale_rows(rows, p), p, arms=("own",)).collect()}
    assert one == two and len(one) > 100
