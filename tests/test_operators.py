"""Traps of panels and walk-forward, identities, closed forms and recoveries on generated series."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import frames, normal
from driftline.operators import audit, breaks, inference, models, panel, resample, scoring, walkforward
from driftline.params import Params
from driftline.sources import bars, generators, provenance

DAY = dt.date(2024, 1, 1)


def days(spark, rows):
    return spark.createDataFrame([(s, DAY + dt.timedelta(days=d), v) for s, d, v in rows], "series_id string, date date, a double")


def test_median_needs_its_count(spark):
    df = spark.createDataFrame([("s", t, float(t)) for t in range(35)], "series_id string, t int, x double")
    got = [r[0] for r in df.select(frames.median(F.col("x"), frames.ordered("series_id"), 252, 30)).collect()]
    assert got[28] is None and got[29] == 14.5


def test_fill_is_five_rows_of_the_own_calendar(spark):
    rows = [("T", d, 1.0) for d in range(8)] + [("P", 0, 5.0)]
    cal = days(spark, rows).where("series_id = 'T'").select(F.col("series_id").alias("target"), "date")
    got = {r["t"]: r["a"] for r in panel.fill_reindex(days(spark, rows), cal).where("series_id = 'P'").collect()}
    assert got[5] == 5.0 and got[6] is None


def test_reindex_loses_what_union_carries(spark):
    rows = [("T", 0, 1.0), ("T", 2, 1.0), ("P", 1, 7.0)]
    cal = days(spark, rows).where("series_id = 'T'").select(F.col("series_id").alias("target"), "date")
    lost = panel.fill_reindex(days(spark, rows), cal).where("series_id = 'P'").orderBy("t").collect()
    kept = panel.fill_union(days(spark, rows), targets=["T"]).where("series_id = 'P'").orderBy("t").collect()
    assert [r["a"] for r in lost] == [None, None] and [r["a"] for r in kept] == [None, 7.0]


def test_equal_close_counts_as_later(spark):
    rows = [(s, d, 10.0 * d) for s in "TPQ" for d in range(3)]
    conv = spark.createDataFrame([("T", 21.0), ("P", 21.0), ("Q", 8.0)], "series_id string, close_utc double")
    got = panel.admissible(panel.fill_union(days(spark, rows), targets=["T"]), conv)
    at = {(r["series_id"], r["t"]): r["a"] for r in got.collect()}
    assert at["P", 1] == 0.0 and at["Q", 1] == 10.0 and at["T", 1] == 10.0


def test_order_guard_and_seam(spark):
    f = spark.createDataFrame([(0, 1, DAY), (0, 2, DAY + dt.timedelta(days=1)), (1, 1, DAY + dt.timedelta(days=9)), (1, 2, DAY), (1, 3, DAY + dt.timedelta(days=5))], "file int, at int, date date")
    assert {r["file"]: r["monotone"] for r in audit.file_order(f).collect()} == {0: True, 1: False}
    c = spark.createDataFrame([("s", DAY + dt.timedelta(days=k), 100.0 + (k == 3 and j) * 1.0, j) for k in range(25) for j in (0, 1)], "series_id string, date date, close double, chunk int")
    r = audit.seam(c).head()
    assert (r["shared"], r["mismatched"], r["verdict"]) == (25, 1, "MISMATCH")
    assert audit.seam(c.where("date < '2024-01-10'")).head()["verdict"] == "UNVERIFIABLE"


def test_reads_retail_files(spark, tmp_path):
    (tmp_path / "x_a.csv").write_text('Date,Price,Open,High,Low,Vol.,Change %\n"01/02/2024","1,000.5","1,000","1,001","999",,1%\n"01/03/2024","bad","1","1","1",,\n"01/02/2024","7","7","7","7",,\n')
    got = bars.read_bars(spark, str(tmp_path / "x_a.csv")).collect()
    assert [(str(r["date"]), r["close"]) for r in got] == [("2024-01-02", 1000.5)]
    assert bars.matching(["d/DAX New Volatility.csv", "d/DAX_a.csv"], "dax", ("volatility",)) == ["d/DAX_a.csv"]


P = Params(horizon=1, train=150, val=50, refit=10, delays=(0, 3, 6), min_train=100)


@pytest.fixture(scope="module")
def factor_rows(spark):
    f = generators.factor_panel(spark, 700, seed=4)
    w = Window.partitionBy("panel").orderBy("t")
    wide = f.groupBy("panel", "t").pivot("series_id", [f"S{i}" for i in range(7)]).agg(F.first("a"))
    rows = wide.select(F.col("panel").cast("string").alias("target"), "t", F.array("S0").alias("own"), F.array(*[f"S{i}" for i in range(1, 7)]).alias("peers"), F.lead("S0").over(w).alias("y"), F.lit(0.0).alias("bench"))
    return rows.persist()


def loop_walk(rows, delta, arm, kind="ridge"):
    """The walk by plain loops, with fitters of its own."""
    nan = lambda v: np.nan if v is None else v
    own, peers = (np.array([[nan(x) for x in r[c]] for r in rows]) for c in ("own", "peers"))
    y = np.array([nan(r["y"]) for r in rows], float)
    x_of = lambda t: own[t - delta] if arm == "own" else np.concatenate([own[t - delta], peers[t]])

    def fitted(X, y, lam):
        A = np.column_stack([np.ones(len(X)), X])
        P = lam * np.diag([0.0] + [1.0] * X.shape[1])
        if kind == "ridge":
            return np.linalg.solve(A.T @ A + P, A.T @ y)
        b = np.zeros(A.shape[1])
        for _ in range(60):  # plain Newton: these designs are well behaved
            mu = 1 / (1 + np.exp(-A @ b))
            b = b - np.linalg.solve(A.T @ (A * (mu * (1 - mu))[:, None]) + P, A.T @ (mu - y) + P @ b)
        return b

    idx = [t for t in range(P.median + P.span + max(P.delays) + P.horizon, len(y)) if np.isfinite(y[t])]
    out, coef = {}, None
    for j, t in enumerate(idx):
        if j % P.refit == 0:
            cut = max(0, t - delta - P.horizon)
            us = [u for u in range(max(0, cut - P.span), cut) if u - delta >= 0 and np.isfinite(y[u]) and np.isfinite(x_of(u)).all()]
            coef = None
            if len(us) >= P.min_train:
                X, v = np.stack([x_of(u) for u in us]), y[us]
                mu, sd = X.mean(0), X.std(0) + 1e-9
                Z, best, lam = (X - mu) / sd, -np.inf, P.lambdas[2]
                for g in P.lambdas if len(us) > P.val + 50 else ():
                    s = np.column_stack([np.ones(P.val), Z[-P.val :]]) @ fitted(Z[: -P.val], v[: -P.val], g)
                    s = -((s - v[-P.val :]) ** 2).mean() if kind == "ridge" else ((s > 0) == (v[-P.val :] > 0.5)).mean()
                    if s > best:
                        best, lam = s, g
                coef = mu, sd, fitted(Z, v, lam)
        f = np.nan if coef is None else coef[2][0] + (x_of(t) - coef[0]) / coef[1] @ coef[2][1:]
        if kind != "ridge":
            f = 1 / (1 + np.exp(-f))
        out[t] = (0.0 if kind == "ridge" else 0.5) if np.isnan(f) else f
    return out


def with_holes(factor_rows):
    """A peer is missing for a while and now and then, own values are NaN on some rows, labels on others."""
    hole = F.col("t").between(300, 420) | (F.col("t") % 17 == 3)
    peers = F.when(hole, F.concat(F.slice("peers", 1, 5), F.array(F.lit(None).cast("double")))).otherwise(F.col("peers"))
    return factor_rows.withColumn("peers", peers).withColumn("own", F.when(F.col("t") % 41 == 5, F.array(F.lit(float("nan")))).otherwise(F.col("own"))).withColumn("y", F.when(F.col("t") % 29 != 7, F.col("y")))


@pytest.mark.parametrize("holes", [False, True])
def test_walk_matches_loops_and_never_leaks(spark, factor_rows, holes):
    data = with_holes(factor_rows) if holes else factor_rows
    rows = data.orderBy("t").collect()
    got = walkforward.walk(data, P).collect()
    for delta in P.delays:
        for arm in walkforward.ARMS:
            want = loop_walk(rows, delta, arm)
            have = {r["t"]: r["f"] for r in got if r["arm"] == arm and r["delta"] == delta}
            assert have.keys() == want.keys() and all(abs(have[t] - f) < 1e-8 for t, f in want.items())
    if holes:  # the cross arm has gaps of its own; the own arm keeps its rows
        back = {a: sum(r["f"] == 0 for r in got if r["arm"] == a and r["delta"] == 0) for a in walkforward.ARMS}
        assert back["cross"] > back["own"] > 0
    assert all(r["late"] == 0 for r in walkforward.leaks(data, P).collect())
    bad = walkforward.leaks(data, P, extra_purge=-P.horizon - 1).collect()
    assert any(r["late"] > 0 for r in bad)


def test_logistic_walk_matches_loops(spark, factor_rows):
    data = with_holes(factor_rows).withColumn("y", F.when(F.col("y").isNotNull(), (F.col("y") > 0).cast("double")))
    rows = data.orderBy("t").collect()
    got = walkforward.walk(data, P, "logistic").where("delta = 3").collect()
    for arm in walkforward.ARMS:
        want = loop_walk(rows, 3, arm, "logistic")
        have = {r["t"]: r["f"] for r in got if r["arm"] == arm}
        assert have.keys() == want.keys() and all(abs(have[t] - f) < 1e-7 for t, f in want.items())


def test_logistic_is_the_maximum():
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 4))
    y = (X @ [1, -1, 0.5, 0] + rng.logistic(size=300) > 0.3).astype(float)
    b = models.logistic(X, y, 2.0)
    slope = np.column_stack([np.ones(300), X]).T @ (models.chance(b, X) - y) + 2.0 * np.r_[0, b[1:]]
    assert np.abs(slope).max() < 1e-6
    flat = models.logistic(np.column_stack([X, np.zeros(300), np.ones(300)]), y, 0.0)  # a column of zeros, and one like the intercept
    assert np.allclose(models.linear(flat, np.column_stack([X, np.zeros(300), np.ones(300)])), models.linear(models.logistic(X, y, 0.0), X), atol=1e-5)
    apart = models.logistic(X[:, :1], (X[:, 0] > 0).astype(float), 0.3)  # separable, held by the penalty
    assert np.isfinite(apart).all() and apart[1] > 1
    assert np.abs(models.logistic(X, np.ones(300), 1.0)[1:]).max() < 1e-3


def test_peers_make_up_for_delay(spark, factor_rows):
    s = scoring.substitution_rate(scoring.skill(walkforward.walk(factor_rows, P)))
    r = {x["delta"]: x for x in s.collect()}
    assert r[0]["rate"] is None and r[6]["rate"] > 0.1 and r[6]["s_own"] < r[0]["s_own"]


def test_too_few_rows_fall_back(spark, factor_rows):
    from dataclasses import replace

    f = walkforward.walk(factor_rows, replace(P, min_train=10_000))
    assert f.where("f <> 0").count() == 0 and f.count() > 0


def test_first_penalty_wins_ties():
    X, y = np.zeros((400, 1)), np.zeros(400)
    assert models.by_validation(X, y, (0.3, 1.0), 100)[1] == 0.3
    assert models.by_validation(X[:120], y[:120], (0.3, 1.0, 3.0), 100)[1] == 1.0


def test_ridge_from_sums_is_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, 200)
    y = 0.4 * x + rng.normal(size=200)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    got = models.ridge_one(df, ["g"], "x", "y", 3.0).head()
    sd = x.std() + 1e-9
    b = models.ridge(((x - x.mean()) / sd)[:, None], y, 3.0)
    assert abs(got["slope"] - b[1] / sd) < 1e-10


def test_principal_signs_and_kalman_tracks(spark):
    w = generators.factor_panel(spark, 600, seed=9).toPandas().pivot(index="t", columns="series_id", values="a").to_numpy()
    mu, sd, V = models.principal(w)
    assert (V[0] >= 0).all() and np.allclose(V.T @ V, np.eye(7), atol=1e-9)
    par = models.factor_parameters(w)
    now = models.kalman(w, par)
    assert np.corrcoef(now, w.mean(1))[0, 1] > 0.9
    late = models.kalman(w, par, 5, 0)
    assert np.isnan(late[:5]).all() and np.corrcoef(late[5:], now[5:])[0, 1] > 0.9


def test_ceiling_against_simulation(spark):
    g = spark.createDataFrame([(0.9, math.sqrt(0.19), math.sqrt(0.3 / 0.7), 1, 2)], "phi double, eta double, noise double, k int, delta int")
    want = g.select(models.delay_ceiling(*[F.col(c) for c in g.columns])).head()[0]
    s = generators.latent(spark, 60_000, 0.9, 0.3, 5).toPandas()
    par = {"mu": 0.0, "sd": 1.0, "lam": np.ones(1), "r": np.array([0.3 / 0.7]), "phi": 0.9, "q": 1 - 0.81}
    z = s["z"].to_numpy()
    m = models.kalman(z[:, None], par)
    # One row ahead of data that are two rows old.
    f = 0.9**3 * m[:-3]
    assert abs(1 - ((z[3:] - f) ** 2).mean() / z.var() - want) < 0.02


def test_hac_is_the_textbook_sum(spark):
    x = np.random.default_rng(1).normal(size=300).cumsum() * 0.05
    df = spark.createDataFrame([("g", t, float(v)) for t, v in enumerate(x)], "g string, t int, x double")
    d = x - x.mean()
    lrv = d @ d / 300 + 2 * sum((1 - k / 9) * (d[k:] @ d[:-k]) / 300 for k in range(1, 9))
    got = inference.hac(df, ["g"], "x", 8).head()
    assert abs(got["se"] - math.sqrt(lrv / 300)) < 1e-12
    assert abs(inference.retention(df, ["g"], "x", 8, 8).head()["coverage"] - 0.95) < 1e-9


@pytest.mark.parametrize(("md", "vd", "kind"), [(5.0, 0.1, "interval"), (0.1, 1.0, "unbounded"), (0.2, 0.02, "exclusion")])
def test_fieller_kinds(spark, md, vd, kind):
    s = spark.range(1).select(inference.fieller(F.lit(3.0 if kind != "unbounded" else 0.1), F.lit(md), F.lit(0.1 if kind != "unbounded" else 1.0), F.lit(vd), F.lit(0.0), F.lit(1.96)).alias("s"))
    r = s.select("s.*", inference.covers(F.col("s"), F.lit(3.0 / md)).alias("c")).head()
    assert r["kind"] == kind and r["c"]


def test_bootstrap_draws_the_last_row(spark):
    one = spark.createDataFrame([(103,)], "n long")
    st = resample.starts(one, 500, 10).agg(F.min("start"), F.max("start"), F.count("*"), F.min("stop"), F.max("stop"), F.sum(F.col("stop") - F.col("start"))).head()
    assert tuple(st) == (0, 93, 5500, 3, 103, 500 * 103)


def test_multiplicity_and_sign(spark):
    p = [0.01, 0.02, 0.03, 0.5]
    t = spark.createDataFrame([("f", x) for x in p], "f string, p double")
    r = {x["p"]: x for x in inference.multiplicity(t, ["f"]).collect()}
    assert abs(r[0.01]["holm"] - 0.04) < 1e-12 and abs(r[0.03]["bh"] - 0.04) < 1e-12 and r[0.5]["holm"] == 0.5
    d = spark.createDataFrame([("g", 1.0)] * 9 + [("g", -1.0)] + [("g", 0.0)], "g string, d double")
    assert abs(inference.sign_test(d, ["g"], "d").head()["p"] - 2 * 11 / 1024) < 1e-12


def test_joint_null_and_checks_are_calm_under_the_null(spark):
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([(f"c{i}", [float(v) for v in rng.normal(size=200)], 10, 2.2) for i in range(5)], "cell_id string, series array<double>, bandwidth int, critical_value double")
    assert all(0 < r["p"] <= 1 and r["hits"] <= 2 for r in inference.joint_null(cells, 100).collect())
    rows = [("g", str(m), t, float(rng.normal())) for m in range(3) for t in range(200)]
    q = inference.reality_check(spark.createDataFrame(rows, "g string, model string, t int, d double"), ["g"], 100, 5).head()
    assert q["p_reality"] > 0.01 and q["p_spa"] > 0.01
    assert 1.9 < inference.fixed_b(spark, [(200, 10)], 1000).head()["critical"] < 2.5
    assert 0.8 < inference.coverage(spark, 150, 100, 0.3, 8).head()["covered"] <= 1


def test_normal_functions(spark):
    zs = [-6.0, -3.4, -1.0, 0.0, 0.5, 3.6, 8.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal.cdf(F.col("z"))).collect()]
    assert all(abs(g - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-13 for g, z in zip(got, zs))
    assert abs(normal.inverse(0.975) - 1.959963984540054) < 1e-12


def test_shared_ranks_and_repeats(spark):
    f = spark.createDataFrame([("k", y, s, t) for t, (y, s) in enumerate([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)])], "k string, y int, f double, t int")
    assert scoring.auc(f, ["k"]).head()["auc"] == 0.875
    c = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("c", [1.0])], "cell_id string, series array<double>")
    assert sorted((r["cell_id"], r["copies"]) for r in scoring.distinct_series(c).collect()) == [("a", 2), ("c", 1)]
    assert scoring.rate_summary(spark.createDataFrame([("t", 1, 0.2, 0.3, 0.5)], "target string, delta int, s_own double, s_cross double, rate double")).head()["mean_of_ratios"] == 0.5


def test_vintages_and_shared_dates(spark):
    rows = spark.createDataFrame([("a", t) for t in range(6)], "target string, t int")
    v = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0)], "target string, made int, phi double")
    got = {r["t"]: r["phi"] for r in panel.latest_vintage(rows, v, 1).collect()}
    assert got == {0: None, 1: None, 2: 10.0, 3: 10.0, 4: 30.0, 5: 30.0}
    a, b = panel.shared_dates([rows, rows.where("t > 3")], ["target", "t"])
    assert a.count() == b.count() == 2


def test_provenance(spark, tmp_path):
    d = spark.createDataFrame([("s", DAY + dt.timedelta(days=200 * k), float(k)) for k in range(5)], "series_id string, date date, x double")
    m = provenance.series_digest(d, "x")
    assert provenance.verify(m, m).head()["state"] == "IDENTICAL"
    changed = provenance.series_digest(d.withColumn("x", F.when(F.year("date") == 2025, 9.0).otherwise(F.col("x"))), "x")
    r = provenance.verify(m, changed).head()
    assert r["state"] == "DIFFERENT" and r["years"] == [2025]
    with pytest.raises(ValueError):
        provenance.refuse_to_shrink(m, m.where("false"))
    cells = spark.createDataFrame([("f", "a", "g", [1.0] * 60), ("f", "b", "g", [1.0] * 3)], "family string, cell_id string, calendar_group string, series array<double>")
    provenance.record_cells(cells, str(tmp_path / "cells"))
    assert [r["cell_id"] for r in spark.read.parquet(str(tmp_path / "cells")).collect()] == ["a"]
    assert provenance.ragged(cells).count() == 1 and provenance.differences(cells, cells).count() == 0


def test_truncated_average(spark):
    assert generators.truncated_average(spark, 50, 5).count() == 50


def test_streams(spark, tmp_path):
    from driftline.streaming import live

    rows = [(i, dt.datetime(2024, 1, 1, i // 4, 10 * (i % 4)), i % 3, "ab"[i % 2], float(i + 1), "") for i in range(16)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    live_rows = live.run_once(live.hourly(live.read_events(spark, path)), "bars_now", str(tmp_path / "c1"), "complete").collect()
    assert len(live_rows) == 8
    out = live.run_once(live.exponential(live.read_events(spark, path), 0.5), "means_now", str(tmp_path / "c2")).collect()
    assert len(out) == 16


def test_sign_test_takes_all_differences(spark):
    """The registered query against brute force over every loss difference, and p against exact fractions."""
    from fractions import Fraction
    from math import comb
    from pathlib import Path

    from driftline.plans import study

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("the driver's tables are not here")
    want = {}
    for r in study.loss_differences(spark, sf).collect():
        if r["d"]:
            n, plus = want.get((r["target"], r["delta"]), (0, 0))
            want[r["target"], r["delta"]] = (n + 1, plus + (r["d"] > 0))
    got = study.sign_test(spark, sf).collect()
    assert {(r["target"], r["delta"]): (r["n"], r["plus"]) for r in got} == want and max(n for n, _ in want.values()) > 100
    for r in got:
        tail = sum(comb(r["n"], i) for i in range(min(r["plus"], r["n"] - r["plus"]) + 1))
        assert abs(r["p"] - min(1.0, float(Fraction(2 * tail, 2 ** r["n"])))) < 2e-6
