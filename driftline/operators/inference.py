"""Inference for overlapping, dependent observations: long-run variances, tests, sets, bootstraps, multiplicity.

Series are rows (key columns, t, value); t runs without holes. Sums and lag products stay in
Catalyst; simulations run in grouped or mapped Arrow functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import normal

from . import resample

Z95 = normal.inverse(0.975)


def lag_products(series: DataFrame, by: list[str], x: str, y: str, band: int) -> DataFrame:
    """(by, k, n, gamma): (1/n) sum of demeaned x_t y_{t+k}, k = 0 .. band. Lags come from one window, so no self-join."""
    w = Window.partitionBy(*by)
    d = series.select(*by, "t", (F.col(x) - F.avg(x).over(w)).alias("dx"), (F.col(y) - F.avg(y).over(w)).alias("dy"), F.count("*").over(w).alias("n"))
    o = w.orderBy("t")
    g = d.select(*by, "dx", "n", "t", *[F.lead("dy", k).over(o).alias(f"y{k}") for k in range(band + 1)])
    s = g.groupBy(*by).agg(F.max("n").alias("n"), *[F.sum(F.col("dx") * F.col(f"y{k}")).alias(f"g{k}") for k in range(band + 1)])
    return s.select(*by, "n", F.posexplode(F.array(*[F.coalesce(F.col(f"g{k}") / F.col("n"), F.lit(0.0)) for k in range(band + 1)])).alias("k", "gamma"))


def long_run(series: DataFrame, by: list[str], x: str, band: int, y: str | None = None) -> DataFrame:
    """(by, n, lrv): Bartlett long-run (co)variance."""
    one = lag_products(series, by, x, y or x, band)
    weight = 1 - F.col("k") / (band + 1)
    if y in (None, x):
        return one.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.when(F.col("k") == 0, F.col("gamma")).otherwise(2 * weight * F.col("gamma"))).alias("lrv"))
    both = one.unionByName(lag_products(series, by, y, x, band).where("k > 0"))
    return both.groupBy(*by).agg(F.max("n").alias("n"), F.sum(weight * F.col("gamma")).alias("lrv"))


def hac(series: DataFrame, by: list[str], x: str, band: int, floor: float = 1e-18) -> DataFrame:
    """(by, n, mean, se, z, p) of a mean."""
    m = series.groupBy(*by).agg(F.avg(x).alias("mean"))
    s = long_run(series, by, x, band).join(m, by)
    se = F.sqrt(F.greatest(F.col("lrv"), F.lit(floor)) / F.col("n"))
    return s.withColumn("se", se).withColumn("z", F.col("mean") / F.col("se")).withColumn("p", normal.two_sided(F.col("z"))).select(*by, "n", "mean", "se", "z", "p")


def differentials(forecasts: DataFrame, nested: bool = False, own: str = "own", cross: str = "cross") -> DataFrame:
    """(target, delta, t, d): squared-error loss of own less that of cross; nested models get the adjustment for their noise."""
    g = forecasts.groupBy("target", "delta", "t", "y").agg(F.max(F.when(F.col("arm") == own, F.col("f"))).alias("fo"), F.max(F.when(F.col("arm") == cross, F.col("f"))).alias("fc"))
    d = (F.col("y") - F.col("fo")) ** 2 - (F.col("y") - F.col("fc")) ** 2
    g = g.withColumn("d", d + (F.col("fo") - F.col("fc")) ** 2 if nested else d).where("d IS NOT NULL")
    return g.select("target", "delta", "t", "d")


def naive(series: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, n, mean, se, z): independent observations."""
    g = series.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return g.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("z", F.col("mean") / F.nullif(F.col("se"), F.lit(0.0))).drop("sd")


def fieller(num: Column, den: Column, vn: Column, vd: Column, cov: Column, z: Column) -> Column:
    """Confidence set of num / den as struct(kind, lo, hi): interval; exclusion (all but lo .. hi); unbounded.

    vn, vd, cov are variances of the means. Roots of A r^2 + B r + C with A = den^2 - z^2 vd.
    """
    A, B, C = den * den - z * z * vd, -2 * (num * den - z * z * cov), num * num - z * z * vn
    disc = B * B - 4 * A * C
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    r1, r2 = (-B - root) / (2 * F.nullif(A, F.lit(0.0))), (-B + root) / (2 * F.nullif(A, F.lit(0.0)))
    kind = F.when((A == 0) | ((disc < 0) & (A <= 0)), "unbounded").when(disc < 0, "empty").when(A > 0, "interval").otherwise("exclusion")
    bounded = kind.isin("interval", "exclusion")
    return F.struct(kind.alias("kind"), F.when(bounded, F.least(r1, r2)).alias("lo"), F.when(bounded, F.greatest(r1, r2)).alias("hi"))


def covers(s: Column, x: Column) -> Column:
    """Whether a confidence set holds x."""
    inside = (x >= s["lo"]) & (x <= s["hi"])
    return F.when(s["kind"] == "unbounded", True).when(s["kind"] == "interval", inside).when(s["kind"] == "exclusion", ~inside | (x == s["lo"]) | (x == s["hi"])).otherwise(False)


def ratio(series: DataFrame, by: list[str], num: str, den: str, band: int, z: float = Z95) -> DataFrame:
    """(by, n, ratio, delta_se, set): ratio of two means with its delta-method error and its set."""
    w = Window.partitionBy(*by)
    x, y = F.col(num) - F.avg(num).over(w), F.col(den) - F.avg(den).over(w)
    d = series.select(*by, "t", F.col(num).alias("num"), F.col(den).alias("den"), x.alias("x"), y.alias("y"))
    o = w.orderBy("t")
    lags = range(1, band + 1)
    d = d.select(*by, "num", "den", "x", "y", *[F.lead(v, k).over(o).alias(f"{v}{k}") for k in lags for v in "xy"])

    def long(a: str, b: str) -> Column:
        """Sum over rows of the weighted products at all lags."""
        terms = [F.sum(F.col(a) * F.col(b))] + [(1 - k / (band + 1)) * F.coalesce(F.sum(F.col(a) * F.col(f"{b}{k}") + F.col(b) * F.col(f"{a}{k}")), F.lit(0.0)) for k in lags]
        return sum(terms[1:], terms[0]) / F.count("*")

    j = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("num").alias("mn"), F.avg("den").alias("md"), long("x", "x").alias("vn"), long("y", "y").alias("vd"), long("x", "y").alias("cv"))
    n, mn, md = F.col("n"), F.col("mn"), F.col("md")
    vn, vd, cv = (F.greatest(F.col("vn"), F.lit(1e-18)) / n, F.greatest(F.col("vd"), F.lit(1e-18)) / n, F.col("cv") / n)
    r = mn / F.nullif(md, F.lit(0.0))
    se = F.sqrt(F.greatest(vn - 2 * r * cv + r * r * vd, F.lit(0.0))) / F.abs(md)
    return j.select(*by, "n", r.alias("ratio"), se.alias("delta_se"), fieller(mn, md, vn, vd, cv, F.lit(z)).alias("set"))


def reality_check(panel: DataFrame, by: list[str], draws: int = 2000, block: int = 40, seed: int = 7, kind: str = "restart") -> DataFrame:
    """(by, models, n, kept, statistic, p_reality, p_spa): the best of many models' mean gains (by, model, t, d) over none, unstudentised.

    The first p recentres every model; the second only those not far below zero, by the law of the
    iterated logarithm with a long-run deviation of band ``block``. Both resample by stationary blocks of
    mean length ``block``; a draw is a key, and models of one length share its blocks.
    """
    fixed = hac(panel, [*by, "model"], "d", block).select(*by, "model", "mean", "se", "n")
    n, root = F.col("n"), F.sqrt("n")
    fixed = fixed.withColumn("keep", F.col("mean") >= -F.col("se") * F.sqrt(2 * F.log(F.log(F.greatest(n, F.lit(3)).cast("double")))))
    top = fixed.groupBy(*by, "n").agg(F.count("*").cast("int").alias("models"), F.sum(F.col("keep").cast("int")).cast("int").alias("kept"), F.max(root * F.col("mean")).alias("statistic"))
    s = resample.block_sums(panel, [*by, "model"], ["d"], draws, block, seed, kind).drop("n").join(fixed, [*by, "model"])
    gap = lambda base: F.max(root * (F.col("d") / n - base))
    boots = s.groupBy(*by, "n", "draw").agg(gap(F.col("mean")).alias("all"), gap(F.when(F.col("keep"), F.col("mean")).otherwise(0.0)).alias("some"))
    over = lambda c: F.avg((F.col(c) >= F.col("statistic")).cast("double"))
    return boots.join(top, [*by, "n"]).groupBy(*by, "models", "n", "kept", "statistic").agg(over("all").alias("p_reality"), over("some").alias("p_spa"))


def bartlett(Z: np.ndarray, band: int) -> np.ndarray:
    """Bartlett long-run variance of each row about its mean: the mean square of its moving sums of band + 1 values, the ends padded with nothing."""
    n = Z.shape[1]
    e = Z - Z.mean(1, keepdims=True)
    run = np.pad(np.cumsum(np.pad(e, ((0, 0), (1, 0))), 1), ((0, 0), (0, band)), mode="edge")
    moving = run[:, 1:] - np.concatenate([np.zeros((len(Z), band + 1)), run[:, 1:n]], 1)
    return (moving**2).sum(1) / ((band + 1) * n)


def fixed_b(spark: SparkSession, sizes: list[tuple[int, int]], draws: int = 4000, seed: int = 20) -> DataFrame:
    """(n, band, critical): the 95% point of |t| of a mean of n independent normals with a Bartlett error of that band, simulated in parallel batches."""
    batch = 250
    grid = spark.createDataFrame([(n, b, k) for n, b in sizes for k in range(-(-draws // batch))], "n int, band int, k int").repartition("n", "band", "k")

    def run(batches):
        for pdf in batches:
            for n, band, k in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, n, band, k])
                x = rng.normal(size=(batch, n))
                d = x - x.mean(1, keepdims=True)
                m = 1 << (2 * n - 1).bit_length()
                f = np.fft.rfft(d, m)
                g = np.fft.irfft(f * np.conj(f), m)[:, : band + 1] / n
                w = np.concatenate([[1], 2 * (1 - np.arange(1, band + 1) / (band + 1))])
                yield pd.DataFrame({"n": n, "band": band, "t": np.abs(x.mean(1)) / np.sqrt(np.maximum(g @ w, 1e-18) / n)})

    sims = grid.mapInPandas(run, "n int, band int, t double")
    return sims.groupBy("n", "band").agg(F.percentile("t", F.lit(0.95)).alias("critical"))


def self_normalised(series: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, n, mean, statistic): the squared mean over the variation of its recursive means; no bandwidth."""
    w = Window.partitionBy(*by).orderBy("t")
    r = series.select(*by, x, F.row_number().over(w).alias("k"), F.avg(x).over(w).alias("rec"))
    m = F.avg(x).over(Window.partitionBy(*by))
    g = r.withColumn("mean", m).groupBy(*by).agg(F.count("*").alias("n"), F.max("mean").alias("mean"), F.sum((F.col("k") * (F.col("rec") - F.col("mean"))) ** 2).alias("v"))
    return g.select(*by, "n", "mean", (F.col("n") * F.col("mean") ** 2 / F.nullif(F.col("v") / (F.col("n") * F.col("n")), F.lit(0.0))).alias("statistic"))


def multiplicity(tests: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Adjusted p by Benjamini-Hochberg (bh) and by Holm (holm) within each family."""
    w = Window.partitionBy(*by)
    up = w.orderBy(F.col(p).asc())
    j, m = F.row_number().over(up), F.count("*").over(w)
    t = tests.withColumn("j", j).withColumn("m", m)
    desc, asc = w.orderBy(F.col("j").desc()), w.orderBy("j")
    t = t.withColumn("bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("j")).over(desc)))
    return t.withColumn("holm", F.least(F.lit(1.0), F.max(F.col(p) * (F.col("m") - F.col("j") + 1)).over(asc))).drop("j", "m")


def whole_blocks(n: int, block: int, band: int) -> int:
    """A block length of at least ``block``, at most a quarter of n, whose last, cut block is longer than the band."""
    long = min(block, max(2, n // 4))
    return next((x for x in range(long, n) if n % x == 0 or n % x > band), n)


def absolute_t(cells: DataFrame, draws: int, block: int, seed: int) -> DataFrame:
    """(cell_id, draw, t) of cells (cell_id, series, bandwidth): |mean| over its long-run error in moving-block draws of the centred series.

    Starts depend on the number of rows and the draw alone, so cells of one calendar share them without meeting.
    A task holds one cell and some of the draws.
    """

    def statistic(row, draw):
        x = np.asarray(row["series"], float)
        Z = (x - x.mean())[resample.rows_drawn(len(x), draw, whole_blocks(len(x), block, int(row["bandwidth"])), seed)]
        return {"t": np.abs(Z.mean(1)) / np.sqrt(np.maximum(bartlett(Z, int(row["bandwidth"])), 1e-18) / len(x))}

    return resample.by_draw(cells.select("cell_id", "series", "bandwidth"), ["cell_id"], draws, statistic, "t double")


def joint_null(cells: DataFrame, draws: int = 2000, block: int = 60, seed: int = 5) -> DataFrame:
    """(rule, cells, hits, null_mean, p, bound) of cells (cell_id, series, bandwidth, critical_value): how often resampling all centred cells together has as many significant ones as the data.

    Rule A holds |t| against the normal, B against the cell's own critical value, C against the 95% point of the
    cell's |t| in draws of another seed. All rules are counted on the same draws, each against its own null. Without
    any exceedance, ``bound`` is the largest chance that such luck leaves with 5%. Series are free of nulls.
    """
    t = absolute_t(cells, draws, block, seed)
    own = absolute_t(cells, draws, block, seed + 7777).groupBy("cell_id").agg(F.percentile("t", F.lit(0.95)).alias("own"))

    def observed(batches):
        for pdf in batches:
            xs = [np.asarray(x, float) for x in pdf["series"]]
            v = [abs(x.mean()) / np.sqrt(max(bartlett(x[None], int(b))[0], 1e-18) / len(x)) for x, b in zip(xs, pdf["bandwidth"])]
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "draw": np.full(len(pdf), -1, np.int64), "t": np.array(v, float)})

    kind = cells.schema["cell_id"].dataType.simpleString()
    seen = cells.select("cell_id", "series", "bandwidth").mapInPandas(observed, f"cell_id {kind}, draw bigint, t double")
    limits = cells.select("cell_id", "critical_value").join(own, "cell_id")
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), c.cast("double").alias("limit")) for r, c in (("A", F.lit(Z95)), ("B", F.col("critical_value")), ("C", F.col("own")))]))
    limits = limits.select("cell_id", rules.alias("r")).select("cell_id", "r.rule", "r.limit")
    hits = t.unionByName(seen).join(limits, "cell_id").groupBy("rule", "draw").agg(F.count("*").alias("cells"), F.sum((F.col("t") > F.col("limit")).cast("long")).alias("hits"))
    real = F.max(F.when(F.col("draw") < 0, F.col("hits"))).over(Window.partitionBy("rule"))
    over = F.sum(((F.col("draw") >= 0) & (F.col("hits") >= F.col("seen"))).cast("long"))
    g = hits.withColumn("seen", real).groupBy("rule", "cells", "seen").agg(F.avg(F.when(F.col("draw") >= 0, F.col("hits"))).alias("null_mean"), over.alias("over"))
    return g.select("rule", "cells", F.col("seen").alias("hits"), "null_mean", ((1 + F.col("over")) / (draws + 1)).alias("p"), F.when(F.col("over") == 0, 1 - 0.05 ** (1 / draws)).alias("bound"))


def fixed_band(n: Column, band: Column) -> Column:
    """The 97.5% point of a mean's t with a Bartlett error of that band, by the published cubic in band over rows."""
    b = (band + 1) / n
    return Z95 + 2.9694 * b + 0.4160 * b * b - 0.5324 * b * b * b


def sign_test(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """(by, n, plus, p): exact two-sided binomial, at most 1; zeros don't count."""
    g = df.where((F.col(d) != 0) & F.col(d).isNotNull()).groupBy(*by).agg(F.count("*").cast("int").alias("n"), F.sum((F.col(d) > 0).cast("int")).cast("int").alias("plus"))
    k = F.least(F.col("plus"), F.col("n") - F.col("plus"))
    terms = F.aggregate(F.sequence(F.lit(0), k), F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")), lambda a, i: F.struct(
        F.when(i == 0, F.lit(0.0)).otherwise(a["c"] + F.log((F.col("n") - i + 1) / F.greatest(i, F.lit(1)))).alias("c"),
        (a["s"] + F.exp(F.when(i == 0, F.lit(0.0)).otherwise(a["c"] + F.log((F.col("n") - i + 1) / F.greatest(i, F.lit(1)))) - F.col("n") * math.log(2))).alias("s"),
    ), lambda a: a["s"])
    return g.withColumn("p", F.least(F.lit(1.0), 2 * terms))


def ljung_box(series: DataFrame, by: list[str], x: str, lags: int) -> DataFrame:
    """(by, n, q, p): portmanteau statistic of the first lags, p by the cube-root approximation."""
    g = lag_products(series, by, x, x, lags)
    zero = F.max(F.when(F.col("k") == 0, F.col("gamma"))).over(Window.partitionBy(*by))
    r = g.withColumn("r", F.col("gamma") / zero).where("k > 0")
    q = r.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("r") ** 2 / (F.col("n") - F.col("k"))).alias("s"))
    q = q.select(*by, "n", (F.col("n") * (F.col("n") + 2) * F.col("s")).alias("q"))
    return q.withColumn("p", normal.chi2_upper(F.col("q"), lags))


def sup_t(series: DataFrame, by: list[str], member: str, x: str, draws: int, block: int) -> DataFrame:
    """(by, member, n, mean, se, critical, lo, hi): a band for the means of all members of a group at once.

    ``critical`` is the 95% point over draws of the largest |mean of the draw - mean| / se over members, which share
    their starts if they have the same rows; se is long-run with band ``block`` and the same in every draw.
    """
    fixed = hac(series, [*by, member], x, block).select(*by, member, "n", "mean", "se")
    s = resample.block_sums(series, [*by, member], [x], draws, block).drop("n").join(fixed, [*by, member])
    top = s.groupBy(*by, "draw").agg(F.max(F.abs(F.col(x) / F.col("n") - F.col("mean")) / F.greatest("se", F.lit(1e-12))).alias("top"))
    c = top.groupBy(*by).agg(F.percentile("top", F.lit(0.95)).alias("critical"))
    half = F.col("critical") * F.col("se")
    return fixed.join(c, by).select(*by, member, "n", "mean", "se", "critical", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def contrast(series: DataFrame, by: list[str], a: tuple[str, str], b: tuple[str, str], band: int) -> DataFrame:
    """(by, n, one, two, contrast, se): a ratio of means less another's, from the full rows; the error is that of the linearised difference (delta method)."""
    w = Window.partitionBy(*by)
    m = {c: F.avg(c).over(w) for c in (*a, *b)}
    rate = lambda p: m[p[0]] / F.nullif(m[p[1]], F.lit(0.0))
    part = lambda p: (F.col(p[0]) - rate(p) * F.col(p[1])) / F.nullif(m[p[1]], F.lit(0.0))
    s = series.select(*by, "t", rate(a).alias("one"), rate(b).alias("two"), (part(a) - part(b)).alias("x"))
    g = s.groupBy(*by).agg(F.max("one").alias("one"), F.max("two").alias("two"))
    return long_run(s, by, "x", band).join(g, by).select(*by, "n", "one", "two", (F.col("one") - F.col("two")).alias("contrast"), F.sqrt(F.greatest("lrv", F.lit(0.0)) / F.col("n")).alias("se"))


def retention(series: DataFrame, by: list[str], x: str, band: int, wide: int) -> DataFrame:
    """(by, share, coverage): long-run variance kept at a short band against a wide one, and the coverage that a 95% interval then has."""
    a = long_run(series, by, x, band).select(*by, F.col("lrv").alias("a"))
    b = long_run(series, by, x, wide).select(*by, F.col("lrv").alias("b"))
    share = F.greatest(F.col("a"), F.lit(0.0)) / F.nullif(F.col("b"), F.lit(0.0))
    return a.join(b, by).select(*by, share.alias("share"), (2 * normal.cdf(Z95 * F.sqrt(share)) - 1).alias("coverage"))


def coverage(spark: SparkSession, n: int, reps: int, rho: float, band: int, seed: int = 3) -> DataFrame:
    """(reps, covered): how often a HAC interval of an AR(1)'s mean holds 0, simulated in parallel."""

    def run(batches):
        for pdf in batches:
            hit = []
            for i in pdf["id"]:
                e = np.random.default_rng([seed, int(i)]).normal(size=n)
                x = np.empty(n)
                x[0] = e[0] / np.sqrt(1 - rho * rho)
                for t in range(1, n):
                    x[t] = rho * x[t - 1] + e[t]
                d = x - x.mean()
                v = d @ d / n + 2 * sum((1 - k / (band + 1)) * (d[k:] @ d[:-k]) / n for k in range(1, band + 1))
                hit.append(abs(x.mean()) <= Z95 * np.sqrt(max(v, 1e-18) / n))
            yield pd.DataFrame({"hit": np.array(hit, float)})

    return spark.range(reps).mapInPandas(run, "hit double").agg(F.count("*").alias("reps"), F.avg("hit").alias("covered"))


def circular_shift(panel: DataFrame, by: list[str], x: str, offset: int) -> DataFrame:
    """A placebo: each value taken ``offset`` rows further on, round the end."""
    n = F.count("*").over(Window.partitionBy(*by))
    keyed = panel.withColumn("n", n)
    src = keyed.select(*by, F.pmod(F.col("t") - offset, F.col("n")).alias("t"), F.col(x).alias("moved"))
    return panel.join(src, [*by, "t"])
