"""Scores of forecasts (target, arm, delta, t, y, f, bench): skill, loss, ranks, rates, ages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ["target", "arm", "delta"]


def qlike(y: Column, f: Column) -> Column:
    """z - ln z - 1 of z = exp(y - f)."""
    return F.exp(y - f) - (y - f) - 1


def skill(forecasts: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Per group: n, mse, qlike, r2 = 1 - SSE / SSE of the benchmark, and the qlike skill. Null where the benchmark has no loss."""
    y, f, b = F.col("y"), F.col("f"), F.col("bench")
    some = forecasts.where(y.isNotNull() & f.isNotNull() & b.isNotNull())
    g = some.groupBy(*by).agg(F.count("*").alias("n"), F.avg((y - f) ** 2).alias("mse"), F.avg(qlike(y, f)).alias("qlike"), F.sum((y - f) ** 2).alias("s"), F.sum((y - b) ** 2).alias("s0"), F.sum(qlike(y, f)).alias("q"), F.sum(qlike(y, b)).alias("q0"))
    return g.withColumn("r2", F.when(F.col("s0") > 0, 1 - F.col("s") / F.col("s0"))).withColumn("qlike_skill", F.when(F.col("q0") > 0, 1 - F.col("q") / F.col("q0"))).drop("s", "s0", "q", "q0")


def binary(forecasts: DataFrame, by: list[str] = KEYS, clip: float = 1e-6, more: list[Column] = ()) -> DataFrame:
    """Per group of (y in 0, 1; f a probability): accuracy at one half, balanced accuracy, Brier and log score."""
    y, f = F.col("y"), F.col("f")
    p = F.least(F.greatest(f, F.lit(clip)), F.lit(1 - clip))
    hit = ((f > 0.5) == (y == 1)).cast("double")
    g = forecasts.where(y.isNotNull() & f.isNotNull()).groupBy(*by)
    half = (F.avg(F.when(y == 1, hit)) + F.avg(F.when(y == 0, hit))) / 2
    return g.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), half.alias("balanced"), F.avg((y - f) ** 2).alias("brier"), F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_score"), *more)


def average_rank(x: Column | str, by: list[str]) -> Column:
    """Rank with ties sharing the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def _area(rank: str = "rank") -> Column:
    """Area under the curve from ranks, null where a kind of label is missing."""
    n1, n0 = F.sum((F.col("y") == 1).cast("long")), F.sum((F.col("y") == 0).cast("long"))
    return (F.sum(F.when(F.col("y") == 1, F.col(rank))) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0))


def auc(forecasts: DataFrame, by: list[str] = KEYS, ties: str = "average") -> DataFrame:
    """Per group: area under the curve; ties share ranks, or go by ``t`` with ``ties="order"``."""
    some = forecasts.where("y IS NOT NULL AND f IS NOT NULL")
    r = average_rank("f", by) if ties == "average" else F.row_number().over(Window.partitionBy(*by).orderBy("f", "t"))
    count = lambda v: F.sum((F.col("y") == v).cast("long"))
    return some.withColumn("rank", r).groupBy(*by).agg(count(1).alias("n1"), count(0).alias("n0"), _area().alias("auc"))


def classified(forecasts: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """``binary`` and ``auc`` in one pass over the forecasts: ranks are shared within the group, which all other scores leave as it is."""
    some = forecasts.where("y IS NOT NULL AND f IS NOT NULL")
    g = Window.partitionBy(*by).orderBy("f")
    # Rows up to and with the row's value, less half of those that share it.
    upto = F.count("*").over(g.rangeBetween(Window.unboundedPreceding, 0))
    ranked = some.withColumn("rank", (F.rank().over(g) + upto) / 2)
    return binary(ranked, by, more=[_area().alias("auc")])


def gaussian_accuracy(rho: Column) -> Column:
    """Share of right signs of two normals with correlation rho."""
    return 0.5 + F.asin(rho) / math.pi


def substitution_rate(skills: DataFrame, value: str = "r2", own: str = "own", cross: str = "cross", least: float = 1e-9) -> DataFrame:
    """(target, delta, s_own, s_cross, rate): the share of skill lost to the delay that the fresh peers give back.

    Null at delay 0, and where the loss is at most ``least``.
    """
    p = skills.groupBy("target", "delta").agg(F.max(F.when(F.col("arm") == own, F.col(value))).alias("s_own"), F.max(F.when(F.col("arm") == cross, F.col(value))).alias("s_cross"))
    lost = F.max(F.when(F.col("delta") == 0, F.col("s_own"))).over(Window.partitionBy("target")) - F.col("s_own")
    return p.withColumn("lost", lost).select("target", "delta", "s_own", "s_cross", F.when((F.col("delta") > 0) & (F.col("lost") > least), (F.col("s_cross") - F.col("s_own")) / F.col("lost")).alias("rate"))


def rate_summary(rates: DataFrame) -> DataFrame:
    """Per delay: the mean of the targets' rates, and the ratio of their mean gains to their mean losses."""
    r = rates.where("rate IS NOT NULL")
    gain = F.col("s_cross") - F.col("s_own")
    return r.groupBy("delta").agg(F.count("*").alias("n"), F.avg("rate").alias("mean_of_ratios"), (F.sum(gain) / F.sum(gain / F.nullif(F.col("rate"), F.lit(0.0)))).alias("ratio_of_means"))


def squared_losses(forecasts: DataFrame) -> DataFrame:
    """(target, delta, t, own, cross, fresh, bench): squared errors of both arms, of the own arm without delay and of the benchmark, where all four are there."""
    y = F.col("y")
    arm = lambda a: F.max(F.when(F.col("arm") == a, (y - F.col("f")) ** 2))
    g = forecasts.groupBy("target", "delta", "t").agg(arm("own").alias("own"), arm("cross").alias("cross"), F.max((y - F.col("bench")) ** 2).alias("bench"))
    fresh = F.max(F.when(F.col("delta") == 0, F.col("own"))).over(Window.partitionBy("target", "t"))
    return g.withColumn("fresh", fresh).where("own IS NOT NULL AND cross IS NOT NULL AND fresh IS NOT NULL AND bench IS NOT NULL")


def rolling_rate(losses: DataFrame, roll: int = 1000, step: int = 250, least: float = 1e-9) -> DataFrame:
    """(target, delta, start, last, rate) of squared losses: the substitution rate in windows of ``roll`` rows, ``step`` apart, both halves on the same rows; ``last`` is the t of a window's last row.

    Windows are frames ahead of their first row: no row is copied into the windows it is in.
    """
    w = Window.partitionBy("target", "delta").orderBy("t")
    ahead = w.rowsBetween(0, roll - 1)
    total = lambda c: F.sum(c).over(ahead)
    lost = (total("own") - total("fresh")) / F.nullif(total("bench"), F.lit(0.0))
    gain = (total("own") - total("cross")) / F.nullif(total("bench"), F.lit(0.0))
    s = losses.where("delta > 0").select("target", "delta", (F.row_number().over(w) - 1).alias("start"), F.count("*").over(ahead).alias("n"), F.max("t").over(ahead).alias("last"), F.when(lost > least, gain / lost).alias("rate"))
    return s.where((F.col("n") == roll) & (F.col("start") % step == 0)).select("target", "delta", "start", "last", "rate")


def rate_trend(windows: DataFrame, year: str = "year") -> DataFrame:
    """(target, delta, windows, least, most, range, trend): span of the rates and their slope a decade, of more than two windows with a rate; the windows overlap, so it describes only."""
    g = windows.where("rate IS NOT NULL").groupBy("target", "delta").agg(F.count("*").alias("windows"), F.min("rate").alias("least"), F.max("rate").alias("most"), (F.regr_slope("rate", year) * 10).alias("b"))
    return g.select("target", "delta", "windows", "least", "most", (F.col("most") - F.col("least")).alias("range"), F.when(F.col("windows") > 2, F.col("b")).alias("trend"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, numbered by ``place``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def outage_split(skills: DataFrame) -> DataFrame:
    """(target, delta, total, feature, vintage, vintage_share) of own-arm skills (target, delta, s_feature, s_outage): what a delay costs by old features, and by old coefficients."""
    s0 = F.max(F.when(F.col("delta") == 0, F.col("s_outage"))).over(Window.partitionBy("target"))
    s = skills.withColumn("total", s0 - F.col("s_outage")).withColumn("feature", s0 - F.col("s_feature")).withColumn("vintage", F.col("s_feature") - F.col("s_outage")).where("delta > 0")
    return s.select("target", "delta", "total", "feature", "vintage", F.when(F.abs("total") > 1e-12, F.col("vintage") / F.col("total")).alias("vintage_share"))


def effective_age(curve: DataFrame, wanted: DataFrame) -> DataFrame:
    """(target, delta, age): where the own skill curve (target, delta, s), made monotone by its running minimum, falls to a wanted skill (target, delta, s).

    Linear between ages; 0 above the curve, null below it.
    """
    w = Window.partitionBy("target").orderBy("delta")
    low = F.min("s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = curve.withColumn("m", low)
    c = c.withColumn("m1", F.lead("m").over(w)).withColumn("d1", F.lead("delta").over(w)).select("target", F.col("delta").alias("d0"), "d1", "m", "m1")
    j = wanted.select("target", "delta", "s").join(c, "target")
    inside = (F.col("s") <= F.col("m")) & (F.col("s") >= F.col("m1")) & (F.col("m") > F.col("m1"))
    x = F.when(inside, F.col("d0") + (F.col("m") - F.col("s")) / F.nullif(F.col("m") - F.col("m1"), F.lit(0.0)) * (F.col("d1") - F.col("d0")))
    top = F.max("m")
    return j.groupBy("target", "delta", "s").agg(F.min(x).alias("age"), top.alias("top")).select("target", "delta", F.when(F.col("s") >= F.col("top"), F.lit(0.0)).otherwise(F.col("age")).alias("age"))


def tail_report(ratios: DataFrame, by: list[str], x: str = "ratio") -> DataFrame:
    q = lambda p: F.percentile(x, F.lit(p))
    share = lambda c: F.avg(c.cast("double"))
    return ratios.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), q(0.5).alias("median"), share(F.col(x) > 2).alias("above_double"), share(F.col(x) < 0.5).alias("below_half"), q(0.05).alias("p05"), q(0.95).alias("p95"))


def equal_bins(x: str, by: list[str], bins: int) -> Column:
    """Bin by rank: floor(place * bins / n). Not ``ntile``, which differs where bins don't divide n."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(x)) - 1
    return F.floor(place * bins / F.count("*").over(Window.partitionBy(*by)))


def mutual_information(pairs: DataFrame, by: list[str], x: str, y: str, bins: int = 16) -> DataFrame:
    """(by, n, mi): plug-in mutual information of two columns in bins of equal count, in nats."""
    b = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bx", equal_bins(x, by, bins)).withColumn("by_", equal_bins(y, by, bins))
    cell = b.groupBy(*by, "bx", "by_").agg(F.count("*").alias("k"))
    w = lambda *c: Window.partitionBy(*by, *c)
    k, n = F.col("k"), F.sum("k").over(w())
    term = k / n * F.log(k * n / (F.sum("k").over(w("bx")) * F.sum("k").over(w("by_"))))
    return cell.withColumn("term", term).groupBy(*by).agg(F.sum("k").alias("n"), F.sum("term").alias("mi"))


def mutual_information_null(pairs: DataFrame, by: list[str], x: str, y: str, draws: int = 200, bins: int = 16) -> DataFrame:
    """(by, n, mi, null_mean, null_sd, debiased) of pairs (by, t, x, y): mutual information against its value when y is dealt anew.

    A draw orders the rows by a digest of (draw, t); bins of equal count of that order are what a permutation of y gives.
    """
    b = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bx", equal_bins(x, by, bins))
    d = b.select(*by, "t", "bx", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    d = d.withColumn("key", F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("t").cast("string"))))
    place = F.row_number().over(Window.partitionBy(*by, "draw").orderBy("key", "t")) - 1
    d = d.withColumn("by_", F.floor(place * bins / F.count("*").over(Window.partitionBy(*by, "draw"))))
    cell = d.groupBy(*by, "draw", "bx", "by_").agg(F.count("*").alias("k"))
    w = lambda *c: Window.partitionBy(*by, "draw", *c)
    k = F.col("k")
    term = k / F.sum("k").over(w()) * F.log(k * F.sum("k").over(w()) / (F.sum("k").over(w("bx")) * F.sum("k").over(w("by_"))))
    null = cell.withColumn("term", term).groupBy(*by, "draw").agg(F.sum("term").alias("m")).groupBy(*by).agg(F.avg("m").alias("null_mean"), F.stddev_samp("m").alias("null_sd"))
    return mutual_information(pairs, by, x, y, bins).join(null, by).withColumn("debiased", F.greatest(F.col("mi") - F.col("null_mean"), F.lit(0.0)))


def nearest_entropy(values: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, n, entropy): differential entropy by nearest neighbours on the line; repeated values count once."""
    euler = 0.57721566490153286
    d = values.where(F.col(x).isNotNull()).select(*by, x).distinct()
    w = Window.partitionBy(*by).orderBy(x)
    gap = F.least(F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(float("inf"))), F.coalesce(F.lead(x).over(w) - F.col(x), F.lit(float("inf"))))
    g = d.withColumn("gap", gap).where("gap < double('infinity')").groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.log(2 * F.col("gap"))).alias("m"))
    return g.where("n > 1").select(*by, "n", (F.col("m") + F.log(F.col("n") - 1) + euler).alias("entropy"))


def r2_ceiling(entropy: Column, variance: Column, mi: Column) -> Column:
    """What no forecast with that mutual information can exceed."""
    return 1 - F.exp(2 * entropy) / (2 * math.pi * math.e) / variance * F.exp(-2 * mi)


def correlations(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, pearson, spearman, fisher): Spearman by mean ranks; Fisher's z of Pearson."""
    some = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = some.withColumn("rx", average_rank(x, by)).withColumn("ry", average_rank(y, by))
    g = r.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("rx", "ry").alias("spearman"))
    return g.withColumn("fisher", F.when(F.abs("pearson") < 1, F.atanh("pearson")))


def leave_one_out(points: DataFrame, x: str, y: str) -> DataFrame:
    """(id, without, slope, crossing, leverage) of each point (id, x, y): the others' correlation, their line's slope and where it meets zero, and the point's pull on the whole line; from sums, no pairs of points."""
    some = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = some.agg(F.count("*").alias("n"), F.avg(x).alias("ax"), F.avg(y).alias("ay"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    j = some.crossJoin(F.broadcast(s))  # one row
    n, dx, dy = F.col("n"), F.col(x) - F.col("ax"), F.col(y) - F.col("ay")
    # Sums about the whole's means, less the point's own part: n / (n - 1) of its squares.
    others = F.nullif(n - 1, F.lit(0))
    left = lambda whole, part: n * F.col(whole) - part * n / others
    cov, vx, vy = left("c", dx * dy), left("vx", dx * dx), left("vy", dy * dy)
    slope = cov / F.nullif(vx, F.lit(0.0))
    mx, my = (n * F.col("ax") - F.col(x)) / others, (n * F.col("ay") - F.col(y)) / others
    return j.select("id", (cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0))).alias("without"), slope.alias("slope"), (mx - my / F.nullif(slope, F.lit(0.0))).alias("crossing"), (1 / n + dx * dx / F.nullif(n * F.col("vx"), F.lit(0.0))).alias("leverage"))


def correlation(x: str, y: str, over: WindowSpec | None = None) -> Column:
    """Pearson's correlation of two columns that are missing together; null where one does not vary, where Spark's own divides by zero."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return at(F.covar_pop(x, y)) / F.nullif(at(F.stddev_pop(x)) * at(F.stddev_pop(y)), F.lit(0.0))


def structure_stability(panel: DataFrame, by: list[str], win: int = 252, gap: int = 63, least: int = 126) -> DataFrame:
    """(by, t, pairs, stability) of a panel (by, t, series_id, a) that has every series in every row: how alike all pairs' correlations in the ``win`` rows before t are to those ``gap`` rows earlier.

    Rows in which a series is missing don't count, and a window needs ``least`` that do. Pairs come from each row's own values.
    """
    day = Window.partitionBy(*by, "t")
    whole = panel.withColumn("full", F.min(F.col("a").isNotNull().cast("int")).over(day)).groupBy(*by, "t").agg(F.max("full").alias("full"), F.array_sort(F.collect_list(F.struct("series_id", "a"))).alias("v"))
    i = F.posexplode("v").alias("i", "one")
    p = whole.select(*by, "t", "full", "v", i).select(*by, "t", "full", "one", F.explode(F.slice(F.col("v"), F.col("i") + 2, F.size("v"))).alias("two"))
    value = lambda c: F.when(F.col("full") == 1, F.col(f"{c}.a"))
    p = p.select(*by, "t", F.col("one.series_id").alias("one"), F.col("two.series_id").alias("two"), value("one").alias("u"), value("two").alias("v"))
    w = Window.partitionBy(*by, "one", "two").orderBy("t")
    past = w.rowsBetween(-win, -1)
    # Only windows that lie whole in the series.
    c = F.when((F.count("u").over(past) >= least) & (F.row_number().over(w) > win), correlation("u", "v", past))
    p = p.select(*by, "t", "one", "two", c.alias("c")).withColumn("before", F.lag("c", gap).over(w))
    both = p.where("c IS NOT NULL AND before IS NOT NULL AND NOT isnan(c) AND NOT isnan(before)")
    return both.groupBy(*by, "t").agg(F.count("*").alias("pairs"), correlation("c", "before").alias("stability"))


def smear(forecasts: DataFrame, span: int, horizon: int) -> DataFrame:
    """Forecasts with ``smear``: the mean of exp(y - f) over the ``span`` rows whose labels had resolved; 1 before there are any."""
    past = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(-(horizon + span), -(horizon + 1))
    return forecasts.withColumn("smear", F.coalesce(F.avg(F.exp(F.col("y") - F.col("f"))).over(past), F.lit(1.0)))


def scale_losses(forecasts: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, n, qlike, mse, natural, unweighted) and their skills, of log forecasts (f, smear, y, bench_var, m0, mh) carried to variances.

    The smeared forecast exp(f) * smear meets exp(y): by quasi-likelihood; by squared error over the median; on the natural
    scale, where the forecaster has the origin's median m0 and the outcome its own, mh; and with mh on both sides, which
    nobody could know and which only takes the weight off. ``bench_var`` is the resolved labels' mean variance.
    """
    some = forecasts.where("y IS NOT NULL AND f IS NOT NULL AND bench_var IS NOT NULL AND m0 IS NOT NULL AND mh IS NOT NULL")
    v, h, b = F.exp("y"), F.exp("f") * F.col("smear"), F.col("bench_var")
    loss = {"qlike": lambda x: v / x - F.log(v / x) - 1, "mse": lambda x: (v - x) ** 2, "natural": lambda x: (v * F.col("mh") - x * F.col("m0")) ** 2, "unweighted": lambda x: ((v - x) * F.col("mh")) ** 2}
    g = some.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(f(h)).alias(k) for k, f in loss.items()], *[F.sum(f(h)).alias(f"m_{k}") for k, f in loss.items()], *[F.sum(f(b)).alias(f"b_{k}") for k, f in loss.items()])
    return g.select(*by, "n", *loss, *[(1 - F.col(f"m_{k}") / F.nullif(F.col(f"b_{k}"), F.lit(0.0))).alias(f"{k}_skill") for k in loss])


def same(a: Column, b: Column, rel: float = 1e-12) -> Column:
    """Equal, or both missing, or apart by no more than ``rel``."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def distinct_series(cells: DataFrame) -> DataFrame:
    """The first of cells (cell_id, series) with one and the same series, and how many there are."""
    h = cells.withColumn("digest", F.sha2(F.concat_ws(",", F.transform("series", lambda v: v.cast("string"))), 256))
    w = Window.partitionBy("digest")
    return h.withColumn("copies", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("cell_id"))).where("k = 1").select("cell_id", "digest", "copies")
