"""Whether a series behaves otherwise after an event: windows around it, breaks in level, alignment and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_window(rows: DataFrame, by: list[str], event: Column, win: int = 250, buffer: int = 21) -> DataFrame:
    """``win`` rows of (by, t) before and after the row at place ``event``, less ``buffer`` rows on either side of it; with ``pos`` and ``after``.

    ``event`` may use ``pos`` (from 0) and ``n``. A group that is too short on one side has no rows.
    """
    w = Window.partitionBy(*by)
    p = rows.withColumn("pos", F.row_number().over(w.orderBy("t")) - 1).withColumn("n", F.count("*").over(w)).withColumn("event", event)
    at, i = F.col("pos"), F.col("event")
    p = p.where((i >= win + buffer) & (i + win + buffer <= F.col("n")))
    before, after = (at >= i - win - buffer) & (at < i - buffer), (at >= i + buffer) & (at < i + win + buffer)
    return p.where(before | after).withColumn("after", after).withColumn("pos", F.row_number().over(w.orderBy("t")) - 1).drop("n", "event")


def break_statistics(windows: DataFrame, by: list[str], band: int = 9) -> DataFrame:
    """(by, n, level, alignment, range) of (by, t, after, v, a, r, dv, q).

    level: Wald statistic, 2 degrees of freedom, of a break in the regression of a on v. The two sides have their own
    fits; a row's influence on the difference of their coefficients is its residual times its side's inverse moments,
    so the covariance is a weighted sum of lag products of two columns.
    alignment: how far the correlation of r with dv moves. range: |t| of the shift in the mean of q.
    """
    w = Window.partitionBy(*by)
    s = Window.partitionBy(*by, "after")
    v, a, q = F.col("v"), F.col("a"), F.col("q")
    slope = F.covar_pop("v", "a").over(s) / F.nullif(F.var_pop("v").over(s), F.lit(0.0))
    x = windows.select(*by, "t", "after", "v", "a", "r", "dv", "q", F.count("*").over(s).alias("m"), F.avg("v").over(s).alias("mv"), F.avg("a").over(s).alias("ma"), F.var_pop("v").over(s).alias("vv"), slope.alias("slope"), (q - F.avg("q").over(s)).alias("z"))
    sign = F.when(F.col("after"), 1.0).otherwise(-1.0)
    e = a - F.col("ma") - F.col("slope") * (v - F.col("mv"))
    tilt = (v - F.col("mv")) / F.nullif(F.col("m") * F.col("vv"), F.lit(0.0))
    x = x.withColumn("i1", sign * tilt * e).withColumn("i0", sign * (1 / F.col("m") - F.col("mv") * tilt) * e)
    o = w.orderBy("t")
    x = x.select("*", *[F.lead(c, k).over(o).alias(f"{c}_{k}") for c in ("i0", "i1", "z") for k in range(1, band + 1)])

    def long(c: str, d: str) -> Column:
        lags = [(1 - k / (band + 1)) * F.coalesce(F.sum(F.col(c) * F.col(f"{d}_{k}") + F.col(d) * F.col(f"{c}_{k}")), F.lit(0.0)) for k in range(1, band + 1)]
        return sum(lags, F.sum(F.col(c) * F.col(d)))

    side = lambda f, after: f(lambda c: F.when(F.col("after") == after, c))
    diff = lambda f: side(f, True) - side(f, False)
    g = x.groupBy(*by).agg(
        F.count("*").alias("n"), long("i0", "i0").alias("v00"), long("i0", "i1").alias("v01"), long("i1", "i1").alias("v11"), long("z", "z").alias("zz"),
        diff(lambda on: F.max(on(F.col("ma") - F.col("slope") * F.col("mv")))).alias("b0"), diff(lambda on: F.max(on(F.col("slope")))).alias("b1"),
        F.abs(diff(lambda on: F.corr(on(F.col("r")), on(F.col("dv"))))).alias("alignment"), diff(lambda on: F.avg(on(q))).alias("shift"),
        F.sum(F.when(F.col("after"), 1).otherwise(0)).alias("n1"),
    )
    b0, b1, n, n1 = (F.col(c) for c in ("b0", "b1", "n", "n1"))
    det = F.col("v00") * F.col("v11") - F.col("v01") ** 2
    wald = (b0 * b0 * F.col("v11") - 2 * b0 * b1 * F.col("v01") + b1 * b1 * F.col("v00")) / F.nullif(det, F.lit(0.0))
    se = F.sqrt(F.greatest(F.col("zz") / n, F.lit(1e-18)) * (1 / n1 + 1 / (n - n1)))
    return g.select(*by, "n", wald.alias("level"), "alignment", F.abs(F.col("shift") / se).alias("range"))


def _from_event(event: Column) -> Column:
    """Whether a row's place is at the event's or later; ``event`` may use ``n``."""
    w = Window.partitionBy("series_id")
    return F.row_number().over(w.orderBy("date")) - 1 >= event


def shifted(bars: DataFrame, event: Column) -> DataFrame:
    """Bars with ``shifted``: the close of the row before from the event on, as when a vendor's dates are a day off."""
    w = Window.partitionBy("series_id")
    b = bars.withColumn("n", F.count("*").over(w)).withColumn("late", _from_event(event))
    return b.withColumn("shifted", F.when(F.col("late"), F.coalesce(F.lag("close").over(w.orderBy("date")), F.col("close"))).otherwise(F.col("close"))).drop("n", "late")


def stretched(bars: DataFrame, event: Column, factor: float) -> DataFrame:
    """Bars whose log ranges from the open are ``factor`` times as wide from the event on, and still hold the close."""
    b = bars.withColumn("n", F.count("*").over(Window.partitionBy("series_id"))).withColumn("late", _from_event(event))
    edge = lambda c: F.col("open") * F.exp(factor * F.log(F.col(c) / F.col("open")))
    high, low = F.greatest(edge("high"), F.col("close")), F.least(edge("low"), F.col("close"))
    return b.withColumn("high", F.when(F.col("late"), high).otherwise(F.col("high"))).withColumn("low", F.when(F.col("late"), low).otherwise(F.col("low"))).drop("n", "late")


def spliced(bars: DataFrame, other: DataFrame, event: Column) -> DataFrame:
    """Bars that are another vendor's (date, open, high, low, close) from the event on, scaled to the close of the row before it.

    The other's values are taken on the bars' dates, carried forward and, before the first, back.
    """
    w = Window.partitionBy("series_id")
    o = w.orderBy("date")
    cols = ("open", "high", "low", "close")
    j = bars.join(other.select("date", *[F.col(c).alias(f"o_{c}") for c in cols]), "date", "left").withColumn("n", F.count("*").over(w)).withColumn("late", _from_event(event))
    carried = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0)), F.first(c, ignorenulls=True).over(o.rowsBetween(0, Window.unboundedFollowing)))
    j = j.select("*", *[carried(f"o_{c}").alias(f"c_{c}") for c in cols])
    before = F.lead("late").over(o) & ~F.col("late")
    scale = F.max(F.when(before, F.col("close") / F.col("c_close"))).over(w)
    j = j.withColumn("scale", scale)
    return j.select(*[c for c in bars.columns if c not in cols], *[F.when(F.col("late") & F.col("scale").isNotNull(), F.col(f"c_{c}") * F.col("scale")).otherwise(F.col(c)).alias(c) for c in cols])


def smoothness(returns: DataFrame, months: int = 120, cap: float = 0.95, least: int = 24) -> DataFrame:
    """(series_id, rho): correlation of a return with the one before over the first ``months`` of (series_id, month, r), from 0 to ``cap``; 0 with fewer than ``least`` returns."""
    w = Window.partitionBy("series_id").orderBy("month")
    f = returns.where("r IS NOT NULL").withColumn("k", F.row_number().over(w)).where(F.col("k") <= months).withColumn("before", F.lag("r").over(w))
    both = F.when(F.col("before").isNotNull(), F.col("r"))
    c = F.covar_pop("before", "r") / F.nullif(F.stddev_pop("before") * F.stddev_pop(both), F.lit(0.0))
    g = f.groupBy("series_id").agg(F.count("*").alias("n"), c.alias("c"))
    return g.select("series_id", F.when(F.col("n") < least, F.lit(0.0)).otherwise(F.least(F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(0.0)), F.lit(cap))).alias("rho"))


def desmoothed(returns: DataFrame, months: int = 120, cap: float = 0.95, least: int = 24) -> DataFrame:
    """(series_id, month, r, rho, sharp): returns with the smoothing of an appraised mark undone, (r - rho r of the month before) / (1 - rho); rho is fixed on the first months."""
    w = Window.partitionBy("series_id").orderBy("month")
    j = returns.join(F.broadcast(smoothness(returns, months, cap, least)), "series_id")
    return j.select("series_id", "month", "r", "rho", ((F.col("r") - F.col("rho") * F.lag("r").over(w)) / (1 - F.col("rho"))).alias("sharp"))


def seasonal_placebo(rows: DataFrame, every: int = 12, least: int = 3) -> DataFrame:
    """(target, t, placebo) of (target, t, month, x, j): the mean of the row's calendar month over rows strictly before the last refit, and nothing else of x.

    Refits are every ``every``-th row of the test index j; rows off the index take the first refit's means. A month needs ``least`` values.
    The means as of a refit come from one sorted pass of running sums by month.
    """
    own = Window.partitionBy("target")
    head = F.when(F.col("j") % every == 0, F.col("t"))
    at = F.coalesce(F.when(F.col("j").isNotNull(), F.max(head).over(own.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))), F.min(head).over(own))
    q = rows.select("target", "t", "month", "x", at.alias("refit"))
    run = Window.partitionBy("target", "month").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    known = q.where("x IS NOT NULL").select("target", "month", F.col("t").alias("at"), F.lit(None).cast(q.schema["t"].dataType).alias("t"), F.struct(F.count("x").over(run).alias("n"), F.avg("x").over(run).alias("mean")).alias("m"))
    asked = q.where("refit IS NOT NULL").select("target", "month", (F.col("refit") - 1).alias("at"), "t", F.lit(None).cast(known.schema["m"].dataType).alias("m"))
    last = F.last("m", ignorenulls=True).over(Window.partitionBy("target", "month").orderBy("at", F.col("t").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    return known.unionByName(asked).withColumn("m", last).where("t IS NOT NULL").select("target", "t", F.when(F.col("m.n") >= least, F.col("m.mean")).alias("placebo"))
