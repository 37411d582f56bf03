"""Features of one series per window partition: decision variable, own blocks, targets, delayed views."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from . import frames


def decision(x: Column, w: WindowSpec, n: int = 252, least: int = 30) -> Column:
    """log of x over its trailing median."""
    return F.log(x / frames.median(x, w, n, least))


def har(a: Column, w: WindowSpec, spans: tuple[int, ...] = (5, 22)) -> dict[str, Column]:
    return {"a": a} | {f"a{n}": frames.mean(a, w, n) for n in spans}


def extended(a: Column, r: Column, w: WindowSpec, lags: int = 4, long: tuple[int, ...] = (66, 252)) -> dict[str, Column]:
    """Lags, long means, and leverage terms of the returns r."""
    out = {f"lag{k}": F.lag(a, k).over(w) for k in range(1, lags + 1)}
    out |= {f"mean{n}": frames.mean(a, w, n) for n in long}
    down = F.least(r, F.lit(0.0))
    return out | {"lev": r, "lev_down": F.when(r.isNotNull(), down), "lev5": frames.mean(r, w, 5)}


def measures(short: Column, long: Column, w: WindowSpec, n: int = 252, least: int = 30) -> dict[str, Column]:
    """A slower measure against its own median, and the level of the faster one, which its median hides."""
    return {"slow": F.log(long / frames.median(long, w, n, least)), "level": F.log(frames.median(short, w, n, least))}


def gapped(peers: Column, w: WindowSpec, gap: int) -> Column:
    """Peers as they were ``gap`` rows ago: a second delay, of the fresh side."""
    return F.lag(peers, gap).over(w) if gap else peers


def targets(a: Column, log_median: Column, w: WindowSpec, h: int, k: int) -> dict[str, Column]:
    """Value and sign h rows on, the value against the origin's median, and the mean of the next k."""
    ahead = w.rowsBetween(1, k)
    later = F.lead(a, h).over(w)
    return {
        "y": later, "y_up": F.when(later.isNotNull(), (later > 0).cast("int")), "y_origin": later + F.lead(log_median, h).over(w) - log_median,
        "y_mean": F.when(F.count(a).over(ahead) >= k, F.avg(a).over(ahead)),
    }


def calendar_dummies(date: Column, w: WindowSpec, h: int) -> dict[str, Column]:
    """Eleven indicators of the month that is forecast (the first month is the base); null where the horizon leaves the sample."""
    m = F.month(F.lead(date, h).over(w))
    return {f"m{k}": F.when(m.isNotNull(), (m == k).cast("int")) for k in range(2, 13)}


def delayed(x: Column, delays: tuple[int, ...], w: WindowSpec) -> Column:
    """An array of (delta, x delta rows ago), for ``explode``: every delay from one window."""
    return F.array(*[F.struct(F.lit(d).alias("delta"), (F.lag(x, d).over(w) if d else x).alias("stale")) for d in delays])


def finite_mean(xs: Column) -> Column:
    """Mean of the values of an array that are there; null if none is."""
    some = F.filter(xs, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))


def winsorised(x: Column, w: WindowSpec, q: float = 0.01, n: int = 1250, least: int = 252) -> Column:
    """x clipped to its q and 1 - q quantiles of the n rows before; as it is until there are enough."""
    past = w.rowsBetween(-n, -1)
    lo, hi = frames.quantile(x, q, past, least), frames.quantile(x, 1 - q, past, least)
    return F.when(lo.isNull() | x.isNull(), x).otherwise(F.least(F.greatest(x, lo), hi))


def appraisal(x: Column, t: Column, w: WindowSpec, every: int) -> Column:
    """The value at each ``every``-th row, held until the next."""
    return F.last(F.when(t % every == 0, x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def risk_premium(implied: Column, realised: Column, w: WindowSpec, delay: int, n: int = 252, least: int = 30) -> Column:
    """Implied minus realised variance of ``delay`` rows ago, over the implied median."""
    stale = F.lag(realised, delay).over(w) if delay else realised
    return (implied - stale) / F.nullif(frames.median(implied, w, n, least), F.lit(0.0))


def slope(short: Column, long: Column, w: WindowSpec) -> Column:
    """Log ratio of a short to a long tenor, both of the row before."""
    return F.log(F.lag(short).over(w) / F.nullif(F.lag(long).over(w), F.lit(0.0)))


def squares(xs: Column) -> Column:
    return F.concat(xs, F.transform(xs, lambda x: x * x))


def factor_terms(g: Column, own0: Column, iv0: Column) -> Column:
    """The factor, its square, and its products with the own and the implied level."""
    return F.array(g, g * g, g * own0, g * iv0)


def fourier(xs: Column, weights: list[list[float]], phases: list[float]) -> Column:
    """Random Fourier features sqrt(2 / m) cos(w x + b) for given draws."""
    scale = math.sqrt(2 / len(phases))
    dot = lambda row: F.aggregate(F.zip_with(xs, F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.array(*[scale * F.cos(dot(row) + float(b)) for row, b in zip(weights, phases)])


def staleness(delta: Column, own: Column) -> Column:
    """Columns for one model over all delays: log(1 + delta) and delta times the own level."""
    return F.array(F.log1p(delta), delta * own)


def month_means_before(df, cut: str, value: str = "r", least: int = 3):
    """Mean by series and calendar month over rows strictly before ``cut``, with at least ``least`` values."""
    g = df.where(F.col("date") < F.lit(cut).cast("date")).groupBy("series_id", F.month("date").alias("month")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return g.where(F.col("n") >= least).drop("n")


def deseasonalised(df, cut: str, value: str = "r"):
    """``value`` without its month's mean of the time before ``cut``, and the level that such returns add up to."""
    out = df.withColumn("month", F.month("date")).join(month_means_before(df, cut, value), ["series_id", "month"], "left")
    w = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("adjusted", F.col(value) - F.coalesce("mean", F.lit(0.0)))
    return out.withColumn("level", F.exp(F.sum("adjusted").over(w))).drop("month", "mean")


def smoothing_lag(every: int, alpha: float) -> float:
    """Mean lag of a value revised every ``every`` rows by partial adjustment ``alpha``."""
    return (every - 1) / 2 + every * (1 - alpha) / alpha
