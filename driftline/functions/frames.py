"""Row frames over ordered series. A frame gives null until it holds enough values."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: str | list[str], order: str = "t") -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The last n rows, this one included."""
    return w.rowsBetween(-(n - 1), 0)


def guarded(value: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(frame) >= least, value)


def mean(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    f = trailing(w, n)
    return guarded(F.avg(x).over(f), x, f, n if least is None else least)


def variance(x: Column, w: WindowSpec, n: int) -> Column:
    f = trailing(w, n)
    return guarded(F.var_samp(x).over(f), x, f, n)


def quantile(x: Column, q: float, frame: WindowSpec, least: int) -> Column:
    """Linear interpolation between order statistics; ``median`` cannot take a frame, ``percentile`` can."""
    return guarded(F.percentile(x, F.lit(q)).over(frame), x, frame, least)


def median(x: Column, w: WindowSpec, n: int, least: int) -> Column:
    return quantile(x, 0.5, trailing(w, n), least)


def carried(x: Column, w: WindowSpec, limit: int | None = None) -> Column:
    """The last value, at most ``limit`` rows old."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def not_nan(x: Column) -> Column:
    """NaN is missing."""
    return F.when(~F.isnan(x), x)
