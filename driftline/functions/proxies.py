"""Variance proxies from bars (open, high, low, close) of one series per window partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from . import frames

O, H, L, C = "open", "high", "low", "close"


def log_return(x: str, w: WindowSpec) -> Column:
    return F.log(F.col(x) / F.lag(x).over(w))


def overnight(w: WindowSpec) -> Column:
    """log(open / previous close); null on a series' first row."""
    return F.log(F.col(O) / F.lag(C).over(w))


def rogers_satchell_row() -> Column:
    u, d, c = F.log(F.col(H) / F.col(O)), F.log(F.col(L) / F.col(O)), F.log(F.col(C) / F.col(O))
    return u * (u - c) + d * (d - c)


def parkinson_row() -> Column:
    return F.pow(F.log(F.col(H) / F.col(L)), 2) / (4 * math.log(2))


def yang_zhang(o: Column, c: Column, rs: Column, w: WindowSpec, n: int = 5, floor: float = 1e-12) -> Column:
    """Overnight variance plus k of the open-to-close variance plus 1 - k of the mean range term, floored."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    frame = frames.trailing(w, n)
    v = F.var_samp(o).over(frame) + k * F.var_samp(c).over(frame) + (1 - k) * F.avg(rs).over(frame)
    return frames.guarded(F.greatest(v, F.lit(floor)), o, frame, n)


def with_proxies(bars, w: WindowSpec, n: int = 5):
    """All five proxies: cc_mean, cc_var (close to close), yz, rs, pk. A series' first row has no return and goes."""
    b = bars.withColumn("r", log_return(C, w)).withColumn("o", overnight(w)).withColumn("c", F.log(F.col(C) / F.col(O)))
    b = b.withColumn("rs_row", rogers_satchell_row()).withColumn("pk_row", parkinson_row()).where(F.col("o").isNotNull())
    r = F.col("r")
    return b.select(
        *bars.columns, "r",
        frames.mean(r * r, w, n).alias("cc_mean"), frames.variance(r, w, n).alias("cc_var"),
        yang_zhang(F.col("o"), F.col("c"), F.col("rs_row"), w, n).alias("yz"),
        frames.mean(F.col("rs_row"), w, n).alias("rs"), frames.mean(F.col("pk_row"), w, n).alias("pk"),
    )
