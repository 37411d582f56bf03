"""Checks of dated series before use: weekend rows, seams of chunks, file order, row invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weekend_gate(bars: DataFrame, weekend_ok: tuple[str, ...] = ()) -> DataFrame:
    return bars.where((F.weekday("date") < 5) | F.col("series_id").isin(*weekend_ok))


def seam(chunks: DataFrame, least: int = 20, tolerance: float = 0.005) -> DataFrame:
    """(series_id, shared, mismatched, verdict) of chunks 0 and 1 of (series_id, date, close, chunk)."""
    a = chunks.where("chunk = 0").select("series_id", "date", F.col("close").alias("x"))
    b = chunks.where("chunk = 1").select("series_id", "date", F.col("close").alias("y"))
    off = F.sum((F.abs(F.col("x") - F.col("y")) > tolerance * F.abs("x")).cast("long"))
    g = a.join(b, ["series_id", "date"]).groupBy("series_id").agg(F.count("*").alias("shared"), off.alias("mismatched"))
    return g.withColumn("verdict", F.when(F.col("shared") < least, "UNVERIFIABLE").when(F.col("mismatched") > 0, "MISMATCH").otherwise("VERIFIED"))


def business_days(start, stop) -> F.Column:
    """Weekdays after ``start`` up to ``stop``."""
    days = F.sequence(F.date_add(start, 1), stop)
    return F.when(stop > start, F.size(F.filter(days, lambda d: F.weekday(d) < 5))).otherwise(0)


def gaps(bars: DataFrame, longer: int) -> DataFrame:
    """Rows that come more than ``longer`` days after the one before, with the business days between."""
    before = F.lag("date").over(Window.partitionBy("series_id").orderBy("date"))
    g = bars.select("series_id", "date", before.alias("before")).where(F.datediff("date", "before") > longer)
    return g.withColumn("business_days", business_days(F.col("before"), F.col("date")).cast("long"))


def discontinuity(bars: DataFrame, sds: float = 3.0) -> DataFrame:
    """(series_id, date, jump): returns beyond ``sds`` standard deviations of their series."""
    r = F.log(F.col("close") / F.lag("close").over(Window.partitionBy("series_id").orderBy("date")))
    x = bars.select("series_id", "date", r.alias("jump"))
    sd = F.stddev_samp("jump").over(Window.partitionBy("series_id"))
    return x.withColumn("sd", sd).where(F.abs("jump") > sds * F.col("sd")).drop("sd")


def file_order(rows: DataFrame) -> DataFrame:
    """(file, up, down, monotone): steps of the dates in the order of (file, at); a swap of day and month shows as both."""
    step = F.datediff("date", F.lag("date").over(Window.partitionBy("file").orderBy("at")))
    g = rows.select("file", step.alias("step")).groupBy("file").agg(F.sum((F.coalesce("step", F.lit(0)) > 0).cast("long")).alias("up"), F.sum((F.coalesce("step", F.lit(0)) < 0).cast("long")).alias("down"), F.count("*").alias("n"))
    return g.select("file", "up", "down", (((F.col("up") > 0) != (F.col("down") > 0)) | (F.col("n") == 1)).alias("monotone"))


def invariants(bars: DataFrame, slack: float = 1e-9) -> DataFrame:
    """Violations by series; all must be 0."""
    count = lambda c: F.sum(c.cast("long"))
    h, lo, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    return bars.groupBy("series_id").agg(F.count("*").alias("n"), count(h < lo).alias("high_below_low"), count(h < F.greatest(o, c) - slack).alias("high_inside"), count(lo > F.least(o, c) + slack).alias("low_inside"), count(c <= 0).alias("not_positive"))
