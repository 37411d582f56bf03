"""Panels of many series on one calendar, with what had been published by a target's close.

Order matters: fill, then keep the target's calendar, then take the row before for late peers.
Windows stop Catalyst from moving the calendar filter below them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import frames


def outer_panel(values: DataFrame, names: list[str], value: str = "a") -> DataFrame:
    """(date, one column per name): outer alignment of all series in one grouped pass, whatever their number."""
    return values.groupBy("date").pivot("series_id", names).agg(F.first(value))


def fill_reindex(values: DataFrame, calendar: DataFrame, limit: int = 5, value: str = "a") -> DataFrame:
    """(target, t, date, series_id, value): values on a target's own calendar (target, date), carried over at most ``limit`` of its rows. Values of other dates are lost."""
    cal = calendar.withColumn("t", F.row_number().over(frames.ordered("target", "date")) - 1)
    grid = cal.crossJoin(values.select("series_id").distinct())
    joined = grid.join(values.select("series_id", "date", value), ["series_id", "date"], "left")
    w = frames.ordered(["target", "series_id"])
    return joined.withColumn(value, frames.carried(F.col(value), w, limit))


def fill_union(values: DataFrame, limit: int = 5, value: str = "a", targets: list[str] | None = None) -> DataFrame:
    """(target, t, date, series_id, value): peers carried over at most ``limit`` rows of the union calendar, then the target's rows only. The target itself is not filled.

    Each series is filled once, whatever the number of targets: a value is written to the places of the calendar up to the
    series' next one. A day's values then meet in one row, which hands them to the targets that have a value that day.
    """
    v = values.select("series_id", "date", F.col(value).alias("v"))
    every = Window.partitionBy(F.lit(0))  # days only: one short row each
    days = v.select("date").distinct().select("date", F.row_number().over(every.orderBy("date")).alias("k"), F.count("*").over(every).cast("int").alias("n"))
    s = Window.partitionBy("series_id")
    x = v.join(days, "date").withColumn("some", F.count("v").over(s)).withColumn("at", F.row_number().over(s.orderBy("k")))
    x = x.where(F.col("v").isNotNull() | ((F.col("some") == 0) & (F.col("at") == 1)))
    o = s.orderBy("k")
    x = x.select("series_id", "v", "k", F.when(F.lag("k").over(o).isNull(), 1).otherwise(F.col("k")).alias("a"), F.coalesce(F.lead("k").over(o) - 1, F.col("n")).alias("b"))
    x = x.select("series_id", "v", "k", F.explode(F.sequence("a", "b")).alias("at"))
    held = F.when((F.col("at") >= F.col("k")) & (F.col("at") <= F.col("k") + limit), F.col("v"))
    day = x.groupBy(F.col("at").alias("k")).agg(F.collect_list(F.struct("series_id", held.alias("v"), (F.col("v").isNotNull() & (F.col("at") == F.col("k"))).alias("own"))).alias("all"))
    own = F.filter("all", lambda e: e["own"] & (e["series_id"].isin(targets) if targets else F.lit(True)))
    p = day.join(days.select("k", "date"), "k").select("date", "all", F.explode(own).alias("o")).select(F.col("o.series_id").alias("target"), "date", F.explode("all").alias("e"))
    p = p.select("target", F.col("e.series_id").alias("series_id"), "date", F.col("e.v").alias(value))
    return p.withColumn("t", F.row_number().over(frames.ordered(["target", "series_id"], "date")) - 1)


def admissible(panel: DataFrame, conventions: DataFrame, value: str = "a") -> DataFrame:
    """The panel as known at the target's close: a peer that closes earlier counts on its row, any other (an equal close, too) on the row before. ``conventions``: (series_id, close_utc), few rows."""
    c = F.broadcast(conventions)
    p = panel.join(c.select("series_id", F.col("close_utc").alias("peer_close")), "series_id").join(c.select(F.col("series_id").alias("target"), F.col("close_utc").alias("own_close")), "target")
    w = frames.ordered(["target", "series_id"])
    known = F.when((F.col("series_id") == F.col("target")) | (F.col("peer_close") < F.col("own_close")), F.col(value)).otherwise(F.lag(value).over(w))
    return p.withColumn(value, known).drop("peer_close", "own_close")


def wide(panel: DataFrame, value: str = "a") -> DataFrame:
    """(target, t, date, own, peers): peers as a map of series to value, with nulls."""
    own = F.max(F.when(F.col("series_id") == F.col("target"), F.col(value)))
    peers = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("series_id") != F.col("target"), F.struct("series_id", F.col(value).alias("v"))))))
    return panel.groupBy("target", "t", "date").agg(own.alias("own"), peers.alias("peers"))


def close_instant(date: Column, local_close: Column, zone: Column) -> Column:
    """The UTC instant of a local closing time; the zone's summer time is kept."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", date.cast("string"), local_close)), zone)


def shared_dates(panels: list[DataFrame], on: list[str]) -> list[DataFrame]:
    """Each panel restricted to the rows that all have."""
    keys = panels[0].select(*on)
    for p in panels[1:]:
        keys = keys.intersect(p.select(*on))
    return [p.join(keys, on, "left_semi") for p in panels]


def training_rows(features: DataFrame, refits: DataFrame, width: int = 256) -> DataFrame:
    """Rows u of ``features`` (target, t, ...) for each refit (target, refit_id, lo, cut): lo <= u < cut.

    An equi-join on blocks of rows instead of a range join: each refit names the few blocks that it touches.
    """
    f = features.withColumn("block", F.floor(F.col("t") / width))
    r = refits.where("cut > lo").withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("cut") - 1) / width))))
    return r.join(f, ["target", "block"]).where("t >= lo AND t < cut").drop("block")


def reconcile(a: DataFrame, b: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(series_id, shared, apart): closes of two sources of one series, and how many differ by more than ``tolerance`` of the first."""
    j = a.select("series_id", "date", F.col("close").alias("x")).join(b.select("series_id", "date", F.col("close").alias("y")), ["series_id", "date"])
    return j.groupBy("series_id").agg(F.count("*").alias("shared"), F.sum((F.abs(F.col("x") - F.col("y")) > tolerance * F.abs("x")).cast("long")).alias("apart"))


def in_episodes(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rows with each named episode (name, lo, hi), few rows, that holds their date; overlapping ones repeat the row."""
    return rows.join(F.broadcast(episodes), (F.col("date") >= F.col("lo")) & (F.col("date") <= F.col("hi")))


def latest_vintage(rows: DataFrame, vintages: DataFrame, lag: int) -> DataFrame:
    """Each row (target, t) with the newest vintage (target, made, ...) made at or before t - lag; null before the first.

    One sorted pass over both instead of a range join.
    """
    cols = [c for c in vintages.columns if c not in ("target", "made")]
    a = rows.select("target", (F.col("t") - lag).alias("at"), F.col("t"), F.lit(None).cast("bigint").alias("made"), *[F.lit(None).cast(vintages.schema[c].dataType).alias(c) for c in cols])
    b = vintages.select("target", F.col("made").cast("bigint").alias("at"), F.lit(None).cast(rows.schema["t"].dataType).alias("t"), F.col("made").cast("bigint").alias("made"), *cols)
    w = Window.partitionBy("target").orderBy("at", F.col("t").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("made").isNotNull(), F.struct("made", *cols)), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("v", last).where(F.col("t").isNotNull()).select("target", "t", "v.*")


def phase(rows: DataFrame, months: tuple[int, ...]) -> DataFrame:
    """Rows of the given months of the year."""
    return rows.where(F.month("date").isin(*months))


def second_series(values: DataFrame, other: str, calendar: DataFrame, limit: int = 5, value: str = "a") -> DataFrame:
    """(target, t, date, v): another series' value as of the target's previous row, carried over at most ``limit`` of its rows."""
    f = fill_reindex(values.where(F.col("series_id") == other), calendar, limit, value)
    return f.select("target", "t", "date", F.lag(value).over(frames.ordered("target")).alias("v"))


def rungs(rows: DataFrame, shares: dict[str, float], n: int = 252, least: int = 60) -> DataFrame:
    """Rows (target, t, v) with a mask for each share: v above that quantile of its last ``n`` values; ``base``: at most the first share's. Null where there are fewer than ``least``."""
    w = frames.trailing(frames.ordered("target"), n)
    qs = {k: frames.quantile(F.col("v"), q, w, least) for k, q in shares.items()}
    return rows.select("*", (F.col("v") <= next(iter(qs.values()))).alias("base"), *[(F.col("v") > q).alias(k) for k, q in qs.items()])
