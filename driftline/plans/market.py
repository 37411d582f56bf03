"""Ingestion audits, proxies, features and targets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import features, frames
from driftline.operators import audit
from driftline.sources import bars as sources

from .base import BARS_SQL, SIGNALS_SQL, bars, query, r6, signals


def series():
    """Rows of a series in order."""
    return frames.ordered("series_id")


@query(f"WITH {BARS_SQL} SELECT series_id, CAST(date AS varchar) AS date, CAST(t AS bigint) AS t, open, high, low, close FROM bars")
def bars_daily(spark, sf_dir):
    """Daily bars by market."""
    return bars(spark, sf_dir).select("series_id", F.col("date").cast("string").alias("date"), F.col("t").cast("long").alias("t"), "open", "high", "low", "close")


@query("""WITH e AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, value, row(ts, event_id) AS k FROM events WHERE value > 0)
SELECT series_id, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, round(arg_min(value, k), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, k), 6) AS close FROM e GROUP BY 1, 2, hour""")
def bars_hourly(spark, sf_dir):
    """Hourly bars by event type."""
    b = sources.from_events(spark, sf_dir)
    return b.select("series_id", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), *r6(open=F.col("open"), high=F.col("high"), low=F.col("low"), close=F.col("close")))


@query(f"WITH {BARS_SQL} SELECT series_id, count(*) AS n, min(CAST(date AS varchar)) AS first_date, max(CAST(date AS varchar)) AS last_date FROM bars WHERE isodow(date) < 6 OR series_id = 'ASIA' GROUP BY 1")
def bars_gate(spark, sf_dir):
    """Weekend rows go, but for the market that trades then, before anything chains rows."""
    return audit.weekend_gate(bars(spark, sf_dir), ("ASIA",)).groupBy("series_id").agg(F.count("*").alias("n"), F.min(F.col("date").cast("string")).alias("first_date"), F.max(F.col("date").cast("string")).alias("last_date"))


CHUNKS_SQL = BARS_SQL + """,
mid AS (SELECT series_id, max(t) AS top FROM bars GROUP BY 1),
chunks AS (SELECT series_id, date, close, 0 AS chunk FROM bars JOIN mid USING (series_id) WHERE t <= top // 2 + 40
  UNION ALL SELECT series_id, date, close * CASE WHEN t % 17 = 0 THEN 1.01 ELSE 1 END, 1 FROM bars JOIN mid USING (series_id) WHERE t >= top // 2)"""


def chunks(spark, sf_dir):
    """Two overlapping halves of each series; the later one is off by 1% on some rows."""
    b = bars(spark, sf_dir)
    top = F.max("t").over(Window.partitionBy("series_id"))
    b = b.withColumn("half", F.floor(top / 2))
    one = b.where("t <= half + 40").select("series_id", "date", "close", F.lit(0).alias("chunk"))
    two = b.where("t >= half").select("series_id", "date", (F.col("close") * F.when(F.col("t") % 17 == 0, 1.01).otherwise(1.0)).alias("close"), F.lit(1).alias("chunk"))
    return one.unionByName(two)


@query(f"WITH {CHUNKS_SQL} SELECT series_id, CAST(date AS varchar) AS date, arg_min(close, chunk) AS close FROM chunks GROUP BY 1, date")
def chunk_splice(spark, sf_dir):
    """S3: union of chunks, the first one's row wins."""
    return sources.spliced(chunks(spark, sf_dir)).select("series_id", F.col("date").cast("string").alias("date"), "close")


@query(f"""WITH {CHUNKS_SQL} SELECT a.series_id, count(*) AS shared, CAST(sum(CASE WHEN abs(a.close - b.close) > 0.005 * abs(a.close) THEN 1 ELSE 0 END) AS bigint) AS mismatched,
CASE WHEN count(*) < 20 THEN 'UNVERIFIABLE' WHEN sum(CASE WHEN abs(a.close - b.close) > 0.005 * abs(a.close) THEN 1 ELSE 0 END) > 0 THEN 'MISMATCH' ELSE 'VERIFIED' END AS verdict
FROM chunks a JOIN chunks b ON a.series_id = b.series_id AND a.date = b.date AND a.chunk = 0 AND b.chunk = 1 GROUP BY 1""")
def seam_audit(spark, sf_dir):
    """Agreement of two chunks where they overlap."""
    return audit.seam(chunks(spark, sf_dir)).select("series_id", "shared", "mismatched", "verdict")


@query(f"WITH {BARS_SQL}, g AS (SELECT series_id, date, lag(date) OVER (PARTITION BY series_id ORDER BY date) AS before FROM bars WHERE t % 97 >= 6) SELECT series_id, CAST(date AS varchar) AS date, CAST((SELECT count(*) FROM range(before + 1, date + 1, INTERVAL 1 DAY) x(d) WHERE isodow(d) < 6) AS bigint) AS business_days FROM g WHERE before IS NOT NULL AND date - before > 3")
def calendar_gaps(spark, sf_dir):
    """Business days across each gap of over three days; six rows of every 97 are taken out so that there are gaps."""
    return audit.gaps(bars(spark, sf_dir).where("t % 97 >= 6"), 3).select("series_id", F.col("date").cast("string").alias("date"), "business_days")


@query("""WITH f AS (SELECT l_suppkey % 10 AS file, row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS "at", CAST(l_shipdate AS date) AS date FROM lineitem),
s AS (SELECT file, "at", sign(date - (lag(date) OVER w)) AS step FROM f WINDOW w AS (PARTITION BY file ORDER BY "at"))
SELECT CAST(file AS bigint) AS file, CAST(coalesce(sum(CASE WHEN step > 0 THEN 1 ELSE 0 END), 0) AS bigint) AS up, CAST(coalesce(sum(CASE WHEN step < 0 THEN 1 ELSE 0 END), 0) AS bigint) AS down, coalesce(bool_or(step > 0), false) <> coalesce(bool_or(step < 0), false) OR count(*) = 1 AS monotone FROM s GROUP BY 1""")
def order_guard(spark, sf_dir):
    """Dates in file order must run one way."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = Window.partitionBy(F.col("l_suppkey") % 10).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    f = rows.select((F.col("l_suppkey") % 10).alias("file"), F.row_number().over(w).alias("at"), F.to_date("l_shipdate").alias("date"))
    return audit.file_order(f)


@query(f"""WITH {BARS_SQL.replace('bars AS', 'whole AS')}, bars AS (SELECT series_id, open, CASE WHEN t % 31 = 0 THEN low * 0.9 ELSE high END AS high, CASE WHEN t % 47 = 0 THEN high * 1.1 ELSE low END AS low, CASE WHEN t % 53 = 0 THEN -close ELSE close END AS close FROM whole)
SELECT series_id, count(*) AS n, CAST(sum(CASE WHEN high < low THEN 1 ELSE 0 END) AS bigint) AS high_below_low, CAST(sum(CASE WHEN high < greatest(open, close) - 1e-9 THEN 1 ELSE 0 END) AS bigint) AS high_inside,
CAST(sum(CASE WHEN low > least(open, close) + 1e-9 THEN 1 ELSE 0 END) AS bigint) AS low_inside, CAST(sum(CASE WHEN close <= 0 THEN 1 ELSE 0 END) AS bigint) AS not_positive FROM bars GROUP BY 1""")
def row_invariants(spark, sf_dir):
    """What must hold in each bar, with violations of each kind planted."""
    t, h, low = F.col("t"), F.col("high"), F.col("low")
    b = bars(spark, sf_dir).select("series_id", "open", F.when(t % 31 == 0, low * 0.9).otherwise(h).alias("high"), F.when(t % 47 == 0, h * 1.1).otherwise(low).alias("low"), F.when(t % 53 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"))
    return audit.invariants(b)


@query(f"WITH {SIGNALS_SQL} SELECT series_id, CAST(date AS varchar) AS date, round(cc_mean, 6) AS cc_mean, round(cc_var, 6) AS cc_var, round(yz, 6) AS yz, round(rs, 6) AS rs, round(pk, 6) AS pk FROM sig")
def variance_proxies(spark, sf_dir):
    """Close-to-close (two definitions), Yang-Zhang, Rogers-Satchell, Parkinson."""
    return signals(spark, sf_dir).select("series_id", F.col("date").cast("string").alias("date"), *r6(**{c: F.col(c) for c in ("cc_mean", "cc_var", "yz", "rs", "pk")}))


@query(f"WITH {SIGNALS_SQL} SELECT series_id, CAST(t AS bigint) AS t, round(lm, 6) AS lm, round(a, 6) AS a FROM sig")
def decision_own(spark, sf_dir):
    """Log of the proxy over its trailing median, on the series' own calendar."""
    return signals(spark, sf_dir).select("series_id", F.col("t").cast("long").alias("t"), *r6(lm=F.col("lm"), a=F.col("a")))


@query(f"""WITH {SIGNALS_SQL}, cal AS (SELECT DISTINCT date FROM sig), ids AS (SELECT DISTINCT series_id FROM sig),
u AS (SELECT series_id, date, yz FROM cal CROSS JOIN ids LEFT JOIN sig USING (series_id, date)),
m AS (SELECT *, CASE WHEN count(yz) OVER f >= 30 THEN quantile_cont(yz, 0.5) OVER f END AS med FROM u WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT series_id, CAST(date AS varchar) AS date, round(ln(yz / med), 6) AS a FROM m""")
def decision_union(spark, sf_dir):
    """The same on the union calendar, where a missing day takes a row of the frame."""
    s = signals(spark, sf_dir).select("series_id", "date", "yz")
    u = s.select("date").distinct().crossJoin(F.broadcast(s.select("series_id").distinct())).join(s, ["series_id", "date"], "left")
    w = frames.ordered("series_id", "date")
    return u.select("series_id", F.col("date").cast("string").alias("date"), F.round(features.decision(F.col("yz"), w, 60, 30), 6).alias("a"))


@query(f"""WITH {SIGNALS_SQL} SELECT series_id, CAST(t AS bigint) AS t, round(a, 6) AS a, round(CASE WHEN count(a) OVER f5 >= 5 THEN avg(a) OVER f5 END, 6) AS a5, round(CASE WHEN count(a) OVER f22 >= 22 THEN avg(a) OVER f22 END, 6) AS a22 FROM sig
WINDOW f5 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), f22 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)""")
def har_block(spark, sf_dir):
    """Level and means of 5 and 22 rows."""
    s = signals(spark, sf_dir)
    return s.select("series_id", F.col("t").cast("long").alias("t"), *r6(**features.har(F.col("a"), series())))


@query(f"""WITH {SIGNALS_SQL} SELECT series_id, CAST(t AS bigint) AS t, round(lag(a, 1) OVER w, 6) AS lag1, round(lag(a, 2) OVER w, 6) AS lag2, round(lag(a, 3) OVER w, 6) AS lag3, round(lag(a, 4) OVER w, 6) AS lag4,
round(CASE WHEN count(a) OVER f66 >= 66 THEN avg(a) OVER f66 END, 6) AS mean66, round(CASE WHEN count(a) OVER f252 >= 252 THEN avg(a) OVER f252 END, 6) AS mean252, round(r, 6) AS lev, round(least(r, 0), 6) AS lev_down,
round(CASE WHEN count(r) OVER f5 >= 5 THEN avg(r) OVER f5 END, 6) AS lev5 FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY t), f5 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
f66 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 65 PRECEDING AND CURRENT ROW), f252 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
def own_extended(spark, sf_dir):
    """Lags, long means, leverage."""
    s = signals(spark, sf_dir)
    return s.select("series_id", F.col("t").cast("long").alias("t"), *r6(**features.extended(F.col("a"), F.col("r"), series())))


@query(f"""WITH {SIGNALS_SQL}, d AS (SELECT series_id, t, month(lead(date, 5) OVER (PARTITION BY series_id ORDER BY t)) AS m FROM sig)
SELECT series_id, CAST(t AS bigint) AS t, {', '.join(f'CAST(CASE WHEN m IS NOT NULL THEN CAST(m = {k} AS int) END AS int) AS m{k}' for k in range(2, 13))} FROM d""")
def calendar_dummies(spark, sf_dir):
    """Months of the rows forecast."""
    s = signals(spark, sf_dir)
    return s.select("series_id", F.col("t").cast("long").alias("t"), *[c.alias(n) for n, c in features.calendar_dummies(F.col("date"), series(), 5).items()])


@query(f"""WITH {SIGNALS_SQL} SELECT series_id, CAST(t AS bigint) AS t, round(lead(a, 5) OVER w, 6) AS y, CASE WHEN lead(a, 5) OVER w IS NOT NULL THEN CAST(lead(a, 5) OVER w > 0 AS int) END AS y_up,
round(lead(a, 5) OVER w + lead(lm, 5) OVER w - lm, 6) AS y_origin, round(CASE WHEN count(a) OVER f >= 5 THEN avg(a) OVER f END, 6) AS y_mean
FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY t), f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def targets(spark, sf_dir):
    """Continuous, binary, re-based and mean targets."""
    s = signals(spark, sf_dir)
    t = features.targets(F.col("a"), F.col("lm"), series(), 5, 5)
    return s.select("series_id", F.col("t").cast("long").alias("t"), t["y_up"].alias("y_up"), *r6(y=t["y"], y_origin=t["y_origin"], y_mean=t["y_mean"]))


@query(f"""WITH {SIGNALS_SQL}, d AS (SELECT unnest([0, 1, 2, 3, 5, 8]) AS delta) SELECT s.series_id, CAST(s.t AS bigint) AS t, CAST(delta AS int) AS delta, round(u.a, 6) AS stale, round(s.a, 6) AS fresh
FROM sig s CROSS JOIN d LEFT JOIN sig u ON u.series_id = s.series_id AND u.t = s.t - delta""")
def delayed_view(spark, sf_dir):
    """Every delay's stale value beside the current one; all delays from one window."""
    s = signals(spark, sf_dir).withColumn("d", features.delayed(F.col("a"), (0, 1, 2, 3, 5, 8), series()))
    return s.select("series_id", F.col("t").cast("long").alias("t"), F.round("a", 6).alias("fresh"), F.explode("d").alias("d")).select("series_id", "t", "fresh", "d.delta", F.round("d.stale", 6).alias("stale"))


@query(f"""WITH {SIGNALS_SQL} SELECT series_id, CAST(t AS bigint) AS t, round(CASE WHEN r IS NULL OR count(r) OVER p < 100 THEN r ELSE least(greatest(r, quantile_cont(r, 0.05) OVER p), quantile_cont(r, 0.95) OVER p) END, 6) AS r
FROM sig WINDOW p AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)""")
def winsor(spark, sf_dir):
    """Clipped to quantiles of the past only."""
    s = signals(spark, sf_dir)
    return s.select("series_id", F.col("t").cast("long").alias("t"), F.round(features.winsorised(F.col("r"), series(), 0.05, 250, 100), 6).alias("r"))


@query(f"""WITH RECURSIVE {SIGNALS_SQL}, v AS (SELECT series_id, t, r FROM sig), e AS (
SELECT series_id, t, r AS x FROM v WHERE t = 0 UNION ALL SELECT v.series_id, v.t, (1 - (1 - pow(0.5, 1.0 / 22))) * e.x + (1 - pow(0.5, 1.0 / 22)) * v.r FROM e JOIN v ON v.series_id = e.series_id AND v.t = e.t + 1)
SELECT series_id, CAST(t AS bigint) AS t, round(x, 6) AS ewma FROM e""")
def ewma(spark, sf_dir):
    """Exponential mean by half-life 22 of the returns; a missing value carries the last mean."""
    from driftline.operators.smoothing import ewm

    return ewm(signals(spark, sf_dir), "r", 22.0).select("series_id", F.col("t").cast("long").alias("t"), F.round("ewma", 6).alias("ewma"))


@query(f"WITH {SIGNALS_SQL} SELECT series_id, CAST(t AS bigint) AS t, round(last_value(CASE WHEN t % 21 = 0 THEN close END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t), 6) AS held FROM sig")
def appraisal(spark, sf_dir):
    """Revised every 21 rows, held between."""
    s = signals(spark, sf_dir)
    return s.select("series_id", F.col("t").cast("long").alias("t"), F.round(features.appraisal(F.col("close"), F.col("t"), series(), 21), 6).alias("held"))


@query(f"""WITH {SIGNALS_SQL}, m AS (SELECT series_id, month(date) AS month, avg(r) AS mean FROM sig WHERE date < DATE '2000-01-01' GROUP BY 1, 2 HAVING count(r) >= 3),
x AS (SELECT s.series_id, s.t, s.r - coalesce(mean, 0) AS adjusted FROM sig s LEFT JOIN m ON m.series_id = s.series_id AND m.month = month(s.date))
SELECT series_id, CAST(t AS bigint) AS t, round(adjusted, 6) AS adjusted, round(sum(adjusted) OVER (PARTITION BY series_id ORDER BY t), 6) AS log_level FROM x""")
def deseasonalise(spark, sf_dir):
    """Month means of the time before a cut taken off, and the level rebuilt."""
    d = features.deseasonalised(signals(spark, sf_dir), "2000-01-01")
    return d.select("series_id", F.col("t").cast("long").alias("t"), *r6(adjusted=F.col("adjusted"), log_level=F.log("level")))


@query(f"""WITH {SIGNALS_SQL}, x AS (SELECT *, lag(yz, 2) OVER w AS stale, CASE WHEN count(pk) OVER f >= 30 THEN quantile_cont(pk, 0.5) OVER f END AS med2, ln((lag(yz) OVER w) / nullif(lag(pk) OVER w, 0)) AS slope FROM sig
WINDOW w AS (PARTITION BY series_id ORDER BY t), f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT series_id, CAST(t AS bigint) AS t, round((pk - stale) / nullif(med2, 0), 6) AS premium, round(slope, 6) AS slope FROM x""")
def risk_premium(spark, sf_dir):
    """Premium of one variance over the other's stale value, and a slope of lagged tenors."""
    s = signals(spark, sf_dir)
    return s.select("series_id", F.col("t").cast("long").alias("t"), *r6(premium=features.risk_premium(F.col("pk"), F.col("yz"), series(), 2, 60, 30), slope=features.slope(F.col("yz"), F.col("pk"), series())))


@query(f"""WITH {SIGNALS_SQL}, x AS (SELECT series_id, t, a, coalesce(a, 0) AS z FROM sig) SELECT series_id, CAST(t AS bigint) AS t, round(a * a, 6) AS sq, round(z * 2 + z * z, 6) AS factor, round(sqrt(2.0 / 2) * cos(0.7 * z - 0.2 * z * z + 0.1), 6) AS rff0, round(sqrt(2.0 / 2) * cos(-0.4 * z + 1.3 * z * z + 2.0), 6) AS rff1, round(ln(1 + 3), 6) AS stale0, round(3 * a, 6) AS stale1 FROM x""")
def expansions(spark, sf_dir):
    """Squares, factor terms, Fourier features, staleness columns."""
    s = signals(spark, sf_dir).withColumn("z", F.coalesce("a", F.lit(0.0)))
    z = F.col("z")
    sq, fac = features.squares(F.array("a")), features.factor_terms(z, F.lit(1.0), F.lit(1.0))
    rff = features.fourier(F.array(z, z * z), [[0.7, -0.2], [-0.4, 1.3]], [0.1, 2.0])
    st = features.staleness(F.lit(3), F.col("a"))
    return s.select("series_id", F.col("t").cast("long").alias("t"), *r6(sq=sq[1], factor=fac[1] + fac[2] + fac[3], rff0=rff[0], rff1=rff[1], stale0=st[0], stale1=st[1]))


@query("""SELECT o_orderpriority AS key, CAST(strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS varchar) AS month, round(arg_max(o_totalprice, row(o_orderdate, o_orderkey)), 6) AS last FROM orders GROUP BY 1, 2""")
def month_end(spark, sf_dir):
    """2.H: last value of each month."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_orderpriority").alias("key"), F.date_format(F.trunc("o_orderdate", "MM"), "yyyy-MM-dd").alias("month")).agg(F.round(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")), 6).alias("last"))
