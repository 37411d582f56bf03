"""Registry of queries, and the tables and SQL that most of them start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import features, frames, proxies
from driftline.params import SHORT
from driftline.sources import bars as sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name, with the SQL that states it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(**cols) -> list:
    """Columns rounded to six places."""
    return [F.round(c, 6).alias(n) for n, c in cols.items()]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with t, the row's number in its series."""
    b = sources.from_lineitem(spark, sf_dir)
    return b.withColumn("t", F.row_number().over(frames.ordered("series_id", "date")) - 1)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with proxies, the log median of the Yang-Zhang variance (lm) and the decision variable (a), renumbered."""
    w = frames.ordered("series_id", "date")
    p = proxies.with_proxies(sources.from_lineitem(spark, sf_dir), w)
    m = frames.median(F.col("yz"), w, SHORT.median, SHORT.min_periods)
    return p.withColumn("lm", F.log(m)).withColumn("a", features.decision(F.col("yz"), w, SHORT.median, SHORT.min_periods)).withColumn("t", F.row_number().over(w) - 1)


def study(spark: SparkSession, sf_dir: str, h: int = 1) -> DataFrame:
    """The own-calendar study table: t, date, own block, label y and its resolved-label benchmark, for rows with a full own block."""
    w = frames.ordered("series_id")
    s = signals(spark, sf_dir)
    block = features.har(F.col("a"), w)
    s = s.select("series_id", "t", "date", "lm", *[c.alias(n) for n, c in block.items()], F.lead("a", h).over(w).alias("y"))
    past = w.rowsBetween(-(h + SHORT.span), -(h + 1))
    return s.withColumn("bench", F.coalesce(F.avg("y").over(past), F.lit(0.0)))


BARS_SQL = """px AS (
  SELECT r_name AS series_id, CAST(l_shipdate AS date) AS date, l_extendedprice / l_quantity AS price,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (SELECT series_id, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close FROM px GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS t FROM raw)"""
YZ_K = 0.34 / (1.34 + 6 / 4)
SIGNALS_SQL = BARS_SQL + f""",
ret AS (SELECT *, ln(close / lag(close) OVER w) AS r, ln(open / lag(close) OVER w) AS o, ln(close / open) AS c,
  ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)) AS rs_row,
  pow(ln(high / low), 2) / (4 * ln(2)) AS pk_row FROM raw WINDOW w AS (PARTITION BY series_id ORDER BY date)),
prox AS (SELECT series_id, date, open, high, low, close, r,
  CASE WHEN count(r) OVER f >= 5 THEN avg(r * r) OVER f END AS cc_mean, CASE WHEN count(r) OVER f >= 5 THEN var_samp(r) OVER f END AS cc_var,
  CASE WHEN count(o) OVER f >= 5 THEN greatest(var_samp(o) OVER f + {YZ_K!r} * var_samp(c) OVER f + (1 - {YZ_K!r}) * avg(rs_row) OVER f, 1e-12) END AS yz,
  CASE WHEN count(rs_row) OVER f >= 5 THEN avg(rs_row) OVER f END AS rs, CASE WHEN count(pk_row) OVER f >= 5 THEN avg(pk_row) OVER f END AS pk
  FROM ret WHERE o IS NOT NULL WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
sig0 AS (SELECT *, CASE WHEN count(yz) OVER m >= {SHORT.min_periods} THEN quantile_cont(yz, 0.5) OVER m END AS med,
  row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS t FROM prox
  WINDOW m AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN {SHORT.median - 1} PRECEDING AND CURRENT ROW)),
sig AS (SELECT *, ln(med) AS lm, ln(yz / med) AS a FROM sig0)"""
STUDY_SQL = SIGNALS_SQL + f""",
st0 AS (SELECT series_id, t, date, lm, a, CASE WHEN count(a) OVER f5 >= 5 THEN avg(a) OVER f5 END AS a5, CASE WHEN count(a) OVER f22 >= 22 THEN avg(a) OVER f22 END AS a22, lead(a, 1) OVER w AS y
  FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY t), f5 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), f22 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)),
study AS (SELECT *, coalesce(avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {SHORT.span + 1} PRECEDING AND 2 PRECEDING), 0.0) AS bench FROM st0)"""
