"""Bars and dated series from CSV files and from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Closing hour of each derived market, in UTC. Ties are on purpose: equal closes count as later.
CLOSE_UTC = {"ASIA": 8.0, "AFRICA": 16.5, "EUROPE": 16.5, "MIDDLE EAST": 13.0, "AMERICA": 21.0}


def number(c: str) -> F.Column:
    """A quoted cell with thousands commas as a double; null if it isn't one."""
    return F.regexp_replace(F.trim(F.col(f"`{c}`")), '[",]', "").try_cast("double")


def day(c: str) -> F.Column:
    """ISO or month-first dates; null if neither."""
    text = F.trim(F.regexp_replace(F.col(f"`{c}`"), '"', ""))
    return F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy")]))


def read_bars(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, date, open, high, low, close) of CSV files with any of the known headers; at numbers a file's rows in their order.

    Rows with a missing cell go; of rows with one date the first in the file stays.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path).withColumn("file", F.col("_metadata.file_name"))
    names = {c.strip().strip('"').lower(): c for c in raw.columns}
    close = names.get("price") or names["close"]
    at = F.row_number().over(Window.partitionBy("file").orderBy(F.monotonically_increasing_id()))
    b = raw.select("file", at.alias("at"), day(names["date"]).alias("date"), *[number(names[c]).alias(c) for c in ("open", "high", "low")], number(close).alias("close")).na.drop()
    first = F.row_number().over(Window.partitionBy("file", "date").orderBy("at"))
    return b.withColumn("k", first).where("k = 1").drop("k")


def matching(files: list[str], keyword: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """Files, in order, whose lower-case base name has the keyword and no excluded word."""
    base = lambda f: f.replace("\\", "/").rsplit("/", 1)[-1].lower()
    return sorted(f for f in files if keyword.lower() in base(f) and not any(x.lower() in base(f) for x in exclude))


def spliced(chunks: DataFrame, rank: str = "chunk") -> DataFrame:
    """One row per series and date: that of the least chunk."""
    first = F.row_number().over(Window.partitionBy("series_id", "date").orderBy(rank))
    return chunks.withColumn("k", first).where("k = 1").drop("k", rank)


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (series_id, date, open, high, low, close): a market per supplier region, price per unit shipped that day."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    where = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("series_id"))
    price = t("lineitem").join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return price.groupBy("series_id", F.to_date("l_shipdate").alias("date")).agg(F.min_by(p, key).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, key).alias("close"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars (series_id, hour, ...): a market per event type, over positive values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    key, v = F.struct("ts", "event_id"), F.col("value")
    return e.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("hour")).agg(F.min_by(v, key).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, key).alias("close"))


def conventions(spark: SparkSession) -> DataFrame:
    """(series_id, close_utc): few rows, a constant of the study."""
    return spark.createDataFrame(list(CLOSE_UTC.items()), "series_id string, close_utc double")
