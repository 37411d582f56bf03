"""Structured Streaming forms: hourly bars with a watermark, and the panel's last known values by key.

The batch operators have no streaming counterpart to match; these give the same bars and the same
publication rule on a stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(series_id, hour, open, high, low, close) of positive values; rows later than the watermark are dropped by Spark."""
    e = events.where("value > 0").withWatermark("ts", late)
    key, v = F.struct("ts", "event_id"), F.col("value")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("series_id")).agg(F.min_by(v, key).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, key).alias("close"))
    return g.select("series_id", F.col("w.start").alias("hour"), "open", "high", "low", "close")


def exponential(events: DataFrame, alpha: float) -> DataFrame:
    """(series_id, ts, level): a keyed recursive mean over each key's rows in the order in which batches bring them."""

    def step(key, batches, state):
        level = state.get[0] if state.exists else None
        for pdf in batches:
            pdf, out = pdf.sort_values(["ts", "event_id"]), []
            for v in pdf["value"]:
                level = v if level is None else level + alpha * (v - level)
                out.append(level)
            yield pd.DataFrame({"series_id": key[0], "ts": pdf["ts"], "level": out})
        if level is not None:
            state.update((float(level),))

    e = events.where("value IS NOT NULL").select(F.col("event_type").alias("series_id"), "event_id", "ts", "value")
    return e.groupBy("series_id").applyInPandasWithState(step, "series_id string, ts timestamp, level double", "level double", "append", "NoTimeout")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, as a table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
