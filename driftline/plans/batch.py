"""Queries in batches that a broken run takes up again."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = "name string, rows long, seconds double"


def done(spark: SparkSession, out: str) -> DataFrame:
    """(name, rows, seconds) of the queries that earlier runs finished; none if nothing was written yet."""
    try:
        return spark.read.schema(DONE).parquet(f"{out}/done")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DONE)


def run(spark: SparkSession, sf_dir: str, out: str, queries: dict, names: Iterable[str] | None = None, limit: int | None = None) -> list[str]:
    """Write each query's result under ``out`` and then a row that says so; queries with such a row are not run again. Returns the names run.

    ``limit`` ends a batch after so many queries. A query that was cut off has no row: its result is overwritten.
    """
    names = list(queries if names is None else names)
    unknown = sorted(set(names) - set(queries))
    if unknown:
        raise KeyError(f"no such query: {unknown}")
    past = {r["name"] for r in done(spark, out).where(F.col("name").isin(names)).select("name").distinct().collect()}
    todo = [n for n in dict.fromkeys(names) if n not in past][:limit]
    for n in todo:
        t = time.monotonic()
        queries[n](spark, sf_dir).write.mode("overwrite").parquet(f"{out}/results/{n}")
        rows = spark.read.parquet(f"{out}/results/{n}").count()
        spark.createDataFrame([(n, rows, time.monotonic() - t)], DONE).coalesce(1).write.mode("append").parquet(f"{out}/done")
    return todo
