"""Recursive smoothers, one series per group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def ewm(df: DataFrame, value: str, halflife: float, order: str = "t") -> DataFrame:
    """(series_id, order, ewma): x += alpha (v - x) from the first value; a missing v leaves x as it is."""
    kept = df.select("series_id", order, value)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        alpha, x, out = 1 - 0.5 ** (1 / halflife), None, []
        for v in pdf[value]:
            if v == v and v is not None:
                x = v if x is None else x + alpha * (v - x)
            out.append(x)
        return pd.DataFrame({"series_id": pdf["series_id"], order: pdf[order], "ewma": out})

    return kept.groupBy("series_id").applyInPandas(run, f"series_id string, {order} {kept.schema[order].dataType.simpleString()}, ewma double")


def partial_adjustment(df: DataFrame, value: str, alpha: float, order: str = "t") -> DataFrame:
    """The same recursion by its weight instead of its half-life."""
    import math

    return ewm(df, value, math.log(0.5) / math.log(1 - alpha), order)
