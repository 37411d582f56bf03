"""A series as a latent autoregression seen with noise: parameters by moments, states by recursion, parameters renewed as time goes on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import models, panel


def vintages(series: DataFrame, first: int, every: int, x: str = "a") -> DataFrame:
    """(series_id, made, n, phi, q, r) at rows t = first, first + every, ... of (series_id, t, x): persistence, shock and noise variance from the values before that row.

    Autocovariances at lags 0 to 2 of the values that are there, one after another. All vintages come
    from one pass of running sums; t counts rows from 0. The persistence lies in 0 .. 0.999.
    """
    w = Window.partitionBy("series_id").orderBy("t")
    v = series.where(F.col(x).isNotNull() & ~F.isnan(x)).select("series_id", "t", F.col(x).cast("double").alias("v"), F.row_number().over(w).alias("k"))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    lag = lambda k: F.lag("v", k).over(w)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).over(past)
    s = v.select(
        "series_id", "t", F.col("k").alias("n"), total(F.col("v")).alias("s"), *[total(F.col("v") * (lag(k) if k else F.col("v"))).alias(f"p{k}") for k in (0, 1, 2)],
        *[total(F.when(F.col("k") <= k, F.col("v"))).alias(f"head{k}") for k in (1, 2)], F.col("v").alias("tail1"), (F.col("v") + F.coalesce(lag(1), F.lit(0.0))).alias("tail2"),
    )
    m, n = F.col("s") / F.col("n"), F.col("n")
    cov = lambda k: (F.col(f"p{k}") - m * ((2 * F.col("s") - F.col(f"head{k}") - F.col(f"tail{k}")) if k else 2 * F.col("s")) + (n - k) * m * m) / n
    g = s.select("series_id", "t", "n", *[cov(k).alias(f"g{k}") for k in (0, 1, 2)])
    phi = F.when(F.abs("g1") > 1e-12, F.least(F.greatest(F.col("g2") / F.col("g1"), F.lit(0.0)), F.lit(0.999))).otherwise(0.0)
    level = F.greatest(F.when(F.col("phi") > 1e-9, F.col("g1") / F.col("phi")).otherwise(0.0), F.lit(1e-12))
    ends = series.groupBy("series_id").agg(F.max("t").alias("end"))
    made = ends.where(F.col("end") >= first).select("series_id", F.explode(F.sequence(F.lit(first), F.col("end").cast("int"), F.lit(every))).alias("made"))
    # A vintage takes the sums of the last value before it: one sorted pass, no range join.
    p = g.withColumn("phi", phi).withColumn("level", level).select("series_id", F.col("t").alias("at"), F.lit(None).cast("int").alias("made"), F.struct("n", "phi", (F.col("level") * (1 - F.col("phi") ** 2)).alias("q"), F.greatest(F.col("g0") - F.col("level"), F.lit(1e-9)).alias("r")).alias("p"))
    both = p.unionByName(made.select("series_id", (F.col("made") - 1).cast(p.schema["at"].dataType).alias("at"), "made", F.lit(None).cast(p.schema["p"].dataType).alias("p")))
    newest = F.last("p", ignorenulls=True).over(Window.partitionBy("series_id").orderBy("at", F.col("made").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("p", newest).where("made IS NOT NULL AND p IS NOT NULL").select("series_id", "made", "p.*")


def states(series: DataFrame, params: DataFrame, x: str = "a") -> DataFrame:
    """(series_id, made, t, state, var): for each vintage of ``params``, the filtered state of (series_id, t, x) at every row; a missing value carries the state forward.

    A group is one series under one set of parameters.
    """
    kept = series.select("series_id", F.col("t").cast("int").alias("t"), F.col(x).cast("double").alias("x")).join(params.select("series_id", F.col("made").cast("int").alias("made"), "phi", "q", "r"), "series_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        phi, q, r = (float(pdf[c].iloc[0]) for c in ("phi", "q", "r"))
        out = np.zeros((len(pdf), 2))
        m, p = 0.0, q / max(1 - phi * phi, 1e-6)
        for i, v in enumerate(pdf["x"].to_numpy()):
            m, p = phi * m, phi * phi * p + q
            if np.isfinite(v):
                gain = p / (p + r)
                m, p = m + gain * (v - m), (1 - gain) * p
            out[i] = m, p
        return pd.DataFrame({"series_id": pdf["series_id"], "made": pdf["made"], "t": pdf["t"], "state": out[:, 0], "var": out[:, 1]})

    return kept.groupBy("series_id", "made").applyInPandas(run, "series_id string, made int, t int, state double, var double")


def live_states(series: DataFrame, first: int, every: int, lag: int, x: str = "a") -> DataFrame:
    """(series_id, t, made, state): the state at each row under the newest parameters made ``lag`` rows before it or earlier; rows before the first vintage have none."""
    params = vintages(series, first, every, x)
    rows = series.select(F.col("series_id").alias("target"), F.col("t").cast("int").alias("t"))
    inforce = panel.latest_vintage(rows, params.select(F.col("series_id").alias("target"), "made"), lag).where("made IS NOT NULL")
    return states(series, params, x).join(inforce.select(F.col("target").alias("series_id"), "t", F.col("made").cast("int").alias("made")), ["series_id", "t", "made"]).select("series_id", "t", "made", "state")


def factor_states(rows: DataFrame, delays: tuple[int, ...], first: int, every: int | None, lag: int, least: int = 100) -> DataFrame:
    """(target, delta, t, made, state) of (target, t, own array, peers array): the common factor as known at t when the own value stops ``delta`` rows before and peers go on.

    Parameters come from all rows before ``made`` = first, first + every, ...; a row uses the newest that are ``delta + lag`` rows old.
    Without ``every`` those of the first rows serve all rows, earlier ones too, as if known in advance. A vintage
    needs ``least`` rows without holes. A group is one target under one set of parameters.
    """
    w = Window.partitionBy("target")
    made = F.sequence(F.lit(first), F.greatest("end", F.lit(first)).cast("int"), F.lit(every)) if every else F.array(F.lit(first))
    parts = rows.withColumn("end", F.max("t").over(w)).select("target", F.col("t").cast("int").alias("t"), F.get("own", F.lit(0)).alias("own"), "peers", F.explode(made).alias("made"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        t, at = pdf["t"].to_numpy(), int(pdf["made"].iloc[0])
        width = max((len(v) for v in pdf["peers"] if v is not None), default=0)
        peers = np.array([np.full(width, np.nan) if v is None else v for v in pdf["peers"]], float).reshape(len(pdf), width)
        obs = np.column_stack([pdf["own"].to_numpy(float), peers])
        past = obs[t < at]
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        par = models.factor_parameters(past) if np.isfinite(past).all(1).sum() >= least else None
        for d in delays if par else ():
            use = (t - d - lag >= at) & (t - d - lag < at + every) if every else t >= d
            out.append((np.full(use.sum(), d), t[use], models.kalman(obs, par, d)[use]))
        delta, t, state = (np.concatenate(x) for x in zip(*out))
        name = pdf["target"].iloc[0]
        return pd.DataFrame([(name, int(d), int(i), at, float(x)) for d, i, x in zip(delta, t, state)], columns=["target", "delta", "t", "made", "state"])

    s = parts.groupBy("target", "made").applyInPandas(run, "target string, delta int, t int, made int, state double")
    return s.where("NOT isnan(state)")
