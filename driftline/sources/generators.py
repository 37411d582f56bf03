"""Seeded synthetic series; recursions run one series or draw per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def factor_panel(spark: SparkSession, n: int, peers: int = 6, seed: int = 1, phi: float = 0.97, shock: float = 0.35, own_phi: float = 0.90, noise: float = 0.55, panels: int = 1) -> DataFrame:
    """(panel, t, series_id, a): a common AR(1) factor with loadings, and an AR(1) of its own for each series; S0 is the target."""

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                rng = np.random.default_rng([seed, int(k)])
                g = np.zeros(n)
                u = np.zeros((n, peers + 1))
                for t in range(1, n):
                    g[t] = phi * g[t - 1] + shock * rng.normal()
                    u[t] = own_phi * u[t - 1] + noise * np.sqrt(1 - own_phi**2) * rng.normal(size=peers + 1)
                load = rng.uniform(0.6, 1.0, peers + 1)
                for i in range(peers + 1):
                    yield pd.DataFrame({"panel": int(k), "t": np.arange(n), "series_id": f"S{i}", "a": g * load[i] + u[:, i]})

    return spark.range(panels).repartition(panels).mapInPandas(run, "panel long, t int, series_id string, a double")


def latent(spark: SparkSession, n: int, phi: float, eta: float, seed: int = 1) -> DataFrame:
    """(t, x, z): an AR(1) state of unit variance, and its observation with noise of share eta."""

    def run(batches):
        for pdf in batches:
            for _ in pdf["id"]:
                rng = np.random.default_rng(seed)
                x = np.zeros(n)
                e = rng.normal(size=n) * np.sqrt(1 - phi * phi)
                x[0] = rng.normal()
                for t in range(1, n):
                    x[t] = phi * x[t - 1] + e[t]
                yield pd.DataFrame({"t": np.arange(n), "x": x, "z": x + rng.normal(size=n) * np.sqrt(eta / (1 - eta))})

    return spark.range(1).mapInPandas(run, "t int, x double, z double")


def truncated_average(spark: SparkSession, n: int, order: int, seed: int = 1) -> DataFrame:
    """(t, x): a moving average of equal weights over ``order`` shocks, so memory ends there."""

    def run(batches):
        for pdf in batches:
            for _ in pdf["id"]:
                e = np.random.default_rng(seed).normal(size=n + order - 1)
                yield pd.DataFrame({"t": np.arange(n), "x": np.convolve(e, np.ones(order) / np.sqrt(order), "valid")})

    return spark.range(1).mapInPandas(run, "t int, x double")
