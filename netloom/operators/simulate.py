"""Simulated noise with the shape of the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _seed(base: int, label: str) -> int:
    import zlib

    return (base * 1_000_003 + zlib.crc32(str(label).encode())) % (1 << 32)


def noisy_counts(m: DataFrame, seed: int = 42, obs: str = "obs_id") -> DataFrame:
    """Counts redrawn per row from the features' shares of all counts; every row keeps its total.

    The shares (one number per feature) travel in the closure. Rows with a total of 0 or less give zeros."""
    sums = m.groupBy("feature").agg(F.sum("value").alias("s")).orderBy("feature").toPandas()
    share = np.maximum(sums["s"].to_numpy(float), 0)
    share = share / share.sum() if share.sum() > 0 else np.full(len(share), 1 / max(1, len(share)))
    features = sums["feature"].tolist()

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        total = max(0, int(round(pdf["value"].sum())))
        values = np.random.default_rng(_seed(seed, pdf[obs].iloc[0])).multinomial(total, share)
        return pd.DataFrame({obs: pdf[obs].iloc[0], "feature": features, "value": values.astype(float)})

    return m.select(obs, "feature", F.col("value").cast("double").alias("value")).groupBy(obs).applyInPandas(draw, f"{obs} {dict(m.dtypes)[obs]}, feature string, value double")


def noisy_values(m: DataFrame, seed: int = 42, obs: str = "obs_id") -> DataFrame:
    """Values redrawn from each feature's normal distribution, in the JVM."""
    stats = m.groupBy("feature").agg(F.avg("value").alias("_m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("_s"))
    from netloom.operators.networks import uniform

    u1, u2 = uniform(seed, obs, "feature"), uniform(seed + 1, obs, "feature")
    normal = F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * np.pi * u2)
    return m.join(stats, "feature").select(obs, "feature", (F.col("_m") + F.col("_s") * normal).alias("value"))
