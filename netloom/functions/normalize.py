"""Normalization and element-wise transforms of long matrices."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.aggregates import not_finite


def _joined(m: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    return m.join(stats, keys)


def clip(c: Column, limit: float | None) -> Column:
    return c if limit is None else F.least(F.greatest(c, F.lit(-limit)), F.lit(limit))


def zscore(m: DataFrame, *, keys: list[str] | None = None, value: str = "value", limit: float | None = None, ddof: int = 1) -> DataFrame:
    """Centred and scaled per feature; features without variance become 0.

    One partial aggregate and a join: no window holds a feature's rows."""
    keys = keys or ["feature"]
    stats = m.groupBy(*keys).agg(F.avg(value).alias("_m"), (F.stddev_samp(value) if ddof else F.stddev_pop(value)).alias("_sd"), (F.max(value) == F.min(value)).alias("_flat"))
    z = F.when(F.col("_flat") | F.col("_sd").isNull() | (F.col("_sd") == 0), 0.0).otherwise((F.col(value) - F.col("_m")) / F.col("_sd"))
    return _joined(m, stats, keys).withColumn(value, clip(z, limit)).drop("_m", "_sd", "_flat")


def robust_scale(m: DataFrame, *, keys: list[str] | None = None, value: str = "value", limit: float | None = None) -> DataFrame:
    """Divided by the distance of the exact quartiles per feature; a distance of 0 counts as 1."""
    keys = keys or ["feature"]
    stats = m.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    width = F.col("_q")[1] - F.col("_q")[0]
    return _joined(m, stats, keys).withColumn(value, clip(F.col(value) / F.when(width == 0, 1.0).otherwise(width), limit)).drop("_q")


METHODS: dict[str, Callable] = {"zscore": zscore, "robustscaler": robust_scale, "raw": lambda m, **_: m}


def by_column(m: DataFrame, f: Callable[[np.ndarray], np.ndarray], *, keys: list[str] | None = None, obs: str = "obs_id", value: str = "value") -> DataFrame:
    """A function of whole columns on each feature: it gets the values in the order of the observations and gives as many.

    A feature's values meet in one task; what the built-in expressions can state should not come here."""
    keys = keys or ["feature"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(obs, kind="stable")
        new = np.asarray(f(pdf[value].to_numpy(float)), float)
        if new.shape != (len(pdf),):
            raise ValueError(f"the function gave {new.shape} for {len(pdf)} values")
        return pdf.assign(**{value: new})

    rows = m.select(*keys, obs, F.col(value).cast("double").alias(value))
    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


@dataclass(frozen=True)
class Preprocessing:
    """Methods and limits for predictors, response and activity input; '' keeps what is set."""

    predictors: tuple[str, float | None] = ("zscore", None)
    response: tuple[str, float | None] = ("zscore", None)
    activity: tuple[str, float | None] = ("raw", None)

    def with_(self, **methods: str | tuple[str, float | None]) -> Preprocessing:
        new = {}
        for part, m in methods.items():
            name, limit = m if isinstance(m, tuple) else (m, None)
            if name == "":
                continue
            if name not in METHODS:
                raise ValueError(f"unknown method {name!r}")
            new[part] = (name, limit)
        return replace(self, **new)

    def apply(self, part: str, m: DataFrame, **kw) -> DataFrame:
        name, limit = getattr(self, part)
        return METHODS[name](m, limit=limit, **kw)


def library_to_one(m: DataFrame, *, row: list[str] | None = None, value: str = "value") -> DataFrame:
    row = row or ["obs_id"]
    return m.join(m.groupBy(*row).agg(F.sum(value).alias("_t")), row).withColumn(value, F.try_divide(value, "_t")).drop("_t")


def library_to_median(m: DataFrame, *, row: list[str] | None = None, value: str = "value", scope: list[str] | None = None) -> DataFrame:
    """Row totals brought to the median of the row totals (of each scope)."""
    row, scope = row or ["obs_id"], scope or []
    totals = m.groupBy(*scope, *row).agg(F.sum(value).alias("_t"))
    middle = totals.groupBy(*scope).agg(F.median("_t").alias("_m"))
    factor = totals.join(middle, scope) if scope else totals.crossJoin(F.broadcast(middle))  # one row
    return m.join(factor, [*scope, *row]).withColumn(value, F.try_divide(value, F.try_divide("_t", "_m"))).drop("_t", "_m")


def batch_medians(m: DataFrame, batch: str, *, row: str = "obs_id", value: str = "value") -> DataFrame:
    """Each batch brought to the median of the batches' median row totals."""
    totals = m.groupBy(batch, row).agg(F.sum(value).alias("_t"))
    per = totals.groupBy(batch).agg(F.median("_t").alias("_b"))
    middle = per.agg(F.median("_b").alias("_m"))
    return m.join(per.crossJoin(F.broadcast(middle)), batch).withColumn(value, F.try_divide(value, F.try_divide("_b", "_m"))).drop("_b", "_m")


def sizes_within_batch(m: DataFrame, batch: str, *, row: str = "obs_id", value: str = "value") -> DataFrame:
    """Row totals brought to their batch's median row total."""
    return library_to_median(m, row=[row], value=value, scope=[batch])


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "log10": lambda v: F.log10(v + 1), "log2": lambda v: F.log2(v + 1), "ln": F.log1p, "ftt": lambda v: F.sqrt(v + 1) + F.sqrt(v) - 1,
}


def transform(m: DataFrame, how: str | Callable[[Column], Column], value: str = "value") -> DataFrame:
    f = TRANSFORMS[how] if isinstance(how, str) else how
    return m.withColumn(value, f(F.col(value)))


def with_factor(m: DataFrame, factors: DataFrame, keys: list[str], operation: str, value: str = "value") -> DataFrame:
    """Add, subtract, multiply or divide by a factor (column ``factor``) per row or feature."""
    ops = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: a / b}
    return m.join(factors.select(*keys, F.col("factor").alias("_f")), keys).withColumn(value, ops[operation](F.col(value).cast("double"), F.col("_f"))).drop("_f")


@dataclass(frozen=True)
class Chain:
    """Preprocessing steps applied in order: names of ``TRANSFORMS`` or functions of a DataFrame."""

    steps: tuple = field(default_factory=tuple)

    def then(self, step: str | Callable, **kw) -> Chain:
        if isinstance(step, str) and step not in TRANSFORMS:
            raise ValueError(f"unknown step {step!r}")
        return Chain((*self.steps, (step, kw)))

    def apply(self, m: DataFrame, value: str = "value", check: bool = True) -> DataFrame:
        for step, kw in self.steps:
            m = transform(m, step, value) if isinstance(step, str) else step(m, **kw)
        if check and not m.where(not_finite(F.col(value))).isEmpty():
            raise ValueError("preprocessing left values that are not finite")
        return m
