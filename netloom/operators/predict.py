"""Prediction from a fitted network."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import kernels
from netloom.functions.normalize import Preprocessing
from netloom.operators.activity import pinv_activity
from netloom.operators.aggregates import multiply
from netloom.sources.writers import load_model


def predict_static(activity: DataFrame, coefficients: DataFrame, obs: str = "obs_id") -> DataFrame:
    """(obs, target, value) = activity times coefficients."""
    return multiply(activity.select(obs, "regulator", "activity"), coefficients.select("regulator", "target", "beta"), row=obs, inner="regulator", column="target", x="activity", y="beta")


def trim_model(coefficients: DataFrame, targets: list[str] | None = None, regulators: list[str] | None = None) -> DataFrame:
    """The model's edges on the given labels; a label the model lacks raises."""
    for column, wanted in (("target", targets), ("regulator", regulators)):
        if wanted is None:
            continue
        have = {r[0] for r in coefficients.where(F.col(column).isin(wanted)).select(column).distinct().collect()}
        if lost := sorted(set(wanted) - have):
            raise KeyError(f"{column} not in the model: {lost[:5]}")
        coefficients = coefficients.where(F.col(column).isin(wanted))
    return coefficients


class Estimator:
    """A fitted network as transformer (expression to activity) and predictor (activity to expression)."""

    def __init__(self, coefficients: DataFrame, scaling: Preprocessing = Preprocessing()):
        self.coefficients, self.scaling = coefficients, scaling

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Estimator:
        """A model that ``Result.save`` wrote, with its preprocessing."""
        tables, settings = load_model(spark, folder, ["coefficients"])
        return cls(tables["coefficients"], Preprocessing(*(tuple(settings[k]) for k in ("predictors", "response", "activity"))))

    def fit(self, *_: object) -> Estimator:
        raise NotImplementedError("a saved network is not fitted again")

    def trim(self, targets: list[str] | None = None, regulators: list[str] | None = None) -> Estimator:
        return Estimator(trim_model(self.coefficients, targets, regulators), self.scaling)

    def transform(self, expression: DataFrame) -> DataFrame:
        """(obs_id, regulator, activity) through the pseudo-inverse of the coefficients."""
        prior = self.coefficients.select("target", "regulator", F.col("beta").alias("weight"))
        return pinv_activity(self.scaling.apply("activity", expression), prior, keep_self=True)

    def predict(self, activity: DataFrame) -> DataFrame:
        return predict_static(activity, self.coefficients)

    def transform_predict(self, expression: DataFrame) -> DataFrame:
        return self.predict(self.transform(expression))


def predict_dynamic(activity: DataFrame, coefficients: DataFrame, *, series: str, time: str, decay: float | DataFrame = 0.0, start: DataFrame | None = None, step_time: float = 1.0, dt: float = 0.1) -> DataFrame:
    """(series, time, target, value): forward Euler along each series; series run in parallel.

    ``decay``: one constant, or (target, decay), absent targets 0. ``start``: (series, target, value), absent ones 0.
    The model's edges travel in the closure: its size is that of the network, not of the data."""
    edges = coefficients.select("target", "regulator", "beta").toPandas()
    targets, regulators = sorted(edges["target"].unique()), sorted(edges["regulator"].unique())
    w = np.zeros((len(targets), len(regulators)))
    w[pd.Index(targets).get_indexer(edges["target"]), pd.Index(regulators).get_indexer(edges["regulator"])] = edges["beta"]
    if isinstance(decay, DataFrame):
        known = {r["target"]: r["decay"] for r in decay.select("target", "decay").join(coefficients.select("target").distinct(), "target", "left_semi").collect()}  # a row a target of the model
        rate = np.array([known.get(t) or 0.0 for t in targets])
    else:
        rate = np.full(len(targets), decay)
    rows = activity.select(series, time, "regulator", "activity", F.lit(None).cast("string").alias("_target"))
    if start is not None:  # starts travel with their series
        first = start.select(series, F.lit(None).cast(dict(activity.dtypes)[time]).alias(time), F.lit(None).cast("string").alias("regulator"), F.col("value").cast("double").alias("activity"), F.col("target").alias("_target"))
        rows = rows.unionByName(first.join(activity.select(series).distinct(), series, "left_semi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        begin = pdf[pdf["_target"].notna()]
        pdf = pdf[pdf["_target"].isna()]
        x0 = begin.set_index("_target")["activity"].reindex(targets).fillna(0.0).to_numpy(float)
        a = pdf.pivot_table(index=time, columns="regulator", values="activity", fill_value=0.0).reindex(columns=regulators, fill_value=0.0).sort_index()
        x = kernels.step_forward(w, a.to_numpy(float), rate, x0, step_time=step_time, dt=dt)
        out = pd.DataFrame(x, columns=targets, index=a.index).stack().reset_index()
        out.columns = [time, "target", "value"]
        out.insert(0, series, pdf[series].iloc[0])
        return out

    kinds = dict(activity.dtypes)
    return rows.groupBy(series).applyInPandas(run, f"{series} {kinds[series]}, {time} {kinds[time]}, target string, value double")
