"""One ranking from several differently-scaled scores (Borda count).

Each score is turned into competition ranks within its scope (ties share the average
rank), a rank into points between 0 and 1, a missing score into the middle, and the weighted
points are summed. Only order counts, so no range, unit or outlier outweighs another.

Ranks come from running totals over the distinct values of each scope: values are spread by range, each part is summed on
its own, and the parts' totals (one row per part and scope) are added in front. No task
holds a scope, however large. Values that many items share (zeros) meet their rank by
a join whose rank side has one row per value; adaptive execution splits such keys.

Defined results
---------------
* null, NaN and infinite scores are missing: 0.5 points. A scope with one scored item gives
  it 0.5 points. Zero is a score.
* a null scope is a scope of its own. Empty table: empty result.
* repeated items: combine them before; the sort ends with the identifier columns, so the order is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators import ordering
from netloom.session import materialize


def finite(c: Column) -> Column:
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v + F.lit(0.0))


def points(df: DataFrame, scope: str, values: list[str]) -> DataFrame:
    """(scope, k, value, points) for each distinct value of the k-th score: 1 for the highest, 0 for the lowest rank.

    All scores are ranked in one pass: the score's number is part of the scope."""
    stacked = df.select(F.col(scope).alias("_s"), F.posexplode(F.array(*values)).alias("k", "_v"))
    ranks = ordering.average_ranks(stacked, scope=["_s", "k"], value="_v", name="_rank", total="_m")
    return ranks.select("_s", "k", "_v", F.when(F.col("_m") > 1, (F.col("_rank") - 1) / (F.col("_m") - 1)).otherwise(0.5).alias("points"))


def borda(df: DataFrame, *, scope: str, scores: dict[str, float]) -> DataFrame:
    """``df`` with ``<score>_points`` and ``borda`` (the weighted sum, to 12 places)."""
    out = df.withColumns({c: finite(F.col(c)) for c in scores})
    ranked = materialize(points(out, scope, list(scores)), "points")
    total = F.lit(0.0)
    for k, (c, weight) in enumerate(scores.items()):
        p = ranked.where(F.col("k") == k).select("_s", "_v", F.col("points").alias(f"{c}_points"))
        out = out.join(p, out[scope].eqNullSafe(p["_s"]) & (out[c] == p["_v"]), "left").drop("_s", "_v").withColumn(f"{c}_points", F.coalesce(f"{c}_points", F.lit(0.5)))
        total = total + F.col(f"{c}_points") * weight
    return out.withColumn("borda", F.round(total, 12))


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with the place of each row in a total order, without one task seeing all rows."""
    return ordering.numbered(df, scope=[], order=order, name=name)
