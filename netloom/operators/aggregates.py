"""Row and feature statistics, bootstrap summaries and cross products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.ordering import average_ranks, ranks_of_counts
from netloom.session import materialize


def not_finite(v: Column) -> Column:
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def moments(m: DataFrame, by: list[str], value: str = "value", n: Column | None = None) -> DataFrame:
    """Sum, mean and sample deviation per key; ``n`` counts the cells of a sparse table, zeros included."""
    if n is None:
        return m.groupBy(*by).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    sums = m.groupBy(*by).agg(F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("_sq"))
    mean = F.col("total") / n
    return sums.select(*by, "total", mean.alias("mean"), F.sqrt(F.greatest(F.col("_sq") - n * mean * mean, F.lit(0.0)) / (n - 1)).alias("sd"))


def load_report(m: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Per feature: cells, and those that are no finite number."""
    return m.groupBy(feature).agg(F.count(F.lit(1)).alias("cells"), F.count_if(not_finite(F.col(value))).alias("not_finite"))


def bootstrap_summary(stack: DataFrame, replicates: Column | int, keys: list[str] | None = None, beta: str = "beta") -> DataFrame:
    """Sign sum, non-zero count, mean and median of each edge over all replicates, absent cells being zero.

    The median needs only the edge's own rows: zeros are counted in, not added as rows."""
    keys = keys or ["target", "regulator"]
    agg = stack.groupBy(*keys).agg(
        F.sum(F.signum(beta)).alias("sign_sum"), F.count_if(F.col(beta) != 0).alias("non_zero"), F.sum(beta).alias("_sum"),
        F.sort_array(F.collect_list(F.when(F.col(beta) != 0, F.col(beta)))).alias("_v"),
    )
    r = replicates if isinstance(replicates, Column) else F.lit(replicates)
    below = F.size(F.filter("_v", lambda x: x < 0))
    at = lambda i: F.when(i < below, F.get("_v", i)).when(i < below + (r - F.size("_v")), F.lit(0.0)).otherwise(F.get("_v", i - (r - F.size("_v"))))
    low, high = F.floor((r - 1) / 2).cast("int"), F.floor(r / 2).cast("int")
    return agg.select(*keys, "sign_sum", "non_zero", (F.col("_sum") / r).alias("mean"), ((at(low) + at(high)) / 2).alias("median"))


def rank_sum_confidence(stack: DataFrame, *, replicate: str = "bootstrap", keys: list[str] | None = None, score: str = "score") -> DataFrame:
    """(keys..., combined_confidences): ranks of all cells of a replicate, ties averaged, summed over
    replicates and scaled to 0..1 by the least sum and replicates times cells.

    ``stack`` holds every cell of the domain; a null score has no rank. Zeros, most of the cells, meet no rank: their common rank in a replicate comes
    from the counts (one row a replicate)."""
    keys = keys or ["target", "regulator"]
    ranks = materialize(average_ranks(stack, scope=[replicate], value=score, name="_rank"), "ranks").select(F.col(replicate).alias("_b"), F.col(score).alias("_s"), "_rank")
    zero = ranks.where("_s = 0").select("_b", F.col("_rank").alias("_zero"))
    live = stack.where(F.col(score) != 0)
    some = live.join(ranks, live[replicate].eqNullSafe(ranks["_b"]) & (live[score] == ranks["_s"])).select(*keys, F.col("_rank"))
    none = stack.where(F.coalesce(F.col(score) == 0, F.lit(True))).select(*keys, replicate, score)
    none = none.join(F.broadcast(zero), none[replicate].eqNullSafe(zero["_b"]), "left").select(*keys, F.when(F.col(score) == 0, F.col("_zero")).alias("_rank"))
    summed = some.unionByName(none).groupBy(*keys).agg(F.sum("_rank").alias("_total"), F.count(F.lit(1)).alias("_reps"))
    edge = summed.agg(F.min("_total").alias("_least"), (F.sum("_reps")).alias("_most"))  # one row
    return summed.crossJoin(F.broadcast(edge)).select(*keys, F.coalesce(F.try_divide(F.col("_total") - F.col("_least"), F.col("_most") - F.col("_least")), F.lit(0.0)).alias("combined_confidences"))


def sparse_rank_sum(stack: DataFrame, cells: DataFrame, replicates: int, *, scope: list[str] | None = None, replicate: str = "bootstrap", keys: list[str] | None = None, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """The same where ``stack`` holds only cells with a score other than 0; ``cells`` (scope..., cells): the size of each domain.

    Returns (scope..., keys..., combined_confidences) of the cells it holds, and (scope..., rest), the confidence of all others.
    Zeros are counted, never stored: a replicate's missing cells share one rank by arithmetic, so work follows the edges, not the
    domain. Tables of one row a scope or replicate are broadcast; both are settings of a run."""
    scope, keys = scope or [], keys or ["target", "regulator"]
    meet = lambda a, b, how="inner": a.join(F.broadcast(b), scope, how) if scope else a.crossJoin(F.broadcast(b))
    live = stack.where(F.col(score).isNotNull() & (F.col(score) != 0))
    counts = materialize(live.groupBy(*scope, replicate, score).agg(F.count(F.lit(1)).alias("_n")), "counts")
    stored = counts.groupBy(*scope, replicate).agg(F.sum("_n").alias("_k"))
    zeros = meet(stored, cells).select(*scope, replicate, F.lit(0.0).alias(score), (F.col("cells") - F.col("_k")).alias("_n")).where("_n > 0")
    ranks = materialize(ranks_of_counts(counts.unionByName(zeros), scope=[*scope, replicate], value=score, name="_rank"), "ranks")
    zero = ranks.where(F.col(score) == 0).select(*scope, replicate, F.col("_rank").alias("_zero"))
    missing = replicates - F.coalesce("_seen", F.lit(0))  # a replicate without any edge ranks all cells alike
    of_zero = zero.groupBy(*scope).agg(F.sum("_zero").alias("_zeros"))
    seen = stored.groupBy(*scope).agg(F.count(F.lit(1)).alias("_seen"))
    base = meet(meet(cells, seen, "left"), of_zero, "left").select(*scope, "cells", (F.coalesce("_zeros", F.lit(0.0)) + missing * (F.col("cells") + 1) / 2).alias("_base"))
    gain = live.join(ranks, [*scope, replicate, score]).join(F.broadcast(zero), [*scope, replicate], "left")
    gains = materialize(gain.groupBy(*scope, *keys).agg(F.sum(F.col("_rank") - F.coalesce("_zero", F.lit(0.0))).alias("_gain")), "sums")
    low = gains.groupBy(*scope).agg(F.min("_gain").alias("_low"), F.count(F.lit(1)).alias("_held"))
    least = F.col("_base") + F.least(F.coalesce("_low", F.lit(0.0)), F.when(F.coalesce("_held", F.lit(0)) < F.col("cells"), 0.0).otherwise(F.coalesce("_low", F.lit(0.0))))
    edge = materialize(meet(base, low, "left").select(*scope, "_base", least.alias("_least"), (replicates * F.col("cells") - least).alias("_span")), "edge")
    conf = lambda total: F.coalesce(F.try_divide(total - F.col("_least"), F.col("_span")), F.lit(0.0))
    return meet(gains, edge).select(*scope, *keys, conf(F.col("_base") + F.col("_gain")).alias("combined_confidences")), edge.select(*scope, conf(F.col("_base")).alias("rest"))


def gram(m: DataFrame, *, obs: str = "obs_id", feature: str = "feature", value: str = "value", other: DataFrame | None = None) -> DataFrame:
    """(a, b, dot): sums of products over observations of all pairs of features (a from ``m``, b from ``other`` or ``m``)."""
    left = m.select(F.col(obs).alias("_o"), F.col(feature).alias("a"), F.col(value).alias("_x"))
    right = (m if other is None else other).select(F.col(obs).alias("_o"), F.col(feature).alias("b"), F.col(value).alias("_y"))
    return left.join(right, "_o").groupBy("a", "b").agg(F.sum(F.col("_x") * F.col("_y")).alias("dot"))


def multiply(left: DataFrame, right: DataFrame, *, row: str, inner: str, column: str, x: str, y: str, out: str = "value") -> DataFrame:
    """Matrix product of two long matrices over their shared label."""
    return left.select(row, inner, F.col(x).alias("_x")).join(right.select(inner, column, F.col(y).alias("_y")), inner).groupBy(row, column).agg(F.sum(F.col("_x") * F.col("_y")).alias(out))


def chunked(df: DataFrame, order: str, value: str, size: int, how: str = "avg") -> DataFrame:
    """Aggregate of fixed-size chunks of a numbered vector."""
    return df.groupBy(F.floor(F.col(order) / size).alias("chunk")).agg(getattr(F, how)(value).alias("value"))


def tasks_of_features(features: DataFrame, task: str = "task", feature: str = "feature") -> DataFrame:
    """(feature, tasks): sorted tasks in which a feature occurs."""
    return features.select(task, feature).distinct().groupBy(feature).agg(F.sort_array(F.collect_list(task)).alias("tasks"))


def features_of_tasks(features: DataFrame, at_least: int | str, n_tasks: int | None = None, task: str = "task", feature: str = "feature") -> DataFrame:
    """Features seen in at least so many tasks; 'union' and 'intersection' are 1 and all."""
    per = features.groupBy(feature).agg(F.countDistinct(task).alias("n"))
    if at_least == "union":
        return per.select(feature)
    if at_least == "intersection":
        total = features.agg(F.countDistinct(task).alias("_all"))
        return per.crossJoin(F.broadcast(total)).where(F.col("n") == F.col("_all")).select(feature)
    return per.where(F.col("n") >= at_least).select(feature)


def regression_summary(edges: DataFrame, beta: str = "beta", targets: DataFrame | None = None) -> DataFrame:
    """Models, mean number of predictors per model, models without any.

    ``targets``: all that were fitted, one row each; models without an edge leave no other trace."""
    per = edges.groupBy("target").agg(F.count_if(F.col(beta) != 0).alias("n"))
    if targets is not None:
        per = targets.select(F.col(targets.columns[0]).alias("target")).distinct().join(per, "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("models"), F.avg("n").alias("mean_predictors"), F.count_if(F.col("n") == 0).alias("null_models"))


def task_aggregate(stack: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Over tasks: sum of the signs of each task's sign sum, and the median of explained shares."""
    keys = keys or ["target", "regulator"]
    per = stack.groupBy("task", *keys).agg(F.sum(F.signum("beta")).alias("_signs"), F.median("share").alias("_share"))
    return per.groupBy(*keys).agg(F.sum(F.signum("_signs")).alias("sign_sum"), F.median("_share").alias("median_share"), F.count(F.lit(1)).alias("tasks"))
