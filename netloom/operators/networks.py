"""Prior and gold-standard networks: alignment, splits, shuffles and noise.

Networks are long tables (target, regulator, weight). Label tables are small beside edges, yet nothing
here collects them: splits and shuffles order labels by a seeded hash. Where the exact legacy stream
of a generator is wanted, ``order`` takes a table (label, place) made on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.ordering import numbered

KEYS = ["target", "regulator"]


def check_filled(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: nothing left")
    return df


def on_axis(axis: int) -> str:
    if axis not in (0, 1):
        raise ValueError("axis must be 0 (targets) or 1 (regulators)")
    return KEYS[axis]


def null_network(targets: DataFrame, regulators: DataFrame) -> DataFrame:
    """All cells of the two label tables with weight 0."""
    return targets.select(F.col(targets.columns[0]).alias("target")).crossJoin(regulators.select(F.col(regulators.columns[0]).alias("regulator"))).withColumn("weight", F.lit(0.0))


def align(prior: DataFrame, targets: DataFrame) -> DataFrame:
    """The prior's regulators over all given targets, 0 where it says nothing; other targets go.

    With a column ``task`` in both, task by task."""
    if "task" in prior.columns and "task" in targets.columns:
        name = next(c for c in targets.columns if c != "task")
        cells = targets.select("task", F.col(name).alias("target")).distinct().join(prior.select("task", "regulator").distinct(), "task")
        return cells.join(prior.select("task", *KEYS, "weight"), ["task", *KEYS], "left").select("task", *KEYS, F.coalesce("weight", F.lit(0.0)).alias("weight"))
    cells = null_network(targets, prior.select("regulator").distinct()).drop("weight")
    return cells.join(prior.select(*KEYS, "weight"), KEYS, "left").select(*KEYS, F.coalesce("weight", F.lit(0.0)).alias("weight"))


def without_gold(prior: DataFrame, gold: DataFrame, axis: int) -> DataFrame:
    """The prior without the labels of an axis that the gold standard holds."""
    return prior.join(gold.select(on_axis(axis)).distinct(), on_axis(axis), "left_anti")


def repeated_labels(net: DataFrame) -> DataFrame:
    """Edges given more than once."""
    return net.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def shuffled(labels: DataFrame, seed: int, column: str) -> DataFrame:
    """(column, place): labels in the order of a seeded hash, from 1."""
    keyed = labels.select(column).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(column))))
    return numbered(keyed, scope=[], order=[F.col("_h"), F.col(column)]).drop("_h")


def split_axis(prior: DataFrame, gold: DataFrame, axis: int, ratio: float, seed: int = 42, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hold out a share of the gold standard's labels; the prior loses them.

    The first int((1 - ratio) * n) labels stay for the prior, the rest are the new gold standard."""
    c = on_axis(axis)
    placed = order if order is not None else shuffled(gold, seed, c)
    n = placed.count()
    held = placed.where(F.col("place") > int((1 - ratio) * n)).select(c)
    return prior.join(held, c, "left_anti"), gold.join(held, c, "left_semi")


def split_edges(gold: DataFrame, ratio: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Disjoint parts of the gold standard's edges; a cell's weight is 0 in the part it is not in.

    The first int(ratio * edges) edges are taken from the prior part."""
    edges = gold.where("weight != 0").withColumn("_e", F.concat_ws("\t", *KEYS))
    placed = shuffled(edges, seed, "_e")
    n = placed.count()
    held = edges.join(placed.where(F.col("place") <= int(ratio * n)).select("_e"), "_e", "left_semi").select(*KEYS, F.lit(True).alias("_held"))
    both = gold.join(held, KEYS, "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    part = lambda keep: both.select(*KEYS, F.when(keep, F.col("weight")).otherwise(0.0).alias("weight"))
    return part(~F.col("_held")), part(F.col("_held"))


def cross_validate(prior: DataFrame, gold: DataFrame, axis: int | None, ratio: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Split by targets (0), regulators (1) or edges (None: the gold standard stays whole)."""
    if axis is None:
        return split_edges(gold, ratio, seed)[0], gold
    return split_axis(prior, gold, axis, ratio, seed)


def shuffle_labels(net: DataFrame, axis: int, seed: int = 42) -> DataFrame:
    """Edges with an axis' labels permuted; -1 permutes both."""
    if axis == -1:
        return shuffle_labels(shuffle_labels(net, 0, seed), 1, seed)
    c = on_axis(axis)
    to = numbered(net.select(c).distinct(), scope=[], order=[F.col(c)], name="_p").select(F.col("_p"), F.col(c).alias("_to"))
    pick = shuffled(net, seed, c).select(F.col("place").alias("_p"), F.col(c).alias("_from"))
    return net.join(pick.join(to, "_p"), net[c] == F.col("_from")).withColumn(c, F.col("_to")).drop("_p", "_from", "_to")


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.conv(F.substring(F.md5(F.concat_ws("\t", F.lit(str(seed)), *columns)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def add_noise(cells: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Weights as 0 or 1, and 1 where a cell's uniform number is at most ``ratio``.

    The threshold is the ratio itself, the uniform's quantile, so no sort is needed."""
    return cells.select(*[c for c in cells.columns if c not in (*KEYS, "weight")], *KEYS, ((F.col("weight") != 0) | (uniform(seed, *KEYS) <= ratio)).cast("double").alias("weight"))


def regulator_status(prior: DataFrame, measured: DataFrame, keep_self: bool = False) -> DataFrame:
    """(regulator, status): ``activity`` with any edge (self-edges only if kept), ``expression`` without one but measured, else ``dropped``."""
    edge = F.col("weight") != 0 if keep_self else (F.col("weight") != 0) & (F.col("target") != F.col("regulator"))
    per = prior.groupBy("regulator").agg(F.count_if(edge).alias("_n"))
    seen = measured.select(F.col(measured.columns[0]).alias("regulator")).distinct().withColumn("_m", F.lit(True))
    return per.join(seen, "regulator", "left").select("regulator", F.when(F.col("_n") > 0, "activity").when(F.col("_m"), "expression").otherwise("dropped").alias("status"))


def ranked_prior(net: DataFrame, score: str, seed: int = 42) -> DataFrame:
    """Per regulator: targets ranked by descending score, ties in seeded random order."""
    keyed = net.withColumn("_u", uniform(seed, *KEYS))
    return numbered(keyed, scope=["regulator"], order=[F.desc_nulls_last(score), F.col("_u"), F.col("target")], name="rank").drop("_u")


def homology_groups(labels: DataFrame, key: str, task: str = "task", label: str = "feature") -> DataFrame:
    """(key, members): sorted (task, label) pairs of each group over all tasks."""
    return labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(F.struct(task, label))).alias("members"))


def map_labels(m: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Labels replaced by their group (mapping: label, group); unmapped labels raise."""
    lost = m.join(mapping.select(F.col("label").alias(column)), column, "left_anti")
    if not lost.isEmpty():
        raise KeyError(f"{column} without a group")
    return m.join(mapping.select(F.col("label").alias(column), "group"), column).withColumn(column, F.col("group")).drop("group")


def homology_tasks(m: DataFrame, mapping: DataFrame, column: str, task: str = "task", value: str = "value", obs: str = "obs_id") -> DataFrame:
    """Tasks brought onto common labels: each label gives way to its group (``mapping``: label, group; a column ``task`` where tasks
    have maps of their own), labels without a group go, labels of one group in a sample are averaged, and groups a task doesn't have
    are columns of zeros, so that every task has the union of all groups."""
    on = [c for c in (task,) if c in mapping.columns]
    named = m.join(mapping.select(*on, F.col("label").alias(column), "group").distinct(), [*on, column]).groupBy(task, obs, F.col("group").alias(column)).agg(F.avg(value).alias(value))
    groups = named.select(column).distinct()
    lacking = named.select(task).distinct().crossJoin(groups).join(named.select(task, column).distinct(), [task, column], "left_anti")
    zeros = named.select(task, obs).distinct().join(lacking, task).select(task, obs, column, F.lit(0.0).alias(value))
    return named.select(task, obs, column, value).unionByName(zeros)
