"""Projection, filtering and reshaping of long matrices and networks.

A matrix is a long table (obs_id, feature, value), a network (target, regulator, weight); zeros
are absent in sparse tables and put back by ``densify`` against the label domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MACHINE_EPS = 2.220446049250313e-16


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def melt(wide: DataFrame, ids: list[str], columns: list[str] | None = None, name: str = "feature", value: str = "value") -> DataFrame:
    """One row per cell; the columns are cast to double."""
    columns = columns or [c for c in wide.columns if c not in ids]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("n"), q(c).try_cast("double").alias("v")) for c in columns]))
    return wide.select(*[q(i) for i in ids], cells.alias("_c")).select(*[q(i) for i in ids], F.col("_c.n").alias(name), F.col("_c.v").alias(value))


def pivot(long: DataFrame, row: str, column: str, value: str, labels: list[str]) -> DataFrame:
    """One column per label: the mean of the cell's rows, 0 where there is none."""
    wide = long.groupBy(row).pivot(column, labels).agg(F.avg(value))
    return wide.select(row, *[F.coalesce(q(c), F.lit(0.0)).alias(c) for c in labels])


def domain(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """All cells of two label tables; the smaller side is meant to be a label list."""
    return rows.crossJoin(columns)


def densify(sparse: DataFrame, cells: DataFrame, keys: list[str], value: str, fill: float = 0.0) -> DataFrame:
    """Every cell of the domain, ``fill`` where the table has none."""
    return cells.join(sparse.select(*keys, value), keys, "left").select(*keys, F.coalesce(value, F.lit(fill)).alias(value))


def sparsify(dense: DataFrame, value: str) -> DataFrame:
    return dense.where(F.col(value).isNotNull() & (F.col(value) != 0))


def split_columns(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return df.drop(*columns), df.select(*[q(c) for c in columns])


def keep_labels(df: DataFrame, column: str, labels: DataFrame | list[str]) -> DataFrame:
    """Rows whose label is in the list; raises if the list is empty."""
    if isinstance(labels, list):
        if not labels:
            raise ValueError(f"no labels to keep in {column}")
        return df.where(q(column).isin(labels))
    return df.join(labels.select(labels.columns[0]).distinct().withColumnRenamed(labels.columns[0], column), column, "left_semi")


def drop_labels(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    return df.join(labels.select(F.col(labels.columns[0]).alias(column)).distinct(), column, "left_anti")


def trim_constant(m: DataFrame, *, scope: list[str] | None = None, feature: str = "feature", value: str = "value", integers: bool = False) -> DataFrame:
    """Features whose values differ by more than rounding (not at all for integers)."""
    keys = [*(scope or []), feature]
    tolerance = 0.0 if integers else 10 * MACHINE_EPS
    moving = m.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("_range")).where(F.col("_range") > tolerance).select(*keys)
    return m.join(moving, keys, "left_semi")


def count_filter(m: DataFrame, minimum: float | None, n_obs: int | Column, *, scope: list[str] | None = None, feature: str = "feature", value: str = "value", strict: bool = False) -> DataFrame:
    """Features whose sum reaches ``minimum`` per observation; then constant ones go.

    ``strict``: a negative value, or none that is a number, raises, as sums of counts mean nothing then."""
    if strict:
        v = F.col(value)
        bad = m.agg(F.count_if(v < 0).alias("negative"), F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("other")).first()
        if bad["negative"] or bad["other"]:
            raise ValueError(f"{bad['negative']} negative values and {bad['other']} that are no numbers among the counts")
    if minimum is not None:
        keys = [*(scope or []), feature]
        m = m.join(m.groupBy(*keys).agg(F.sum(value).alias("_sum")).where(F.col("_sum") >= minimum * n_obs).select(*keys), keys, "left_semi")
    return trim_constant(m, scope=scope, feature=feature, value=value)


def set_diagonal(net: DataFrame, fill: float, row: str = "target", column: str = "regulator", value: str = "weight") -> DataFrame:
    return net.withColumn(value, F.when(q(row) == q(column), F.lit(fill)).otherwise(q(value)))


def regulator_lists(net: DataFrame, value: str = "weight") -> DataFrame:
    """(target, regulators): sorted regulators with a non-zero weight."""
    return net.where(F.col(value) != 0).groupBy("target").agg(F.sort_array(F.collect_set("regulator")).alias("regulators"))


def strongest(nets: list[DataFrame], value: str = "weight") -> DataFrame:
    """The greatest weight of each edge over several adjacency tables."""
    both = nets[0]
    for n in nets[1:]:
        both = both.unionByName(n)
    return both.groupBy("target", "regulator").agg(F.max(value).alias(value))


def labels(*tables: DataFrame, how: str = "union") -> DataFrame:
    """Union or intersection of one-column label tables."""
    out = tables[0].distinct()
    for t in tables[1:]:
        out = out.union(t).distinct() if how == "union" else out.intersect(t)
    return out


def intervals(df: DataFrame, column: str) -> DataFrame:
    """``chrom:start-end`` into chrom, start, end; numbers that are missing become 0."""
    part = lambda i: F.regexp_extract(column, r"^(.*):(\d*)-(\d*)$", i)
    number = lambda i: F.coalesce(F.expr(f"try_cast(regexp_extract({column}, '^(.*):([0-9]*)-([0-9]*)$', {i}) AS BIGINT)"), F.lit(0))
    return df.withColumn("chrom", part(1)).withColumn("start", number(2)).withColumn("end", number(3))


def decoded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Binary columns as UTF-8 text."""
    return df.select(*[F.decode(q(c), "UTF-8").alias(c) if c in columns else q(c) for c in df.columns])
