"""Totals, ranks and places along a global order, without one task seeing all rows.

Rows are spread by range of the order and stored with their part; totals run within the
parts, and what earlier parts add up to (one row per part and scope) is put in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.session import materialize, parallelism


def ranged(df: DataFrame, keys: list[Column], name: str = "order") -> DataFrame:
    return materialize(df.repartitionByRange(parallelism(df.sparkSession), *keys).withColumn("_part", F.spark_partition_id()), name)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def running_totals(df: DataFrame, *, scope: list[str], order: list[Column], sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the running total (inclusive) of each column of ``sums`` {new: column} along the order.

    The order must be total within a scope. ``totals`` {new: name in sums}: the scope's whole sum, at no further pass."""
    spread = ranged(df, [*[F.col(c) for c in scope], *order])
    w = W.partitionBy("_part", *scope).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*scope).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    all_parts = W.partitionBy(*scope)
    totals = totals or {}
    parts = spread.groupBy("_part", *scope).agg(*[F.sum(c).alias(f"_total_{n}") for n, c in sums.items()])
    parts = parts.select(F.col("_part").alias("_in_part"), *[F.col(c).alias(f"_in_scope{i}") for i, c in enumerate(scope)], *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums], *[F.coalesce(F.sum(f"_total_{n}").over(all_parts), F.lit(0)).alias(f"_whole_{t}") for t, n in totals.items()])
    on = F.col("_part") == F.col("_in_part")
    for i, c in enumerate(scope):
        on = on & same(F.col(c), F.col(f"_in_scope{i}"))
    run = spread.select("*", *[F.sum(c).over(w).alias(f"_run_{n}") for n, c in sums.items()])
    run = run.join(parts, on)
    return run.select(*df.columns, *[(F.coalesce(F.col(f"_run_{n}"), F.lit(0)) + F.col(f"_before_{n}")).alias(n) for n in sums], *[F.col(f"_whole_{t}").alias(t) for t in totals])


def numbered(df: DataFrame, *, scope: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the place (from 1) of each row along a total order within its scope."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("long")), scope=scope, order=order, sums={name: "_one"}).drop("_one")


def average_ranks(df: DataFrame, *, scope: list[str], value: str, name: str = "rank", total: str | None = None) -> DataFrame:
    """(scope..., value, name): ascending rank of each distinct value, ties share the average. ``total``: also the scope's rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*scope, value).agg(F.count(F.lit(1)).alias("_n"))
    return ranks_of_counts(counts, scope=scope, value=value, name=name, total=total)


def ranks_of_counts(counts: DataFrame, *, scope: list[str], value: str, name: str = "rank", total: str | None = None) -> DataFrame:
    """The same from (scope..., value, _n): how often each distinct value occurs."""
    run = running_totals(counts, scope=scope, order=[F.col(value)], sums={"_upto": "_n"}, totals={total: "_upto"} if total else None)
    return run.select(*scope, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name), *([total] if total else []))
