"""References to records that do not exist.

Parent keys are integers within a group. Sorted, they are compressed into contiguous runs ``[first, last]``. A
reference is matched as-of to the run that starts last at or before it, and is an orphan if
there is none or its key lies beyond the run's end.

Named keys (``named_orphans``) get dense integers first: all names of parents and references are numbered in their order, so
parents without a gap in between form one run, and a run ends only where a name is missing. References whose name
lies beyond a run's end are orphans whatever their time; for the others the parents' lifetimes, as integers (microseconds),
are compressed and matched in the same way within each name.

Scale: names are numbered as distinct rows, spread by range. Parent intervals are merged twice, first within salted parts of a
group, so that a parent delivered a million times shrinks before its group meets. References are distinct
rows before they meet the runs; groups with more than ``hot_rows`` of them, and more than a thousandth of all, are salted, and the runs
of just these groups are copied to every salt. So there are at most 1,000 of them.

Defined results
---------------
* a null group column is a value of its own; a null key of a parent interval drops the interval;
  a reference with a null key is an orphan, as nothing is known to exist then.
* an interval whose end lies before its start is empty; a null end is open.
* equal references count once in ``orphans``; empty parents: every reference is an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.ordering import numbered
from netloom.session import materialize

OPEN = (1 << 63) - 1
MOST_HOT = 1000
BLOCK = 16  # bits of a dense key that stay in one task


def runs(parents: DataFrame, group: list[str], first: Column, last: Column | None = None, salts: int = 16) -> DataFrame:
    """(group..., first, last): maximal runs of integers covered by the parents' intervals.

    Neighbouring integers join: {1,2,3,7} gives [1,3] and [7,7]."""
    spans = parents.select(*group, first.cast("long").alias("first"), (F.coalesce(last.cast("long"), F.lit(OPEN)) if last is not None else first.cast("long")).alias("last")).where("first is not null and last >= first").distinct()

    def merge(df: DataFrame, by: list[str]) -> DataFrame:
        w = W.partitionBy(*by).orderBy("first", "last")
        reach = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
        fresh = F.when(reach.isNull() | (F.col("first") > F.when(reach == OPEN, reach).otherwise(reach + 1)), 1).otherwise(0)
        return df.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*by, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")

    # blocks of neighbouring keys stay together: only then a part's keys form runs
    salted = spans.withColumn("_salt", F.pmod(F.shiftright("first", 20), F.lit(salts)))
    return merge(merge(salted, [*group, "_salt"]).drop("_salt"), group)


def unmatched(refs: DataFrame, parent_runs: DataFrame, group: list[str], key: str, hot_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """The references without a run, with all their columns; null-safe in the group columns."""
    g = [f"_g{i}" for i in range(len(group))]
    keyed = refs.select("*", *[F.col(c).alias(a) for c, a in zip(group, g)], F.col(key).cast("long").alias("_at"))
    sizes = keyed.groupBy(*g).count()
    share = sizes.agg(F.sum("count").alias("_all"))  # one row
    hot = sizes.crossJoin(F.broadcast(share)).where((F.col("count") > hot_rows) & (F.col("count") * MOST_HOT > F.col("_all"))).select(*[F.col(a).alias(f"h{a}") for a in g])  # at most MOST_HOT rows
    is_hot = lambda df: df.join(F.broadcast(hot), [F.col(a).eqNullSafe(F.col(f"h{a}")) for a in g], "left").withColumn("_hot", F.col(f"h{g[0]}").isNotNull()).drop(*[f"h{a}" for a in g])
    columns = refs.columns
    left = is_hot(keyed).select(*g, "_at", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_last"), F.struct(*columns).alias("_row"), F.when(F.col("_hot"), F.pmod(F.xxhash64("_at", *columns), F.lit(salts)).cast("int")).otherwise(0).alias("_salt"))
    right = is_hot(parent_runs.select(*[F.col(c).alias(a) for c, a in zip(group, g)], "first", "last")).select(
        *g, F.col("first").alias("_at"), F.lit(0).alias("_kind"), F.col("last").alias("_last"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"),
    )
    as_of = W.partitionBy(*g, "_salt").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_end", F.last("_last", ignorenulls=True).over(as_of))
    lost = F.col("_at").isNull() | F.col("_end").isNull() | (F.col("_at") > F.col("_end"))
    return both.where((F.col("_kind") == 1) & lost).select("_row.*")


def orphans(refs: DataFrame, parents: DataFrame, *, group: list[str], ref_key: Column, first: Column, last: Column | None = None, out: list[str], hot_rows: int = 200_000) -> DataFrame:
    """Distinct ``out`` columns of the references whose key no parent's run covers."""
    known = list(dict.fromkeys([*out, *group]))
    asked = refs.select(*known, ref_key.cast("long").alias("_key")).distinct()
    return unmatched(asked, runs(parents, group, first, last), group, "_key", hot_rows).select(*out).distinct()


def named_keys(refs: DataFrame, parents: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group..., key, id, block, is_parent): all names of both sides, numbered from 1 in their order."""
    names = lambda df, flag: df.select(*group, key).distinct().withColumn("is_parent", F.lit(flag))
    both = names(refs, 0).unionByName(names(parents, 1)).groupBy(*group, key).agg(F.max("is_parent").alias("is_parent"))
    placed = numbered(both, scope=[], order=[*[F.col(c).asc_nulls_first() for c in group], F.col(key)], name="id")
    return placed.withColumn("block", F.shiftright("id", BLOCK))


def key_runs(keys: DataFrame) -> DataFrame:
    """(block, first, last): the runs of the parents' dense keys; a run ends at a block's border at the latest."""
    return runs(keys.where("is_parent = 1"), ["block"], F.col("id"))


def named_orphans(refs: DataFrame, parents: DataFrame, *, group: list[str], key: str, at: str, first: str, last: str, out: list[str], hot_rows: int = 200_000) -> DataFrame:
    """Distinct ``out`` columns of the references to a name (``key``, within ``group``) that no parent bears at that time.

    ``refs``: group..., key, at (integer), out...; ``parents``: group..., key, first, last (integers; ``last`` null: open)."""
    columns = list(dict.fromkeys([*group, key, at, *out]))
    asked = materialize(refs.select(*columns).distinct(), "asked")  # read three times
    parents = materialize(parents.where(F.col(key).isNotNull()).groupBy(*group, key, first).agg(F.max(F.coalesce(last, F.lit(OPEN))).alias(last)), "parents")
    keys = materialize(named_keys(asked, parents, group, key), "keys")
    gone = unmatched(keys.where("is_parent = 0").select("id", "block"), key_runs(keys), ["block"], "id", hot_rows)
    on = lambda a, b: [a[c].eqNullSafe(b[f"k_{c}"]) for c in [*group, key]]
    named = lambda df, *more: df.select(*[F.col(c).alias(f"k_{c}") for c in [*group, key]], *more)
    lost = named(keys.join(gone.select("id"), "id", "left_semi"))
    known = named(keys.where("is_parent = 1"), "id")
    absent = asked.join(lost, on(asked, lost), "left_semi").select(*out)
    timed = asked.join(known, on(asked, known)).select("id", F.col(at).alias("_key"), *out)
    lives = parents.join(known, on(parents, known)).select("id", F.col(first).alias("_first"), F.col(last).alias("_last"))
    late = unmatched(timed, runs(lives, ["id"], F.col("_first"), F.col("_last")), ["id"], "_key", hot_rows).select(*out)
    return absent.unionByName(late).distinct()
