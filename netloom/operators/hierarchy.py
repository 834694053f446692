"""Parent-child links to full hierarchies.

Nodes are spread over partitions; in each, chains of parents are contracted to the place
where they leave the partition (the fragment's exit). The exits form a quotient forest with
far fewer nodes, which is solved the same way, recursively; its paths are then put before
the fragments' own. A chain that never ends is seen as a circle inside one partition, at
whatever level all of it meets in one.

Placement: nodes of a small scope (task) share a partition, and so many partitions are made that each holds about
``fragment_rows``; scopes above that are cut by ``locality``, an expression that links within a chain tend to agree on. From
the second level on a node moves, by a coin of its key, to its parent's partition, so every
level shrinks the quotient by about a quarter of its linked nodes whatever the shape, and
the recursion ends. What one task holds is bounded by about ``fragment_rows``, and ``final_rows`` at the end.

Defined results
---------------
* ids are trimmed; null or empty ids are no nodes; a parent that is null, empty, in
  ``no_parent`` or names no node of the scope is no parent.
* of several rows of one node the latest by ``order`` counts; equal rows count once.
* a null, NaN or infinite weight adds nothing; the root's own weight never counts.
* nodes whose chain never ends: ``in_cycle`` true, null path, root, depth and weight.
* null scope is a scope of its own. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.session import materialize

NODE = "scope string, node string, parent string, seg array<string>, w double"
LOCAL = "scope string, node string, parent string, frag string, fseg array<string>, fw double, lpath array<string>, lsum double, exit_parent string, in_cycle boolean"


def contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chains inside one partition: for each node its fragment's topmost node, the names and
    weight gained from there (``seg`` holds the names one step gains) and the parent outside."""
    n = len(pdf)
    scope = pdf["scope"].fillna("\0null")
    parent = pdf["parent"].astype(object)
    key = pd.MultiIndex.from_arrays([scope, pdf["node"]])
    par = key.get_indexer(pd.MultiIndex.from_arrays([scope, parent.where(parent.notna(), "\0none")])).astype(np.int64)
    par[parent.isna().to_numpy()] = -1
    top, steps = np.where(par >= 0, par, np.arange(n)), (par >= 0).astype(np.int64)
    for _ in range(n.bit_length() + 1):  # pointer doubling
        steps, top = steps + steps[top], top[top]
    looped = par[top] >= 0 if n else np.zeros(0, bool)
    segs, w = pdf["seg"].to_numpy(), pdf["w"].to_numpy(float)
    path: list = [None] * n
    total = np.zeros(n)
    for i in np.argsort(steps, kind="stable"):
        if not looped[i]:
            p = par[i]
            path[i], total[i] = ([], 0.0) if p < 0 else ([*path[p], *segs[i]], total[p] + w[i])
    pick = lambda values: np.where(looped, None, np.asarray(values, dtype=object)[top]) if n else []
    fseg = [None if out else segs[t] for out, t in zip(looped, top)]
    return pd.DataFrame({
        "scope": pdf["scope"], "node": pdf["node"], "parent": parent, "frag": pick(pdf["node"].to_numpy()), "fseg": fseg, "fw": w[top],
        "lpath": path, "lsum": total, "exit_parent": pick(parent.where(parent.notna(), None).to_numpy()), "in_cycle": looped,
    })


def _solve(nodes: DataFrame, part: Column | None, level: int, fragment_rows: int, final_rows: int) -> DataFrame:
    """(scope, node, path, total, in_cycle) for every node; path null in or below a circle."""
    n = nodes.count()
    last = level > 0 and n <= final_rows  # a quotient that one task holds
    if n == 0:
        return nodes.select("scope", "node", F.col("seg").alias("path"), F.col("w").alias("total"), F.lit(False).alias("in_cycle"))
    if last:
        placed = nodes.withColumn("part", F.lit(0))
    elif level == 0 and part is not None:
        placed = nodes.withColumn("part", part)
    else:
        coin = lambda c: F.pmod(F.xxhash64("scope", c, F.lit(level)), F.lit(2))
        home = F.when(F.col("parent").isNotNull() & (coin("node") == 0) & (coin("parent") == 1), F.col("parent")).otherwise(F.col("node"))
        placed = nodes.withColumn("part", F.pmod(F.xxhash64("scope", home, F.lit(-level)), F.lit(max(2, -(-n // fragment_rows)))).cast("int"))
    local = placed.groupBy("part").applyInPandas(lambda pdf: contract(pdf), LOCAL)
    if last:
        return local.select("scope", "node", F.when(~F.col("in_cycle"), F.concat("fseg", "lpath")).alias("path"), F.when(~F.col("in_cycle"), F.col("fw") + F.col("lsum")).alias("total"), "in_cycle")
    local = materialize(local, f"fragments{level}")
    # the quotient forest: topmost nodes of fragments whose parent lies elsewhere, at that parent's fragment
    tops = local.where((F.col("node") == F.col("frag")) & F.col("exit_parent").isNotNull()).select("scope", "node", F.col("fseg").alias("seg"), F.col("fw").alias("w"), F.col("exit_parent").alias("at"))
    there = local.select(F.col("scope").alias("s2"), F.col("node").alias("at2"), F.col("frag").alias("frag2"), F.col("fseg").alias("fseg2"), F.col("fw").alias("fw2"), F.col("lpath").alias("lpath2"), F.col("lsum").alias("lsum2"), F.col("exit_parent").alias("exit2"), F.col("in_cycle").alias("cycle2"))
    circle, inner = F.col("cycle2"), F.col("exit2").isNotNull()
    quotient = tops.join(there, tops["scope"].eqNullSafe(there["s2"]) & (F.col("at") == F.col("at2"))).select(
        "scope", "node",
        F.when(circle, F.col("node")).when(inner, F.col("frag2")).alias("parent"),  # below a circle: a circle of its own
        F.when(circle, F.col("seg")).when(inner, F.concat("lpath2", "seg")).otherwise(F.concat("fseg2", "lpath2", "seg")).alias("seg"),
        F.when(circle, F.col("w")).when(inner, F.col("lsum2") + F.col("w")).otherwise(F.col("fw2") + F.col("lsum2") + F.col("w")).alias("w"),
    )
    quotient = materialize(quotient, f"quotient{level}")
    solved = _solve(quotient, None, level + 1, fragment_rows, final_rows).select(F.col("scope").alias("s3"), F.col("node").alias("n3"), F.col("path").alias("p3"), F.col("total").alias("t3"), F.col("in_cycle").alias("c3"))
    both = local.join(solved, local["scope"].eqNullSafe(solved["s3"]) & (F.col("frag") == F.col("n3")), "left")
    cyclic = F.col("in_cycle") | F.coalesce("c3", F.lit(False))
    outside = F.col("exit_parent").isNotNull()
    return both.select(
        "scope", "node",
        F.when(~cyclic, F.concat(F.when(outside, F.col("p3")).otherwise(F.col("fseg")), F.col("lpath"))).alias("path"),
        F.when(~cyclic, F.when(outside, F.col("t3")).otherwise(F.col("fw")) + F.col("lsum")).alias("total"),
        cyclic.alias("in_cycle"),
    )


def current_nodes(df: DataFrame, *, scope: str, node: str, parent: str, weight: str | None, order: list[str], no_parent: tuple[str, ...] = ("NA",)) -> DataFrame:
    """(scope, node, parent, w): the latest row of each node; parents that name no node are null."""
    q = lambda c: F.col(f"`{c}`")
    w = q(weight).cast("double") if weight else F.lit(0.0)
    up = F.trim(q(parent))
    rows = df.select(
        q(scope).alias("scope"), F.trim(q(node)).alias("node"), F.struct(*[q(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("o"),
        F.struct(F.when(~up.isin("", *no_parent), up).alias("parent"), F.when(F.isnan(w) | w.isNull() | (F.abs(w) == float("inf")), 0.0).otherwise(w).alias("w")).alias("v"),
    ).where(F.col("node").isNotNull() & (F.col("node") != ""))
    latest = rows.groupBy("scope", "node").agg(F.max(F.struct("o", "v")).alias("m")).select("scope", "node", F.col("m.v.parent").alias("parent"), F.col("m.v.w").alias("w"))
    known = latest.select(F.col("scope").alias("s1"), F.col("node").alias("n1"))
    joined = latest.join(known, latest["scope"].eqNullSafe(known["s1"]) & (F.col("parent") == F.col("n1")), "left")
    return joined.select("scope", "node", F.col("n1").alias("parent"), F.when(F.col("n1").isNotNull(), F.col("w")).otherwise(0.0).alias("w"))


def resolve(df: DataFrame, *, scope: str, node: str, parent: str, weight: str | None = None, order: list[str], no_parent: tuple[str, ...] = ("NA",), locality: Column | None = None, fragment_rows: int = 20_000, final_rows: int = 20_000) -> DataFrame:
    """(scope, node, parent, path, root, depth, total, in_cycle), one row for each node.

    ``locality``: expression over ``node`` that linked nodes tend to share; it only steers
    the placement of scopes above ``fragment_rows``.
    """
    nodes = materialize(current_nodes(df, scope=scope, node=node, parent=parent, weight=weight, order=order, no_parent=no_parent).withColumn("seg", F.array("node")), "nodes")
    sizes = nodes.groupBy("scope").count()
    large = sizes.where(F.col("count") > fragment_rows).select(F.col("scope").alias("big"), F.ceil(F.col("count") / F.lit(fragment_rows)).cast("int").alias("cuts"))
    spread = nodes.join(large, nodes["scope"].eqNullSafe(large["big"]), "left")
    near = locality if locality is not None else F.col("node")
    packs = F.lit(max(1, -(-nodes.count() // fragment_rows)))
    part = F.when(F.col("cuts").isNotNull(), F.concat_ws(":", F.lit("cut"), F.xxhash64("scope"), F.pmod(F.xxhash64(near), F.col("cuts")))).otherwise(F.concat_ws(":", F.lit("pack"), F.pmod(F.xxhash64("scope"), packs)))
    solved = _solve(spread.select("scope", "node", "parent", "seg", "w", part.alias("at")), F.col("at"), 0, fragment_rows, final_rows)
    up = nodes.select(F.col("scope").alias("s0"), F.col("node").alias("n0"), "parent")
    return solved.join(up, solved["scope"].eqNullSafe(up["s0"]) & (F.col("node") == F.col("n0"))).select(
        "scope", "node", "parent", "path", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), "total", "in_cycle"
    ).withColumn("depth", F.when(F.col("path").isNotNull(), F.col("depth")))


def descendants(resolved: DataFrame) -> DataFrame:
    """(scope, node, descendant, steps): all later nodes of every node, as rows.

    Read off the paths, so without a join; rows, as a root may have any number of descendants.
    Nodes in or below a circle have no path and give no rows here but in ``circle_descendants``.
    """
    up = resolved.where(F.col("depth") > 0).select("scope", F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("pos", "node"))
    return up.select("scope", "node", "descendant", (F.col("depth") - F.col("pos")).alias("steps"))


def circle_descendants(resolved: DataFrame) -> DataFrame:
    """(scope, node, descendant, steps): all later nodes of every node in or below a circle, as rows.

    Each pair of different nodes counts once, with the fewest steps; no node is later than itself. By doubling:
    ``near`` holds all earlier nodes up to ``reach`` steps back, ``jump`` the node ``reach`` steps back. It ends with
    the first round that adds nothing, as a chain gives new nodes without a gap until it meets itself.
    """
    jump = materialize(resolved.where("in_cycle").select("scope", F.col("node").alias("descendant"), F.col("parent").alias("node")), "circles")
    near = jump.where(F.col("node") != F.col("descendant")).select("scope", "node", "descendant", F.lit(1).alias("steps"))
    known, reach = near.count(), 1
    while known:
        at = jump.select(F.col("scope").alias("s1"), F.col("descendant").alias("from"), F.col("node").alias("via"))
        far = near.join(at, near["scope"].eqNullSafe(at["s1"]) & (F.col("descendant") == F.col("via"))).where(F.col("node") != F.col("from"))
        far = far.select("scope", "node", F.col("from").alias("descendant"), (F.col("steps") + reach).alias("steps"))
        wider = materialize(near.unionByName(far).groupBy("scope", "node", "descendant").agg(F.min("steps").alias("steps")), f"near{reach}")
        if (found := wider.count()) == known:
            break
        on = jump.join(at.withColumnRenamed("via", "next"), jump["scope"].eqNullSafe(at["s1"]) & (F.col("node") == F.col("from")))
        jump = materialize(on.select("scope", "descendant", F.col("next").alias("node")), f"jump{reach}")
        near, known, reach = wider, found, 2 * reach
    return near
