"""Mixing sources to target weights.

Token weights of the cells (source, language, topic) are raked by iterative proportional
fitting: to each source's target tokens, and to the languages' and topics' own shares as far as
the sources allow; the source step comes last. Rounds go on until no weight moves by more than ``TOLERANCE``. A weight is the
expected number of copies and never exceeds the source's cap. Each record
then gets the whole part of its cell's weight as copies, and one more if its uniform hash falls below
the fraction, scaled per source so that the tokens reached come as close to the target as
whole records allow. The scale comes from two histograms over hash thresholds, and in the one bin in which they pass the target from the
draws themselves, one by one; all of it is summed and cut in Spark.

Sizes: up to ``max_cells`` cells of source, language and topic are raked on the driver, more by the same steps in Spark, every cell and
label by itself (``rake_in_spark``); the bound decides only where. More than ``max_sources`` sources are refused, as a table of settings
that long may be a mistake; None takes any number, and so do the queries.

Defined results
---------------
* source names are trimmed and lowered; a source that is null or has no target gives nothing.
* null language or topic: the label ``none``. Texts without tokens are never taken.
* a source too small even at its cap gives all it has, ``max_repeats`` times, and falls short; the
  others keep their targets (share of the token total). A source without records reaches 0.
* equal ids are one draw (the hash decides); targets named twice: the first by share counts; null repeats: 0.
* the same input gives the same selection. Empty table: empty selection, report with zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.session import discard, materialize, stored

BINS = 4096
TOLERANCE = 1e-9
MAX_ROUNDS = 2000
MAX_SOURCES = 5000
AXES = ("source", "lang", "topic")
Cell = tuple[str, str, str]


@dataclass(frozen=True)
class Fit:
    """Raked weights: copies for each cell (None where they were raked in Spark), rounds taken, the last move, and the largest relative miss of each axis' margins."""

    weights: dict[Cell, float] | None
    rounds: int
    moved: float
    misses: dict[str, float]


def rake(tokens: dict[Cell, float], want: dict[str, float], cap: dict[str, int], max_rounds: int = MAX_ROUNDS) -> Fit:
    """``want``: tokens per source; ``cap``: most copies. Cells at their cap stay there, the others of a margin take up the rest."""
    cells = [c for c, t in tokens.items() if t > 0 and c[0] in want]
    if not cells:
        return Fit({}, 0, 0.0, dict.fromkeys(AXES, 0.0))
    mass = np.array([float(tokens[c]) for c in cells])
    most = np.array([float(cap[c[0]]) for c in cells])
    labels, at = zip(*(np.unique([c[k] for c in cells], return_inverse=True) for k in range(3)))
    have = np.bincount(at[0], mass)
    aim = np.minimum([want[s] for s in labels[0]], have * [cap[s] for s in labels[0]])
    goals = [aim, *(np.bincount(at[k], mass) / mass.sum() * aim.sum() for k in (1, 2))]
    weight = np.minimum(most, (aim / have)[at[0]])

    def fit(w: np.ndarray, k: int) -> np.ndarray:
        free, n = np.ones(len(w), bool), len(labels[k])
        w = w.copy()
        while True:
            fixed, loose = np.bincount(at[k], w * mass * ~free, n), np.bincount(at[k], w * mass * free, n)
            scale = np.where(loose > 0, np.maximum(0.0, goals[k] - fixed) / np.where(loose > 0, loose, 1.0), 1.0)
            new = np.where(free, w * scale[at[k]], w)
            over = free & (new > most * (1 + 1e-12))
            if not over.any():
                return new
            w[over], free[over] = most[over], False

    for rounds in range(1, max_rounds + 1):
        new = fit(fit(fit(weight, 1), 2), 0)
        moved = float(np.abs(new - weight).max())
        weight = new
        if moved <= TOLERANCE:
            break
    weight = np.clip(weight, 0.0, most)
    reached = [np.bincount(at[k], weight * mass) for k in range(3)]
    misses = {a: float(np.max(np.abs(r - g) / np.maximum(g, 1.0))) for a, r, g in zip(AXES, reached, goals)}
    return Fit(dict(zip(cells, weight.tolist())), rounds, moved, misses)


def _scales(cells: DataFrame, axis: str, made: list[str]) -> DataFrame:
    """(axis, x): the factor of each label that brings the cells, each at most at its cap, to the label's goal."""
    w, most, t, x = F.col("w"), F.col("most"), F.col("t"), F.col("x")
    ratio, over = F.try_divide(w, most), F.coalesce(F.col("x") * F.try_divide(w, most) > 1 + 1e-12, F.lit(False))
    goal = F.max(f"goal_{axis}")
    first = cells.groupBy(axis).agg(F.coalesce(F.try_divide(F.greatest(goal, F.lit(0.0)), F.sum(w * t)), F.lit(1.0)).alias("x"), F.max(ratio).alias("top"))
    found, path = stored(first, "scales")
    made.append(path)
    while not found.where(x * F.col("top") > 1 + 1e-12).isEmpty():  # each time at least one more cell is at its cap
        rest, loose = goal - F.sum(F.when(over, most * t).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(w * t))
        more = F.greatest(F.max(x), F.coalesce(F.try_divide(rest, loose), F.max(x)))
        found, path = stored(cells.join(found, axis).groupBy(axis).agg(more.alias("x"), F.max(F.when(~over, ratio)).alias("top")), "scales")
        made.append(path)
    return found.drop("top")


def rake_in_spark(cells: DataFrame, aims: DataFrame, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, Fit]:
    """The steps of ``rake`` for any number of cells: the cells with their weight ``w``, and the fit.

    ``cells``: source, lang, topic, t, cap; ``aims``: source, have, aim; both stored. A weight within ``TOLERANCE`` of a whole number is that number."""
    spark = cells.sparkSession
    total = aims.agg(F.sum("aim")).first()[0]
    mass = cells.agg(F.sum("t")).first()[0]
    goals, paths = aims.select("source", F.col("aim").alias("goal_source"), "have"), []
    state = cells.join(goals, "source").select("source", "lang", "topic", F.col("t").cast("double").alias("t"), F.col("cap").cast("double").alias("most"), "goal_source", "have")
    for c in ("lang", "topic"):
        goal, path = stored(cells.groupBy(c).agg((F.sum("t") / F.lit(float(mass)) * F.lit(float(total))).alias(f"goal_{c}")), "goals")
        paths.append(path)
        state = state.join(goal, c)
    w, most = F.col("w"), F.col("most")
    state, path = stored(state.withColumn("w", F.least(most, F.col("goal_source") / F.col("have"))).drop("have"), "raked")
    paths.append(path)
    kept = state.columns
    for rounds in range(1, max_rounds + 1):
        new = state.withColumn("was", w)
        for axis in ("lang", "topic", "source"):
            over = F.coalesce(F.col("x") * F.try_divide(w, most) > 1 + 1e-12, F.lit(False))
            new = new.join(_scales(new, axis, paths), axis).withColumn("w", F.when(over, most).otherwise(w * F.col("x"))).drop("x")
        state, path = stored(new.select(*kept, F.abs(w - F.col("was")).alias("moved")), "raked")
        discard(spark, paths)
        paths = [path]
        moved = state.agg(F.max("moved")).first()[0]
        if moved <= TOLERANCE:
            break
    near = F.round(w)
    w = F.greatest(F.lit(0.0), F.least(most, w))
    state = materialize(state.withColumn("w", F.when(F.abs(F.col("w") - near) <= TOLERANCE, near).otherwise(w)), "weights")
    discard(spark, paths)
    miss = lambda a: state.groupBy(a).agg(F.sum(F.col("w") * F.col("t")).alias("r"), F.max(f"goal_{a}").alias("g")).agg(F.max(F.abs(F.col("r") - F.col("g")) / F.greatest("g", F.lit(1.0)))).first()[0]
    return state.select(*AXES, "t", "w"), Fit(None, rounds, moved, {a: miss(a) for a in AXES})


@dataclass(frozen=True)
class Plan:
    """The raked cells (source, lang, topic, t, w), what each source aims at (source, aim), the fit, the records, and whether the sources are few."""

    cells: DataFrame
    aims: DataFrame
    fit: Fit
    rows: DataFrame
    few: bool


def plan(counted: DataFrame, targets: DataFrame, *, max_cells: int = 20_000, max_sources: int | None = MAX_SOURCES) -> Plan:
    spark = counted.sparkSession
    if max_sources is not None and targets.select("source").limit(max_sources + 1).count() > max_sources:
        raise ValueError(f"more than {max_sources} sources in a mix")
    name = lambda c: F.lower(F.trim(c)).alias("source")
    first = F.min(F.struct(F.col("source").alias("named"), "target_share", F.coalesce("max_repeats", F.lit(0)).alias("cap")))
    wanted = targets.where("source is not null and target_share is not null").groupBy(name("source")).agg(first.alias("f")).select("source", F.col("f.target_share").cast("double").alias("share"), F.col("f.cap").cast("int").alias("cap"))
    label = lambda c: F.coalesce(F.col(c), F.lit("none")).alias(c)
    cleaned = counted.where("n_tokens > 0").select("doc_id", name("source"), label("lang"), label("topic"), "n_tokens")  # other columns may have any name
    total = float(counted.agg(F.sum("n_tokens")).first()[0] or 0)
    cells = materialize(cleaned.groupBy(*AXES).agg(F.sum("n_tokens").alias("t")).join(wanted, "source"), "cells")
    few = cells.limit(max_cells + 1).collect()
    if len(few) <= max_cells:
        tokens = {(r["source"], r["lang"], r["topic"]): float(r["t"]) for r in sorted(few)}
        want, cap = {r["source"]: r["share"] * total for r in few}, {r["source"]: r["cap"] for r in few}
        fit = rake(tokens, want, cap)
        have = dict.fromkeys(want, 0.0)
        for c, t in tokens.items():
            have[c[0]] += t
        aims = spark.createDataFrame([(s, min(want[s], t * cap[s])) for s, t in have.items()], "source string, aim double")
        raked = spark.createDataFrame([(*c, tokens[c], w) for c, w in fit.weights.items()], "source string, lang string, topic string, t double, w double")
        return Plan(raked, aims, fit, cleaned, len(want) <= MAX_SOURCES)
    aims = cells.groupBy("source").agg(F.sum("t").cast("double").alias("have"), F.max("share").alias("share"), F.max("cap").alias("cap"))
    aims = materialize(aims.select("source", "have", F.least(F.col("share") * F.lit(total), F.col("have") * F.col("cap")).alias("aim")), "aims")
    raked, fit = rake_in_spark(cells, aims)
    return Plan(raked, aims.select("source", "aim"), fit, cleaned, aims.count() <= MAX_SOURCES)


def _cut(hist: DataFrame, missing: str) -> DataFrame:
    """Per source the place (bin, or draw) in which the running total passes what is missing, the total before it and the place's own.

    None where all of them together don't pass it. A source has at most BINS + 1 bins, and in a bin of a bin a handful of draws."""
    w = W.partitionBy("source").orderBy("b")
    run = hist.withColumn("upto", F.sum("t").over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("upto") > F.col(missing), F.struct("b", (F.col("upto") - F.col("t")).alias("before"), "t")))
    return run.groupBy("source").agg(first.alias("at"), F.max(missing).alias(missing)).where("at is not null").select("source", "at.b", "at.t", (F.col(missing) - F.col("at.before")).alias("rest"))


def select(counted: DataFrame, targets: DataFrame, *, seed: int = 7, max_cells: int = 20_000, max_sources: int | None = MAX_SOURCES, planned: Plan | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, copies) of the chosen records.

    ``counted``: doc_id, source, lang, topic, n_tokens; stored, as it is read several times.
    ``targets``: source, target_share, max_repeats."""
    p = planned or plan(counted, targets, max_cells=max_cells, max_sources=max_sources)
    small = F.broadcast if p.few else lambda df: df  # one row a source
    weights = p.cells.select(*AXES, "w")
    drawn = p.rows.join(F.broadcast(weights) if p.fit.weights is not None else weights, [*AXES])  # at most max_cells rows are sent
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    part = F.col("w") - F.floor("w")
    drawn = drawn.withColumn("base", F.floor("w").cast("int")).withColumn("at", F.when(part > 0, unit / part))

    hist = lambda df, b: df.groupBy("source", b.alias("b")).agg(F.sum("n_tokens").cast("long").alias("t"))
    missing = drawn.groupBy("source").agg(F.sum(F.col("base").cast("long") * F.col("n_tokens")).alias("given")).join(p.aims, "source").select("source", (F.col("aim") - F.col("given")).alias("missing"))
    # draws go on without end, bins of them do not: rising with the draw from 0 to BINS, the draw 1 in the middle
    place = F.when(F.col("at") < 1, F.col("at") / 2).otherwise(1 - 0.5 / F.greatest("at", F.lit(1.0))) * BINS
    open_ = drawn.where("at is not null").withColumn("place", place)
    coarse = _cut(hist(open_, F.floor("place")).join(small(missing), "source"), "missing").select("source", F.col("b").alias("edge"), "rest")
    inside = open_.join(small(coarse), "source").where(F.floor("place") == F.col("edge")).withColumn("finer", F.floor((F.col("place") - F.col("edge")) * BINS))
    fine = _cut(hist(inside, F.col("finer")).join(small(coarse.select("source", "rest")), "source"), "rest").select("source", F.col("b").alias("edge_"), F.col("rest").alias("rest_"))
    last = inside.join(small(fine), "source").where(F.col("finer") == F.col("edge_"))
    one = _cut(hist(last, F.col("at")).join(small(fine.select("source", "rest_")), "source"), "rest_")
    # the draw that passes the target counts if it comes closer with it; without one, all do
    limits = one.select("source", F.col("b").alias("limit"), (F.col("t") - F.col("rest") < F.col("rest")).alias("closer"))
    extra = F.when(F.col("at").isNotNull() & (F.col("limit").isNull() | (F.col("at") < F.col("limit")) | (F.col("closer") & (F.col("at") == F.col("limit")))), 1).otherwise(0)
    return drawn.join(small(limits), "source", "left").withColumn("copies", (F.col("base") + extra).cast("int")).where("copies > 0").select("doc_id", "source", "lang", "topic", "n_tokens", "copies")


def report(chosen: DataFrame, counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: tokens wanted and reached, shares, records, most copies."""
    total = counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_copies"))
    reached = got.agg(F.sum("tokens").alias("chosen_tokens"))
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    return t.join(got, "source", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(reached)).select(
        "source", "target_share", "max_repeats", F.round(F.col("target_share") * F.col("all_tokens")).cast("long").alias("target_tokens"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.try_divide(F.coalesce("tokens", F.lit(0)), "chosen_tokens"), F.lit(0.0)), 6).alias("share_of_selection"), F.round(F.coalesce(F.try_divide(F.coalesce("tokens", F.lit(0)), "all_tokens"), F.lit(0.0)), 6).alias("share_of_total"),
        F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )


def margins(chosen: DataFrame, p: Plan) -> DataFrame:
    """(axis, label, goal, fitted, reached, rounds, moved): tokens each margin aims at, has by the fit, and has in the selection."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("label")) for a in AXES])).alias("m")
    fitted = p.cells.select(each, "t", (F.col("t") * F.col("w")).alias("f")).groupBy("m.axis", "m.label").agg(F.sum("t").alias("t"), F.sum("f").alias("fitted"))
    whole, total = p.cells.agg(F.sum("t")).first()[0], p.aims.agg(F.sum("aim")).first()[0]
    aims = p.aims.select(F.lit("source").alias("axis"), F.col("source").alias("label"), "aim")
    goal = F.coalesce("aim", F.col("t") / F.lit(whole) * F.lit(total))
    got = chosen.select(each, (F.col("n_tokens") * F.col("copies")).alias("t")).groupBy("m.axis", "m.label").agg(F.sum("t").alias("reached"))
    both = fitted.join(aims, ["axis", "label"], "left").join(got, ["axis", "label"], "left")
    return both.select("axis", "label", F.round(goal, 1).alias("goal"), F.round("fitted", 1).alias("fitted"), F.coalesce("reached", F.lit(0)).alias("reached"), F.lit(p.fit.rounds).alias("rounds"), F.lit(p.fit.moved).alias("moved"))


def change_type(text: Column) -> Column:
    """A topic label that the record states itself: the kind (extension) of the first file its diff changes, ``none`` without one."""
    kind = F.lower(F.regexp_extract(text, r"(?m)^(?:diff --git|\+\+\+|---|Index:) \S*\.([A-Za-z0-9]{1,8})(?=\s|$)", 1))
    return F.when(text.isNull() | (kind == ""), "none").otherwise(kind)
