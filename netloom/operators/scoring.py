"""Scores of a ranked network against a gold standard.

``confidences`` (target, regulator, combined_confidences) meet ``gold`` (target, regulator, weight;
null is not scored) in a full outer join. Curves are running totals along descending confidence; ties are broken by regulator,
then target, the order of the columns of a network. Curves by confidence (confusion, MCC) are computed over distinct confidences, so
they have as many rows as there are different values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.ordering import running_totals
from netloom.session import materialize

CONF = "combined_confidences"


def attach_gold(confidences: DataFrame, gold: DataFrame) -> DataFrame:
    """Full outer join; ``gold_standard`` is 1 for a non-zero weight, 0 for zero, null if not scored."""
    marks = gold.select("target", "regulator", F.when(F.col("weight").isNotNull(), (F.col("weight") != 0).cast("int")).alias("gold_standard"))
    return confidences.join(marks, ["target", "regulator"], "full_outer")


def scored(attached: DataFrame, method: str = "keep_all_gold_standard") -> DataFrame:
    """Rows with a gold standard; ``overlap``: also with a confidence."""
    if method not in ("keep_all_gold_standard", "overlap"):
        raise ValueError(f"unknown filter {method!r}")
    rows = attached.where(F.col("gold_standard").isNotNull())
    return rows.where(F.col(CONF).isNotNull()) if method == "overlap" else rows


def confusion(rows: DataFrame) -> DataFrame:
    """Per distinct confidence (null last): tp, fp, tn, fn if all edges from it on up are called."""
    per = rows.groupBy(CONF).agg(F.sum("gold_standard").alias("_p"), F.sum(1 - F.col("gold_standard")).alias("_n"))
    run = running_totals(per, scope=[], order=[F.desc_nulls_last(CONF)], sums={"tp": "_p", "fp": "_n"})
    total = per.agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("_all_p"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_all_n"))  # one row
    return run.crossJoin(F.broadcast(total)).select(CONF, "tp", "fp", (F.col("_all_n") - F.col("fp")).alias("tn"), (F.col("_all_p") - F.col("tp")).alias("fn"))


def mcc_curve(rows: DataFrame) -> DataFrame:
    """(confidence, mcc): Matthews correlation; a zero denominator counts as 1."""
    return _mcc(confusion(rows))


def _mcc(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    bottom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(CONF, ((tp * tn - fp * fn) / F.when(bottom == 0, 1.0).otherwise(bottom)).alias("mcc"))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with place, _tp, precision, recall and the whole counts _all (edges) and _rows: one range sort, stored once."""
    order = [F.desc_nulls_last(CONF), F.col("regulator"), F.col("target")]
    run = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), scope=[], order=order, sums={"place": "_one", "_tp": "gold_standard"}, totals={"_all": "_tp", "_rows": "place"})
    return materialize(run.drop("_one").withColumn("precision", F.col("_tp") / F.col("place")).withColumn("recall", F.try_divide("_tp", "_all")), "curve")


def _levelled(curve: DataFrame) -> DataFrame:
    """Rows of confidence 0 share their mean precision; ``_before``: the precision of the row before (of the first: its own).

    The row before holds one true edge less where this one holds one, at the place before, so no neighbour is looked up."""
    zero = F.col(CONF) == 0
    flat = curve.agg(F.avg(F.when(zero, F.col("precision"))).alias("_flat"), F.min(F.when(zero, F.col("place"))).alias("_z0"), F.max(F.when(zero, F.col("place"))).alias("_z1"))  # one row
    both = curve.crossJoin(F.broadcast(flat))
    at = F.col("place") - 1
    before = F.when(at == 0, F.col("precision")).when((at >= F.col("_z0")) & (at <= F.col("_z1")), F.col("_flat")).otherwise((F.col("_tp") - F.col("gold_standard")) / F.when(at > 0, at).otherwise(1))
    both = both.withColumn("precision", F.when(zero, F.col("_flat")).otherwise(F.col("precision")))
    return both.withColumn("_before", F.when(at == 0, F.col("precision")).otherwise(before)).drop("_flat", "_z0", "_z1")


def precision_recall(rows: DataFrame, ties: str | None = None) -> DataFrame:
    """``rows`` with place, precision and recall; rows of confidence 0 share their mean precision.

    ``ties`` (min, max, avg): both values are aggregated per confidence instead."""
    curve = _placed(rows)
    if ties:
        per = curve.groupBy(CONF).agg(getattr(F, ties)("precision").alias("precision"), getattr(F, ties)("recall").alias("recall"))
        curve = curve.drop("precision", "recall").join(per.withColumnRenamed(CONF, "_c"), F.col(CONF).eqNullSafe(F.col("_c"))).drop("_c")
        return curve.drop("_tp", "_all", "_rows")
    return _levelled(curve).drop("_tp", "_all", "_rows", "_before")


def aupr(curve: DataFrame) -> DataFrame:
    """One row: area under the curve, the first precision held back to recall 0.

    Steps lie between neighbours; only rows where recall grows add area, and each needs
    the row before it. Neighbours meet by place, so no task sees the whole curve."""
    now = curve.select("place", F.col("precision").alias("p"), F.col("recall").alias("r"))
    last = curve.select((F.col("place") + 1).alias("place"), F.col("precision").alias("p0"), F.col("recall").alias("r0"))
    both = now.join(last, "place", "left")
    p0, r0 = F.coalesce("p0", "p"), F.coalesce("r0", F.lit(0.0))
    return both.agg(F.sum((F.col("r") - r0) * (p0 + (F.col("p") - p0) / 2)).alias("aupr"))


def f1_curve(curve: DataFrame) -> DataFrame:
    both = F.col("precision") + F.col("recall")
    return curve.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def best_f1(curve: DataFrame) -> DataFrame:
    """One row: greatest F1 and the least confidence that has it."""
    top = f1_curve(curve).agg(F.max(F.struct("f1", (-F.col(CONF)).alias("c"))).alias("m"))
    return top.select(F.col("m.f1").alias("max_f1"), (-F.col("m.c")).alias("f1_confidence"))


def best_mcc(mcc: DataFrame, confidences: DataFrame | None = None) -> DataFrame:
    """One row: the value farthest from zero, and the least confidence with the greatest value.

    ``confidences``: also ``mcc_edges``, the edges of the whole network from that confidence up."""
    top = mcc.agg(F.max_by("mcc", F.abs("mcc")).alias("max_mcc"), F.max(F.struct("mcc", (-F.col(CONF)).alias("c"))).alias("m"))
    best = top.select("max_mcc", (-F.col("m.c")).alias("mcc_confidence"))
    if confidences is None:
        return best
    return confidences.select(CONF).crossJoin(F.broadcast(best)).agg(F.first("max_mcc").alias("max_mcc"), F.first("mcc_confidence").alias("mcc_confidence"), F.count_if(F.col(CONF) >= F.col("mcc_confidence")).alias("mcc_edges"))


def edges_over(curve: DataFrame, column: str, threshold: float) -> DataFrame:
    """One row: the least confidence whose ``column`` reaches the threshold and the edges from it up."""
    at = curve.where(F.col(column) >= threshold).agg(F.min(CONF).alias("confidence"))  # one row
    return curve.crossJoin(F.broadcast(at)).agg(F.first("confidence").alias("confidence"), F.count_if(F.col(CONF) >= F.col("confidence")).alias("edges"))


@dataclass(frozen=True)
class Metric:
    """A named way to score; ``score`` gives one row whose first column is the score."""

    name: str
    scorer: object

    def score(self, confidences: DataFrame, gold: DataFrame, method: str = "keep_all_gold_standard") -> DataFrame:
        return self.scorer(scored(attach_gold(confidences, gold), method))


def _area(curve: DataFrame) -> DataFrame:
    """The area of a levelled curve: recall grows by one edge at rows that hold one, and nowhere else."""
    step = (F.col("precision") + F.col("_before")) / 2 / F.col("_all")
    return curve.agg(F.sum(F.when(F.col("_all") > 0, F.when(F.col("gold_standard") == 1, step).otherwise(0.0))).alias("aupr"))


def _combined(rows: DataFrame) -> DataFrame:
    """All three measures off one stored curve: area and F1 row by row, MCC from the last row of each confidence."""
    placed = _placed(rows)
    curve = _levelled(placed)
    per = placed.groupBy(CONF).agg(F.max("_tp").alias("tp"), F.max("place").alias("_place"), F.first("_all").alias("_all"), F.first("_rows").alias("_rows"))
    counts = per.select(CONF, "tp", (F.col("_place") - F.col("tp")).alias("fp"), (F.col("_rows") - F.col("_all") - F.col("_place") + F.col("tp")).alias("tn"), (F.col("_all") - F.col("tp")).alias("fn"))
    return _area(curve).crossJoin(F.broadcast(best_f1(curve))).crossJoin(F.broadcast(best_mcc(_mcc(counts))))


METRICS = {
    "combined": Metric("combined", _combined), "aupr": Metric("aupr", lambda r: _area(_levelled(_placed(r)))), "precision-recall": Metric("aupr", lambda r: _area(_levelled(_placed(r)))),
    "f1": Metric("f1", lambda r: best_f1(precision_recall(r, ties="avg"))), "mcc": Metric("mcc", lambda r: best_mcc(mcc_curve(r))),
}


def metric(name: str | Metric) -> Metric:
    if isinstance(name, Metric):
        return name
    if str(name).lower() not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[str(name).lower()]


def network_table(confidences: DataFrame, prior: DataFrame, coefficients: DataFrame, shares: DataFrame, extra: dict[str, DataFrame] | None = None, threshold: float = 0.0) -> DataFrame:
    """Edges above the threshold with prior, full-fit coefficient, explained share and extra columns by name."""
    keys = ["target", "regulator"]
    out = confidences.where(F.col(CONF) > threshold)
    for name, df, column in (("prior", prior, "weight"), ("model_coefficient", coefficients, "beta"), ("model_exp_var", shares, "share")):
        out = out.join(df.select(*keys, F.col(column).alias(name)), keys, "left")
    for name in sorted(extra or {}):
        out = out.join(extra[name].select(*keys, F.col("value").alias(name)), keys, "left")
    return out


def back_join(confidences: DataFrame, curve: DataFrame, columns: list[str]) -> DataFrame:
    """Curve values put back on all confidences."""
    keys = ["target", "regulator"]
    return confidences.join(curve.select(*keys, *columns), keys, "left")


def histogram(confidences: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, edges) over confidences above 0."""
    at = F.least(F.floor(F.col(CONF) * bins), F.lit(bins - 1)).cast("int")
    return confidences.where(F.col(CONF) > 0).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("edges"))
