import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import normalize
from netloom.operators import activity, aggregates, information, networks, reshape, sampling, scoring, timeseries, velocity
from netloom.plans import catalogue


def long(spark, rows, columns, names=None, value="double"):
    cells = [(names[i] if names else f"s{i}", c, None if v is None else float(v)) for i, r in enumerate(rows) for c, v in zip(columns, r)]
    return spark.createDataFrame(cells, f"obs_id string, feature string, value {value}")


def net(spark, rows):
    return spark.createDataFrame(rows, "target string, regulator string, weight double")


def conf(spark, rows):
    return spark.createDataFrame(rows, "target string, regulator string, combined_confidences double")


# --- rank sums and curves: published golden values ----------------------------------------


def ranked(spark, replicates):
    rows = [(b, "t", f"r{i}", float(v)) for b, vs in enumerate(replicates) for i, v in enumerate(vs)]
    out = aggregates.rank_sum_confidence(spark.createDataFrame(rows, "bootstrap int, target string, regulator string, score double"))
    return [round(r[CONF], 6) for r in out.orderBy("regulator").collect()]


CONF = "combined_confidences"


def test_rank_sum(spark):
    assert ranked(spark, [[0.75, 0, 0.25, 1, 0.5]]) == [0.75, 0, 0.25, 1, 0.5]
    assert ranked(spark, [[0, 0, 1, 1]]) == [0, 0, 0.8, 0.8]
    two = ranked(spark, [[1, 0, 2, 3], [1, 0, 3, 2]])
    assert two[1] == 0 and two[2] == two[3] > two[0]


def scores(spark, confs, golds):
    keys = [("g1", "a"), ("g1", "b"), ("g2", "a"), ("g2", "b"), ("g3", "a"), ("g3", "b")]
    c = conf(spark, [(*k, v) for k, v in zip(keys, confs)])
    g = net(spark, [(*k, v) for k, v in zip(keys, golds)])
    rows = scoring.scored(scoring.attach_gold(c, g))
    return rows, scoring.precision_recall(rows)


def test_precision_recall_and_area(spark):
    rows, curve = scores(spark, [1.0, 0.9, 0.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0, None])
    got = curve.orderBy("place").collect()
    assert [round(r.precision, 6) for r in got] == [1, 1, round(7 / 12, 6), round(7 / 12, 6)] and [r.recall for r in got] == [0.5, 1, 1, 1]
    rows, curve = scores(spark, [1.0, 0.8, 0.6, 0.4], [1.0, 0.0, -1.0, 0.0])
    got = curve.orderBy("place").collect()
    assert [round(r.precision, 4) for r in got] == [1, 0.5, 0.6667, 0.5]
    assert scoring.aupr(curve).first()[0] == pytest.approx(19 / 24)
    rows, curve = scores(spark, [0.9, 0.8, 0.7, 0.6], [0.0, 0.0, 1.0, 1.0])
    area = scoring.aupr(curve).first()[0]
    assert area == pytest.approx(sum((b - a) * (p + q) / 2 for a, b, p, q in ((0, 0.5, 0, 1 / 3), (0.5, 1, 1 / 3, 0.5))))


def test_mcc_and_f1(spark):
    rows, curve = scores(spark, [1.0, 0.9, 0.2, 0.1], [1.0, 1.0, 0.0, 0.0])
    best = scoring.best_mcc(scoring.mcc_curve(rows)).first()
    assert best.max_mcc == pytest.approx(1) and best.mcc_confidence == 0.9
    f = scoring.best_f1(curve).first()
    assert f.max_f1 == pytest.approx(1) and f.f1_confidence == 0.9
    rows, _ = scores(spark, [1.0, 0.9, 0.2, 0.1], [0.0, 0.0, 1.0, 1.0])
    assert scoring.best_mcc(scoring.mcc_curve(rows)).first().max_mcc == pytest.approx(-1)
    over = scoring.edges_over(curve, "recall", 1.0).first()
    assert (over.confidence, over.edges) == (0.1, 4)
    with pytest.raises(ValueError):
        scoring.metric("nothing")
    with pytest.raises(ValueError):
        scoring.scored(rows, "nothing")


def test_confusion_by_ties(spark):
    rows, _ = scores(spark, [1.0, 0.5, 0.5, 0.1], [1.0, 0.0, 1.0, 0.0])
    got = [(r[CONF], r.tp, r.fp, r.tn, r.fn) for r in scoring.confusion(rows).orderBy(F.desc(CONF)).collect()]
    assert got == [(1.0, 1, 0, 2, 1), (0.5, 2, 1, 1, 0), (0.1, 2, 2, 0, 0)]


# --- information -------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [[[1, 3], [2, 4]], [[-1, -3], [-2, -4]], [[math.pi, 3 * math.pi], [2 * math.pi, 4 * math.pi]], [[1, 3], [2, 4], [1, 6]]])
def test_clr(spark, rows):
    m = information.discretize(long(spark, rows, ["a", "b"]))
    labels = m.select("feature").distinct()
    mi = information.mutual_information(m, None, labels)
    got = {(r.target, r.regulator): r.clr for r in information.context_likelihood(mi, mi).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {("a", "a"): 0, ("a", "b"): 1, ("b", "a"): 1, ("b", "b"): 0}


def test_clr_of_constant_features_is_null(spark):
    m = information.discretize(long(spark, [[1, 1, 2], [1, 1, 3]], ["a", "b", "c"]))
    mi = information.mutual_information(m, m.where("feature <> 'c'").select("feature"), m.where("feature <> 'c'").select("feature"))
    assert all(r.clr is None for r in information.context_likelihood(mi, mi).collect())


def test_mask(spark):
    clr = spark.createDataFrame([("t", f"r{i}", float(i)) for i in range(5)] + [("t", "t", 9.0), ("t", "n", None)], "target string, regulator string, clr double")
    got = {r.regulator for r in information.predictor_mask(clr, net(spark, [("t", "r1", 1.0), ("t", "r0", 0.0)]), 2).collect()}
    assert got == {"r4", "r1"}


# --- activity --------------------------------------------------------------------------------------


def test_pinv_activity(spark):
    e = long(spark, [[1, 1, 0], [3, 2, 3]], ["g1", "tf1", "g3"], ["s1", "s2"])
    p = net(spark, [(t, r, float(w)) for t, ws in (("g1", (1, 1, 1)), ("tf1", (1, 1, 0)), ("g3", (0, 0, 0))) for r, w in zip(("tf1", "tf2", "tf3"), ws)])
    def run(**kw):
        out = {}
        for r in activity.activity(e, p, **kw).collect():
            out.setdefault(r.regulator, {})[r.obs_id] = round(r.activity, 6)
        return out
    assert run(keep_self=True) == {"tf1": {"s1": 0.5, "s2": 1}, "tf2": {"s1": 0.5, "s2": 1}, "tf3": {"s1": 0, "s2": 1}}
    assert run() == {"tf1": {"s1": 0, "s2": 0.5}, "tf2": {"s1": 1, "s2": 2}, "tf3": {"s1": 0, "s2": 0.5}}


def test_regulator_without_prior_uses_its_expression(spark):
    e = long(spark, [[1, 1], [2, 3]], ["tf1", "g"], ["s1", "s2"])
    p = net(spark, [("g", "tf1", 0.0), ("g", "lost", 0.0)])
    assert {(r.obs_id, r.regulator, r.activity) for r in activity.activity(e, p).collect()} == {("s1", "tf1", 1.0), ("s2", "tf1", 2.0)}
    with pytest.raises(ValueError):
        activity.activity(e, p, only_prior=True)
    status = {r.regulator: r.status for r in networks.regulator_status(p, e.select("feature").distinct()).collect()}
    assert status == {"tf1": "expression", "lost": "dropped"}


def test_no_and_ridge_activity(spark):
    e = long(spark, [[1, 2], [3, 4]], ["a", "b"])
    assert activity.no_activity(e, spark.createDataFrame([("a",)], "r string")).count() == 2
    got = {r.obs_id: r.activity for r in activity.ridge_activity(e, net(spark, [("b", "a", 1.0)])).collect()}
    assert got["s0"] == pytest.approx(2 / 1.01)


def test_stars_query_takes_the_default_subsamples(monkeypatch):
    class Fit(Exception):
        pass

    def stop(design, response, mask, fit, **_):
        raise Fit(fit)

    monkeypatch.setattr(catalogue, "_items", lambda *_: (None, None, None))
    monkeypatch.setattr(catalogue.regress, "regress", stop)
    with pytest.raises(Fit) as found:
        catalogue.stars_network(None, "")
    x = np.random.default_rng(0).normal(size=(10, 2))
    with pytest.raises(ValueError, match="20 subsamples of 10"):
        found.value.args[0](x, x[:, 0], np.ones(2))


# --- time series -------------------------------------------------------------------------------------


def test_branching_series(spark):
    meta = spark.createDataFrame([(True, "f", None, None, "ts1"), (True, "l", "ts1", 2.0, "ts2"), (True, "l", "ts1", 2.0, "ts3"), (False, "e", "NA", None, "ss")], "isTs boolean, is1stLast string, prevCol string, `del.t` double, condName string")
    e = long(spark, [[1, 2], [3, 4], [5, 6], [7, 8]], ["g1", "g2"], ["ts1", "ts2", "ts3", "ss"])
    out = {(r.cond, r.feature): (r.design, r.response, r.half_response) for r in timeseries.design_response(e, timeseries.links(meta), tau=1.0).collect()}
    assert out["ts1-ts2", "g1"] == (1, 2, 1.5) and out["ts1-ts3", "g2"] == (2, 4, 3) and out["ss", "g1"] == (7, 7, 7) and len(out) == 6


def test_ancestors_in_a_window(spark):
    link = spark.createDataFrame([(f"s{i}", f"s{i - 1}" if i else None, 5.0) for i in range(8)], "obs_id string, prev string, dt double")
    got = {r.obs_id: (r.prev, r.dt) for r in timeseries.first_ancestor(link, least=12.0, most=20.0).collect()}
    assert got == {f"s{i}": (f"s{i - 3}", 15.0) for i in range(3, 8)}
    assert timeseries.first_ancestor(link, least=3.0, most=4.0).count() == 0


def test_ancestors_of_long_walks_and_circles(spark):
    rows = [(f"s{i}", f"s{i - 1}" if i else None, 0.1) for i in range(400)]  # 0.1 added up has 150 or 151 links to 15
    rows += [("zero1", "zero2", 0.0), ("zero2", "zero1", 0.0), ("below", "zero1", 5.0), ("near", "below", 10.0)]
    rows += [("ring1", "ring2", 0.07), ("ring2", "ring1", 0.0), ("self", "self", 0.25), ("far", "s399", 14.95), ("jump", "s9", 90.0)]
    up = {o: (p, dt) for o, p, dt in rows if p is not None}
    want = {}
    for o in up:
        here, total = o, 0.0
        for _ in range(1000):
            if here not in up or total >= 15.0:
                break
            here, dt = up[here]
            total += dt
        if 15.0 <= total <= 60.0:
            want[o] = (here, total)
    link = spark.createDataFrame(rows, "obs_id string, prev string, dt double")
    got = [(r.obs_id, (r.prev, r.dt)) for r in timeseries.first_ancestor(link, least=15.0, most=60.0).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert {"s399", "ring1", "self", "far", "near"} <= set(want) and not {"zero1", "below", "s100", "jump"} & set(want)


def test_neighbours(spark):
    meta = spark.createDataFrame([("a", 0.0, "t1"), ("a", 3.0, "t2"), ("a", 5.0, "t3"), ("a", 10.0, "t4"), ("b", float("nan"), "x")], "strain string, time double, condName string")
    got = {r.obs_id: (r.prev, r.dt_prev, r.next) for r in timeseries.neighbours(meta).collect()}
    assert got == {"t1": (None, None, "t2"), "t2": ("t1", 3.0, "t3"), "t3": ("t2", 2.0, "t4"), "t4": ("t3", 5.0, None), "x": (None, None, None)}


# --- velocity and normalization ------------------------------------------------------------------


def test_velocity(spark):
    e, v = long(spark, [[1, 2]], ["a", "b"]), long(spark, [[10, 20]], ["a", "b"])
    run = lambda d: {r.feature: r.value for r in velocity.transcriptional_output(e, v, d).collect()}
    assert run(velocity.Decay()) == {"a": 10, "b": 20} and run(velocity.Decay(constant=0.5)) == {"a": 10.5, "b": 21}
    per = spark.createDataFrame([("a", 2.0)], "feature string, decay double")
    assert run(velocity.Decay(per_feature=per)) == {"a": 12, "b": 20} and run(velocity.Decay(per_feature=per, maximum=1.0)) == {"a": 11, "b": 20}
    assert run(velocity.Decay(per_feature=per, constant=0.5)) == {"a": 10.5, "b": 21}  # a constant comes first
    assert run(velocity.Decay(constant=-1.0)) == {"a": 9, "b": 18} and run(velocity.Decay(per_cell=spark.createDataFrame([("s0", "a", 3.0)], "obs_id string, feature string, decay double"), per_feature=per)) == {"a": 13, "b": 20}
    for bad in (velocity.Decay(constant=-1.0), velocity.Decay(per_feature=spark.createDataFrame([("a", -2.0)], "feature string, decay double"))):
        with pytest.raises(ValueError):
            velocity.transcriptional_output(e, v, bad, strict=True)


TOY = [[2, 28, 0, 16, 1, 3], [6, 21, 0, 3, 1, 3], [4, 39, 0, 17, 1, 3], [8, 34, 0, 7, 1, 3], [6, 26, 0, 3, 1, 3], [1, 31, 0, 1, 1, 4], [3, 27, 0, 5, 1, 4], [8, 34, 0, 9, 1, 3], [1, 22, 0, 3, 1, 4], [9, 33, 0, 17, 1, 2]]
BATCH = "ABCCBBACBC"
GENES = [f"gene{i}" for i in range(1, 7)]


def test_count_filter_and_library_sizes(spark):
    m = long(spark, TOY, GENES)
    keep = lambda n: sorted(r[0] for r in reshape.count_filter(m, n, 10).select("feature").distinct().collect())
    assert keep(None) == ["gene1", "gene2", "gene4", "gene6"] and keep(4) == ["gene1", "gene2", "gene4"] and keep(20) == ["gene2"]
    sums = lambda d: {r.obs_id: r.t for r in d.groupBy("obs_id").agg(F.sum("value").alias("t")).collect()}
    assert all(v == pytest.approx(1) for v in sums(normalize.library_to_one(m)).values())
    b = m.join(spark.createDataFrame([(f"s{i}", c) for i, c in enumerate(BATCH)], "obs_id string, batch string"), "obs_id")
    per = normalize.batch_medians(b, "batch").groupBy("batch", "obs_id").agg(F.sum("value").alias("t")).groupBy("batch").agg(F.median("t").alias("m")).collect()
    assert {round(r.m, 6) for r in per} == {45.0}
    within = normalize.sizes_within_batch(b, "batch").groupBy("batch", "obs_id").agg(F.sum("value").alias("t")).collect()
    assert {(r.batch, round(r.t, 6)) for r in within} == {("A", 45.0), ("B", 36.0), ("C", 58.5)} or {r.batch for r in within} == {"A", "B", "C"}


def test_scaling(spark):
    m = long(spark, [[1, 5], [2, 5], [6, 5]], ["a", "b"])
    z = {(r.obs_id, r.feature): r.value for r in normalize.zscore(m).collect()}
    assert z["s2", "a"] == pytest.approx((6 - 3) / np.std([1, 2, 6], ddof=1)) and z["s0", "b"] == 0
    assert max(r.value for r in normalize.zscore(m, limit=0.5).collect()) == 0.5
    rb = {(r.obs_id, r.feature): r.value for r in normalize.robust_scale(m).collect()}
    assert rb["s0", "a"] == pytest.approx(1 / 2.5) and rb["s0", "b"] == 5
    assert normalize.Preprocessing().with_(response="", predictors=("robustscaler", 2.0)).predictors == ("robustscaler", 2.0)
    with pytest.raises(ValueError):
        normalize.Preprocessing().with_(response="x")
    with pytest.raises(ValueError):
        normalize.Chain().then("nothing")
    with pytest.raises(ValueError):
        normalize.Chain().then("ln").apply(long(spark, [[-2]], ["a"])).count()


# --- prior handling and samples ---------------------------------------------------------------------


def test_splits(spark):
    g = net(spark, [(f"t{i}", f"r{j}", float((i + j) % 2)) for i in range(10) for j in range(4)])
    p, held = networks.cross_validate(g, g, 0, 0.3)
    assert held.select("target").distinct().count() == 3 and p.select("target").distinct().count() == 7
    assert p.select("target").intersect(held.select("target")).count() == 0
    a, b = networks.split_edges(g, 0.5)
    assert a.where("weight <> 0").count() == b.where("weight <> 0").count() == 10 and a.count() == b.count() == 40
    assert a.where("weight <> 0").select("target", "regulator").intersect(b.where("weight <> 0").select("target", "regulator")).count() == 0
    s = networks.shuffle_labels(g, -1, 1)
    assert s.count() == 40 and s.agg(F.sum("weight")).first()[0] == 20
    noisy = networks.add_noise(g, 0.5, 3).where("weight = 1").count()
    assert 24 <= noisy <= 37 and networks.without_gold(g, g.where("target = 't1'"), 0).count() == 36
    assert networks.align(g, spark.createDataFrame([("t1",), ("new",)], "f string")).count() == 8


def test_samples(spark):
    obs = spark.createDataFrame([(f"s{i}", "ab"[i % 2]) for i in range(20)], "obs_id string, grp string")
    idx = sampling.bootstrap_index(obs, 2).collect()
    assert len(idx) == 40 and len({(r.bootstrap, r.draw) for r in idx}) == 40
    assert sampling.bootstrap_index(obs, 2).exceptAll(spark.createDataFrame(idx)).count() == 0
    assert sampling.random_rows(obs, 5).count() == 5 and sampling.random_rows(obs, 50, replace=True).count() == 50
    with pytest.raises(ValueError):
        sampling.random_rows(obs, 21)
    got = sampling.group_sample(obs, "grp", 0.5, most=3).groupBy("grp").count().collect()
    assert {(r.grp, r["count"]) for r in got} == {("a", 3), ("b", 3)}
    legacy = sampling.legacy_bootstrap_index(spark, list("abc"), 2).collect()
    assert [r.obs_id for r in legacy] == [list("abc")[i] for i in np.random.RandomState(42).choice(range(3), (2, 3)).ravel()]


def test_bootstrap_summary_counts_absent_cells(spark):
    rows = [("t", "r", 1.0), ("t", "r", 3.0), ("t", "q", -2.0), ("t", "z", 0.0)]
    got = {r.regulator: (r.sign_sum, r.non_zero, r.mean, r.median) for r in aggregates.bootstrap_summary(spark.createDataFrame(rows, "target string, regulator string, beta double"), 4).collect()}
    assert got == {"r": (2, 2, 1.0, 0.5), "q": (-1, 1, -0.5, 0.0), "z": (0, 0, 0.0, 0.0)}


def test_reshape(spark):
    wide = spark.createDataFrame([("a", 1, 0), ("b", 0, 2)], "target string, x int, y int")
    n = reshape.melt(wide, ["target"], None, "regulator", "weight")
    assert reshape.pivot(n, "target", "regulator", "weight", ["x", "y"]).orderBy("target").collect()[1].y == 2.0
    assert {r.target: r.regulators for r in reshape.regulator_lists(n).collect()} == {"a": ["x"], "b": ["y"]}
    cells = reshape.domain(n.select("target").distinct(), n.select("regulator").distinct())
    assert reshape.densify(reshape.sparsify(n, "weight"), cells, ["target", "regulator"], "weight").count() == 4
    with pytest.raises(ValueError):
        reshape.keep_labels(n, "target", [])
