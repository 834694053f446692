import gzip
import random
import shutil
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions.normalize import Chain, Preprocessing
from netloom.operators import predict
from netloom.plans.workflow import Data, Spec, assemble_tasks, cross_validate, grid_search, infer, prepare_networks, regulator_activity, sample_runs, with_homology
from netloom.sources import readers, writers
from tests.test_network import BATCH, GENES, TOY, long, net


@pytest.fixture(scope="module")
def toy(spark):
    e = long(spark, TOY, GENES).where("feature in ('gene1', 'gene2', 'gene3', 'gene4', 'gene6')").persist()
    g = net(spark, [(t, r, float((t, r) in {("gene1", "gene6"), ("gene2", "gene6"), ("gene4", "gene3")})) for t in ("gene1", "gene2", "gene4", "gene5") for r in ("gene3", "gene6")])
    return Data(e, g, g, spark.createDataFrame([("gene3",), ("gene6",)], "r string"))


@pytest.mark.parametrize("spec", [Spec(), Spec(clr_only=True), Spec(regression="elasticnet")], ids=["bbsr", "clr", "net"])
def test_single_task(toy, spec):
    r = infer(toy, spec)
    assert r.score.first()[0] == pytest.approx(1) and r.confidences.count() == 8  # the published score of this toy
    assert set(r.network.columns) >= {"target", "regulator", "combined_confidences", "prior", "model_coefficient", "model_exp_var", "beta.sign.sum", "var.exp.median"}


def test_single_cell_and_stability_selection(toy):
    r = infer(toy, Spec(regression="stars", workflow="single-cell", preprocess=Chain().then("log2"), options={"folds": 2}))
    assert 0 <= r.score.first()[0] <= 1 and r.spec.bootstraps == 1


@pytest.fixture(scope="module")
def tasks(spark, toy):
    by = spark.createDataFrame([(f"s{i}", c) for i, c in enumerate(BATCH)], "obs_id string, task string")
    return Data(toy.expression.join(by, "obs_id"), toy.prior, toy.gold, toy.regulators)


@pytest.fixture(scope="module")
def noisy(spark, toy):
    """The toy with the published noise (a seeded public generator), for penalized models."""
    rng = np.random.default_rng(200)
    m = np.array(TOY, float)
    m = m + np.abs(np.hstack([rng.standard_normal((len(m), 1)) * m[:, i].std() for i in range(m.shape[1])]))
    return replace(toy, expression=long(spark, m.tolist(), GENES).persist())


def twice(spark, data):
    """Two tasks of the same samples."""
    return replace(data, expression=data.expression.crossJoin(spark.createDataFrame([("A",), ("B",)], "task string")))


STARS = {"folds": 2}
RIDGE = {"folds": 2, "method": "ridge", "ridge_threshold": 1e-3}
LASSO = 0.657777  # the published score


@pytest.mark.parametrize("options, score", [(STARS, LASSO), (RIDGE, 1)], ids=["lasso", "ridge"])
def test_stability_selection_scores(noisy, options, score):
    assert infer(noisy, Spec(regression="stars", options=options)).score.first()[0] == pytest.approx(score, abs=1e-4)


@pytest.mark.parametrize("name, options, score", [("elasticnet-by-task", {}, 1), ("stars-by-task", STARS, LASSO), ("stars-by-task", RIDGE, 1), ("amusr", {}, 1)], ids=["net", "lasso", "ridge", "amusr"])
def test_multitask(spark, noisy, name, options, score):
    r = infer(twice(spark, noisy), Spec(regression=name, workflow="multitask", options=options))
    assert r.score.first()[0] == pytest.approx(score, abs=1e-4)  # published
    assert sorted(r.tasks) == ["A", "B"] and all(0 <= t.score.first()[0] <= 1 for t in r.tasks.values())


def test_multitask_best_subset(spark, toy):
    """The published score is that of one generator's two bootstraps of the noisy toy; on the toy itself it holds for any draws."""
    assert infer(twice(spark, toy), Spec(regression="bbsr-by-task", workflow="multitask")).score.first()[0] == pytest.approx(1)


def _stack(spark, tasks):
    """Two equal replicates a task of published coefficients (genes 1, 2, 4, 6 by gene3, gene6)."""
    rows = []
    for t, (beta, share) in enumerate(tasks):
        for g, bs, ss in zip(("gene1", "gene2", "gene4", "gene6"), beta, share):
            rows += [(f"t{t}", b, g, r, float(x), float(y)) for b in (0, 1) for r, x, y in zip(("gene3", "gene6"), bs, ss) if x or y]
    labels = lambda names, c: spark.createDataFrame([(f"t{t}", n) for t in range(len(tasks)) for n in names], f"task string, {c} string")
    return spark.createDataFrame(rows, "task string, bootstrap int, target string, regulator string, beta double, share double"), labels(("gene1", "gene2", "gene4", "gene6"), "target"), labels(("gene3", "gene6"), "regulator")


RANDOM = [([[1, 0], [0.5, 0], [0, 1], [0.5, 0]], [[0.75, 0], [0.25, 0], [0.75, 0], [0.25, 0]]), ([[0, 0], [0.5, 0], [1, 0], [0.5, 0]], [[0, 0], [1, 0], [0, 0], [1, 0]]), ([[0.5, 0.2], [0.5, 0.1], [0.5, 0.2], [0.5, 0.2]], [[0.5, 0.5]] * 4)]
PERFECT = [([[0, 1], [0, 1], [1, 0], [0.5, 0]], [[0, 1], [0, 1], [1, 0], [0.25, 0]]), ([[0, 1], [0, 1], [1, 0], [0.5, 0]], [[0, 1], [0, 1], [1, 0], [1, 0]]), ([[0, 1], [0, 1], [1, 0], [0.5, 0.2]], [[0, 1], [0, 1], [1, 0], [0.5, 0.5]])]


@pytest.mark.parametrize("given, filter_, score", [(RANDOM, "overlap", 0.37777), (PERFECT, "keep_all_gold_standard", 1)])
def test_multitask_results(spark, toy, given, filter_, score):
    stack, targets, regulators = _stack(spark, given)
    r = assemble_tasks(stack, targets, regulators, toy.prior, toy.gold, Spec(gold_filter=filter_))
    assert r.rescore("aupr").first()[0] == pytest.approx(score, abs=1e-4)  # published
    one = r.tasks["t1"].network.where("target = 'gene4' and regulator = 'gene3'").collect()
    if given is PERFECT:
        assert one[0]["beta.sign.sum"] == 2 and one[0]["var.exp.median"] == 1
        assert r.network.where("target = 'gene4' and regulator = 'gene3'").first()["beta.sign.sum"] == 3


def test_tasks_with_their_own_priors_lose_held_out_labels(spark, tasks):
    own = tasks.prior.crossJoin(spark.createDataFrame([("A",), ("B",), ("C",)], "task string"))
    prior, gold = prepare_networks(replace(tasks, prior=own), Spec(workflow="multitask", cv_ratio=0.5))
    held = {r.target for r in gold.collect()}
    assert held and not held & {r.target for r in prior.where("weight != 0").collect()} and prior.select("task").distinct().count() == 3
    r = infer(replace(tasks, prior=own), Spec(regression="sklearn-by-task", workflow="multitask", bootstraps=1))
    assert set(r.tasks) == {"A", "B", "C"}


def test_regression_of_ones_own(toy):
    from netloom.operators.regress import LeastSquares

    by_class = infer(toy, Spec(regression=LeastSquares, bootstraps=1))
    by_name = infer(toy, Spec(regression="sklearn", bootstraps=1))
    assert sorted(map(tuple, by_class.edges.collect())) == sorted(map(tuple, by_name.edges.collect())) and by_class.spec.kind == "custom"


def test_sparse_confidences_equal_dense_ones(spark):
    from netloom.operators import aggregates

    rnd = random.Random(8)
    cells = [(b, f"t{i}", f"r{j}", rnd.choice([0.0, 0.0, 0.5, rnd.random(), -0.2])) for b in range(3) for i in range(6) for j in range(5)]
    df = spark.createDataFrame(cells, "bootstrap int, target string, regulator string, score double")
    dense = {(r[0], r[1]): r[2] for r in aggregates.rank_sum_confidence(df).collect()}
    kept, rest = aggregates.sparse_rank_sum(df.where("score != 0"), spark.createDataFrame([(30,)], "cells int"), 3)
    got = {(r[0], r[1]): r[2] for r in kept.collect()}
    assert got and all(dense[k] == pytest.approx(v) for k, v in got.items())
    assert all(dense[k] == pytest.approx(rest.first()["rest"]) for k in dense.keys() - got.keys())


def test_homology_brings_tasks_onto_common_labels(spark):
    m = spark.createDataFrame([("A", "s1", "a1", 1.0), ("A", "s1", "a2", 3.0), ("B", "s2", "b1", 5.0), ("B", "s2", "b9", 7.0)], "task string, obs_id string, feature string, value double")
    maps = spark.createDataFrame([("a1", "g1"), ("a2", "g1"), ("b1", "g2")], "label string, group string")
    d = with_homology(Data(m, spark.createDataFrame([("a1", "b1", 1.0), ("a2", "b1", 0.0)], "target string, regulator string, weight double")), maps)
    assert {tuple(r) for r in d.expression.collect()} == {("A", "s1", "g1", 2.0), ("A", "s1", "g2", 0.0), ("B", "s2", "g2", 5.0), ("B", "s2", "g1", 0.0)}
    assert [tuple(r) for r in d.prior.collect()] == [("g1", "g2", 1.0)]


def test_sheets_without_parents(spark):
    from netloom.operators import timeseries

    sheet = spark.createDataFrame([("a", 0.0, "x0"), ("a", 3.0, "x3"), ("a", 5.0, "x5"), ("b", None, "y")], "strain string, time double, condName string")
    read = timeseries.handler(sheet)
    assert {(r.obs_id, r.prev, r.dt) for r in read(sheet).collect()} == {("x0", None, None), ("x3", "x0", 3.0), ("x5", "x3", 2.0), ("y", None, None)}
    scoped = read(sheet.withColumn("task", F.lit("t")), ["task"]).collect()
    assert {(r.task, r.obs_id, r.prev) for r in scoped} == {("t", "x0", None), ("t", "x3", "x0"), ("t", "x5", "x3"), ("t", "y", None)}
    assert timeseries.handler(sheet, "branching") is None
    m = spark.createDataFrame([("x0", "g", 1.0), ("x3", "g", 4.0), ("z", "g", 2.0)], "obs_id string, feature string, value double")
    dr = {r.cond: r.response for r in timeseries.design_response(m, read(sheet), tau=1.0).collect()}
    assert dr == {"x0-x3": 2.0, "z": 2.0}
    timeseries.check_overlap(m, sheet)
    for bad in (lambda: timeseries.check_overlap(m, sheet, strict=True), lambda: timeseries.check_overlap(m.where("obs_id = 'z'"), sheet), lambda: timeseries.handler(sheet, "x"), lambda: timeseries.design_response(m.where("obs_id <> 'x0'"), read(sheet), strict=True)):
        with pytest.raises(ValueError):
            bad()


def test_no_measured_cell_is_lost(spark):
    from netloom.operators import timeseries

    m = spark.createDataFrame([("a", "g", 1.0), ("a", "h", 2.0), ("b", "g", 3.0), ("b", "k", 9.0), ("d", "g", 5.0)], "obs_id string, feature string, value double")
    link = spark.createDataFrame([("b", "a", 2.0), ("c", "b", 2.0), ("d", "c", 2.0)], "obs_id string, prev string, dt double")
    got = {(r.cond, r.feature): (r.design, r.response) for r in timeseries.design_response(m, link, tau=1.0).collect()}
    assert got == {("a-b", "g"): (1.0, 2.0), ("a", "h"): (2.0, 2.0), ("b", "k"): (9.0, 9.0), ("d", "g"): (5.0, 5.0)}


def test_settings_are_checked(toy):
    for bad in ({"regression": "x"}, {"workflow": "x"}, {"cv_ratio": 2.0}, {"bootstraps": 0}, {"metric": "x"}):
        with pytest.raises(ValueError):
            Spec(**bad)
    with pytest.raises(ValueError):
        Spec().with_(nothing=1)
    with pytest.raises(ValueError):
        infer(Data(toy.expression, toy.prior))


def test_grid_and_samples(spark, toy, tmp_path):
    quick = Spec(regression="sklearn", bootstraps=1)
    runs = grid_search(toy, quick, {"seed": [1, 2]})
    assert [p for p, _ in runs] == [{"seed": 1}, {"seed": 2}]
    sheet = spark.createDataFrame([(f"s{i}", "A" if c == "A" else "B", False, None, None, None) for i, c in enumerate(BATCH)], "condName string, batch string, isTs boolean, is1stLast string, prevCol string, `del.t` double")
    out = sample_runs(Data(toy.expression, toy.prior, toy.gold, toy.regulators, sheet=sheet), quick, dropin="batch")
    assert [(t, v) for t, v, _ in out] == [("dropin", "A"), ("dropin", "B")]
    table = cross_validate(Data(toy.expression, toy.prior, toy.gold, toy.regulators, sheet=sheet), quick, {"seed": [1, 2]}, folder=str(tmp_path / "cv"), sizes=[0.9], size_group="batch")
    rows = table.collect()
    assert table.columns[:4] == ["seed", "Test", "Value", "Num_Obs"] and [(x.seed, x.Test, x.Num_Obs) for x in rows][:2] == [("1", None, 10), ("2", None, 10)] and len(rows) == 4 and rows[2].Test == "size"
    assert spark.read.parquet(str(tmp_path / "cv" / "performance")).count() == 4 and (tmp_path / "cv" / "seed_1" / "network.tsv").exists()
    shutil.rmtree(tmp_path / "cv")
    r = runs[1][1]
    r.write(str(tmp_path), {"curve": None})
    r.save(str(tmp_path / "model"))
    e = predict.Estimator.load(spark, str(tmp_path / "model"))
    assert e.scaling == r.spec.scaling and e.transform_predict(toy.expression).count() > 0
    with pytest.raises(NotImplementedError):
        e.fit(toy.expression)
    back, settings = writers.load_model(spark, str(tmp_path / "model"), ["coefficients"])
    assert back["coefficients"].count() == r.coefficients.count() and settings["regression"] == "sklearn"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["combined_confidences.tsv.gz", "model", "model_coefficients.tsv.gz", "network.tsv"]


def test_predict(spark):
    c = spark.createDataFrame([("t", "r", 2.0), ("t", "q", 1.0)], "target string, regulator string, beta double")
    a = spark.createDataFrame([("s", "r", 3.0), ("s", "q", 1.0)], "obs_id string, regulator string, activity double")
    assert predict.predict_static(a, c).first().value == 7.0
    series = spark.createDataFrame([("x", t, "r", 1.0) for t in range(3)], "series string, time int, regulator string, activity double")
    got = [r.value for r in predict.predict_dynamic(series, c, series="series", time="time").orderBy("time").collect()]
    assert got == pytest.approx([0, 2.2, 4.2])
    begin = spark.createDataFrame([("x", "t", 10.0), ("y", "t", 1.0)], "series string, target string, value double")
    rates = spark.createDataFrame([("t", 0.1), ("other", 5.0)], "target string, decay double")
    got = [r.value for r in predict.predict_dynamic(series, c, series="series", time="time", start=begin, decay=rates).orderBy("time").collect()]
    x, want = 10.0, [10.0]
    for k in range(30):
        x += (2.0 - 0.1 * x) * 0.1
        want += [x] if k in (10, 20) else []
    assert got == pytest.approx(want)
    assert predict.trim_model(c, regulators=["r"]).count() == 1
    with pytest.raises(KeyError):
        predict.trim_model(c, targets=["u"])


def test_sources(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("id\tg1\tg2\tbatch\ns1\t1\t2\tA\ns2\t3\t4\tB\n")
    m, sheet = readers.read_matrix(spark, str(tmp_path / "e.tsv"), sheet_columns=["batch"])
    assert {(r.obs_id, r.feature, r.value) for r in m.collect()} == {("s1", "g1", 1.0), ("s1", "g2", 2.0), ("s2", "g1", 3.0), ("s2", "g2", 4.0)} and sheet.count() == 2
    (tmp_path / "n.tsv").write_text("G1\tG2\nt1\t1\t0\nt2\t0\t1\n")
    assert readers.read_network(spark, str(tmp_path / "n.tsv")).where("weight = 1").count() == 2
    cells = tmp_path / "cells"
    cells.mkdir()
    (cells / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% x\n2 3 3\n1 1 5\n2 3 3\n1 2 7\n")
    (cells / "barcodes.tsv").write_text("c1\nc2\nc3\n")
    with gzip.open(cells / "features.tsv.gz", "wt") as f:
        f.write("g1\tx\ng2\ty\n")
    got = {(r.obs_id, r.feature, r.value) for r in readers.read_expression(spark, "tenx", str(cells)).collect()}
    assert got == {("c1", "g1", 5.0), ("c3", "g2", 3.0), ("c2", "g1", 7.0)}
    (tmp_path / "tfs.tsv").write_text("b\na\n")
    assert [r.label for r in readers.read_lines(spark, str(tmp_path / "tfs.tsv")).orderBy("place").collect()] == ["b", "a"]
    for bad in (lambda: readers.read_expression(spark, "h9", "x"), lambda: readers.join_path("a", None), lambda: readers.read_feature_sheet(spark, "x", None)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        readers.read_cell_folder(spark, str(tmp_path))
    assert readers.join_path("/a/", "b") == "/a/b" and readers.join_path("/a", "/b") == "/b"
    assert writers.write_tsv(m, None, "x") is None and writers.write_tsv(m, str(tmp_path), "out.tsv")


def test_layers_decay_and_sheets(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("id\tg1\tg2\ns1\t1\t2\ns2\t3\t4\n")
    m = readers.read_expression(spark, "tsv", str(tmp_path / "v.tsv"))
    assert readers.read_layer(spark, "tsv", str(tmp_path / "v.tsv"), m).count() == 4
    with pytest.raises(ValueError, match="shares no cell"):
        readers.read_layer(spark, "tsv", str(tmp_path / "v.tsv"), m.withColumn("obs_id", F.lit("z")))
    assert readers.read_decay(spark, str(tmp_path / "v.tsv"))[0] == "per_cell"
    (tmp_path / "d.tsv").write_text("id\tDC\ng1\t0.5\ng2\t1\n")
    kind, per = readers.read_decay(spark, str(tmp_path / "d.tsv"))
    assert kind == "per_feature" and {(r.feature, r.decay) for r in per.collect()} == {("g1", 0.5), ("g2", 1.0)}
    (tmp_path / "row.tsv").write_text("id\tg1\tg2\nDC\t0.5\t1\n")
    assert {(r.feature, r.decay) for r in readers.read_decay(spark, str(tmp_path / "row.tsv"))[1].collect()} == {("g1", 0.5), ("g2", 1.0)}
    assert readers.read_activity(spark, str(tmp_path / "v.tsv")).columns == ["obs_id", "regulator", "value"]
    (tmp_path / "m.tsv").write_text("isTs\tis1stLast\tprevCol\tdel.t\tcondName\nTRUE\tf\tNA\tNA\ta\nTRUE\tl\ta\t2.5\tb\n")
    sheet = readers.read_sheet(spark, str(tmp_path / "m.tsv"))
    assert dict(sheet.dtypes)["isTs"] == "boolean" and {(r["condName"], r["del.t"]) for r in sheet.collect()} == {("a", None), ("b", 2.5)}
    (tmp_path / "twice.tsv").write_text("t\tr\tr\na\t1\t2\n")
    with pytest.raises(ValueError, match="twice"):
        readers.read_network(spark, str(tmp_path / "twice.tsv"))


def test_hdf5_files(spark, tmp_path):
    try:
        import h5py
    except ImportError:
        for read in (readers.read_annotated, readers.read_cells_hdf5, readers.read_hdf5):
            with pytest.raises(ImportError, match="h5py"):
                read(spark, str(tmp_path / "x.h5"))
        return
    with h5py.File(tmp_path / "cells.h5", "w") as f:
        g = f.create_group("matrix")
        g["barcodes"], g["genes"], g["data"], g["indices"], g["indptr"] = [b"c1", b"c2"], [b"g1", b"g2"], [5, 7], [1, 0], [0, 1, 2]
    assert {tuple(r) for r in readers.read_cells_hdf5(spark, str(tmp_path / "cells.h5")).collect()} == {("c1", "g2", 5.0), ("c2", "g1", 7.0)}


def test_functions_of_whole_columns(spark):
    from netloom.functions.normalize import by_column

    m = spark.createDataFrame([("s2", "a", 3), ("s1", "a", 1), ("s1", "b", 5)], "obs_id string, feature string, value int")
    assert {tuple(r) for r in by_column(m, np.cumsum).collect()} == {("a", "s1", 1.0), ("a", "s2", 4.0), ("b", "s1", 5.0)}
    with pytest.raises(Exception, match="the function gave"):
        by_column(m, lambda v: v[:0]).collect()


def test_single_file(spark, tmp_path):
    assert writers.write_tsv(spark.range(3), str(tmp_path), "one.tsv", single=True) and (tmp_path / "one.tsv").read_text() == "id\n0\n1\n2\n"


def test_stream(spark, tmp_path):
    from netloom.operators.lineparse import SAMPLE_SHEET
    from netloom.streaming.lines import parse_stream, reject_counts, write_parsed

    schema = "raw_id long, source string, line string, at timestamp"
    src = tmp_path / "in"
    rows = [(1, "meta_data", "TRUE\tm\tS1\t10\tS2", "2024-01-01 00:10:00"), (2, "meta_data", "TRUE\tm\tS1\tx\tS2", "2024-01-01 00:20:00"), (2, "meta_data", "TRUE\tm\tS1\tx\tS2", "2024-01-01 00:21:00"), (3, "meta_data", "TRUE\tm\tS1\ty\tS2", "2024-01-01 01:20:00")]
    spark.createDataFrame(rows, "raw_id long, source string, line string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(src))
    read = lambda: spark.readStream.schema(schema).parquet(str(src))
    layouts = {"meta_data": SAMPLE_SHEET}
    write_parsed(parse_stream(read(), layouts, ["raw_id"], time="at", once=["raw_id"]), str(tmp_path / "out")).awaitTermination(120)
    got = sorted((r.raw_id, r.state) for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect())
    assert got == [(1, "loaded"), (2, "rejected"), (3, "rejected")]
    q = reject_counts(parse_stream(read(), layouts, ["raw_id", "at"]), "at").writeStream.outputMode("complete").format("memory").queryName("rejects").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.kind, r.lines) for r in spark.sql("select * from rejects").collect()) == [("invalid", 1), ("invalid", 2)]
    for bad in (lambda: parse_stream(spark.createDataFrame([], schema), layouts, []), lambda: parse_stream(read(), layouts, [], once=["raw_id"])):
        with pytest.raises(ValueError):
            bad()


def test_matrix_and_checks(spark):
    from netloom.functions import checks
    from netloom.operators.matrix import Matrix, split_by_column

    wide = spark.createDataFrame([("s1", 1, 0.0, "A"), ("s2", 0, 4.0, "B")], "id string, x int, y double, batch string")
    m = Matrix.from_wide(wide, "id")
    assert m.shape() == (2, 2) and m.obs.columns == ["obs_id", "batch"] and m.sparse().cells.count() == 2 and m.sparse().dense().cells.count() == 4
    assert {r.feature: (r.total, r.mean) for r in m.sparse().moments().collect()} == {"x": (1, 0.5), "y": (4, 2)}
    assert m.subset(["s1"], ["y"]).cells.count() == 1
    more = m.with_sheet(spark.createDataFrame([("s1", "C", 1), ("s9", "D", 2)], "obs_id string, batch string, n int"))
    assert {r.obs_id: (r.batch, r.n) for r in more.obs.collect()} == {"s1": ("C", 1), "s2": (None, None)}
    assert m.dot(spark.createDataFrame([("x", "k", 2.0), ("y", "k", 1.0)], "feature string, column string, value double")).count() == 2
    assert split_by_column(m.cells, m.obs, "batch").select("task").distinct().count() == 2
    assert Matrix.from_wide(wide, "id", features_are_rows=True).features.count() == 2
    assert checks.in_range(1, 0, 2) == 1 and checks.one_of("a", ["a"]) == "a" and checks.of_type(None, int, none=True) is None and checks.subclass_of(bool, int)
    checks.aligned(m.cells, m.obs, "obs_id")
    checks.unique(m.cells, ["obs_id", "feature"])
    checks.finite(m.cells)
    for bad in (lambda: checks.in_range(3, 0, 2), lambda: checks.in_range("x"), lambda: checks.in_range(1.5, integer=True), lambda: checks.one_of("b", ["a"]), lambda: checks.of_type(1, str), lambda: checks.subclass_of(1, int), lambda: checks.a_path("/no/such"), lambda: checks.unique(m.cells, ["obs_id"]), lambda: checks.finite(m.cells.withColumn("value", F.lit(None).cast("double"))), lambda: checks.aligned(m.cells, wide.withColumnRenamed("id", "obs_id").limit(1), "obs_id")):
        with pytest.raises(ValueError):
            bad()


def test_scaling_reaches_the_models(toy):
    spec = Spec(regression="sklearn", bootstraps=1, scaling=Preprocessing().with_(predictors="raw", response="raw"))
    raw = {(r.target, r.regulator): r.beta for r in infer(toy, spec).coefficients.collect()}
    scaled = {(r.target, r.regulator): r.beta for r in infer(toy, spec.with_(scaling=Preprocessing())).coefficients.collect()}
    assert raw.keys() == scaled.keys() and any(abs(raw[k] - scaled[k]) > 1e-6 for k in raw)


def test_activity_scaling_reaches_the_half_response(toy):
    rows = toy.expression.select(F.col("obs_id").alias("cond"), "feature", F.col("value").alias("design"), F.col("value").alias("response"), (F.col("value") * 3 + 5).alias("half_response"))
    spec = Spec(scaling=Preprocessing().with_(activity="zscore"))
    got = [{(r.cond, r.regulator): r.value for r in regulator_activity(d, toy.prior, toy, spec, []).collect()} for d in (rows, rows.withColumn("half_response", F.col("design")))]
    assert got[0] and got[0] == pytest.approx(got[1])  # z-scores forget scale and shift
