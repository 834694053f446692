import random

import pytest
from pyspark.sql import functions as F

from netloom.llm import mixing, queries

SCHEMA = "doc_id long, source string, lang string, topic string, n_tokens int"


def test_raking_meets_the_margins():
    tokens = {(s, l, t): float(10 + 7 * i + 3 * j + k) for i, s in enumerate("ab") for j, l in enumerate("xy") for k, t in enumerate("pq")}
    fit = mixing.rake(tokens, {"a": 40.0, "b": 30.0}, {"a": 3, "b": 3})
    w = fit.weights
    got = {s: sum(w[c] * tokens[c] for c in tokens if c[0] == s) for s in "ab"}
    assert got["a"] == pytest.approx(40) and got["b"] == pytest.approx(30)
    share = sum(w[c] * tokens[c] for c in tokens if c[1] == "x") / 70
    assert share == pytest.approx(sum(t for c, t in tokens.items() if c[1] == "x") / sum(tokens.values()), abs=1e-6)
    assert fit.moved <= mixing.TOLERANCE and fit.rounds < 100 and max(fit.misses.values()) < 1e-6


def test_raking_respects_caps():
    w = mixing.rake({("a", "x", "p"): 10.0, ("a", "y", "p"): 1000.0, ("b", "x", "p"): 500.0}, {"a": 1500.0, "b": 9000.0}, {"a": 2, "b": 4}).weights
    assert w["b", "x", "p"] == pytest.approx(4) and max(w["a", "x", "p"], w["a", "y", "p"]) <= 2
    assert 10 * w["a", "x", "p"] + 1000 * w["a", "y", "p"] == pytest.approx(1500)
    assert mixing.rake({}, {"a": 1.0}, {"a": 1}).weights == {}


def make(spark, n=4000):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        s = rnd.choices(["big", " Big ", "small", "tiny", "other", None], [50, 10, 12, 1, 20, 7])[0]
        rows.append((i, s, rnd.choice(["en", "de", None]), rnd.choice(["diff", "prose", None]), rnd.choice([0, 5, 50, 120, 400])))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_shares_caps_and_determinism(spark):
    rows, df = make(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("SMALL ", 0.3, 3), ("tiny", 0.1, 2), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    chosen = mixing.select(df.withColumn("w", F.lit(1)).withColumn("at", F.lit("x")), targets)
    got = chosen.collect()
    total = sum(r[4] for r in rows)
    have = lambda s: sum(r[4] for r in rows if r[1] and r[1].strip().lower() == s)
    tokens = {s: sum(r.copies * r.n_tokens for r in got if r.source == s) for s in ("big", "small", "tiny")}
    for s, share, cap in (("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.1, 2)):
        assert abs(tokens[s] - min(share * total, cap * have(s))) <= 400
        assert all(r.copies <= cap for r in got if r.source == s)
    assert {r.source for r in got} == {"big", "small", "tiny"} and all(r.copies >= 1 for r in got) and len({r.doc_id for r in got}) == len(got)
    assert sorted(mixing.select(df.repartition(7), targets).collect()) == sorted(got)
    rep = {r.source: r for r in mixing.report(chosen, df, targets).collect()}
    assert rep["none"].tokens == 0 and rep["big"].tokens == tokens["big"] and rep["tiny"].most_copies == 2


def test_empty(spark):
    _, df = make(spark, 20)
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    none = mixing.select(df.limit(0), targets)
    assert none.count() == 0 and mixing.report(none, df.limit(0), targets).first().tokens == 0
    assert mixing.select(df, targets.limit(0)).count() == 0


def test_many_labels_are_raked_together_and_no_record_is_lost(spark):
    rows = [(i, "a", f"l{i % 40}", f"t{i % 37}", 10) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen = mixing.select(df, targets, max_cells=100)
    assert chosen.count() == 3000 and chosen.select("lang").distinct().count() == 40
    with pytest.raises(ValueError, match="sources"):
        mixing.select(df, spark.range(mixing.MAX_SOURCES + 1).select(F.col("id").cast("string").alias("source"), F.lit(0.0).alias("target_share"), F.lit(1).alias("max_repeats")))


def test_margins(spark):
    _, df = make(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3)], "source string, target_share double, max_repeats int")
    p = mixing.plan(df, targets)
    got = mixing.margins(mixing.select(df, targets, planned=p), p).collect()
    assert {r.axis for r in got} == {"source", "lang", "topic"} and p.fit.misses["source"] < 1e-6
    for r in got:
        assert abs(r.reached - r.fitted) <= 0.05 * max(r.fitted, 20_000)


def test_topics(spark):
    texts = [None, " ", "x\ndiff --git a/x.PY b/x.rs\n@@ -1,2 +3 @@", "Index: src/a.b.java\n", "+++ b/Makefile\n+++ b/y.go", "see a.py", "--- \n"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(mixing.change_type(F.col("t"))).collect()]
    assert got == ["none", "none", "py", "java", "go", "none", "none"]


def test_every_label_has_its_own_margin_beyond_the_bound(spark):
    sizes = {(s, l, t): 40 + 9 * i + 5 * ((3 * i + 2 * j + k) % 7) for i, s in enumerate("ab") for j, l in enumerate("vwxyz") for k, t in enumerate("pqr") if (i, j, k) != (1, 4, 2)}
    df = spark.createDataFrame([(100 * i + n, *c, 10) for i, (c, size) in enumerate(sizes.items()) for n in range(size)], SCHEMA)
    targets = spark.createDataFrame([("a", 0.66, 2), ("b", 0.2, 1)], "source string, target_share double, max_repeats int")
    tokens, total = {c: 10.0 * n for c, n in sizes.items()}, 10.0 * sum(sizes.values())
    whole = mixing.rake(tokens, {"a": 0.66 * total, "b": 0.2 * total}, {"a": 2, "b": 1})
    p = mixing.plan(df, targets, max_cells=10)
    got = {(r.axis, r.label): r for r in mixing.margins(mixing.select(df, targets, planned=p), p).collect()}
    assert set(got) == {(a, c[k]) for k, a in enumerate(mixing.AXES) for c in sizes}
    for (axis, name), r in got.items():
        k = mixing.AXES.index(axis)
        assert r.fitted == pytest.approx(sum(whole.weights[c] * t for c, t in tokens.items() if c[k] == name), abs=0.06)
    weights = {(r.source, r.lang, r.topic): r.w for r in p.cells.collect()}
    assert weights == pytest.approx(whole.weights, abs=1e-8) and p.fit.misses == pytest.approx(whole.misses, abs=1e-6)


def test_caps_are_met_in_spark(spark):
    tokens = {("a", "x", "p"): 10.0, ("a", "y", "p"): 1000.0, ("b", "x", "p"): 500.0, ("c", "y", "p"): 70.0}
    want, cap = {"a": 1500.0, "b": 9000.0, "c": 10.0}, {"a": 2, "b": 4, "c": 0}
    cells = spark.createDataFrame([(*c, t, cap[c[0]]) for c, t in tokens.items()], "source string, lang string, topic string, t double, cap int")
    have = {s: sum(t for c, t in tokens.items() if c[0] == s) for s in want}
    aims = spark.createDataFrame([(s, have[s], min(want[s], have[s] * cap[s])) for s in want], "source string, have double, aim double")
    raked, _ = mixing.rake_in_spark(cells, aims, 3)
    assert {(r.source, r.lang, r.topic): r.w for r in raked.collect()} == pytest.approx(mixing.rake(tokens, want, cap, 3).weights, abs=1e-8)


def test_the_selection_does_not_depend_on_bins(spark, monkeypatch):
    _, df = make(spark)
    targets = spark.createDataFrame([("big", 0.31, 1), ("small", 0.17, 3)], "source string, target_share double, max_repeats int")
    fine = sorted(mixing.select(df, targets).collect())
    monkeypatch.setattr(mixing, "BINS", 2)
    assert sorted(mixing.select(df, targets).collect()) == fine


def test_few_records_of_small_weight_reach_their_target(spark):
    df = spark.createDataFrame([(i, "a", "x", "p", 10) for i in range(3)] + [(9, "b", "x", "p", 970)], SCHEMA)
    targets = spark.createDataFrame([("a", 0.0075, 1)], "source string, target_share double, max_repeats int")
    for seed in range(6):  # 7.5 of 30 tokens: one record is closer than none or two, wherever the draws lie
        assert [r.copies for r in mixing.select(df, targets, seed=seed).collect()] == [1]


def test_any_number_of_sources_in_the_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    n = 5003
    spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("S"), "id").alias("source"), F.lit("en").alias("lang"), F.lit("one two three").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(1.0 / n).alias("target_share"), F.lit(1).alias("max_repeats")).write.parquet(f"{tmp_path}/mix_targets.parquet")
    assert queries.p7_mix(spark, str(tmp_path)).count() == n
