import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from netloom.llm import ranks, topn


def brute_points(values):
    """values: list of float or None."""
    known = sorted(v for v in values if v is not None)
    m = len(known)
    out = []
    for v in values:
        if v is None or m < 2:
            out.append(0.5)
        else:
            below, same = sum(x < v for x in known), sum(x == v for x in known)
            out.append((below + (same - 1) / 2) / (m - 1))
    return out


def test_borda_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):  # one scope holds most rows, many values are tied
        s = "hot" if i % 3 else rnd.choice(["a", "b", None, "single"] if i < 100 else ["a", None])
        rows.append((s, f"i{i:03d}", rnd.choice([0.0, -0.0, 1.0, 1e300, rnd.random(), None, float("nan")]), rnd.choice([0.0, rnd.randrange(5) / 7, None, float("inf")])))
    df = spark.createDataFrame(rows, "scope string, id string, x double, y double")
    got = {r.id: r for r in ranks.borda(df, scope="scope", scores={"x": 1.0, "y": 2.0}).collect()}
    assert len(got) == 300
    clean = lambda v: None if v is None or v != v or abs(v) == float("inf") else v
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        px, py = brute_points([clean(r[2]) for r in mine]), brute_points([clean(r[3]) for r in mine])
        for r, a, b in zip(mine, px, py):
            assert got[r[1]].borda == pytest.approx(a + 2 * b, abs=1e-9)


def test_range_of_a_score_does_not_matter(spark):
    df = spark.createDataFrame([("s", i, float(i), float(9 - i)) for i in range(10)], "scope string, id int, x double, y double")
    a = ranks.borda(df, scope="scope", scores={"x": 1.0, "y": 1.0}).select("id", "borda").collect()
    b = ranks.borda(df.withColumn("x", F.exp(F.col("x") * 50)), scope="scope", scores={"x": 1.0, "y": 1.0}).select("id", "borda").collect()
    assert dict(a) == dict(b) and set(dict(a).values()) == {1.0}


def test_numbered(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "id int, v double")
    got = ranks.numbered(df, [F.desc("v"), F.col("id")]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 51))
    assert [(r.v, r.id) for r in got] == sorted(((float(i % 3), i) for i in range(50)), key=lambda t: (-t[0], t[1]))
    empty = df.limit(0)
    assert ranks.numbered(empty, [F.desc("v"), F.col("id")]).count() == 0
    assert ranks.borda(empty.withColumn("s", F.lit("x")), scope="s", scores={"v": 1.0}).count() == 0


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), s), s)
    out = {}
    for (g, i), s in best.items():
        out.setdefault(g, []).append((-s, i))
    return {(g, i, -s, k + 1) for g, v in out.items() for k, (s, i) in enumerate(sorted(v)[:n])}


def test_top_n_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [("hot" if k % 3 == 0 else f"g{rnd.randrange(200)}", f"r{rnd.randrange(300)}é"[: rnd.randrange(2, 6)], rnd.choice([0.5, 0.25, rnd.random(), float("inf"), -1.0])) for k in range(6000)]
    rows += [(None, "r", 1.0), ("g1", None, 1.0), ("g1", "x", None), ("g1", "y", float("nan")), ("", "", 2.0)]
    df = spark.createDataFrame(rows, "g string, i string, score double").withColumn("s", F.lit(1)).withColumn("place", F.lit("clash"))
    got = topn.top_n(df, group="g", item="i", score="score", n=5).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 5) and len(got) == len(brute_top(rows, 5))
    assert topn.top_n(df.limit(0), group="g", item="i", score="score").count() == 0


def skipping(df, n=5):
    path = topn.cluster(df, group=F.col("g"), item=F.col("i"), score=F.col("s"), row_group_bytes=4096)
    read = skipped = 0
    for p, _ in topn.files(df.sparkSession, path):
        _, r, s = topn.read_top(p, n)
        read, skipped = read + r, skipped + s
    return read, skipped


def scored(spark, rows, groups):
    return spark.range(rows).select(F.concat(F.lit("g"), F.pmod("id", F.lit(groups))).alias("g"), F.concat(F.lit("r"), F.col("id")).alias("i"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e9).alias("s"))


def test_row_groups_of_a_large_group_are_skipped(spark):
    df = scored(spark, 200_000, 1)
    read, skipped = skipping(df)
    assert skipped > 3 * read
    want = df.orderBy(F.desc("s"), "i").limit(5).toPandas()
    got = topn.top_n(df, group="g", item="i", score="s", n=5, row_group_bytes=4096).orderBy("place").toPandas()
    pd.testing.assert_series_equal(got["i"], want["i"])


def test_row_groups_below_every_contained_group_are_skipped(spark):
    df = scored(spark, 200_000, 500)  # 400 rows each, many groups in each row group
    read, skipped = skipping(df)
    assert skipped > read
    rows = [tuple(r) for r in df.collect()]
    got = topn.top_n(df, group="g", item="i", score="s", n=5, row_group_bytes=4096).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 5)


def test_equal_scores_are_never_skipped(spark):
    df = scored(spark, 50_000, 3).withColumn("s", F.lit(0.5))
    rows = [tuple(r) for r in df.collect()]
    assert {tuple(r) for r in topn.top_n(df, group="g", item="i", score="s", n=5, row_group_bytes=4096).collect()} == brute_top(rows, 5)
