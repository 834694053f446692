import random

from pyspark.sql import functions as F

from netloom.operators import orphans


def test_runs_of_integers(spark):
    df = spark.createDataFrame([(k,) for k in [1, 2, 3, 7, 7, 8, 1 << 21, (1 << 20) - 1, 1 << 20]] + [(None,)], "k long").withColumn("g", F.lit("a"))
    got = sorted((r["first"], r["last"]) for r in orphans.runs(df, ["g"], F.col("k")).collect())
    assert got == [(1, 3), (7, 8), ((1 << 20) - 1, 1 << 20), (1 << 21, 1 << 21)]


def test_intervals_and_open_ends(spark):
    df = spark.createDataFrame([("a", 5, 9), ("a", 1, 5), ("a", 20, None), ("a", 30, 40), ("a", 12, 11), (None, 1, 2)], "g string, s long, e long")
    got = sorted(((r["g"] or "", r["first"], r["last"]) for r in orphans.runs(df, ["g"], F.col("s"), F.col("e")).collect()))
    assert got == [("", 1, 2), ("a", 1, 9), ("a", 20, orphans.OPEN)]


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(5)
    name = lambda: "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None, "c "])
    parents = [(name(), (s := rnd.randrange(100)), rnd.choice([None, s, s + rnd.randrange(30)])) for _ in range(60)]
    refs = [(name(), rnd.choice([None, rnd.randrange(120)]), "t") for _ in range(500)]
    p, r = spark.createDataFrame(parents, "n string, s long, e long"), spark.createDataFrame(refs, "n string, at long, tab string")
    want = {(t, n, a) for n, a, t in refs if a is None or not any(m == n and s <= a and (e is None or a <= e) for m, s, e in parents)}
    for hot in (20, 10_000):
        got = orphans.orphans(r.withColumn("k", F.col("at")), p, group=["n"], ref_key=F.col("at"), first=F.col("s"), last=F.col("e"), out=["tab", "n", "k"], hot_rows=hot).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_empty_sides(spark):
    p, r = spark.createDataFrame([], "n string, s long"), spark.createDataFrame([("a", 1), ("a", 1)], "n string, at long")
    run = lambda r, p: orphans.orphans(r, p, group=["n"], ref_key=F.col("at"), first=F.col("s"), out=["n"]).collect()
    assert [x.n for x in run(r, p)] == ["a"]
    assert run(r.limit(0), p) == []


def test_named_orphans_against_brute_force(spark):
    rnd = random.Random(6)
    name = lambda: "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "gone", "c ", "z", ""])
    parents = [(rnd.choice(["t", None]), rnd.choice(["hot", "a", "b", "c ", "x", None]), (s := rnd.randrange(100)), rnd.choice([None, s, s + rnd.randrange(30)])) for _ in range(60)]
    refs = [(rnd.choice(["t", None, "u"]), name(), rnd.choice([None, rnd.randrange(120)]), "tab") for _ in range(600)]
    p, r = spark.createDataFrame(parents, "g string, k string, s long, e long"), spark.createDataFrame(refs, "g string, k string, at long, tab string").withColumn("id", F.lit("clash"))
    want = {(g, k, a) for g, k, a, _ in refs if a is None or not any(pg == g and pk == k and s <= a and (e is None or a <= e) for pg, pk, s, e in parents)}
    for hot in (20, 10_000):
        got = orphans.named_orphans(r, p, group=["g"], key="k", at="at", first="s", last="e", out=["g", "k", "at"], hot_rows=hot).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)
    keys = orphans.named_keys(r, p.where("k is not null"), ["g"], "k").orderBy("id").collect()
    assert [x.id for x in keys] == list(range(1, len(keys) + 1)) and [(x.g or "", x.k) for x in keys] == sorted((x.g or "", x.k) for x in keys)
    assert len(orphans.named_orphans(r, p.limit(0), group=["g"], key="k", at="at", first="s", last="e", out=["g", "k"]).collect()) == len({x[:2] for x in refs})
    assert orphans.named_orphans(r.limit(0), p, group=["g"], key="k", at="at", first="s", last="e", out=["k"]).count() == 0
