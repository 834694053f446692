import random

import numpy as np
import pytest

from netloom.llm import spans


def brute(rows, n):
    seen = {}
    for d, t in rows:
        for i in range(len(t or "") - n + 1):
            seen.setdefault(t[i : i + n], set()).add(d)
    pairs = {(a, b) for v in seen.values() for a in v for b in v if a < b}
    cover = {}
    for d, t in rows:
        out = []
        for i in range(len(t or "") - n + 1):
            if len(seen[t[i : i + n]]) > 1:
                if out and i <= out[-1][1]:
                    out[-1][1] = i + n
                else:
                    out.append([i, i + n])
        if out:
            cover[d] = [tuple(x) for x in out]
    return pairs, cover


def corpus(seed, n=60, alphabet="abcdefgé漢🙂 \n"):
    rnd = random.Random(seed)
    fresh = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    pool = [fresh(rnd.randrange(15, 60)) for _ in range(12)] + ["=" * 40, "ab" * 25, " " * 30]
    return [(i, "".join(rnd.choice([fresh(rnd.randrange(0, 25)), (p := rnd.choice(pool))[rnd.randrange(len(p)) :], p]) for _ in range(rnd.randrange(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("seed, length, hot", [(1, 20, 10**6), (2, 20, 3), (3, 31, 2), (4, 12, 10**6)])
def test_pairs_and_spans_against_brute_force(spark, seed, length, hot):
    rows = corpus(seed) + [(100, None), (101, ""), (102, "x" * (length - 1))]
    twin = "same text of enough length, whatever is asked for here"
    rows += [(103, twin), (104, twin), (105, twin)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, pos string").repartition(5)
    pairs, cover = brute(rows, length)
    assert pairs
    got = spans.shared_pairs(df, length=length, hot_rows=hot).collect()
    assert {tuple(r) for r in got} == pairs and len(got) == len(pairs)
    found = {}
    for r in spans.shared_spans(df, length=length, hot_rows=hot).collect():
        found.setdefault(r.doc, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in found.items()} == cover


def test_small_batches_split_groups(spark):
    rows = corpus(7)
    pairs, _ = brute(rows, 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(r) for r in spans.shared_pairs(spark.createDataFrame(rows, "doc_id long, text string"), length=20).collect()} == pairs
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_texts_are_sliced_without_loss(spark, monkeypatch):
    rnd = random.Random(9)
    body = "".join(rnd.choice("abcdefgh") for _ in range(3 * spans.SLICE))
    at = spans.SLICE - 60  # across a border of slices
    rows = [(1, body), (2, "q" + body[at : at + 120] + "z"), (3, "q" + body[2 * spans.SLICE : 2 * spans.SLICE + 119] + "z")]
    got = {tuple(r) for r in spans.shared_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2)}


def test_every_window_has_an_entry():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab"), size=k)) for k in (5, 40, 19, 20, 21, 100)]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    at, _ = spans.entries(codes, sizes, 20)
    start = 0
    for t in texts:
        for i in range(len(t) - 20 + 1):
            assert ((at >= start + i) & (at <= start + i + 10)).any()
        start += len(t)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_pairs(df).count() == 0 and spans.shared_spans(df).count() == 0


@pytest.mark.parametrize("hot", [50, 10**6])
def test_one_text_in_many_surroundings(spark, hot):
    """A planted text in most documents, each time between other characters, and a group of equal copies."""
    rnd = random.Random(11)
    fresh = lambda k: "".join(rnd.choice("abcdefghij") for _ in range(k))
    planted, copy = fresh(90), fresh(130)
    rows = [(f"d{i:03d}", (fresh(rnd.randrange(30)) + planted + fresh(rnd.randrange(30))) if i % 3 else copy) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    pairs, cover = brute(rows, 40)
    assert {tuple(r) for r in spans.shared_pairs(df, length=40, hot_rows=hot).collect()} == pairs
    found = {}
    for r in spans.shared_spans(df, length=40, hot_rows=hot).collect():
        found.setdefault(r.doc, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in found.items()} == cover
    for r in spans.shared_factors(df, length=40, hot_rows=hot).collect():
        assert 40 <= r.factor <= r.end - r.start or r.factor == 40
    classes = spans.match_classes(df, length=40, hot_rows=hot)
    assert classes.count() < 20 * len(rows)
