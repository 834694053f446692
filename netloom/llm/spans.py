"""Long exact spans shared between records, by parsing every text relative to the indexed reference blocks.

The corpus is its own reference. Its index holds, for every window of ``length`` characters,
the k-gram (half that length) with the least hash, so any stretch of ``length`` equal characters in two
texts contains an entry of both, at the same place of the stretch. A reference block is what the index holds under one
entry: the stretches of text around that k-gram in all documents that have it, equal stretches kept once. A document is parsed
against each block it has an entry in, and against no other, as no other can hold a factor of that length over this place.

The parse: a block's stretches are put in suffix order, first from the k-gram on, then from one character further left each time
(the order of longer suffixes follows from the one before by one stable sort on the new character). From a given start the longest
match of a stretch in the block, its greedy factor, is with a neighbour in that order. Factors of at least ``length`` are
duplicate spans. They are checked at the factors' left boundary: a pair of documents is given only where the characters before differ
or a text begins, so a long copy doesn't repeat its pairs at each of its entries.

Scale: only entries of at least two stretches travel on, counted with partial sums; whole texts never meet. Equal stretches are one
row of a block with the least and greatest document that have them, so a text copied into a third of all documents costs a block one row;
documents come back by a join at the end, pairs by joining classes of equal boundaries, never as a list in one task.
Blocks with more than ``hot_rows`` different stretches (one text in many different surroundings) are not parsed in one task: their windows
are counted by key in Spark with partial sums, which gives the same factors of ``length`` (by 128 bits of hash; elsewhere characters are
compared). Nothing is capped: work follows the matches there are.

Defined results
---------------
* lengths are Unicode code points; blanks, line ends and signs count as they stand.
* null texts and texts shorter than ``length`` share nothing. Equal texts of that length are pairs.
* repeats inside one document don't count; repeated ids count as one document. Ids of any type are kept as they are.
* empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.session import materialize

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        m = max(n, SLICE + 4096)
        one = np.ones(1, np.uint64)
        fill = lambda b: np.concatenate([one, np.cumprod(np.full(m - 1, b, np.uint64))])
        _POWERS[0] = fill(_BASE), fill(pow(_BASE, -1, 1 << 64))
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def entries(codes: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``codes`` (texts one after the other) of the index entries, and their hashes."""
    k, n = length // 2, len(codes)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pw, inverse = powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * pw[:n], out=run[1:])
    h = mix((run[k:] - run[:-k]) * inverse[: n - k + 1])
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # order by hash, then place
    width, have = length - k + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    windows = np.maximum(sizes - length + 1, 0)  # windows never cross from text to text
    first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(windows) - windows), windows)
    at = (m[first + np.arange(len(first))] & low).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    return at, h[at]


def index(docs: DataFrame, length: int) -> DataFrame:
    """(h, doc, pos): the entries of all texts, found from left to right in slices that overlap."""
    import netloom.llm.spans as me

    kind = docs.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            sizes = np.array([len(t) for _, _, t in held], np.int64)
            codes = np.frombuffer("".join(t for _, _, t in held).encode("utf-32-le", "surrogatepass"), np.uint32)
            at, h = me.entries(codes, sizes, length)
            starts = np.cumsum(sizes) - sizes
            which = np.searchsorted(starts, at, side="right") - 1
            base = np.array([b for _, b, _ in held], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([d for d, _, _ in held], ids).take(pa.array(which)), pa.array((at - starts[which] + base[which]).astype(np.int32))], names=["h", "doc", "pos"])

        held, size, ids = [], 0, None
        for b in batches:
            ids = b["doc"].type
            for d, t in zip(b["doc"].to_pylist(), b["text"].to_pylist()):
                for start in range(0, max(1, len(t) - length + 1), SLICE - length + 1):
                    piece = t if len(t) <= SLICE else t[start : start + SLICE]
                    if held and size + len(piece) > SLICE:
                        yield flush()
                        held, size = [], 0
                    held.append((d, start, piece))
                    size += len(piece)
        if held:
            yield flush()

    return docs.mapInArrow(run, T.StructType([T.StructField("h", T.LongType()), T.StructField("doc", kind), T.StructField("pos", T.IntegerType())]))


def stretches(docs: DataFrame, length: int) -> DataFrame:
    """(h, c1, c2, doc, pos, have, s): entries that occur again, with the characters around them.

    ``have`` characters stand before the k-gram in ``s``; (h, c1, c2) names equal stretches."""
    k = length // 2
    need = length - k
    found = materialize(index(docs, length), "entries")
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    marks = found.join(again, "h", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("pos", "h")).alias("marks"))  # bounded by the text's length
    around = lambda m: F.struct(m["h"].alias("h"), m["pos"].alias("pos"), F.least(m["pos"], F.lit(need + 1)).alias("have"), F.substring("text", F.greatest(m["pos"] - need, F.lit(1)), F.least(m["pos"], F.lit(need + 1)) + k + need).alias("s"))
    cut = docs.join(marks, "doc").select("doc", F.explode(F.transform("marks", around)).alias("m")).select("doc", "m.*")
    return materialize(cut.select("h", F.xxhash64("have", "s").alias("c1"), F.xxhash64("s", F.lit(1)).alias("c2"), "doc", "pos", "have", "s"), "stretches")


CLASS = ["h", "c1", "c2"]


def blocks(found: DataFrame, length: int, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(h, c1, c2, have, s, several): the different stretches of each block, once for blocks to parse and once for those to count.

    Blocks of one stretch in one document share nothing and drop out."""
    each = found.groupBy(*CLASS).agg(F.first("have").alias("have"), F.first("s").alias("s"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    sizes = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("h", "n")
    kept = each.join(sizes, "h")
    return kept.where(F.col("n") <= hot_rows).drop("n"), kept.where(F.col("n") > hot_rows).drop("n")


class Block:
    """The stretches of whole blocks, as a matrix of characters with the k-gram at one column."""

    def __init__(self, t: pa.Table, length: int):
        self.length, self.k = length, length // 2
        self.need = length - self.k
        n = t.num_rows
        col = lambda c: t[c].to_numpy().astype(np.int64)
        self.h, self.c1, self.c2, self.have = col("h"), col("c1"), col("c2"), col("have")
        ids = pa.chunked_array([*t["low"].chunks, *t["high"].chunks]).combine_chunks().dictionary_encode()
        codes = ids.indices.to_numpy(zero_copy_only=False)
        self.low, self.high = np.minimum(codes[:n], codes[n:]), np.maximum(codes[:n], codes[n:])  # any order of documents will do
        self.group = np.cumsum(np.r_[False, self.h[1:] != self.h[:-1]]) if n else np.zeros(0, np.int64)
        texts = t["s"].to_pylist()
        size = np.array([len(x) for x in texts], np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        width = self.need + 1 + self.k + self.need
        self.zero = self.need + 1  # column of the k-gram
        start = self.zero - self.have
        rows = np.repeat(np.arange(n), size)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        self.m = np.zeros((n, width), np.uint32)
        self.m[rows, cols] = flat + np.uint32(1)  # 0: beyond the text
        self.after = size - self.have - self.k  # characters after the k-gram
        right = [x[h:] for x, h in zip(texts, self.have.tolist())]
        self.order = np.array(sorted(range(n), key=lambda i: (self.group[i], right[i])), np.int64)

    def starts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each start ``o`` characters before the k-gram: the stretches that reach over a whole window from there, in
        suffix order, and for each the length of its match with the one before it (the greedy factor is the longer of both sides)."""
        order = self.order
        for o in range(self.need + 1):
            if o:
                order = order[np.argsort((self.group[order] << 21) | self.m[order, self.zero - o], kind="stable")]
            rows = order[(self.have[order] >= o) & (self.after[order] >= self.need - o)]
            if len(rows) < 1:
                continue
            here = self.m[:, self.zero - o :]
            lcp = np.zeros(len(rows), np.int64)
            for i in range(1, len(rows), 4096):
                a, b = rows[i : i + 4096], rows[i - 1 : i - 1 + len(rows[i : i + 4096])]
                x, y = here[a], here[b]
                differ = (x != y) | (x == 0) | (self.group[a] != self.group[b])[:, None]
                lcp[i : i + 4096] = np.where(differ.any(1), differ.argmax(1), here.shape[1])
            yield o, rows, lcp

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Starts with factors of at least the asked length: the stretches, where runs of one window begin, and factor lengths."""
        for o, rows, lcp in self.starts():
            same = lcp >= self.length
            inside = same | np.r_[same[1:], False] | (self.low[rows] != self.high[rows])
            if inside.any():
                longest = np.maximum(lcp, np.r_[lcp[1:], 0])
                yield o, rows[inside], np.flatnonzero(~same[inside]), longest[inside]

    def matches(self) -> dict[str, np.ndarray]:
        """Equal windows at a left boundary: (h, o, run) names them; each stretch with the character before, -1 where its text begins."""
        out = []
        for o, rows, starts, _ in self.runs():
            size = np.diff(np.r_[starts, len(rows)])
            before = np.where(self.have[rows] > o, self.m[rows, self.zero - o - 1].astype(np.int64), -1)
            differ = np.minimum.reduceat(before, starts) != np.maximum.reduceat(before, starts)
            begin = np.add.reduceat(((before == -1) & (self.low[rows] != self.high[rows])) * 2 + (before == -1), starts) > 1
            take = np.repeat(differ | begin, size)
            r = rows[take]
            out.append((self.h[r], self.c1[r], self.c2[r], np.full(len(r), o), np.repeat(rows[starts], size)[take], np.zeros(len(r), np.int64), before[take]))
        return dict(zip(("h", "c1", "c2", "o", "m1", "m2", "before"), map(np.concatenate, zip(*out)) if out else [np.zeros(0, np.int64)] * 7))

    def factors(self) -> dict[str, np.ndarray]:
        """(h, c1, c2, first, last, factor): a stretch's windows from ``last`` down to ``first`` characters before the k-gram
        stand in another document too; ``factor``: length of the greedy factor from the leftmost of them, as far as the block reaches."""
        n = len(self.h)
        hit = np.zeros((n, self.need + 3), bool)
        longest = np.zeros((n, self.need + 3), np.int64)
        for o, rows, starts, length in self.runs():
            several = np.minimum.reduceat(self.low[rows], starts) != np.maximum.reduceat(self.high[rows], starts)
            ok = np.repeat(several, np.diff(np.r_[starts, len(rows)]))
            hit[rows[ok], o + 1] = True
            alone = self.low[rows] != self.high[rows]
            longest[rows[ok], o + 1] = np.where(alone, o + self.k + self.after[rows], length)[ok]
        turn = np.diff(hit.astype(np.int8), axis=1)
        r, first = np.nonzero(turn == 1)
        _, last = np.nonzero(turn == -1)
        return {"h": self.h[r], "c1": self.c1[r], "c2": self.c2[r], "first": first, "last": last - 1, "factor": longest[r, last]}


MATCH = "h long, c1 long, c2 long, o long, m1 long, m2 long, before long"
FACTOR = "h long, c1 long, c2 long, first long, last long, factor long"


def parse(block: DataFrame, length: int, what: str, schema: str) -> DataFrame:
    """Run ``Block.matches`` or ``Block.factors`` over the blocks, some whole ones at a time."""
    import netloom.llm.spans as me

    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            got = getattr(me.Block(t, length), what)()
            return pa.RecordBatch.from_arrays([pa.array(got[c].astype(np.int64)) for c in names], names=names)

        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = b["h"].to_numpy()
            if not len(keys):
                continue
            if held and held[-1]["h"][-1].as_py() != keys[0]:
                yield solve(pa.Table.from_batches(held))
                held = []
            cut = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])  # the last block may go on
            if cut:
                yield solve(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    return block.select(*CLASS, "have", "s", "low", "high").repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def windows(hot: DataFrame, length: int) -> DataFrame:
    """Every window of the stretches of large blocks: (h, c1, c2, o, m1, m2, before, low, high)."""
    k = length // 2
    need = length - k
    o = F.explode(F.sequence(F.greatest(F.lit(0), need + k + F.col("have") - F.length("s")), F.least(F.lit(need), F.col("have"))))
    at = F.col("have") - F.col("o")
    window = F.substring("s", at + 1, F.lit(length))
    fits = F.col("have") + k - F.length("s") + need <= F.least(F.lit(need), F.col("have"))
    return hot.where(fits).select("*", o.alias("o")).select(
        *CLASS, F.col("o").cast("long").alias("o"), F.xxhash64(window).alias("m1"), F.xxhash64(window, F.lit(1)).alias("m2"),
        F.when(at > 0, F.ascii(F.substring("s", at, F.lit(1)))).otherwise(-1).cast("long").alias("before"), "low", "high",
    )


def hot_matches(hot: DataFrame, length: int) -> DataFrame:
    """As ``Block.matches``, counted by key."""
    w, key = windows(hot, length), ["h", "o", "m1", "m2"]
    start = (F.col("before") == -1).cast("int")
    good = w.groupBy(*key).agg(F.min("before").alias("a"), F.max("before").alias("b"), F.sum(start + 2 * start * (F.col("low") != F.col("high")).cast("int")).alias("begins")).where("a <> b or begins > 1").select(*key)
    return w.join(good, key).select(*[f.split()[0] for f in MATCH.split(", ")])


def hot_factors(hot: DataFrame, length: int) -> DataFrame:
    """As ``Block.factors``, counted by key; a factor counts as far as the window reaches."""
    w, key = windows(hot, length), ["h", "o", "m1", "m2"]
    good = w.groupBy(*key).agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a <> b").select(*key)
    hits = w.join(good, key).select(*CLASS, "o")
    run = F.col("o") - F.row_number().over(W.partitionBy(*CLASS).orderBy("o"))  # at most length / 2 + 1 rows
    return hits.withColumn("r", run).groupBy(*CLASS, "r").agg(F.min("o").alias("first"), F.max("o").alias("last")).select(*CLASS, "first", "last", F.lit(length).cast("long").alias("factor"))


def _docs(df: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    text: Column = F.col(f"`{text_col}`")
    return df.select(F.col(f"`{id_col}`").alias("doc"), text.alias("text")).where(text.isNotNull() & (F.length(text) >= length) & F.col("doc").isNotNull())


def match_classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 120, hot_rows: int = 20_000) -> DataFrame:
    """(h, o, m1, m2, before, doc): documents in classes of one equal window at its left boundary, linear in the text.

    Two documents of a class are a pair if ``before`` differs or is -1; every pair has such a class."""
    found = stretches(_docs(df, id_col, text_col, length), length)
    plain, hot = blocks(found, length, hot_rows)
    classes = parse(plain, length, "matches", MATCH).unionByName(hot_matches(hot, length))
    return classes.join(found.select(*CLASS, "doc"), CLASS).select("h", "o", "m1", "m2", "before", "doc").distinct()


def shared_pairs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 120, hot_rows: int = 20_000) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: pairs with an equal stretch of at least ``length`` characters.

    Classes are paired before their documents, so all that is joined is a pair."""
    members = materialize(match_classes(df, id_col=id_col, text_col=text_col, length=length, hot_rows=hot_rows), "classes")
    key = ["h", "o", "m1", "m2"]
    sides = members.select(*key, "before").distinct()
    couples = sides.withColumnRenamed("before", "left").join(sides.withColumnRenamed("before", "right"), key).where("left < right or (left = -1 and right = -1)")
    a = couples.join(members.withColumnRenamed("before", "left").withColumnRenamed("doc", "a"), [*key, "left"])
    both = a.join(members.withColumnRenamed("before", "right").withColumnRenamed("doc", "b"), [*key, "right"]).where("a <> b")
    return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


def shared_factors(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 120, hot_rows: int = 20_000) -> DataFrame:
    """(doc, start, end, factor): runs of shared windows around the index entries of every document; ``factor`` is the
    length of the greedy factor that begins at ``start``, as far as the block's stretches reach."""
    found = stretches(_docs(df, id_col, text_col, length), length)
    plain, hot = blocks(found, length, hot_rows)
    got = parse(plain, length, "factors", FACTOR).unionByName(hot_factors(hot, length))
    return got.join(found.select(*CLASS, "doc", "pos"), CLASS).select("doc", (F.col("pos") - F.col("last")).alias("start"), (F.col("pos") - F.col("first") + length).alias("end"), "factor")


def shared_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 120, hot_rows: int = 20_000) -> DataFrame:
    """(doc, start, end), merged and in order: the stretches that stand in another document."""
    raw = shared_factors(df, id_col=id_col, text_col=text_col, length=length, hot_rows=hot_rows).select("doc", "start", "end").distinct()
    w = W.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    return raw.withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
