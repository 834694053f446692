"""Top N items within every group, by statistics-guided skipping.

The rows are clustered by group into Parquet files, each sorted by descending score, so that a file's row groups hold
ever lower scores of the same set of groups. One task takes one file: it visits the row groups in descending order of the
maximum in their statistics. Of a row group it reads the group column first (by dictionary, a small part of the bytes): if every
group in it already has N items and its maximum lies strictly below the least of their N-th scores, items and scores are never read.
Else they are read, and rows below their own group's N-th score are dropped before items are compared.

Groups with more rows than a task should sort alone are cut over many files by item (an item's rows stay together), each of
which is mostly skipped after its first row groups; the at most N survivors per file and group meet in one last selection.
Which groups are that large comes from a frequent-items sketch: a group above rows / (4 x tasks) is certainly named, so
the list has at most 4 x tasks entries; the result doesn't depend on it.

What a task holds: N items for each group of its file and one row group; files have about ``FILE_ROWS`` rows at most. Groups with
hardly more than N rows leave nothing to skip: their row groups all hold an item of somebody's first N.

Defined results
---------------
* rows with a null group, null item, or null or NaN score do not count; infinities do.
* each item counts once per group, with its highest score.
* ties: items ascending by code point. Groups with fewer than N items give all they have.
* empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.session import owned_path, parallelism

ROW_GROUP_BYTES = 64 << 20
FILE_ROWS = 4_000_000


def cluster(df: DataFrame, *, group: Column, item: Column, score: Column, share: float | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> str:
    """Write (g, i, s) clustered by group; the folder's path. Files ``hot=1`` hold parts of large groups."""
    spark = df.sparkSession
    rows = df.select(group.alias("g"), item.alias("i"), score.cast("double").alias("s")).where("g is not null and i is not null and s is not null and not isnan(s)")
    tasks = parallelism(spark)
    share = share or max(1e-4, 1 / (4 * tasks))
    seen = df.count()  # from the footers
    frequent = rows.select("g").freqItems(["g"], share).first()[0] or []  # at most 1 / share entries
    width = max(tasks, -(-seen // FILE_ROWS))
    hot = F.col("g").isin(list(frequent)) if frequent else F.lit(False)
    salt = F.when(hot, F.pmod(F.xxhash64("i"), F.lit(width)).cast("int")).otherwise(-1)
    path = owned_path(spark, "clustered")
    (
        rows.withColumn("hot", hot.cast("int")).withColumn("salt", salt)
        .repartition(width, "g", "salt").sortWithinPartitions("hot", F.desc("s")).drop("salt")
        .write.option("parquet.block.size", row_group_bytes).partitionBy("hot").parquet(path)
    )
    return path


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(file, hot): as many as partitions wrote, at most two per task."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    out = []
    for hot in (0, 1):
        part = jvm.org.apache.hadoop.fs.Path(root, f"hot={hot}")
        if fs.exists(part):
            out += [(str(s.getPath().toUri().toString()), hot) for s in fs.listStatus(part) if s.getPath().getName().endswith(".parquet")]
    return out


def places(t: pa.Table) -> np.ndarray:
    """Place of each row within its run of equal groups, from 0."""
    codes = t["g"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))


def best(t: pa.Table, n: int) -> pa.Table:
    """The first n distinct items of each group, sorted by group, descending score, item."""
    t = t.group_by(["g", "i"]).aggregate([("s", "max")]).rename_columns(["g", "i", "s"]).select(["g", "i", "s"])
    t = t.take(pc.sort_indices(t, sort_keys=[("g", "ascending"), ("s", "descending"), ("i", "ascending")]))
    return t.filter(pa.array(places(t) < n))


def read_top(path: str, n: int) -> tuple[pa.Table, int, int]:
    """Top n per group of one clustered file; row groups read and skipped."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    skipped = 0
    kept = pa.table({"g": pa.array([], pa.string()), "i": pa.array([], pa.string()), "s": pa.array([], pa.float64())})
    full, floor = pa.array([], pa.string()), np.zeros(0)  # groups that have n items, and their n-th scores
    with fs.open_input_file(name) as handle:
        f = pq.ParquetFile(handle, read_dictionary=["g"])
        at = {f.schema_arrow.field(k).name: k for k in range(len(f.schema_arrow))}
        stats = [f.metadata.row_group(k).column(at["s"]).statistics for k in range(f.num_row_groups)]
        tops = [s.max if s is not None and s.has_min_max else float("inf") for s in stats]
        for k in sorted(range(len(tops)), key=lambda k: (-tops[k], k)):  # descending maximum; among equal ones the order of the file
            g = f.read_row_group(k, columns=["g"])["g"].combine_chunks()
            names = pc.cast(g.dictionary, pa.string())
            where = pc.index_in(names, full)
            least = np.full(len(names), -np.inf)
            known = ~np.asarray(pc.is_null(where))
            least[known] = floor[np.asarray(pc.fill_null(where, 0))[known]]
            codes = g.indices.to_numpy(zero_copy_only=False)
            if len(codes) and tops[k] < least[codes].min():
                skipped += 1
                continue
            rest = f.read_row_group(k, columns=["i", "s"])
            keep = rest["s"].to_numpy() >= least[codes]
            fresh = pa.table({"g": pc.cast(g, pa.string()), "i": rest["i"], "s": rest["s"]}).filter(pa.array(keep))
            if fresh.num_rows:
                kept = best(pa.concat_tables([kept, fresh]), n)
                last = kept.filter(pa.array(places(kept) == n - 1))
                full, floor = last["g"].combine_chunks(), last["s"].to_numpy()
    return kept, len(tops) - skipped, skipped


def top_n(df: DataFrame, *, group: str, item: str, score: str, n: int = 5, share: float | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """(group, item, score, place): place 1 is the highest."""
    spark = df.sparkSession
    q = lambda c: F.col(f"`{c}`")
    path = cluster(df, group=q(group).cast("string"), item=q(item).cast("string"), score=q(score), share=share, row_group_bytes=row_group_bytes)
    schema = "g string, i string, s double, place int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b["path"].to_pylist():
                t = read_top(p, n)[0]
                yield from t.append_column("place", pa.array(places(t) + 1, pa.int32())).combine_chunks().to_batches()

    def over(which: int) -> DataFrame:
        names = [(p,) for p, hot in listed if hot == which]
        if not names:
            return spark.createDataFrame([], schema)
        return spark.createDataFrame(spark.sparkContext.parallelize(names, len(names)), "path string").mapInArrow(scan, schema)  # a file a task

    listed = files(spark, path)
    w = W.partitionBy("g").orderBy(F.desc("s"), "i")
    # a small group lies in one file and is done; the parts of a large group, n items each, meet here
    large = over(1).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return over(0).unionByName(large).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "place")
