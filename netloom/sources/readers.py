"""Sources: delimited matrices, coordinate matrices, HDF5-based files, sheets, lists and networks, all as long tables.

HDF5-based files (plain, annotated and 10x) are read where the optional package h5py is installed; without it they raise."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators import reshape


def join_path(folder: str | None, name: str | None) -> str:
    """Absolute names and URIs pass; ~ is expanded; no name raises."""
    if name is None:
        raise ValueError("no file name")
    name = os.path.expanduser(name)
    if "://" in name or os.path.isabs(name) or folder is None:
        return name
    return f"{os.path.expanduser(folder).rstrip('/')}/{name}"


def read_table(spark: SparkSession, path: str | None, **options) -> DataFrame | None:
    """A tab-separated file with a header (both can be overridden); compressed files by suffix; None stays None."""
    if path is None:
        return None
    return spark.read.options(**({"sep": "\t", "header": "true", "quote": '"'} | options)).csv(path)


def read_matrix(spark: SparkSession, path: str, *, features_are_rows: bool = False, sheet_columns: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """A wide file to (matrix, sheet): columns named in ``sheet_columns`` become the samples' sheet."""
    wide = read_table(spark, path, **options)
    key = wide.columns[0]
    sheet = wide.select(F.col(f"`{key}`").alias("obs_id"), *[F.col(f"`{c}`") for c in sheet_columns or []])
    cells = reshape.melt(wide.drop(*(sheet_columns or [])), [key], name="_c").withColumnRenamed(key, "_k")
    obs, feature = ("_c", "_k") if features_are_rows else ("_k", "_c")
    return cells.select(F.col(obs).alias("obs_id"), F.col(feature).alias("feature"), "value"), sheet


def _placed(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(place, column): the lines of a label file numbered in the order of the file, from 1.

    Lines are numbered within each part and the parts' line counts are added in front: no task sees the whole file."""
    rows = spark.read.text(path).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    before = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_p"), (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a part
    within = F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33)  # the row's number in its part
    return rows.join(F.broadcast(before), F.col("_part") == F.col("_p")).select((F.col("_before") + within + 1).alias("place"), F.col("value").alias(column))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, label) of a file with one label per line, in its order; more than one column raises."""
    rows = _placed(spark, path, "value").where(F.trim("value") != "")
    if not rows.where(F.col("value").contains("\t")).isEmpty():
        raise ValueError(f"{path}: more than one column")
    return rows.select("place", F.trim("value").alias("label"))


def read_coordinates(spark: SparkSession, matrix: str, obs: str, features: str, *, features_are_rows: bool = True) -> DataFrame:
    """A coordinate matrix with its two label lists; comments start with % and the first other line holds the sizes."""
    lines = spark.read.text(matrix).where(~F.col("value").startswith("%"))
    size = lines.first()[0]
    parts = F.split(F.trim("value"), r"\s+")
    cells = lines.where(F.col("value") != size).select(parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), F.coalesce(parts[2].cast("double"), F.lit(1.0)).alias("value"))
    repeated = lines.where(F.col("value") == size).select(parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), parts[2].cast("double").alias("value"), F.monotonically_increasing_id().alias("_n"))
    again = repeated.orderBy("_n").offset(1).drop("_n")  # a cell may read like the size line
    row, column = (features, obs) if features_are_rows else (obs, features)
    label = lambda p: _placed(spark, p, "_l").select("place", F.split("_l", "\t")[0].alias("label"))
    r, c = label(row).toDF("i", "_row"), label(column).toDF("j", "_col")
    names = ("_row", "_col") if features_are_rows else ("_col", "_row")
    return cells.unionByName(again).join(r, "i").join(c, "j").select(F.col(names[1]).alias("obs_id"), F.col(names[0]).alias("feature"), "value")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, on any file system the cluster knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_cell_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder, local or remote, with matrix.mtx, barcodes.tsv and features.tsv or genes.tsv, each also as .gz; the plain file wins."""
    def find(*names: str) -> str:
        for n in names:
            for candidate in (n, n + ".gz"):
                if exists(spark, f"{folder.rstrip('/')}/{candidate}"):
                    return f"{folder.rstrip('/')}/{candidate}"
        raise FileNotFoundError(f"{folder}: none of {names}")

    return read_coordinates(spark, find("matrix.mtx"), find("barcodes.tsv"), find("genes.tsv", "features.tsv"))


def _hdf5():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("HDF5-based files need the optional package h5py") from e
    return h5py


HDF5_ROWS = 4096  # rows of a matrix one task reads


def _text(values) -> list[str]:
    return [v.decode() if isinstance(v, bytes) else str(v) for v in values]


def _read_blocks(spark: SparkSession, rows: int, block) -> DataFrame:
    """Cells of a row-wise stored matrix, ``HDF5_ROWS`` rows a task; ``block(start, stop)`` gives row names, column names and values."""
    def run(batches):
        for b in batches:
            for start in b["start"]:
                obs, features, values = block(int(start), min(int(start) + HDF5_ROWS, rows))
                yield pd.DataFrame({"obs_id": obs, "feature": features, "value": values})

    starts = [(i,) for i in range(0, rows, HDF5_ROWS)]
    empty = "obs_id string, feature string, value double"
    return spark.createDataFrame(spark.sparkContext.parallelize(starts, len(starts)), "start long").mapInPandas(run, empty) if starts else spark.createDataFrame([], empty)


def _sparse_rows(path: str, group: str, obs: list[str], features: list[str]):
    """Cells of a compressed-row matrix stored as data, indices and indptr."""
    def block(start: int, stop: int):
        with _hdf5().File(path, "r") as f:
            g = f[group]
            ptr = np.asarray(g["indptr"][start : stop + 1], np.int64)
            value, at = np.asarray(g["data"][ptr[0] : ptr[-1]], float), np.asarray(g["indices"][ptr[0] : ptr[-1]])
        row = np.repeat(np.arange(start, stop), np.diff(ptr))
        return np.array(obs, dtype=object)[row], np.array(features, dtype=object)[at], value

    return block


def _dense_rows(path: str, name: str, obs: list[str], features: list[str]):
    def block(start: int, stop: int):
        with _hdf5().File(path, "r") as f:
            m = np.asarray(f[name][start:stop], float)
        return np.repeat(np.array(obs[start:stop], dtype=object), m.shape[1]), np.tile(np.array(features, dtype=object), len(m)), m.ravel()

    return block


def read_annotated(spark: SparkSession, path: str, layer: str = "X") -> DataFrame:
    """An annotated matrix file (h5ad): observations by features, dense or compressed by row. ``path`` must be one that executors can open."""
    with _hdf5().File(path, "r") as f:
        index = lambda g: _text(g[g.attrs.get("_index", "_index")][:])
        obs, features = index(f["obs"]), index(f["var"])
        sparse = hasattr(f[layer], "keys")
        if sparse and "csc" in str(f[layer].attrs.get("encoding-type", "csr_matrix")):
            obs, features = features, obs
            return _read_blocks(spark, len(obs), _sparse_rows(path, layer, obs, features)).select(F.col("feature").alias("obs_id"), F.col("obs_id").alias("feature"), "value")
    return _read_blocks(spark, len(obs), (_sparse_rows if sparse else _dense_rows)(path, layer, obs, features))


def read_cells_hdf5(spark: SparkSession, path: str, group: str = "matrix") -> DataFrame:
    """A 10x file: cells by features, stored as one compressed row a cell."""
    with _hdf5().File(path, "r") as f:
        g = f[group]
        obs = _text(g["barcodes"][:])
        features = _text((g["features"]["id"] if "features" in g else g["genes"])[:])
    return _read_blocks(spark, len(obs), _sparse_rows(path, group, obs, features))


def read_hdf5(spark: SparkSession, path: str, key: str = "df", *, features_are_rows: bool = False) -> DataFrame:
    """A fixed-format table of one numeric block (axis0: columns, axis1: rows)."""
    with _hdf5().File(path, "r") as f:
        g = f[key]
        columns, rows = _text(g["axis0"][:]), _text(g["axis1"][:])
    out = _read_blocks(spark, len(rows), _dense_rows(path, f"{key}/block0_values", rows, columns))
    return out.select(F.col("feature").alias("obs_id"), F.col("obs_id").alias("feature"), "value") if features_are_rows else out


def read_layer(spark: SparkSession, kind: str, path: str, expression: DataFrame | None = None, **kw) -> DataFrame:
    """A further matrix (velocity, decay per cell, activity) in any format; features and samples must be among the expression's."""
    m = read_expression(spark, kind, path, **kw)
    if expression is not None and m.join(expression.select("obs_id", "feature"), ["obs_id", "feature"], "left_semi").isEmpty():
        raise ValueError(f"{path} shares no cell with the expression")
    return m


def read_decay(spark: SparkSession, path: str, expression: DataFrame | None = None, **kw) -> tuple[str, DataFrame]:
    """Decay constants and what they go by: (``per_feature``, table) for a file of one column, else (``per_cell``, table).

    A file of one column may lie either way (one row a feature, or one row in all)."""
    m, _ = read_matrix(spark, path, **kw)
    wide = m.select("feature").distinct().limit(2).count()
    high = m.select("obs_id").distinct().limit(2).count()
    value = F.col("value").cast("double").alias("decay")
    if wide == 1:
        return "per_feature", m.select(F.col("obs_id").alias("feature"), value)
    if high == 1:
        return "per_feature", m.select("feature", value)
    return "per_cell", m.select("obs_id", "feature", value)


def read_activity(spark: SparkSession, path: str, kind: str = "tsv", **kw) -> DataFrame:
    """Activities computed before: (obs_id, regulator, value), to be given as ``Data.activity``."""
    return read_expression(spark, kind, path, **kw).withColumnRenamed("feature", "regulator")


def read_network(spark: SparkSession, path: str, **options) -> DataFrame:
    """A targets-by-regulators file as (target, regulator, weight); a header one name short has no name for its first column."""
    sep = options.get("sep", "\t")
    lines = [x[0].split(sep) for x in spark.read.text(path).take(2)]  # the header and a row
    width = max(map(len, lines))
    columns = [f"c{i}" for i in range(width)]
    raw = spark.read.options(**({"sep": sep, "header": "false"} | options)).schema(", ".join(f"{c} string" for c in columns)).csv(path)
    head = [v.strip('"') for v in lines[0]]
    names = head if len(head) < width else head[1:]
    is_head = F.lit(True)
    for c, v in zip(columns, head):
        is_head = is_head & F.coalesce(F.col(c), F.lit("")).eqNullSafe(F.lit(v))
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: a regulator is named twice")
    wide = raw.where(~is_head).select(F.col("c0").alias("target"), *[F.col(f"c{i + 1}").alias(n) for i, n in enumerate(names)])
    return reshape.melt(wide, ["target"], names, "regulator", "weight")


def read_sheet(spark: SparkSession, path: str | None, obs: DataFrame | None = None) -> DataFrame:
    """A sample sheet, or one without links for the given samples."""
    from netloom.operators.timeseries import default_sheet

    if path is None:
        return default_sheet(obs)
    sheet = read_table(spark, path, nullValue="NA")
    kinds = {"isTs": "boolean", "del.t": "double", "time": "double"}
    return sheet.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in sheet.columns])


def read_feature_sheet(spark: SparkSession, path: str | None, key: str | None) -> DataFrame | None:
    """Feature attributes keyed ``feature``; both or neither argument; an absent key column raises."""
    if (path is None) != (key is None):
        raise ValueError("give both the file and its key column, or neither")
    if path is None:
        return None
    sheet = read_table(spark, path)
    if key not in sheet.columns:
        raise ValueError(f"{path} has no column {key}")
    return sheet.withColumnRenamed(key, "feature")


READERS: dict[str, Callable[..., DataFrame]] = {
    "tsv": lambda spark, path, **kw: read_matrix(spark, path, **kw)[0], "parquet": lambda spark, path, **kw: spark.read.parquet(path),
    "mtx": read_coordinates, "tenx": read_cell_folder, "h5ad": read_annotated, "tenx_h5": read_cells_hdf5, "hdf5": read_hdf5,
}


def read_expression(spark: SparkSession, kind: str, path: str, **kw) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}; known: {sorted(READERS)}")
    return READERS[kind](spark, path, **kw)
