"""Session configuration and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "netloom", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local tests) a temporary folder is made, set as checkpoint
    folder and removed when the driver ends.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = sc.applicationId
    if app not in _OWN_DIRS:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="netloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN_DIRS[app] = f"file://{own}"
        sc.setCheckpointDir(_OWN_DIRS[app])
    return _OWN_DIRS[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/netloom-{name}-{uuid.uuid4().hex}"


_MADE: dict[str, tuple[SparkSession, list[str]]] = {}


def owned_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when ``release`` is called or the driver ends."""
    path = shared_path(spark, name)
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = (spark, [])
        atexit.register(release, spark)
    _MADE[app][1].append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; results that were not yet read from them are lost."""
    app = next((a for a, (s, _) in _MADE.items() if s is spark), None)
    if app is None:
        return
    paths = _MADE[app][1]
    try:
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        paths.clear()
    except Exception:  # the JVM may be gone by then: the folder is left to the cluster
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: the result survives the loss of any executor, and is stored by column
    and compressed. The folder is removed by ``release``, and when the driver ends.
    """
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same with its path, for ``discard``."""
    spark = df.sparkSession
    path = owned_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _MADE[spark.sparkContext.applicationId][1].remove(path)


def parallelism(spark: SparkSession) -> int:
    """Tasks of a shuffle that should use the whole cluster."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
