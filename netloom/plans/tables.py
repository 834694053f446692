"""The tables as the operators want them, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import reshape


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def expression(spark: SparkSession, sf: str) -> DataFrame:
    """(task, obs_id, feature, value): the latest finite value of each cell."""
    e = table(spark, sf, "expression")
    v = F.col("value")
    good = e.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return good.groupBy("task", F.trim("obs_id").alias("obs_id"), "feature").agg(F.max(F.struct("loaded_at", "row_id", "value")).alias("m")).select("task", "obs_id", "feature", F.col("m.value").alias("value"))


def confidences(spark: SparkSession, sf: str) -> DataFrame:
    """(target, regulator, combined_confidences): the greatest over all tasks."""
    n = table(spark, sf, "network_data")
    c = F.col("combined_confidences")
    return n.where(c.isNotNull() & ~F.isnan(c) & F.col("target").isNotNull() & F.col("regulator").isNotNull()).groupBy("target", "regulator").agg(F.max(c).alias("combined_confidences"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(target, regulator, weight): scored cells; of a target given twice the value of greatest size, then the greater."""
    wide = table(spark, sf, "gold_standard")
    cells = reshape.melt(wide, ["target"], [f"G{i}" for i in range(1, 21)], "regulator", "weight").where("weight is not null and target is not null")
    return cells.groupBy("target", "regulator").agg(F.max(F.struct(F.abs("weight").alias("a"), "weight")).alias("m")).select("target", "regulator", F.col("m.weight").alias("weight"))


def prior(spark: SparkSession, sf: str) -> DataFrame:
    """(target, regulator, weight): edges with a positive prior count, all tasks."""
    n = table(spark, sf, "network_data")
    return n.where("prior <> 0 and target is not null and regulator is not null").groupBy("target", "regulator").agg(F.max("prior").cast("double").alias("weight"))


def known(spark: SparkSession, sf: str) -> DataFrame:
    """(target, regulator, weight): every edge of the networks with its prior, 0 or 1, as a gold standard."""
    n = table(spark, sf, "network_data")
    return n.where("prior is not null and target is not null and regulator is not null").groupBy("target", "regulator").agg(F.max("prior").cast("double").alias("weight"))


def stack(spark: SparkSession, sf: str) -> DataFrame:
    """(task, bootstrap, target, regulator, beta, share): the coefficient stacks; missing coefficients are 0, repeats count by the latest."""
    r = table(spark, sf, "results_processor")
    fin = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).otherwise(0.0)
    keys = ["task", "bootstrap", "target", "regulator"]
    return r.where("target is not null and regulator is not null").groupBy(*keys).agg(F.max(F.struct("loaded_at", "row_id", fin("betas").alias("beta"), fin("rescaled_betas").alias("share"))).alias("m")).select(*keys, F.col("m.beta").alias("beta"), F.col("m.share").alias("share"))


def sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The current row of every named condition."""
    m = table(spark, sf, "meta_data").withColumn("condName", F.trim("condName")).where("condName is not null and condName <> ''")
    cols = ["isTs", "is1stLast", "prevCol", "del.t"]
    top = m.groupBy("task", "condName").agg(F.max(F.struct("loaded_at", "row_id", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])).alias("m"))
    return top.select("task", "condName", *[F.col(f"m.c{i}").alias(c) for i, c in enumerate(cols)])


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(obs_id, feature, value): embeddings as a dense matrix; features d00..d63."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("obs_id"), F.posexplode("embedding").alias("dim", "v"))
    return e.select("obs_id", F.format_string("d%02d", "dim").alias("feature"), F.col("v").cast("double").alias("value"))


SQL = {
    "e": "e AS (SELECT task, trim(obs_id, ' ') AS obs_id, feature, value FROM expression WHERE isfinite(value) QUALIFY row_number() OVER (PARTITION BY task, trim(obs_id, ' '), feature ORDER BY loaded_at DESC, row_id DESC) = 1)",
    "c": "c AS (SELECT target, regulator, max(combined_confidences) AS combined_confidences FROM network_data WHERE combined_confidences IS NOT NULL AND NOT isnan(combined_confidences) AND target IS NOT NULL AND regulator IS NOT NULL GROUP BY ALL)",
    "g": "g AS (SELECT target, regulator, weight FROM (SELECT target, regulator, CAST(w AS DOUBLE) AS weight FROM (UNPIVOT gold_standard ON COLUMNS(* EXCLUDE target) INTO NAME regulator VALUE w)) WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target, regulator ORDER BY abs(weight) DESC, weight DESC) = 1)",
    "k": "k AS (SELECT target, regulator, CAST(max(prior) AS DOUBLE) AS weight FROM network_data WHERE prior IS NOT NULL AND target IS NOT NULL AND regulator IS NOT NULL GROUP BY ALL)",
    "p": "p AS (SELECT target, regulator, CAST(max(prior) AS DOUBLE) AS weight FROM network_data WHERE prior <> 0 AND target IS NOT NULL AND regulator IS NOT NULL GROUP BY ALL)",
    "s": "s AS (SELECT task, bootstrap, target, regulator, CASE WHEN isfinite(betas) THEN betas ELSE 0 END AS beta, CASE WHEN isfinite(rescaled_betas) THEN rescaled_betas ELSE 0 END AS share FROM results_processor WHERE target IS NOT NULL AND regulator IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, bootstrap, target, regulator ORDER BY loaded_at DESC, row_id DESC) = 1)",
    "m": """m AS (SELECT task, trim(condName, ' ') AS "condName", "isTs", "is1stLast", "prevCol", "del.t" FROM meta_data WHERE condName IS NOT NULL AND trim(condName, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY task, trim(condName, ' ') ORDER BY loaded_at DESC, row_id DESC) = 1)""",
    "v": "v AS (SELECT vec_id AS obs_id, printf('d%02d', dim - 1) AS feature, CAST(embedding[dim] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings))",
}


def sql(names: str, rest: str) -> str:
    """The named common tables before a query."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + rest
