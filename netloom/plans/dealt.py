"""Queries of the general data-preparation problems (lines, hierarchies, orphans) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import hierarchy, lineparse, orphans
from netloom.session import materialize

LAYOUTS = {"meta_data": lineparse.SAMPLE_SHEET, "gold_standard": lineparse.GOLD_STANDARD}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    body = table(spark, sf, "raw_lines").where("line_no > 1").select("raw_id", "source", "file_name", "line_no", "line")
    return lineparse.parse_lines(body, LAYOUTS, keep=["raw_id", "file_name", "line_no"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose cheapest parse costs something, or that have none."""
    return lineparse.rejected(_parsed(spark, sf)).select("raw_id")


def p1_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected lines with the edit operations that would mend them."""
    return lineparse.rejected(_parsed(spark, sf)).select("raw_id", "file_name", "line_no", F.col("parse_cost").alias("cost"), F.col("parse_reason").alias("reason"))


def p1_sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    return lineparse.loaded(_parsed(spark, sf), "meta_data", LAYOUTS["meta_data"], ["raw_id"])


def p1_gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    return lineparse.loaded(_parsed(spark, sf), "gold_standard", LAYOUTS["gold_standard"], ["raw_id"])


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "meta_data").select("row_id", "task", "condName", "prevCol", "`del.t`", "loaded_at")
    series = F.regexp_extract("node", r"_([0-9]+)[^_]*$", 1)  # samples of a series share its number
    return hierarchy.resolve(meta, scope="task", node="condName", parent="prevCol", weight="del.t", order=["loaded_at", "row_id"], locality=series)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    r = _resolved(spark, sf).where("parent is not null")
    return r.select(F.col("scope").alias("task"), F.col("node").alias("cond_name"), F.when(F.col("in_cycle"), "(cycle)").otherwise(F.col("root")).alias("root_name"))


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Path from the first sample, depth, elapsed time, root, and whether the chain is circular."""
    return _resolved(spark, sf).select(F.col("scope").alias("task"), F.col("node").alias("cond_name"), F.array_join("path", ">").alias("path"), F.col("depth").cast("long").alias("depth"), F.round(F.when(~F.col("in_cycle"), F.col("total")), 4).alias("elapsed"), F.col("root").alias("root_name"), "in_cycle")


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All later samples of every condition; in and below circles each pair of different conditions once, by the fewest steps."""
    resolved = _resolved(spark, sf)
    return hierarchy.descendants(resolved).unionByName(hierarchy.circle_descendants(resolved)).select(F.col("scope").alias("task"), F.col("node").alias("cond_name"), F.col("descendant").alias("later_name"), F.col("steps").cast("long").alias("steps"))


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    meta, expr = table(spark, sf, "meta_data"), table(spark, sf, "expression")
    prev = F.trim("prevCol")
    refs = (
        meta.where(prev.isNotNull() & ~prev.isin("", "NA")).select(F.lit("meta_data").alias("ref_table"), "task", prev.alias("missing_key"), "loaded_at")
        .unionByName(expr.select(F.lit("expression").alias("ref_table"), "task", F.trim("obs_id").alias("missing_key"), "loaded_at"))
        .withColumn("period", F.date_format("loaded_at", "yyyy-MM"))
    )
    parents = meta.select("task", F.trim("condName").alias("missing_key"), "loaded_at", "deleted_at")
    return refs, parents


def _lives(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """References and parents with times as microseconds; a parent lives from its loading to the microsecond before its deletion."""
    refs, parents = _references(spark, sf)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return refs.select("ref_table", "period", "task", "missing_key", micros("loaded_at").alias("at")), parents.where("missing_key is not null").select("task", "missing_key", micros("loaded_at").alias("first"), (micros("deleted_at") - 1).alias("last"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Dense integer keys of all names; those beyond a run of parents are missing, the others are tested against lifetimes."""
    refs, parents = _lives(spark, sf)
    return orphans.named_orphans(refs, parents, group=["task"], key="missing_key", at="at", first="first", last="last", out=["ref_table", "period", "task", "missing_key"])


def p4_runs(spark: SparkSession, sf: str) -> DataFrame:
    """How far the dense parent keys compress: names, parents and runs."""
    refs, parents = _lives(spark, sf)
    keys = materialize(orphans.named_keys(refs.where("missing_key is not null"), parents, ["task"], "missing_key"), "keys")
    return keys.agg(F.count(F.lit(1)).alias("names"), F.sum("is_parent").alias("parents")).crossJoin(orphans.key_runs(keys).agg(F.count(F.lit(1)).alias("runs")))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Missing keys per table and month."""
    return p4_found(spark, sf).groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("missing_keys"), F.countDistinct("task").alias("tasks"))


def p4_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The same on plain integer ids: orders without a customer of the nation keys 0 to 20."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    refs = orders.select(F.lit("orders").alias("ref_table"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_custkey").alias("missing_key"), F.shiftright("o_custkey", 16).alias("block"))
    parents = customer.where("c_nationkey <= 20").select(F.col("c_custkey").alias("key"), F.shiftright("c_custkey", 16).alias("block"))
    return orphans.orphans(refs, parents, group=["block"], ref_key=F.col("missing_key"), first=F.col("key"), out=["ref_table", "period", "missing_key"])


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_sheet_rows, p1_gold_rows, p2_found, p2_paths, p2_descendants, p4_found, p4_report, p4_runs, p4_orders)}

_FIELDS = r"""
WITH body AS (
  SELECT raw_id, source, CASE WHEN line LIKE '%' || chr(13) THEN left(line, length(line) - 1) ELSE line END AS line
  FROM raw_lines WHERE line_no > 1
), shaped AS (
  SELECT *, line IS NOT NULL AND regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS sound,
    regexp_extract_all(chr(9) || line, '\t("(?:[^"]|"")*"|[^"\t]*)', 1) AS raw
  FROM body
), fields AS (
  SELECT raw_id, source, sound, len(raw) AS n,
    list_transform(raw, lambda x: trim(CASE WHEN x[1] = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, ' ')) AS f
  FROM shaped
), judged AS (
  SELECT *, CASE
    WHEN sound AND source = 'meta_data' AND n = 5 THEN
      upper(f[1]) IN ('TRUE', 'FALSE') AND f[2] IN ('e', 'f', 'm', 'l') AND f[5] NOT IN ('', 'NA')
      AND (f[4] = 'NA' OR (regexp_full_match(f[4], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
        AND coalesce(isfinite(try_cast(f[4] AS DOUBLE)) AND try_cast(f[4] AS DOUBLE) >= 0, false)))
    WHEN sound AND source = 'gold_standard' AND n = 21 THEN
      f[1] NOT IN ('', 'NA') AND len(list_filter(f[2:21], lambda x: NOT (x = 'NA' OR (regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
        AND coalesce(try_cast(x AS DOUBLE) IN (-1, 0, 1), false))))) = 0
    ELSE false END AS ok
  FROM fields
)
"""

_TREE = """
WITH RECURSIVE nodes AS (
  SELECT task, trim(condName, ' ') AS node, trim(prevCol, ' ') AS up, "del.t" AS w
  FROM meta_data WHERE condName IS NOT NULL AND trim(condName, ' ') <> ''
  QUALIFY row_number() OVER (PARTITION BY task, trim(condName, ' ') ORDER BY loaded_at DESC, row_id DESC) = 1
), linked AS (
  SELECT n.task, n.node, p.node AS parent, CASE WHEN n.w IS NULL OR isnan(n.w) THEN 0 ELSE n.w END AS w
  FROM nodes n LEFT JOIN nodes p ON p.task = n.task AND p.node = n.up AND n.up NOT IN ('', 'NA')
), tree AS (
  SELECT task, node, node AS root, CAST(0 AS BIGINT) AS depth, CAST(0 AS DOUBLE) AS total, node AS path, [node] AS steps FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT l.task, l.node, t.root, t.depth + 1, t.total + l.w, t.path || '>' || l.node, list_append(t.steps, l.node)
  FROM tree t JOIN linked l ON l.task = t.task AND l.parent = t.node
)
"""

_ORPHANS = """
WITH refs AS (
  SELECT 'meta_data' AS ref_table, task, trim(prevCol, ' ') AS missing_key, loaded_at FROM meta_data
  WHERE prevCol IS NOT NULL AND trim(prevCol, ' ') NOT IN ('', 'NA')
  UNION ALL SELECT 'expression', task, trim(obs_id, ' '), loaded_at FROM expression
), found AS (
  SELECT DISTINCT ref_table, strftime(loaded_at, '%Y-%m') AS period, task, missing_key FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM meta_data m WHERE m.task = r.task AND trim(m.condName, ' ') = r.missing_key
    AND m.loaded_at <= r.loaded_at AND (m.deleted_at IS NULL OR m.deleted_at > r.loaded_at))
)
"""

ORACLE = {
    "p1_found": _FIELDS + "SELECT raw_id FROM judged WHERE NOT ok",
    "p1_sheet_rows": _FIELDS + """SELECT raw_id, upper(f[1]) = 'TRUE' AS "isTs", f[2] AS "is1stLast", nullif(nullif(f[3], 'NA'), '') AS "prevCol",
      try_cast(nullif(f[4], 'NA') AS DOUBLE) AS "del.t", f[5] AS "condName" FROM judged WHERE ok AND source = 'meta_data'""",
    "p1_gold_rows": _FIELDS + "SELECT raw_id, f[1] AS target, " + ", ".join(f'CAST(try_cast(nullif(f[{i + 1}], \'NA\') AS DOUBLE) AS INTEGER) AS "G{i}"' for i in range(1, 21)) + " FROM judged WHERE ok AND source = 'gold_standard'",
    "p2_found": _TREE + "SELECT l.task, l.node AS cond_name, coalesce(t.root, '(cycle)') AS root_name FROM linked l LEFT JOIN tree t ON t.task = l.task AND t.node = l.node WHERE l.parent IS NOT NULL",
    "p2_paths": _TREE + "SELECT l.task, l.node AS cond_name, t.path, t.depth, round(t.total, 4) AS elapsed, t.root AS root_name, t.root IS NULL AS in_cycle FROM linked l LEFT JOIN tree t ON t.task = l.task AND t.node = l.node",
    "p2_descendants": _TREE.rsplit(", tree AS", 1)[0] + """, up AS (
        SELECT task, node, parent AS above, CAST(1 AS BIGINT) AS steps, [node, parent] AS met FROM linked WHERE parent IS NOT NULL AND parent <> node
        UNION ALL SELECT u.task, u.node, l.parent, u.steps + 1, list_append(u.met, l.parent) FROM up u JOIN linked l ON l.task = u.task AND l.node = u.above
        WHERE l.parent IS NOT NULL AND NOT list_contains(u.met, l.parent)
      ) SELECT task, above AS cond_name, node AS later_name, steps FROM up""",
    "p4_found": _ORPHANS + "SELECT * FROM found",
    "p4_report": _ORPHANS + "SELECT ref_table, period, count(*) AS missing_keys, count(DISTINCT task) AS tasks FROM found GROUP BY ALL",
    "p4_runs": """WITH k AS (SELECT task, name, max(p) AS p FROM (
        SELECT task, trim(prevCol, ' ') AS name, 0 AS p FROM meta_data WHERE prevCol IS NOT NULL AND trim(prevCol, ' ') NOT IN ('', 'NA')
        UNION ALL SELECT task, trim(obs_id, ' '), 0 FROM expression WHERE obs_id IS NOT NULL
        UNION ALL SELECT task, trim(condName, ' '), 1 FROM meta_data WHERE condName IS NOT NULL) GROUP BY ALL
      ), n AS (SELECT *, row_number() OVER (ORDER BY task NULLS FIRST, name) AS id FROM k),
      r AS (SELECT id // 65536 AS b, id - row_number() OVER (PARTITION BY id // 65536 ORDER BY id) AS run FROM n WHERE p = 1)
      SELECT (SELECT count(*) FROM n) AS names, (SELECT sum(p)::BIGINT FROM n) AS parents, (SELECT count(*) FROM (SELECT DISTINCT b, run FROM r)) AS runs""",
    "p4_orders": """SELECT DISTINCT 'orders' AS ref_table, strftime(o_orderdate, '%Y-%m') AS period, o_custkey AS missing_key FROM orders
      WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey <= 20)""",
}
