"""Queries of the language-model problems and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import encode, mixing, ranks, spans, topn
from netloom.session import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary() -> str:
    return os.path.join(encode.vocabulary_dir(), "byte_bpe_50k.tiktoken")


def p3_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """One ranking of all edges. An edge's scores are the discrete medians over its rows of |betas| and of rescaled_betas."""
    rows = table(spark, sf, "results_processor").select("task", "target", "regulator", F.abs(ranks.finite(F.col("betas"))).alias("b"), ranks.finite(F.col("rescaled_betas")).alias("r"))
    edges = rows.groupBy("task", "target", "regulator").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY b)").alias("beta_score"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY r)").alias("rescaled_score"))
    edges = materialize(edges, "edges")
    ranked = ranks.borda(edges, scope="task", scores={"beta_score": 1.0, "rescaled_score": 1.0})
    order = [F.desc("borda"), F.asc_nulls_last("task"), F.asc_nulls_last("target"), F.asc_nulls_last("regulator")]
    return ranks.numbered(ranked.select("task", "target", "regulator", "borda"), order).select("task", "target", "regulator", F.round("borda", 9).alias("borda"), F.col("position").cast("long").alias("position"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n(table(spark, sf, "network_data"), group="target", item="regulator", score="combined_confidences", n=5).select("target", "regulator")


def p5_top(spark: SparkSession, sf: str) -> DataFrame:
    """The same with score and place."""
    return topn.top_n(table(spark, sf, "network_data"), group="target", item="regulator", score="combined_confidences", n=5)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf, "documents"), keep=["doc_id"], path=vocabulary())


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: number of ids, and whether they decode to the text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = vocabulary()
    back = encode.decode_texts(encode.encode_texts(docs, keep=["doc_id", "text"], path=path), keep=["doc_id", "text", "ids"], path=path, out="back")
    return back.select("doc_id", F.size("ids").alias("n_ids"), F.coalesce(F.col("back") == F.coalesce("text", F.lit("")), F.lit(False)).alias("same"))


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labelled = docs.select("doc_id", "source", "lang", mixing.change_type(F.col("text")).alias("topic"), "text")
    return materialize(encode.encode_texts(labelled, keep=["doc_id", "source", "lang", "topic"], path=vocabulary(), out="n_tokens", counts_only=True), "counted")


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The selection: chosen records and how often each is used."""
    return mixing.select(_counted(spark, sf), table(spark, sf, "mix_targets"), max_sources=None)


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached, by source."""
    counted, targets = _counted(spark, sf), table(spark, sf, "mix_targets")
    return mixing.report(mixing.select(counted, targets, max_sources=None), counted, targets)


def p7_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every source, language and topic: what the mix aims at, what the fit gives and what the selection reaches."""
    counted, targets = _counted(spark, sf), table(spark, sf, "mix_targets")
    planned = mixing.plan(counted, targets, max_sources=None)
    return mixing.margins(mixing.select(counted, targets, planned=planned), planned)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf, "documents"))


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The shared stretches of every document: start (from 0) and length in characters."""
    s = spans.shared_spans(table(spark, sf, "documents"))
    return s.select(F.col("doc").alias("doc_id"), "start", (F.col("end") - F.col("start")).alias("length"))


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs before they are expanded: documents by class of one equal window at its left boundary, with the character before it."""
    return spans.match_classes(table(spark, sf, "documents")).select(F.xxhash64("h", "o", "m1", "m2").alias("class_id"), "before", F.col("doc").alias("doc_id"))


def p8_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document: shared stretches, characters they cover, and their part of the text."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    got = p8_spans(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("stretches"), F.sum("length").alias("shared_chars"))
    return docs.join(got, "doc_id", "left").select("doc_id", "chars", F.coalesce("stretches", F.lit(0)).alias("stretches"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.round(F.coalesce(F.try_divide("shared_chars", "chars"), F.lit(0.0)), 6).alias("shared_part"))


QUERIES = {f.__name__: f for f in (p3_ranking, p5_found, p5_top, p6_ids, p6_round_trip, p7_mix, p7_report, p7_margins, p8_found, p8_classes, p8_spans, p8_coverage)}

_BEST = """
WITH pairs AS (
  SELECT target, regulator, max(combined_confidences) AS combined_confidences FROM network_data
  WHERE target IS NOT NULL AND regulator IS NOT NULL AND combined_confidences IS NOT NULL AND NOT isnan(combined_confidences) GROUP BY ALL
), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY combined_confidences DESC, regulator) AS INTEGER) AS place FROM pairs)
"""

_WINDOWS = """
WITH w AS (SELECT doc_id, i, substr(text, i, 120) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 118)) AS i FROM documents WHERE length(text) >= 120)),
shared AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1), hits AS (SELECT DISTINCT doc_id, i, s FROM w SEMI JOIN shared USING (s)),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 120 THEN 0 ELSE 1 END AS fresh FROM hits),
spans AS (SELECT doc_id, min(i) - 1 AS "start", max(i) + 120 - min(i) AS length FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run)
"""

ORACLE = {
    "p8_found": _WINDOWS + "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM hits a JOIN hits b ON a.s = b.s AND a.doc_id < b.doc_id",
    "p8_spans": _WINDOWS + """SELECT doc_id, CAST("start" AS BIGINT) AS "start", CAST(length AS BIGINT) AS length FROM spans""",
    "p8_coverage": _WINDOWS + """, c AS (SELECT doc_id, count(*) AS stretches, CAST(sum(length) AS BIGINT) AS shared_chars FROM spans GROUP BY doc_id)
      SELECT d.doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS chars, coalesce(stretches, 0) AS stretches, coalesce(shared_chars, 0) AS shared_chars,
        round(coalesce(shared_chars / nullif(length(text), 0)::DOUBLE, 0), 6) AS shared_part FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""",
    "p3_ranking": """
WITH rows AS (
  SELECT task, target, regulator, CASE WHEN isfinite(betas) THEN abs(betas) END AS b, CASE WHEN isfinite(rescaled_betas) THEN rescaled_betas END AS r FROM results_processor
), edges AS (
  SELECT task, target, regulator, quantile_disc(b, 0.5) AS b, quantile_disc(r, 0.5) AS r FROM rows GROUP BY ALL
), counted AS (
  SELECT *, rank() OVER (PARTITION BY task, b IS NULL ORDER BY b) - 1 AS bl, count(*) OVER (PARTITION BY task, b) AS bt, count(b) OVER (PARTITION BY task) AS bm,
    rank() OVER (PARTITION BY task, r IS NULL ORDER BY r) - 1 AS rl, count(*) OVER (PARTITION BY task, r) AS rt, count(r) OVER (PARTITION BY task) AS rm FROM edges
), scored AS (
  SELECT task, target, regulator, round(CASE WHEN b IS NULL OR bm < 2 THEN 0.5 ELSE (bl + (bt - 1) / 2.0::DOUBLE) / (bm - 1) END + CASE WHEN r IS NULL OR rm < 2 THEN 0.5 ELSE (rl + (rt - 1) / 2.0::DOUBLE) / (rm - 1) END, 12) AS borda FROM counted
)
SELECT task, target, regulator, round(borda, 9) AS borda, row_number() OVER (ORDER BY borda DESC, task NULLS LAST, target NULLS LAST, regulator NULLS LAST) AS position FROM scored""",
    "p5_found": _BEST + "SELECT target, regulator FROM placed WHERE place <= 5",
    "p5_top": _BEST + "SELECT * FROM placed WHERE place <= 5",
}
