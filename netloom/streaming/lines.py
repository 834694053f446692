"""The line parse over a stream: rows go to tables as they arrive, rejects are counted by event time.

The parse keeps no state. State is kept only by the counts (one row per window, layout and reason kind until the watermark
passes) and, where asked for, by the removal of lines delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.operators.lineparse import Layout, parse_lines, rejected


def parse_stream(lines: DataFrame, layouts: dict[str, Layout], keep: list[str], *, time: str | None = None, late: str = "1 day", once: list[str] | None = None) -> DataFrame:
    """``parse_lines`` of a stream. With ``time`` and ``once`` a line with equal ``once`` columns counts once within ``late``."""
    if not lines.isStreaming:
        raise ValueError("not a stream")
    if once is not None:
        if time is None:
            raise ValueError("lines delivered again are told by their time: give its column")
        lines = lines.withWatermark(time, late).dropDuplicatesWithinWatermark(once)
    return parse_lines(lines, layouts, keep=keep)


def reject_counts(parsed: DataFrame, time: str, *, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, parse_layout, kind, lines): rejected lines by window of event time and by their first edit operation or fault.

    A window is final when the watermark, ``late`` behind the newest time, has passed it."""
    kind = F.regexp_extract("parse_reason", r"^(insert \w+|delete \w+|invalid|blank line|unknown layout)", 1)
    late_rows = rejected(parsed).withWatermark(time, late)
    return late_rows.groupBy(F.window(time, window).alias("w"), "parse_layout", kind.alias("kind")).agg(F.count(F.lit(1)).alias("lines")).select(F.col("w.start").alias("start"), "parse_layout", "kind", "lines")


def write_parsed(parsed: DataFrame, folder: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Append to ``folder``/rows as Parquet, split into state=loaded and state=rejected; restarts go on from the checkpoint beside it."""
    bad = F.col("parse_cost").isNull() | (F.col("parse_cost") > 0)
    out = parsed.withColumn("state", F.when(bad, "rejected").otherwise("loaded"))
    return out.writeStream.format("parquet").partitionBy("state").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
