"""Roll-ups of audit and usage streams by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour", by: tuple[str, ...] = ("event_type",), at: str = "ts", value: str = "value") -> DataFrame:
    """(window_start, by, n, total) of each window; a stream's late rows are dropped after the watermark, a table's never."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id", at: str = "ts") -> DataFrame:
    """(by, start, end, n) of runs of events less than a gap apart."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_usage(events: DataFrame) -> DataFrame:
    """(stream_id, input, output): of the usage that the events of a stream report (stream_id, seq, data as JSON), the last of each count."""
    count = lambda name: F.coalesce(*(F.get_json_object("data", f"$.{p}usage.{name}_tokens").cast("long") for p in ("", "message.", "response.")))
    rows = events.select("stream_id", "seq", count("input").alias("i"), count("output").alias("o"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return rows.groupBy("stream_id").agg(last("i").alias("input"), last("o").alias("output"))


def sink_json(stream: DataFrame, path: str, checkpoint: str):
    """A started query that appends a stream to JSON files, exactly once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
