"""Risk events per second from a stream of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.photos import SEVERITY, THRESHOLD


def risk_timeline(events: DataFrame, labels: DataFrame, lateness: str = "10 seconds", threshold: float = THRESHOLD) -> DataFrame:
    """events: ts, label, conf, streamed. Per second: severity and number of detections; late rows beyond `lateness` are dropped."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("severity")), F.lit(0))
    d = events.withWatermark("ts", lateness).where(F.col("conf") >= threshold).join(F.broadcast(labels), "label", "left").withColumn("rank", rank)
    g = d.groupBy(F.window("ts", "1 second")).agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    name = F.element_at(F.create_map(*(F.lit(x) for k, v in SEVERITY.items() for x in (v, k))), F.col("rank"))
    return g.select(F.col("window.start").alias("second"), name.alias("severity"), "n")
