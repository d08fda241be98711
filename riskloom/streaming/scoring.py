"""Scoring of streams: a fit is a projection, so it runs on a streaming DataFrame as on a stored one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskloom.plans.solve import SegmentedSolution, Solution, predict


def score_stream(sol: Solution | SegmentedSolution, stream: DataFrame, path: str, checkpoint: str, name: str = "prediction"):
    """Appends scored rows to Parquet files; returns the running query."""
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is needed; use predict() for stored rows")
    return predict(sol, stream, name).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
