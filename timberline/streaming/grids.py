"""Grid and key aggregates over streams of points, with a watermark on the time of receipt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.points import usable_rows
from ..operators.spatial import cell


def _timed(rows: DataFrame) -> DataFrame:
    """Watermarks need timestamps with a zone; stored ones have none."""
    return rows.withColumn("received_at", F.col("received_at").cast("timestamp"))


def deliveries(stream: DataFrame, lateness: str = "60 days") -> DataFrame:
    """Usable points of a stream of deliveries, repeated deliveries dropped within the lateness."""
    rows = _timed(usable_rows(stream, received_at="received_at", treeID="treeID"))
    return rows.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["point_id"])


def running_tops(stream: DataFrame, res: float = 10.0) -> DataFrame:
    """(row_, col_, n, z_max) per cell so far, for output mode update or complete; deliveries count as they come."""
    p = usable_rows(stream)
    return p.groupBy(cell(F.col("y"), res).alias("row_"), cell(F.col("x"), res).alias("col_")).agg(F.count("*").alias("n"), F.max("z").alias("z_max"))


def windowed_counts(stream: DataFrame, window: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """(start, n, z_max) per tumbling window of receipt, final once the watermark has passed it."""
    p = _timed(usable_rows(stream, received_at="received_at")).withWatermark("received_at", lateness)
    return p.groupBy(F.window("received_at", window).alias("w")).agg(F.count("*").alias("n"), F.max("z").alias("z_max")).select(F.col("w.start").alias("start"), "n", "z_max")
