"""Cleaning of point clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import pick

NOISE_CLASS = 7


def is_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def usable_rows(las: DataFrame, **extra: str) -> DataFrame:
    """Rows with an id, finite-or-infinite X, Y, Z (neither null nor NaN) and a class other than noise.

    Output: point_id, x, y, z and the ``extra`` columns (new_name="existing"). A null class counts as not
    noise; a null point_id is dropped, as the row cannot be told from others. Repeated deliveries stay.
    """
    df = pick(las, point_id="point_id", x="X", y="Y", z="Z", _class="Classification", **extra)
    ok = F.col("point_id").isNotNull() & is_number(F.col("x")) & is_number(F.col("y")) & is_number(F.col("z"))
    return df.where(ok & (F.col("_class").isNull() | (F.col("_class") != NOISE_CLASS))).drop("_class")


def usable_points(las: DataFrame, **extra: str) -> DataFrame:
    """``usable_rows`` with every point_id once.

    A repeated delivery carries the same position, so any of its rows stands for the point; the shuffle is
    by point_id, which is even whatever the scans, trees or places look like.
    """
    return usable_rows(las, **extra).dropDuplicates(["point_id"])
