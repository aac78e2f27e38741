"""Filters, decimation and sampling; random choices are hashes of ids, so a retried task chooses the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import cell, check_radius


def hash01(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the columns and the seed, written out with bars
    between them, which any SQL engine can repeat."""
    text = F.concat_ws("|", *[c.cast("string") for c in columns], F.lit(str(int(seed))))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(13)), 16, 10).cast("double") * F.lit(2.0**-52)


def height_slice(points: DataFrame, low: float, high: float, z: str = "z") -> DataFrame:
    """Rows with low <= z <= high."""
    return points.where(F.col(z).between(low, high))


def without_ground(points: DataFrame, classification: str = "classification", z: str = "z", least: float = 1 / 3) -> DataFrame:
    """Rows that aren't ground and stand above ``least``; a null class isn't known to be ground and drops too."""
    return points.where((F.col(classification) != 2) & (F.col(z) > least))


def _voxels(points: DataFrame, edge: float, order: list[Column]) -> DataFrame:
    keys = [cell(F.col(c), check_radius(edge)).alias("_v" + c) for c in "xyz"]
    v = points.select("*", *keys)
    w = Window.partitionBy("_vx", "_vy", "_vz").orderBy(*order)
    return v.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_vx", "_vy", "_vz")


def decimate_random(points: DataFrame, edge: float, seed: int = 0) -> DataFrame:
    """One random point per voxel (by hash of id and seed); ``points`` has id, x, y, z."""
    return _voxels(points, edge, [hash01(seed, F.col("id")), F.col("id")])


def decimate_first(points: DataFrame, edge: float) -> DataFrame:
    """The point with the smallest id of each voxel; voxels start at the origin."""
    return _voxels(points, edge, [F.col("id")])


def bernoulli(points: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Each row with probability ``share``."""
    if not 0 <= share <= 1:
        raise ValueError("share must be from 0 to 1")
    return points.where(hash01(seed, F.col("id")) < share)


def crop(points: DataFrame, x: float, y: float, length: float, circle: bool = True, negate: bool = False) -> DataFrame:
    """Points closer than ``length`` to (x, y), or in the open square of that width; ``negate`` takes the others."""
    dx, dy = F.col("x") - x, F.col("y") - y
    inside = F.hypot(dx, dy) < length if circle else (F.abs(dx) < length / 2) & (F.abs(dy) < length / 2)
    return points.where(~inside if negate else inside)


def recentre(points: DataFrame) -> DataFrame:
    """x and y relative to the middle of their range, with the shift in columns x0, y0."""
    mid = points.agg(((F.min("x") + F.max("x")) / 2).alias("x0"), ((F.min("y") + F.max("y")) / 2).alias("y0"))
    return points.join(F.broadcast(mid), F.lit(True)).withColumn("x", F.col("x") - F.col("x0")).withColumn("y", F.col("y") - F.col("y0"))


def clean_number(c: Column, default: float) -> Column:
    """The number, or a default for null and NaN."""
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(float(default)))


def slices(points: DataFrame, step: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Points with low <= z < high and the number of their horizontal slice of height ``step`` from low up;
    without bounds from the lowest point on."""
    check_radius(step)
    if low is None:
        base = points.agg(F.min("z").alias("_low"))
        s = points.join(F.broadcast(base), F.lit(True)).withColumn("slice", F.floor((F.col("z") - F.col("_low")) / step).cast("int")).drop("_low")
    else:
        s = points.where(F.col("z") >= low).withColumn("slice", F.floor((F.col("z") - low) / step).cast("int"))
    return s if high is None else s.where(F.col("z") < high)


def voxel_index(points: DataFrame, edge: float = 0.05) -> DataFrame:
    """(id, vx, vy, vz): whole voxel numbers from the smallest coordinates on; the triple is the key, so
    voxels never collide."""
    low = points.agg(*[F.min(c).alias("_" + c) for c in "xyz"])
    at = [F.floor((F.col(c) - F.col("_" + c)) / check_radius(edge)).alias("v" + c) for c in "xyz"]
    return points.join(F.broadcast(low), F.lit(True)).select("id", *at)
