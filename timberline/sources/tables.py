"""Point clouds and rasters as Parquet tables, imagery requests, frames of a turning cloud."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import bounding_box
from ..operators.spatial import cell


@dataclass(frozen=True)
class CloudMeta:
    """What a cloud's coordinates refer to."""

    epsg: int | None = None
    units: str = "m"


@dataclass(frozen=True)
class GridSpec:
    xmin: float
    ymin: float
    res: float
    nrow: int
    ncol: int
    epsg: int | None = None


def same_crs(a: CloudMeta | GridSpec, b: CloudMeta | GridSpec) -> bool:
    """False, with a warning, if both are known and differ."""
    if a.epsg is not None and b.epsg is not None and a.epsg != b.epsg:
        print(f"warning: coordinate systems differ: {a.epsg} and {b.epsg}")
        return False
    return True


def cloud_from_rows(spark: SparkSession, rows) -> DataFrame:
    """A cloud from a pandas frame or rows with X, Y, Z; point_id is added if missing."""
    df = spark.createDataFrame(rows)
    if not {"X", "Y", "Z"} <= set(df.columns):
        raise ValueError("a point cloud needs X, Y and Z")
    return df if "point_id" in df.columns else df.withColumn("point_id", F.monotonically_increasing_id())


def las_to_xyz(las: DataFrame) -> DataFrame:
    """Exactly the columns X, Y, Z."""
    if not {"X", "Y", "Z"} <= set(las.columns):
        raise ValueError("las must be a point cloud with X, Y and Z")
    return las.select("X", "Y", "Z")


def write_cloud(las: DataFrame, path: str, tile: float = 100.0, overwrite: bool = False) -> None:
    """Parquet, clustered by square tiles and sorted by Z inside, so that slices and areas skip row groups."""
    tiled = las.withColumn("tile_x", cell(F.col("X"), tile)).withColumn("tile_y", cell(F.col("Y"), tile))
    out = tiled.repartitionByRange("tile_x", "tile_y", "Z").sortWithinPartitions("tile_x", "tile_y", "Z").drop("tile_x", "tile_y")
    out.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_bands(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three rasters (row_, col_, value) from one table with a ``layer`` column of at least three bands, or
    from three tables of one band each."""
    if len(paths) == 1:
        all_bands = spark.read.parquet(paths[0])
        if "layer" not in all_bands.columns or all_bands.where(F.col("layer").isin(1, 2, 3)).select("layer").distinct().count() < 3:
            raise ValueError("a single raster must have at least three bands")
        return tuple(all_bands.where(F.col("layer") == i).select("row_", "col_", "value") for i in (1, 2, 3))
    if len(paths) == 3:
        return tuple(spark.read.parquet(p).select("row_", "col_", "value") for p in paths)
    raise ValueError("rasters must be one with three bands or three with one")


def write_raster(raster: DataFrame, path: str, overwrite: bool = False) -> None:
    raster.repartitionByRange("row_", "col_").sortWithinPartitions("row_", "col_").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def output_path(source: str, suffix: str, given: str | None = None, overwrite: bool = False) -> str:
    """The given path, or the source's with another ending; an existing file is an error unless overwriting."""
    path = given or os.path.splitext(source)[0] + suffix
    if os.path.exists(path) and not overwrite:
        raise ValueError(f"{path} exists; use overwrite=True")
    return path


def imagery_request(las: DataFrame, meta: CloudMeta, years: tuple[int, int], buffer: float = 0.0) -> dict | None:
    """The search for imagery over a cloud: bounding box, coordinate system and range of dates. None without
    a coordinate system or points. Sending it and reading the answer need a network."""
    if meta.epsg is None:
        return None
    if len(years) != 2 or years[0] > years[1]:
        raise ValueError("year_range must be two years in order")
    if buffer < 0:
        raise ValueError("buffer must not be negative")
    box = bounding_box(las.select(F.col("X").alias("x"), F.col("Y").alias("y")), buffer).first()
    if box["xmin"] is None:
        return None
    return {"bbox": [box["xmin"], box["ymin"], box["xmax"], box["ymax"]], "epsg": meta.epsg, "datetime": "/".join((f"{years[0]}-01-01", f"{years[1]}-12-31"))}


def newest_first(features: list[dict]) -> list[dict]:
    """Found images, the most recent first."""
    return sorted(features, key=lambda f: f.get("properties", {}).get("datetime") or "", reverse=True)


def rotation_frames(points: DataFrame, duration: float = 12, rpm: float = 5, axis: str = "z", size: tuple[int, int] = (800, 600)) -> DataFrame:
    """(frame, id, u, v, depth): the cloud (id, x, y, z) turned about an axis through its middle, ten frames
    a second, scaled to the screen; depth grows away from the viewer. Drawing and encoding are sinks."""
    if not duration > 0 or not rpm > 0:
        raise ValueError("duration and rpm must be positive")
    if axis not in ("x", "y", "z"):
        raise ValueError("axis must be 'x', 'y' or 'z'")
    n = math.ceil(duration * 10)
    mid = points.agg(*[((F.min(c) + F.max(c)) / 2).alias("m" + c) for c in "xyz"], F.sqrt(sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in "yz"), (F.max("x") - F.min("x")) * (F.max("x") - F.min("x")))).alias("span"))
    p = points.join(F.broadcast(mid), F.lit(True)).select("id", "span", *[(F.col(c) - F.col("m" + c)).alias(c) for c in "xyz"])
    p = p.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("a", F.col("frame") * (2 * math.pi * rpm / 60 / 10))
    a, b, up = {"z": ("x", "y", "z"), "x": ("y", "z", "x"), "y": ("z", "x", "y")}[axis]
    s = F.coalesce(F.try_divide(F.lit(float(min(size))), F.col("span")), F.lit(1.0))
    u, d = F.col(a) * F.cos("a") - F.col(b) * F.sin("a"), F.col(a) * F.sin("a") + F.col(b) * F.cos("a")
    return p.select("frame", "id", (u * s + size[0] / 2).alias("u"), (size[1] / 2 - F.col(up) * s).alias("v"), d.alias("depth"))
