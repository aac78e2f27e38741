"""Colours for points: by attribute, raster, sky visibility or screen-space occlusion; blends of two clouds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.palette import ramp
from ..sources.tables import same_crs
from .sampling import hash01
from .spatial import cell, check_radius, radius_pairs

METHODS = ("attr", "rgb", "pcv", "ssao")
BLENDS = ("alpha", "multiply", "screen", "overlay")


def bin256(v: Column) -> Column:
    """Bin 1..256 of a number in [0, 1]: equal widths, closed on the right, 0 in the first; null stays null."""
    return F.when(v.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(256), F.ceil(v * 256)))).cast("int")


def by_value(values: DataFrame, palette: list[str] | None = None) -> DataFrame:
    """(id, R, G, B) of (id, value): min-max scaled, binned and put through a ramp. Null and NaN values are
    black; equal values are all in the first bin."""
    v = values.select("id", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value"))
    span = v.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    share = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    # values that are missing have a stop of their own after the ramp
    binned = v.join(F.broadcast(span), F.lit(True)).select("id", F.when(F.col("value").isNull(), F.lit(257)).otherwise(bin256(share)).alias("bin"))
    stops = [*ramp(palette or ["black", "white"]), (0, 0, 0)]
    return binned.select("id", *[F.element_at(F.array(*[F.lit(s[i]) for s in stops]), F.col("bin")).alias("RGB"[i]) for i in range(3)])


def by_raster(points: DataFrame, red: DataFrame, green: DataFrame, blue: DataFrame, res: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(id, R, G, B) from the cells of three rasters; outside and null are 0; if no red value exceeds 1, all
    are shares of 255; truncated."""
    scale = red.agg(F.when(F.max("value") <= 1, 255.0).otherwise(1.0).alias("scale"))
    bands = [r.select("row_", "col_", F.col("value").alias("v"), F.lit(n).alias("band")) for n, r in (("R", red), ("G", green), ("B", blue))]
    wide = bands[0].unionByName(bands[1]).unionByName(bands[2]).groupBy("row_", "col_").agg(*[F.max(F.when(F.col("band") == n, F.col("v"))).alias(n) for n in "RGB"])
    at = points.select("id", cell(F.col("y"), res, origin[1]).cast("int").alias("row_"), cell(F.col("x"), res, origin[0]).cast("int").alias("col_"))
    out = at.join(wide, ["row_", "col_"], "left").join(F.broadcast(scale), F.lit(True))
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), (F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) * F.col("scale")).cast("int"))).alias(c)
    return out.select("id", clip("R"), clip("G"), clip("B"))


def sky_visibility(points: DataFrame, radius: float = 1.0, directions: int = 60) -> DataFrame:
    """(id, value): mean over ``directions`` azimuths of pi/2 minus the horizon, the largest elevation of
    neighbours whose bearing is within acos(0.7) of the azimuth; without such neighbours pi/2 counts.

    All azimuths are maxima in one aggregation of one join; nothing is exploded per direction.
    """
    if directions < 1:
        raise ValueError("num_directions must be a positive integer")
    p = radius_pairs(points, points, check_radius(radius), 3).where("l_id <> r_id")
    p = p.withColumn("h", F.hypot("dx", "dy")).where(F.col("h") >= 1e-10).withColumn("up", F.atan2("dz", "h"))
    turn = [2 * math.pi * i / directions for i in range(directions)]
    maxima = [F.max(F.when((F.col("dx") * math.cos(a) + F.col("dy") * math.sin(a)) / F.col("h") > 0.7, F.col("up"))).alias(f"a{i}") for i, a in enumerate(turn)]
    sky = F.aggregate(F.array(*[F.coalesce(F.lit(math.pi / 2) - F.col(f"a{i}"), F.lit(math.pi / 2)) for i in range(directions)]), F.lit(0.0), lambda s, v: s + v) / directions
    seen = p.groupBy(F.col("l_id").alias("id")).agg(*maxima).select("id", sky.alias("value"))
    return points.select("id").join(seen, "id", "left").select("id", F.coalesce("value", F.lit(math.pi / 2)).alias("value"))


def depth_map(points: DataFrame, pixel: float) -> DataFrame:
    """(gx, gy, depth): the lowest z of each pixel, pixels counted from the smallest x and y."""
    low = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    at = points.join(F.broadcast(low), F.lit(True)).select(F.floor((F.col("x") - F.col("x0")) / pixel).alias("gx"), F.floor((F.col("y") - F.col("y0")) / pixel).alias("gy"), "z")
    return at.groupBy("gx", "gy").agg(F.min("z").alias("depth"))


def screen_occlusion(points: DataFrame, pixel: float = 0.1, kernel: int = 5, samples: int = 16, seed: int = 42) -> DataFrame:
    """(id, value): 1 minus the mean occlusion over sampled pixels that hold points, at least 0.

    Offsets are hashes of point, sample and seed, truncated to whole pixels within the kernel. A pixel whose
    depth is below the point's z counts (1 - distance / kernel) * min(1, difference / (distance + 0.1)).
    """
    check_radius(pixel)
    if kernel < 1 or samples < 1:
        raise ValueError("kernel_size and num_samples must be positive integers")
    low = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    p = points.join(F.broadcast(low), F.lit(True)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    offset = lambda axis: ((hash01(seed, F.col("id"), F.col("s"), F.lit(axis)) * 2 - 1) * kernel).cast("int")
    p = p.withColumn("ox", offset(0)).withColumn("oy", offset(1))
    p = p.select("id", "z", "ox", "oy", (F.floor((F.col("x") - F.col("x0")) / pixel) + F.col("ox")).alias("gx"), (F.floor((F.col("y") - F.col("y0")) / pixel) + F.col("oy")).alias("gy"))
    met = p.join(depth_map(points, pixel), ["gx", "gy"]).withColumn("below", F.col("z") - F.col("depth")).withColumn("dist", F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy")))
    part = F.when(F.col("below") > 0, (1 - F.col("dist") / kernel) * F.least(F.lit(1.0), F.col("below") / (F.col("dist") + 0.1))).otherwise(0.0)
    shade = met.groupBy("id").agg(F.avg(part).alias("o"))
    return points.select("id").join(shade, "id", "left").select("id", (1 - F.least(F.lit(1.0), F.coalesce("o", F.lit(0.0)))).alias("value"))


def colorize(points: DataFrame, method: str = "attr", attribute: str | None = None, palette: list[str] | None = None, rasters: tuple | None = None, res: float = 1.0, radius: float = 1.0, directions: int = 60, kernel: int = 5, pixel: float = 0.1, samples: int = 16, crs: tuple | None = None) -> DataFrame:
    """(id, R, G, B) by one of METHODS. ``points`` has id, x, y, z and the attribute. ``crs`` are the
    descriptions of the cloud and of the rasters; a warning is given if their coordinate systems differ."""
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if method == "attr":
        if attribute is None:
            raise ValueError("attribute_name must be provided for method 'attr'")
        if attribute not in points.columns:
            raise ValueError(f"attribute '{attribute}' not found in the point cloud")
        return by_value(points.select("id", F.col(attribute).alias("value")), palette)
    if method == "rgb":
        if rasters is None or len(rasters) != 3:
            raise ValueError("raster_path must be provided: one raster for red, green and blue each")
        if crs is not None:
            same_crs(*crs)
        return by_raster(points, *rasters, res)
    if method == "pcv":
        return by_value(sky_visibility(points, radius, directions), palette)
    return by_value(screen_occlusion(points, pixel, kernel, samples), palette)


def blend(first: DataFrame, second: DataFrame, method: str = "alpha", alpha: float = 0.5) -> DataFrame:
    """(id, R, G, B) of two clouds (id, R, G, B) matched by id; clamped to 0..255 and truncated."""
    if method not in BLENDS:
        raise ValueError(f"method must be one of {', '.join(BLENDS)}")
    if isinstance(alpha, bool) or not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    for cloud in (first, second):
        if not {"R", "G", "B"} <= set(cloud.columns):
            raise ValueError("both point clouds must have R, G and B")
    b = second.select("id", *[F.col(c).alias(c + "2") for c in "RGB"])

    def mixed(c: str) -> Column:
        x, y = F.col(c).cast("double"), F.col(c + "2").cast("double")
        v = {
            "alpha": x * (1 - alpha) + y * alpha,
            "multiply": x * y / 255,
            "screen": 255 - (255 - x) * (255 - y) / 255,
            "overlay": F.when(x < 128, 2 * x * y / 255).otherwise(255 - 2 * (255 - x) * (255 - y) / 255),
        }[method]
        return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(v, 9)).cast("int"))).alias(c)

    return first.join(b, "id").select("id", *[mixed(c) for c in "RGB"])


def merge_colors(first: DataFrame, second: DataFrame, method: str = "alpha", alpha: float = 0.5) -> DataFrame:
    """``blend`` after a check that both clouds have equally many points."""
    if first.count() != second.count():
        raise ValueError("point clouds must have the same number of points")
    return blend(first, second, method, alpha)
