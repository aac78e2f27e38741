"""Points near other points, and points inside regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace, broadcast_if_small, pick
from .points import is_number, usable_points

#: Region edges and tiles are broadcast up to this many rows, about 60 bytes each; beyond it they shuffle.
MAX_BROADCAST_ROWS = 200_000
#: Points of a cell that meet their neighbours in one task; a cell with more is salted.
CROWD = 5_000


def _cells(c, edge: float):
    return F.floor(c / F.lit(float(edge)))


def cell_edge(points: DataFrame, radius: float, most: float = 16.0) -> float:
    """Edge of the cells for ``near_pairs``: 8, 4 or 2 radii, the widest at which a point shares its cell with
    at most ``most`` others on average, counted in one of 64 cells. It changes the work only, not the result."""
    wide = 8 * radius
    home = [F.floor(F.col(c) / F.lit(float(wide))).alias("w" + c) for c in "xyz"]
    some = points.select("x", "y", "z", *home).where(F.pmod(F.xxhash64("wx", "wy", "wz"), F.lit(64)) == 0)
    fine = some.groupBy("wx", "wy", "wz", *[F.floor(F.col(c) / F.lit(2.0 * radius)).alias("c" + c) for c in "xyz"]).agg(F.count("*").alias("n"))
    half = fine.groupBy("wx", "wy", "wz", *[F.floor(F.col("c" + c) / 2).alias("h" + c) for c in "xyz"]).agg(F.sum("n").alias("n"))
    whole = half.groupBy("wx", "wy", "wz").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("h"))
    r = whole.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("w"), F.sum("h").alias("h")).first()
    for times, pairs in ((8, r["w"]), (4, r["h"])):
        if not r["n"] or pairs / r["n"] <= most:
            return float(times * radius)
    return 2.0 * radius


def near_pairs(points: DataFrame, radius: float, cell: float | None = None, crowd: int = CROWD) -> DataFrame:
    """All pairs (key_a < key_b) of different points with a distance in x, y, z below ``radius``.

    ``points`` has point_id (unique), x, y, z. Each point probes its home cell; the build side is copied
    into every cell that its search box touches, so each pair meets once, in the home cell of its smaller
    id. Points of a cell with more than ``crowd`` of them are spread over salts, to each of which what the
    cell meets is copied. Points at equal positions are pairs like others.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    edge = float(cell or cell_edge(points, radius))
    r = F.lit(float(radius))
    at = ["cx", "cy", "cz"]
    home = points.select(F.col("point_id").alias("key_a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), _cells(F.col("x"), edge).alias("cx"), _cells(F.col("y"), edge).alias("cy"), _cells(F.col("z"), edge).alias("cz"))
    build = points.select(F.col("point_id").alias("key_b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    for axis in "xyz":
        lo, hi = _cells(F.col("b" + axis) - r, edge), _cells(F.col("b" + axis) + r, edge)
        build = build.withColumn("c" + axis, F.explode(F.when(lo == hi, F.array(lo)).otherwise(F.sequence(lo, hi))))
    full = home.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(*at, F.ceil(F.col("n") / crowd).cast("int").alias("salts"))
    full = Workspace(points.sparkSession, "crowded").put("cells", full)
    if not full.isEmpty():
        few = broadcast_if_small(full, MAX_BROADCAST_ROWS)
        home = home.join(few, at, "left").withColumn("salt", F.pmod(F.xxhash64("key_a"), F.coalesce("salts", F.lit(1)))).drop("salts")
        build = build.join(few, at, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts")
        at = [*at, "salt"]
    d = [F.col("a" + s) - F.col("b" + s) for s in "xyz"]
    close = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < r * r
    return home.join(build, at).where((F.col("key_a") < F.col("key_b")) & close).select("key_a", "key_b")


def region_edges(rings: DataFrame) -> DataFrame:
    """(region, edge, x1, y1, x2, y2): the edges of rings (region, ring), closed implicitly.

    Horizontal edges and edges of zero length never cross a ray and are left out; rings with fewer than
    three corners, with null or NaN corners, or null rings have no inside and give no edge.
    """
    ok = F.col("ring").isNotNull() & (F.size("ring") >= 3) & ~F.exists("ring", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))
    corners = rings.where(ok).withColumn("following", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)))
    e = corners.select("region", F.posexplode(F.arrays_zip("ring", "following")).alias("edge", "e"))
    e = e.select("region", "edge", F.col("e.ring.x").alias("x1"), F.col("e.ring.y").alias("y1"), F.col("e.following.x").alias("x2"), F.col("e.following.y").alias("y2"))
    return e.where(F.col("y1") != F.col("y2"))


def _level(width, strip: float):
    """Tiles of ``strip`` times a power of two, of which a region of this width has about eight at most."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(width / F.lit(8 * strip), F.lit(1e-9))))).cast("int")


def _tiles(points: DataFrame, regions: DataFrame, strip: float) -> DataFrame:
    """The points in the tiles of every level that some region has; there are at most some sixty levels."""
    levels = [r[0] for r in regions.select("level").distinct().collect()]
    p = points.select("point_id", "x", "y", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("level"))
    size = F.lit(float(strip)) * F.pow(F.lit(2.0), F.col("level"))
    return p.select("*", F.floor(F.col("y") / size).alias("row"), F.floor(F.col("x") / size).alias("tile"))


def points_in_rings(points: DataFrame, rings: DataFrame, strip: float = 8.0) -> DataFrame:
    """(region, point_id) of points inside rings, by crossing parity in SQL.

    ``points`` has point_id, x, y and may repeat a point; ``rings`` has region, ring. Edges are binned into
    strips along y and copied into the tiles between their region's left bound and themselves, so a point
    meets only edges of regions that reach its tile. Strips and tiles are ``strip`` metres or, for large
    regions, a power of two times that, so an edge has a bounded number of copies whatever its region's size.
    A ray to greater x crosses an edge if the edge spans y half-open (lower end in, upper end out, so a ray
    through a corner counts once) and passes right of the point; an odd number of crossings is inside. A point
    exactly on a left edge is inside and on a right edge outside, so adjoining regions never share a point.
    """
    work = Workspace(points.sparkSession, "rings")
    e = region_edges(rings)
    bounds = e.groupBy("region").agg(*[f(g("x1", "x2")).alias(n + "x") for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))], *[f(g("y1", "y2")).alias(n + "y") for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))])
    bounds = bounds.select("region", F.col("lox").alias("left"), _level(F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy")), strip).alias("level"))
    size = F.lit(float(strip)) * F.pow(F.lit(2.0), F.col("level"))
    at = lambda c: F.floor(c / size)
    e = e.join(bounds, "region").select(
        "region", "edge", "x1", "y1", "x2", "y2", "level",
        F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))).alias("row"), at(F.col("left")).alias("from"), at(F.greatest("x1", "x2")).alias("to"),
    ).withColumn("tile", F.explode(F.sequence("from", "to"))).drop("from", "to")
    e = work.put("edges", e)
    spans = (F.least("y1", "y2") <= F.col("y")) & (F.col("y") < F.greatest("y1", "y2"))
    x = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    hits = _tiles(points, e, strip).join(broadcast_if_small(e, MAX_BROADCAST_ROWS), ["level", "row", "tile"]).where(spans & (x > F.col("x")))
    # a repeated delivery repeats its crossings: one row per edge first, both steps on one partitioning
    crossings = hits.select("region", "point_id", "edge").repartition("region", "point_id").dropDuplicates(["region", "point_id", "edge"])
    return crossings.groupBy("region", "point_id").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select("region", "point_id")


def points_in_discs(points: DataFrame, discs: DataFrame, strip: float = 8.0) -> DataFrame:
    """(region, point_id) of points less than ``radius`` from (cx, cy); ``discs`` has region, cx, cy, radius.

    Discs with a null, NaN or non-positive radius or centre hold nothing. Tiles grow with the disc.
    """
    work = Workspace(points.sparkSession, "discs")
    d = discs.where(is_number(F.col("cx")) & is_number(F.col("cy")) & is_number(F.col("radius")) & (F.col("radius") > 0)).withColumn("level", _level(2 * F.col("radius"), strip))
    size = F.lit(float(strip)) * F.pow(F.lit(2.0), F.col("level"))
    for name, c in (("row", F.col("cy")), ("tile", F.col("cx"))):
        d = d.withColumn(name, F.explode(F.sequence(F.floor((c - F.col("radius")) / size), F.floor((c + F.col("radius")) / size))))
    d = work.put("tiles", d)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    hits = _tiles(points, d, strip).join(broadcast_if_small(d, MAX_BROADCAST_ROWS), ["level", "row", "tile"]).where(dx * dx + dy * dy < F.col("radius") * F.col("radius"))
    return hits.select("region", "point_id").dropDuplicates(["region", "point_id"])


def inside_plots(points: DataFrame, plots: DataFrame) -> DataFrame:
    """(region, point_id) for plots of either shape; a plot of another or null shape holds nothing."""
    p = pick(plots, region="plot_id", shape="shape", cx="cx", cy="cy", radius="radius", ring="ring").where(F.col("region").isNotNull())
    shape = F.lower(F.trim("shape"))
    return points_in_discs(points, p.where(shape == "disc")).unionByName(points_in_rings(points, p.where(shape == "ring")))


def near_and_inside(las: DataFrame, plots: DataFrame, radius: float = 0.0505) -> DataFrame:
    """(kind, key_a, key_b): ``near`` pairs of usable points and ``inside`` pairs of plot and point.

    Unusable points and plots without a valid shape give no rows; repeated deliveries and repeated plots
    give each pair once; empty tables give an empty result.
    """
    points = Workspace(las.sparkSession, "regions").put("points", usable_points(las))
    near = near_pairs(points, radius).select(F.lit("near").alias("kind"), "key_a", "key_b")
    inside = inside_plots(points, plots).select(F.lit("inside").alias("kind"), F.col("region").cast("long").alias("key_a"), F.col("point_id").alias("key_b"))
    return near.unionByName(inside)
