"""Radius joins, neighbour counts and nearest neighbours on cell-bucketed equi-joins.

Every join is keyed by grid cells, so it runs as a shuffled or broadcast equi-join with adaptive skew
handling; a radius includes its boundary. Rows with a null or NaN coordinate have no neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace
from .points import is_number


def check_radius(radius: float) -> float:
    if isinstance(radius, bool) or not isinstance(radius, (int, float)) or not radius > 0:
        raise ValueError("radius must be positive")
    return float(radius)


def cell(c: Column, edge: float, origin: float = 0.0) -> Column:
    """Number of the grid cell of width ``edge``; whole numbers, also below zero."""
    return F.floor((c - F.lit(float(origin))) / F.lit(float(edge)))


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, dims: int = 3) -> DataFrame:
    """(l_id, r_id, dx, dy[, dz], d2) with d2 <= radius², for tables with id, x, y[, z].

    d* are right minus left, measured from the left point, which keeps precision far from the origin. Left
    rows stay in one cell; right rows are copied into the cells that their search box touches.
    """
    r = check_radius(radius)
    axes = "xyz"[:dims]
    edge = 2 * r
    ok = lambda: [is_number(F.col(a)) for a in axes]
    a, b = left, right
    for cond in ok():
        a, b = a.where(cond), b.where(cond)
    a = a.select(F.col("id").alias("l_id"), *[F.col(v).alias("l" + v) for v in axes], *[cell(F.col(v), edge).alias("c" + v) for v in axes])
    b = b.select(F.col("id").alias("r_id"), *[F.col(v).alias("r" + v) for v in axes])
    for v in axes:
        lo, hi = cell(F.col("r" + v) - r, edge), cell(F.col("r" + v) + r, edge)
        b = b.withColumn("c" + v, F.explode(F.when(lo == hi, F.array(lo)).otherwise(F.array(lo, hi))))
    pairs = a.join(b, ["c" + v for v in axes]).select("l_id", "r_id", *[(F.col("r" + v) - F.col("l" + v)).alias("d" + v) for v in axes])
    d2 = sum((F.col("d" + v) * F.col("d" + v) for v in axes[1:]), F.col("dx") * F.col("dx"))
    return pairs.withColumn("d2", d2).where(F.col("d2") <= r * r)


def count_in_disc(points: DataFrame, radius: float, of: DataFrame | None = None) -> DataFrame:
    """(id, n): points within the radius in x, y, the point itself included; ``of`` gives other query points,
    of which those without any neighbour count 0."""
    q = points if of is None else of
    n = radius_pairs(q, points, radius, 2).groupBy("l_id").agg(F.count("*").alias("n"))
    return n.withColumnRenamed("l_id", "id") if of is None else q.select("id").join(n.withColumnRenamed("l_id", "id"), "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def count_in_sphere(points: DataFrame, radius: float) -> DataFrame:
    """(id, n): points within the radius in x, y, z, the point itself included."""
    return radius_pairs(points, points, radius, 3).groupBy(F.col("l_id").alias("id")).agg(F.count("*").alias("n"))


def relative_density(points: DataFrame, small: float, large: float) -> DataFrame:
    """(id, n_small, n_large, relative_density): share of the neighbours in the large disc that lie in the
    small one, from one join at the large radius."""
    if not check_radius(small) <= check_radius(large):
        raise ValueError("the small radius must not exceed the large one")
    p = radius_pairs(points, points, large, 2).groupBy(F.col("l_id").alias("id"))
    n = p.agg(F.sum((F.col("d2") <= small * small).cast("long")).alias("n_small"), F.count("*").alias("n_large"))
    return n.withColumn("relative_density", F.col("n_small") / F.col("n_large"))


def knn_within(points: DataFrame, k: int, radius: float, dims: int = 3) -> DataFrame:
    """(l_id, r_id, rank, dist): the k nearest others of each point within the radius; ties by id.

    Equals the k nearest of all where these lie within the radius, which is what a graph with a longest
    edge needs.
    """
    if k < 1:
        raise ValueError("k must be a positive integer")
    p = radius_pairs(points, points, radius, dims).where("l_id <> r_id")
    w = Window.partitionBy("l_id").orderBy("d2", "r_id")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("l_id", "r_id", "rank", F.sqrt("d2").alias("dist"))


def nearest_within(left: DataFrame, right: DataFrame, radius: float, dims: int = 3) -> DataFrame:
    """(l_id, r_id, dist): the nearest right row of each left row within the radius, the smaller id on ties.
    Left rows without one are absent."""
    p = radius_pairs(left, right, radius, dims)
    best = p.groupBy("l_id").agg(F.min(F.struct("d2", "r_id")).alias("m"))
    return best.select("l_id", F.col("m.r_id").alias("r_id"), F.sqrt("m.d2").alias("dist"))


def nearest(left: DataFrame, right: DataFrame, start: float, work: Workspace, dims: int = 3) -> DataFrame:
    """(l_id, r_id, dist): the nearest right row of each left row, however far, the smaller id on ties.

    The search begins within ``start``; whoever found nothing looks four times as far, until all have an
    answer or the reach spans everything. Left rows with a null or NaN coordinate, or all if there is no
    right row, have none.
    """
    axes, work = "xyz"[:dims], work.child("nearest")
    ok = F.lit(True)
    for a in axes:
        ok = ok & is_number(F.col(a))
    right = work.put("right", right.where(ok).select("id", *axes))
    open_ = work.put("open", left.where(ok).select("id", *axes))
    ends = right.select(*axes).unionByName(open_.select(*axes)).agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    widest = sum((ends[a] or 0.0) ** 2 for a in axes) ** 0.5 * 1.001 + 1e-9
    found, reach, turn = None, min(check_radius(start), widest), 0
    while True:
        some = work.put(f"found-{turn}", nearest_within(open_, right, reach, dims))
        found = some if found is None else found.unionByName(some)
        if reach >= widest:
            return found
        open_ = work.put("open", open_.join(some.select(F.col("l_id").alias("id")), "id", "left_anti"))
        if open_.isEmpty():
            return found
        reach, turn = min(reach * 4, widest), turn + 1


def points_in_circles(points: DataFrame, circles: DataFrame, margin: float = 0.0) -> DataFrame:
    """(id, circle): for each point inside some circle (closed) the smallest circle id. ``circles`` has
    circle, cx, cy, r; the margin widens them. Circles are put into cells of their own size class, so a few
    large ones don't multiply all."""
    c = circles.where(is_number(F.col("cx")) & is_number(F.col("cy")) & is_number(F.col("r"))).withColumn("r", F.col("r") + margin).where("r >= 0")
    edge = 1.0
    for name, v in (("ix", "cx"), ("iy", "cy")):
        c = c.withColumn(name, F.explode(F.sequence(cell(F.col(v) - F.col("r"), edge), cell(F.col(v) + F.col("r"), edge))))
    p = points.select("id", "x", "y", cell(F.col("x"), edge).alias("ix"), cell(F.col("y"), edge).alias("iy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return p.join(c, ["ix", "iy"]).where(dx * dx + dy * dy <= F.col("r") * F.col("r")).groupBy("id").agg(F.min("circle").alias("circle"))


def ids_from_map(points: DataFrame, tree_map: DataFrame, length: float = 2.5, circle: bool = True) -> DataFrame:
    """(id, tree_id): the first map entry (by its order) within ``length`` of a point, or, if not circle, in
    the square of that width around it; 0 where there is none. ``tree_map`` has order, tree_id, x, y."""
    r = check_radius(length) if circle else check_radius(length) / 2
    m = tree_map.select(F.col("order").alias("id"), "x", "y")
    p = radius_pairs(points, m, r if circle else r * 2**0.5, 2)
    inside = p.where(F.col("d2") < r * r) if circle else p.where((F.abs("dx") < r) & (F.abs("dy") < r))
    first = inside.groupBy(F.col("l_id").alias("id")).agg(F.min("r_id").alias("order")).join(tree_map.select("order", "tree_id"), "order")
    return points.select("id").join(first.select("id", "tree_id"), "id", "left").select("id", F.coalesce("tree_id", F.lit(0)).alias("tree_id"))


def distance_statistics(distances: DataFrame, column: str = "distances", zero: float = 1e-8) -> DataFrame:
    """Median, Min, Max, Mean, Var and Sd of the sorted distances of each row (id, array), up to the first
    value below ``zero``, after which the list counts as unused; the upper median and the sample variance.
    Rows without a value have nulls."""
    first = F.expr(f"aggregate(transform({column}, v -> v < {zero!r}D), struct(0 AS n, false AS stop), (a, b) -> struct(if(a.stop or b, a.n, a.n + 1) AS n, a.stop or b AS stop)).n")
    used = F.slice(F.col(column), F.lit(1), first)
    d = distances.select("id", F.when(first > 0, F.sort_array(used)).alias("v")).withColumn("k", F.size("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / F.col("k")
    d = d.withColumn("Mean", mean)
    ss = F.aggregate(F.transform("v", lambda x: (x - F.col("Mean")) * (x - F.col("Mean"))), F.lit(0.0), lambda a, b: a + b)
    d = d.withColumn("Var", F.when(F.col("k") > 1, ss / (F.col("k") - 1)))
    return d.select("id", F.get("v", F.floor(F.col("k") / 2).cast("int")).alias("Median"), F.array_min("v").alias("Min"), F.array_max("v").alias("Max"), "Mean", "Var", F.sqrt("Var").alias("Sd"))
