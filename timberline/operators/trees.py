"""Stem detection, segmentation of points to trees, and attributes per tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace
from . import grid
from .eigen import eigen_metrics
from .fits import fit_groups, landau_groups
from .graph import first_seeds, knn_edges
from .points import is_number
from .sampling import clean_number, decimate_random, height_slice, without_ground
from .skew import top_per_key
from .spatial import cell, nearest, nearest_within, points_in_circles, relative_density

#: Points that a task gathers before it keeps only the corners of their trees' hulls.
CHUNK = 20_000


# -- attributes ------------------------------------------------------------------------------------------

def tree_heights(points: DataFrame) -> DataFrame:
    """(tree_id, x, y, height): the highest point of each non-null tree of (id, tree_id, x, y, z), the
    smallest id on ties."""
    top = top_per_key(points.where(is_number(F.col("z"))), "tree_id", [F.col("z").desc(), F.col("id")])
    return top.select("tree_id", "x", "y", F.col("z").alias("height"))


def key_quantiles(rows: DataFrame, key: str, value: str, steps: int) -> DataFrame:
    """(key, q): the exact quantiles 0, 1/steps, ..., 1 of each non-null key, interpolated linearly.

    Equal values are counted first; counts are summed up by ranges of the value and then inside them, so no
    task holds all values of a key, however many rows it has.
    """
    r = rows.where(F.col(key).isNotNull() & is_number(F.col(value))).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    n = r.groupBy("_k", "_v").agg(F.count("*").alias("_n")).withColumn("_b", F.floor("_v"))
    part = n.groupBy("_k", "_b").agg(F.sum("_n").alias("_m"))
    part = part.withColumn("_skip", F.sum("_m").over(Window.partitionBy("_k").orderBy("_b")) - F.col("_m")).withColumn("_all", F.sum("_m").over(Window.partitionBy("_k")))
    at = n.join(part.drop("_m"), ["_k", "_b"])
    at = at.withColumn("_to", F.col("_skip") + F.sum("_n").over(Window.partitionBy("_k", "_b").orderBy("_v"))).withColumn("_from", F.col("_to") - F.col("_n"))
    # the ranks on either side of each quantile that fall on this value
    wanted = F.expr(f"transform(sequence(0, {steps}), i -> named_struct('i', i, 'at', (_all - 1) * (i / {steps}D)))")
    hits = at.select("_k", "_v", F.explode(F.filter(wanted, lambda w: ((F.floor(w["at"]) >= F.col("_from")) & (F.floor(w["at"]) < F.col("_to"))) | ((F.ceil(w["at"]) >= F.col("_from")) & (F.ceil(w["at"]) < F.col("_to"))))).alias("w"))
    share = F.col("w.at") - F.floor("w.at")
    q = hits.groupBy("_k", F.col("w.i").alias("_i")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first(share).alias("_s"))
    q = q.select("_k", F.struct("_i", F.when(F.col("_s") == 0, F.col("_lo")).otherwise((1 - F.col("_s")) * F.col("_lo") + F.col("_s") * F.col("_hi")).alias("v")).alias("_q"))
    return q.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list("_q")), lambda e: e["v"]).alias("q")).withColumnRenamed("_k", key)


def crown_base_heights(points: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(tree_id, crown_base_height): the upper end of the first step of more than ``threshold`` between
    consecutive 5 % quantiles of z; the greatest z if there is none."""
    q = key_quantiles(points, "tree_id", "z", 20)
    steps = F.filter(F.zip_with(F.slice("q", 1, 20), F.slice("q", 2, 20), lambda a, b: F.when(b - a > threshold, b)), lambda v: v.isNotNull())
    return q.select("tree_id", F.coalesce(F.get(steps, F.lit(0)), F.element_at("q", 21)).alias("crown_base_height"))


def hull_2d(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; fewer than three for points on a line."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def area_2d(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = (ring - ring[0]).T
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def hull_3d(p: np.ndarray) -> tuple[float, float, np.ndarray] | None:
    """(volume, surface, corners) of the convex hull by adding points to a tetrahedron; None if flat."""
    p = np.unique(p, axis=0)
    if len(p) < 4:
        return None
    o = p.mean(0)
    p = p - o
    eps = 1e-9 * max(np.abs(p).max(), 1e-12)
    a = int(p[:, 0].argmin())
    b = int(np.linalg.norm(p - p[a], axis=1).argmax())
    line = np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1)
    c = int(line.argmax())
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    off = (p - p[a]) @ normal
    d = int(np.abs(off).argmax())
    size = np.linalg.norm(normal)
    if size <= eps * eps or abs(off[d]) <= eps * size:
        return None
    faces = [(a, b, c), (a, c, d), (a, d, b), (b, d, c)] if off[d] < 0 else [(a, c, b), (a, d, c), (a, b, d), (b, c, d)]
    f = np.array(faces)
    plane = lambda f: (lambda n: (n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300), f))(np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]]))
    n, f = plane(f)
    left = np.setdiff1d(np.arange(len(p)), [a, b, c, d])
    while len(left):
        above = p[left] @ n.T - (n * p[f[:, 0]]).sum(1)
        keep = above.max(1) > eps
        left, above = left[keep], above[keep]
        if not len(left):
            break
        k = int(above.max(1).argmax())
        i, seen = left[k], above[k] > eps
        edges = {(int(u), int(v)) for t in f[seen] for u, v in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        rim = [(u, v) for u, v in edges if (v, u) not in edges]
        n2, f2 = plane(np.array([(u, v, i) for u, v in rim]))
        n, f = np.concatenate([n[~seen], n2]), np.concatenate([f[~seen], f2])
        left = np.delete(left, k)
    cross = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
    volume = float((p[f[:, 0]] * cross).sum() / 6)
    return abs(volume), float(np.linalg.norm(cross, axis=1).sum() / 2), p[np.unique(f)] + o


def _corners(p: np.ndarray) -> np.ndarray:
    """The corners of the hull, which has the same hull; all points where that is flat."""
    if p.shape[1] == 2:
        return hull_2d(p)
    h = hull_3d(p)
    return np.unique(p, axis=0) if h is None else h[2]


def _hull_points(points: DataFrame, dims: int, chunk: int = CHUNK) -> DataFrame:
    """(tree_id, x, y[, z]): the points that can be corners of the hull of their tree.

    Each task keeps the corners of the parts of the trees that it has seen, so what a tree sends on is
    bounded by the number of tasks, not of its points; whatever its share of all rows is. Parts of fewer
    than 64 points are sent as they are.
    """
    axes = ["x", "y", "z"][:dims]
    p = points.select("tree_id", *axes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for f in frames:
            held = f if held is None else pd.concat([held, f])
            if len(held) >= chunk:
                held = reduce(held)
                if len(held) >= chunk // 2:  # many small trees: nothing to gain
                    yield held
                    held = None
        if held is not None and len(held):
            yield reduce(held)

    def reduce(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, part in f.groupby("tree_id", sort=False):
            if len(part) < 64:
                out.append(part)
            else:
                c = pd.DataFrame(_corners(part[axes].to_numpy()), columns=axes)
                c.insert(0, "tree_id", tree)
                out.append(c)
        return pd.concat(out) if out else f

    kind = p.schema["tree_id"].dataType.simpleString()
    return p.mapInPandas(run, f"tree_id {kind}, " + ", ".join(f"{a} double" for a in axes))


def crown_hulls(points: DataFrame) -> DataFrame:
    """(tree_id, crown_area, ring): area and corners of the hull in x, y; null for fewer than three points."""
    p = points.where(F.col("tree_id").isNotNull() & is_number(F.col("x")) & is_number(F.col("y")))
    n = p.groupBy("tree_id").agg(F.count("*").alias("n"))
    kind = p.schema["tree_id"].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ring = hull_2d(f[["x", "y"]].to_numpy())
        return pd.DataFrame({"tree_id": [f["tree_id"].iloc[0]], "area": [area_2d(ring)], "ring": [[{"x": float(x), "y": float(y)} for x, y in ring]]})

    h = _hull_points(p, 2).groupBy("tree_id").applyInPandas(run, f"tree_id {kind}, area double, ring array<struct<x:double,y:double>>")
    ok = F.col("n") > 2
    return n.join(h, "tree_id").select("tree_id", F.when(ok, F.col("area")).alias("crown_area"), F.when(ok, F.col("ring")).alias("ring"))


def crown_volumes(points: DataFrame, bases: DataFrame) -> DataFrame:
    """(tree_id, crown_volume, crown_surface) of the hull of the points above the crown base; null for fewer
    than four points or a flat crown."""
    p = points.where(F.col("tree_id").isNotNull() & is_number(F.col("x")) & is_number(F.col("y")) & is_number(F.col("z")))
    above = p.join(bases, "tree_id").where(F.col("z") > F.col("crown_base_height"))
    kind = p.schema["tree_id"].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        h = hull_3d(f[["x", "y", "z"]].to_numpy())
        return pd.DataFrame({"tree_id": [f["tree_id"].iloc[0]], "crown_volume": [None if h is None else h[0]], "crown_surface": [None if h is None else h[1]]})

    h = _hull_points(above, 3).groupBy("tree_id").applyInPandas(run, f"tree_id {kind}, crown_volume double, crown_surface double")
    return bases.select("tree_id").join(h, "tree_id", "left")


def id_mismatches(trees: DataFrame, points: DataFrame) -> DataFrame:
    """(tree_id, missing_in): ids of the tree table without points, and of points without an entry; 0 and
    null are no trees."""
    t = trees.select("tree_id").where(F.col("tree_id").isNotNull()).distinct()
    p = points.select("tree_id").where(F.col("tree_id").isNotNull() & (F.col("tree_id") != 0)).distinct()
    return t.join(p, "tree_id", "left_anti").withColumn("missing_in", F.lit("points")).unionByName(p.join(t, "tree_id", "left_anti").withColumn("missing_in", F.lit("trees")))


def tree_attributes(trees: DataFrame, points: DataFrame) -> DataFrame:
    """One row per distinct row of ``trees`` (tree_id, x, y, z, radius, error), with height, crown_area,
    crown_base_height, crown_volume, diameter = 2 radius, and the hull ring.

    ``points`` has id, tree_id, x, y, z. Trees without points have null attributes; points without a tree
    entry are reported by ``id_mismatches`` and have no row here.
    """
    t = trees.distinct()
    known = points.join(t.select("tree_id").distinct(), "tree_id", "left_semi")
    base = crown_base_heights(known)
    out = t.join(tree_heights(known).select("tree_id", "height"), "tree_id", "left").join(crown_hulls(known), "tree_id", "left").join(base, "tree_id", "left").join(crown_volumes(known, base), "tree_id", "left")
    return out.withColumn("diameter", F.col("radius") * 2)


# -- stem detection --------------------------------------------------------------------------------------

def locate_trees(
    points: DataFrame, work: Workspace, res: float = 0.05, spacing: float = 0.0254, density: float = 0.2, sizes: tuple[float, float, float] = (0.333, 0.166, 0.5),
    verticality: float = 0.6666, low: float = 0.6666, high: float = 2.0, least_area: float = 0.025, method: str = "ransac", max_radius: float = 0.5, deviation: float = 0.25,
    n: int = 20, inliers: float = 0.9, conf: float = 0.99, seed: int = 0, grow: float = 1.5, shrink: float = 1.475, margin: float = 0.075,
) -> DataFrame:
    """(tree_id, x, y, z, radius, error): stems found in a cloud (id, x, y, z) with normalised heights.

    Decimate, slice, keep what is dense and vertical on a common grid, close and intersect both shapes,
    filter shapes by their height statistics, put a circle around each, take the vertical points in the
    circles and fit cylinders in three nested slices; the mean of each tree's fits is its row. ``sizes``
    are the radii for verticality and for the small and the large disc. All rasters start at the origin.
    """
    if method not in ("ransac", "irls"):
        raise ValueError("method must be ransac or irls")
    ok = is_number(F.col("x")) & is_number(F.col("y")) & is_number(F.col("z"))
    cloud = work.put("cloud", decimate_random(points.where(ok).select("id", "x", "y", "z"), spacing, seed))
    cut = height_slice(cloud, low, high)
    upright = eigen_metrics(cut, sizes[0], curvature=False).select("id", F.col("Verticality").alias("v"))
    dense = relative_density(cut, sizes[1], sizes[2]).select("id", "relative_density")
    p = work.put("slice", cut.join(upright, "id", "left").join(dense, "id", "left").withColumn("v", clean_number(F.col("v"), 0.5)))
    stats = F.percentile("z", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    pixels = work.put("pixels", grid.pixel_metrics(p, {"dens": F.percentile("relative_density", F.lit(0.5)), "vert": F.percentile("v", F.lit(0.5)), "sd": F.stddev_samp("v"), "z": stats}, res))

    def shapes(column: str, threshold: float) -> DataFrame:
        marked = grid.classify(pixels.select("row_", "col_", F.col(column).alias("value")), [(0.0, threshold, 0.0), (threshold, 1.0, 1.0)]).where("value = 1")
        parts = work.put(column + "-parts", grid.connected_cells(marked, work))
        wide = work.put(column + "-wide", parts.join(grid.areas(parts, res).where(F.col("area") > least_area), "label", "left_semi"))
        filled = work.put(column + "-filled", grid.fill_holes(wide, work))
        return work.put(column, grid.close_cells(filled, grow / res, shrink / res))

    vert, dens = shapes("vert", verticality), shapes("dens", density)
    both = grid.intersect_labels(vert, dens, res).where(F.col("area") > least_area)
    cells = vert.withColumnRenamed("label", "label_a").join(dens.withColumnRenamed("label", "label_b"), ["row_", "col_"]).join(both.select("label_a", "label_b"), ["label_a", "label_b"], "left_semi")
    cells = work.put("both", cells.select("row_", "col_", F.concat_ws("/", "label_a", "label_b").alias("label")))
    q = lambda c, share: F.bround(F.percentile(c, F.lit(share)), 2)
    zones = grid.zonal(cells, pixels.withColumn("z1", F.col("z")[0]).withColumn("z50", F.col("z")[1]).withColumn("z99", F.col("z")[2]), {"SDvert": q("sd", 0.5), "low": q("z1", 0.05), "high": q("z99", 0.99), "mid": q("z50", 0.5)})
    canopy = grid.pixel_metrics(cloud, {"top": F.max("z")}, 0.1)
    fine = cells.select("label", cell(F.col("row_") * res + res / 2, 0.1).cast("int").alias("row_"), cell(F.col("col_") * res + res / 2, 0.1).cast("int").alias("col_")).distinct()
    tops = grid.zonal(fine, canopy, {"top": F.max("top")})
    tall = (F.col("high") - F.col("low") > 0.5 * (high - low)) & (F.col("low") < 1.25 * low) & (F.col("top") >= high) & (F.col("SDvert") < deviation)
    kept = zones.join(tops, "label").where(tall).select("label")
    rim = grid.rim_cells(cells.join(kept, "label", "left_semi")).select("label", grid.pack(F.col("row_"), F.col("col_")).alias("id"), ((F.col("col_") + 0.5) * res).alias("x"), ((F.col("row_") + 0.5) * res).alias("y"))
    discs = work.put("discs", landau_groups(rim, "label").select(F.xxhash64("label").alias("circle"), "cx", "cy", "r"))
    stems = points_in_circles(p, discs, margin).join(p.where(F.col("v") >= verticality), "id").select(F.col("circle").alias("stem"), "id", "x", "y", "z")
    windows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in enumerate(((low, high), (1.1 - (1.1 - low) / 2, 1.6 + (high - 1.6) / 2), (1.1, 1.6)))])
    nested = work.put("nested", stems.withColumn("w", F.explode(windows)).where(F.col("z").between(F.col("w.a"), F.col("w.b"))).select(F.concat_ws("/", "stem", "w.k").alias("part"), "stem", "id", "x", "y", "z"))
    fits = fit_groups(nested, "part", method, n=n, inliers=inliers, conf=conf, seed=seed).where((F.abs("radius") <= max_radius) & F.col("err").isNotNull() & ~F.isnan("err"))
    mean = fits.withColumn("stem", F.substring_index("part", "/", 1).cast("long")).groupBy("stem").agg(F.avg("px").alias("x"), F.avg("py").alias("y"), F.avg("pz").alias("z"), F.avg("radius").alias("radius"), F.avg("err").alias("error"))
    mean = work.put("trees", mean)
    # small numbers in order of place; ranges first, so that no task numbers all trees
    order = mean.repartitionByRange("x", "y", "stem").sortWithinPartitions("x", "y", "stem").withColumn("_i", F.monotonically_increasing_id())
    order = work.put("order", order.withColumn("_p", F.shiftright("_i", 33)))
    # one row per task of the sort
    per = order.groupBy("_p").agg(F.count("*").alias("n"))
    skip = per.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("skip"))
    numbered = order.join(skip, "_p")
    return numbered.select((F.col("skip") + F.col("_i") - F.shiftleft(F.col("_p"), 33) + 1).cast("int").alias("tree_id"), "x", "y", "z", "radius", "error")


# -- segmentation ----------------------------------------------------------------------------------------

def nudge_seeds(seeds: DataFrame, longest: float) -> DataFrame:
    """Seeds thicker than the longest link are moved by half their radius along y, so that the graph's links
    reach from them to the stem's surface: down for those above the mean y, up for the others."""
    mid = seeds.agg(F.avg("y").alias("_mid"))
    r = F.col("radius")
    moved = F.when(r > longest, F.col("y") - F.signum(F.col("y") - F.col("_mid") + 1e-12) * r / 2).otherwise(F.col("y"))
    return seeds.join(F.broadcast(mid), F.lit(True)).withColumn("y", moved).drop("_mid")


def segment_points(
    points: DataFrame, trees: DataFrame, work: Workspace, k: int = 50, longest: float = 0.33, scaled: bool = False, low: float = 0.5, high: float = 2.0,
    formula: str | None = None, spacing: float | None = 0.1, dense: bool = False, snap: float | None = None, seed: int = 0, breast_height: float = 1.3,
) -> DataFrame:
    """(id, x, y, z, tree_id[, nnd]): points with the tree that reaches them first through the neighbour graph.

    ``points`` has id, x, y, z, classification; ``trees`` tree_id, x, y, radius. Without ``dense`` the rows
    are those of the thinned cloud without ground, 0 for unreached points and null for labels that no tree
    claims in the slice. With ``dense`` every point takes the label of the nearest thinned point, 0 beyond
    1.25 times the spacing (or ``snap``) and for ground; ``nnd`` is the distance, null beyond. An empty tree
    table leaves all points 0. Ids of points may be below 0, but must fit into 63 bits.
    """
    ok = is_number(F.col("x")) & is_number(F.col("y")) & is_number(F.col("z"))
    all_points = points.where(ok).select("id", "x", "y", "z", "classification")
    thin = all_points if spacing is None else decimate_random(all_points, spacing, seed)
    thin = work.put("thin", without_ground(thin).drop("classification"))
    radius = clean_number(F.col("radius"), 0.01)
    t = trees.select(F.col("tree_id").cast("long").alias("tree_id"), "x", "y", radius.alias("radius")).where(F.col("tree_id").isNotNull() & is_number(F.col("x")) & is_number(F.col("y"))).groupBy("tree_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("radius").alias("radius"))
    t = work.put("seeds", nudge_seeds(t, longest).withColumn("z", F.lit(breast_height)))
    # seeds are vertices beside the points: even numbers are points, odd ones seeds
    point, vertex = F.col("id") * 2, F.col("tree_id") * 2 + 1
    both = thin.select(point.alias("id"), "x", "y", "z").unionByName(t.select(vertex.alias("id"), "x", "y", "z"))
    edges = work.put("edges", knn_edges(both, k, longest))
    label = first_seeds(edges, t.select(vertex.alias("node"), "radius"), thin.select(point.alias("node")), work, formula, scaled)
    label = work.put("labels", label.select(F.shiftright("node", 1).alias("id"), "seed"))
    # seeds are odd, so the number 0 of unreached points is no seed
    sparse = thin.join(label, "id")
    # a tree claims the label of the slice point nearest to it, however far that is
    claim = nearest(t.select(F.col("tree_id").alias("id"), "x", "y", "z"), height_slice(sparse, low, high), longest, work)
    claim = claim.join(sparse.select(F.col("id").alias("r_id"), "seed"), "r_id").where("seed <> 0").groupBy("seed").agg(F.min("l_id").alias("tree_id"))
    named = sparse.join(claim, "seed", "left").select("id", "x", "y", "z", F.when(F.col("seed") == 0, F.lit(0)).otherwise(F.col("tree_id")).cast("int").alias("tree_id"))
    if not dense:
        return named
    reach = snap or (1.25 * spacing if spacing else None)
    if reach is None:
        raise ValueError("dense output without a spacing needs a snap radius")
    named = work.put("named", named)
    near = nearest_within(all_points, named, reach).join(named.select(F.col("id").alias("r_id"), "tree_id", F.lit(True).alias("hit")), "r_id").select(F.col("l_id").alias("id"), "tree_id", "hit", F.col("dist").alias("nnd"))
    out = all_points.join(near, "id", "left")
    none = F.col("hit").isNull() | (F.coalesce("classification", F.lit(0)) == 2) & F.col("tree_id").isNotNull()
    return out.select("id", "x", "y", "z", F.when(none, F.lit(0)).otherwise(F.col("tree_id")).alias("tree_id"), "nnd")


__all__ = ["crown_base_heights", "crown_hulls", "crown_volumes", "id_mismatches", "key_quantiles", "locate_trees", "segment_points", "tree_attributes", "tree_heights"]
