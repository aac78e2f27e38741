"""Queries of the point-cloud and raster operators, with their SQL, over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.palette import ramp
from ..operators import color, eigen, fits, graph, grid, hough, patches, sampling, spatial, trees
from ..operators.points import usable_points
from ..runtime import Workspace, pick, table
from ..sources.tables import rotation_frames

SMALL, LARGE = 0.1665, 0.5005
DIRECTIONS = 60
SPHERE = 0.2505
#: Links between neighbours of stems stand well below this.
LONGEST = 0.3305


def cloud(spark, sf_dir):
    """(id, x, y, z, ...) of the usable points."""
    las = table(spark, sf_dir, "las")
    return usable_points(las, tree_id="treeID", classification="Classification", verticality="verticality", scan_id="scan_id").withColumnRenamed("point_id", "id")


def seeds(spark, sf_dir):
    """(tree_id, x, y, z, radius, error): one row per tree, radius 0.01 where it is missing."""
    t = pick(table(spark, sf_dir, "treelocs"), tree_id="TreeID", x="X", y="Y", z="Z", radius="Radius", error="Error").distinct()
    return t.groupBy("tree_id").agg(*[F.min(c).alias(c) for c in ("x", "y", "z")], F.min(sampling.clean_number(F.col("radius"), 0.01)).alias("radius"), F.min("error").alias("error"))


def slice_of(spark, sf_dir, low=0.5, high=2.0):
    return sampling.height_slice(cloud(spark, sf_dir), low, high)


def stems(spark, sf_dir):
    """Points with a tree, catch-all segments included."""
    return cloud(spark, sf_dir).where("tree_id is not null")


def habitat(spark, sf_dir):
    return grid.clean_raster(table(spark, sf_dir, "habitat_raster"))


def _r(c, n=6):
    return F.round(c, n).alias(c)


def _off_ties(c):
    """Seven decimals; the shift keeps sums of whole millimetres away from the halves, where noise decides."""
    return F.round(c + 3e-11, 7)


def count_in_disc(spark, sf_dir, points=cloud):
    return spatial.count_in_disc(points(spark, sf_dir), LARGE)


def count_in_sphere(spark, sf_dir, points=cloud):
    return spatial.count_in_sphere(points(spark, sf_dir), SPHERE)


def relative_density(spark, sf_dir):
    """Flagship: density of the slice, as a raster of medians."""
    s = slice_of(spark, sf_dir)
    d = spatial.relative_density(s, SMALL, LARGE)
    out = grid.pixel_metrics(s.join(d, "id"), {"n": F.count("*"), "density": F.percentile("relative_density", F.lit(0.5))}, 1.0)
    return out.select("row_", "col_", "n", _r("density"))


def height_slice(spark, sf_dir):
    return slice_of(spark, sf_dir).select("id", "z")


def ground_filter(spark, sf_dir):
    return sampling.without_ground(cloud(spark, sf_dir)).select("id", "z")


def voxel_first(spark, sf_dir):
    return sampling.decimate_first(cloud(spark, sf_dir), 0.5).select("id")


def voxel_random(spark, sf_dir):
    return sampling.decimate_random(cloud(spark, sf_dir), 0.5, seed=7).select("id", "x", "y", "z")


def voxel_index(spark, sf_dir):
    return sampling.voxel_index(cloud(spark, sf_dir), 0.5)


def bernoulli_sample(spark, sf_dir):
    return sampling.bernoulli(cloud(spark, sf_dir), 0.25, seed=3).select("id")


def crop_disc(spark, sf_dir):
    return sampling.crop(cloud(spark, sf_dir), 100.0, 100.0, 60.0005).select("id")


def recentred(spark, sf_dir):
    return sampling.recentre(cloud(spark, sf_dir)).select("id", _r("x"), _r("y"))


def slices(spark, sf_dir):
    return sampling.slices(cloud(spark, sf_dir), 0.5, 0.25, 3.25).groupBy("slice").agg(F.count("*").alias("n"))


def pixel_metrics(spark, sf_dir):
    q = F.percentile("z", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    p = grid.pixel_metrics(cloud(spark, sf_dir), {"n": F.count("*"), "top": F.max("z"), "q": q, "sd": F.stddev_samp("z")}, 5.0)
    return p.select("row_", "col_", "n", "top", F.round(F.col("q")[0], 6).alias("z01"), F.round(F.col("q")[1], 6).alias("z50"), F.round(F.col("q")[2], 6).alias("z99"), _r("sd"))


def neighborhood_covariance(spark, sf_dir, points=cloud):
    s = points(spark, sf_dir)
    c = eigen.covariances(spatial.radius_pairs(s, s, LARGE))
    return c.select("id", "n", *[_off_ties(F.col(x)).alias(x) for x in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")])


def eigen_density(spark, sf_dir, points=cloud):
    m = eigen.eigen_metrics(points(spark, sf_dir), LARGE, curvature=False)
    return m.select("id", _r("SurfaceDensity"), _r("VolumeDensity"), "NumNeighbors")


def eigen_invariants(spark, sf_dir, points=cloud):
    """Sum, sum of products and product of the eigenvalues, which SQL gets without an eigensolver."""
    m = eigen.eigen_metrics(points(spark, sf_dir), LARGE, curvature=False)
    a, b, c = F.col("eLargest"), F.col("eMedium"), F.col("eSmallest")
    return m.select("id", _off_ties(F.col("eSum")).alias("eSum"), _off_ties(a * b + a * c + b * c).alias("minors"), _off_ties(a * b * c).alias("det"))


def eigen_metrics_full(spark, sf_dir):
    return eigen.eigen_metrics(cloud(spark, sf_dir), LARGE)


def knn_within(spark, sf_dir, points=cloud):
    return spatial.knn_within(points(spark, sf_dir), 5, LARGE).select("l_id", "r_id", "rank", _r("dist"))


def nearest_seed(spark, sf_dir):
    """Nearest slice point of each tree, however far."""
    t = seeds(spark, sf_dir).select(F.col("tree_id").alias("id"), "x", "y", "z")
    return spatial.nearest(t, slice_of(spark, sf_dir), 0.5005, Workspace(spark, "nearest")).select("l_id", "r_id", _r("dist"))


def point_in_disc(spark, sf_dir):
    t = seeds(spark, sf_dir).select(F.col("tree_id").alias("circle"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("radius").alias("r"))
    return spatial.points_in_circles(cloud(spark, sf_dir), t, 0.0755)


def tree_ids_from_map(spark, sf_dir):
    t = seeds(spark, sf_dir).select(F.col("tree_id").alias("order"), "tree_id", "x", "y")
    return spatial.ids_from_map(cloud(spark, sf_dir), t, 2.5005)


def graph_edges(spark, sf_dir):
    return graph.undirected(graph.knn_edges(cloud(spark, sf_dir), 50, LONGEST)).select("src", "dst", _r("w"))


def graph_degree(spark, sf_dir):
    return graph.degrees(graph.knn_edges(cloud(spark, sf_dir), 50, LONGEST))


def connected_points(spark, sf_dir, points=cloud):
    work = Workspace(spark, "components")
    s = work.put("slice", points(spark, sf_dir))
    e = spatial.radius_pairs(s, s, LONGEST).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    return graph.components(work.put("pairs", e), work, s.select(F.col("id").alias("node")))


def shortest_path_assign(spark, sf_dir):
    """Points to the seed that reaches them first through the graph; the seed of a tree is its lowest id."""
    work = Workspace(spark, "paths")
    s = work.put("cloud", cloud(spark, sf_dir))
    seed = work.put("seed", s.where("tree_id is not null").groupBy("tree_id").agg(F.min("id").alias("node")).select("node", F.lit(0.1).alias("radius")))
    e = work.put("knn", graph.knn_edges(s, 8, 1.0005))
    d = graph.first_seeds(e, seed, s.select(F.col("id").alias("node")), work)
    return d.select("node", "seed", F.round("dist", 6).alias("dist"))


def metabolic_scale(spark, sf_dir):
    t = seeds(spark, sf_dir)
    return t.select("tree_id", F.round(graph.scale_column(None, "radius"), 6).alias("scale"), F.round(graph.scale_column("x/2 + sqrt(x)", "radius"), 6).alias("own"))


def circle_algebraic(spark, sf_dir):
    c = fits.algebraic_circles(stems(spark, sf_dir), "tree_id").where("n >= 6")
    return c.select("tree_id", _r("cx", 4), _r("cy", 4), _r("r", 4), "n")


def circle_landau(spark, sf_dir):
    return fits.landau_groups(stems(spark, sf_dir), "tree_id")


def circle_irls(spark, sf_dir):
    return fits.fit_circles(stems(spark, sf_dir), "tree_id", "irls")


def circle_ransac(spark, sf_dir):
    return fits.fit_circles(stems(spark, sf_dir), "tree_id", "ransac", n=5)


def knn_distance_statistics(spark, sf_dir):
    k = spatial.knn_within(cloud(spark, sf_dir), 5, LARGE).groupBy(F.col("l_id").alias("id")).agg(F.sort_array(F.collect_list("dist")).alias("distances"))
    d = spatial.distance_statistics(k)
    return d.select("id", *[_r(c) for c in ("Median", "Min", "Max", "Mean")])


def _cylinders(method, **options):
    def run(spark, sf_dir):
        return fits.fit_groups(stems(spark, sf_dir), "tree_id", method, **options)

    run.__name__ = f"cylinder_{method}"
    return run


def tree_height(spark, sf_dir):
    return trees.tree_heights(cloud(spark, sf_dir)).select("tree_id", "x", "y", "height")


def crown_base_height(spark, sf_dir):
    return trees.crown_base_heights(cloud(spark, sf_dir)).select("tree_id", _r("crown_base_height"))


def tree_id_mismatch(spark, sf_dir):
    return trees.id_mismatches(seeds(spark, sf_dir), cloud(spark, sf_dir))


def crown_area(spark, sf_dir):
    return trees.crown_hulls(cloud(spark, sf_dir)).select("tree_id", _r("crown_area", 7))


def tree_attributes(spark, sf_dir):
    return trees.tree_attributes(seeds(spark, sf_dir), cloud(spark, sf_dir)).drop("ring")


def raster_reclass(spark, sf_dir):
    return grid.classify(habitat(spark, sf_dir), [(float("-inf"), 10.0, None), (10.0, float("inf"), 1.0)], right=False)


def focal_max(spark, sf_dir):
    return grid.focal_max(habitat(spark, sf_dir), 2.0)


def patchmorph(spark, sf_dir):
    return patches.patchmorph(table(spark, sf_dir, "habitat_raster"), [5.0, 10.0], [2.0, 3.0], [2.0, 4.0], Workspace(spark, "patches"))


def sum_by_suitability(spark, sf_dir):
    return patches.sum_by_suitability(patchmorph(spark, sf_dir), [5.0, 10.0])


def _suitable(spark, sf_dir):
    return habitat(spark, sf_dir).where("value >= 10")


def connected_cells(spark, sf_dir):
    return grid.connected_cells(_suitable(spark, sf_dir), Workspace(spark, "cells"))


def polygon_area(spark, sf_dir):
    return grid.areas(connected_cells(spark, sf_dir), 1.0)


def filled_holes(spark, sf_dir):
    work = Workspace(spark, "holes")
    return grid.fill_holes(work.put("labels", grid.connected_cells(_suitable(spark, sf_dir), work)), work)


def closed_cells(spark, sf_dir):
    return grid.close_cells(connected_cells(spark, sf_dir), 2.0, 1.0)


def zonal_stats(spark, sf_dir):
    z = grid.zonal(connected_cells(spark, sf_dir), habitat(spark, sf_dir), {"n": F.count("*"), "mean": F.avg("value"), "mid": F.percentile("value", F.lit(0.5))})
    return z.select("label", "n", _r("mean"), _r("mid"))


def extract_cells(spark, sf_dir):
    return grid.extract(cloud(spark, sf_dir), habitat(spark, sf_dir), 10.0)


def color_attr(spark, sf_dir):
    return color.colorize(cloud(spark, sf_dir), "attr", "verticality", ["black", "red", "white"])


def color_raster(spark, sf_dir):
    h = habitat(spark, sf_dir)
    return color.by_raster(cloud(spark, sf_dir), h, h.withColumn("value", F.col("value") / 2), h.withColumn("value", F.col("value") / 4), 10.0)


def _blend(method):
    def run(spark, sf_dir):
        c = cloud(spark, sf_dir)
        a = c.select("id", *[F.pmod(F.col("id") * k, F.lit(256)).cast("int").alias(n) for k, n in ((7, "R"), (11, "G"), (13, "B"))])
        b = c.select("id", *[F.pmod(F.col("id") * k, F.lit(256)).cast("int").alias(n) for k, n in ((3, "R"), (5, "G"), (17, "B"))])
        return color.blend(a, b, method, 0.25)

    run.__name__ = f"blend_{method}"
    return run


def pcv(spark, sf_dir):
    return color.sky_visibility(cloud(spark, sf_dir), 1.0005, DIRECTIONS).select("id", F.round("value", 6).alias("value"))


def ssao(spark, sf_dir):
    return color.screen_occlusion(cloud(spark, sf_dir), 0.1).select("id", F.round("value", 6).alias("value"))


def depth_map(spark, sf_dir):
    return color.depth_map(cloud(spark, sf_dir), 2.0)


def hough_votes(spark, sf_dir):
    p = hough.pixel_counts(stems(spark, sf_dir), 0.05, ("tree_id",))
    return hough.hough_votes(p, 0.25, 0.05, 0.1, ("tree_id",))


def hough_centre(spark, sf_dir):
    return hough.single_centre(hough_votes(spark, sf_dir), ("tree_id",))


def stem_layers(spark, sf_dir):
    return hough.stem_layers(stems(spark, sf_dir))


def hough_centres(spark, sf_dir):
    """Centres over the whole slice, thinned to one per surroundings."""
    p = hough.pixel_counts(cloud(spark, sf_dir), 0.05)
    return hough.merge_centres(hough.hough_votes(p, 0.25, 0.05), 0.05, 0.25)


def _discs(spark, sf_dir):
    d = stem_layers(spark, sf_dir).where("votes > 0")
    return d.select((F.col("tree_id").cast("long") * 1000 + F.col("layer")).alias("disc"), "layer", "x", "y", "radius", "votes")


def disc_groups(spark, sf_dir):
    return hough.group_discs(_discs(spark, sf_dir), 0.5, 2)


def tree_map(spark, sf_dir):
    d = Workspace(spark, "discs").put("discs", _discs(spark, sf_dir))
    return hough.tree_map(d, hough.group_discs(d, 0.5, 2))


def normal_votes(spark, sf_dir):
    s = cloud(spark, sf_dir)
    n = eigen.eigen_metrics(s, LARGE, curvature=False).where("NumNeighbors >= 3").select("id", F.col("Nx").alias("nx"), F.col("Ny").alias("ny"), F.col("Nz").alias("nz"))
    return hough.normal_votes(s.select("id", "x", "y", "z").join(n, "id"), 0.05, 0.25)


def _segments(spark, sf_dir):
    """Points of all trees in segments of half a metre, with the radius that the layers voted for."""
    layers = Workspace(spark, "layers").put("layers", stem_layers(spark, sf_dir)).select("tree_id", F.col("layer").alias("segment"), F.col("radius").alias("hough_radius"))
    p = sampling.slices(stems(spark, sf_dir), 0.5, 0.0).withColumnRenamed("slice", "segment")
    return p.join(layers, ["tree_id", "segment"]).select("tree_id", "segment", "hough_radius", "id", "x", "y", "z")


def stem_fits(spark, sf_dir):
    return hough.stem_fits(_segments(spark, sf_dir), method="irls")


def stem_circles(spark, sf_dir):
    return hough.stem_fits(_segments(spark, sf_dir), form="circle")


def crown_volume(spark, sf_dir):
    c = stems(spark, sf_dir)
    return trees.crown_volumes(c, trees.crown_base_heights(c)).select("tree_id", _r("crown_volume"), _r("crown_surface"))


def segment_dense(spark, sf_dir):
    return trees.segment_points(cloud(spark, sf_dir), seeds(spark, sf_dir), Workspace(spark, "segment"), longest=LONGEST, dense=True, scaled=True)


def tile_bounds(spark, sf_dir):
    return grid.bounding_box(cloud(spark, sf_dir), 1.0)


def pixel_counts(spark, sf_dir):
    return hough.pixel_counts(stems(spark, sf_dir), 0.05, ("tree_id",))


def locate_trees(spark, sf_dir):
    return trees.locate_trees(cloud(spark, sf_dir), Workspace(spark, "locate"))


def segment_points(spark, sf_dir):
    return trees.segment_points(cloud(spark, sf_dir), seeds(spark, sf_dir), Workspace(spark, "segment"), longest=LONGEST)


def rotation(spark, sf_dir):
    f = rotation_frames(cloud(spark, sf_dir))
    return f.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.min("u"), 4).alias("u_min"), F.round(F.max("u"), 4).alias("u_max"), F.round(F.min("v"), 4).alias("v_min"), F.round(F.max("depth"), 4).alias("depth_max"))


_NAMES = """count_in_disc count_in_sphere relative_density height_slice ground_filter voxel_first voxel_random voxel_index bernoulli_sample
crop_disc recentred slices pixel_metrics neighborhood_covariance eigen_density eigen_invariants eigen_metrics_full knn_within nearest_seed
point_in_disc tree_ids_from_map graph_edges graph_degree connected_points shortest_path_assign metabolic_scale circle_algebraic circle_landau circle_irls circle_ransac knn_distance_statistics
tree_height crown_base_height tree_id_mismatch crown_area tree_attributes raster_reclass focal_max patchmorph sum_by_suitability
connected_cells polygon_area filled_holes closed_cells zonal_stats extract_cells color_attr color_raster pcv ssao depth_map
hough_votes hough_centre hough_centres disc_groups tree_map normal_votes stem_fits stem_circles crown_volume segment_dense tile_bounds stem_layers pixel_counts locate_trees segment_points rotation""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
QUERIES |= {f"blend_{m}": _blend(m) for m in color.BLENDS}
QUERIES |= {"cylinder_ransac": _cylinders("ransac", n=10), "cylinder_irls": _cylinders("irls"), "cylinder_nm": _cylinders("nm"), "cylinder_bf": _cylinders("bf")}

_CLOUD = """u AS (
  SELECT point_id AS id, min(X) AS x, min(Y) AS y, min(Z) AS z, min("treeID") AS tree_id, min(Classification) AS classification, min(verticality) AS verticality
  FROM las
  WHERE X IS NOT NULL AND Y IS NOT NULL AND Z IS NOT NULL AND NOT isnan(X) AND NOT isnan(Y) AND NOT isnan(Z)
    AND (Classification IS NULL OR Classification <> 7) AND point_id IS NOT NULL
  GROUP BY point_id)"""
_SLICE = _CLOUD + ",\ns AS (SELECT * FROM u WHERE z BETWEEN 0.5 AND 2.0)"
_STEMS = _CLOUD + ",\nst AS (SELECT * FROM u WHERE tree_id IS NOT NULL)"
_SEEDS = """t0 AS (SELECT DISTINCT * FROM treelocs),
t AS (SELECT TreeID AS tree_id, min(X) AS x, min(Y) AS y, min(Z) AS z, min(CASE WHEN Radius IS NULL OR isnan(Radius) THEN 0.01::DOUBLE ELSE Radius END) AS radius FROM t0 GROUP BY TreeID)"""
_HABITAT = "h AS (SELECT row_, col_, max(CASE WHEN NOT isnan(value) THEN value END) AS value FROM habitat_raster GROUP BY row_, col_)"


def _pairs(a: str, b: str, r: float, dims: int = 3) -> str:
    """l_id, r_id, d*, d2 of rows of a and b within r: a hash join on cells of width r with its 3x3 around."""
    d = "(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)" + (" + (b.z - a.z) * (b.z - a.z)" if dims == 3 else "")
    return f"""off AS (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
near AS (SELECT b.*, floor(b.x / {r}) + i AS cx, floor(b.y / {r}) + j AS cy FROM {b} b, off),
pairs AS (SELECT a.id AS l_id, b.id AS r_id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, {d} AS d2
  FROM {a} a JOIN near b ON floor(a.x / {r}) = b.cx AND floor(a.y / {r}) = b.cy WHERE {d} <= {r}::DOUBLE * {r}::DOUBLE)"""


_COV = ", ".join(f"avg(d{a} * d{b}) - avg(d{a}) * avg(d{b}) AS c{a}{b}" for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")))
_CLEAN = "CAST(greatest(0, least(255, floor(round({}, 9)))) AS INT)"


def _blend_sql(method: str) -> str:
    f = {
        "alpha": "{a} * (1 - 0.25::DOUBLE) + {b} * 0.25::DOUBLE", "multiply": "{a} * {b} / 255", "screen": "255 - (255 - {a}) * (255 - {b}) / 255",
        "overlay": "CASE WHEN {a} < 128 THEN 2 * {a} * {b} / 255 ELSE 255 - 2 * (255 - {a}) * (255 - {b}) / 255 END",
    }[method]
    ch = [(("R", 7, 3), ("G", 11, 5), ("B", 13, 17))[i] for i in range(3)]
    cols = ", ".join(_CLEAN.format(f.format(a=f"(id * {p} % 256)::DOUBLE", b=f"(id * {q} % 256)::DOUBLE")) + f' AS "{n}"' for n, p, q in ch)
    return f"WITH {_CLOUD}\nSELECT id, {cols} FROM u"


def _disc(radius: float, closed: bool) -> str:
    return "VALUES " + ", ".join(f"({i}, {j})" for i, j in grid.disc_offsets(radius, closed))


def _patch_sql() -> str:
    """Per combination: spread, complement, spread, twice."""
    parts, out = [], []
    for s in (5, 10):
        parts.append(f"s{s} AS (SELECT row_, col_ FROM h WHERE value >= {s})")
        for p in (2, 4):
            parts.append(f"n{s}_{p} AS (SELECT DISTINCT row_ + i AS row_, col_ + j AS col_ FROM s{s}, ({_disc(p / 2, False)}) o(i, j))")
            parts.append(f"f{s}_{p} AS (SELECT row_, col_ FROM h ANTI JOIN n{s}_{p} USING (row_, col_))")
            parts.append(f"a{s}_{p} AS (SELECT row_, col_ FROM h SEMI JOIN (SELECT DISTINCT row_ + i AS row_, col_ + j AS col_ FROM f{s}_{p}, ({_disc(p, True)}) o(i, j)) q USING (row_, col_))")
            for g in (2, 3):
                k = f"{s}_{p}_{g}"
                parts.append(f"m{k} AS (SELECT DISTINCT row_ + i AS row_, col_ + j AS col_ FROM a{s}_{p}, ({_disc(g / 2, False)}) o(i, j))")
                parts.append(f"e{k} AS (SELECT row_, col_ FROM h ANTI JOIN m{k} USING (row_, col_))")
                parts.append(f"b{k} AS (SELECT row_, col_, 1.0::DOUBLE AS value FROM h SEMI JOIN (SELECT DISTINCT row_ + i AS row_, col_ + j AS col_ FROM e{k}, ({_disc(g, True)}) o(i, j)) q USING (row_, col_))")
                out.append(f"SELECT {s}::DOUBLE AS suit, {g}::DOUBLE AS gap, {p}::DOUBLE AS spur, h.row_, h.col_, b.value FROM h LEFT JOIN b{k} b USING (row_, col_)")
    return f"WITH {_HABITAT},\n" + ",\n".join(parts) + "\n, patches AS (" + "\nUNION ALL ".join(out) + ")\n"


_PACK = "((row_ + 1073741824)::BIGINT * 2147483648 + col_ + 1073741824)"
_CELLS = f"""{_HABITAT},
c AS (SELECT row_, col_, {_PACK} AS node FROM h WHERE value >= 10),
l AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM c a JOIN c b ON (a.row_ = b.row_ AND abs(a.col_ - b.col_) = 1) OR (a.col_ = b.col_ AND abs(a.row_ - b.row_) = 1)),
reach(n, m) AS (SELECT node, node FROM c UNION SELECT r.n, l.b FROM reach r JOIN l ON r.m = l.a),
cells AS MATERIALIZED (SELECT c.row_, c.col_, q.label FROM c JOIN (SELECT m, min(n) AS label FROM reach GROUP BY m) q ON c.node = q.m)"""


def _ramp_sql(i: int) -> str:
    return "[" + ", ".join(str(c[i]) for c in ramp(["black", "red", "white"])) + "]"


_PCV = ", ".join(f"max(CASE WHEN (dx * {math.cos(2 * math.pi * i / DIRECTIONS)!r}::DOUBLE + dy * {math.sin(2 * math.pi * i / DIRECTIONS)!r}::DOUBLE) / h > 0.7 THEN atan2(dz, h) END) AS a{i}" for i in range(DIRECTIONS))
_KNN_EDGES = "e AS (SELECT l_id, r_id, sqrt(d2) AS w FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY d2, r_id) AS r FROM pairs WHERE l_id <> r_id) WHERE r <= 50),\nun AS (SELECT src, dst, min(w) AS w FROM (SELECT l_id AS src, r_id AS dst, w FROM e UNION ALL SELECT r_id, l_id, w FROM e) GROUP BY src, dst)"

SQL = {
    "count_in_disc": f"WITH {_CLOUD},\n{_pairs('u', 'u', LARGE, 2)}\nSELECT l_id AS id, count(*) AS n FROM pairs GROUP BY l_id",
    "count_in_sphere": f"WITH {_CLOUD},\n{_pairs('u', 'u', SPHERE)}\nSELECT l_id AS id, count(*) AS n FROM pairs GROUP BY l_id",
    "relative_density": f"""WITH {_SLICE},
{_pairs('s', 's', LARGE, 2)},
d AS (SELECT l_id AS id, sum(CASE WHEN d2 <= {SMALL}::DOUBLE * {SMALL}::DOUBLE THEN 1 ELSE 0 END)::DOUBLE / count(*) AS density FROM pairs GROUP BY l_id)
SELECT CAST(floor(y) AS INT) AS row_, CAST(floor(x) AS INT) AS col_, count(*) AS n, round(quantile_cont(density, 0.5), 6) AS density FROM s JOIN d USING (id) GROUP BY ALL""",
    "height_slice": f"WITH {_SLICE}\nSELECT id, z FROM s",
    "ground_filter": f"WITH {_CLOUD}\nSELECT id, z FROM u WHERE classification <> 2 AND z > 1.0::DOUBLE / 3",
    "voxel_first": f"WITH {_CLOUD}\nSELECT min(id) AS id FROM u GROUP BY floor(x / 0.5), floor(y / 0.5), floor(z / 0.5)",
    "voxel_index": f"WITH {_CLOUD},\nlow AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM u)\nSELECT id, CAST(floor((x - x0) / 0.5) AS BIGINT) AS vx, CAST(floor((y - y0) / 0.5) AS BIGINT) AS vy, CAST(floor((z - z0) / 0.5) AS BIGINT) AS vz FROM u, low",
    "crop_disc": f"WITH {_CLOUD}\nSELECT id FROM u WHERE sqrt((x - 100) * (x - 100) + (y - 100) * (y - 100)) < 60.0005",
    "recentred": f"WITH {_CLOUD},\nm AS (SELECT (min(x) + max(x)) / 2 AS x0, (min(y) + max(y)) / 2 AS y0 FROM u)\nSELECT id, round(x - x0, 6) AS x, round(y - y0, 6) AS y FROM u, m",
    "slices": f"WITH {_CLOUD}\nSELECT CAST(floor((z - 0.25::DOUBLE) / 0.5::DOUBLE) AS INT) AS slice, count(*) AS n FROM u WHERE z >= 0.25 AND z < 3.25 GROUP BY 1",
    "pixel_metrics": f"""WITH {_CLOUD}
SELECT CAST(floor(y / 5) AS INT) AS row_, CAST(floor(x / 5) AS INT) AS col_, count(*) AS n, max(z) AS top, round(quantile_cont(z, 0.01), 6) AS z01, round(quantile_cont(z, 0.5), 6) AS z50, round(quantile_cont(z, 0.99), 6) AS z99, round(stddev_samp(z), 6) AS sd
FROM u GROUP BY 1, 2""",
    "neighborhood_covariance": f"WITH {_CLOUD},\n{_pairs('u', 'u', LARGE)},\nc AS (SELECT l_id AS id, count(*) AS n, {_COV} FROM pairs GROUP BY l_id)\nSELECT id, n, " + ", ".join(f"round({c} + 3e-11, 7) AS {c}" for c in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")) + " FROM c",
    "eigen_density": f"""WITH {_CLOUD},
{_pairs('u', 'u', LARGE)},
c AS (SELECT l_id AS id, count(*)::DOUBLE AS n FROM pairs GROUP BY l_id)
SELECT id, CASE WHEN n < 3 THEN 0 ELSE round(n / (pi() * {LARGE * LARGE!r}::DOUBLE), 6) END AS "SurfaceDensity", CASE WHEN n < 3 THEN 0 ELSE round(n / (4.0::DOUBLE / 3 * pi() * {LARGE**3!r}::DOUBLE), 6) END AS "VolumeDensity", n AS "NumNeighbors" FROM c""",
    "eigen_invariants": f"""WITH {_CLOUD},
{_pairs('u', 'u', LARGE)},
c AS (SELECT l_id AS id, count(*) AS n, {_COV} FROM pairs GROUP BY l_id)
SELECT id, CASE WHEN n < 3 THEN 0 ELSE round(cxx + cyy + czz + 3e-11, 7) END AS "eSum",
  CASE WHEN n < 3 THEN 0 ELSE round(cxx * cyy - cxy * cxy + cxx * czz - cxz * cxz + cyy * czz - cyz * cyz + 3e-11, 7) END AS minors,
  CASE WHEN n < 3 THEN 0 ELSE round(cxx * (cyy * czz - cyz * cyz) - cxy * (cxy * czz - cyz * cxz) + cxz * (cxy * cyz - cyy * cxz) + 3e-11, 7) END AS det FROM c""",
    "knn_within": f"WITH {_CLOUD},\n{_pairs('u', 'u', LARGE)}\nSELECT l_id, r_id, CAST(r AS INT) AS rank, round(sqrt(d2), 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY d2, r_id) AS r FROM pairs WHERE l_id <> r_id) WHERE r <= 5",
    "knn_distance_statistics": f"""WITH {_CLOUD},
{_pairs('u', 'u', LARGE)},
k AS (SELECT l_id AS id, list(sqrt(d2) ORDER BY d2) AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY d2, r_id) AS r FROM pairs WHERE l_id <> r_id) WHERE r <= 5 GROUP BY l_id),
q AS (SELECT id, v[1:(CASE WHEN v[1] < 1e-8 THEN 0 ELSE len(v) END)] AS v FROM k)
SELECT id, round(v[len(v) // 2 + 1], 6) AS "Median", round(v[1], 6) AS "Min", round(v[len(v)], 6) AS "Max", round(list_avg(v), 6) AS "Mean" FROM q""",
    "nearest_seed": f"""WITH {_SLICE},\n{_SEEDS}
SELECT l_id, m.r_id AS r_id, round(sqrt(m.d2), 6) AS dist FROM (SELECT t.tree_id AS l_id, min({{'d2': (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z), 'r_id': s.id}}) AS m FROM t, s GROUP BY t.tree_id)""",
    "point_in_disc": f"WITH {_CLOUD},\n{_SEEDS}\nSELECT s.id, min(t.tree_id) AS circle FROM u s JOIN t ON s.x BETWEEN t.x - t.radius - 0.1 AND t.x + t.radius + 0.1 AND (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) <= (t.radius + 0.0755::DOUBLE) * (t.radius + 0.0755::DOUBLE) GROUP BY s.id",
    "tree_ids_from_map": f"WITH {_CLOUD},\n{_SEEDS},\nti AS (SELECT tree_id AS id, x, y, z FROM t),\n{_pairs('u', 'ti', 2.5005, 2)}\nSELECT s.id, coalesce(min(r_id), 0) AS tree_id FROM u s LEFT JOIN pairs ON s.id = l_id GROUP BY s.id",
    "graph_edges": f"WITH {_CLOUD},\n{_pairs('u', 'u', LONGEST)},\n{_KNN_EDGES}\nSELECT src, dst, round(w, 6) AS w FROM un",
    "graph_degree": f"WITH {_CLOUD},\n{_pairs('u', 'u', LONGEST)},\n{_KNN_EDGES}\nSELECT src AS node, count(*) AS degree FROM un GROUP BY src",
    "connected_points": f"""WITH RECURSIVE {_CLOUD},
{_pairs('u', 'u', LONGEST)},
l AS MATERIALIZED (SELECT l_id AS a, r_id AS b FROM pairs WHERE l_id <> r_id),
best(node, component) USING KEY (node) AS (SELECT id, id FROM u
  UNION SELECT l.b, min(b.component) FROM best b JOIN l ON b.node = l.a JOIN recurring.best o ON o.node = l.b WHERE b.component < o.component GROUP BY l.b)
SELECT node, component FROM best""",
    "metabolic_scale": f"WITH {_SEEDS}\nSELECT tree_id, round(1 / pow(2 * radius, 0.125::DOUBLE), 6) AS scale, round(radius / 2 + sqrt(radius), 6) AS own FROM t",
    "circle_algebraic": f"""WITH {_STEMS},
m AS (SELECT tree_id, avg(x) AS mx, avg(y) AS my FROM st GROUP BY tree_id),
d AS (SELECT tree_id, mx, my, x - mx AS u, y - my AS v FROM st JOIN m USING (tree_id)),
q AS (SELECT tree_id, mx, my, count(*) AS n, sum(u * u) AS suu, sum(v * v) AS svv, sum(u * v) AS suv, sum(u * (u * u + v * v)) AS bu, sum(v * (u * u + v * v)) AS bv, avg(u * u + v * v) AS mz FROM d GROUP BY ALL HAVING count(*) >= 6),
f AS (SELECT *, (bu * svv - bv * suv) / (2 * (suu * svv - suv * suv)) AS a, (bv * suu - bu * suv) / (2 * (suu * svv - suv * suv)) AS b FROM q)
SELECT tree_id, round(mx + a, 4) AS cx, round(my + b, 4) AS cy, round(sqrt(a * a + b * b + mz), 4) AS r, n FROM f""",
    "tree_height": f"WITH {_CLOUD}\nSELECT tree_id, x, y, z AS height FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY z DESC, id) AS r FROM u WHERE tree_id IS NOT NULL) WHERE r = 1",
    "crown_base_height": f"""WITH {_CLOUD},
q AS (SELECT tree_id, quantile_cont(z, [{', '.join(str(i / 20) for i in range(21))}]) AS q FROM u WHERE tree_id IS NOT NULL GROUP BY tree_id),
p AS (SELECT tree_id, q, unnest(generate_series(1, 20)) AS i FROM q),
f AS (SELECT tree_id, min(i) AS i FROM p WHERE q[i + 1] - q[i] > 0.05::DOUBLE GROUP BY tree_id)
SELECT q.tree_id, round(CASE WHEN f.i IS NULL THEN q.q[21] ELSE q.q[f.i + 1] END, 6) AS crown_base_height FROM q LEFT JOIN f USING (tree_id)""",
    "tree_id_mismatch": f"WITH {_CLOUD},\np AS (SELECT DISTINCT tree_id FROM u WHERE tree_id <> 0),\nt AS (SELECT DISTINCT TreeID AS tree_id FROM treelocs WHERE TreeID IS NOT NULL)\nSELECT tree_id, 'points' AS missing_in FROM t ANTI JOIN p USING (tree_id) UNION ALL SELECT tree_id, 'trees' FROM p ANTI JOIN t USING (tree_id)",
    "raster_reclass": f"WITH {_HABITAT}\nSELECT row_, col_, CASE WHEN value >= 10 THEN 1.0::DOUBLE END AS value FROM h",
    "focal_max": f"WITH {_HABITAT},\nm AS (SELECT row_ + i AS row_, col_ + j AS col_, max(value) AS value FROM h, ({_disc(2.0, True)}) o(i, j) GROUP BY 1, 2)\nSELECT h.row_, h.col_, m.value FROM h LEFT JOIN m USING (row_, col_)",
    "patchmorph": _patch_sql() + "SELECT * FROM patches",
    "sum_by_suitability": _patch_sql() + "SELECT suit, row_, col_, sum(coalesce(value, 0)) AS value FROM patches GROUP BY suit, row_, col_",
    "connected_cells": f"WITH RECURSIVE {_CELLS}\nSELECT * FROM cells",
    "polygon_area": f"WITH RECURSIVE {_CELLS}\nSELECT label, count(*) * 1.0::DOUBLE AS area FROM cells GROUP BY label",
    "zonal_stats": f"WITH RECURSIVE {_CELLS}\nSELECT label, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS mid FROM cells JOIN h USING (row_, col_) GROUP BY label",
    "extract_cells": f"WITH {_CLOUD},\n{_HABITAT}\nSELECT id, h.value FROM u LEFT JOIN h ON CAST(floor(y / 10) AS INT) = row_ AND CAST(floor(x / 10) AS INT) = col_",
    "color_attr": f"""WITH {_CLOUD},
v AS (SELECT id, CASE WHEN NOT isnan(verticality) THEN verticality END AS v FROM u),
m AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
b AS (SELECT id, CAST(greatest(1, least(256, ceil((v - lo) / (hi - lo) * 256))) AS INT) AS bin, v FROM v, m)
SELECT id, """ + ", ".join(f"CASE WHEN v IS NULL THEN 0 ELSE {_ramp_sql(i)}[bin] END AS \"{'RGB'[i]}\"" for i in range(3)) + " FROM b",
    "color_raster": f"WITH {_CLOUD},\n{_HABITAT}\nSELECT id, " + ", ".join(f'CAST(trunc(coalesce(h.value, 0) / {k}) AS INT) AS "{n}"' for k, n in ((1, "R"), (2, "G"), (4, "B"))) + " FROM u LEFT JOIN h ON CAST(floor(y / 10) AS INT) = row_ AND CAST(floor(x / 10) AS INT) = col_",
    "pcv": f"""WITH {_CLOUD},
{_pairs('u', 'u', 1.0005)},
g AS (SELECT *, sqrt(dx * dx + dy * dy) AS h FROM pairs WHERE l_id <> r_id),
a AS (SELECT l_id AS id, {_PCV} FROM g WHERE h >= 1e-10 GROUP BY l_id)
SELECT s.id, round(CASE WHEN a.id IS NULL THEN pi() / 2 ELSE ({' + '.join(f'coalesce(pi() / 2 - a{i}, pi() / 2)' for i in range(DIRECTIONS))}) / {DIRECTIONS} END, 6) AS value FROM u s LEFT JOIN a USING (id)""",
    "depth_map": f"WITH {_CLOUD},\nlow AS (SELECT min(x) AS x0, min(y) AS y0 FROM u)\nSELECT CAST(floor((x - x0) / 2) AS BIGINT) AS gx, CAST(floor((y - y0) / 2) AS BIGINT) AS gy, min(z) AS depth FROM u, low GROUP BY 1, 2",
    "tile_bounds": f"WITH {_CLOUD}\nSELECT min(x) - 1 AS xmin, min(y) - 1 AS ymin, max(x) + 1 AS xmax, max(y) + 1 AS ymax FROM u",
    "pixel_counts": f"WITH {_STEMS},\nlow AS (SELECT tree_id, min(x) AS x0, min(y) AS y0 FROM st GROUP BY tree_id)\nSELECT tree_id, CAST(floor((x - x0) / 0.05::DOUBLE) AS INT) AS px, CAST(floor((y - y0) / 0.05::DOUBLE) AS INT) AS py, count(*) AS n FROM st JOIN low USING (tree_id) GROUP BY 1, 2, 3",
    **{f"blend_{m}": _blend_sql(m) for m in color.BLENDS},
}
_RINGS = "VALUES " + ", ".join(f"({s}, {i}, {j})" for s in range(1, 6) for i, j in hough.ring(s))
_VOTES = SQL["pixel_counts"].replace("SELECT tree_id, CAST(floor((x - x0)", "SELECT tree_id, CAST(floor((x - x0)").split("\nSELECT", 1)
SQL["hough_votes"] = f"""{_VOTES[0]},
pc AS (SELECT{_VOTES[1]}),
mx AS (SELECT tree_id, max(n) AS most FROM pc GROUP BY tree_id)
SELECT tree_id, step, px + i AS px, py + j AS py, count(*) AS votes FROM pc JOIN mx USING (tree_id), ({_RINGS}) o(step, i, j) WHERE n >= greatest(1, ceil(most * 0.1::DOUBLE)) GROUP BY 1, 2, 3, 4"""
SQL["hough_centre"] = f"SELECT tree_id, step, px, py, votes FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY votes DESC, step, py, px) AS r FROM ({SQL['hough_votes']})) WHERE r = 1"
SQL["shortest_path_assign"] = f"""WITH RECURSIVE {_STEMS},
{_pairs('u', 'u', 1.0005)},
e AS (SELECT l_id, r_id, sqrt(d2) AS w FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY d2, r_id) AS r FROM pairs WHERE l_id <> r_id) WHERE r <= 8),
un AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM (SELECT l_id AS src, r_id AS dst, w FROM e UNION ALL SELECT r_id, l_id, w FROM e) GROUP BY src, dst),
seed AS (SELECT min(id) AS node FROM st GROUP BY tree_id),
best(node, m) USING KEY (node) AS (SELECT id, CASE WHEN id IN (SELECT node FROM seed) THEN {{'dist': 0::DOUBLE, 'seed': id}} ELSE {{'dist': 1e9::DOUBLE, 'seed': 0::BIGINT}} END FROM u
  UNION SELECT un.dst, min({{'dist': b.m.dist + un.w, 'seed': b.m.seed}}) FROM best b JOIN un ON b.node = un.src JOIN recurring.best o ON o.node = un.dst
    WHERE b.m.dist < 1e9 AND (b.m.dist + un.w < o.m.dist OR b.m.dist + un.w = o.m.dist AND b.m.seed < o.m.seed) GROUP BY un.dst)
SELECT node, CASE WHEN m.dist < 999 THEN m.seed ELSE 0 END AS seed, CASE WHEN m.dist < 999 THEN round(m.dist, 6) END AS dist FROM best"""
