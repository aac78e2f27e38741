"""Neighbourhoods, fits, graphs, rasters, patches, colours and trees on clouds with known answers."""

import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timberline.functions.formulas import formula_column
from timberline.functions.palette import PALETTE, ramp, rgb
from timberline.operators import color, eigen, fits, graph, grid, hough, patches, sampling, spatial, trees
from timberline.plans import operator_queries, reference_queries
from timberline.runtime import Workspace
from timberline.sources import las_file, tables


def cloud(spark, p, **cols):
    names = list(cols)
    rows = [(i, *map(float, q), *(cols[n][i] for n in names)) for i, q in enumerate(p)]
    return spark.createDataFrame(rows, ["id", "x", "y", "z", *names])


def cylinder(r=0.2, h=2.0, n=100, noise=0.01, seed=123, cx=0.0, cy=0.0):
    g = np.random.default_rng(seed)
    t, z = g.uniform(0, 2 * np.pi, n), g.uniform(0, h, n)
    return np.column_stack([cx + r * np.cos(t) + g.normal(0, noise, n), cy + r * np.sin(t) + g.normal(0, noise, n), z])


def metrics(spark, p, r):
    return eigen.eigen_metrics(cloud(spark, p), r).toPandas().sort_values("id").reset_index(drop=True)


def test_line_plane_wall(spark):
    m = metrics(spark, [(0.1 * i, 0, 0) for i in range(9)], 0.35)
    assert np.allclose(m.Linearity, 1) and np.allclose(m.Planarity, 0, atol=1e-7) and (m.Omnivariance < 1e-4).all()
    plane = list(itertools.product(np.arange(5) * 0.1, np.arange(5) * 0.1, [0.0]))
    m = metrics(spark, plane, 0.25)
    assert m.Planarity[12] > 0.99 and np.allclose(m.Verticality, 0) and np.allclose(m.Roughness, 0, atol=1e-9) and np.allclose(m.MeanCurvature, 0, atol=1e-6) and np.allclose(m.Nz, 1)
    m = metrics(spark, [(0.0, a, b) for a, b, _ in plane], 0.25)
    assert np.allclose(m.Verticality, 1)


def test_few_neighbours_are_zero(spark):
    m = metrics(spark, [(0, 0, 0), (0.05, 0, 0), (9, 9, 9)], 0.1)
    assert list(m.NumNeighbors) == [2, 2, 1] and (m[eigen.METRICS[:-1]].to_numpy() == 0).all()


def test_curvature_of_sphere_and_cylinder(spark):
    g = np.random.default_rng(1)
    xy = g.uniform(-0.1, 0.1, (120, 2))
    xy[0] = 0
    cap = np.column_stack([xy, np.sqrt(1 - (xy**2).sum(1))])
    m = metrics(spark, cap, 0.3)
    assert abs(m.MeanCurvature[0] - 1) < 0.02 and abs(m.GaussianCurvature[0] - 1) < 0.04
    strip = np.column_stack([np.sqrt(1 - xy[:, 0] ** 2), xy[:, 0], xy[:, 1]])
    m = metrics(spark, strip, 0.3)
    assert abs(m.MeanCurvature[0] - 0.5) < 0.02 and m.GaussianCurvature[0] < 0.02


def test_metrics_against_numpy(spark):
    g = np.random.default_rng(4)
    p = g.uniform(0, 1, (150, 3)) + [500000, 4000000, 0]
    m = metrics(spark, p, 0.4)
    for i in (0, 70, 149):
        q = p[np.linalg.norm(p - p[i], axis=1) <= 0.4]
        w, v = np.linalg.eigh(np.cov(q.T, bias=True))
        w = w[::-1]
        row = m.loc[i]
        assert row.NumNeighbors == len(q) and np.allclose([row.eLargest, row.eMedium, row.eSmallest], w, atol=1e-9)
        n = v[:, 0]
        d = (q - p[i]) @ v[:, 1]
        assert abs(row.Roughness - abs((p[i] - q.mean(0)) @ n)) < 1e-7 and abs(row.MomentOrder1 - d.sum() ** 2 / (d**2).sum()) < 1e-5
        assert abs(row.PCA1 - w[0] / w.sum()) < 1e-9 and abs(row.VolumeDensity - len(q) / (4 / 3 * math.pi * 0.4**3)) < 1e-6


def test_solver_against_numpy():
    g = np.random.default_rng(8)
    a = g.normal(size=(3000, 3, 3)) * 10.0 ** g.uniform(-6, 2, (3000, 1, 3))
    c = a @ a.transpose(0, 2, 1)
    c[:100, 2], c[:100, :, 2], c[100:200], c[200:300] = 0, 0, np.eye(3), 0
    solve = lambda c: eigen._solver().func(*(pd.Series(c[:, i, j]) for i in range(3) for j in range(i, 3)))[eigen.EIGEN].to_numpy()
    m = solve(c)
    w, v = m[:, :3], m[:, 3:].reshape(-1, 3, 3).transpose(0, 2, 1)
    size = np.abs(c).max((1, 2))[:, None, None] + 1e-300
    assert (np.abs(w - np.linalg.eigvalsh(c)[:, ::-1]) <= 1e-14 * size[:, 0]).all() and np.allclose(v.transpose(0, 2, 1) @ v, np.eye(3), atol=1e-13)
    assert (np.abs((v * w[:, None]) @ v.transpose(0, 2, 1) - c) <= 1e-14 * size).all() and all((solve(c[i : i + 1]) == m[i]).all() for i in (0, 150, 250, 2000))


def test_thin_neighbourhoods(spark, las, tmp_path):
    """Two points above each other and one aside span an upright plane: its normal is level, so y tells its sign.
    The sum 0.0911415 of four points rounds up. Both hold in whatever order the neighbours are summed."""
    rows = [(1, 508.64, 1906.136, 5.538), (2, 508.979, 1906.319, 5.815), (3, 508.64, 1906.136, 5.545), (4, 0.0, 0.0, 0.0), (5, -0.273, -0.051, 0.216), (6, -0.273, -0.051, 0.222)]
    rows += [(7, 223.835, 908.773, 8.993), (8, 223.804, 908.769, 8.401), (9, 223.851, 908.771, 8.196), (10, 223.842, 908.781, 8.696)]
    las(rows).write.parquet(str(tmp_path / "las.parquet"))
    m = {r.id: r for r in operator_queries.QUERIES["eigen_metrics"](spark, str(tmp_path)).collect()}
    assert [(m[i].NumNeighbors, m[i].Nx, m[i].Ny, abs(m[i].Nz)) for i in (1, 2, 3)] == [(3, -0.475028, 0.879971, 0)] * 3
    assert all(m[i].NumNeighbors == 3 and m[i].Ny > 0 and m[i].Nz == 0 for i in (4, 5, 6)) and m[10].NumNeighbors == 4 and m[10].eSum == 0.091142


@pytest.mark.parametrize("radius", [0, -1, "a", True])
def test_radius_is_checked(spark, radius):
    with pytest.raises(ValueError, match="radius must be positive"):
        eigen.eigen_metrics(cloud(spark, [(0, 0, 0)]), radius)


def test_radius_joins_against_brute_force(spark):
    g = np.random.default_rng(2)
    p = np.round(g.uniform(-2, 2, (200, 3)), 3)
    df = cloud(spark, p)
    d3 = np.linalg.norm(p[:, None] - p[None], axis=2)
    d2 = np.linalg.norm(p[:, None, :2] - p[None, :, :2], axis=2)
    assert {r.id: r.n for r in spatial.count_in_sphere(df, 0.7).collect()} == dict(enumerate((d3 <= 0.7).sum(1)))
    assert {r.id: r.n for r in spatial.count_in_disc(df, 0.5).collect()} == dict(enumerate((d2 <= 0.5).sum(1)))
    got = {(r.l_id, r["rank"]): r.r_id for r in spatial.knn_within(df, 3, 1.5).collect()}
    for i in range(200):
        o = [j for j in np.argsort(d3[i]) if j != i and d3[i, j] <= 1.5][:3]
        assert [got.get((i, k + 1)) for k in range(len(o))] == o
    near = {r.l_id: r.r_id for r in spatial.nearest_within(df.where("id < 50"), df.where("id >= 50"), 5.0).collect()}
    assert near == {i: 50 + int(d3[i, 50:].argmin()) for i in range(50)}
    bad = df.unionByName(spark.createDataFrame([(900, float("nan"), 0.0, 0.0), (901, None, 0.0, 0.0)], df.schema))
    assert spatial.count_in_sphere(bad, 0.7).count() == 200 and spatial.count_in_sphere(bad.limit(0), 0.7).count() == 0


def test_cylinder_fits(spark):
    p = cylinder()
    for method in ("ransac", "irls", "nm"):
        r = fits.fit_cylinder(p, method, n=10, inliers=0.8)
        assert len(r) == 6 and abs(r[4] - 0.2) < 0.05, method
    r = fits.fit_cylinder(p, "bf", n=10, max_angle=1, n_best=5)
    assert abs(r[2] - 0.2) < 0.05 and abs(r[4]) <= 1
    assert fits.fit_cylinder(np.ones((2, 3))) is None and fits.fit_cylinder(cylinder(n=4), "ransac", n=5) is not None
    with pytest.raises(ValueError):
        fits.fit_cylinder(p, "magic")


def test_fits_per_group(spark):
    a, b = cylinder(0.15, 1.5, 60, 0.005, 456), cylinder(0.3, 2, 80, 0.005, 7, 5, 5)
    df = cloud(spark, np.concatenate([a, b, [[0, 0, 0]]]), tree=[1] * 60 + [2] * 80 + [3])
    got = {r.tree: r for r in fits.fit_groups(df, "tree", "irls").collect()}
    assert set(got) == {1, 2} and abs(got[1].radius - 0.15) < 0.02 and abs(got[2].radius - 0.3) < 0.03 and abs(got[2].px - 5) < 0.1
    again = {r.tree: r.radius for r in fits.fit_groups(df.repartition(3), "tree", "irls").collect()}
    assert again == {t: r.radius for t, r in got.items()}
    c = {r.tree: r for r in fits.algebraic_circles(df, "tree").collect()}
    assert abs(c[2].cx - 5) < 0.02 and abs(c[2].r - 0.3) < 0.02 and c[3].r is None
    assert abs({r.tree: r.r for r in fits.landau_groups(df, "tree").collect()}[1] - 0.15) < 0.02


def test_many_simplexes_agree_with_one():
    f = lambda p: (p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2
    p, v, ok = fits.nelder_mead(f, np.array([0.0, 0.0]))
    q, w, done = fits.nelder_mead_many(lambda s, which: (s[:, 0] - 1) ** 2 + 3 * (s[:, 1] + 2) ** 2, np.zeros((3, 2)))
    assert ok and done.all() and np.allclose(p, [1, -2], atol=1e-3) and np.allclose(q, p, atol=1e-6)


def test_components_and_paths(spark):
    work = Workspace(spark, "test")
    rnd = random.Random(1)
    pairs = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    parent = {n: n for e in pairs for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    table = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in graph.components(table, work).collect()}
    assert got == {n: root(n) for n in parent}
    assert graph.components(table.limit(0), work).count() == 0
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(10)] + [(0, 9, 2.5), (20, 21, 1.0)], "src long, dst long, w double")
    seeds = spark.createDataFrame([(0, 0.5), (10, 2.0), (99, 1.0)], "node long, radius double")
    d = {(r.seed, r.node): r.dist for r in graph.shortest_paths(edges, seeds, work).collect()}
    assert d[0, 5] == 5.0 and d[0, 9] == 2.5 and d[10, 6] == 4.0 and d[99, 99] == 0.0 and (0, 20) not in d
    dist = graph.shortest_paths(edges, seeds, work)
    nodes = spark.createDataFrame([(i,) for i in (0, 4, 6, 21)], "node long")
    plain = {r.node: r.seed for r in graph.assign_to_seeds(dist, seeds, nodes).collect()}
    # 99 is an id like others; the node 4 is nearer to 0, 6 to 10; 21 isn't reached
    assert plain[4] == 0 and plain[6] == 10 and plain[21] == 0
    scaled = {r.node: r.seed for r in graph.assign_to_seeds(dist, seeds, nodes, "x", True).collect()}
    assert scaled[6] == 0


def test_formula(spark):
    df = spark.createDataFrame([(4.0,)], "r double")
    for text, want in (("x/2", 2.0), ("1/(2*x)^(1/8)", 1 / 8**0.125), ("-x ^ 2 + sqrt(x)*3", -10.0), ("pow(x, 2) - 1e1", 6.0), ("x/0", None)):
        got = df.select(formula_column(text, F.col("r"))).first()[0]
        assert got == want or abs(got - want) < 1e-12
    for text in ("system(1)", "x +", "y", "x; 1", "(x", "x x"):
        with pytest.raises(ValueError):
            formula_column(text, F.col("r"))


def _dilated(cells, offsets):
    return {(r + i, c + j) for r, c in cells for i, j in offsets}


def test_patches_against_distances(spark):
    g = np.random.default_rng(9)
    v = g.choice([0.0, 5.0, 10.0, 20.0], (14, 14), p=[0.6, 0.2, 0.1, 0.1])
    cells = list(itertools.product(range(14), range(14)))
    df = spark.createDataFrame([(r, c, float(v[r, c])) for r, c in cells] + [(0, 0, None), (3, 3, float("nan"))], "row_ int, col_ int, value double")
    got = patches.patchmorph(df, [5, 10], [2, 3], [1, 2], Workspace(spark, "test"))
    assert got.count() == 2 * 2 * 2 * 196

    def stage(start, size):
        dist = {c: min(math.dist(c, s) for s in start) for c in cells}
        k = grid.disc_offsets(size)
        return {c for c in cells if max(dist[d] for d in ((c[0] + i, c[1] + j) for i, j in k) if d in dist) >= size / 2}

    for s, gp, sp in itertools.product((5, 10), (2, 3), (1, 2)):
        want = stage(stage([c for c in cells if v[c] >= s], sp), gp)
        have = {(r.row_, r.col_) for r in got.where((F.col("suit") == s) & (F.col("gap") == gp) & (F.col("spur") == sp) & (F.col("value") == 1)).collect()}
        assert have == want, (s, gp, sp)
    total = patches.sum_by_suitability(got, [5])
    assert total.count() == 196 and total.agg(F.max("value")).first()[0] <= 4
    assert patches.patchmorph(df, [], [1], [1], Workspace(spark, "test")) is None
    with pytest.raises(ValueError):
        patches.patchmorph(df, [99], [1], [1], Workspace(spark, "test"))
    assert patches.select_layer(got, patches.layer_name(5, 2, 1)).count() == 196 and patches.select_layer(got, "suit_50_gap_2_spur_1") is None


def test_sum_uses_exact_suitability(spark):
    rows = [(5.0, g, 1.0, r, c, v) for g, v in ((1.0, 1.0), (2.0, 2.0)) for r in range(3) for c in range(3)] + [(50.0, 1.0, 1.0, 0, 0, 9.0), (10.0, 1.0, 1.0, 0, 0, 3.0)]
    df = spark.createDataFrame(rows, "suit double, gap double, spur double, row_ int, col_ int, value double")
    got = {(r.suit, r.row_, r.col_): r.value for r in patches.sum_by_suitability(df, [5, 10]).collect()}
    assert got[5.0, 0, 0] == 3.0 and got[10.0, 0, 0] == 3.0 and len(got) == 10


def test_raster_shapes(spark):
    work = Workspace(spark, "test")
    ringed = [(r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)] + [(10, 10), (11, 11)]
    df = spark.createDataFrame([(r, c, 1.0) for r, c in ringed], "row_ int, col_ int, value double")
    lab = work.put("lab", grid.connected_cells(df, work))
    assert sorted(r.area for r in grid.areas(lab, 0.5).collect()) == [0.25, 0.25, 6.0]
    filled = grid.fill_holes(lab, work)
    assert filled.count() == 27 and filled.where("row_ = 2 and col_ = 2").count() == 1
    d = {(r.row_, r.col_) for r in grid.dilate(df, 2.0).collect()}
    assert d == _dilated(ringed, grid.disc_offsets(2.0))
    closed = {(r.row_, r.col_) for r in grid.close_cells(lab, 2.0, 1.0).collect()}
    grown = _dilated([c for c in ringed if c[0] < 6], grid.disc_offsets(2.0))
    assert {c for c in grown if all((c[0] + i, c[1] + j) in grown for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))} <= closed
    z = {r.n for r in grid.zonal(lab, df, {"n": F.count("*")}).collect()}
    assert z == {24, 1}
    both = grid.intersect_labels(lab, filled, 1.0)
    assert both.count() == 3
    k = grid.classify(spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.2), (0, 2, 1.0), (0, 3, None)], "row_ int, col_ int, value double"), [(0.0, 0.2, 0.0), (0.2, 1.0, 1.0)])
    assert [r.value for r in k.orderBy("col_").collect()] == [0.0, 0.0, 1.0, None]


def test_hulls():
    square = np.array(list(itertools.product([0.0, 2.0], [0.0, 3.0])) + [[1, 1], [1, 0]])
    assert fits is not None and trees.area_2d(trees.hull_2d(square)) == 6.0
    cube = np.array(list(itertools.product([0.0, 1.0], repeat=3)) + [[0.5, 0.5, 0.5]])
    v, s, c = trees.hull_3d(cube)
    assert abs(v - 1) < 1e-9 and abs(s - 6) < 1e-9 and len(c) == 8
    assert trees.hull_3d(np.column_stack([square, np.zeros(6)])) is None
    g = np.random.default_rng(0).normal(size=(3000, 3))
    ball = g / np.linalg.norm(g, axis=1, keepdims=True)
    v, s, _ = trees.hull_3d(ball)
    assert abs(v - 4 / 3 * math.pi) < 0.06 and abs(s - 4 * math.pi) < 0.1


def test_tree_attributes(spark):
    g = np.random.default_rng(3)
    p = np.concatenate([np.column_stack([g.normal(10, 0.5, 50), g.normal(10, 0.5, 50), g.uniform(0, 5, 50)]), np.column_stack([g.normal(15, 0.5, 50), g.normal(15, 0.5, 50), g.uniform(0, 6, 50)])])
    df = cloud(spark, p, tree_id=[1] * 50 + [2] * 50)
    t = spark.createDataFrame([(1, 10.0, 10.0, 0.0, 0.2, 0.01), (2, 15.0, 15.0, 0.0, 0.25, None), (2, 15.0, 15.0, 0.0, 0.25, None), (3, 1.0, 1.0, 0.0, 0.1, 0.0)], "tree_id int, x double, y double, z double, radius double, error double")
    got = {r.tree_id: r for r in trees.tree_attributes(t, df).collect()}
    assert set(got) == {1, 2, 3} and got[1].diameter == 0.4 and abs(got[1].height - p[:50, 2].max()) < 1e-12
    assert got[1].crown_volume > 0 and got[2].crown_area > 0 and got[3].height is None and got[3].crown_volume is None
    q = np.quantile(p[:50, 2], np.arange(21) / 20)
    step = [b for a, b in zip(q, q[1:]) if b - a > 0.05][0]
    assert abs(got[1].crown_base_height - step) < 1e-9
    assert {(r.tree_id, r.missing_in) for r in trees.id_mismatches(t, df).collect()} == {(3, "points")}


def test_segmentation_of_two_blobs(spark):
    g = np.random.default_rng(8)
    p = np.concatenate([np.column_stack([g.normal(10, 0.3, 100), g.normal(10, 0.3, 100), g.uniform(0, 3, 100)]), np.column_stack([g.normal(14, 0.3, 100), g.normal(14, 0.3, 100), g.uniform(0, 4, 100)])])
    df = cloud(spark, p, classification=[1] * 200)
    t = spark.createDataFrame([(1, 10.0, 10.0, 1.3, 0.15, 0.01), (2, 14.0, 14.0, 1.3, None, 0.01)], "tree_id int, x double, y double, z double, radius double, error double")
    out = trees.segment_points(df, t, Workspace(spark, "test"), k=10, longest=0.8).toPandas()
    left, right = out[out.x < 12], out[out.x > 12]
    assert set(left.tree_id.dropna()) <= {0, 1} and set(right.tree_id.dropna()) <= {0, 2} and (left.tree_id == 1).mean() > 0.5
    dense = trees.segment_points(df, t, Workspace(spark, "test"), k=10, longest=0.8, dense=True)
    assert dense.count() == 200 and "nnd" in dense.columns
    none = trees.segment_points(df, t.limit(0), Workspace(spark, "test"), k=10, longest=0.8)
    assert none.where("tree_id <> 0").count() == 0


def test_colours(spark):
    assert len(PALETTE) == 10 and rgb("#0a0B0c") == (10, 11, 12) and ramp(["black", "white"])[255] == (255, 255, 255) and ramp(["black", "white"])[128] == (128, 128, 128)
    df = cloud(spark, [(i, 0, i) for i in range(5)], v=[0.0, 1.0, None, float("nan"), 0.5])
    got = {r.id: (r.R, r.G, r.B) for r in color.colorize(df, "attr", "v").collect()}
    assert got[0] == (0, 0, 0) and got[1] == (255, 255, 255) and got[2] == got[3] == (0, 0, 0) and got[4] == (127, 127, 127)
    flat = color.colorize(df.withColumn("v", F.lit(3.0)), "attr", "v", ["red", "blue"])
    assert {(r.R, r.G, r.B) for r in flat.collect()} == {(255, 0, 0)}
    for bad in ({"method": "nope"}, {"method": "attr"}, {"method": "attr", "attribute": "zz"}, {"method": "rgb"}):
        with pytest.raises(ValueError):
            color.colorize(df, **bad)
    with pytest.raises(ValueError):
        ramp(["nocolour"])


def test_colours_of_rasters(spark, capsys):
    df = cloud(spark, [(0.5, 0.5, 0), (1.5, 0.5, 0), (9, 9, 0)])
    red, green = (spark.createDataFrame(r, "row_ int, col_ int, value double") for r in ([(0, 0, 0.5), (0, 1, 1.0)], [(0, 0, 0.2), (0, 1, None)]))
    got = {r.id: (r.R, r.G, r.B) for r in color.colorize(df, "rgb", rasters=(red, green, green), crs=(tables.CloudMeta(1), tables.CloudMeta(2))).collect()}
    assert got == {0: (127, 51, 51), 1: (255, 0, 0), 2: (0, 0, 0)} and "differ" in capsys.readouterr().out


def test_sky_and_screen(spark):
    flat = cloud(spark, [(i * 0.2, j * 0.2, 0.0) for i in range(4) for j in range(4)])
    assert all(abs(r.value - math.pi / 2) < 1e-12 for r in color.sky_visibility(flat, 0.5, 12).collect())
    wall = cloud(spark, [(0, 0, 0)] + [(0.3, 0.0, 0.1 * k) for k in range(1, 5)])
    foot = {r.id: r.value for r in color.sky_visibility(wall, 1.0, 36).collect()}[0]
    share = sum(math.cos(2 * math.pi * i / 36) > 0.7 for i in range(36)) / 36
    assert abs(foot - (math.pi / 2 - share * math.atan2(0.4, 0.3))) < 1e-9
    g = np.random.default_rng(5)
    s = color.screen_occlusion(cloud(spark, g.uniform(0, 5, (300, 3))), 0.5, 3, 8).toPandas()
    assert len(s) == 300 and s.value.between(0, 1.5).all() and s.value.nunique() > 2


def test_blends(spark):
    a = spark.createDataFrame([(1, 100, 200, 0)], "id long, R int, G int, B int")
    b = spark.createDataFrame([(1, 50, 100, 255)], "id long, R int, G int, B int")
    got = {m: tuple(color.blend(a, b, m, 0.5).first())[1:] for m in color.BLENDS}
    assert got == {"alpha": (75, 150, 127), "multiply": (19, 78, 0), "screen": (130, 221, 255), "overlay": (39, 188, 0)}
    for bad in ({"alpha": 1.5}, {"method": "add"}):
        with pytest.raises(ValueError):
            color.blend(a, b, **bad)
    with pytest.raises(ValueError):
        color.merge_colors(a, b.limit(0))
    with pytest.raises(ValueError):
        color.blend(a.drop("R"), b)


def test_hough(spark):
    t = np.linspace(0, 2 * np.pi, 120, endpoint=False)
    ringp = np.column_stack([0.2 * np.cos(t), 0.2 * np.sin(t), np.linspace(0.1, 3.9, 120)])
    df = cloud(spark, ringp, tree_id=[1] * 120)
    px = hough.pixel_counts(df, 0.05)
    best = hough.single_centre(hough.hough_votes(px, 0.3, 0.05)).first()
    assert abs((best.px + 0.5) * 0.05 - 0.2) <= 0.051 and best.step == 4
    # every layer holds points all around the stem, as the guide stays in place below its slice
    around = cloud(spark, np.column_stack([ringp[:, :2], 0.1 + 3.8 * (np.arange(120) * 37 % 120) / 119]), tree_id=[1] * 120)
    layers = hough.stem_layers(around, 0.0, 4.0, 1.0, 0.3, 0.05).toPandas()
    assert len(layers) == 4 and (layers.radius.sub(0.2).abs() <= 0.051).all()
    centres = hough.merge_centres(hough.hough_votes(px, 0.3, 0.05), 0.05, 0.3)
    assert centres.count() == 1
    n = cloud(spark, ringp, nx=np.cos(t).tolist(), ny=np.sin(t).tolist(), nz=[0.0] * 120)
    v = hough.normal_votes(n, 0.05, 0.3, flat=True).toPandas()
    assert v.votes.max() > 20


def test_sampling(spark):
    g = np.random.default_rng(6)
    df = cloud(spark, g.uniform(0, 2, (500, 3)))
    a = {r.id for r in sampling.decimate_random(df, 0.5, 1).collect()}
    assert len(a) == len({tuple(np.floor(r / 0.5)) for r in np.array([tuple(x)[1:4] for x in df.collect()])}) and a == {r.id for r in sampling.decimate_random(df.repartition(5), 0.5, 1).collect()}
    n = sampling.bernoulli(df, 0.3, 2).count()
    assert 100 < n < 200 and sampling.bernoulli(df, 1.0).count() == 500 and sampling.bernoulli(df, 0.0).count() == 0
    assert sampling.crop(df, 1, 1, 0.5).count() + sampling.crop(df, 1, 1, 0.5, negate=True).count() == 500
    assert sampling.slices(df, 0.5, 0, 2).select("slice").distinct().count() == 4


def test_las_files(spark, tmp_path):
    g = np.random.default_rng(1)
    x, y, z = g.uniform(0, 100, (3, 2500)).round(3)
    las_file.write_las(f"{tmp_path}/a.las", x, y, z, np.full(2500, 5))
    las_file.write_las(f"{tmp_path}/b.las", x[:10], y[:10], z[:10])
    df = las_file.read_las(spark, str(tmp_path), records_per_task=1000).orderBy("point_id").toPandas()
    assert len(df) == 2510 and list(df.point_id) == list(range(2510)) and np.allclose(df.X[:2500], x) and set(df.Classification[:2500]) == {5}
    shared = las_file.read_las(spark, f"file://{tmp_path}", records_per_task=1000)
    assert shared.count() == 2510 and las_file.read_las(spark, f"file://{tmp_path}/b.las").count() == 10
    (tmp_path / "bad.las").write_bytes(b"nothing")
    with pytest.raises(Exception):
        las_file.read_las(spark, f"{tmp_path}/bad.las").count()


def test_tables_and_frames(spark, tmp_path):
    df = tables.cloud_from_rows(spark, [dict(X=1.0, Y=2.0, Z=3.0), dict(X=4.0, Y=5.0, Z=6.0)])
    assert tables.las_to_xyz(df).columns == ["X", "Y", "Z"] and tables.imagery_request(df, tables.CloudMeta(), (2018, 2020)) is None
    req = tables.imagery_request(df, tables.CloudMeta(26910), (2018, 2020), 1.0)
    assert req["bbox"] == [0.0, 1.0, 5.0, 6.0] and req["datetime"] == "2018-01-01/2020-12-31"
    tables.write_cloud(df, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 2
    with pytest.raises(Exception):
        tables.write_cloud(df, f"{tmp_path}/c")
    f = tables.rotation_frames(cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 1)]), 1, 60)
    assert f.count() == 30 and f.select("frame").distinct().count() == 10
    with pytest.raises(ValueError):
        tables.rotation_frames(df, axis="w")
    one = spark.createDataFrame([(0, 0, 1, 0.5)], "row_ int, col_ int, layer int, value double")
    one.write.parquet(f"{tmp_path}/r")
    with pytest.raises(ValueError):
        tables.read_bands(spark, [f"{tmp_path}/r"])


def test_streams(spark, tmp_path):
    from timberline.streaming import grids

    src = f"{tmp_path}/in"
    table = spark.read.parquet("/root/testdata/sf0.001/las.parquet")
    table.write.parquet(src)
    s = spark.readStream.schema(table.schema).parquet(src)
    for name, df, mode in (("tops", grids.running_tops(s, 50.0), "complete"), ("once", grids.deliveries(s), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    from timberline.operators.points import usable_points, usable_rows

    assert spark.sql("select sum(n) from tops").first()[0] == usable_rows(table).count()
    assert spark.sql("select count(*) from once").first()[0] == usable_points(table).count()


def test_entry_works_without_the_llm_package():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and "p2_found" in q and "p4_found" in q


def test_queries_over_the_whole_cloud(spark, las, tmp_path):
    """Points below and above the slice have rows and are neighbours."""
    q = reference_queries.QUERIES
    rnd = np.random.default_rng(4)
    p = rnd.uniform((0, 0, 0), (1.2, 1.2, 4), (150, 3))
    las([(i, *map(float, r)) for i, r in enumerate(p)]).write.parquet(str(tmp_path / "las.parquet"))
    rows = lambda name: q[name](spark, str(tmp_path)).collect()
    d = p[None] - p[:, None]
    dist, flat = np.sqrt((d**2).sum(2)), np.hypot(d[..., 0], d[..., 1])
    large = reference_queries.LARGE
    near = (dist <= large).sum(1)
    assert {r.id: r.NumNeighbors for r in rows("eigen_metrics_full")} == dict(enumerate(near)) == {r.id: r.NumNeighbors for r in rows("eigen_density")}
    assert {r.id: r.n for r in rows("neighborhood_covariance")} == dict(enumerate(near)) and len(rows("eigen_invariants")) == 150
    assert {r.id: r.n for r in rows("count_in_disc")} == dict(enumerate((flat <= large).sum(1)))
    assert {r.id: r.n for r in rows("count_in_sphere")} == dict(enumerate((dist <= reference_queries.SPHERE).sum(1)))
    for r in rows("knn_within"):
        assert np.argsort(dist[r.l_id])[r.rank] == r.r_id and dist[r.l_id, r.r_id] <= large
    links = {(a, b) for a in range(150) for b in np.argsort(dist[a])[1:51] if dist[a, b] <= reference_queries.LONGEST}
    links |= {(b, a) for a, b in links}
    assert {(r.src, r.dst) for r in rows("graph_edges")} == links
    assert {r.node: r.degree for r in rows("graph_degree")} == dict(Counter(a for a, _ in links))
    part = list(range(150))
    for _ in part:
        part = [min(part[b] for b in np.flatnonzero(dist[a] <= reference_queries.LONGEST)) for a in range(150)]
    assert {r.node: r.component for r in rows("connected_points")} == dict(enumerate(part))
    for r in rows("pcv"):
        sky = []
        for t in 2 * math.pi * np.arange(60) / 60:
            seen = [math.atan2(d[r.id, j, 2], flat[r.id, j]) for j in range(150) if j != r.id and dist[r.id, j] <= 1.0005 and d[r.id, j, 0] * math.cos(t) + d[r.id, j, 1] * math.sin(t) > 0.7 * flat[r.id, j]]
            sky.append(math.pi / 2 - max(seen) if seen else math.pi / 2)
        assert abs(r.value - np.mean(sky)) < 1e-6


def test_centres_of_one_cell_and_chains(spark):
    rnd = random.Random(2)
    peaks = {(3, 3): 90, (3 + 13, 3 + 13): 50} | {(100 + 10 * i, 100): 60 - i for i in range(8)}  # 13 px each way: 0.9 m
    peaks |= {(rnd.randrange(200, 300), rnd.randrange(100)): rnd.randrange(3, 40) for _ in range(400)}
    rows = [(1, *k, v) for k, v in peaks.items()]
    want = []
    for _, x, y, v in sorted(rows, key=lambda r: (-r[3], r[0], r[2], r[1])):
        if all(math.hypot(x - a, y - b) > 15 for a, b in want):
            want.append((x, y))
    got = hough.merge_centres(spark.createDataFrame(rows, "step int, px int, py int, votes long"), 0.05, 0.25).collect()
    assert len(got) == len(want) and {(r.px, r.py) for r in got} == set(want) and {(3, 3), (16, 16), (120, 100)} <= set(want)


def test_circle_through_the_rim_of_a_disc(spark):
    disc = [(i + 5, j - 40, label) for i in range(-25, 26) for j in range(-25, 26) for label, r in (("a", 20), ("b", 8)) if i * i + j * j <= r * r]
    cells = spark.createDataFrame(disc + [(500, 500, "c")], "row_ int, col_ int, label string")
    rim = grid.rim_cells(cells).select("label", grid.pack(F.col("row_"), F.col("col_")).alias("id"), F.col("col_").cast("double").alias("x"), F.col("row_").cast("double").alias("y"))
    got = {r.label: r for r in fits.landau_groups(rim, "label").collect()}
    assert rim.where("label = 'c'").count() == 1
    assert abs(got["a"].r - 20) < 1 and abs(got["b"].r - 8) < 1 and abs(got["a"].cx + 40) < 0.1 and abs(got["a"].cy - 5) < 0.1


def test_circles_and_layers_use_all_points(spark):
    p = cylinder(r=0.2, h=3.0, n=5000, noise=0.004, seed=8)
    df = cloud(spark, p).withColumn("tree_id", F.lit(1))
    c, e = fits.circle_irls(p[:, 0], p[:, 1])
    got = fits.fit_circles(df, "tree_id", "irls").first()
    assert np.allclose([got.cx, got.cy, got.radius, got.err], [*c, e])
    got = fits.landau_groups(df, "tree_id").first()
    assert np.allclose([got.cx, got.cy, got.r], fits.landau_circle(p[:, 0], p[:, 1]))
    one = hough.stem_layers(df).collect()
    twice = hough.stem_layers(df.unionByName(df.withColumn("id", F.col("id") + 100000))).collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in twice] and all(r.votes > 0 for r in one)


@pytest.mark.parametrize("scaled,block_nodes", [(False, 10**6), (True, 30)])
def test_first_seeds_are_those_of_all_paths(spark, scaled, block_nodes):
    """Pruned labels, in one block per part or in small ones, choose what all paths of all seeds choose."""
    work = Workspace(spark, "test")
    g = np.random.default_rng(5)
    p = g.uniform(0, 3, (90, 2))
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    links = [(int(i) - 40, int(j) - 40, float(d[i, j])) for i in range(90) for j in np.argsort(d[i])[1:4]]
    edges = spark.createDataFrame(links, "src long, dst long, w double")
    radius = {int(i) - 40: float(r) for i, r in zip(g.permutation(90)[:12], g.uniform(0.01, 0.5, 12))}
    seeds = spark.createDataFrame(list(radius.items()), "node long, radius double")
    nodes = spark.createDataFrame([(i - 40,) for i in range(91)], "node long")
    w = np.full((90, 90), np.inf)
    for i, j, v in links:
        w[i + 40, j + 40] = w[j + 40, i + 40] = v
    np.fill_diagonal(w, 0)
    for k in range(90):
        w = np.minimum(w, w[:, k : k + 1] + w[k : k + 1])
    got = {r.node: (r.seed, r.dist) for r in graph.first_seeds(edges, seeds, nodes, work, None, scaled, block_nodes=block_nodes).collect()}
    assert set(got) == {i - 40 for i in range(91)} and got[50] == (0, None)
    for n in range(90):
        v, s = min((w[s + 40, n] * ((2 * r) ** -0.125 if scaled else 1), s) for s, r in radius.items())
        assert got[n - 40] == (0, None) if v == np.inf else got[n - 40][0] == s and abs(got[n - 40][1] - v) < 1e-9


@pytest.mark.parametrize("low,shift", [(3.0, 0), (0.5, -1000)])
def test_claims_reach_any_distance_and_ids_may_be_negative(spark, low, shift):
    p = [(10.0, 10.0, 0.5 + 0.15 * i) for i in range(34)]
    df = cloud(spark, p, classification=[1] * 34).withColumn("id", F.col("id") + shift)
    t = spark.createDataFrame([(7, 10.0, 10.0, 1.3, 0.15, 0.01)], "tree_id int, x double, y double, z double, radius double, error double")
    out = trees.segment_points(df, t, Workspace(spark, "test"), k=6, longest=0.33, low=low, high=low + 2)
    assert {r.tree_id for r in out.collect()} == {7}


def test_nearest_however_far(spark):
    g = np.random.default_rng(3)
    a, b = g.uniform(-1, 1, (40, 3)) * [[1000, 1000, 10]], g.uniform(-1, 1, (60, 3))
    got = {r.l_id: (r.r_id, r.dist) for r in spatial.nearest(cloud(spark, a), cloud(spark, b), 0.1, Workspace(spark, "test")).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert {k: v[0] for k, v in got.items()} == {i: int(d[i].argmin()) for i in range(40)} and all(abs(v[1] - d[k].min()) < 1e-9 for k, v in got.items())
    assert spatial.nearest(cloud(spark, a), cloud(spark, b).limit(0), 0.1, Workspace(spark, "test")).count() == 0


def test_subsets_of_all_points(spark):
    """A group of 50,000 points, of which the fits see more than any fixed first part of ids."""
    assert fits._rounds(25, 5, 0.9, 0.95) == 100 and fits._rounds(5, 5, 0.9, 0.95) == 20
    p = np.concatenate([cylinder(0.5, 2.0, 5000, 0.002, 1), cylinder(0.2, 2.0, 45000, 0.002, 2)])
    df = cloud(spark, p).withColumn("tree", F.lit(1))
    c = fits.fit_circles(df, "tree", "ransac", n=10, n_best=0).first()
    assert abs(c.radius - 0.2) < 0.02 and np.hypot(c.cx, c.cy) < 0.02
    r = fits.fit_groups(df, "tree", "ransac", n=10).first()
    assert abs(r.radius - 0.2) < 0.03
    rows = fits.subset_rows(df, "tree", 30_000).agg(F.count("*").alias("n"), F.min("_total").alias("t"), F.countDistinct("_order").alias("o")).first()
    assert tuple(rows) == (30_000, 50_000, 30_000)
    x, y = p[:500, 0], p[:500, 1]
    whole, part = (fits.ransac_circle(x, y, 5, 0.9, 0.95, 0, np.random.default_rng(0), t) for t in (None, 50_000))
    assert np.isfinite(whole).all() and part[3] < whole[3]  # the error divides by the size of the group


def test_tilts_are_found(spark):
    p = cylinder(0.2, 2.0, 120, 0.002, 9) @ fits.rotation(-6, 4).T
    b = fits.fit_groups(cloud(spark, p).withColumn("tree", F.lit("a")), "tree", "bf", n=8, max_angle=8, n_best=3).first()
    assert abs(b.radius - 0.2) < 0.02 and b.err < 0.002 and (abs(b.ax) > 2 or abs(b.ay) > 2)


def test_cylinders_use_all_points(spark):
    """Groups of more than a hundred points: the fit of all of them, beside the fits of other groups."""
    a, b = cylinder(0.15, 1.5, 400, 0.005, 456), cylinder(0.3, 2, 90, 0.005, 7, 5, 5)
    df = cloud(spark, np.concatenate([a, b]), tree=[1] * 400 + [2] * 90)
    for method, fit in (("irls", fits.fit_irls), ("nm", fits.fit_nm)):
        got = {r.tree: r for r in fits.fit_groups(df, "tree", method).collect()}
        for t, p in ((1, a), (2, b)):
            q, e = fit(p)
            assert abs(got[t].radius - q[4]) < 1e-4 and abs(got[t].err / e - 1) < 0.05, method


def _cost(f):
    start = time.process_time()
    got = f()
    return got, time.process_time() - start


def test_cylinders_side_by_side():
    """Fits of many clouds cost a part of as many single ones and don't depend on what stands beside them."""
    g = np.random.default_rng(1)
    clouds = [cylinder(g.uniform(0.1, 0.4), 1.5, int(g.integers(8, 60)), 0.005, i, i) for i in range(150)]
    (p, e), spent = _cost(lambda: fits.fit_cylinders(clouds, True))
    few, alone = _cost(lambda: [fits.fit_irls(c) for c in clouds[:10]])
    assert spent / 150 < alone / 10 / 2
    assert all(abs(q[4] - p[i, 4]) < 1e-3 and abs(v - e[i]) < 1e-5 for i, (q, v) in enumerate(few))
    q, v = fits.fit_cylinders(clouds[40:43], True)
    assert np.array_equal(q, p[40:43]) and np.array_equal(v, e[40:43])
    large = cylinder(0.2, 2.0, fits.ALONE, 0.004, 3)
    p, e = fits.fit_cylinders([large, large[:-1]], True)
    assert np.allclose(p[:, 4], 0.2, atol=0.002) and abs(e[0] / e[1] - 1) < 0.01


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_groups_stay_whole(monkeypatch, rows):
    """Groups that reach over the frames of a task, however many rows are joined."""
    monkeypatch.setattr(fits, "STACK_ROWS", rows)
    t = pd.DataFrame({"k": ["a"] * 3 + ["b"] * 30 + ["c"] + ["d"] * 4, "v": range(38)})
    got = list(fits._whole_groups((t.iloc[i : i + 5] for i in range(0, 38, 5)), "k"))
    assert list(pd.concat(got)["v"]) == list(range(38)) and sum(f["k"].nunique() for f in got) == 4


def test_subsets_of_many_groups_at_once():
    p = cylinder(0.2, 2.0, 300, 0.004, 5)
    g = np.random.default_rng(2)
    subsets = np.array([p[g.permutation(300)[:10]] for _ in range(1400)])
    (q, e), spent = _cost(lambda: fits.fit_many(subsets))
    few, parts = _cost(lambda: [fits.fit_many(subsets[i : i + 35]) for i in range(0, 140, 35)])
    assert spent / 40 < parts / 4 / 2  # 40 groups at once cost less than half of as many by themselves
    assert np.array_equal(np.concatenate([f[1] for f in few]), e[:140])
    # a different order of additions may lead a simplex elsewhere, yet not in many cases
    assert sum(abs(fits.fit_nm(subsets[i])[1] - e[i]) < 1e-6 for i in range(20)) >= 14
    assert all(abs((fits.cylinder_residuals(q[i], fits._centred(subsets[i])) ** 2).sum() - e[i]) < 1e-9 for i in np.flatnonzero(np.isfinite(e)))


def test_circles_side_by_side():
    g = np.random.default_rng(4)
    clouds = [cylinder(g.uniform(0.1, 0.4), 1.5, int(g.integers(4, 60)), 0.005, i, i % 7, 3)[:, :2] for i in range(150)]
    starts = np.array([fits._circle_start(c[:, 0], c[:, 1]) for c in clouds])
    (p, e), spent = _cost(lambda: fits.minimise_many(fits._circle_planes, clouds, starts, True))
    few, alone = _cost(lambda: [fits.circle_irls(c[:, 0], c[:, 1]) for c in clouds[:15]])
    assert spent / 150 < alone / 15 / 2
    assert all(np.allclose(q, p[i], atol=1e-3) and abs(v - e[i]) < 1e-5 for i, (q, v) in enumerate(few))


def test_tilts_together():
    """All tilts about y at once: subsets of distinct points, the circles of one tilt at a time, at a part of the cost."""
    d = fits._distinct(6, 5, 3000, np.random.default_rng(0))
    assert all(len(set(c)) == 5 for c in d.T.tolist()) and np.bincount(d.ravel()).min() > 2300
    p, ays, k = cylinder(0.2, 2.0, 60, 0.01, 5), np.arange(-30, 31), fits._rounds(25, 5, 0.9, 0.95)
    got, spent = _cost(lambda: [fits.tilted_circles(p, 4, ays, 5, 0.9, 0.95, 20, np.random.default_rng(7)) for _ in range(5)][0])
    d, want = fits._distinct(60, 5, k * 61, np.random.default_rng(7)), []
    for j, ay in enumerate(ays):
        t, s = p @ fits.rotation(4, ay), d[:, j * k : (j + 1) * k].T
        c = fits.circles_ls(t[:, 0][s], t[:, 1][s])
        c[:, 3] = np.sqrt(c[:, 3] / 60)
        c = c[np.isfinite(c).all(1)]
        c = c[np.argsort(c[:, 3], kind="stable")][:22]
        want.append([*(fits.upper_median(c[:, i]) for i in range(4)), 4, ay])
    assert np.allclose(got, min(want, key=lambda w: w[3]))
    _, alone = _cost(lambda: [fits.ransac_circle(t[:, 0], t[:, 1], 5, 0.9, 0.95, 20, np.random.default_rng(j)) for j in range(61)])
    assert spent / 5 < alone


def _discs_in_order(rows, reach, least):
    """The rule in plain words: strongest first; whoever is free becomes a head and takes all free ones near."""
    tree = {}
    for d, x, y, v in sorted(rows, key=lambda r: (-r[3], r[0])):
        if d in tree:
            continue
        for e, a, b, _ in rows:
            if e not in tree and math.hypot(x - a, y - b) < reach:
                tree[e] = d
    return {d: t for d, t in tree.items() if sum(1 for u in tree.values() if u == t) >= least}


@pytest.mark.parametrize("least", [1, 2])
def test_groups_of_discs(spark, least):
    rnd = random.Random(4)
    rows = [(i, 0.4 * i, 0.0, 10 - i) for i in range(1, 5)] + [(100 + i, 20 + rnd.uniform(0, 4), rnd.uniform(0, 4), rnd.randint(3, 30)) for i in range(150)]
    df = spark.createDataFrame(rows, "disc long, x double, y double, votes int").withColumn("layer", F.lit(1))
    got = {r.disc: r.tree for r in hough.group_discs(df, 0.5, least).collect()}
    assert got == _discs_in_order(rows, 0.5, least) and (least == 2 or (got[2] == 1 and got[3] == 3 and got[4] == 3))
    some = df.withColumn("circles", F.when(F.col("disc") % 2 == 0, 10).otherwise(2))
    assert {r.disc % 2 for r in hough.group_discs(some, 0.5, 1, 0.5).collect()} == {0}
    assert hough.group_discs(df.limit(0), 0.5).count() == 0


def test_layers_keep_the_guide_below_its_slice(spark):
    def ring_at(cx, z, n, r=0.2):
        t = np.linspace(0, 2 * np.pi, n, endpoint=False)
        return np.column_stack([cx + r * np.cos(t), r * np.sin(t), np.full(n, z)])

    p = np.concatenate([ring_at(0, z, 400) for z in (0.2, 1.2, 1.7, 2.2, 2.7, 3.2, 3.7)] + [ring_at(0.03, 4.2, 400), ring_at(0.06, 4.7, 400), [[0, 0, -0.5]], ring_at(0, 5.1, 3)])
    got = {r.layer: r for r in hough.stem_layers(cloud(spark, p, tree_id=[4] * len(p))).collect()}
    # layers count from 0; an empty or thin one carries the circle below it on
    assert sorted(got) == list(range(11)) and got[1].carried and got[10].carried and not got[0].carried and got[10].x == got[9].x
    assert abs(got[0].radius - 0.2) <= 0.03 and abs(got[9].x - got[0].x) > 0.02 and all(r.votes >= 3 for r in got.values())


def test_stem_fits_fall_back(spark):
    a, b = cylinder(0.15, 1.0, 80, 0.003, 1), cylinder(0.4, 1.0, 80, 0.003, 2, 3, 3)
    df = cloud(spark, np.concatenate([a, b]), plot=[1] * 80 + [2] * 80, tree_id=[5] * 160, segment=[0] * 160).withColumn("hough_radius", F.lit(0.15))
    for form, cx in (("cylinder", "px"), ("circle", "cx")):
        # five points fit a cylinder of five parameters exactly, whatever its radius; twenty don't
        got = {r.plot: r for r in hough.stem_fits(df, 0.05, ("plot", "tree_id", "segment"), form, n=20).collect()}
        assert not got[1].fallback and abs(got[1].radius - 0.15) < 0.03 and got[2].fallback and got[2].radius == 0.15 and got[2].err == 0
        assert abs(got[2][cx] - (b[:, 0].min() + b[:, 0].max()) / 2) < 1e-9
    with pytest.raises(ValueError):
        hough.stem_fits(df, form="cone")


def test_quantiles_and_hulls_of_hot_keys(spark):
    """One key with most rows, one with few: same results, and no frame over the chunk."""
    g = np.random.default_rng(7)
    p = np.round(g.normal(0, 5, (6000, 3)), 2)
    key = [0] * 5400 + [1] * 24 + [2 + i % 90 for i in range(576)]
    df = cloud(spark, p, tree_id=key)
    q = {r.tree_id: r.q for r in trees.key_quantiles(df, "tree_id", "z", 20).collect()}
    k = np.array(key)
    for t in (0, 1, 2):
        assert np.allclose(q[t], np.quantile(p[k == t, 2], np.arange(21) / 20))
    thin = trees._hull_points(df, 2, chunk=500)
    assert thin.where("tree_id = 0").count() < 1500
    area = {r.tree_id: r.crown_area for r in trees.crown_hulls(df).collect()}
    for t in (0, 1, 2):
        assert abs(area[t] - trees.area_2d(trees.hull_2d(p[k == t, :2]))) < 1e-9
    solid = trees._hull_points(df, 3, chunk=500).where("tree_id = 0").toPandas()
    assert abs(trees.hull_3d(solid[["x", "y", "z"]].to_numpy())[0] - trees.hull_3d(p[k == 0])[0]) < 1e-6


def test_votes_along_normals_by_group(spark):
    t = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    p = np.column_stack([np.cos(t) * 0.2, np.sin(t) * 0.2, t * 0])
    n = cloud(spark, np.concatenate([p, p]), part=[1] * 60 + [2] * 60, nx=np.cos(t).tolist() * 2, ny=np.sin(t).tolist() * 2, nz=[0.0] * 120)
    both, apart = (hough.normal_votes(n, 0.05, 0.3, True, by).agg(F.max("votes")).first()[0] for by in ((), ("part",)))
    assert both == 2 * apart
