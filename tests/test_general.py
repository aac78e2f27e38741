"""Neighbours, regions and hot keys against brute force, with dirty, tied, empty and clashing input."""

import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import points, regions, skew
from timberline.runtime import pick

NAN = float("nan")


def test_pick_prefers_exact_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "point_id long, `X` double, `cx` double").withColumn("_c0", F.lit(1))
    assert pick(df, a="X", b="cx").first() == (2.0, 3.0)
    with pytest.raises(ValueError):
        pick(df, a="missing")


def test_usable_rows(las):
    rows = [(1, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0), (3, 1.0, NAN, 1.0), (4, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0), (5, 2.0, 2.0, 2.0)]
    df = las(rows, cls=[5, 5, 5, 7, 5, 5, None])
    assert sorted(r[0] for r in points.usable_points(df).select("point_id").collect()) == [1, 5]


def test_near_pairs_against_brute_force(spark, las):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(-300, 300) / 1000, rnd.randint(-300, 300) / 1000, rnd.randint(0, 200) / 1000) for i in range(400)]
    rows += [(1000 + i, 0.1, 0.1, 0.1) for i in range(20)]  # one crowded place
    r = 0.0505
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and sum((a[k] - b[k]) ** 2 for k in (1, 2, 3)) < r * r}
    df = las(rows + rows[:50]).withColumn("cx", F.lit(1)).withColumn("KIND", F.lit("x"))
    got = regions.near_pairs(points.usable_points(df), r).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        regions.near_pairs(points.usable_points(df), 0)


def _inside(ring, x, y):
    n = 0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
            n += 1
    return n % 2 == 1


def test_inside_plots_against_brute_force(spark, las):
    rnd = random.Random(7)
    star = [(0.0, 0.0), (20.0, 3.0), (40.0, 0.0), (25.0, 12.0), (30.0, 30.0), (20.0, 15.0), (5.0, 33.0), (12.0, 12.0)]
    square = [(10.0, 10.0), (10.0, 30.0), (30.0, 30.0), (30.0, 10.0)]
    rows = [(i, rnd.randint(-5000, 45000) / 1000 + 0.0003, rnd.randint(-5000, 45000) / 1000 + 0.0003, 1.0) for i in range(800)]
    rows += [(5000, 5.0, 12.0, 0.0)]  # on the height of a corner
    plots = spark.createDataFrame(
        [(1, "ring", None, None, None, star), (2, "ring", None, None, None, square[::-1]), (3, "disc", 20.0, 20.0, 9.0, None), (4, "disc", None, 1.0, 2.0, None), (5, "ring", None, None, None, star[:2]),
         (6, "blob", 1.0, 1.0, 99.0, None), (7, "disc", 1.0, 1.0, NAN, None), (8, None, 1.0, 1.0, 9.0, None)],
        "plot_id int, shape string, cx double, cy double, radius double, ring array<struct<x double, y double>>",
    )
    want = {(p, i) for i, x, y, _ in rows for p, ok in ((1, _inside(star, x, y)), (2, _inside(square, x, y)), (3, (x - 20) ** 2 + (y - 20) ** 2 < 81)) if ok}
    df = las(rows + rows[:200])
    got = regions.inside_plots(points.usable_rows(df), plots).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    both = regions.near_and_inside(df, plots)
    assert both.columns == ["kind", "key_a", "key_b"]
    assert regions.near_and_inside(df.limit(0), plots.limit(0)).count() == 0


def test_adjoining_regions_share_no_point(spark, las):
    rings = [(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), (2, [(10.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.0, 10.0)])]
    r = spark.createDataFrame(rings, "region int, ring array<struct<x double, y double>>")
    p = points.usable_rows(las([(1, 10.0, 5.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 20.0, 5.0, 0.0), (4, 5.0, 10.0, 0.0)]))
    assert sorted(tuple(x) for x in regions.points_in_rings(p, r).collect()) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_regions_with_and_without_broadcast(spark, las, monkeypatch, limit):
    monkeypatch.setattr(regions, "MAX_BROADCAST_ROWS", limit)
    r = spark.createDataFrame([(1, "disc", 0.0, 0.0, 2.0, None)], "plot_id int, shape string, cx double, cy double, radius double, ring array<struct<x double, y double>>")
    assert [tuple(x) for x in regions.inside_plots(points.usable_rows(las([(1, 1.0, 1.0, 1.0), (2, 3.0, 0.0, 0.0)])), r).collect()] == [(1, 1)]


def test_hot_keys_give_the_same_results(spark, las):
    rnd = random.Random(3)
    rows, ids = [], []
    for i in range(3000):
        rows.append((i, 0.0, 0.0, rnd.randint(0, 50) / 10))
        ids.append(0 if i < 1500 else 1 if i < 2200 else None if i % 50 == 0 else 1000 + i % 200)
    want = {}
    for (i, _, _, z), t in zip(rows, ids):
        if t is not None and (t not in want or (-z, i) < want[t]):
            want[t] = (-z, i)
    df = las(rows + rows[:100], treeID=ids + ids[:100]).withColumn("_salt", F.lit(9))
    assert {r["treeID"]: r["point_id"] for r in skew.highest_returns(df, points.usable_rows).collect()} == {t: v[1] for t, v in want.items()}
    heavy = {r["treeID"] for r in skew.heavy_hitters(df.where("treeID is not null"), "treeID", 0.2).collect()}
    assert heavy == {0, 1}
    prof = {r["treeID"]: r["n_points"] for r in skew.key_profile(df, points.usable_rows).collect()}
    assert prof == {t: ids.count(t) for t in set(ids) if t is not None}
    top = skew.top_per_key(df.select("treeID", "point_id", "Z").dropDuplicates(["point_id"]), "treeID", [F.col("Z").desc(), F.col("point_id")], 5)
    assert top.groupBy("treeID").count().where("count <> least(count, 5)").count() == 0 and top.where("treeID = 0").count() == 5
    assert skew.highest_returns(df.limit(0), points.usable_rows).count() == 0
    with pytest.raises(ValueError):
        skew.top_per_key(df, "treeID", [F.col("Z")], 0)


def test_large_regions_and_crowded_cells(spark, las, monkeypatch):
    """A region 100 km wide has few copies of its edges; a crowd is salted and loses no pair."""
    wide = [(0.0, 0.0), (100_000.0, 10.0), (100_000.0, 40_000.0), (50_000.0, 90_000.0), (0.0, 60_000.0)]
    small = [(10.0, 10.0), (14.0, 10.0), (12.0, 15.0)]
    rnd = random.Random(9)
    rows = [(i, rnd.uniform(-10, 100_010), rnd.uniform(-10, 90_010), 1.0) for i in range(300)] + [(1000 + i, rnd.uniform(8, 16), rnd.uniform(8, 16), 1.0) for i in range(200)]
    plots = spark.createDataFrame([(1, "ring", None, None, None, wide), (2, "ring", None, None, None, small), (3, "disc", 50_000.0, 40_000.0, 30_000.0, None)], "plot_id int, shape string, cx double, cy double, radius double, ring array<struct<x double, y double>>")
    want = {(p, i) for i, x, y, _ in rows for p, ok in ((1, _inside(wide, x, y)), (2, _inside(small, x, y)), (3, (x - 50_000) ** 2 + (y - 40_000) ** 2 < 9e8)) if ok}
    stored = []
    put = regions.Workspace.put
    monkeypatch.setattr(regions.Workspace, "put", lambda self, name, df: stored.append((name, put(self, name, df))) or stored[-1][1])
    got = regions.inside_plots(points.usable_rows(las(rows)), plots).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert all(df.count() < 200 for name, df in stored if name in ("edges", "tiles"))
    crowd = [(i, rnd.randint(0, 200) / 1000, rnd.randint(0, 200) / 1000, 0.0) for i in range(400)]
    r = 0.0505
    near = {(a[0], b[0]) for a in crowd for b in crowd if a[0] < b[0] and sum((a[k] - b[k]) ** 2 for k in (1, 2, 3)) < r * r}
    p = points.usable_points(las(crowd))
    assert regions.cell_edge(p, r, 0.5) in (2 * r, 8 * r)
    for edge in (2 * r, 8 * r):
        got = regions.near_pairs(p, r, edge, crowd=30).collect()
        assert {tuple(x) for x in got} == near and len(got) == len(near)
