"""Splitting, clusters, neighbours and percentiles against brute force on small clouds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import clusters, neighbors, percentiles, split
from timberline.runtime import Workspace

NAN = float("nan")


def strip(n, seed=1, gaps=(), crowd=0):
    """Positions along a strip in millimetres, with empty stretches and a crowded place."""
    rnd = random.Random(seed)
    xs = [rnd.randint(0, 40_000) for _ in range(n)] + [20_000] * crowd
    return [x / 1000 for x in xs if not any(a < x / 1000 < b for a, b in gaps)]


@pytest.fixture(scope="module")
def scans(spark):
    return spark.createDataFrame([(1, "X"), (2, " y"), (3, "Q"), (None, "X"), (4, None)], "scan_id bigint, axis string")


def test_boundaries_and_pieces(spark, las, scans):
    gaps = ((5.0, 6.5), (11.0, 12.0), (33.0, 39.0))
    a, b = strip(1500, 1, gaps), strip(200, 2, ((1.0, 9.0),))
    rows = [(i, x, 0.0, 0.0) for i, x in enumerate(a)] + [(5000 + i, 0.0, x, 0.0) for i, x in enumerate(b)] + [(9000 + i, 0.01 * i, 0.0, 0.0) for i in range(500)]
    ids = [1] * len(a) + [2] * len(b) + [3] * 500
    df = las(rows + rows[:40], scan_id=ids + ids[:40]).withColumn("axis", F.lit("Y"))
    p = split.scan_positions(df, scans)
    assert {r.item for r in p.select("item").distinct().collect()} == {1, 2}
    order = sorted({x for x in a})
    first = {x: min(i for i, y in enumerate(a) if y == x) for x in order}
    want = {tuple(sorted((first[u], first[v]))) for u, v in zip(order, order[1:]) if round((v - u) * 1000) >= 1000}
    got = split.natural_boundaries(p, range_length=8.0).collect()
    assert {(r.point_a, r.point_b) for r in got} == want and len(got) == len(want) >= 3
    assert split.natural_boundaries(p.limit(0)).count() == 0 and split.cut_pieces(p.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [0, 150, 700])
def test_pieces_cover_and_overlap(spark, las, scans, crowd):
    a = strip(1400, 3, ((5.0, 6.5), (11.0, 12.0), (30.0, 39.0)), crowd)
    p = split.scan_positions(las([(i, x, 0.0, 0.0) for i, x in enumerate(a)]), scans)
    pieces = split.cut_pieces(p, range_length=8.0)
    t = pieces.toPandas().sort_values("first")
    assert (t.n_points <= 400).all() and (t.n_core > 0).all() and t.n_core.sum() == len(a)
    assert list(t["first"]) == [0, *t.n_core.cumsum()[:-1]] and list(t.piece) == list(range(1, len(t) + 1))
    m = split.piece_members(p, pieces, range_length=8.0).toPandas()
    assert sorted(m[~m.shared].id) == list(range(len(a))) and len(m) == t.n_points.sum()
    pos = dict(enumerate(a))
    rank = {i: k for k, i in enumerate(sorted(pos, key=lambda i: (pos[i], i)))}
    by_rank = sorted(a)
    for r in t.itertuples():
        last = r.first + r.n_core - 1
        after = [k for k in range(last + 1, len(a)) if by_rank[k] <= by_rank[last] + 0.5 + 1e-9]
        if len(after) + r.n_core <= 400:  # else the limit wins
            assert r.n_points - r.n_core == len(after)
    assert rank is not None


def test_groups_against_brute_force(spark, las):
    rnd = random.Random(4)
    rows = []
    for k in range(25):
        cx, cy = rnd.uniform(0, 20), rnd.uniform(0, 20)
        rows += [(cx + rnd.gauss(0, 0.5), cy + rnd.gauss(0, 0.5), rnd.uniform(0, 2)) for _ in range(rnd.randint(1, 30))]
    rows += [(30 + 0.75 * i, 0.0, 0.0) for i in range(40)]  # a long chain
    rows += [(60.0, 60.0, 1.0)] * 60 + [(60.0, 60.8, 1.0)] * 60  # crowded places at 0.8
    rows += [(80 + rnd.uniform(0, 0.4), rnd.uniform(0, 0.05), 0.0) for _ in range(150)] + [(81.15 + rnd.uniform(0, 0.05), rnd.uniform(0, 0.05), 0.0) for _ in range(150)]
    p = [(i, *(round(v, 3) for v in q)) for i, q in enumerate(rows)]
    x = np.array([q[1:] for q in p])
    near = ((x[:, None] - x[None]) ** 2).sum(2) < 0.8005**2
    label = np.arange(len(p))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(p))])
        if (new == label).all():
            break
        label = new
    want = {(int(g), i) for i, g in enumerate(label) if (label == g).sum() >= 5}
    df = las(p + p[:30])
    got = clusters.unlabelled_groups(df).select("group_id", "point_id").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    d = {r.group_id: r for r in clusters.describe_groups(df).collect()}
    assert {g: r.n_points for g, r in d.items()} == {g: sum(1 for h, _ in want if h == g) for g, _ in want}
    assert all(len(r.typical) == 3 and {(g, t) for t in r.typical} <= want for g, r in d.items())
    assert clusters.unlabelled_groups(df.limit(0)).count() == 0


def test_flow_is_stochastic_and_bounded(spark):
    work = Workspace(spark, "test")
    n = 300
    hub = [(0, i, 0.9) for i in range(1, n)] + [(i, 0, 0.9) for i in range(1, n)]
    nodes = spark.createDataFrame([(i, 1) for i in range(n)], "node long, weight long")
    flow = clusters.markov_flow(nodes, spark.createDataFrame(hub, "a long, b long, w double"), work)
    c = flow.groupBy("col").agg(F.sum("v").alias("s"), F.count("*").alias("n")).toPandas()
    assert len(c) == n and np.allclose(c.s, 1) and c.n.max() <= 100


def _nearest(x, ids, k=3):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, 2**60)
    out = set()
    for i in range(len(x)):
        for j in np.lexsort((ids, d[i]))[:k]:
            if j != i:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return {(int(a), int(b)) for a, b in out}


def test_neighbours_against_brute_force(spark):
    g = np.random.default_rng(2)
    x = np.concatenate([g.integers(0, 60_000, (150, 3)), g.integers(0, 300, (150, 3)), np.full((40, 3), 7777), [[10**6, 10**6, 0]]])
    ids = g.permutation(len(x)) + 100
    df = spark.createDataFrame([(int(i), *map(int, v)) for i, v in zip(ids, x)], "id long, x long, y long, z long")
    got = neighbors.nearest_pairs(df.unionByName(df.limit(20))).collect()
    assert {tuple(r) for r in got} == _nearest(x, ids) and len({tuple(r) for r in got}) == len(got)
    assert neighbors.nearest_pairs(df.limit(0)).count() == 0 and neighbors.nearest_pairs(df.limit(1)).count() == 0 and neighbors.nearest_pairs(df.limit(3)).count() == 3


def test_graph_finds_most_and_search_too(spark):
    las = spark.read.parquet("/root/testdata/sf0.01/las.parquet")
    v = neighbors.slice_vectors(las)
    t = v.toPandas()
    x, ids = t[["x", "y", "z"]].to_numpy(), t.id.to_numpy()
    want = _nearest(x, ids)
    work = Workspace(spark, "test")
    graph = neighbors.nn_descent(v, work)
    top = graph.toPandas().sort_values(["src", "d2", "dst"]).groupby("src").head(3)
    got = {(min(a, b), max(a, b)) for a, b in zip(top.src, top.dst)}
    assert len(got & want) / len(want) >= 0.9
    queries = v.where("id % 50 = 0").select(F.col("id").alias("query"), *[F.col(c).alias("q" + c) for c in "xyz"])
    r = neighbors.search_graph(graph, queries, work).toPandas()
    hit = 0
    for q, part in r.groupby("query"):
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        d[ids == q] = 2**60
        hit += len(set(ids[np.lexsort((ids, d))[:3]]) & set(part.dst))
    assert set(r["query"]) == {i for i in ids if i % 50 == 0} and hit / (3 * r["query"].nunique()) >= 0.9


def test_percentiles_by_many_rounds(spark, las):
    rnd = random.Random(6)
    rows, trees, vert = [], [], []
    for i in range(4000):
        rows.append((i, 0.0, 0.0, round(rnd.gauss(10, 4), 2) if i % 3 else 5.0))
        trees.append(0 if i < 2500 else None if i % 97 == 0 else 1000 + i % 7)
        vert.append(None if i % 11 == 0 else NAN if i % 13 == 0 else rnd.random())
    df = las(rows + rows[:100], treeID=trees + trees[:100], verticality=vert + vert[:100])
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]
    z = {}
    for (i, _, _, h), t, v in zip(rows, trees, vert):
        if t is not None:
            z.setdefault((t, "Z"), []).append(h)
            if v is not None and v == v:
                z.setdefault((t, "verticality"), []).append(v)
    want = {(*k, p): float(np.quantile(v, p)) for k, v in z.items() for p in ps}
    for kw in ({"block_values": 64}, {}):
        got = {(r.treeID, r.measure, r.p): r.value for r in percentiles.tree_percentiles(df, ps, **kw).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    loose = {(r.treeID, r.measure, r.p): r.value for r in percentiles.tree_percentiles(df, [0.5], block_values=64, rank_error=0.05).collect()}
    for (t, m, p), v in loose.items():
        lo, hi = np.quantile(z[t, m], [p - 0.06, p + 0.06])
        assert lo <= v <= hi
    assert percentiles.striking_trees(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        percentiles.tree_percentiles(df, [1.5])


def test_striking_trees(spark, las):
    rows = [(i, 0.0, 0.0, 20.0 if i % 10 == 0 else 1.0) for i in range(60)] + [(100 + i, 0.0, 0.0, 1.0) for i in range(29)]
    df = las(rows, treeID=[0] * 60 + [7] * 29, verticality=[0.7] * 60 + [0.9] * 29)
    assert {tuple(r) for r in percentiles.striking_trees(df).collect()} == {(0, "verticality"), (0, "Z")}


@pytest.mark.parametrize("kind", ["even", "clustered", "grid"])
def test_lists_over_many_blocks(spark, kind):
    """Blocks of a few vectors: links cross their borders, and the check of balls that reach out is exact."""
    g = np.random.default_rng(11)
    x = {
        "even": lambda: g.integers(-4000, 4000, (1200, 3)),
        "clustered": lambda: np.concatenate([g.integers(0, 10**7, (30, 1)).repeat(3, 1) + g.integers(0, 200, (30, 3)), g.normal(0, 30, (1100, 3)).astype(int), [[-(10**8), 5, 5]]]),
        "grid": lambda: np.stack(np.meshgrid(*[np.arange(10) * 100] * 3), -1).reshape(-1, 3),
    }[kind]()
    ids = g.permutation(len(x)) + 1
    df = spark.createDataFrame([(int(i), *map(int, v)) for i, v in zip(ids, x)], "id long, x long, y long, z long")
    got = {tuple(r) for r in neighbors.nearest_pairs(df, block=60).collect()}
    want = _nearest(x, ids)
    if kind == "clustered":  # crowded places hold back nothing either
        assert len({tuple(v) for v in x.tolist()}) < len(x)
    assert got == want
    work = Workspace(spark, "test")
    lists, low, shift = neighbors.neighbour_lists(neighbors.thin_places(df, 3, work)[0], work, block=60)
    assert lists.select("block").distinct().count() >= 10 and lists.groupBy("id").count().where("count > 1").count() == 0
    found = neighbors.check_lists(lists, low, shift, 3, work).agg(F.avg(F.col("found").cast("double"))).first()[0]
    assert found >= (0.8 if kind == "clustered" else 0.9)  # one far vector leaves the crowd a single cell of the curve
    with pytest.raises(RuntimeError):
        neighbors.neighbour_lists(df, work, max_rounds=1, least_change=-1.0)
