"""Similarity clusters by Markov clustering on sparse distributed matrices, level by level.

Points closer than a radius are similar. Points that share a cell whose diagonal is the radius are similar
to each other, so a cell is one node, with its number of points as weight; that keeps the graph small where
points crowd. On the graph, flow is simulated: the column-stochastic matrix is squared, its entries are
raised to a power, small ones are pruned, and the row that attracts most of a column's flow is its cluster.
Flow never leaves a connected part, but one part may form several clusters. Clusters become the nodes of the
next level, as long as links between clusters are left; so the last level's clusters are exactly the parts
connected by similarity, and each point has its share of flow at every level.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.points import usable_points
from ..operators.skew import top_per_key
from ..runtime import Workspace

INFLATION = 1.8
#: Entries below this share of a column are dropped, so a column holds at most 1 / PRUNE entries.
PRUNE = 0.01
#: Squarings per level; the clusters of a level needn't be final.
SQUARINGS = 2
#: Boxes per cell and axis in which points are summed up for the distance between cells.
BOXES = 8
MAX_LEVELS = 60
#: Boxes shrink to an eighth at most so often: to less than the last place of a coordinate of 100 km.
MAX_HALVINGS = 14


def _axes(pattern: str) -> list[str]:
    return [pattern.format(c) for c in "xyz"]


def cell_graph(points: DataFrame, radius: float, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, links): the cell of each point (node, point_id), the weight of each node, and for
    each pair of similar cells (a, b, both ways) their closeness w in (0, 1]. Two cells are similar if some
    point of one is closer than ``radius`` to some point of the other.

    Points are summed up in small boxes with tight bounds. A pair of boxes is certainly similar if even
    their farthest corners are close enough - as with boxes of one point, or of equal points -, and
    certainly not if their nearest are not; pairs of cells which no pair of boxes decides are asked again with
    smaller boxes, so dense neighbours at about the radius give no pairs of all their points.
    """
    edge = radius / math.sqrt(3) * (1 - 1e-9)
    fine = edge / BOXES
    p = points.select("point_id", "x", "y", "z", *[F.floor(F.col(c) / edge).alias("c" + c) for c in "xyz"], *[F.floor(F.col(c) / fine).alias("b" + c) for c in "xyz"])
    p = work.put("points", p)
    cell, box = _axes("c{}"), _axes("b{}")
    cells = p.groupBy(*cell).agg(F.min("point_id").alias("node"), F.count("*").alias("weight"))
    cells = work.put("cells", cells)
    members = work.put("members", p.join(cells.drop("weight"), cell).select("node", "point_id"))
    r2 = F.lit(float(radius) ** 2)
    both = [*_axes("ac{}"), *cell]
    bounds = [f(c).alias(m + c) for c in "xyz" for m, f in (("lo", F.min), ("hi", F.max))]
    least = sum((lambda g: g * g)(F.greatest(F.lit(0.0), F.col("lo" + c) - F.col("ahi" + c), F.col("alo" + c) - F.col("hi" + c))) for c in "xyz")
    most = sum((lambda g: g * g)(F.greatest(F.col("hi" + c) - F.col("alo" + c), F.col("ahi" + c) - F.col("lo" + c))) for c in "xyz")

    def judge(pairs: DataFrame) -> DataFrame:
        """Per pair of cells: d2, an upper bound of the least distance, and whether smaller boxes could lower it."""
        near_boxes = pairs.withColumn("_least", least).withColumn("_most", most).where(F.col("_least") < r2)
        return near_boxes.groupBy(*both).agg(F.min("_most").alias("d2"), F.max((F.col("_most") >= r2).cast("int")).alias("_unsure"))

    boxes = work.put("boxes", p.groupBy(*cell, *box).agg(*bounds, F.count("*").alias("n")))
    # every box meets the boxes of the cells that follow its own and reach into its surroundings
    near = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias("d" + c) for c, v in zip("xyz", s)]) for s in near])).alias("s")
    a = boxes.select(*[F.col(c).alias("a" + c) for c in boxes.columns], steps)
    a = a.select(*[c for c in a.columns if c != "s"], *[(F.col("ac" + c) + F.col("s.d" + c)).alias("c" + c) for c in "xyz"])
    gap = [F.greatest(F.lit(0.0), F.col("c" + c) * edge - F.col("ahi" + c), F.col("alo" + c) - (F.col("c" + c) + 1) * edge) for c in "xyz"]
    a = a.where(sum(g * g for g in gap) < r2)
    judged = work.put("judged", judge(a.join(boxes, cell)))
    sure = judged.where(F.col("d2") < r2).select(*both, "d2")
    open_ = judged.where((F.col("d2") >= r2) & (F.col("_unsure") == 1)).select(*both)
    # what is open is asked again with boxes of an eighth, until boxes hold one place and leave no doubt; of
    # pairs of boxes only those that their larger boxes left in doubt are made
    doubt, depth = a.join(boxes, cell), 0
    while not open_.isEmpty():
        if depth == MAX_HALVINGS:
            raise RuntimeError("points too close to tell apart")
        doubt = doubt.withColumn("_least", least).withColumn("_most", most).where((F.col("_least") < r2) & (F.col("_most") >= r2)).join(open_, both)
        doubt = work.put(f"doubt-{depth}", doubt.select(*both, *_axes("ab{}"), *box).distinct())
        fine, depth = fine / 8, depth + 1
        small = work.put(f"small-{depth}", p.groupBy(*cell, *box, *[F.floor(F.col(c) / fine).alias("n" + c) for c in "xyz"]).agg(*bounds, F.count("*").alias("n")))
        p = p.withColumns({"b" + c: F.floor(F.col(c) / fine) for c in "xyz"})
        left = small.select(*[F.col(c).alias("a" + c) for c in small.columns])
        pairs = doubt.join(left, [*_axes("ac{}"), *_axes("ab{}")]).join(small, [*cell, *box]).drop(*_axes("ab{}"), *box)
        doubt = pairs.withColumnsRenamed({**{"an" + c: "ab" + c for c in "xyz"}, **{"n" + c: "b" + c for c in "xyz"}})
        again = work.put(f"judged-{depth}", judge(doubt))
        sure = sure.unionByName(again.where(F.col("d2") < r2).select(*both, "d2"))
        open_ = again.where((F.col("d2") >= r2) & (F.col("_unsure") == 1)).select(*both)
    one = cells.select(*[F.col("c" + c).alias("ac" + c) for c in "xyz"], F.col("node").alias("a"))
    links = sure.join(one, _axes("ac{}")).join(cells.select(*cell, F.col("node").alias("b")), cell)
    links = links.select("a", "b", (1.05 - F.sqrt("d2") / float(radius)).alias("w"))
    links = work.put("links", links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    return members, cells.select("node", "weight"), links


def _normal(m: DataFrame) -> DataFrame:
    """Columns that sum to 1 without entries below PRUNE; the largest entry of a column always stays."""
    c = Window.partitionBy("col")
    m = m.withColumn("v", F.col("v") / F.sum("v").over(c)).withColumn("_top", F.max("v").over(c))
    m = m.where((F.col("v") >= PRUNE) | (F.col("v") >= F.col("_top"))).drop("_top")
    return m.withColumn("v", F.col("v") / F.sum("v").over(c))


def markov_flow(nodes: DataFrame, links: DataFrame, work: Workspace, inflation: float = INFLATION, squarings: int = SQUARINGS) -> DataFrame:
    """(row, col, v): the flow matrix after some rounds of squaring, inflation and pruning.

    Each node has a loop as strong as its strongest link. A product has at most 1 / PRUNE terms for each
    entry, also around a node with very many links, as its column is pruned.
    """
    loops = nodes.join(links.groupBy(F.col("b").alias("node")).agg(F.max("w").alias("w")), "node", "left").select(F.col("node").alias("row"), F.col("node").alias("col"), F.coalesce("w", F.lit(1.0)).alias("v"))
    flow = work.put("flow", _normal(links.select(F.col("a").alias("row"), F.col("b").alias("col"), F.col("w").alias("v")).unionByName(loops)))
    for _ in range(squarings):
        left = flow.select("row", F.col("col").alias("mid"), F.col("v").alias("u"))
        right = flow.select(F.col("row").alias("mid"), "col", "v")
        square = left.join(right, "mid").groupBy("row", "col").agg(F.sum(F.col("u") * F.col("v")).alias("v"))
        flow = work.put("flow", _normal(square.withColumn("v", F.pow("v", inflation))))
    return flow


def cluster(points: DataFrame, radius: float, work: Workspace, inflation: float = INFLATION) -> DataFrame:
    """(point_id, group_id, flow): ``group_id`` is the smallest point_id of the group, ``flow`` the share
    that the point's cell attracts within its group, over all levels. ``points`` has point_id (unique),
    x, y, z. Points without a neighbour form groups of their own."""
    if not radius > 0:
        raise ValueError("radius must be positive")
    members, nodes, links = cell_graph(points, radius, work)
    # where: the present node of each cell, and its flow so far
    where = work.put("where", nodes.select(F.col("node").alias("cell"), "node", F.lit(0.0).alias("flow")))
    for _ in range(MAX_LEVELS):
        if links.isEmpty():
            break
        linked = work.put("linked", nodes.join(links.select(F.col("a").alias("node")).distinct(), "node", "left_semi"))
        flow = markov_flow(linked, links, work, inflation)
        # the attractor of each column, the smaller one on ties
        pick = work.put("pick", flow.groupBy("col").agg(F.max_by("row", F.struct("v", -F.col("row"))).alias("to")))
        sizes = pick.agg(F.count("*").alias("all"), F.countDistinct("to").alias("left")).first()
        if sizes["left"] == sizes["all"]:
            # the level would leave as many nodes, each drawn to itself or changed for another: they follow
            # their strongest links instead, of which the strongest of all joins two
            best = links.groupBy(F.col("a").alias("col")).agg(F.max_by("b", F.struct("w", -F.col("b"))).alias("to"))
            pick = work.put("pick", best.select("col", F.least("col", "to").alias("to")))
        weight = linked.withColumnsRenamed({"node": "col", "weight": "n"})
        drawn = flow.join(weight, "col").groupBy(F.col("row").alias("node")).agg(F.sum(F.col("v") * F.col("n")).alias("drawn"))
        share = linked.join(drawn, "node", "left").select("node", F.log(F.coalesce("drawn", F.lit(0.0)) / F.col("weight") + 1e-9).alias("drawn"))
        step = pick.select(F.col("col").alias("node"), "to").join(share, "node")
        where = work.put("where", where.join(step, "node", "left").select("cell", F.coalesce("to", "node").alias("node"), (F.col("flow") + F.coalesce("drawn", F.lit(0.0))).alias("flow")))
        to = pick.select(F.col("col").alias("_c"), F.col("to").alias("_t"))
        between = links.join(to.withColumnsRenamed({"_c": "a", "_t": "ta"}), "a").join(to.withColumnsRenamed({"_c": "b", "_t": "tb"}), "b").where("ta <> tb")
        links = work.put("links", between.groupBy(F.col("ta").alias("a"), F.col("tb").alias("b")).agg(F.sum("w").alias("w")))
        nodes = work.put("nodes", linked.withColumnRenamed("node", "_c").join(to, "_c").groupBy(F.col("_t").alias("node")).agg(F.sum("weight").alias("weight")))
    else:
        raise RuntimeError(f"links are left after {MAX_LEVELS} levels")
    # nodes of cells are smallest ids, so the smallest cell of a group names it
    ids = where.groupBy("node").agg(F.min("cell").alias("group_id"))
    named = work.put("named", where.join(ids, "node").select(F.col("cell").alias("node"), "group_id", "flow"))
    return members.join(named, "node").select("point_id", "group_id", "flow")


def unlabelled_groups(las: DataFrame, radius: float = 0.8005, least: int = 5) -> DataFrame:
    """(group_id, point_id, flow): groups of usable points with a null treeID, of at least ``least`` points."""
    work = Workspace(las.sparkSession, "clusters")
    points = usable_points(las, treeID="treeID").where(F.col("treeID").isNull()).select("point_id", "x", "y", "z")
    groups = work.put("groups", cluster(points, radius, work))
    large = groups.groupBy("group_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("group_id")
    return groups.join(large, "group_id", "left_semi").select("group_id", "point_id", "flow")


def describe_groups(las: DataFrame, radius: float = 0.8005, least: int = 5, typical: int = 3) -> DataFrame:
    """(group_id, n_points, typical): the size of each group and its ``typical`` points that attract most
    flow, strongest first, the smaller point_id on ties."""
    groups = unlabelled_groups(las, radius, least)
    size = groups.groupBy("group_id").agg(F.count("*").alias("n_points"))
    top = top_per_key(groups, "group_id", [F.col("flow").desc(), F.col("point_id")], typical)
    best = top.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("flow")).alias("f"), "point_id"))), lambda s: s["point_id"]).alias("typical"))
    return size.join(best, "group_id")
