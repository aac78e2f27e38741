"""Graphs as edge tables: construction, connected parts, multi-source shortest paths, assignment to seeds."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import scale_column
from ..runtime import Workspace
from .spatial import knn_within

MAX_ROUNDS = 200
#: Nodes of a block that one task solves.
BLOCK_NODES = 50_000
#: Distances from here on count as unreachable.
UNREACHABLE = 999.0


def knn_edges(points: DataFrame, k: int = 50, longest: float = 0.33) -> DataFrame:
    """(src, dst, w): links to the k nearest others that are at most ``longest`` away."""
    return knn_within(points, k, longest, 3).select(F.col("l_id").alias("src"), F.col("r_id").alias("dst"), F.col("dist").alias("w"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each link in both directions, once, with its smallest weight; loops and null ends drop."""
    e = edges.where("src <> dst")
    both = e.select("src", "dst", "w").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.min("w").alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def components(edges: DataFrame, work: Workspace, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node of the connected part. ``edges`` has a, b of one sortable type;
    ``nodes`` (node) adds isolated ones.

    Alternating stars: every node links its larger neighbours to its smallest one, then its smaller ones;
    the number of rounds grows with the logarithm of the size of a part, whatever its shape, and the edge
    table only shrinks. A node with very many links never gathers them.
    """
    work = work.child("stars")
    edges = work.put("edges", edges.select("a", "b"))
    e = work.put("stars", edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        # links and their digest: equal ones in a row mean that nothing moves any more
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38, 0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        e = work.put("stars", small.where("u <> v").distinct())
    else:
        raise RuntimeError("no end of the rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    every = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    every = (every if nodes is None else every.unionByName(nodes.select("node"))).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


_LABEL = "node bigint, seed bigint, f double, dist double"


def _spread(links: dict, owned: set, labels: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """(labels of owned nodes, labels handed to others) by Dijkstra over scaled distances.

    Labels (value, seed, node, f, dist) come in order of value = f * dist, then seed. One that comes later
    can win further on only if its factor is smaller than all before, so a node keeps those alone.
    """
    heap = list(labels)
    heapq.heapify(heap)
    least: dict[int, float] = {}
    inside, outside = [], []
    while heap:
        value, seed, node, f, dist = heapq.heappop(heap)
        if f >= least.get(node, math.inf):
            continue
        least[node] = f
        (inside if node in owned else outside).append((node, seed, f, dist))
        if node in owned:
            for other, w in links.get(node, ()):
                if f < least.get(other, math.inf):
                    heapq.heappush(heap, (f * (dist + w), seed, other, f, dist + w))
    return inside, outside


def _solve(key: tuple, edges: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
    """One block: rows of its own nodes, and rows with ``to_block`` of what it hands to others."""
    links: dict[int, list[tuple[int, float]]] = {}
    block_of: dict[int, int] = {}
    for s, d, w, b in zip(edges["src"].tolist(), edges["dst"].tolist(), edges["w"].tolist(), edges["dst_block"].tolist()):
        links.setdefault(s, []).append((d, w))
        block_of[d] = b
    owned = set(links) | set(labels["node"].tolist())
    start = [(f * d, s, n, f, d) for n, s, f, d in zip(labels["node"].tolist(), labels["seed"].tolist(), labels["f"].tolist(), labels["dist"].tolist())]
    inside, outside = _spread(links, owned, start)
    out = pd.DataFrame(inside + outside, columns=["node", "seed", "f", "dist"]).astype({"node": "int64", "seed": "int64", "f": "float64", "dist": "float64"})
    out.insert(0, "block", key[0])
    # numbers of blocks use all 64 bits, which a float doesn't hold
    out["to_block"] = pd.array([pd.NA] * len(inside) + [block_of[r[0]] for r in outside], dtype="Int64")
    return out


def _undominated(labels: DataFrame, *keep: str) -> DataFrame:
    """Of the labels of a node, in order of f * dist and then seed, those with a smaller factor than all before."""
    w = Window.partitionBy("node").orderBy((F.col("f") * F.col("dist")), "seed", "f", "dist")
    before = F.min("f").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return labels.withColumn("_f", before).where(F.col("_f").isNull() | (F.col("f") < F.col("_f"))).drop("_f")


def seed_labels(edges: DataFrame, seeds: DataFrame, work: Workspace, block_nodes: int = BLOCK_NODES, blocks: DataFrame | None = None) -> DataFrame:
    """(node, seed, f, dist): of each node the seeds that can be the first to reach it or what lies behind it.

    ``edges`` are undirected (src, dst, w >= 0), ``seeds`` has node and f, a factor > 0 of its distances. Per
    node only seeds stay that no other beats in both factor and scaled distance: with equal factors a single
    one, so the table grows with the nodes, not with nodes times seeds. ``blocks`` (node, block) says which
    nodes stand together; by default a connected part, cut by hash where it has more than ``block_nodes``
    nodes. A task solves one block by Dijkstra and hands labels on to others, which are solved again until
    nothing new is handed on; blocks that nothing reaches rest.
    """
    work = work.child("labels")
    e = work.put("edges", undirected(edges))
    start = seeds.select(F.col("node").cast("long").alias("node"), F.col("f").cast("double").alias("f")).groupBy("node").agg(F.min("f").alias("f"))
    if blocks is None:
        part = work.put("parts", components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), work, start))
        large = part.groupBy("component").agg(F.ceil(F.count("*") / block_nodes).alias("cuts"))
        blocks = part.join(large, "component").select("node", F.when(F.col("cuts") == 1, F.col("component")).otherwise(F.xxhash64("component", F.pmod(F.xxhash64("node"), F.col("cuts")))).alias("block"))
    blocks = work.put("blocks", blocks.select(F.col("node").cast("long").alias("node"), F.col("block").cast("long").alias("block")))
    at = lambda end: blocks.withColumnsRenamed({"node": end, "block": end + "_block"})
    e = work.put("placed", e.join(at("src"), "src").join(at("dst"), "dst").withColumnRenamed("src_block", "block"))
    inbox = work.put("inbox", start.join(blocks, "node").select("node", F.col("node").alias("seed"), "f", F.lit(0.0).alias("dist"), "block"))
    done, active = None, inbox.select("block").distinct()
    for _ in range(MAX_ROUNDS):
        active = work.put("active", active)
        mine, held = e.join(active, "block", "left_semi"), inbox.join(active, "block", "left_semi")
        out = work.put("out", held.groupBy("block").cogroup(mine.groupBy("block")).applyInPandas(lambda k, l, m: _solve(k, m, l), "block bigint, " + _LABEL + ", to_block bigint"))
        own = out.where("to_block is null").drop("to_block")
        done = own if done is None else own.unionByName(done.join(active, "block", "left_anti"))
        done = work.put("done", done)
        handed = out.where("to_block is not null").select("node", "seed", "f", "dist", F.col("to_block").alias("block"))
        # a block is solved again only for labels that nothing it has would beat
        fresh = work.put("fresh", _undominated(handed.distinct().withColumn("new", F.lit(1)).unionByName(done.select("node", "seed", "f", "dist", "block").withColumn("new", F.lit(0)).join(handed.select("node").distinct(), "node", "left_semi"))).where("new = 1").drop("new"))
        fresh = fresh.join(done.select("node", "seed", "f", "dist"), ["node", "seed", "f", "dist"], "left_anti")
        if fresh.isEmpty():
            return done.select("node", "seed", "f", "dist")
        inbox = work.put("inbox", _undominated(inbox.unionByName(fresh.select(*inbox.columns)).distinct()))
        active = fresh.select("block").distinct()
    raise RuntimeError("no end of the rounds")


def shortest_paths(edges: DataFrame, seeds: DataFrame, work: Workspace) -> DataFrame:
    """(seed, node, dist): distances from each seed (node) to all nodes it reaches, itself included.

    ``edges`` are undirected (src, dst, w >= 0). The result has a row for every seed and node of a part, so it
    is for few seeds; which seed comes first is answered by ``seed_labels``. All seeds advance together, a
    round per link of the longest path, keeping the shortest distance of seed and node.
    """
    work = work.child("paths")
    e = work.put("path-edges", undirected(edges)).withColumnRenamed("src", "node")
    front = seeds.select(F.col("node").cast("long").alias("seed")).distinct().select("seed", F.col("seed").alias("node"), F.lit(0.0).alias("dist"))
    state = work.put("paths", front.withColumn("fresh", F.lit(True)))
    while not state.where("fresh").isEmpty():
        ahead = state.where("fresh").join(e, "node").select("seed", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.lit(True).alias("fresh"))
        both = state.withColumn("fresh", F.lit(False)).unionByName(ahead)
        state = work.put("paths", both.groupBy("seed", "node").agg(F.min("dist").alias("dist"), F.min_by("fresh", F.struct("dist", "fresh")).alias("fresh")))
    return state.drop("fresh")


def assign_to_seeds(distances: DataFrame, seeds: DataFrame, nodes: DataFrame, formula: str | None = None, scaled: bool = False, cap: float = UNREACHABLE) -> DataFrame:
    """(node, seed, dist): the seed with the smallest, possibly scaled, distance below ``cap``, the smaller
    on ties; 0 for nodes that no seed reaches.

    ``seeds`` has node and radius. With ``scaled`` distances are multiplied by the formula in x = radius, by
    default 1 / (2 x)^(1/8). The choice is made from all seeds, as scaled regions needn't be neighbours.
    """
    f = scale_column(formula, "radius") if scaled else F.lit(1.0)
    d = distances.join(seeds.select(F.col("node").alias("seed"), f.alias("_f")), "seed").withColumn("dist", F.col("dist") * F.col("_f")).where(F.col("dist") < cap)
    best = d.groupBy("node").agg(F.min(F.struct("dist", "seed")).alias("m"))
    return nodes.select("node").join(best, "node", "left").select("node", F.coalesce("m.seed", F.lit(0).cast("long")).alias("seed"), F.col("m.dist").alias("dist"))


def first_seeds(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, work: Workspace, formula: str | None = None, scaled: bool = False, cap: float = UNREACHABLE, **options) -> DataFrame:
    """(node, seed, dist) as ``assign_to_seeds`` of all shortest paths, from ``seed_labels`` alone."""
    f = scale_column(formula, "radius") if scaled else F.lit(1.0)
    labels = seed_labels(edges, seeds.select("node", f.alias("f")).where(F.col("f") > 0), work, **options)
    best = labels.withColumn("dist", F.col("f") * F.col("dist")).where(F.col("dist") < cap).groupBy("node").agg(F.min(F.struct("dist", "seed")).alias("m"))
    return nodes.select("node").join(best, "node", "left").select("node", F.coalesce("m.seed", F.lit(0).cast("long")).alias("seed"), F.col("m.dist").alias("dist"))


def seeds_in_graph(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds that some edge touches, seeds that none does), each (node)."""
    used = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return seeds.select("node").join(used, "node", "left_semi"), seeds.select("node").join(used, "node", "left_anti")
