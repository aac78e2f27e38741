"""Oversized items cut into pieces at natural boundaries, without any worker seeing a whole item.

Positions of an item are grouped into ranges; each range finds its own boundaries and counts, with a halo
of the overlap's width from the range after it; a small table of range ends is stitched for boundaries that
lie between ranges and for prefix sums, and pieces are emitted by offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.points import usable_points
from ..runtime import Workspace, broadcast_if_small, pick

#: Positions are compared as whole multiples of this many metres.
UNIT = 1e-6
MAX_BROADCAST_ROWS = 200_000
#: Pieces are numbered in stretches of an item of so many halves of the limit.
STRETCH_PIECES = 1_000


def scan_positions(las: DataFrame, scans: DataFrame) -> DataFrame:
    """(item, pos, id): usable points of scans with an axis, placed along it; pos in units.

    Scans that are missing, repeated with another axis, or have an axis other than X or Y have no rows.
    """
    axis = pick(scans, item="scan_id", axis="axis").select("item", F.upper(F.trim("axis")).alias("axis")).where(F.col("item").isNotNull() & F.col("axis").isin("X", "Y"))
    axis = axis.groupBy("item").agg(F.min("axis").alias("axis"), F.max("axis").alias("_other")).where("axis = _other").drop("_other")
    points = usable_points(las, item="scan_id").where(F.col("item").isNotNull())
    along = F.when(F.col("axis") == "X", F.col("x")).otherwise(F.col("y"))
    return points.join(broadcast_if_small(axis, MAX_BROADCAST_ROWS), "item").select("item", F.round(along / UNIT).cast("long").alias("pos"), F.col("point_id").alias("id"))


def ranges_of(rows: DataFrame, limit: int, gap: float, range_length: float, work: Workspace | None = None) -> DataFrame:
    """One row per distinct position of each item with more than ``limit`` rows:
    (item, range, pos, n, id, before, before_id, offset, segment).

    ``id`` is the smallest at the position, ``before`` the position before it in the whole item, ``offset``
    the number of rows before it, ``segment`` the number of natural boundaries up to it. The positions are
    counted and stored once, so the rows are read once.
    """
    work = work or Workspace(rows.sparkSession, "split")
    step, wide = round(gap / UNIT), round(range_length / UNIT)
    places = work.put("places", rows.groupBy("item", F.floor(F.col("pos") / wide).alias("range"), "pos").agg(F.count("*").alias("n"), F.min("id").alias("id")))
    big = work.put("big", places.groupBy("item").agg(F.sum("n").alias("_n")).where(F.col("_n") > limit).select("item"))
    places = places.join(broadcast_if_small(big, MAX_BROADCAST_ROWS), "item", "left_semi")
    w = Window.partitionBy("item", "range").orderBy("pos")
    places = places.withColumn("_p", F.lag("pos").over(w)).withColumn("_i", F.lag("id").over(w)).withColumn("_sum", F.sum("n").over(w) - F.col("n"))
    places = places.withColumn("_cuts", F.sum((F.col("pos") - F.col("_p") >= step).cast("int")).over(w))
    # the boundary table: ends, sizes and inner boundaries of each range, stitched along the item
    ends = places.groupBy("item", "range").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max_by("id", "pos").alias("last_id"), F.sum("n").alias("size"), F.max(F.coalesce("_cuts", F.lit(0))).alias("cuts"))
    along = Window.partitionBy("item").orderBy("range")
    ends = ends.withColumn("p", F.lag("last").over(along)).withColumn("i", F.lag("last_id").over(along))
    ends = ends.withColumn("edge", F.coalesce((F.col("first") - F.col("p") >= step).cast("int"), F.lit(0)))
    ends = ends.withColumn("skip", F.sum("size").over(along) - F.col("size")).withColumn("seams", F.sum(F.col("cuts") + F.col("edge")).over(along) - F.col("cuts"))
    stitched = places.join(ends.select("item", "range", "p", "i", "skip", "seams"), ["item", "range"])
    return stitched.select(
        "item", "range", "pos", "n", "id", F.coalesce("_p", "p").alias("before"), F.coalesce("_i", "i").alias("before_id"),
        (F.col("skip") + F.col("_sum")).alias("offset"), (F.col("seams") + F.coalesce("_cuts", F.lit(0))).alias("segment"),
    )


def natural_boundaries(rows: DataFrame, limit: int = 400, gap: float = 1.0, range_length: float = 32.0) -> DataFrame:
    """(item, point_a, point_b): steps of at least ``gap`` between consecutive positions of oversized items,
    with the smallest id at either side, the smaller one first."""
    r = ranges_of(rows, limit, gap, range_length).where(F.col("pos") - F.col("before") >= round(gap / UNIT))
    return r.select("item", F.least("id", "before_id").alias("point_a"), F.greatest("id", "before_id").alias("point_b"))


def cut_pieces(rows: DataFrame, limit: int = 400, gap: float = 1.0, overlap: float = 0.5, range_length: float = 32.0) -> DataFrame:
    """(item, piece, first, n_core, n_points): pieces of oversized items, in order of (pos, id).

    A piece has the rows with offsets from ``first`` (0-based) on: ``n_core`` of its own, then those that
    also begin the next piece, ``n_points`` together, at most ``limit``. Cores cover the item without gap or
    repetition. Segments between natural boundaries of at most limit / 2 rows are packed together, larger
    ones up to the limit stand alone; across an empty stretch as wide as the overlap nothing is shared.
    Segments over the limit are cut by offset, and everything within ``overlap`` after a core belongs to its
    piece too. Only where more than 3/4 of the limit lie within one overlap the limit wins: the core is half
    the limit and the shared rows end at the limit.
    """
    if limit < 4 or not 0 <= overlap <= min(gap, range_length):
        raise ValueError("need limit >= 4 and 0 <= overlap <= gap, range_length")
    reach, wide, half = round(overlap / UNIT), round(range_length / UNIT), limit // 2
    work = Workspace(rows.sparkSession, "pieces")
    r = work.put("ranges", ranges_of(rows, limit, gap, range_length, work))
    # halo: the first positions of a range also stand at the end of the range before it
    halo = r.where(F.pmod("pos", F.lit(wide)) <= reach).withColumn("range", F.col("range") - 1).withColumn("core", F.lit(False))
    w = Window.partitionBy("item", "range", "segment").orderBy("pos")
    ahead = r.withColumn("core", F.lit(True)).unionByName(halo).withColumn("ahead", F.sum("n").over(w.rangeBetween(0, reach)) - F.col("n")).where("core")
    ahead = work.put("ahead", ahead)
    segments = ahead.groupBy("item", "segment").agg(F.min("offset").alias("start"), F.sum("n").alias("size"), F.max(F.col("ahead") + F.col("n") - 1).alias("most"))
    step = F.when(F.col("most") <= limit - limit // 4, limit - F.col("most")).otherwise(half)
    segments = work.put("segments", segments.withColumn("step", F.when(F.col("size") > limit, step)))
    small = segments.where(F.col("size") <= half).groupBy("item", F.floor(F.col("start") / half).alias("_bin")).agg(F.min("start").alias("first"), F.sum("size").alias("n_core")).drop("_bin")
    alone = segments.where((F.col("size") > half) & F.col("step").isNull()).select("item", F.col("start").alias("first"), F.col("size").alias("n_core"))
    cut = ahead.join(segments.where(F.col("step").isNotNull()).drop("most"), ["item", "segment"]).withColumn("rel", F.col("offset") - F.col("start"))
    # the cores that end at a row of this position: (k + 1) * step - 1 in [rel, rel + n), or the segment's end
    lo, hi = F.ceil((F.col("rel") + 1) / F.col("step")) - 1, F.floor((F.col("rel") + F.col("n")) / F.col("step")) - 1
    full = cut.withColumn("k", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    end = (F.col("k") + 1) * F.col("step")
    shared = F.least(limit - F.col("step"), F.col("rel") + F.col("n") - end + F.col("ahead"))
    full = full.select("item", (F.col("start") + F.col("k") * F.col("step")).alias("first"), F.col("step").alias("n_core"), shared.alias("n_shared"))
    rest = segments.where(F.col("step").isNotNull() & (F.col("size") % F.col("step") > 0)).select("item", (F.col("start") + F.col("size") - F.col("size") % F.col("step")).alias("first"), (F.col("size") % F.col("step")).alias("n_core"))
    zero = F.lit(0).cast("long").alias("n_shared")
    plain = small.select("item", "first", "n_core", zero).unionByName(alone.select("item", "first", "n_core", zero)).unionByName(rest.select("item", "first", "n_core", zero))
    # numbers by prefix sums over stretches of the item, as the offsets are
    pieces = work.put("cut", full.unionByName(plain).withColumn("_stretch", F.floor(F.col("first") / (STRETCH_PIECES * half))))
    before = pieces.groupBy("item", "_stretch").agg(F.count("*").alias("_n"))
    before = before.select("item", "_stretch", (F.sum("_n").over(Window.partitionBy("item").orderBy("_stretch")) - F.col("_n")).alias("_skip"))
    number = F.col("_skip") + F.row_number().over(Window.partitionBy("item", "_stretch").orderBy("first"))
    return pieces.join(before, ["item", "_stretch"]).select("item", number.cast("long").alias("piece"), "first", "n_core", (F.col("n_core") + F.col("n_shared")).alias("n_points"))


def piece_members(rows: DataFrame, pieces: DataFrame, limit: int = 400, gap: float = 1.0, range_length: float = 32.0) -> DataFrame:
    """(item, piece, id, shared): the rows of each piece; ``shared`` marks those that begin the next piece."""
    places = ranges_of(rows, limit, gap, range_length).select("item", "pos", "offset")
    at = rows.join(places, ["item", "pos"]).withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("item", "pos").orderBy("id")) - 1)
    at = at.select("item", "id", "rank", F.floor(F.col("rank") / limit).alias("_slot"))
    p = pieces.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("first") / limit), F.floor((F.col("first") + F.col("n_points") - 1) / limit))))
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n_points"))
    return at.join(p, ["item", "_slot"]).where(inside).select("item", "piece", "id", (F.col("rank") >= F.col("first") + F.col("n_core")).alias("shared"))
