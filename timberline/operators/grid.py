"""Rasters as long tables (row_, col_, value columns): aggregation, classes, shapes, zones, extraction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace
from .graph import components
from .spatial import cell, check_radius, nearest

#: Cell numbers are packed into one long for graph algorithms.
_BIAS = 1 << 30


def pixel_metrics(points: DataFrame, metrics: dict[str, Column], res: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(row_, col_, metrics...): aggregates per grid cell, all in one pass; rows count upwards with y."""
    check_radius(res)
    g = points.groupBy(cell(F.col("y"), res, origin[1]).cast("int").alias("row_"), cell(F.col("x"), res, origin[0]).cast("int").alias("col_"))
    return g.agg(*[c.alias(n) for n, c in metrics.items()])


def clean_raster(raster: DataFrame) -> DataFrame:
    """Each cell once: the greatest of its numbers, null if it has none; NaN counts as null."""
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    return raster.where(F.col("row_").isNotNull() & F.col("col_").isNotNull()).groupBy("row_", "col_").agg(F.max(v).alias("value"))


def classify(raster: DataFrame, classes: list[tuple[float, float, float | None]], right: bool = True, others_null: bool = False) -> DataFrame:
    """Values in an interval become its class: (low, high] if ``right``, else [low, high). Others stay, or
    become null."""
    v = F.col("value")
    new = F.when(F.lit(False), F.lit(None).cast("double"))
    for low, high, to in classes:
        inside = (v > low) & (v <= high) if right else (v >= low) & (v < high)
        new = new.when(inside, F.lit(to).cast("double"))
    return raster.withColumn("value", new if others_null else new.otherwise(v))


def pack(row: Column, col: Column) -> Column:
    return (row.cast("long") + _BIAS) * (1 << 31) + (col.cast("long") + _BIAS)


def rim_cells(cells: DataFrame) -> DataFrame:
    """The cells of (row_, col_, label) that lack a 4-neighbour of their label."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])).alias("o")
    around = cells.select("label", "row_", "col_").distinct().select("label", "row_", "col_", o)
    n = around.select("label", (F.col("row_") + F.col("o.i")).alias("row_"), (F.col("col_") + F.col("o.j")).alias("col_"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    rim = n.groupBy("label", "row_", "col_").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("own and n < 5")
    return rim.select("row_", "col_", "label")


def _links(cells: DataFrame, *by: str) -> DataFrame:
    """Pairs of 4-neighbours among the cells as (by..., row_, col_, row2, col2)."""
    step = F.explode(F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c")))).alias("s")
    a = cells.select(*by, F.col("row_").alias("row0"), F.col("col_").alias("col0"), step).select(*by, "row0", "col0", (F.col("row0") + F.col("s.r")).alias("row_"), (F.col("col0") + F.col("s.c")).alias("col_"))
    return a.join(cells.select(*by, "row_", "col_"), [*by, "row_", "col_"]).select(*by, "row0", "col0", F.col("row_").alias("row2"), F.col("col_").alias("col2"))


def connected_cells(cells: DataFrame, work: Workspace) -> DataFrame:
    """(row_, col_, label): 4-connected parts of the cells; the label is the packed number of the smallest cell."""
    c = cells.select("row_", "col_").distinct()
    e = _links(c).select(pack(F.col("row0"), F.col("col0")).alias("a"), pack(F.col("row2"), F.col("col2")).alias("b"))
    n = c.select("row_", "col_", pack(F.col("row_"), F.col("col_")).alias("node"))
    return n.join(components(e, work, n.select("node")), "node").select("row_", "col_", F.col("component").alias("label"))


def areas(labels: DataFrame, res: float) -> DataFrame:
    return labels.groupBy("label").agg((F.count("*") * (res * res)).alias("area"))


def fill_holes(labels: DataFrame, work: Workspace) -> DataFrame:
    """The labelled cells together with the cells they enclose, each label by itself."""
    work = work.child("holes")
    box = labels.groupBy("label").agg(F.min("row_").alias("r0"), F.max("row_").alias("r1"), F.min("col_").alias("c0"), F.max("col_").alias("c1"))
    around = box.withColumn("row_", F.explode(F.sequence(F.col("r0") - 1, F.col("r1") + 1))).withColumn("col_", F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)))
    edge = (F.col("row_") < F.col("r0")) | (F.col("row_") > F.col("r1")) | (F.col("col_") < F.col("c0")) | (F.col("col_") > F.col("c1"))
    outside = work.put("outside", around.withColumn("edge", edge).select("label", "row_", "col_", "edge").join(labels.select("label", "row_", "col_"), ["label", "row_", "col_"], "left_anti"))
    node = lambda r, c: F.concat_ws("/", F.col("label").cast("string"), F.col(r).cast("string"), F.col(c).cast("string"))
    e = _links(outside, "label").select(node("row0", "col0").alias("a"), node("row2", "col2").alias("b"))
    n = outside.select(node("row_", "col_").alias("node"), "label", "row_", "col_", "edge")
    part = n.join(components(e, work, n.select("node")), "node")
    holes = part.join(part.where("edge").select("component").distinct(), "component", "left_anti").select("row_", "col_", "label")
    return labels.select("row_", "col_", "label").unionByName(holes)


def disc_offsets(radius: float, closed: bool = True) -> list[tuple[int, int]]:
    """Whole offsets (i, j) with i² + j² <= radius², or < for an open disc."""
    n = int(math.floor(radius)) if radius > 0 else 0
    inside = (lambda d: d <= radius * radius + 1e-9) if closed else (lambda d: d < radius * radius - 1e-9)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if inside(i * i + j * j)]


def disc_runs(radius: float, closed: bool = True) -> list[tuple[int, int]]:
    """(i, w): the rows of a disc and how far each reaches to either side."""
    rows: dict[int, int] = {}
    for i, j in disc_offsets(radius, closed):
        rows[i] = max(rows.get(i, 0), j)
    return sorted(rows.items())


def dilate(cells: DataFrame, radius: float, closed: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., row_, col_): cells at most (closed) or less than (open) ``radius`` cells from the given ones.

    Only cells at the border of the set spread, as from an inner cell the way outwards passes a nearer one. A
    cell spreads as one run per row of its disc; runs of a row are joined before they become cells again, so
    the rows in between grow with the radius and not with its square.
    """
    c = cells.select(*by, "row_", "col_").distinct()
    reach = disc_runs(radius, closed)
    if not reach:
        return c.limit(0)
    four = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(j).alias("c")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])).alias("s")
    n = c.select(*by, "row_", "col_", four).select(*by, (F.col("row_") + F.col("s.r")).alias("row_"), (F.col("col_") + F.col("s.c")).alias("col_")).groupBy(*by, "row_", "col_").agg(F.count("*").alias("_n"))
    rim = c.join(n.where("_n = 4"), [*by, "row_", "col_"], "left_anti")
    runs = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(w).alias("w")) for i, w in reach])).alias("s")
    spread = rim.select(*by, "row_", "col_", runs).select(*by, (F.col("row_") + F.col("s.r")).cast("int").alias("row_"), (F.col("col_") - F.col("s.w")).alias("_lo"), (F.col("col_") + F.col("s.w")).alias("_hi"))
    spread = spread.groupBy(*by, "row_", "_lo").agg(F.max("_hi").alias("_hi"))
    w = Window.partitionBy(*by, "row_").orderBy("_lo")
    before = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spread = spread.withColumn("_new", F.coalesce((F.col("_lo") > before + 1).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    joined = spread.groupBy(*by, "row_", "_run").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    around = joined.select(*by, "row_", F.explode(F.sequence("_lo", "_hi")).alias("col_")).withColumn("col_", F.col("col_").cast("int"))
    return around.unionByName(c.select(*by, F.col("row_").cast("int").alias("row_"), F.col("col_").cast("int").alias("col_"))).distinct()


def close_cells(labels: DataFrame, out: float, back: float) -> DataFrame:
    """Labelled cells grown by ``out`` and shrunk by ``back`` cells, each label by itself; labels may overlap."""
    grown = dilate(labels, out, True, ("label",))
    four = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(j).alias("c")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])).alias("s")
    rim = grown.select("label", "row_", "col_", four).select("label", (F.col("row_") + F.col("s.r")).alias("row_"), (F.col("col_") + F.col("s.c")).alias("col_")).distinct().join(grown, ["label", "row_", "col_"], "left_anti")
    return grown.join(dilate(rim, back, True, ("label",)), ["label", "row_", "col_"], "left_anti")


def intersect_labels(a: DataFrame, b: DataFrame, res: float) -> DataFrame:
    """(label_a, label_b, area) of labels of two rasters on one grid that share cells."""
    both = a.select("row_", "col_", F.col("label").alias("label_a")).join(b.select("row_", "col_", F.col("label").alias("label_b")), ["row_", "col_"])
    return both.groupBy("label_a", "label_b").agg((F.count("*") * (res * res)).alias("area"))


def zonal(labels: DataFrame, raster: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(label, metrics...) over the cells of each label; labels without a cell in the raster have none."""
    return labels.select("label", "row_", "col_").join(raster, ["row_", "col_"]).groupBy("label").agg(*[c.alias(n) for n, c in metrics.items()])


def extract(points: DataFrame, raster: DataFrame, res: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(id, value): the raster's value in the cell of each point; null outside."""
    at = points.select("id", cell(F.col("y"), res, origin[1]).cast("int").alias("row_"), cell(F.col("x"), res, origin[0]).cast("int").alias("col_"))
    return at.join(raster.select("row_", "col_", "value"), ["row_", "col_"], "left").select("id", "value")


def crop_raster(raster: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return raster.where(F.col("row_").between(*rows) & F.col("col_").between(*cols))


def bounding_box(points: DataFrame, buffer: float = 0.0) -> DataFrame:
    """One row xmin, ymin, xmax, ymax, widened by the buffer; nulls for an empty table."""
    return points.agg((F.min("x") - buffer).alias("xmin"), (F.min("y") - buffer).alias("ymin"), (F.max("x") + buffer).alias("xmax"), (F.max("y") + buffer).alias("ymax"))


def focal_max(raster: DataFrame, radius: float) -> DataFrame:
    """(row_, col_, value): for each cell of the raster the greatest number within a disc of cells, nulls ignored."""
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(j).alias("c")) for i, j in disc_offsets(radius)])).alias("s")
    spread = raster.where("value is not null").select("row_", "col_", "value", offsets).select((F.col("row_") + F.col("s.r")).cast("int").alias("row_"), (F.col("col_") + F.col("s.c")).cast("int").alias("col_"), "value")
    best = spread.groupBy("row_", "col_").agg(F.max("value").alias("value"))
    return raster.select("row_", "col_").join(best, ["row_", "col_"], "left")


def distance_transform(raster: DataFrame, marked: DataFrame, work: Workspace) -> DataFrame:
    """(row_, col_, value): the distance, in cells, of each cell of the raster from the nearest marked one; 0
    for these. No rows if none is marked."""
    at = lambda d: d.select(pack(F.col("row_"), F.col("col_")).alias("id"), F.col("col_").cast("double").alias("x"), F.col("row_").cast("double").alias("y"))
    far = nearest(at(raster), at(marked), 2.0, work, 2)
    here = raster.select("row_", "col_", pack(F.col("row_"), F.col("col_")).alias("l_id"))
    return here.join(far, "l_id").select("row_", "col_", F.col("dist").alias("value"))


def add_rasters(rasters: DataFrame, by: list[str]) -> DataFrame:
    """Sum per cell over layers, null as 0."""
    return rasters.groupBy(*by, "row_", "col_").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))
