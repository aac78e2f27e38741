"""Patch delineation on habitat rasters for every combination of suitability, gap and spur."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace
from .grid import add_rasters, clean_raster, dilate


def _each(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def patchmorph(raster: DataFrame, suits: list[float], gaps: list[float], spurs: list[float], work: Workspace, res: float = 1.0) -> DataFrame | None:
    """(suit, gap, spur, row_, col_, value): 1 for patch cells, null for the other cells of the raster.

    In set form, without distance rasters: with S the suitable cells, A has the cells with a cell within the
    spur that is at least spur / 2 from S; the patch has the cells with a cell within the gap that is at
    least gap / 2 from A. A depends on suit and spur only and is made once for all gaps. An empty list gives
    None. A suitability that no cell reaches, or that leaves no A, is an error, as there is no distance.
    """
    if not (suits and gaps and spurs):
        return None
    grid = work.put("grid", clean_raster(raster))
    cells = grid.select("row_", "col_")
    suitable = work.put("suitable", _each([grid.where(F.col("value") >= s).select(F.lit(float(s)).alias("suit"), "row_", "col_") for s in suits]))
    if suitable.select("suit").distinct().count() < len(set(map(float, suits))):
        raise ValueError("a suitability is reached by no cell")
    every = lambda keys: cells.join(F.broadcast(keys), F.lit(True))  # noqa: E731 - keys: one row per combination given

    def opened(start: DataFrame, by: tuple[str, ...], size: float) -> DataFrame:
        key = [*by]
        combos = start.select(*key).distinct()
        far = every(combos).join(dilate(start, size / 2 / res, False, by), [*key, "row_", "col_"], "left_anti")
        return dilate(far, size / res, True, by).join(cells, ["row_", "col_"], "left_semi")

    spur = work.put("spur", _each([opened(suitable, ("suit",), s).withColumn("spur", F.lit(float(s))) for s in spurs]))
    if spur.select("suit", "spur").distinct().count() < len(set(map(float, suits))) * len(set(map(float, spurs))):
        raise ValueError("a combination of suitability and spur leaves no cell")
    patch = work.put("patch", _each([opened(spur, ("suit", "spur"), g).withColumn("gap", F.lit(float(g))) for g in gaps]))
    combos = spur.select("suit", "spur").distinct().withColumn("gap", F.explode(F.array(*[F.lit(float(g)) for g in gaps])))
    whole = every(combos).join(patch.withColumn("value", F.lit(1.0)), ["suit", "gap", "spur", "row_", "col_"], "left")
    return whole.select("suit", "gap", "spur", "row_", "col_", "value")


def layer_name(suit: float, gap: float, spur: float) -> str:
    return f"suit_{suit:g}_gap_{gap:g}_spur_{spur:g}"


def select_layer(patches: DataFrame, name: str) -> DataFrame | None:
    """The layer of that name; None, with a message, if there is none."""
    n = F.format_string("suit_%s_gap_%s_spur_%s", *[F.regexp_replace(F.col(c).cast("string"), r"\.0$", "") for c in ("suit", "gap", "spur")])
    found = patches.where(n == name)
    if found.isEmpty():
        print(f"no raster is named {name}")
        return None
    return found


def sum_by_suitability(patches: DataFrame, suits: list[float]) -> DataFrame:
    """(suit, row_, col_, value): sum over gaps and spurs of each suitability in the list, null as 0."""
    return add_rasters(patches.where(F.col("suit").isin([float(s) for s in suits])), ["suit"])
