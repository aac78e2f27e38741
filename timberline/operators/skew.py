"""Per-key results when a few keys hold most rows: heavy hitters apart, the rest by ordinary shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import pick

#: Bound of the heavy list: it is broadcast, so it can never hold more than this many keys.
MAX_HEAVY = 1000
SKETCH_ITEMS = 10_000


def heavy_hitters(df: DataFrame, key: str, share: float = 0.005, max_keys: int = MAX_HEAVY) -> DataFrame:
    """Keys that hold at least ``share`` of all rows with a non-null key, as a table (key, rows_about).

    One pass over the key column with a mergeable frequent-items sketch of fixed size. At most 1/share keys
    can qualify, and at most ``max_keys`` come out. An empty table gives no key.
    """
    only = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"))
    if isinstance(only.schema["_key"].dataType, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError("the key must be a scalar column")
    top = only.agg(F.expr(f"approx_top_k(_key, {int(max_keys)}, {SKETCH_ITEMS})").alias("top"), F.count("*").alias("n"))
    return top.select("n", F.explode("top").alias("t")).where(F.col("t.count") >= F.greatest(F.lit(2.0), F.col("n") * share)).select(F.col("t.item").alias(key), F.col("t.count").alias("rows_about"))


def split_by_weight(df: DataFrame, key: str, share: float = 0.005, salts: int = 64, salt_by: list[Column] | None = None, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(heavy rows with a column _salt, light rows). Both by broadcast join with the bounded heavy list.

    Rows with a null key are light. ``salt_by`` are the columns that spread a heavy key; by default all.
    With ``chunk`` a key has as many salts as it needs for about that many rows each.
    """
    count = F.lit(salts) if chunk is None else F.ceil(F.col("rows_about") / chunk)
    heavy = F.broadcast(heavy_hitters(df, key, share).select(key, count.cast("int").alias("_salts")))
    spread = salt_by or [F.col(c) for c in df.columns]
    hot = df.join(heavy, key).withColumn("_salt", F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int")).select(*df.columns, "_salt")
    return hot, df.join(heavy, key, "left_anti")


def aggregate_per_key(df: DataFrame, key: str, partial: dict[str, Column], merge: dict[str, Column], final: dict[str, Column], share: float = 0.005, salts: int = 64) -> DataFrame:
    """Aggregates per non-null key. ``partial`` aggregates rows, ``merge`` merges partials of the same
    names, ``final`` turns merged columns into results. Heavy keys are aggregated per salt first."""
    rows = df.where(F.col(key).isNotNull())
    hot, rest = split_by_weight(rows, key, share, salts)
    part = [c.alias(n) for n, c in partial.items()]
    heavy = hot.groupBy(key, "_salt").agg(*part).groupBy(key).agg(*[c.alias(n) for n, c in merge.items()])
    light = rest.groupBy(key).agg(*part)
    return heavy.unionByName(light).select(key, *[c.alias(n) for n, c in final.items()])


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int = 1, share: float = 0.005, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each non-null key in the given order, which should end in a unique column.

    Heavy keys are ranked within (key, salt) and again over the at most k * salts survivors; the other keys
    are ranked after one ordinary shuffle. The rank limit also cuts rows before either shuffle.
    """
    if k < 1:
        raise ValueError("k must be a positive integer")
    rows = df.where(F.col(key).isNotNull())
    hot, rest = split_by_weight(rows, key, share, salts)

    def first(d: DataFrame, *by: str) -> DataFrame:
        return d.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")

    heavy = first(first(hot, key, "_salt").drop("_salt"), key)
    return heavy.unionByName(first(rest, key))


def highest_returns(las: DataFrame, points: Callable[..., DataFrame]) -> DataFrame:
    """(treeID, point_id): of each non-null treeID, 0 included, the usable point with the largest Z, the
    smallest point_id on ties. Repeated deliveries tie with themselves and change nothing; an empty table
    gives an empty result."""
    rows = points(las, treeID="treeID").select("treeID", "point_id", "z")
    return top_per_key(rows, "treeID", [F.col("z").desc(), F.col("point_id")]).select("treeID", "point_id")


def key_profile(las: DataFrame, points: Callable[..., DataFrame]) -> DataFrame:
    """Per non-null treeID over usable points, each point_id once: number of points, lowest, highest and mean Z.

    The mean is taken over whole millimetres, so it doesn't depend on the order of the rows."""
    rows = points(las, treeID="treeID").select("treeID", "point_id", "z").dropDuplicates(["point_id"])
    z = F.col("z")
    return aggregate_per_key(
        rows, "treeID",
        {"n": F.count("*"), "lo": F.min(z), "hi": F.max(z), "s": F.sum(F.round(z * 1000).cast("long"))},
        {"n": F.sum("n"), "lo": F.min("lo"), "hi": F.max("hi"), "s": F.sum("s")},
        {"n_points": F.col("n"), "z_min": F.col("lo"), "z_max": F.col("hi"), "z_mean": F.col("s") / F.col("n") / 1000},
    )


__all__ = ["aggregate_per_key", "heavy_hitters", "highest_returns", "key_profile", "pick", "split_by_weight", "top_per_key"]
