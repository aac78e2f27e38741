"""Exact percentiles per group over very large columns by distributed multi-select.

The values of a group lie in sorted blocks of bounded size. In each round every block proposes the median of
its values that are still in question, the weighted median of the proposals is the pivot, all blocks count
below, equal and above, and the ruled-out range is discarded; all groups and percentiles advance together.
Block tables of separate days or scans are combined by union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.points import is_number, usable_points
from ..runtime import Workspace, broadcast_if_small

#: Values in a block, on average; also the number of candidates of a target that one row may gather at the end.
BLOCK_VALUES = 1024
#: Lists of large groups and of open targets are broadcast up to this many rows of some 100 bytes.
MAX_BROADCAST_ROWS = 100_000


def make_blocks(rows: DataFrame, by: list[str], value: str, spread: list[str], parts: list[str] | None = None, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(by..., vals): sorted blocks. Rows with a null group, or a null or NaN value, are left out.

    ``spread`` are the columns whose hash spreads a large group over blocks; ``parts`` keep separate parts,
    such as days, in separate blocks. Only groups that need more than one block are listed for the join.
    """
    r = rows.where(is_number(F.col(value)))
    for c in by:
        r = r.where(F.col(c).isNotNull())
    large = r.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > block_values).select(*by, F.ceil(F.col("_n") / block_values).cast("int").alias("_blocks"))
    r = r.join(broadcast_if_small(large, MAX_BROADCAST_ROWS), by, "left")
    r = r.withColumn("_block", F.when(F.col("_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_blocks")).cast("int")))
    return r.groupBy(*by, *(parts or []), "_block").agg(F.sort_array(F.collect_list(value)).alias("vals")).select(*by, "vals")


def _active() -> Column:
    return F.filter("vals", lambda v: (F.col("lo").isNull() | (v > F.col("lo"))) & (F.col("hi").isNull() | (v < F.col("hi"))))


def select_percentiles(blocks: DataFrame, by: list[str], percentiles: list[float], work: Workspace, block_values: int = BLOCK_VALUES, rank_error: float = 0.0) -> DataFrame:
    """(by..., n, p, value): percentiles with linear interpolation, for each group in ``blocks``.

    Exact for rank_error 0. Otherwise a target ends as soon as at most rank_error * n values are in
    question, and one of these is the result: its rank is off by at most that many. ``blocks`` must be a
    stored table, as each round reads it.
    """
    if not percentiles or not all(0 <= p <= 1 for p in percentiles):
        raise ValueError("percentiles must be numbers from 0 to 1")
    groups = blocks.groupBy(*by).agg(F.sum(F.size("vals")).alias("n"), F.count("*").alias("n_blocks"), F.max_by("vals", F.lit(0)).alias("vals")).withColumn("vals", F.when(F.col("n_blocks") == 1, F.col("vals")))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for p in percentiles])
    targets = groups.select(*by, "n", "n_blocks", "vals", F.explode(wanted).alias("w")).select(*by, "n", "n_blocks", "vals", F.col("w.p").alias("p"), F.col("w.at").alias("at"))
    v = lambda at: F.get("vals", at.cast("int"))
    below, above, part = v(F.floor("at")), v(F.ceil("at")), F.col("at") - F.floor("at")
    done = targets.where("n_blocks = 1").select(*by, "n", "p", F.when(part == 0, below).otherwise(below + (above - below) * part).alias("value"))
    large = work.put("large", targets.where("n_blocks > 1").select(*by, "n", "p", "at"))
    if large.isEmpty():
        return done
    ranks = large.select(*by, "n", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")).distinct()
    state = work.put("state", ranks.select(*by, "n", "rank", F.col("rank").alias("k"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.col("n").alias("left"), F.lit(None).cast("double").alias("value")))
    key = [*by, "rank"]
    limit = F.greatest(F.lit(block_values).cast("double"), F.col("n") * rank_error)
    while True:
        open_ = state.where(F.col("value").isNull() & (F.col("left") > limit))
        if open_.isEmpty():
            break
        small = broadcast_if_small(open_.select(*key, "k", "lo", "hi"), MAX_BROADCAST_ROWS)
        act = blocks.join(small, by).select(*key, _active().alias("act")).where(F.size("act") > 0)
        proposals = act.select(*key, F.element_at("act", ((F.size("act") + 1) / 2).cast("int")).alias("pivot"), F.size("act").cast("long").alias("weight"))
        w = Window.partitionBy(*key)
        ranked = proposals.withColumn("sum", F.sum("weight").over(w.orderBy("pivot"))).withColumn("all", F.sum("weight").over(w))
        pivots = work.put("pivots", ranked.where(F.col("sum") * 2 >= F.col("all")).groupBy(*key).agg(F.min("pivot").alias("pivot")))
        asked = broadcast_if_small(open_.select(*key, "lo", "hi").join(pivots, key), MAX_BROADCAST_ROWS)
        seen = blocks.join(asked, by).select(*key, "pivot", _active().alias("act"))
        seen = seen.select(*key, "pivot", F.size("act").alias("m"), F.size(F.filter("act", lambda x: x < F.col("pivot"))).alias("less"), F.size(F.filter("act", lambda x: x <= F.col("pivot"))).alias("upto"))
        counts = seen.groupBy(*key).agg(F.max("pivot").alias("pivot"), *[F.sum(c).alias(c) for c in ("m", "less", "upto")])
        s = state.join(counts, key, "left")
        left, right = F.col("k") < F.col("less"), F.col("k") >= F.col("upto")
        state = work.put("state", s.select(
            *by, "n", "rank",
            F.when(right, F.col("k") - F.col("upto")).otherwise(F.col("k")).alias("k"),
            F.when(right, F.col("pivot")).otherwise(F.col("lo")).alias("lo"),
            F.when(left, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(left, F.col("less")).when(right, F.col("m") - F.col("upto")).otherwise(F.col("left")).alias("left"),
            F.when(F.col("pivot").isNotNull() & ~left & ~right, F.col("pivot")).otherwise(F.col("value")).alias("value"),
        ))
    rest = state.where(F.col("value").isNull())
    if rank_error > 0:  # any value in question will do where too many to gather are left
        gathered = rest.where(F.col("left") <= block_values)
        loose = blocks.join(broadcast_if_small(rest.where(F.col("left") > block_values).select(*key, "lo", "hi"), MAX_BROADCAST_ROWS), by).select(*key, _active().alias("act")).where(F.size("act") > 0)
        found = loose.groupBy(*key).agg(F.min(F.element_at("act", 1)).alias("got"))
    else:
        gathered, found = rest, None
    last = blocks.join(broadcast_if_small(gathered.select(*key, "k", "lo", "hi"), MAX_BROADCAST_ROWS), by).select(*key, "k", _active().alias("act")).where(F.size("act") > 0)
    exact = last.groupBy(*key).agg(F.get(F.sort_array(F.flatten(F.collect_list("act"))), F.first("k").cast("int")).alias("got"))
    found = exact if found is None else exact.unionByName(found)
    values = work.put("values", state.join(found, key, "left").select(*key, F.coalesce("value", "got").alias("value")))
    both = large.join(values.withColumnsRenamed({"rank": "_r", "value": "_lo"}), by).where(F.col("_r") == F.floor("at"))
    both = both.join(values.withColumnsRenamed({"rank": "_q", "value": "_hi"}), by).where(F.col("_q") == F.ceil("at"))
    part = F.col("at") - F.floor("at")
    return done.unionByName(both.select(*by, "n", "p", F.when(part == 0, F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part).alias("value")))


def tree_measures(las: DataFrame) -> DataFrame:
    """(treeID, measure, v, point_id, day): Z and verticality of usable points with a treeID, long form."""
    p = usable_points(las, treeID="treeID", verticality="verticality", day="gps_time").where(F.col("treeID").isNotNull())
    pair = F.explode(F.array(F.struct(F.lit("Z").alias("measure"), F.col("z").alias("v")), F.struct(F.lit("verticality").alias("measure"), F.col("verticality").alias("v"))))
    return p.select("treeID", "point_id", F.to_date("day").alias("day"), pair.alias("m")).select("treeID", "m.measure", "m.v", "point_id", "day")


def tree_percentiles(las: DataFrame, percentiles: list[float], by_day: bool = False, block_values: int = BLOCK_VALUES, rank_error: float = 0.0) -> DataFrame:
    """(treeID, measure, n, p, value) of Z and verticality; with ``by_day`` assembled from blocks per day of gps_time."""
    work = Workspace(las.sparkSession, "percentiles")
    by = ["treeID", "measure"]
    blocks = work.put("blocks", make_blocks(tree_measures(las), by, "v", ["point_id"], ["day"] if by_day else None, block_values))
    return select_percentiles(blocks, by, percentiles, work, block_values, rank_error)


def combine_blocks(parts: list[DataFrame]) -> DataFrame:
    """The block table of all parts, such as stored tables of separate days or scans; blocks need no merging."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def percentiles_from_parts(las: DataFrame, percentiles: list[float], parts: int = 4, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(treeID, measure, n, p, value): block tables are made and stored for each of ``parts`` groups of scans
    by themselves, and the percentiles of all of them come from the stored tables alone."""
    work = Workspace(las.sparkSession, "parts")
    by = ["treeID", "measure"]
    # a point delivered again carries its scan, so no point is in two parts; null scans are a part of the first
    which = F.coalesce(F.pmod(F.xxhash64("scan_id"), F.lit(parts)), F.lit(0))
    stored = [work.put(f"blocks-{i}", make_blocks(tree_measures(las.where(which == i)), by, "v", ["point_id"], None, block_values)) for i in range(parts)]
    return select_percentiles(combine_blocks(stored), by, percentiles, work, block_values)


def striking_trees(las: DataFrame, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(treeID, measure): ``verticality`` with a median of at least 0.70, ``Z`` with a 95 % percentile at
    least 12 m above the median, each over at least 30 values. Null treeIDs, null and NaN values and
    unusable points don't count; an empty table gives an empty result."""
    p = tree_percentiles(las, [0.5, 0.95], block_values=block_values).where("n >= 30")
    both = p.groupBy("treeID", "measure").agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("mid"), F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("high"))
    # differences of millimetres, free of the noise of binary fractions
    return both.where(((F.col("measure") == "verticality") & (F.round("mid", 9) >= 0.70)) | ((F.col("measure") == "Z") & (F.round(F.col("high") - F.col("mid"), 9) >= 12))).select("treeID", "measure")
