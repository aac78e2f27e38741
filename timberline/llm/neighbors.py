"""Most similar vectors for every vector by NN-descent, and greedy search in the neighbour graph.

The neighbours of a neighbour are likely neighbours. Vectors stand in blocks of bounded size along a Z-order
curve. A list of neighbours starts from vectors that lie next to each other in sorted orders, first of blocks
along a shifted curve, so that links cross the borders of the blocks. In each round a join brings every block
the lists that its vectors name and the lists that name its vectors; there all neighbours of neighbours are
compared until the block's own lists rest. It ends when hardly a list changes in a round.

The lists are the result. An exact check counts what lies in the ball up to the k-th neighbour of a list, and
replaces only entries that it refutes.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.points import usable_rows
from ..runtime import Workspace, broadcast_if_small

#: Length of the lists that NN-descent keeps; longer lists find more.
LIST_LENGTH = 8
#: Neighbours on either side in a sorted order that a list starts from.
START_REACH = 4
MAX_ROUNDS = 30
#: It ends when fewer list entries than this share changed in a round.
LEAST_CHANGE = 0.002
#: Vectors in a block, at most twice as many.
BLOCK = 8_192
#: Bits of a coordinate in a place on the curve; the shifted curve needs one more.
BITS = 20
#: Edges, in millimetres, of the cells whose representatives a search starts from.
ENTRY_CELLS = (500, 2_000, 8_000, 32_000, 256_000, 1 << 40)
#: Balls that reach into other blocks are broadcast up to so many rows of some 100 bytes.
MAX_BROADCAST_ROWS = 100_000

_LOG = logging.getLogger(__name__)
_VECTOR = ["x", "y", "z"]
_LINK = pa.struct([("id", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("block", pa.int64()), ("d2", pa.int64()), ("fresh", pa.bool_())])
_PLACED = "block bigint, id bigint, x bigint, y bigint, z bigint, code bigint"
_LISTS = _PLACED + ", nb array<struct<id:bigint,x:bigint,y:bigint,z:bigint,block:bigint,d2:bigint,fresh:boolean>>"
_FAR = np.iinfo(np.int64).max
# Shifts and masks that spread the bits of a number to every third place.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


# -- places on the curve ---------------------------------------------------------------------------------

def _interleave(x, y, z):
    """The place of a cell on the Z-order curve; columns or arrays of whole numbers from 0 on."""

    def spread(v):
        for by, mask in _SPREAD:
            if isinstance(v, Column):
                v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
            else:
                v = (v | (v << by)) & mask
        return v

    if isinstance(x, Column):
        return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))
    return spread(x) | (spread(y) << 1) | (spread(z) << 2)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a partition in tables of ``size`` rows, the last ones of at most as many and about equal."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= 2 * size:
            t = pa.Table.from_batches(held).combine_chunks()
            yield t.slice(0, size)
            held, n = t.slice(size).to_batches(), n - size
    if n:
        t, parts = pa.Table.from_batches(held).combine_chunks(), max(1, -(-n // size))
        for i in range(parts):
            yield t.slice(i * n // parts, (i + 1) * n // parts - i * n // parts)


def place_in_blocks(vectors: DataFrame, work: Workspace, block: int = BLOCK) -> tuple[DataFrame, tuple[int, ...], int]:
    """((block, id, x, y, z, code), smallest coordinates, shift): blocks are runs of the curve, so two blocks
    share at most the place where they meet. ``code`` is the place of (coordinate - smallest) >> shift."""
    ends = vectors.agg(*[F.min(c).alias("lo" + c) for c in _VECTOR], *[F.max(c).alias("hi" + c) for c in _VECTOR]).first()
    low = tuple(ends["lo" + c] or 0 for c in _VECTOR)
    span = max((ends["hi" + c] or 0) - v for c, v in zip(_VECTOR, low))
    shift = max(0, int(span).bit_length() - BITS)
    v = vectors.select("id", *_VECTOR, _interleave(*[F.shiftright(F.col(c) - F.lit(v), shift) for c, v in zip(_VECTOR, low)]).alias("code"))
    order = ["code", *_VECTOR, "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, t in enumerate(_chunks(batches, block)):
            yield from t.add_column(0, "block", pa.array(np.full(t.num_rows, first + n))).to_batches()

    placed = v.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _PLACED)
    return work.put("placed", placed), low, shift


# -- lists -----------------------------------------------------------------------------------------------

def _best(s: np.ndarray, d: np.ndarray, d2: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(s, d, d2, fresh, rank): the k nearest d of each s, each once, smaller d on ties; a link that is also
    there as an old one isn't fresh."""
    order = np.lexsort((fresh, d, d2, s))
    s, d, d2, fresh = s[order], d[order], d2[order], fresh[order]
    once = np.ones(len(s), bool)
    once[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d, d2, fresh = s[once], d[once], d2[once], fresh[once]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    rank = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
    keep = rank < k
    return s[keep], d[keep], d2[keep], fresh[keep], rank[keep]


def _start_links(xyz: np.ndarray, code: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), both ways, at most ``reach`` apart along the curve or along strips of either axis."""
    n = len(xyz)
    wide = np.maximum(1, (np.ptp(xyz, axis=0) + 1) * 2 // max(1, int(np.sqrt(n))))
    x, y, z = xyz.T
    a, b = [], []
    for order in (np.lexsort((z, y, x, code)), np.lexsort((z, y, x // wide[0])), np.lexsort((z, x, y // wide[1]))):
        for step in range(1, min(reach, n - 1) + 1):
            a += [order[:-step], order[step:]]
            b += [order[step:], order[:-step]]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _list_table(rows: dict[str, np.ndarray], at: np.ndarray, nodes: dict[str, np.ndarray], links: tuple[np.ndarray, ...]) -> pa.Table:
    """One row per number in ``at`` with its links (s, d, d2, fresh), sorted by s then distance."""
    s, d, d2, fresh = links
    ends = np.searchsorted(s, np.append(at, at[-1] + 1 if len(at) else 0))
    flat = [nodes[c][d] for c in ("id", "x", "y", "z", "block")] + [d2, fresh]
    nb = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(c) for c in flat], fields=list(_LINK)))
    names = [f.split()[0] for f in _PLACED.split(", ")]
    return pa.Table.from_arrays([*[pa.array(rows[c]) for c in names], nb], names=[*names, "nb"])


def _columns(t: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy() for c in names}


def _start(placed: DataFrame, low: tuple[int, ...], shift: int, k: int, reach: int, block: int) -> DataFrame:
    """First lists, from sorted orders inside blocks of a curve that is shifted by a third of its range."""
    third = (1 << BITS) // 3
    code = _interleave(*[F.shiftright(F.col(c) - F.lit(v), shift) + third for c, v in zip(_VECTOR, low)])
    order = ["other", *_VECTOR, "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, block):
            v = _columns(t, ("block", "id", *_VECTOR, "code", "other"))
            # numbers in order of id, as ties are ordered by id
            by_id = np.argsort(v["id"])
            v = {c: a[by_id] for c, a in v.items()}
            xyz = np.stack([v[c] for c in _VECTOR], 1)
            a, b = _start_links(xyz, v["other"], reach)
            s, d, d2, fresh, _ = _best(a, b, ((xyz[a] - xyz[b]) ** 2).sum(1), np.ones(len(a), bool), k)
            yield from _list_table(v, np.arange(len(xyz)), v, (s, d, d2, fresh)).to_batches()

    return placed.withColumn("other", code).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _LISTS)


def _improve(t: pa.Table, k: int, first: bool, reach: int) -> pa.Table:
    """The lists of one block's vectors after comparing all neighbours of neighbours at hand.

    ``t`` has the rows of the block and of others that its vectors name or are named by; column ``to`` is the
    block. Pairs of which neither link is fresh met before. Of a vector's links of both directions the 2 k
    nearest count.
    """
    t = t.combine_chunks()
    v = _columns(t, ("to", "block", "id", *_VECTOR, "code"))
    nb = t.column("nb").combine_chunks()
    nb = nb.chunk(0) if isinstance(nb, pa.ChunkedArray) else nb
    sizes, flat = np.diff(nb.offsets.to_numpy()), nb.flatten()
    link = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(_LINK)}
    mine = v["block"] == v["to"]
    ids, at, back = np.unique(np.concatenate([v["id"], link["id"]]), return_index=True, return_inverse=True)
    nodes = {"id": ids} | {c: np.concatenate([v[c], link[c]])[at] for c in ("x", "y", "z", "block")}
    xyz = np.stack([nodes[c] for c in _VECTOR], 1)
    n = len(v["id"])
    s, d, fresh, d2 = np.repeat(back[:n], sizes), back[n:], link["fresh"].astype(bool), link["d2"]
    own_rows = np.flatnonzero(mine)
    own_rows = own_rows[np.argsort(back[own_rows])]
    own = back[own_rows]
    of_own = np.repeat(mine, sizes)
    lists = (s[of_own], d[of_own], d2[of_own], fresh[of_own])
    halo = (s[~of_own], d[~of_own], d2[~of_own], fresh[~of_own])
    seen = np.zeros(0, np.int64) if first else np.unique(lists[0] * len(ids) + lists[1])
    if first:
        a, b = _start_links(xyz[own], v["code"][own_rows], reach)
        a, b = own[a], own[b]
        lists = tuple(np.concatenate(p) for p in zip(lists, (a, b, ((xyz[a] - xyz[b]) ** 2).sum(1), np.ones(len(a), bool))))
    lists = _best(*lists, k)[:4]
    while lists[3].any() or halo[3].any():
        s, d, d2, fresh = (np.concatenate(p) for p in zip(lists, halo))
        e = _best(np.concatenate([s, d]), np.concatenate([d, s]), np.concatenate([d2, d2]), np.concatenate([fresh, fresh]), 2 * k)
        near = np.full((len(ids), 2 * k), -1)
        young = np.zeros((len(ids), 2 * k), bool)
        near[e[0], e[4]], young[e[0], e[4]] = e[1], e[3]
        worst = np.full(len(ids), _FAR)
        full = np.bincount(lists[0], minlength=len(ids)) >= k
        np.maximum.at(last := np.zeros(len(ids), np.int64), lists[0], lists[2])
        worst[full] = last[full]
        any_young = young.any(1)
        busy = own[any_young[own] | (any_young[near[own]] & (near[own] >= 0)).any(1)]
        found = []
        for part in np.array_split(busy, max(1, len(busy) // 2048)):
            via = near[part]
            cand = near[via]
            ok = (cand >= 0) & (via >= 0)[:, :, None] & (young[part][:, :, None] | young[via]) & (cand != part[:, None, None])
            far = sum((xyz[cand, i] - xyz[part, i][:, None, None]) ** 2 for i in range(3))
            ok &= far <= worst[part][:, None, None]
            r, i, j = np.nonzero(ok)
            found.append((part[r], cand[r, i, j], far[r, i, j]))
        more = [np.concatenate([f[i] for f in found]) for i in range(3)]
        known = np.zeros(len(lists[0]), bool)
        lists = _best(np.concatenate([lists[0], more[0]]), np.concatenate([lists[1], more[1]]), np.concatenate([lists[2], more[2]]), np.concatenate([known, np.ones(len(more[0]), bool)]), k)[:4]
        halo = (*halo[:3], np.zeros(len(halo[0]), bool))
    s, d, d2, _ = lists
    fresh = ~np.isin(s * len(ids) + d, seen)
    rows = {c: a[own_rows] for c, a in v.items()}
    return _list_table(rows, own, nodes, (s, d, d2, fresh))


def _round(k: int, first: bool, reach: int) -> Callable[[pa.Table], pa.Table]:
    return lambda t: _improve(t, k, first, reach)


def neighbour_lists(vectors: DataFrame, work: Workspace, k: int = LIST_LENGTH, reach: int = START_REACH, max_rounds: int = MAX_ROUNDS, least_change: float = LEAST_CHANGE, block: int = BLOCK) -> tuple[DataFrame, tuple[int, ...], int]:
    """(lists, smallest coordinates, shift): one row (block, id, x, y, z, code, nb) per vector, ``nb`` its
    neighbours by distance and then id.

    ``vectors`` has id (unique), x, y, z as long. As at most k + 1 vectors should share a place, only a
    bounded number of others can have one vector among their nearest, and what a block gets from others is
    bounded by its border. Lists that still change after ``max_rounds`` are an error.
    """
    placed, low, shift = place_in_blocks(vectors, work, block)
    lists = work.put("lists", _start(placed, low, shift, k, reach, block))
    for turn in range(max_rounds):
        pushed = lists.select("id", "block", F.explode(F.array_distinct(F.transform("nb", lambda m: m["block"]))).alias("to")).where("to <> block").select("id", "to")
        pulled = lists.select(F.explode("nb").alias("m"), F.col("block").alias("to")).where("m.block <> to").select(F.col("m.id").alias("id"), "to")
        moved = pushed.unionByName(pulled).distinct().join(lists, "id")
        gathered = lists.withColumn("to", F.col("block")).unionByName(moved.select(*lists.columns, "to"))
        lists = work.put("lists", gathered.groupBy("to").applyInArrow(_round(k, turn == 0, reach), _LISTS))
        n = lists.agg(F.sum(F.size("nb")).alias("all"), F.sum(F.size(F.filter("nb", lambda m: m["fresh"]))).alias("new")).first()
        if (n["new"] or 0) <= least_change * (n["all"] or 0):
            return lists, low, shift
    raise RuntimeError(f"neighbour lists still change after {max_rounds} rounds")


def nn_descent(vectors: DataFrame, work: Workspace, k: int = LIST_LENGTH, **options) -> DataFrame:
    """The neighbour graph (src, s-coordinates, dst, d-coordinates, d2, fresh) of ``neighbour_lists``."""
    return _graph(neighbour_lists(vectors, work, k, **options)[0])


def _graph(lists: DataFrame) -> DataFrame:
    e = lists.select(F.col("id").alias("src"), *[F.col(c).alias("s" + c) for c in _VECTOR], F.explode("nb").alias("m"))
    return e.select("src", *["s" + c for c in _VECTOR], F.col("m.id").alias("dst"), *[F.col("m." + c).alias("d" + c) for c in _VECTOR], "m.d2", "m.fresh")


# -- exact check -----------------------------------------------------------------------------------------

_CHECKED = "block bigint, id bigint, x bigint, y bigint, z bigint, worst bigint, outside boolean, top array<struct<dst:bigint,d2:bigint,found:boolean>>"


def _recount(t: pa.Table, k: int, low: tuple[int, ...], shift: int) -> pa.Table:
    """Counts the vectors of a block inside the ball of each list, up to its k-th neighbour; an entry that a
    nearer vector refutes is replaced (``found`` false). ``outside``: the ball reaches beyond the block."""
    t = t.sort_by([("code", "ascending"), ("id", "ascending")]).combine_chunks()
    v = _columns(t, ("block", "id", *_VECTOR, "code"))
    nb = t.column("nb").combine_chunks()
    nb = nb.chunk(0) if isinstance(nb, pa.ChunkedArray) else nb
    sizes, flat = np.diff(nb.offsets.to_numpy()), nb.flatten()
    n = len(v["id"])
    src = np.repeat(np.arange(n), sizes)
    rank = np.arange(len(src)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    top = rank < k
    src, dst, d2 = src[top], flat.field(0).to_numpy()[top], flat.field(5).to_numpy()[top]
    last = np.zeros(n, np.int64)
    np.maximum.at(last, src, d2)
    known = np.bincount(src, minlength=n) >= k
    xyz = np.stack([v[c] for c in _VECTOR], 1)
    worst = np.where(known, last, _FAR)
    # cells of a power of two, at least as wide as the ball, so it touches at most two along each axis
    place = (xyz - np.array(low)) >> shift
    radius = np.where(known, (np.ceil(np.sqrt(last.astype(float))).astype(np.int64) >> shift) + 1, 0)
    level = np.where(known, np.ceil(np.log2(2.0 * radius + 2)).astype(np.int64), BITS + 1)
    level = np.minimum(level, BITS + 1)
    begin = np.maximum(place - radius[:, None], 0) >> level[:, None]
    end = np.minimum(place + radius[:, None], (1 << BITS) - 1) >> level[:, None]
    outside = ~known
    hits = []
    code, every = v["code"], np.arange(n)
    for corner in range(8):
        pick = [corner >> i & 1 for i in range(3)]
        use = np.ones(n, bool)
        for i in range(3):
            use &= (end[:, i] > begin[:, i]) if pick[i] else True
        b = every[use]
        cellno = np.stack([(end if pick[i] else begin)[b, i] for i in range(3)], 1)
        wide = 3 * level[b]
        whole = wide >= 63
        wide = np.where(whole, 0, wide)
        prefix = _interleave(*cellno.T)
        lo = np.where(whole, 0, prefix << wide)
        hi = np.where(whole, _FAR, (prefix + 1) << wide)
        outside[b] |= (lo <= code[0]) | (hi > code[-1])
        i0, i1 = np.searchsorted(code, lo), np.searchsorted(code, hi)
        for part in np.array_split(np.arange(len(b)), max(1, int((i1 - i0).sum()) // 2_000_000 + 1)):
            m = i1[part] - i0[part]
            a = np.repeat(b[part], m)
            c = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(i0[part], m)
            far = ((xyz[a] - xyz[c]) ** 2).sum(1)
            ok = (far <= worst[a]) & (a != c)
            hits.append((a[ok], v["id"][c[ok]], far[ok]))
    a = np.concatenate([src, *[h[0] for h in hits]])
    c = np.concatenate([dst, *[h[1] for h in hits]])
    far = np.concatenate([d2, *[h[2] for h in hits]])
    s, d, d2, new, _ = _best(a, c, far, np.arange(len(a)) >= len(src), k)
    ends = np.searchsorted(s, np.arange(n + 1)).astype(np.int32)
    np.maximum.at(last := np.zeros(n, np.int64), s, d2)
    enough = np.diff(ends) >= k
    entries = pa.StructArray.from_arrays([pa.array(d), pa.array(d2), pa.array(~new)], names=["dst", "d2", "found"])
    cols = [pa.array(v[x]) for x in ("block", "id", *_VECTOR)] + [pa.array(last, mask=~enough), pa.array(outside), pa.ListArray.from_arrays(pa.array(ends), entries)]
    return pa.Table.from_arrays(cols, names=[f.split()[0] for f in _CHECKED.split(", ")])


def check_lists(lists: DataFrame, low: tuple[int, ...], shift: int, k: int, work: Workspace) -> DataFrame:
    """(src, dst, d2, found): the exact k nearest; ``found`` tells the entries that were in the lists.

    Whatever is nearer than the k-th entry lies in the ball around src up to it. Balls inside the run of the
    curve that their block holds are decided there; of the others the vectors of other blocks are looked up
    in cells of a power of two, at least as wide as the ball, so a ball meets at most eight.
    """
    checked = work.put("checked", lists.groupBy("block").applyInArrow(lambda t: _recount(t, k, low, shift), _CHECKED))
    entry = F.explode("top").alias("e")
    inside = checked.where("not outside").select(F.col("id").alias("src"), entry).select("src", "e.*")
    open_ = checked.where("outside")
    span = lists.agg(*[(F.max(c) - F.min(c) + 1).alias(c) for c in _VECTOR]).first()
    most = sum(span[c] or 0 for c in _VECTOR) ** 2
    ball = open_.select("block", "id", *[F.col(c).alias("s" + c) for c in _VECTOR], F.coalesce("worst", F.lit(min(most, 2**62))).alias("worst"))
    ball = ball.withColumn("r", F.ceil(F.sqrt("worst")).cast("long")).withColumn("level", F.ceil(F.log2(2 * F.col("r") + 1)).cast("int"))
    for c in _VECTOR:
        ball = ball.withColumn("c" + c, F.explode(F.expr(f"array_distinct(array(shiftright(s{c} - r, level), shiftright(s{c} + r, level)))")))
    probes = work.put("probes", ball.drop("r"))
    levels = [r[0] for r in probes.select("level").distinct().collect()]  # at most 63 numbers
    held = open_.select(F.col("id").alias("src"), entry).select("src", "e.*")
    if levels:
        placed = lists.select(F.col("block").alias("_b"), F.col("id").alias("dst"), *[F.col(c).alias("d" + c) for c in _VECTOR], F.explode(F.array(*map(F.lit, levels))).alias("level"))
        placed = placed.select("*", *[F.expr(f"shiftright(d{c}, level)").alias("c" + c) for c in _VECTOR])
        a, b, c = (F.col("s" + v) - F.col("d" + v) for v in _VECTOR)
        met = placed.join(broadcast_if_small(probes, MAX_BROADCAST_ROWS), ["level", "cx", "cy", "cz"]).where("block <> _b").withColumn("d2", a * a + b * b + c * c).where("d2 <= worst")
        held = held.unionByName(met.select(F.col("id").alias("src"), "dst", "d2", F.lit(False).alias("found")))
        held = held.groupBy("src", "dst", "d2").agg(F.max("found").alias("found"))
        held = held.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))).where(F.col("_r") <= k).drop("_r")
    return inside.unionByName(held)


# -- searches --------------------------------------------------------------------------------------------

def slice_vectors(las: DataFrame, low: float = 1.1, high: float = 1.6) -> DataFrame:
    """(id, x, y, z) of the usable points with low <= Z <= high, in whole millimetres. Repeated deliveries
    have one position, so the slice is cut before they are dropped."""
    p = usable_rows(las).where(F.round("z", 6).between(low, high)).dropDuplicates(["point_id"])
    return p.select(F.col("point_id").alias("id"), *[F.round(F.col(c) * 1000).cast("long").alias(c) for c in _VECTOR])


def thin_places(vectors: DataFrame, k: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(vectors with at most k + 1 at a place, pairs (src, dst) of the others).

    Of equal vectors only the k + 1 with the smallest ids can be anyone's neighbour. The others have the
    first k of them as neighbours, so a place with very many equal vectors costs one join with its head.
    """
    v = work.put("vectors", vectors.select("id", *_VECTOR).distinct())
    kept = work.put("kept", v.withColumn("_r", F.row_number().over(Window.partitionBy(*_VECTOR).orderBy("id"))).where(F.col("_r") <= k + 1))
    crowded = kept.groupBy(*_VECTOR).agg(F.count("*").alias("n"), F.max("id").alias("last"), F.collect_list(F.when(F.col("_r") <= k, F.col("id"))).alias("heads")).where(F.col("n") == k + 1)
    crowded = work.put("crowded", crowded.drop("n"))
    rest = v.join(broadcast_if_small(crowded, MAX_BROADCAST_ROWS), _VECTOR).where("id > last").select(F.col("id").alias("src"), F.explode("heads").alias("dst"))
    return kept.drop("_r"), rest


def nearest_pairs(vectors: DataFrame, k: int = 3, work: Workspace | None = None, exact: bool = True, **options) -> DataFrame:
    """(point_a, point_b), the smaller id first: pairs of which at least one is among the k nearest of the
    other, by distance and then id. ``exact`` checks the lists of NN-descent; the share of their entries
    that the check leaves, their recall, is logged.

    A place with many equal vectors costs nothing. Fewer than k + 1 vectors give what there is; an empty
    table gives an empty result; repeated rows count once.
    """
    work = work or Workspace(vectors.sparkSession, "neighbors")
    kept, rest = thin_places(vectors, k, work)
    lists, low, shift = neighbour_lists(kept, work, max(k, options.pop("list_length", LIST_LENGTH)), **options)
    if exact:
        top = work.put("top", check_lists(lists, low, shift, k, work))
        share = top.agg(F.avg(F.col("found").cast("double"))).first()[0]
        _LOG.info("recall of the neighbour lists before repair: %s", share)
    else:
        top = lists.select(F.col("id").alias("src"), F.explode(F.slice("nb", 1, k)).alias("e")).select("src", F.col("e.id").alias("dst"))
    both = top.select("src", "dst").unionByName(rest)
    return both.select(F.least("src", "dst").alias("point_a"), F.greatest("src", "dst").alias("point_b")).distinct()


def search_graph(graph: DataFrame, queries: DataFrame, work: Workspace, k: int = 3, beam: int = 16, max_rounds: int = 500) -> DataFrame:
    """(query, rank, dst, d2): the k nearest vectors of each query by greedy search in the graph.

    ``queries`` has query, qx, qy, qz as long; a vector with the query's own id isn't returned. A search
    starts at representatives of the cells around the query, from fine to coarse ones, so that the graph
    needs no long links; it opens the unopened vectors of its beam together with their neighbours in either
    direction and ends when the whole beam is open; searches that are open after ``max_rounds`` are an error.
    """
    nodes = work.put("nodes", graph.select(F.col("src").alias("dst"), *[F.col("s" + c).alias("d" + c) for c in _VECTOR]).distinct())
    backward = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[F.col("s" + c).alias("d" + c) for c in _VECTOR], "d2")
    backward = backward.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))).where(F.col("_r") <= LIST_LENGTH)
    links = work.put("links", graph.select("src", "dst", "dx", "dy", "dz").unionByName(backward.select("src", "dst", "dx", "dy", "dz")).distinct())
    e, f, g = (F.col("d" + c) - F.col("q" + c) for c in _VECTOR)
    far = e * e + f * f + g * g
    q = ["query", "qx", "qy", "qz"]

    def best(d: DataFrame, n: int) -> DataFrame:
        once = d.groupBy(*q, "dst", "d2").agg(F.max("open").alias("open"))
        return once.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("d2", "dst"))).where(F.col("_r") <= n).drop("_r")

    state = None
    for edge in ENTRY_CELLS:
        cell = [F.floor(F.col("d" + c) / edge).alias("c" + c) for c in _VECTOR]
        some = nodes.select("dst", "dx", "dy", "dz", *cell).groupBy("cx", "cy", "cz").agg(F.min(F.struct("dst", "dx", "dy", "dz")).alias("a"), F.max(F.struct("dst", "dx", "dy", "dz")).alias("b"))
        some = some.select("cx", "cy", "cz", F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select("cx", "cy", "cz", "e.*")
        around = queries.select(*q)
        for c in _VECTOR:
            at = F.floor(F.col("q" + c) / edge)
            around = around.withColumn("c" + c, F.explode(F.array(at - 1, at, at + 1)))
        met = around.join(some, ["cx", "cy", "cz"]).withColumn("d2", far).select(*q, "dst", "d2", F.lit(False).alias("open"))
        state = met if state is None else state.unionByName(met)
    state = work.put("beam", best(state, beam))
    for _ in range(max_rounds):
        todo = state.where(~F.col("open"))
        if todo.isEmpty():
            break
        seen = todo.select(*q, F.col("dst").alias("src")).join(links, "src").withColumn("d2", far).select(*q, "dst", "d2", F.lit(False).alias("open"))
        state = work.put("beam", best(state.withColumn("open", F.lit(True)).unionByName(seen), beam))
    else:
        raise RuntimeError(f"searches are still open after {max_rounds} rounds")
    others = state.where(F.col("dst") != F.col("query")).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d2", "dst")))
    return others.where(F.col("rank") <= k).select("query", "rank", "dst", "d2")


def search_slice(las: DataFrame, every: int = 50, k: int = 3) -> DataFrame:
    """(query, rank, dst, d2): for each vector of the slice whose id is divisible by ``every``, its k nearest others."""
    work = Workspace(las.sparkSession, "search")
    v = work.put("slice", slice_vectors(las))
    queries = v.where(F.col("id") % every == 0).select(F.col("id").alias("query"), *[F.col(c).alias("q" + c) for c in _VECTOR])
    return search_graph(work.put("graph", nn_descent(thin_places(v, k, work)[0], work)), queries, work, k)


__all__ = ["check_lists", "nearest_pairs", "neighbour_lists", "nn_descent", "search_graph", "search_slice", "slice_vectors", "thin_places"]
