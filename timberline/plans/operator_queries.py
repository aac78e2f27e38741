"""More queries with SQL written from the definitions: metrics, shapes, samples, trees, rasters, segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.palette import PALETTE, rgb
from ..operators import eigen, fits, graph, grid, hough, patches, sampling, trees
from ..runtime import Workspace, table
from ..sources.tables import las_to_xyz as to_xyz
from . import reference_queries as base
from .reference_queries import _CELLS, _CLOUD, _HABITAT, _PACK, _SEEDS, _STEMS, LARGE, LONGEST, _pairs, _r, cloud, habitat, seeds, stems

#: Directions of eigenvectors are compared where the eigenvalues on either side differ by this share of the
#: largest; entropies where no eigenvalue is as small as this.
GAP, SOLID = 1e-4, 1e-9
_PLAIN = "eLargest eMedium eSmallest eSum Curvature Omnivariance Anisotropy Linearity Planarity Sphericity SurfaceVariation ChangeCurvature SurfaceDensity VolumeDensity NormalChangeRate PCA1 PCA2".split()
_NORMAL = "Verticality Nx Ny Nz Roughness".split()


# -- metrics ---------------------------------------------------------------------------------------------

def eigen_metrics(spark, sf_dir):
    """All metrics but the curvatures; those of directions are null where the direction isn't defined."""
    m = eigen.eigen_metrics(cloud(spark, sf_dir), LARGE, curvature=False)
    l1, l2, l3 = F.col("eLargest"), F.col("eMedium"), F.col("eSmallest")
    up, across = l2 - l3 > GAP * l1, l1 - l2 > GAP * l1
    few = F.col("NumNeighbors") < 3
    cols = [F.when(few | (l1 > 1e-12), F.round(c, 6)).alias(c) for c in _PLAIN] + [F.when(few | up, F.round(c, 6)).alias(c) for c in _NORMAL]
    return m.select("id", *cols, F.when(few | (l3 > SOLID), F.round("Eigentropy", 6)).alias("Eigentropy"), F.when(few | (up & across), F.round("MomentOrder1", 4)).alias("MomentOrder1"), "NumNeighbors")


def _jacobi(sweeps: int = 6) -> str:
    """Steps j1, j2, ... that turn the symmetric matrix of each row of j0 (a00, a01, ..., a22) diagonal and the
    columns of v00..v22 into its eigenvectors, one plane rotation a step."""
    out, n = [], 0
    name = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    for _ in range(sweeps):
        for p, q in ((0, 1), (0, 2), (1, 2)):
            r = 3 - p - q
            pp, qq, pq, pr, qr = name(p, p), name(q, q), name(p, q), name(p, r), name(q, r)
            new = {pp: f"{pp} - t * {pq}", qq: f"{qq} + t * {pq}", pq: "0::DOUBLE", pr: f"c * {pr} - s * {qr}", qr: f"s * {pr} + c * {qr}", name(r, r): name(r, r)}
            vec = {f"v{i}{p}": f"c * v{i}{p} - s * v{i}{q}" for i in range(3)} | {f"v{i}{q}": f"s * v{i}{p} + c * v{i}{q}" for i in range(3)} | {f"v{i}{r}": f"v{i}{r}" for i in range(3)}
            cols = ", ".join(f"{e} AS {k}" for k, e in (new | vec).items())
            angle = f"CASE WHEN {pq} = 0 THEN 0::DOUBLE ELSE (CASE WHEN {qq} >= {pp} THEN 1::DOUBLE ELSE -1::DOUBLE END) / (abs(({qq} - {pp}) / (2 * {pq})) + sqrt(pow(({qq} - {pp}) / (2 * {pq}), 2) + 1)) * sign({pq}) END"
            out.append(f"j{n + 1} AS (SELECT id, n, mx, my, mz, {cols} FROM (SELECT *, t / sqrt(t * t + 1) AS s, 1 / sqrt(t * t + 1) AS c FROM (SELECT *, {angle} AS t FROM j{n})))")
            n += 1
    return ",\n".join(out) + f",\nlast AS (SELECT * FROM j{n})"


def _eigen_sql() -> str:
    cov = ", ".join(f"avg(d{a} * d{b}) - avg(d{a}) * avg(d{b}) AS a{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j)
    unit = ", ".join(f"{float(i == j)}::DOUBLE AS v{i}{j}" for i in range(3) for j in range(3))
    value = {
        "eLargest": "l1", "eMedium": "l2", "eSmallest": "l3", "eSum": "l1 + l2 + l3", "Curvature": "l3 / (l1 + l2 + l3)", "Omnivariance": "cbrt(l1 * l2 * l3)", "Anisotropy": "(l1 - l3) / l1",
        "Linearity": "(l1 - l2) / l1", "Planarity": "(l2 - l3) / l1", "Sphericity": "l3 / l1", "SurfaceVariation": "l3 / (l1 + l2 + l3)", "ChangeCurvature": "l3 / (l1 + l2 + l3)",
        "SurfaceDensity": f"n / (pi() * {LARGE * LARGE!r}::DOUBLE)", "VolumeDensity": f"n / (4.0::DOUBLE / 3 * pi() * {LARGE**3!r}::DOUBLE)", "NormalChangeRate": "l3 / (l1 + l2 + l3)",
        "PCA1": "l1 / (l1 + l2 + l3)", "PCA2": "l2 / (l1 + l2 + l3)",
        "Verticality": "1 - abs(nz)", "Nx": "nx", "Ny": "ny", "Nz": "nz", "Roughness": "abs(mx * nx + my * ny + mz * nz)",
    }
    ok = {c: "l1 > 1e-12" for c in _PLAIN} | {c: f"l2 - l3 > {GAP} * l1" for c in _NORMAL}
    cols = [f"CASE WHEN n < 3 THEN 0 WHEN {ok[c]} THEN round({e}, 6) END AS \"{c}\"" for c, e in value.items()]
    cols.append(f"CASE WHEN n < 3 THEN 0 WHEN l3 > {SOLID} THEN round(-(l1 * ln(l1) + l2 * ln(l2) + l3 * ln(l3)), 6) END AS \"Eigentropy\"")
    cols.append(f"CASE WHEN n < 3 THEN 0 WHEN l2 - l3 > {GAP} * l1 AND l1 - l2 > {GAP} * l1 THEN CASE WHEN n * (l2 + s * s) < 1e-10 THEN 0 ELSE round(n * s * s / (l2 + s * s), 4) END END AS \"MomentOrder1\"")
    return f"""WITH {_CLOUD},
{_pairs('u', 'u', LARGE)},
j0 AS (SELECT l_id AS id, count(*)::DOUBLE AS n, avg(dx) AS mx, avg(dy) AS my, avg(dz) AS mz, {cov}, {unit} FROM pairs GROUP BY l_id),
{_jacobi()},
e AS (SELECT id, n, mx, my, mz, list_reverse_sort([{{'l': a00, 'x': v00, 'y': v10, 'z': v20}}, {{'l': a11, 'x': v01, 'y': v11, 'z': v21}}, {{'l': a22, 'x': v02, 'y': v12, 'z': v22}}]) AS e FROM last),
f AS (SELECT id, n, mx, my, mz, greatest(e[1].l, 0) AS l1, greatest(e[2].l, 0) AS l2, greatest(e[3].l, 0) AS l3, mx * e[2].x + my * e[2].y + mz * e[2].z AS s, e[3] AS v,
  CASE WHEN (CASE WHEN abs(e[3].z) > 1e-12 THEN e[3].z WHEN abs(e[3].y) > 1e-12 THEN e[3].y ELSE e[3].x END) < 0 THEN -1 ELSE 1 END AS up FROM e),
g AS (SELECT *, up * v.x AS nx, up * v.y AS ny, up * v.z AS nz FROM f)
SELECT id, {', '.join(cols)}, n AS "NumNeighbors" FROM g"""


# -- samples ---------------------------------------------------------------------------------------------

def _hash(seed: int, *columns: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(columns)}, '{seed}')), 1, 13))::BIGINT"


def upright(spark, sf_dir):
    """Points whose stored verticality, 0.5 where it is missing, reaches the bound for stems."""
    return cloud(spark, sf_dir).where(sampling.clean_number(F.col("verticality"), 0.5) >= 0.6666).select("id", "z")


def crop_square(spark, sf_dir):
    return sampling.crop(cloud(spark, sf_dir), 100.0, 100.0, 80.001, circle=False).select("id")


def crop_outside(spark, sf_dir):
    return sampling.crop(cloud(spark, sf_dir), 100.0, 100.0, 60.0005, negate=True).select("id")


def las_to_xyz(spark, sf_dir):
    return to_xyz(table(spark, sf_dir, "las"))


def palette_colours(spark, sf_dir):
    return spark.createDataFrame([(n, *rgb(c)) for n, c in PALETTE.items()], "name string, R int, G int, B int")


# -- rasters ---------------------------------------------------------------------------------------------

def raster_classes(spark, sf_dir):
    """Classes closed on the right: 5 belongs to the first, 10 and 20 to the second, 0 stays."""
    return grid.classify(habitat(spark, sf_dir), [(0.0, 5.0, 1.0), (5.0, 20.0, 2.0)])


def raster_window(spark, sf_dir):
    return grid.crop_raster(habitat(spark, sf_dir), (3, 11), (20, 60))


def distance_transform(spark, sf_dir):
    """Distance of every cell, in cells, from the nearest suitable one."""
    h = habitat(spark, sf_dir)
    return grid.distance_transform(h, h.where("value >= 10"), Workspace(spark, "distance")).select("row_", "col_", _r("value"))


def patch_layer(spark, sf_dir):
    return patches.select_layer(base.patchmorph(spark, sf_dir), patches.layer_name(10, 2, 4)).select("row_", "col_", "value")


def label_overlap(spark, sf_dir):
    """Shapes of two thresholds that share cells, with the shared area."""
    work = Workspace(spark, "overlap")
    h = work.put("habitat", habitat(spark, sf_dir))
    a, b = (work.put(n, grid.connected_cells(h.where(c), work)) for n, c in (("a", "value >= 5"), ("b", "value >= 10")))
    return grid.intersect_labels(a, b, 0.5)


_NEXT = "(a.row_ = b.row_ AND abs(a.col_ - b.col_) = 1) OR (a.col_ = b.col_ AND abs(a.row_ - b.row_) = 1)"


def _parts(name: str, where: str) -> str:
    """The 4-connected parts of the cells as CTEs ending in ``name`` (row_, col_, label)."""
    return f"""c{name} AS (SELECT row_, col_, {_PACK} AS node FROM h WHERE {where}),
l{name} AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM c{name} a JOIN c{name} b ON {_NEXT}),
r{name}(n, m) AS (SELECT node, node FROM c{name} UNION SELECT r.n, l.b FROM r{name} r JOIN l{name} l ON r.m = l.a),
{name} AS MATERIALIZED (SELECT c.row_, c.col_, q.label FROM c{name} c JOIN (SELECT m, min(n) AS label FROM r{name} GROUP BY m) q ON c.node = q.m)"""


def _near(a: str, size: float, out: str, closed: bool = True) -> str:
    """Offsets within a disc, from the squared distance between cells."""
    n = int(size)
    return f"(SELECT i, j FROM range(-{n}, {n + 1}) x(i), range(-{n}, {n + 1}) y(j) WHERE i * i + j * j {'<=' if closed else '<'} {size * size})"


def _patch_sql() -> str:
    """The definition: distance from what is suitable, its maximum in a disc, a threshold; then the same for gaps."""
    parts, out = [], []

    def stage(name: str, start: str, size: float) -> str:
        return f"""d{name} AS MATERIALIZED (SELECT h.row_, h.col_, min((h.row_ - s.row_) * (h.row_ - s.row_) + (h.col_ - s.col_) * (h.col_ - s.col_)) AS d2 FROM h, {start} s GROUP BY h.row_, h.col_),
{name} AS MATERIALIZED (SELECT a.row_, a.col_ FROM d{name} a, {_near('', size, '')} o JOIN d{name} b ON b.row_ = a.row_ + o.i AND b.col_ = a.col_ + o.j GROUP BY a.row_, a.col_ HAVING sqrt(max(b.d2)) >= {size / 2})"""

    for s in (5, 10):
        parts.append(f"s{s} AS (SELECT row_, col_ FROM h WHERE value >= {s})")
        for p in (2, 4):
            parts.append(stage(f"a{s}_{p}", f"s{s}", p))
            for g in (2, 3):
                parts.append(stage(f"b{s}_{p}_{g}", f"a{s}_{p}", g))
                out.append(f"SELECT {s}::DOUBLE AS suit, {g}::DOUBLE AS gap, {p}::DOUBLE AS spur, h.row_, h.col_, CASE WHEN b.row_ IS NOT NULL THEN 1::DOUBLE END AS value FROM h LEFT JOIN b{s}_{p}_{g} b USING (row_, col_)")
    return f"WITH {_HABITAT},\n" + ",\n".join(parts) + "\n, patches AS (" + "\nUNION ALL ".join(out) + ")\n"


# -- trees -----------------------------------------------------------------------------------------------

def tree_table(spark, sf_dir):
    """Attributes per entry of the tree table, without the volumes."""
    t = trees.tree_attributes(seeds(spark, sf_dir), cloud(spark, sf_dir))
    return t.select("tree_id", "x", "y", "radius", "diameter", "height", _r("crown_area", 7), _r("crown_base_height"))


def nudged_seeds(spark, sf_dir):
    return trees.nudge_seeds(seeds(spark, sf_dir), 0.15).select("tree_id", "x", _r("y"))


def segment_snapped(spark, sf_dir):
    """Every point with the tree of the nearest thinned point, by unscaled distances."""
    s = trees.segment_points(cloud(spark, sf_dir), seeds(spark, sf_dir), Workspace(spark, "segment"), longest=LONGEST, dense=True)
    return s.select("id", "x", "y", "z", "tree_id", _r("nnd"))


def seeds_in_graph(spark, sf_dir):
    """Which trees' lowest points are vertices of the graph of stem neighbours, and which stand alone."""
    work = Workspace(spark, "vertices")
    s = work.put("stems", stems(spark, sf_dir))
    e = work.put("edges", graph.knn_edges(s, 5, 0.2005))
    first = s.groupBy("tree_id").agg(F.min("id").alias("node")).select("node")
    inside, outside = graph.seeds_in_graph(e, first)
    return inside.withColumn("inside", F.lit(True)).unionByName(outside.withColumn("inside", F.lit(False)))


def circle_landau(spark, sf_dir):
    c = fits.landau_groups(stems(spark, sf_dir), "tree_id")
    return c.select("tree_id", *[_r(v, 3) for v in ("cx", "cy", "r")])


def centre_votes(spark, sf_dir):
    """Votes along normals that point away from the middle of each tree."""
    s = stems(spark, sf_dir)
    mid = s.groupBy("tree_id").agg(*[(F.sum(F.round(F.col(c) * 1000).cast("long")) / F.count("*") / 1000).alias("m" + c) for c in "xy"])
    d = s.join(mid, "tree_id").withColumn("r", F.sqrt((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")))).where("r > 0.001")
    n = d.select("tree_id", "id", "x", "y", "z", ((F.col("x") - F.col("mx")) / F.col("r")).alias("nx"), ((F.col("y") - F.col("my")) / F.col("r")).alias("ny"), F.lit(0.0).alias("nz"))
    return hough.normal_votes(n, 0.0501, 0.25, True, ("tree_id",)).select("tree_id", "id", "votes", _r("distance"))


def _discs(spark, sf_dir):
    """One voted centre per tree, in whole pixels of 5 cm."""
    s = stems(spark, sf_dir).where("tree_id >= 1000")
    low = s.groupBy("tree_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    c = hough.single_centre(hough.hough_votes(hough.pixel_counts(s, 0.05, ("tree_id",)), 0.25, 0.05, 0.1, ("tree_id",)), ("tree_id",)).join(low, "tree_id")
    return c.select(F.col("tree_id").cast("long").alias("disc"), (F.floor(F.col("x0") / 0.05) + F.col("px")).cast("double").alias("x"), (F.floor(F.col("y0") / 0.05) + F.col("py")).cast("double").alias("y"), "votes")


def centre_groups(spark, sf_dir):
    d = Workspace(spark, "centres").put("discs", _discs(spark, sf_dir))
    return hough.group_discs(d, 60.5)


def _votes_sql(pixel: float, where: str) -> str:
    """Votes per tree: offsets of circles of 1 to 5 pixels, sampled once per pixel of their length."""
    return f"""st2 AS (SELECT * FROM st WHERE {where}),
low AS (SELECT tree_id, min(x) AS x0, min(y) AS y0 FROM st2 GROUP BY tree_id),
pc AS (SELECT tree_id, CAST(floor((x - x0) / {pixel}::DOUBLE) AS INT) AS px, CAST(floor((y - y0) / {pixel}::DOUBLE) AS INT) AS py, count(*) AS n FROM st2 JOIN low USING (tree_id) GROUP BY 1, 2, 3),
mx AS (SELECT tree_id, max(n) AS most FROM pc GROUP BY tree_id),
turn AS (SELECT step, unnest(generate_series(0, CAST(ceil(2 * pi() * step) AS INT) - 1)) AS k, ceil(2 * pi() * step) AS m FROM range(1, 6) t(step)),
ring AS (SELECT DISTINCT step, CAST(floor(step * cos(2 * pi() * k / m) + 0.5) AS INT) AS i, CAST(floor(step * sin(2 * pi() * k / m) + 0.5) AS INT) AS j FROM turn),
votes AS (SELECT tree_id, CAST(step AS INT) AS step, px + i AS px, py + j AS py, count(*) AS votes FROM pc JOIN mx USING (tree_id), ring WHERE n >= greatest(1, ceil(most * 0.1::DOUBLE)) GROUP BY 1, 2, 3, 4),
centre AS (SELECT tree_id, step, px, py, votes FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY votes DESC, step, py, px) AS r FROM votes) WHERE r = 1)"""


def _landau_sql(rounds: int = 50) -> str:
    steps = ["m AS (SELECT tree_id, avg(x) AS mx, avg(y) AS my FROM st GROUP BY tree_id)", "k0 AS (SELECT tree_id, mx, my, mx AS a, my AS b, false AS still FROM m)"]
    far = "greatest(sqrt((x - a) * (x - a) + (y - b) * (y - b)), 1e-300)"
    for i in range(rounds):
        steps.append(f"""n{i} AS MATERIALIZED (SELECT tree_id, any_value(mx) + avg({far}) * -avg((x - a) / {far}) AS a2, any_value(my) + avg({far}) * -avg((y - b) / {far}) AS b2 FROM k{i} JOIN st USING (tree_id) WHERE NOT still GROUP BY tree_id),
k{i + 1} AS MATERIALIZED (SELECT k.tree_id, mx, my, coalesce(a2, a) AS a, coalesce(b2, b) AS b, still OR abs(a2 - a) + abs(b2 - b) < 1e-8 AS still FROM k{i} k LEFT JOIN n{i} USING (tree_id))""")
    return f"WITH {_STEMS},\n" + ",\n".join(steps) + f"\nSELECT tree_id, round(any_value(a), 3) AS cx, round(any_value(b), 3) AS cy, round(avg(sqrt((x - a) * (x - a) + (y - b) * (y - b))), 3) AS r FROM k{rounds} JOIN st USING (tree_id) GROUP BY tree_id"


#: Area between the upper and the lower chain: a point is on the lower one if no slope to its left exceeds one to its right.
_AREA = """pt AS (SELECT tree_id, round(x * 1000) AS x, min(round(y * 1000)) AS lo, max(round(y * 1000)) AS hi FROM u WHERE tree_id IS NOT NULL GROUP BY 1, 2),
sl AS (SELECT p.tree_id, p.x, p.lo, p.hi, max(CASE WHEN q.x < p.x THEN (p.lo - q.lo) / (p.x - q.x) END) AS l1, min(CASE WHEN q.x > p.x THEN (q.lo - p.lo) / (q.x - p.x) END) AS l2,
  min(CASE WHEN q.x < p.x THEN (p.hi - q.hi) / (p.x - q.x) END) AS h1, max(CASE WHEN q.x > p.x THEN (q.hi - p.hi) / (q.x - p.x) END) AS h2 FROM pt p JOIN pt q USING (tree_id) GROUP BY ALL),
chain AS (SELECT tree_id, -1 AS side, x, lo AS y FROM sl WHERE l1 IS NULL OR l2 IS NULL OR l1 <= l2 UNION ALL SELECT tree_id, 1, x, hi FROM sl WHERE h1 IS NULL OR h2 IS NULL OR h1 >= h2),
strip AS (SELECT tree_id, side * (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM chain WINDOW w AS (PARTITION BY tree_id, side ORDER BY x)),
area AS (SELECT tree_id, CASE WHEN n > 2 THEN round(coalesce(a, 0) / 1e6, 7) END AS crown_area FROM (SELECT tree_id, sum(a) AS a FROM strip GROUP BY tree_id) JOIN (SELECT tree_id, count(*) AS n FROM u GROUP BY tree_id) USING (tree_id))"""
_SEGMENT = f"""th0 AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 0.1::DOUBLE), floor(y / 0.1::DOUBLE), floor(z / 0.1::DOUBLE) ORDER BY {_hash(0, 'id')}, id) AS r FROM u),
th AS MATERIALIZED (SELECT id, x, y, z FROM th0 WHERE r = 1 AND classification <> 2 AND z > 1.0::DOUBLE / 3),
mid AS (SELECT avg(y) AS my FROM t),
sd AS (SELECT tree_id::BIGINT AS tree_id, x, CASE WHEN radius > {LONGEST} THEN y - sign(y - my + 1e-12) * radius / 2 ELSE y END AS y, 1.3::DOUBLE AS z FROM t, mid WHERE tree_id IS NOT NULL),
nd AS MATERIALIZED (SELECT id * 2 AS id, x, y, z FROM th UNION ALL SELECT tree_id * 2 + 1, x, y, z FROM sd),
{_pairs('nd', 'nd', LONGEST)},
e AS (SELECT l_id, r_id, sqrt(d2) AS w FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY d2, r_id) AS r FROM pairs WHERE l_id <> r_id) WHERE r <= 50),
un AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM (SELECT l_id AS src, r_id AS dst, w FROM e UNION ALL SELECT r_id, l_id, w FROM e) GROUP BY src, dst),
best(node, m) USING KEY (node) AS (SELECT id, CASE WHEN id % 2 <> 0 THEN {{'dist': 0::DOUBLE, 'seed': id}} ELSE {{'dist': 1e9::DOUBLE, 'seed': 0::BIGINT}} END FROM nd
  UNION SELECT un.dst, min({{'dist': b.m.dist + un.w, 'seed': b.m.seed}}) FROM best b JOIN un ON b.node = un.src JOIN recurring.best o ON o.node = un.dst
    WHERE b.m.dist < 1e9 AND (b.m.dist + un.w < o.m.dist OR b.m.dist + un.w = o.m.dist AND b.m.seed < o.m.seed) GROUP BY un.dst),
lab AS MATERIALIZED (SELECT th.id, th.x, th.y, th.z, CASE WHEN m.dist < 999 THEN m.seed ELSE 0 END AS seed FROM th JOIN best ON best.node = th.id * 2),
hit AS (SELECT sd.tree_id, min({{'d2': (l.x - sd.x) * (l.x - sd.x) + (l.y - sd.y) * (l.y - sd.y) + (l.z - sd.z) * (l.z - sd.z), 'id': l.id}}) AS m FROM sd, lab l WHERE l.z BETWEEN 0.5 AND 2.0 GROUP BY sd.tree_id),
claim AS (SELECT seed, min(tree_id) AS tree_id FROM hit JOIN lab ON lab.id = hit.m.id WHERE seed <> 0 GROUP BY seed)"""

QUERIES = {f.__name__: f for f in (
    eigen_metrics, upright, crop_square, crop_outside, las_to_xyz, palette_colours, raster_classes, raster_window, distance_transform, patch_layer, label_overlap,
    tree_table, nudged_seeds, segment_snapped, seeds_in_graph, circle_landau, centre_votes, centre_groups,
)}

_TREE_COLUMNS = base.SQL["crown_base_height"].split("q AS (", 1)[1].split("\nSELECT q.tree_id", 1)[0]
_SHADE = f"""low AS (SELECT min(x) AS x0, min(y) AS y0 FROM u),
dep AS (SELECT floor((x - x0) / 0.1::DOUBLE) AS gx, floor((y - y0) / 0.1::DOUBLE) AS gy, min(z) AS depth FROM u, low GROUP BY 1, 2),
smp AS (SELECT id, z, floor((x - x0) / 0.1::DOUBLE) AS px, floor((y - y0) / 0.1::DOUBLE) AS py, trunc(({_hash(42, 'id', 's', "'0'")} / 4503599627370496::DOUBLE * 2 - 1) * 5) AS ox, trunc(({_hash(42, 'id', 's', "'1'")} / 4503599627370496::DOUBLE * 2 - 1) * 5) AS oy FROM u, low, range(16) r(s)),
met AS (SELECT id, z - depth AS below, sqrt(ox * ox + oy * oy) AS dist FROM smp JOIN dep ON gx = px + ox AND gy = py + oy),
shade AS (SELECT id, avg(CASE WHEN below > 0 THEN (1 - dist / 5) * least(1, below / (dist + 0.1::DOUBLE)) ELSE 0 END) AS o FROM met GROUP BY id)"""

SQL = {
    "eigen_metrics": _eigen_sql(),
    "upright": f"WITH {_CLOUD}\nSELECT id, z FROM u WHERE CASE WHEN verticality IS NULL OR isnan(verticality) THEN 0.5 ELSE verticality END >= 0.6666::DOUBLE",
    "crop_square": f"WITH {_CLOUD}\nSELECT id FROM u WHERE abs(x - 100) < 40.0005::DOUBLE AND abs(y - 100) < 40.0005::DOUBLE",
    "crop_outside": f"WITH {_CLOUD}\nSELECT id FROM u WHERE NOT (sqrt((x - 100) * (x - 100) + (y - 100) * (y - 100)) < 60.0005)",
    "las_to_xyz": 'SELECT X AS "X", Y AS "Y", Z AS "Z" FROM las',
    "palette_colours": "SELECT name, CAST('0x' || substr(c, 2, 2) AS INT) AS \"R\", CAST('0x' || substr(c, 4, 2) AS INT) AS \"G\", CAST('0x' || substr(c, 6, 2) AS INT) AS \"B\" FROM (VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in PALETTE.items()) + ") p(name, c)",
    "raster_classes": f"WITH {_HABITAT}\nSELECT row_, col_, CASE WHEN value > 0 AND value <= 5 THEN 1.0::DOUBLE WHEN value > 5 AND value <= 20 THEN 2.0::DOUBLE ELSE value END AS value FROM h",
    "raster_window": f"WITH {_HABITAT}\nSELECT row_, col_, value FROM h WHERE row_ BETWEEN 3 AND 11 AND col_ BETWEEN 20 AND 60",
    "distance_transform": f"WITH {_HABITAT},\ns AS (SELECT row_ AS r, col_ AS c FROM h WHERE value >= 10)\nSELECT row_, col_, round(sqrt(min((row_ - r) * (row_ - r) + (col_ - c) * (col_ - c))), 6) AS value FROM h, s GROUP BY row_, col_",
    "patchmorph": _patch_sql() + "SELECT * FROM patches",
    "sum_by_suitability": _patch_sql() + "SELECT suit, row_, col_, sum(coalesce(value, 0)) AS value FROM patches GROUP BY suit, row_, col_",
    "patch_layer": _patch_sql() + "SELECT row_, col_, value FROM patches WHERE suit = 10 AND gap = 2 AND spur = 4",
    "focal_max": f"WITH {_HABITAT}\nSELECT a.row_, a.col_, max(b.value) AS value FROM h a, {_near('', 2.0, '')} o LEFT JOIN h b ON b.row_ = a.row_ + o.i AND b.col_ = a.col_ + o.j GROUP BY a.row_, a.col_",
    "label_overlap": f"WITH RECURSIVE {_HABITAT},\n{_parts('p', 'value >= 5')},\n{_parts('q', 'value >= 10')}\nSELECT p.label AS label_a, q.label AS label_b, count(*) * 0.25::DOUBLE AS area FROM p JOIN q USING (row_, col_) GROUP BY 1, 2",
    "filled_holes": f"""WITH RECURSIVE {_CELLS},
box AS (SELECT label, min(row_) - 1 AS r0, max(row_) + 1 AS r1, min(col_) - 1 AS c0, max(col_) + 1 AS c1 FROM cells GROUP BY label),
field AS (SELECT label, r.row_, c.col_, r.row_ IN (r0, r1) OR c.col_ IN (c0, c1) AS rim FROM box, LATERAL (SELECT unnest(generate_series(r0, r1)) AS row_) r, LATERAL (SELECT unnest(generate_series(c0, c1)) AS col_) c),
free AS MATERIALIZED (SELECT label, row_, col_, rim FROM field ANTI JOIN cells USING (label, row_, col_)),
flood(label, row_, col_) AS (SELECT label, row_, col_ FROM free WHERE rim UNION SELECT b.label, b.row_, b.col_ FROM flood a JOIN free b ON a.label = b.label AND ({_NEXT}))
SELECT row_, col_, label FROM cells UNION ALL SELECT CAST(row_ AS INT), CAST(col_ AS INT), label FROM free ANTI JOIN flood USING (label, row_, col_)""",
    "closed_cells": f"""WITH RECURSIVE {_CELLS},
grown AS MATERIALIZED (SELECT DISTINCT label, row_ + i AS row_, col_ + j AS col_ FROM cells, {_near('', 2.0, '')} o),
open AS (SELECT g.label, g.row_, g.col_ FROM grown g, {_near('', 1.0, '')} o LEFT JOIN grown b ON b.label = g.label AND b.row_ = g.row_ + o.i AND b.col_ = g.col_ + o.j WHERE b.label IS NULL)
SELECT label, CAST(row_ AS INT) AS row_, CAST(col_ AS INT) AS col_ FROM grown ANTI JOIN open USING (label, row_, col_)""",
    "voxel_random": f"WITH {_CLOUD}\nSELECT id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 0.5), floor(y / 0.5), floor(z / 0.5) ORDER BY {_hash(7, 'id')}, id) AS r FROM u) WHERE r = 1",
    "bernoulli_sample": f"WITH {_CLOUD}\nSELECT id FROM u WHERE {_hash(3, 'id')} < 0.25::DOUBLE * 4503599627370496",
    "ssao": f"WITH {_CLOUD},\n{_SHADE}\nSELECT u.id, round(1 - least(1, coalesce(o, 0)), 6) AS value FROM u LEFT JOIN shade USING (id)",
    "crown_area": f"WITH {_CLOUD},\n{_AREA}\nSELECT tree_id, crown_area FROM area",
    "tree_table": f"""WITH {_CLOUD},\n{_SEEDS},\n{_AREA},\nq AS ({_TREE_COLUMNS},
top AS (SELECT tree_id, z AS height FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY z DESC, id) AS r FROM u) WHERE r = 1),
cb AS (SELECT q.tree_id, round(CASE WHEN f.i IS NULL THEN q.q[21] ELSE q.q[f.i + 1] END, 6) AS crown_base_height FROM q LEFT JOIN f USING (tree_id))
SELECT t.tree_id, t.x, t.y, t.radius, 2 * t.radius AS diameter, height, crown_area, crown_base_height FROM t LEFT JOIN top USING (tree_id) LEFT JOIN area USING (tree_id) LEFT JOIN cb USING (tree_id)""",
    "nudged_seeds": f"WITH {_SEEDS}\nSELECT tree_id, x, round(CASE WHEN radius > 0.15::DOUBLE THEN y - sign(y - (SELECT avg(y) FROM t) + 1e-12) * radius / 2 ELSE y END, 6) AS y FROM t",
    "seeds_in_graph": f"""WITH {_STEMS},
{_pairs('st', 'st', 0.2005)},
k AS (SELECT DISTINCT l_id AS id FROM pairs WHERE l_id <> r_id)
SELECT node, node IN (SELECT id FROM k) AS inside FROM (SELECT min(id) AS node FROM st GROUP BY tree_id)""",
    "circle_landau": _landau_sql(),
    "hough_votes": f"WITH {_STEMS},\n{_votes_sql(0.05, 'true')}\nSELECT * FROM votes",
    "hough_centre": f"WITH {_STEMS},\n{_votes_sql(0.05, 'true')}\nSELECT * FROM centre",
    "centre_votes": f"""WITH {_STEMS},
mid AS (SELECT tree_id, sum(CAST(round(x * 1000) AS BIGINT)) / count(*) / 1000 AS mx, sum(CAST(round(y * 1000) AS BIGINT)) / count(*) / 1000 AS my FROM st GROUP BY tree_id),
nrm AS (SELECT tree_id, id, x, y, (x - mx) / r AS nx, (y - my) / r AS ny FROM (SELECT *, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS r FROM st JOIN mid USING (tree_id)) WHERE r > 0.001),
stp AS (SELECT tree_id, id, x, y, -0.25::DOUBLE + i * 0.0501::DOUBLE AS d, nx, ny FROM nrm, range(0, CAST(floor((0.5 + 0.0501::DOUBLE) / 0.0501::DOUBLE - 1e-9) AS INT) + 1) r(i)),
vox AS (SELECT tree_id, id, d, floor((x + d * nx) / 0.0501::DOUBLE) AS vx, floor((y + d * ny) / 0.0501::DOUBLE) AS vy, floor(x / 0.0501::DOUBLE) AS ox, floor(y / 0.0501::DOUBLE) AS oy FROM stp),
one AS (SELECT tree_id, id, vx, vy, min(d) AS d FROM vox WHERE vx <> ox OR vy <> oy GROUP BY ALL),
cnt AS (SELECT tree_id, vx, vy, count(*) AS votes FROM one GROUP BY ALL)
SELECT tree_id, id, votes, round(abs(d), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, id ORDER BY votes DESC, d) AS r FROM one JOIN cnt USING (tree_id, vx, vy)) WHERE r = 1""",
    "centre_groups": f"""WITH RECURSIVE {_STEMS},
{_votes_sql(0.05, 'tree_id >= 1000')},
dc AS MATERIALIZED (SELECT tree_id::BIGINT AS disc, floor(x0 / 0.05::DOUBLE) + px AS x, floor(y0 / 0.05::DOUBLE) + py AS y, votes, row_number() OVER (ORDER BY votes DESC, tree_id) AS k FROM centre JOIN low USING (tree_id)),
walk(k, heads) AS (SELECT 0::BIGINT, []::STRUCT(disc BIGINT, x DOUBLE, y DOUBLE)[] UNION ALL
  SELECT w.k + 1, CASE WHEN len(list_filter(heads, lambda o: sqrt((o.x - d.x) * (o.x - d.x) + (o.y - d.y) * (o.y - d.y)) < 60.5)) > 0 THEN heads ELSE list_append(heads, {{'disc': d.disc, 'x': d.x, 'y': d.y}}) END FROM walk w JOIN dc d ON d.k = w.k + 1),
hd AS (SELECT unnest(generate_series(1, len(heads))) AS n, unnest(heads) AS o FROM (SELECT heads FROM walk ORDER BY k DESC LIMIT 1))
SELECT disc, arg_min(o.disc, n) AS tree FROM dc JOIN hd ON sqrt((o.x - dc.x) * (o.x - dc.x) + (o.y - dc.y) * (o.y - dc.y)) < 60.5 GROUP BY disc""",
    "rotation": f"""WITH {_CLOUD},
m AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz, 600 / sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS k FROM u),
f AS (SELECT CAST(fr AS INT) AS frame, fr * {2 * 3.141592653589793 * 5 / 60 / 10!r}::DOUBLE AS a, x - mx AS x, y - my AS y, z - mz AS z, k FROM u, m, range(120) r(fr))
SELECT frame, count(*) AS n, round(min((x * cos(a) - y * sin(a)) * k + 400), 4) AS u_min, round(max((x * cos(a) - y * sin(a)) * k + 400), 4) AS u_max, round(min(300 - z * k), 4) AS v_min, round(max(x * sin(a) + y * cos(a)), 4) AS depth_max FROM f GROUP BY frame""",
    "segment_points": f"WITH RECURSIVE {_CLOUD},\n{_SEEDS},\n{_SEGMENT}\nSELECT id, x, y, z, CAST(CASE WHEN lab.seed = 0 THEN 0 ELSE claim.tree_id END AS INT) AS tree_id FROM lab LEFT JOIN claim USING (seed)",
    "segment_snapped": f"""WITH RECURSIVE {_CLOUD},\n{_SEEDS},\n{_SEGMENT},
nm AS MATERIALIZED (SELECT id, x, y, z, CASE WHEN lab.seed = 0 THEN 0 ELSE claim.tree_id END AS tree_id FROM lab LEFT JOIN claim USING (seed)),
cp AS (SELECT nm.*, floor(x / 0.125) + i AS cx, floor(y / 0.125) + j AS cy FROM nm, range(-1, 2) a(i), range(-1, 2) b(j)),
sn AS (SELECT u.id, min({{'d2': (c.x - u.x) * (c.x - u.x) + (c.y - u.y) * (c.y - u.y) + (c.z - u.z) * (c.z - u.z), 'id': c.id, 'tree_id': c.tree_id}}) AS m FROM u JOIN cp c ON floor(u.x / 0.125) = c.cx AND floor(u.y / 0.125) = c.cy
  WHERE (c.x - u.x) * (c.x - u.x) + (c.y - u.y) * (c.y - u.y) + (c.z - u.z) * (c.z - u.z) <= 0.125::DOUBLE * 0.125::DOUBLE GROUP BY u.id)
SELECT u.id, u.x, u.y, u.z, CAST(CASE WHEN sn.m IS NULL OR coalesce(u.classification, 0) = 2 AND sn.m.tree_id IS NOT NULL THEN 0 ELSE sn.m.tree_id END AS INT) AS tree_id, round(sqrt(sn.m.d2), 6) AS nnd FROM u LEFT JOIN sn USING (id)""",
    "color_attr": f"""WITH {_CLOUD},
v AS (SELECT id, CASE WHEN NOT isnan(verticality) THEN verticality END AS v FROM u),
m AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
b AS (SELECT id, v, greatest(1, least(256, ceil((v - lo) / (hi - lo) * 256))) - 1 AS bin FROM v, m),
stop(k, r, g, bl) AS (VALUES (0, 0, 0, 0), (1, 255, 0, 0), (2, 255, 255, 255)),
w AS (SELECT id, v, least(1, floor(bin * 2 / 255)) AS k, bin * 2 / 255 - least(1, floor(bin * 2 / 255)) AS part FROM b)
SELECT id, """ + ", ".join(f"CASE WHEN v IS NULL THEN 0 ELSE CAST(floor(a.{c} + (b.{c} - a.{c}) * part + 0.5) AS INT) END AS \"{n}\"" for n, c in (("R", "r"), ("G", "g"), ("B", "bl"))) + " FROM w LEFT JOIN stop a ON a.k = w.k LEFT JOIN stop b ON b.k = w.k + 1",
}

__all__ = ["QUERIES", "SQL"]
