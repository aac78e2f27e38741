"""Queries of the two general problems: neighbours and regions, and hot keys."""

from __future__ import annotations

from ..operators import points, regions, skew
from ..runtime import table


def p2_found(spark, sf_dir):
    return regions.near_and_inside(table(spark, sf_dir, "las"), table(spark, sf_dir, "plots"))


def p4_found(spark, sf_dir):
    return skew.highest_returns(table(spark, sf_dir, "las"), points.usable_rows)


def p4_key_profile(spark, sf_dir):
    return skew.key_profile(table(spark, sf_dir, "las"), points.usable_rows)


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_key_profile": p4_key_profile}

#: One row per usable point, shared by the statements below.
USABLE = """usable AS (
  SELECT point_id, min(X) AS x, min(Y) AS y, min(Z) AS z, min("treeID") AS "treeID"
  FROM las
  WHERE X IS NOT NULL AND Y IS NOT NULL AND Z IS NOT NULL AND NOT isnan(X) AND NOT isnan(Y) AND NOT isnan(Z)
    AND (Classification IS NULL OR Classification <> 7) AND point_id IS NOT NULL
  GROUP BY point_id)"""

SQL = {
    "p2_found": f"""WITH {USABLE},
home AS (SELECT *, floor(x / 0.0505) AS cx, floor(y / 0.0505) AS cy, floor(z / 0.0505) AS cz FROM usable),
steps AS (SELECT unnest([-1, 0, 1]) AS s),
build AS (SELECT h.point_id, h.x, h.y, h.z, h.cx + a.s AS cx, h.cy + b.s AS cy, h.cz + c.s AS cz FROM home h, steps a, steps b, steps c),
near AS (SELECT DISTINCT a.point_id AS key_a, b.point_id AS key_b FROM home a JOIN build b ON a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz
  WHERE a.point_id < b.point_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.0505::DOUBLE * 0.0505::DOUBLE),
disc AS (SELECT p.plot_id, u.point_id FROM plots p JOIN usable u ON u.x BETWEEN p.cx - p.radius AND p.cx + p.radius
  WHERE p.shape = 'disc' AND (u.x - p.cx) * (u.x - p.cx) + (u.y - p.cy) * (u.y - p.cy) < p.radius * p.radius),
corner AS (SELECT plot_id, ring, unnest(generate_series(1, len(ring))) AS i FROM plots WHERE shape = 'ring'),
edge AS (SELECT plot_id, ring[i].x AS x1, ring[i].y AS y1, ring[i % len(ring) + 1].x AS x2, ring[i % len(ring) + 1].y AS y2 FROM corner),
ring AS (SELECT e.plot_id, u.point_id FROM edge e JOIN usable u ON u.y >= least(e.y1, e.y2) AND u.y < greatest(e.y1, e.y2)
  WHERE e.x1 + (u.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) > u.x GROUP BY e.plot_id, u.point_id HAVING count(*) % 2 = 1)
SELECT 'near' AS kind, key_a, key_b FROM near
UNION ALL SELECT DISTINCT 'inside', plot_id::BIGINT, point_id FROM disc
UNION ALL SELECT 'inside', plot_id::BIGINT, point_id FROM ring""",
    "p4_found": f"""WITH {USABLE}
SELECT "treeID", point_id FROM (SELECT "treeID", point_id, row_number() OVER (PARTITION BY "treeID" ORDER BY z DESC, point_id) AS r FROM usable WHERE "treeID" IS NOT NULL) WHERE r = 1""",
    "p4_key_profile": f"""WITH {USABLE}
SELECT "treeID", count(*) AS n_points, min(z) AS z_min, max(z) AS z_max, sum(CAST(round(z * 1000) AS BIGINT)) / count(*) / 1000 AS z_mean FROM usable WHERE "treeID" IS NOT NULL GROUP BY "treeID\"""",
}
