"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import table
from . import clusters, leaks, neighbors, percentiles, split, tokens, truncation


def p7_ids(spark, sf_dir):
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark, sf_dir):
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark, sf_dir):
    return truncation.find_truncated(table(spark, sf_dir, "documents"))


def p9_rates(spark, sf_dir):
    return truncation.truncation_rates(table(spark, sf_dir, "documents"))


def p1_found(spark, sf_dir):
    rows = split.scan_positions(table(spark, sf_dir, "las"), table(spark, sf_dir, "scans"))
    b = split.natural_boundaries(rows)
    return b.select(F.col("item").alias("scan_id"), "point_a", "point_b")


def p1_pieces(spark, sf_dir):
    rows = split.scan_positions(table(spark, sf_dir, "las"), table(spark, sf_dir, "scans"))
    return split.cut_pieces(rows).withColumnRenamed("item", "scan_id")


def p3_found(spark, sf_dir):
    return clusters.unlabelled_groups(table(spark, sf_dir, "las")).select("group_id", "point_id")


def p3_groups(spark, sf_dir):
    return clusters.describe_groups(table(spark, sf_dir, "las"))


def p3_sizes(spark, sf_dir):
    """The size of each group, as SQL can say it too; ``p3_groups`` adds the most typical points."""
    g = clusters.unlabelled_groups(table(spark, sf_dir, "las"))
    return g.groupBy("group_id").agg(F.count("*").alias("n_points"))


def p5_found(spark, sf_dir):
    return neighbors.nearest_pairs(neighbors.slice_vectors(table(spark, sf_dir, "las")))


def p5_search(spark, sf_dir):
    return neighbors.search_slice(table(spark, sf_dir, "las"))


def p6_found(spark, sf_dir):
    return percentiles.striking_trees(table(spark, sf_dir, "las"))


def p6_percentiles(spark, sf_dir):
    p = percentiles.tree_percentiles(table(spark, sf_dir, "las"), [0.05, 0.5, 0.95])
    return p.select("treeID", "measure", "n", "p", F.round("value", 6).alias("value"))


def p6_by_day(spark, sf_dir):
    p = percentiles.tree_percentiles(table(spark, sf_dir, "las"), [0.25, 0.75], by_day=True)
    return p.select("treeID", "measure", "n", "p", F.round("value", 6).alias("value"))


def p6_from_parts(spark, sf_dir):
    """Percentiles of all scans from block tables that were stored for groups of scans by themselves."""
    p = percentiles.percentiles_from_parts(table(spark, sf_dir, "las"), [0.5, 0.9])
    return p.select("treeID", "measure", "n", "p", F.round("value", 6).alias("value"))


def p9_sources(spark, sf_dir):
    """Texts with content per source, as SQL can say it too; ``p9_rates`` adds how many are cut."""
    return truncation.truncation_rates(table(spark, sf_dir, "documents")).select("source", "n_docs")


QUERIES = {
    "p1_found": p1_found, "p1_pieces": p1_pieces,
    "p3_found": p3_found, "p3_groups": p3_groups, "p3_sizes": p3_sizes,
    "p5_found": p5_found, "p5_search": p5_search,
    "p6_found": p6_found, "p6_percentiles": p6_percentiles, "p6_by_day": p6_by_day, "p6_from_parts": p6_from_parts,
    "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_rates": p9_rates, "p9_sources": p9_sources,
}

_USABLE = """usable AS (
  SELECT point_id, min(scan_id) AS scan_id, min(X) AS x, min(Y) AS y, min(Z) AS z, min("treeID") AS "treeID", min(verticality) AS verticality
  FROM las
  WHERE X IS NOT NULL AND Y IS NOT NULL AND Z IS NOT NULL AND NOT isnan(X) AND NOT isnan(Y) AND NOT isnan(Z)
    AND (Classification IS NULL OR Classification <> 7) AND point_id IS NOT NULL
  GROUP BY point_id)"""
_MEASURES = f"""{_USABLE},
long AS (SELECT "treeID", 'Z' AS measure, z AS v FROM usable WHERE "treeID" IS NOT NULL
  UNION ALL SELECT "treeID", 'verticality', verticality FROM usable WHERE "treeID" IS NOT NULL AND verticality IS NOT NULL AND NOT isnan(verticality))"""


def _percentile_sql(ps: list[float]) -> str:
    parts = [f"SELECT \"treeID\", measure, count(*) AS n, {p}::DOUBLE AS p, round(quantile_cont(v, {p}), 6) AS value FROM long GROUP BY \"treeID\", measure" for p in ps]
    return f"WITH {_MEASURES}\n" + "\nUNION ALL ".join(parts)


SQL: dict[str, str] = {
    "p1_found": f"""WITH {_USABLE},
placed AS (SELECT u.scan_id, CASE WHEN s.axis = 'X' THEN u.x ELSE u.y END AS pos, u.point_id, count(*) OVER (PARTITION BY u.scan_id) AS n FROM usable u JOIN scans s ON u.scan_id = s.scan_id),
places AS (SELECT scan_id, pos, min(point_id) AS id FROM placed WHERE n > 400 GROUP BY scan_id, pos),
steps AS (SELECT scan_id, id, lag(id) OVER w AS before_id, round(pos - lag(pos) OVER w, 6) AS step FROM places WINDOW w AS (PARTITION BY scan_id ORDER BY pos))
SELECT scan_id, least(id, before_id) AS point_a, greatest(id, before_id) AS point_b FROM steps WHERE step >= 1.0""",
    "p3_found": f"""WITH RECURSIVE {_USABLE},
v AS (SELECT point_id AS id, CAST(round(x * 1000) AS BIGINT) AS x, CAST(round(y * 1000) AS BIGINT) AS y, CAST(round(z * 1000) AS BIGINT) AS z FROM usable WHERE "treeID" IS NULL),
link AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON b.x BETWEEN a.x - 801 AND a.x + 801 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 640800),
reach(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
named AS (SELECT b AS point_id, min(a) AS group_id FROM reach GROUP BY b),
kept AS (SELECT group_id FROM named GROUP BY group_id HAVING count(*) >= 5)
SELECT group_id, point_id FROM named WHERE group_id IN (SELECT group_id FROM kept)""",
    "p9_sources": "SELECT source, count(*) AS n_docs FROM documents WHERE regexp_matches(text, '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]') GROUP BY source",
    "p5_found": f"""WITH {_USABLE},
v AS (SELECT point_id AS id, CAST(round(x * 1000) AS BIGINT) AS x, CAST(round(y * 1000) AS BIGINT) AS y, CAST(round(z * 1000) AS BIGINT) AS z FROM usable WHERE round(z, 6) BETWEEN 1.1 AND 1.6),
d AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.id) AS r FROM v a JOIN v b ON a.id <> b.id)
SELECT DISTINCT least(a, b) AS point_a, greatest(a, b) AS point_b FROM d WHERE r <= 3""",
    "p6_found": f"""WITH {_MEASURES}
SELECT "treeID", measure FROM long GROUP BY "treeID", measure
HAVING count(*) >= 30 AND CASE WHEN measure = 'verticality' THEN round(quantile_cont(v, 0.5), 9) >= 0.70 ELSE round(quantile_cont(v, 0.95) - quantile_cont(v, 0.5), 9) >= 12 END""",
    "p6_percentiles": _percentile_sql([0.05, 0.5, 0.95]),
    "p6_by_day": _percentile_sql([0.25, 0.75]),
    "p6_from_parts": _percentile_sql([0.5, 0.9]),
}
SQL["p3_sizes"] = f"SELECT group_id, count(*) AS n_points FROM ({SQL['p3_found']}) GROUP BY group_id"
SQL["p1_pieces"] = f"""WITH {_USABLE},
placed AS (SELECT u.scan_id, CAST(round((CASE WHEN s.axis = 'X' THEN u.x ELSE u.y END) * 1e6) AS BIGINT) AS pos, u.point_id, count(*) OVER (PARTITION BY u.scan_id) AS m FROM usable u JOIN scans s ON u.scan_id = s.scan_id),
pl AS (SELECT scan_id, pos, count(*) AS n FROM placed WHERE m > 400 GROUP BY scan_id, pos),
w1 AS (SELECT *, sum(n) OVER w - n AS off, CASE WHEN pos - lag(pos) OVER w >= 1000000 THEN 1 ELSE 0 END AS cut FROM pl WINDOW w AS (PARTITION BY scan_id ORDER BY pos)),
w2 AS (SELECT *, sum(cut) OVER (PARTITION BY scan_id ORDER BY pos) AS seg FROM w1),
w3 AS (SELECT *, sum(n) OVER (PARTITION BY scan_id, seg ORDER BY pos RANGE BETWEEN CURRENT ROW AND 500000 FOLLOWING) - n AS ahead FROM w2),
sg AS (SELECT scan_id, seg, min(off) AS start, sum(n) AS size, max(ahead + n - 1) AS most FROM w3 GROUP BY 1, 2),
st AS (SELECT *, CASE WHEN size > 400 THEN CASE WHEN most <= 300 THEN 400 - most ELSE 200 END END AS step FROM sg),
small AS (SELECT scan_id, min(start) AS first, sum(size) AS n_core, 0 AS shared FROM st WHERE size <= 200 GROUP BY scan_id, floor(start / 200)),
alone AS (SELECT scan_id, start AS first, size AS n_core, 0 AS shared FROM st WHERE size > 200 AND step IS NULL),
core AS (SELECT scan_id, seg, start, size, step, unnest(generate_series(0, CAST(ceil(size / step) AS BIGINT) - 1)) AS k FROM st WHERE step IS NOT NULL),
bounds AS (SELECT *, start + k * step AS first, least(start + (k + 1) * step, start + size) - (start + k * step) AS n_core FROM core),
long AS (SELECT b.scan_id, b.first, b.n_core, CASE WHEN b.n_core < b.step OR b.first + b.n_core = b.start + b.size THEN 0 ELSE least(400 - b.step, w.off + w.n - (b.first + b.n_core) + w.ahead) END AS shared
  FROM bounds b JOIN w3 w ON w.scan_id = b.scan_id AND w.seg = b.seg AND w.off <= b.first + b.n_core - 1 AND w.off + w.n > b.first + b.n_core - 1)
SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY first) AS piece, CAST(first AS BIGINT) AS first, CAST(n_core AS BIGINT) AS n_core, CAST(n_core + shared AS BIGINT) AS n_points
FROM (SELECT * FROM small UNION ALL SELECT * FROM alone UNION ALL SELECT * FROM long)"""
