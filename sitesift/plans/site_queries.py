"""Queries over sites, map sheets and geology polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geometry as G
from sitesift.functions import text as X
from sitesift.operators import legends, sites
from sitesift.plans.bindings import Source
from sitesift.plans.registry import query


def features(s: Source) -> DataFrame:
    """b_features as polygons with holes, unit codes and two datasets."""
    f = s.view("b_features")
    c = F.col
    outer = F.array(
        G.point("west", "south"), G.point("east", "south"), G.point("east", c("north") - 0.125),
        G.point(c("east") - 0.125, "north"), G.point("west", "north"), G.point("west", "south"))
    w, so, e, n = c("west") + 0.125, c("south") + 0.125, c("east") - 0.125, c("north") - 0.125
    hole = F.array(G.point(w, so), G.point(e, so), G.point(e, n), G.point(w, n), G.point(w, so))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return f.select(
        "feature_seq", F.when(c("feature_seq") % 2 == 0, "surficial").otherwise("bedrock")
        .alias("dataset_id"), F.col("label").alias("name"),
        X.surficial_code("label").alias("unit_code"), "west", "south", "east", "north",
        outer.alias("polygon"), F.when(c("has_hole"), F.array(hole)).otherwise(none).alias("holes"))


def views(s: Source) -> DataFrame:
    """A 100 km square around every site, with binary-exact corners."""
    return s.view("b_sites").select(
        F.col("site_id").alias("view_id"),
        G.bounds(F.col("lng") - 0.5, F.col("lat") - 0.375, F.col("lng") + 0.5,
                 F.col("lat") + 0.375).alias("bounds"))


STORED = ("west", "south", "east", "north")

# Which (site, feature) pairs hold, by exploded edges: shared by the checks.
HIT_SQL = """
pairs AS (
  SELECT s.site_id, s.lng, s.lat, f.feature_seq, f.label
  FROM b_sites s JOIN b_features f
    ON s.lng BETWEEN f.west AND f.east AND s.lat BETWEEN f.south AND f.north),
rings AS (
  SELECT p.site_id, p.feature_seq, p.label, e.ring_no,
    SUM(CASE WHEN (e.y2 > p.lat) <> (e.y1 > p.lat)
      AND p.lng < (e.x1 - e.x2) * (p.lat - e.y2)
        / CASE WHEN e.y1 = e.y2 THEN 1e0 ELSE e.y1 - e.y2 END + e.x2
      THEN 1 ELSE 0 END) % 2 AS odd,
    MAX(CASE WHEN ABS((p.lng - e.x1) * (e.y2 - e.y1) - (p.lat - e.y1) * (e.x2 - e.x1))
        <= 1e-10 * SQRT((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1))
      AND p.lng BETWEEN LEAST(e.x1, e.x2) - 1e-10 AND GREATEST(e.x1, e.x2) + 1e-10
      AND p.lat BETWEEN LEAST(e.y1, e.y2) - 1e-10 AND GREATEST(e.y1, e.y2) + 1e-10
      THEN 1 ELSE 0 END) AS on_edge
  FROM pairs p JOIN b_edges e ON e.feature_seq = p.feature_seq
  GROUP BY 1, 2, 3, 4),
hits AS (
  SELECT site_id, feature_seq, label FROM rings GROUP BY 1, 2, 3
  HAVING MAX(CASE WHEN ring_no = 0 THEN GREATEST(odd, on_edge) ELSE 0 END) = 1
     AND MAX(CASE WHEN ring_no = 1 THEN GREATEST(odd, on_edge) ELSE 0 END) = 0)
"""

CODES = "|".join(legends.surficial_codes())


def code_sql(text: str) -> str:
    return (f"NULLIF(regexp_extract(lower(trim({text})), "
            f"'(?:^|[^0-9a-z_])({CODES})(?:[^0-9a-z]|$)', 1), '')")


@query("site_unit", f"""
WITH {HIT_SQL}, first AS (SELECT site_id, MIN(feature_seq) AS feature_seq FROM hits GROUP BY 1)
SELECT s.site_id, s.lng, s.lat, f.feature_seq, f.label AS name, {code_sql("f.label")} AS unit_code
FROM b_sites s LEFT JOIN first USING (site_id) LEFT JOIN b_features f
  ON f.feature_seq = first.feature_seq
""")
def site_unit(s: Source) -> DataFrame:
    found = sites.site_unit(s.view("b_sites"), features(s), stored_box=STORED)
    return found.select("site_id", "lng", "lat", "feature_seq", "name", "unit_code")


@query("site_unit_by_edges", f"""
WITH {HIT_SQL} SELECT site_id, feature_seq FROM hits
""")
def site_unit_by_edges(s: Source) -> DataFrame:
    return sites.site_hits_by_edges(s.view("b_sites"), features(s), stored_box=STORED)


VISIBLE_SQL = """
v AS (SELECT site_id AS view_id, lng - 0.5e0 AS vw, lat - 0.375e0 AS vs, lng + 0.5e0 AS ve,
  lat + 0.375e0 AS vn FROM b_sites),
near AS (SELECT v.*, f.feature_seq, f.label FROM v JOIN b_features f
  ON f.west <= ve AND f.east >= vw AND f.south <= vn AND f.north >= vs),
by_edge AS (
  SELECT DISTINCT n.view_id, n.feature_seq FROM near n JOIN b_edges e ON e.feature_seq = n.feature_seq
  WHERE (e.x1 <> e.x2 OR (e.x1 >= vw AND e.x1 <= ve)) AND (e.y1 <> e.y2 OR (e.y1 >= vs AND e.y1 <= vn))
  AND GREATEST(0e0,
    CASE WHEN e.x2 > e.x1 THEN (vw - e.x1) / (e.x2 - e.x1) WHEN e.x2 < e.x1 THEN (ve - e.x1) / (e.x2 - e.x1) ELSE 0e0 END,
    CASE WHEN e.y2 > e.y1 THEN (vs - e.y1) / (e.y2 - e.y1) WHEN e.y2 < e.y1 THEN (vn - e.y1) / (e.y2 - e.y1) ELSE 0e0 END)
  <= LEAST(1e0,
    CASE WHEN e.x2 > e.x1 THEN (ve - e.x1) / (e.x2 - e.x1) WHEN e.x2 < e.x1 THEN (vw - e.x1) / (e.x2 - e.x1) ELSE 1e0 END,
    CASE WHEN e.y2 > e.y1 THEN (vn - e.y1) / (e.y2 - e.y1) WHEN e.y2 < e.y1 THEN (vs - e.y1) / (e.y2 - e.y1) ELSE 1e0 END)),
corners AS (
  SELECT view_id, feature_seq, 1 AS c, vw AS px, vs AS py FROM near UNION ALL
  SELECT view_id, feature_seq, 2, ve, vs FROM near UNION ALL
  SELECT view_id, feature_seq, 3, ve, vn FROM near UNION ALL
  SELECT view_id, feature_seq, 4, vw, vn FROM near),
corner_rings AS (
  SELECT p.view_id, p.feature_seq, p.c, e.ring_no,
    SUM(CASE WHEN (e.y2 > py) <> (e.y1 > py) AND px < (e.x1 - e.x2) * (py - e.y2)
      / CASE WHEN e.y1 = e.y2 THEN 1e0 ELSE e.y1 - e.y2 END + e.x2 THEN 1 ELSE 0 END) % 2 AS odd,
    MAX(CASE WHEN ABS((px - e.x1) * (e.y2 - e.y1) - (py - e.y1) * (e.x2 - e.x1)) <= 1e-10
      AND px BETWEEN LEAST(e.x1, e.x2) AND GREATEST(e.x1, e.x2)
      AND py BETWEEN LEAST(e.y1, e.y2) AND GREATEST(e.y1, e.y2) THEN 1 ELSE 0 END) AS on_edge
  FROM corners p JOIN b_edges e ON e.feature_seq = p.feature_seq GROUP BY 1, 2, 3, 4),
by_corner AS (
  SELECT DISTINCT view_id, feature_seq FROM (
    SELECT view_id, feature_seq, c FROM corner_rings GROUP BY 1, 2, 3
    HAVING MAX(CASE WHEN ring_no = 0 THEN GREATEST(odd, on_edge) ELSE 0 END) = 1
       AND MAX(CASE WHEN ring_no = 1 THEN GREATEST(odd, on_edge) ELSE 0 END) = 0) q),
seen AS (SELECT view_id, feature_seq FROM by_edge UNION SELECT view_id, feature_seq FROM by_corner)
"""


@query("visible_features", f"WITH {VISIBLE_SQL} SELECT view_id, feature_seq FROM seen")
def visible_features(s: Source) -> DataFrame:
    return sites.visible_features(views(s), features(s), stored_box=STORED).select(
        "view_id", "feature_seq")


@query("visible_units", f"""
WITH {VISIBLE_SQL}, coded AS (
  SELECT s.view_id, s.feature_seq, f.label, {code_sql("f.label")} AS unit_code
  FROM seen s JOIN b_features f ON f.feature_seq = s.feature_seq)
SELECT view_id, COALESCE(unit_code, label) AS unit_key, MAX(feature_seq) AS feature_seq
FROM coded GROUP BY 1, 2
""")
def visible_units(s: Source) -> DataFrame:
    found = sites.visible_units(views(s), features(s), attrs=(), stored_box=STORED)
    return found.select("view_id", "unit_key", "feature_seq")


@query("sort_units", f"""
WITH keys AS (SELECT CASE WHEN feature_seq % 2 = 0 THEN 'surficial' ELSE 'bedrock' END AS dataset_id,
  COALESCE({code_sql("label")}, label) AS unit_key FROM b_features),
units AS (SELECT DISTINCT dataset_id, unit_key FROM keys)
SELECT dataset_id, unit_key, CAST(ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY
  CASE WHEN regexp_extract(unit_key, '^[0-9]+') = '' THEN 1 ELSE 0 END,
  TRY_CAST(regexp_extract(unit_key, '^[0-9]+') AS BIGINT),
  lower(regexp_extract(unit_key, '^[0-9]+\\s*([A-Za-z]*)', 1)), lower(unit_key), unit_key) AS BIGINT) AS unit_pos
FROM units
""")
def sort_units(s: Source) -> DataFrame:
    units = features(s).select("dataset_id", sites.unit_key().alias("unit_key")).distinct()
    return sites.sort_units(units, "dataset_id")


@query("unit_counts", """
SELECT CASE WHEN feature_seq % 2 = 0 THEN 'surficial' ELSE 'bedrock' END AS dataset_id,
  COUNT(*) AS features, COUNT(DISTINCT feature_seq % 7) AS docs FROM b_features GROUP BY 1
""")
def unit_counts(s: Source) -> DataFrame:
    return sites.unit_counts(features(s).withColumn("doc", F.col("feature_seq") % 7))


@query("unit_coverage", f"""
WITH {VISIBLE_SQL}, area AS (
  SELECT feature_seq, COALESCE({code_sql("label")}, label) AS unit_key,
    (east - west) * (north - south) - 0.0078125e0
      - CASE WHEN has_hole THEN (east - west - 0.25e0) * (north - south - 0.25e0) ELSE 0e0 END AS a
  FROM b_features),
units AS (SELECT view_id, unit_key, SUM(a) AS area, COUNT(*) AS features
  FROM seen JOIN area USING (feature_seq) GROUP BY 1, 2),
total AS (SELECT view_id, SUM(area) AS t, CAST(SUM(features) AS BIGINT) AS n FROM units GROUP BY 1)
SELECT view_id, unit_key, ROUND(area, 9) AS area, features, ROUND(area / t, 9) AS share, FALSE AS is_total
FROM units JOIN total USING (view_id)
UNION ALL SELECT view_id, NULL, ROUND(t, 9), n, 1e0, TRUE FROM total
""")
def unit_coverage(s: Source) -> DataFrame:
    found = sites.unit_coverage(views(s), features(s), stored_box=STORED)
    return found.select(
        "view_id", "unit_key", F.round("area", 9).alias("area"), "features",
        F.round("share", 9).alias("share"), (F.col("is_total") == 1).alias("is_total"))


@query("scan_tiles", """
SELECT feature_seq, label AS name FROM b_features
WHERE west <= -80e0 AND east >= -86.5e0 AND south <= 46.25e0 AND north >= 44.5e0
""")
def scan_tiles(s: Source) -> DataFrame:
    view = {"west": -86.5, "east": -80.0, "south": 44.5, "north": 46.25}
    return sites.scan_tiles(features(s), view).select("feature_seq", "name")


@query("sheet_covered", """
WITH sheets AS (SELECT site_id, CASE WHEN site_id % 3 = 0 THEN 'surficial'
    WHEN site_id % 3 = 1 THEN 'bedrock' ELSE 'custom' END AS kind,
  lng - 0.5e0 AS w, lat - 0.375e0 AS s, lng + 0.5e0 AS e, lat + 0.375e0 AS n FROM b_sites),
datasets AS (SELECT CASE WHEN feature_seq % 2 = 0 THEN 'surficial' ELSE 'bedrock' END AS kind,
  MIN(west) AS west, MIN(south) AS south, MAX(east) AS east, MAX(north) AS north FROM b_features GROUP BY 1)
SELECT site_id, sheets.kind, COALESCE(west <= w AND east >= e AND south <= s AND north >= n, FALSE) AS covered
FROM sheets LEFT JOIN datasets ON datasets.kind = sheets.kind
""")
def sheet_covered(s: Source) -> DataFrame:
    sheets = views(s).select(
        F.col("view_id").alias("site_id"),
        F.when(F.col("view_id") % 3 == 0, "surficial").when(F.col("view_id") % 3 == 1, "bedrock")
        .otherwise("custom").alias("kind"), "bounds")
    extent = features(s).groupBy(F.col("dataset_id").alias("kind")).agg(
        *[(F.min if c in ("west", "south") else F.max)(c).alias(c) for c in STORED])
    datasets = extent.select("kind", G.bounds(*STORED).alias("coverage"))
    return sites.sheet_covered(sheets, datasets).select("site_id", "kind", "covered")


def legend_values() -> str:
    rows = legends._rows(legends.SURFICIAL_LEGEND)
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


@query("legend_lookup", f"""
WITH legend AS (SELECT * FROM (VALUES {legend_values()}) AS t(code, color, title, detail)),
coded AS (SELECT feature_seq, label, {code_sql("label")} AS code FROM b_features)
SELECT c.feature_seq, c.code, l.title, l.detail, l.color,
  CASE WHEN l.code IS NULL THEN NULL
    WHEN regexp_replace(l.code, '[a-z]$', '') IN (l.code, '5') THEN '' ELSE p.detail END AS material
FROM coded c LEFT JOIN legend l ON l.code = c.code
LEFT JOIN legend p ON p.code = regexp_replace(l.code, '[a-z]$', '')
""")
def legend_lookup(s: Source) -> DataFrame:
    coded = features(s).select("feature_seq", F.col("unit_code").alias("code"))
    return legends.legend_lookup(coded, legends.surficial_legend(s.spark)).select(
        "feature_seq", "code", "title", "detail", "color", "material")


@query("geometry_bounds", """
SELECT feature_seq, MIN(LEAST(x1, x2)) AS west, MIN(LEAST(y1, y2)) AS south,
  MAX(GREATEST(x1, x2)) AS east, MAX(GREATEST(y1, y2)) AS north FROM b_edges GROUP BY 1
""")
def geometry_bounds(s: Source) -> DataFrame:
    return features(s).select(
        "feature_seq", G.geometry_bounds("polygon", "holes").alias("b")).select("feature_seq", "b.*")


@query("dataset_bounds", """
SELECT CASE WHEN feature_seq % 2 = 0 THEN 'surficial' ELSE 'bedrock' END AS dataset_id,
  MIN(west) AS west, MIN(south) AS south, MAX(east) AS east, MAX(north) AS north,
  COUNT(*) AS feature_count FROM b_features GROUP BY 1
""")
def dataset_bounds(s: Source) -> DataFrame:
    return sites.dataset_bounds(features(s).drop(*STORED), "dataset_id")


@query("ring_area", """
SELECT feature_seq, ROUND((east - west) * (north - south) - 0.0078125e0, 9) AS area FROM b_features
""")
def ring_area(s: Source) -> DataFrame:
    return features(s).select(
        "feature_seq", F.round(G.ring_area("polygon"), 9).alias("area"))


@query("merge_features", """
SELECT CAST(0 AS INT) AS part_no, feature_seq, label AS name FROM b_features WHERE feature_seq % 2 = 0
UNION ALL SELECT CAST(1 AS INT), feature_seq, label FROM b_features WHERE feature_seq % 2 = 1
""")
def merge_features(s: Source) -> DataFrame:
    f = features(s).select("dataset_id", "feature_seq", "name")
    return sites.merge_features(
        f.where("dataset_id = 'surficial'"), f.where("dataset_id = 'bedrock'")
    ).select("part_no", "feature_seq", "name")
