"""Queries over the text that the sinks write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geometry as G
from sitesift.plans.bindings import Source
from sitesift.plans.geodesy_queries import FRAMES, frame_world
from sitesift.plans.record_queries import FILE_ROWS
from sitesift.plans.registry import query, scalar
from sitesift.plans.site_queries import features
from sitesift.plans.survey_queries import SPOTS, contours
from sitesift.sinks import exports
from sitesift.session import shared_folder

OPTIONS = {"image_height": 190, "scale": 1500, "dpi": 300, "origin_e": 500000.0,
           "origin_n": 4800000.0, "start": 7, "description": "spot elev"}
POINTS_SQL = f"""
s AS ({SPOTS}), p AS (SELECT *, 6 + ROW_NUMBER() OVER (PARTITION BY drawing_id ORDER BY spot_id) AS number,
  500000e0 + x * 0.127e0 AS e, 4800000e0 + (190 - y) * 0.127e0 AS n FROM s WHERE include)
"""


def lines(s: Source, line) -> DataFrame:
    spots = s.sql(SPOTS).withColumn("raw_full", F.concat(F.lit('EL "'), "raw", F.lit('"'))).withColumn(
        "status", F.when(F.col("confidence") > 0.9, "OK"))
    points = exports.survey_points(spots, OPTIONS)
    return points.select("drawing_id", "spot_id", line().alias("line"))


@query("write_spot_csv", f"""
WITH {POINTS_SQL} SELECT drawing_id, spot_id, printf('%d,%.2f,%.4f,%.4f,%.1f,%.1f,spot_elev,%s,', number, value, e, n, x, y,
  CASE WHEN confidence > 0.9 THEN 'OK' ELSE 'REVIEW' END) || replace('|EL ||' || raw || '||' || '|', '|', chr(34)) AS line FROM p
""")
def write_spot_csv(s: Source) -> DataFrame:
    return lines(s, exports.csv_line)


@query("write_pnezd", f"WITH {POINTS_SQL} SELECT drawing_id, spot_id, printf('%d,%.4f,%.4f,%.3f,spot_elev', number, n, e, value) AS line FROM p")
def write_pnezd(s: Source) -> DataFrame:
    return lines(s, exports.pnezd_line)


@query("write_landxml", f"""
WITH {POINTS_SQL} SELECT drawing_id, spot_id, printf('    <CgPoint name="%d" desc="spot_elev" code="spot_elev">%.4f %.4f %.3f</CgPoint>', number, n, e, value) AS line FROM p
""")
def write_landxml(s: Source) -> DataFrame:
    return lines(s, exports.landxml_line)


@query("write_dxf_points", f"""
WITH {POINTS_SQL} SELECT drawing_id, spot_id, replace(printf('0|POINT|8|SPOT_ELEVATIONS|10|%.4f|20|%.4f|30|%.3f|0|TEXT|8|SPOT_LABELS|10|%.4f|20|%.4f|30|%.3f|40|0.9|1|%.2f spot_elev',
  e, n, value, e + 0.5e0, n + 0.5e0, value, value), '|', chr(10)) AS line FROM p
""")
def write_dxf_points(s: Source) -> DataFrame:
    return lines(s, exports.dxf_point)


BLOCK_PART = "0|ATTRIB|8|SPOT_ELEVATIONS|10|%.4f|20|%.4f|30|%.3f|40|0.8|1|{value}|2|{tag}|70|0|"


@query("write_dxf_blocks", f"""
WITH {POINTS_SQL} SELECT drawing_id, spot_id, replace(
  printf('0|INSERT|8|SPOT_ELEVATIONS|2|POINT|66|1|10|%.4f|20|%.4f|30|%.3f|41|1|42|1|43|1|50|0|', e, n, value)
  || printf('{BLOCK_PART.format(value="%.3f", tag="ELEV")}', e + 0.8e0, n + 0.8e0, value, value)
  || printf('{BLOCK_PART.format(value="%d", tag="POINT")}', e + 0.8e0, n, value, number)
  || printf('{BLOCK_PART.format(value="spot_elev", tag="DESC")}', e + 0.8e0, n - 0.8e0, value)
  || '0|SEQEND|8|SPOT_ELEVATIONS', '|', chr(10)) AS line FROM p
""")
def write_dxf_blocks(s: Source) -> DataFrame:
    return lines(s, exports.dxf_block_point)


@query("write_dxf_polylines", """
SELECT contour_id, replace(printf('0|POLYLINE|8|%s|66|1|10|0|20|0|30|%.3f|70|8', layer, z)
  || printf('|0|VERTEX|8|%s|10|%.4f|20|%.4f|30|%.3f|70|32', layer, x1, y1, z) || printf('|0|VERTEX|8|%s|10|%.4f|20|%.4f|30|%.3f|70|32', layer, x2, y2, z)
  || printf('|0|VERTEX|8|%s|10|%.4f|20|%.4f|30|%.3f|70|32', layer, x3, y3, z)
  || CASE WHEN contour_id % 4 = 0 THEN printf('|0|VERTEX|8|%s|10|%.4f|20|%.4f|30|%.3f|70|32', layer, x1, y1, z) ELSE '' END || '|0|SEQEND', '|', chr(10)) AS line
FROM (SELECT *, CASE WHEN contour_id % 3 = 0 THEN 0e0 ELSE CAST(contour_id % 100 AS DOUBLE) END AS z FROM b_contours) c
""")
def write_dxf_polylines(s: Source) -> DataFrame:
    c = F.col
    z = F.when(c("contour_id") % 3 != 0, (c("contour_id") % 100).cast("double"))
    return contours(s).select("contour_id", exports.contour_entity(
        "layer", "points", z, c("contour_id") % 4 == 0).alias("line"))


def vertex(x: str, y: str) -> str:
    # Coordinates are multiples of 1/16, so text without an exponent is exact.
    number = "regexp_replace(regexp_replace(printf('%.6f', {v}), '0+$', ''), '[.]$', '')"
    return f"'|10|' || {number.format(v=x)} || '|20|' || {number.format(v=y)}"


@query("write_boundaries", f"""
SELECT feature_seq, replace('0|LWPOLYLINE|5|' || printf('%X', feature_seq + 16) || '|100|AcDbEntity|8|SITE_BOUNDARY|100|AcDbPolyline|90|6|70|1'
  || {vertex('west', 'south')} || {vertex('east', 'south')} || {vertex('east', '(north - 0.125e0)')} || {vertex('(east - 0.125e0)', 'north')}
  || {vertex('west', 'north')} || {vertex('west', 'south')}, '|', chr(10)) AS line FROM b_features
""")
def write_boundaries(s: Source) -> DataFrame:
    return features(s).select("feature_seq", exports.boundary_entity(
        F.lit("SITE_BOUNDARY"), F.slice("polygon", 1, 5), F.col("feature_seq") + 16).alias("line"))


@query("write_manifest", f"""
SELECT path, '{{"bytes":' || bytes || ',"doc_id":' || doc_id || ',"mime":"' || mime || '","path":"' || path || '","pixel_height":' || COALESCE(CAST(pixel_height AS VARCHAR), 'null')
  || ',"pixel_width":' || COALESCE(CAST(pixel_width AS VARCHAR), 'null') || ',"sha256":"' || sha256 || '","world_file_path":' || COALESCE('"' || world_file_path || '"', 'null') || '}}' AS json,
  concat_ws(',', doc_id, path, mime, sha256, bytes, COALESCE(CAST(pixel_width AS VARCHAR), ''), COALESCE(CAST(pixel_height AS VARCHAR), ''), COALESCE(world_file_path, '')) AS csv
FROM ({FILE_ROWS}) f
""")
def write_manifest(s: Source) -> DataFrame:
    rows = s.sql(FILE_ROWS).withColumn("package_id", F.lit(1))
    return exports.manifest_rows(rows).select("path", "json", "csv")


scalar("write_world_files", FRAMES, ["site_id"],
       lambda: {"text": exports.world_file_text(frame_world())},
       {"text": "CASE WHEN k > 0 THEN '0.750000000000' || chr(10) || '0.00000000000' || chr(10) || '0.00000000000' || chr(10) || '-0.750000000000' "
                "|| chr(10) || printf('%.6f', x + k / 2) || chr(10) || printf('%.5f', y - k / 2) || chr(10) END"})


@query("write_feature_tiles", """
SELECT CASE WHEN feature_seq % 2 = 0 THEN 'surficial' ELSE 'bedrock' END AS dataset_id,
  CAST(CAST(FLOOR(west) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(FLOOR(south) AS BIGINT) AS VARCHAR) AS tile,
  MIN(west) AS west, MIN(south) AS south, MAX(east) AS east, MAX(north) AS north, COUNT(*) AS feature_count
FROM b_features GROUP BY 1, 2
""")
def write_feature_tiles(s: Source) -> DataFrame:
    """Written, published, read again through the contract, and summed up."""
    path = f"{shared_folder(s.spark)}/tiles-{uuid.uuid4().hex}"
    exports.write_feature_tiles(features(s), path, s.table("part").count())
    stored = exports.read_feature_tiles(s.spark, path)
    return exports.tile_manifest(stored.drop("west", "south", "east", "north"), "dataset_id", "tile")


@query("read_feature_tiles", """
SELECT CASE WHEN feature_seq % 2 = 0 THEN 'surficial' ELSE 'bedrock' END AS dataset_id, feature_seq, west, north FROM b_features
WHERE west <= -84e0 AND east >= -86.5e0 AND south <= 46.25e0 AND north >= 44.5e0
""")
def read_feature_tiles(s: Source) -> DataFrame:
    """A viewport read from what was written and published."""
    path = f"{shared_folder(s.spark)}/tiles-{uuid.uuid4().hex}"
    exports.write_feature_tiles(features(s), path, s.table("part").count())
    view = {"west": -86.5, "east": -84.0, "south": 44.5, "north": 46.25}
    return exports.read_feature_tiles(s.spark, path, view).select("dataset_id", "feature_seq", "west", "north")


@query("write_source_record", """
SELECT o_orderkey AS item, 'H-' || o_orderkey || chr(10) || 'Acquisition year: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE '1990' END || chr(10)
  || 'Acquisition year verification: unverified' || chr(10) || 'Provider: ' || o_orderpriority || chr(10) || 'Attribution: By' || chr(10) || '    two' || chr(10)
  || 'Licence: L' || chr(10) || 'Redistribution evidence: E' || chr(10) || 'Image: not provided' AS text FROM orders
""")
def write_source_record(s: Source) -> DataFrame:
    c = F.col
    items = s.table("orders").select(
        c("o_orderkey").alias("item"), F.concat(F.lit("H-"), c("o_orderkey").cast("string")).alias("code"),
        F.when(c("o_orderkey") % 3 != 0, 1990).alias("year"), F.lit("unverified").alias("verification"),
        c("o_orderpriority").alias("provider"), F.lit("By\ntwo").alias("attribution"), F.lit("L").alias("license"),
        F.lit("E").alias("evidence"), F.lit(None).cast("string").alias("image_path"))
    return items.select("item", exports.source_record_text().alias("text"))


HREFS = """SELECT page_id, 'https://g.example.org/mines/data/google/mrd128/polygons/a/b.kml' AS base,
  CASE page_id % 4 WHEN 0 THEN CONCAT('t', CAST(page_id AS STRING), '.kml') WHEN 1 THEN 'http://g.example.org/Mines/Data/Google/MRD128/polygons/c.kmz'
    WHEN 2 THEN url ELSE '/mines/data/google/mrd128/polygons/d.kml' END AS href FROM pages"""


@query("rewrite_links", f"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../../../mrd128-cache/polygons/a/' || href WHEN 1 THEN '../../../mrd128-cache/polygons/c.kmz'
  WHEN 2 THEN href ELSE '../../../mrd128-cache/polygons/d.kml' END AS local_href FROM ({HREFS}) h
""")
def rewrite_links(s: Source) -> DataFrame:
    return exports.rewrite_links(s.sql(HREFS)).select("page_id", "local_href")
