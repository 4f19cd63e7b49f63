"""Streaming jobs, run over the tables in several batches, and their table forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.plans.bindings import Source
from sitesift.plans.registry import query
from sitesift.plans.site_queries import STORED, features
from sitesift.plans.survey_queries import FOLDED, SPOTS
from sitesift.streaming import replay
from sitesift.streaming.sites import latest_site as newest
from sitesift.streaming.sites import store_cells, stream_site_changes
from sitesift.streaming.sites import stream_site_units as units_of_stream
from sitesift.streaming.sites import tile_progress as progress
from sitesift.streaming.spots import NAMES, stream_finished_drawings

# A user's event moves their site to one of the known places.
MOVES = """SELECT e.user_id AS project_id, e.event_id AS revision, e.ts, s.lat, s.lng FROM events e
  JOIN b_sites s ON s.site_id = (e.user_id * 7 + e.event_id) % (SELECT COUNT(*) FROM customer)"""


@query("latest_site", f"""
WITH m AS ({MOVES}) SELECT project_id, MAX(revision) AS revision, arg_max(lat, revision) AS lat, arg_max(lng, revision) AS lng FROM m GROUP BY 1
""")
def latest_site(s: Source) -> DataFrame:
    return newest(s.sql(MOVES).drop("ts")).select("project_id", "revision", "lat", "lng")


@query("stream_site_units", f"""
WITH m AS ({MOVES}), places AS (SELECT DISTINCT lng, lat, FLOOR(lng) AS cx, FLOOR(lat) AS cy FROM b_sites),
c AS (SELECT *, unnest(generate_series(CAST(FLOOR(south) AS BIGINT), CAST(FLOOR(north) AS BIGINT))) AS cy FROM (
  SELECT *, unnest(generate_series(CAST(FLOOR(west) AS BIGINT), CAST(FLOOR(east) AS BIGINT))) AS cx FROM b_features)),
h AS (
  SELECT p.lng, p.lat, MIN(f.feature_seq) AS feature_seq FROM places p JOIN c f ON f.cx = p.cx AND f.cy = p.cy
    AND p.lng BETWEEN f.west AND f.east AND p.lat BETWEEN f.south AND f.north
    AND (p.lng - (f.east - 0.125e0)) + (p.lat - (f.north - 0.125e0)) <= 0.125e0
    AND NOT (f.has_hole AND p.lng BETWEEN f.west + 0.125e0 AND f.east - 0.125e0 AND p.lat BETWEEN f.south + 0.125e0 AND f.north - 0.125e0)
  GROUP BY 1, 2)
SELECT m.project_id, m.revision, h.feature_seq FROM m LEFT JOIN h ON h.lng = m.lng AND h.lat = m.lat
""")
def stream_site_units(s: Source) -> DataFrame:
    moves = s.sql(MOVES).withColumn("part", (F.dayofmonth("ts") / 8).cast("int")).drop("ts")
    folder = replay.fresh_folder(s.spark)
    cells = store_cells(features(s), f"cells_{uuid.uuid4().hex}", f"{folder}/cells", (), 8, STORED)
    stream = replay.arrive(moves, "part", "project_id", f"{folder}/in", 4)
    running = units_of_stream(stream, cells, f"{folder}/out", f"{folder}/checkpoint", "revision")
    found = replay.ended(running, lambda: s.spark.read.parquet(f"{folder}/out"))
    return found.select("project_id", "revision", "feature_seq")


# Purchases date an item, clicks save a view; every other event is the site's. Sites keep to three places, so some rows move nothing.
PROJECTS = """SELECT e.user_id AS project_id, e.event_id AS revision, e.ts,
  CASE e.event_type WHEN 'purchase' THEN 'historical' WHEN 'click' THEN 'view' ELSE 'site' END AS kind,
  CASE e.event_type WHEN 'purchase' THEN CAST(e.event_id AS STRING) WHEN 'click' THEN CONCAT('view ', CAST(e.event_id % 5 AS STRING)) END AS item,
  s.lat, s.lng FROM events e LEFT JOIN b_sites s ON s.site_id = (e.user_id * 7 + e.event_id % 3) % (SELECT COUNT(*) FROM customer)
  AND e.event_type NOT IN ('purchase', 'click')"""


@query("stream_latest_site", f"""
WITH e AS ({PROJECTS}),
n AS (SELECT *, LAG(lat) OVER w AS plat, LAG(lng) OVER w AS plng FROM e WHERE kind = 'site' WINDOW w AS (PARTITION BY project_id ORDER BY revision)),
moves AS (SELECT project_id, revision, lat, lng FROM n WHERE plat IS NULL OR plat <> lat OR plng <> lng),
gone AS (SELECT e.project_id, e.kind, e.item, e.revision, MIN(m.revision) AS cleared
  FROM e LEFT JOIN moves m ON m.project_id = e.project_id AND m.revision > e.revision WHERE e.kind <> 'site' GROUP BY 1, 2, 3, 4),
parts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id, kind, cleared ORDER BY revision) AS sequence FROM gone)
SELECT project_id, 'site' AS kind, revision, CAST(NULL AS VARCHAR) AS item, lat, lng, CAST(NULL AS BIGINT) AS sequence FROM moves
UNION ALL SELECT project_id, kind, cleared, item, NULL, NULL, sequence FROM parts WHERE kind = 'historical' AND cleared IS NOT NULL
UNION ALL SELECT DISTINCT project_id, kind, cleared, item, NULL, NULL, CAST(NULL AS BIGINT) FROM parts WHERE kind = 'view' AND cleared IS NOT NULL
""")
def stream_latest_site(s: Source) -> DataFrame:
    bounds = s.table("events").stat.approxQuantile("event_id", [0.33, 0.66], 0.01)
    part = F.lit(0)
    for bound in bounds:
        part = part + (F.col("revision") > bound).cast("int")
    # revisions need not follow ts in the table; here event time follows the revision
    rows = s.sql(PROJECTS).withColumn("part", part).withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("part") * 3600))
    stream = replay.arrive(rows, "part", "project_id", replay.fresh_folder(s.spark), 3)
    return replay.finished(stream_site_changes(stream))


@query("tile_progress", """
SELECT user_id % 20 AS run_id, date_trunc('hour', ts) AS window_start, COUNT(*) AS total,
  CAST(SUM(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS done FROM events GROUP BY 1, 2
""")
def tile_progress(s: Source) -> DataFrame:
    events = s.table("events").withColumn("run_id", F.col("user_id") % 20)
    return progress(events, "run_id", done=F.col("event_type") != "error")


# Odd drawings come after the even ones have ended; a drawing is read in three strips of its page, ten minutes each.
ARRIVING = f"""SELECT *, part, timestamp_seconds(1700000000 + part * 600) AS seen_at FROM (
  SELECT *, CAST(3 * (drawing_id % 2) + FLOOR(x / 87) AS INT) AS part FROM ({SPOTS}))"""


@query("stream_dedupe_spots", FOLDED)
def stream_dedupe_spots(s: Source) -> DataFrame:
    rows = s.sql(ARRIVING).select("drawing_id", *NAMES, "seen_at", "part")
    later = s.sql("SELECT CAST(NULL AS BIGINT) AS drawing_id, 0L AS spot_id, 0D AS x, 0D AS y, 0D AS value, '' AS raw, 0D AS confidence, "
                  "timestamp_seconds(1700000000 + 86400) AS seen_at, 6 AS part")
    readings = replay.arrive(rows.unionByName(later), "part", "drawing_id", replay.fresh_folder(s.spark), 7)
    ended = replay.finished(stream_finished_drawings(readings, idle="25 minutes"))
    return ended.select("drawing_id", "spot_id", "x", "y", "value")
