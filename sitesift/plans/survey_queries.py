"""Queries over survey labels and contour lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geodesy as D
from sitesift.functions import geometry as G
from sitesift.functions import text as X
from sitesift.operators import surveys
from sitesift.plans.bindings import Source
from sitesift.plans.registry import query, rounded, scalar

# b_tokens with an id of its own and the value as text.
SPOTS = """
SELECT drawing_id, ((x * 190 + y) * 1000 + whole) * 300 + cents * 3
    + CASE confidence WHEN 0.95e0 THEN 0 WHEN 0.58e0 THEN 1 ELSE 2 END AS spot_id,
  CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, whole + cents / 1e2 AS value, whole, cents,
  CONCAT(CAST(whole AS STRING), '.', LPAD(CAST(cents AS STRING), 2, '0')) AS raw, confidence,
  (whole % 5 <> 0) AS include
FROM b_tokens
"""
SPOTS = SPOTS.replace("cents / 1e2", "cents / 100e0")


@query("dedupe_spots", f"""
WITH s AS ({SPOTS})
SELECT drawing_id, spot_id, x, y, value FROM s p WHERE NOT EXISTS (
  SELECT 1 FROM s q WHERE q.drawing_id = p.drawing_id
    AND SQRT((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) <= 40
    AND (q.raw = p.raw OR ABS(q.value - p.value) < 0.011e0)
    AND (q.confidence > p.confidence OR (q.confidence = p.confidence AND q.spot_id < p.spot_id)))
""")
def dedupe_spots(s: Source) -> DataFrame:
    return surveys.dedupe_spots(s.sql(SPOTS).drop("whole", "cents", "include")).select("drawing_id", "spot_id", "x", "y", "value")


# The sequential merge as a fold over the readings of each drawing, one reading a step.
FOLDED = f"""
WITH RECURSIVE s AS ({SPOTS}),
r AS (SELECT drawing_id, ROW_NUMBER() OVER (PARTITION BY drawing_id ORDER BY spot_id) AS rn,
  {{'spot_id': spot_id, 'x': x, 'y': y, 'value': value, 'raw': raw, 'confidence': confidence}} AS r FROM s),
fold AS (SELECT drawing_id, CAST(1 AS BIGINT) AS n, [r] AS kept FROM r WHERE rn = 1
  UNION ALL SELECT drawing_id, n + 1, CASE WHEN j IS NULL THEN list_append(kept, r)
    WHEN r.confidence > kept[j].confidence THEN list_concat(list_append(kept[1:j - 1], r), kept[j + 1:]) ELSE kept END
  FROM (SELECT f.drawing_id, f.n, f.kept, r.r, list_position(list_transform(f.kept, lambda k:
      SQRT((k.x - r.r.x) * (k.x - r.r.x) + (k.y - r.r.y) * (k.y - r.r.y)) <= 40
      AND (k.raw = r.r.raw OR ABS(k.value - r.r.value) < 0.011e0)), TRUE) AS j
    FROM fold f JOIN r ON r.drawing_id = f.drawing_id AND r.rn = f.n + 1) step),
last AS (SELECT drawing_id, arg_max(kept, n) AS kept FROM fold GROUP BY 1),
k AS (SELECT drawing_id, unnest(kept) AS k FROM last)
SELECT drawing_id, k.spot_id AS spot_id, k.x AS x, k.y AS y, k.value AS value FROM k
"""


@query("dedupe_spots_greedy", FOLDED)
def dedupe_spots_greedy(s: Source) -> DataFrame:
    kept = surveys.dedupe_spots(s.sql(SPOTS).drop("whole", "cents", "include"), mode="greedy")
    return kept.select("drawing_id", "spot_id", "x", "y", "value")


@query("number_points", f"""
WITH s AS ({SPOTS}) SELECT drawing_id, spot_id,
  CAST(99 + ROW_NUMBER() OVER (PARTITION BY drawing_id ORDER BY spot_id) AS BIGINT) AS number
FROM s WHERE include
""")
def number_points(s: Source) -> DataFrame:
    chosen = s.sql(SPOTS).where(X.spot_selected("include", "value"))
    return surveys.number_points(chosen, 100).select("drawing_id", "spot_id", "number")


scalar("spot_selected", SPOTS, ["drawing_id", "spot_id"],
       lambda: {"chosen": X.spot_selected(
           "include", F.when(F.col("cents") != 7, F.col("value")))},
       {"chosen": "(include AND cents <> 7)"})

scalar("ranged_elevation", SPOTS, ["drawing_id", "spot_id"],
       lambda: {f: X.ranged_elevation(
           "value", F.col("whole") % 3 == 0, 1 + F.col("whole") % 2, 110.0, 140.0)[f]
           for f in ("value", "status", "include", "confidence")},
       {"value": "CASE WHEN value BETWEEN 110 AND 140 THEN value END",
        "status": "CASE WHEN value BETWEEN 110 AND 140 AND whole % 3 = 0 AND whole % 2 = 0 THEN 'OK' ELSE 'REVIEW' END",
        "include": "(value BETWEEN 110 AND 140 AND whole % 3 = 0 AND whole % 2 = 0)",
        "confidence": "CASE WHEN value BETWEEN 110 AND 140 AND whole % 3 = 0 AND whole % 2 = 0 THEN 0.95e0 "
                      "WHEN value BETWEEN 110 AND 140 THEN 0.58e0 ELSE 0.25e0 END"})

scalar("metres_per_pixel", SPOTS, ["drawing_id", "spot_id"],
       lambda: {"k": F.round(D.metres_per_pixel(F.col("whole") * 10 - 1100, F.lit(300)), 9)},
       {"k": "CASE WHEN whole * 10 - 1100 > 0 THEN "
             + rounded("(25.4e0 * (whole * 10 - 1100)) / (300 * 1000)", 9) + " END"})

scalar("to_world", SPOTS, ["drawing_id", "spot_id"],
       lambda: {"e": F.round(world()["x"], 6), "n": F.round(world()["y"], 6), "z": world()["z"]},
       {"e": rounded("500000e0 + x * (25.4e0 * 1500 / (300 * 1000))"),
        "n": rounded("4800000e0 + (190 - y) * (25.4e0 * 1500 / (300 * 1000))"), "z": "value"})


def world() -> F.Column:
    return D.to_world("x", "y", "value", 190, 1500, 300, 500000.0, 4800000.0)


# Labels with one or two numbers, a comma as the decimal mark now and then.
LABELS = """
SELECT drawing_id, x, y, whole, cents, confidence, CONCAT('EL ', CAST(whole AS STRING),
    CASE WHEN cents % 2 = 0 THEN ',' ELSE '.' END, LPAD(CAST(cents AS STRING), 2, '0'),
    CASE WHEN whole % 3 = 0 THEN CONCAT(' / ', CAST(whole + 1 AS STRING), '.00') ELSE ' m' END,
    CASE WHEN whole % 7 = 0 THEN ' 1234.56 no' ELSE '' END) AS text
FROM b_tokens
"""


@query("parse_elevations", f"""
WITH l AS ({LABELS}), n AS (
  SELECT drawing_id, x, y, whole, cents, confidence, 0 AS k,
    CONCAT(whole, '.', LPAD(CAST(cents AS VARCHAR), 2, '0')) AS raw FROM l
  UNION ALL SELECT drawing_id, x, y, whole, cents, confidence, 1, CONCAT(whole + 1, '.00') FROM l WHERE whole % 3 = 0)
SELECT drawing_id, x, y, whole, cents, confidence, k, raw, CAST(raw AS DOUBLE) AS value,
  (raw LIKE '%.00') AS is_round FROM n
""")
def parse_elevations(s: Source) -> DataFrame:
    keys = ["drawing_id", "x", "y", "whole", "cents", "confidence"]
    return s.sql(LABELS).select(
        *keys, F.posexplode(X.parse_elevations("text")).alias("k", "n")
    ).select(*keys, "k", "n.raw", "n.value", F.col("n.round").alias("is_round"))


@query("spot_candidates", f"""
WITH l AS ({LABELS}), n AS (
  SELECT l.*, 0 AS k, 1 + CASE WHEN whole % 3 = 0 THEN 1 ELSE 0 END AS n, whole + cents / 100e0 AS v FROM l
  UNION ALL SELECT l.*, 1, 2, whole + 1e0 FROM l WHERE whole % 3 = 0)
SELECT drawing_id, x AS tx, y AS ty, whole, cents, k,
  (16 * (drawing_id % 5) + CASE WHEN n > 1 AND whole % 2 = 1 THEN x + 32 * ((k + 0.5e0) / n)
    WHEN whole % 2 = 0 THEN x + 3e0 ELSE x + 16e0 END) / 0.5e0 AS x,
  (8 * (drawing_id % 5) + CASE WHEN n > 1 AND whole % 2 = 1 THEN y
    WHEN whole % 2 = 0 THEN y - 5e0 ELSE y + 4e0 END) / 0.5e0 AS y,
  v AS value, CASE WHEN whole % 2 = 0 AND n = 1 THEN 'OK' ELSE 'REVIEW' END AS status,
  CASE WHEN whole % 2 = 0 AND n = 1 THEN 0.95e0 ELSE 0.58e0 END AS confidence
FROM n
""")
def spot_candidates(s: Source) -> DataFrame:
    c = F.col
    box = F.array(*[G.point(c("x") + dx, c("y") + dy) for dx, dy in ((0, 0), (32, 0), (32, 8), (0, 8))])
    marked = c("whole") % 2 == 0
    tokens = s.sql(LABELS).select(
        "drawing_id", (c("drawing_id") % 5).alias("tile_id"),
        F.struct("x", "y", "whole", "cents").alias("pos"), "text", box.alias("poly"),
        F.when(marked, c("x") + 3.0).alias("mark_x"), F.when(marked, c("y") - 5.0).alias("mark_y"),
        F.when(marked, "dot").alias("mark_type"))
    tiles = tokens.select("drawing_id", "tile_id").distinct().select(
        "*", (c("tile_id") * 16).alias("tile_x"), (c("tile_id") * 8).alias("tile_y"),
        F.lit(0.5).alias("proc_scale"))
    found = surveys.spot_candidates(tokens, tiles)
    return found.select(
        "drawing_id", c("pos.x").alias("tx"), c("pos.y").alias("ty"), "pos.whole", "pos.cents", "k",
        "x", "y", "value", "status", "confidence")


@query("ocr_tiles", """
WITH RECURSIVE pages_ AS (SELECT doc_id AS page_id, 1 + n_chars % 4000 AS width, 1 + (n_chars * 7) % 3000 AS height FROM documents),
xs AS (SELECT page_id, width, height, 0 AS x FROM pages_ UNION ALL
  SELECT page_id, width, height, x + 680 FROM xs WHERE x + 800 < width),
ys AS (SELECT page_id, x, width, height, 0 AS y FROM xs UNION ALL
  SELECT page_id, x, width, height, y + 480 FROM ys WHERE y + 600 < height)
SELECT page_id, x, y, CAST(LEAST(800, width - x) AS INT) AS w, CAST(LEAST(600, height - y) AS INT) AS h FROM ys
""")
def ocr_tiles(s: Source) -> DataFrame:
    pages = s.sql("SELECT doc_id AS page_id, 1 + n_chars % 4000 AS width, "
                  "1 + (n_chars * 7) % 3000 AS height FROM documents")
    return surveys.ocr_tiles(pages, 120)


def contours(s: Source) -> DataFrame:
    return s.view("b_contours").select(
        "drawing_id", "contour_id", "layer",
        F.array(G.point("x1", "y1"), G.point("x2", "y2"), G.point("x3", "y3")).alias("points"),
        F.lit(None).cast("double").alias("elevation"), F.lit(False).alias("closed"))


def cuts(s: Source) -> DataFrame:
    return s.view("b_contours").select("drawing_id").distinct().select(
        "drawing_id", F.col("drawing_id").alias("cut_id"), F.lit(0.0).alias("cut_x1"),
        F.lit(32.0).alias("cut_y1"), F.lit(128.0).alias("cut_x2"), F.lit(32.0).alias("cut_y2"))


# The first leg runs from y = 0 to 64 and meets the cut halfway; the second
# leg lies at or above y = 64, so it never does.
HITS_SQL = """
hits AS (SELECT drawing_id, contour_id, ((x1 + x2) / 2) / 128e0 AS t FROM b_contours
  WHERE layer LIKE 'CONTOUR%' AND (x1 + x2) / 2 BETWEEN 0 AND 128)
"""


@query("cut_line_hits", f"WITH {HITS_SQL} SELECT drawing_id AS cut_id, contour_id, ROUND(t, 9) AS t FROM hits")
def cut_line_hits(s: Source) -> DataFrame:
    return surveys.cut_line_hits(contours(s), cuts(s)).select(
        "cut_id", "contour_id", F.round("t", 9).alias("t"))


@query("label_contours", f"""
WITH {HITS_SQL}, numbered AS (SELECT contour_id,
  100 + (ROW_NUMBER() OVER (PARTITION BY drawing_id ORDER BY t, contour_id) - 1) * 0.5e0 AS elevation FROM hits)
SELECT c.drawing_id, c.contour_id, c.layer, n.elevation
FROM b_contours c LEFT JOIN numbered n ON n.contour_id = c.contour_id
""")
def label_contours(s: Source) -> DataFrame:
    return surveys.label_contours(contours(s), cuts(s), 100.0, 0.5).select(
        "drawing_id", "contour_id", "layer", "elevation")


@query("centroid", f"""
SELECT contour_id, {rounded("(x1 + x2 + x3) / 3", 9)} AS cx, {rounded("(y1 + y2 + y3) / 3", 9)} AS cy FROM b_contours
""")
def centroid(s: Source) -> DataFrame:
    c = G.centroid("points")
    return contours(s).select("contour_id", F.round(c["x"], 9).alias("cx"), F.round(c["y"], 9).alias("cy"))


@query("near_duplicate_lines", """
WITH c AS (SELECT drawing_id, contour_id, layer, (x1 + x2 + x3) / 3 AS x, (y1 + y2 + y3) / 3 AS y FROM b_contours),
fresh AS (SELECT * FROM c WHERE contour_id % 3 <> 0),
others AS (SELECT drawing_id, contour_id AS o, x, y FROM fresh UNION ALL
  SELECT drawing_id, -1, x, y FROM c WHERE contour_id % 3 = 0 AND layer LIKE 'CONTOUR%')
SELECT drawing_id, contour_id FROM fresh p WHERE NOT EXISTS (SELECT 1 FROM others q
  WHERE q.drawing_id = p.drawing_id AND q.o < p.contour_id
    AND SQRT((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) < 20)
""")
def near_duplicate_lines(s: Source) -> DataFrame:
    lines = contours(s)
    fresh = lines.where("contour_id % 3 <> 0")
    old = lines.where("contour_id % 3 = 0")
    return surveys.near_duplicate_lines(fresh, old).select("drawing_id", "contour_id")


# A radius at which lines stay and lines go; sums of the centres differ by less than the distance of any pair to it.
@query("near_duplicate_lines_close", """
WITH c AS (SELECT drawing_id, contour_id, layer, (x1 + x2 + x3) / 3 AS x, (y1 + y2 + y3) / 3 AS y FROM b_contours),
fresh AS (SELECT * FROM c WHERE contour_id % 3 <> 0),
others AS (SELECT drawing_id, contour_id AS o, x, y FROM fresh UNION ALL
  SELECT drawing_id, -1, x, y FROM c WHERE contour_id % 3 = 0 AND layer LIKE 'CONTOUR%')
SELECT drawing_id, contour_id FROM fresh p WHERE NOT EXISTS (SELECT 1 FROM others q
  WHERE q.drawing_id = p.drawing_id AND q.o < p.contour_id
    AND SQRT((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) < 0.3)
""")
def near_duplicate_lines_close(s: Source) -> DataFrame:
    lines = contours(s)
    found = surveys.near_duplicate_lines(lines.where("contour_id % 3 <> 0"), lines.where("contour_id % 3 = 0"), 0.3)
    return found.select("drawing_id", "contour_id")


@query("simplify_line", """
SELECT contour_id, CAST(CASE WHEN (x3 = x1 AND y3 = y1)
  OR ABS((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1))
    / SQRT((x3 - x1) * (x3 - x1) + (y3 - y1) * (y3 - y1)) > 1.25e0 THEN 3 ELSE 2 END AS INT) AS points FROM b_contours
""")
def simplify_line(s: Source) -> DataFrame:
    return surveys.simplify_line(contours(s).select("contour_id", "points"), 1.25).select(
        "contour_id", F.size("points").alias("points"))
