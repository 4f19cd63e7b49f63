"""Queries over the geometric predicates and ring rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geometry as G
from sitesift.operators import rings
from sitesift.plans.bindings import Source
from sitesift.plans.registry import query, scalar
from sitesift.plans.site_queries import features

SITES = """SELECT site_id, CASE WHEN site_id % 11 = 0 THEN NULL WHEN site_id % 13 = 0 THEN 91e0
  ELSE lat END AS lat, CASE WHEN site_id % 17 = 0 THEN -180.5e0 ELSE lng END AS lng FROM b_sites"""

scalar("valid_location", SITES, ["site_id"],
       lambda: {"ok": G.valid_location("lat", "lng")},
       {"ok": "COALESCE(ABS(lat) <= 90 AND ABS(lng) <= 180, FALSE)"})

BOXES = """SELECT f.feature_seq, f.west, CASE WHEN f.feature_seq % 9 = 0 THEN -86e0 ELSE f.south END AS south,
  CASE WHEN f.feature_seq % 10 = 0 THEN f.west ELSE f.east END AS east, f.north,
  (f.feature_seq % 4 = 0) AS no_box, s.site_id, s.lng, s.lat,
  s.lng - 0.75e0 AS vw, s.lat - 0.75e0 AS vs, s.lng + 0.75e0 AS ve, s.lat + 0.75e0 AS vn
  FROM b_features f JOIN b_sites s ON s.site_id = f.feature_seq"""


def box() -> F.Column:
    return F.when(~F.col("no_box"), G.bounds("west", "south", "east", "north"))


scalar("valid_bounds", BOXES, ["feature_seq"],
       lambda: {"ok": G.valid_bounds(G.bounds("west", "south", "east", "north")),
                "holds_site": G.valid_bounds(
                    G.bounds("west", "south", "east", "north"), "lat", "lng")},
       {"ok": "(north > south AND east > west AND south >= -85 AND north <= 85)",
        "holds_site": "(north > south AND east > west AND south >= -85 AND north <= 85 AND "
                      "lat BETWEEN south AND north AND lng BETWEEN west AND east)"})

scalar("bbox_intersects", BOXES, ["feature_seq"],
       lambda: {"meets": G.bbox_intersects(box(), G.bounds("vw", "vs", "ve", "vn"))},
       {"meets": "(no_box OR (west <= ve AND east >= vw AND south <= vn AND north >= vs))"})

scalar("bbox_contains", BOXES, ["feature_seq"],
       lambda: {
           "holds": G.bbox_contains(box(), G.bounds("lng", "lat", "lng", "lat")),
           "strict": G.bbox_contains(box(), G.bounds("lng", "lat", "lng", "lat"), null_ok=False)},
       {"holds": "(no_box OR (west <= lng AND east >= lng AND south <= lat AND north >= lat))",
        "strict": "(NOT no_box AND west <= lng AND east >= lng AND south <= lat AND north >= lat)"})

EDGES = """SELECT e.feature_seq, e.ring_no, e.edge_no, e.x1, e.y1, e.x2, e.y2,
  f.west + ((f.feature_seq * 7) % 32) / 32e0 AS px, f.south + ((f.feature_seq * 5) % 24) / 32e0 AS py,
  f.west + ((f.feature_seq * 3) % 16) / 16e0 AS qx, f.north - ((f.feature_seq * 11) % 16) / 32e0 AS qy
  FROM b_edges e JOIN b_features f ON f.feature_seq = e.feature_seq"""

LENGTH = "SQRT((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"


def on_sql(x: str, y: str, ax: str, ay: str, bx: str, by: str) -> str:
    length = f"SQRT(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    return (f"(ABS(({x} - {ax}) * ({by} - {ay}) - ({y} - {ay}) * ({bx} - {ax})) <= 1e-10 * {length} "
            f"AND {x} BETWEEN LEAST({ax}, {bx}) - 1e-10 AND GREATEST({ax}, {bx}) + 1e-10 "
            f"AND {y} BETWEEN LEAST({ay}, {by}) - 1e-10 AND GREATEST({ay}, {by}) + 1e-10)")


def turn_sql(ax, ay, bx, by, cx, cy) -> str:
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def cross_sql(a: tuple, b: tuple, c: tuple, d: tuple) -> str:
    touch = " OR ".join([on_sql(*a, *c, *d), on_sql(*b, *c, *d), on_sql(*c, *a, *b), on_sql(*d, *a, *b)])
    return (f"({touch} OR ({turn_sql(*a, *b, *c)} * {turn_sql(*a, *b, *d)} < 0 "
            f"AND {turn_sql(*c, *d, *a)} * {turn_sql(*c, *d, *b)} < 0))")


EDGE_KEYS = ["feature_seq", "ring_no", "edge_no"]

scalar("on_segment", EDGES, EDGE_KEYS,
       lambda: {"touches": G.on_segment("px", "py", "x1", "y1", "x2", "y2")},
       {"touches": on_sql("px", "py", "x1", "y1", "x2", "y2")})

scalar("segments_cross", EDGES, EDGE_KEYS,
       lambda: {"crossed": G.segments_cross("x1", "y1", "x2", "y2", "px", "py", "qx", "qy")},
       {"crossed": cross_sql(("x1", "y1"), ("x2", "y2"), ("px", "py"), ("qx", "qy"))})

SLAB = "CASE WHEN {b} > {a} THEN ({lo} - {a}) / ({b} - {a}) WHEN {b} < {a} THEN ({hi} - {a}) / ({b} - {a}) ELSE {e} END"
scalar("segment_meets_box", EDGES, EDGE_KEYS,
       lambda: {"meets": G.segment_meets_box(
           "x1", "y1", "x2", "y2",
           G.bounds(F.col("px") - 0.25, F.col("py") - 0.25, F.col("px") + 0.25, F.col("py") + 0.25))},
       {"meets": "((x1 <> x2 OR x1 BETWEEN px - 0.25e0 AND px + 0.25e0) AND "
                 "(y1 <> y2 OR y1 BETWEEN py - 0.25e0 AND py + 0.25e0) AND GREATEST(0e0, "
                 + SLAB.format(a="x1", b="x2", lo="px - 0.25e0", hi="px + 0.25e0", e="0e0") + ", "
                 + SLAB.format(a="y1", b="y2", lo="py - 0.25e0", hi="py + 0.25e0", e="0e0")
                 + ") <= LEAST(1e0, "
                 + SLAB.format(a="x1", b="x2", lo="px + 0.25e0", hi="px - 0.25e0", e="1e0") + ", "
                 + SLAB.format(a="y1", b="y2", lo="py + 0.25e0", hi="py - 0.25e0", e="1e0") + "))"})


def ring_point(f: DataFrame) -> tuple[F.Column, F.Column]:
    seq = F.col("feature_seq")
    return (F.col("west") + ((seq * 7) % 32) / 32.0, F.col("south") + ((seq * 5) % 24) / 32.0)


@query("point_in_ring", f"""
WITH i AS ({EDGES}), t AS (
  SELECT feature_seq, SUM(CASE WHEN (y2 > py) <> (y1 > py) AND px < (x1 - x2) * (py - y2)
      / CASE WHEN y1 = y2 THEN 1e0 ELSE y1 - y2 END + x2 THEN 1 ELSE 0 END) % 2 AS odd,
    MAX(CASE WHEN {on_sql("px", "py", "x1", "y1", "x2", "y2")} THEN 1 ELSE 0 END) AS touch
  FROM i WHERE ring_no = 0 GROUP BY 1)
SELECT feature_seq, (odd = 1 OR touch = 1) AS inside FROM t
""")
def point_in_ring(s: Source) -> DataFrame:
    f = features(s)
    return f.select("feature_seq", G.point_in_ring(*ring_point(f), "polygon").alias("inside"))


@query("point_in_convex", """
WITH p AS (SELECT feature_seq, west, south, east, north, west + ((feature_seq * 7) % 32) / 32e0 AS px,
  south + ((feature_seq * 5) % 24) / 32e0 AS py FROM b_features)
SELECT feature_seq, (px >= west AND px <= east AND py >= south AND py <= north
  AND (px - (east - 0.125e0)) + (py - (north - 0.125e0)) <= 0.125e0) AS inside FROM p
""")
def point_in_convex(s: Source) -> DataFrame:
    f = features(s)
    corners = F.slice("polygon", 1, 5)
    return f.select("feature_seq", G.point_in_convex(*ring_point(f), corners).alias("inside"))


@query("close_ring", """
SELECT feature_seq, 6 AS points, TRUE AS closed FROM b_features
""")
def close_ring(s: Source) -> DataFrame:
    given = F.when(F.col("feature_seq") % 2 == 0, F.slice("polygon", 1, 5)).otherwise(F.col("polygon"))
    closed = G.close_ring(given)
    return features(s).select(
        "feature_seq", F.size(closed).alias("points"),
        (F.element_at(closed, 1) == F.element_at(closed, -1)).alias("closed"))


# Every third ring swaps two vertices, so that it crosses itself.
def twisted(s: Source) -> DataFrame:
    p = F.col("polygon")
    swapped = F.array(p[0], p[2], p[1], p[3], p[4], p[5])
    return features(s).select(
        F.col("feature_seq").alias("ring_id"),
        F.when(F.col("feature_seq") % 3 == 0, swapped).otherwise(p).alias("ring"))


TWISTED_SQL = """
v AS (
  SELECT feature_seq AS ring_id, 1 AS k, west AS x, south AS y FROM b_features UNION ALL
  SELECT feature_seq, CASE WHEN feature_seq % 3 = 0 THEN 3 ELSE 2 END, east, south FROM b_features UNION ALL
  SELECT feature_seq, CASE WHEN feature_seq % 3 = 0 THEN 2 ELSE 3 END, east, north - 0.125e0 FROM b_features UNION ALL
  SELECT feature_seq, 4, east - 0.125e0, north FROM b_features UNION ALL
  SELECT feature_seq, 5, west, north FROM b_features UNION ALL
  SELECT feature_seq, 6, west, south FROM b_features),
seg AS (SELECT a.ring_id, a.k AS edge_no, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM v a JOIN v b ON b.ring_id = a.ring_id AND b.k = a.k + 1),
crossing AS (SELECT l.ring_id, l.edge_no AS i, r.edge_no AS j FROM seg l JOIN seg r
  ON r.ring_id = l.ring_id AND l.edge_no + 1 < r.edge_no AND NOT (l.edge_no = 1 AND r.edge_no = 5)
  WHERE """ + cross_sql(("l.x1", "l.y1"), ("l.x2", "l.y2"), ("r.x1", "r.y1"), ("r.x2", "r.y2")) + ")"


@query("self_intersections", f"WITH {TWISTED_SQL} SELECT ring_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM crossing")
def self_intersections(s: Source) -> DataFrame:
    return rings.crossings(twisted(s))


@query("validate_rings", f"""
WITH {TWISTED_SQL}, bad AS (SELECT DISTINCT ring_id FROM crossing)
SELECT f.feature_seq AS ring_id, CASE WHEN bad.ring_id IS NULL THEN '' ELSE 'self-intersection' END
  || CASE WHEN f.feature_seq % 5 = 0 THEN (CASE WHEN bad.ring_id IS NULL THEN '' ELSE ',' END) || 'not-closed' ELSE '' END AS violations
FROM b_features f LEFT JOIN bad ON bad.ring_id = f.feature_seq
""")
def validate_rings(s: Source) -> DataFrame:
    # Every fifth ring ends on a far vertex, whose edge crosses nothing new.
    p = F.col("ring")
    given = twisted(s).withColumn("ring", F.when(
        F.col("ring_id") % 5 == 0, F.concat(
            F.slice(p, 1, 5), F.array(G.point(p[0]["x"], p[0]["y"] + 0.03125)))).otherwise(p))
    checked = rings.validate_rings(given)
    return checked.select("ring_id", F.array_join(F.reverse(F.array_sort("violations")), ",").alias("violations"))


# Rings of six orders of size and six of flatness: width w = 2^-(4 size), height w / 2^thin; every seventh crosses itself.
SIZED = """SELECT feature_seq AS ring_id, feature_seq % 6 AS size, feature_seq % 7 = 3 AS crossed, west,
  CAST(POWER(2e0, -4 * (feature_seq % 6)) AS DOUBLE) AS w,
  CAST(POWER(2e0, -4 * (feature_seq % 6) - CASE feature_seq % 5 WHEN 0 THEN 44 WHEN 1 THEN 43 WHEN 2 THEN 41 WHEN 3 THEN 20 ELSE 0 END) AS DOUBLE) AS h FROM b_features"""


def sized(s: Source) -> DataFrame:
    """Steps on both long sides, so that the area is a sum of many terms; crossed ones swap the far corners."""
    west, w, h = F.col("west"), F.col("w"), F.col("h")
    east = F.when(F.col("crossed"), F.array(G.point(west + w, h), G.point(west + w, F.lit(0.0)))).otherwise(
        F.array(G.point(west + w, F.lit(0.0)), G.point(west + w, h)))
    along = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: G.point(west + w * k / 8, F.when(k % 2 == 1, F.lit(0.0)).otherwise(h / 4)))
    ring = F.concat(F.array(G.point(west, F.lit(0.0))), along, east, F.array(G.point(west, h), G.point(west, F.lit(0.0))))
    return s.sql(SIZED).select("ring_id", "crossed", ring.alias("ring"))


@query("compensated_area", f"SELECT ring_id, w * h * (1 - 3e0 / 32) AS area FROM ({SIZED}) r WHERE NOT crossed")
def compensated_area(s: Source) -> DataFrame:
    return sized(s).where("NOT crossed").select("ring_id", G.compensated_area("ring").alias("area"))


def lies_sql(p: str, a: str, b: str) -> str:
    return (f"({p}x BETWEEN LEAST({a}x, {b}x) AND GREATEST({a}x, {b}x) AND {p}y BETWEEN LEAST({a}y, {b}y) AND GREATEST({a}y, {b}y) "
            f"AND ABS({turn_sql(a, b, p)}) < 1e-14)")


def turn_sql(a: str, b: str, c: str) -> str:
    return f"(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


MEET_SQL = " OR ".join([
    lies_sql("l.a", "r.a", "r.b"), lies_sql("l.b", "r.a", "r.b"), lies_sql("r.a", "l.a", "l.b"), lies_sql("r.b", "l.a", "l.b"),
    f"({turn_sql('l.a', 'l.b', 'r.a')} * {turn_sql('l.a', 'l.b', 'r.b')} < 0 AND {turn_sql('r.a', 'r.b', 'l.a')} * {turn_sql('r.a', 'r.b', 'l.b')} < 0)"])


# A crossed ring winds both ways, so its area is about half, and the area limit meets it one step earlier.
@query("validate_projected_rings", f"""
WITH r AS ({SIZED}), v AS (
  SELECT ring_id, 1 AS k, west AS x, 0e0 AS y FROM r UNION ALL SELECT ring_id, 12, west, 0e0 FROM r UNION ALL SELECT ring_id, 11, west, h FROM r
  UNION ALL SELECT ring_id, k + 1, west + w * k / 8, CASE WHEN k % 2 = 1 THEN 0e0 ELSE h / 4 END FROM r, (VALUES (1), (2), (3), (4), (5), (6), (7)) t(k)
  UNION ALL SELECT ring_id, 9, west + w, CASE WHEN crossed THEN h ELSE 0e0 END FROM r UNION ALL SELECT ring_id, 10, west + w, CASE WHEN crossed THEN 0e0 ELSE h END FROM r),
s AS (SELECT a.ring_id, a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM v a JOIN v b ON b.ring_id = a.ring_id AND b.k = a.k + 1),
c AS (SELECT DISTINCT l.ring_id FROM s l JOIN s r ON r.ring_id = l.ring_id AND l.k + 1 < r.k AND NOT (l.k = 1 AND r.k = 11) WHERE {MEET_SQL})
SELECT r.ring_id, concat_ws(',', CASE WHEN west + w >= -72 THEN 'coordinates' END, CASE WHEN h / w <= POWER(2e0, CASE WHEN crossed THEN -41 ELSE -42 END) THEN 'flat' END,
  CASE WHEN c.ring_id IS NOT NULL THEN 'self-intersection' END) AS violations FROM r LEFT JOIN c ON c.ring_id = r.ring_id
""")
def validate_projected_rings(s: Source) -> DataFrame:
    return rings.validate_projected_rings(sized(s)).select("ring_id", F.array_join("violations", ",").alias("violations"))
