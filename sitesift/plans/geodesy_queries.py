"""Queries over projections, sheets, placements and world files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geodesy as D
from sitesift.functions import geometry as G
from sitesift.operators import sheets
from sitesift.plans.bindings import Source
from sitesift.plans.registry import query, rounded, scalar
from sitesift.plans.site_queries import features


def num(value: float) -> str:
    """A double literal that no engine reads as a decimal."""
    text = repr(float(value))
    return text if "e" in text else text + "e0"


R, GR, DEG = num(D.MERCATOR_RADIUS), num(D.GROUND_RADIUS), num(D.DEG)


def my(lat: str) -> str:
    return f"({R} * LN(TAN(({lat}) * {num(D.DEG / 2)} + {num(math.pi / 4)})))"


def mx(lng: str) -> str:
    return f"({R} * ({lng}) * {DEG})"


def ilat(y: str) -> str:
    return f"((ATAN(EXP(({y}) / {R})) * 2 - {num(math.pi / 2)}) / {DEG})"


def ilng(x: str) -> str:
    return f"(({x}) / {R} / {DEG})"


SITES = "SELECT site_id, lng, lat, requested_year FROM b_sites"
KEY = ["site_id"]
r6 = lambda c: F.round(c, 6)
r9 = lambda c: F.round(c, 9)

scalar("web_mercator", SITES, KEY,
       lambda: {"x": r6(D.web_mercator("lng", "lat")["x"]), "y": r6(D.web_mercator("lng", "lat")["y"])},
       {"x": rounded(mx("lng")), "y": rounded(my("lat"))})

scalar("inv_web_mercator", "SELECT site_id, lng * 111000e0 AS x, lat * 131000e0 AS y FROM b_sites", KEY,
       lambda: {"lng": r9(D.inv_web_mercator("x", "y")["x"]), "lat": r9(D.inv_web_mercator("x", "y")["y"])},
       {"lng": rounded(ilng("x"), 9), "lat": rounded(ilat("y"), 9)})

scalar("utm_zone", """SELECT site_id, lng + 0.03125e0 - CASE WHEN site_id % 50 = 0 THEN 4e0 ELSE 0e0 END AS lng,
  CASE WHEN site_id % 23 = 0 THEN -lat WHEN site_id % 29 = 0 THEN lat + 42 ELSE lat END AS lat FROM b_sites""", KEY,
       lambda: {f: D.utm_zone("lng", "lat")[f] for f in ("zone", "epsg", "error")},
       {"zone": "CASE WHEN lat >= 0 AND lat <= 84 AND lng NOT IN (-96, -90, -84, -78, -72) AND lng BETWEEN -96 AND -72 "
                "THEN CAST(FLOOR((lng + 180) / 6) + 1 AS INT) END",
        "epsg": "CASE WHEN lat >= 0 AND lat <= 84 AND lng NOT IN (-96, -90, -84, -78, -72) AND lng BETWEEN -96 AND -72 "
                "THEN 'EPSG:269' || CAST(CAST(FLOOR((lng + 180) / 6) + 1 AS INT) AS VARCHAR) END",
        "error": "CASE WHEN lat < 0 THEN 'southern-hemisphere' WHEN lat > 84 THEN 'latitude-range' "
                 "WHEN lng IN (-96, -90, -84, -78, -72) THEN 'zone-boundary' "
                 "WHEN lng NOT BETWEEN -96 AND -72 THEN 'unsupported-zone' END"})


def utm_sql(source: str, keys: str) -> str:
    """SQL giving e and n of (lng, lat, zone) rows, step by step."""
    east = " + ".join(["eta"] + [
        f"{num(a)} * COS({2 * j} * xi) * SINH({2 * j} * eta)" for j, a in enumerate(D.KRUEGER_ALPHA, 1)])
    north = " + ".join(["xi"] + [
        f"{num(a)} * SIN({2 * j} * xi) * COSH({2 * j} * eta)" for j, a in enumerate(D.KRUEGER_ALPHA, 1)])
    k = num(D.UTM_SCALE * D.KRUEGER_RADIUS)
    e = num(D.GRS80_E)
    return f"""
    u0 AS ({source}),
    u1 AS (SELECT *, SINH(ATANH(SIN(lat * {DEG})) - {e} * ATANH({e} * SIN(lat * {DEG}))) AS t,
      (lng - (zone * 6 - 183)) * {DEG} AS dl FROM u0),
    u2 AS (SELECT *, ATAN2(t, COS(dl)) AS xi, ATANH(SIN(dl) / SQRT(1 + t * t)) AS eta FROM u1),
    utm AS (SELECT {keys}, 500000 + {k} * ({east}) AS e, {k} * ({north}) AS n FROM u2)"""


ZONED = "SELECT site_id, lng, lat, CAST(FLOOR((lng + 180) / 6) + 1 AS INT) AS zone FROM b_sites"


@query("to_utm", f"WITH {utm_sql(ZONED, 'site_id')} SELECT site_id, ROUND(e, 4) AS e, ROUND(n, 4) AS n FROM utm")
def to_utm(s: Source) -> DataFrame:
    u = D.to_utm("lng", "lat", "zone")
    return s.sql(ZONED).select("site_id", F.round(u["e"], 4).alias("e"), F.round(u["n"], 4).alias("n"))


VERTICES = """
SELECT feature_seq, k, x AS lng, y AS lat, CAST(FLOOR((west + 180) / 6) + 1 AS INT) AS zone FROM (
  SELECT feature_seq, west, 0 AS k, west AS x, south AS y FROM b_features UNION ALL
  SELECT feature_seq, west, 1, east, south FROM b_features UNION ALL
  SELECT feature_seq, west, 2, east, north - 0.125e0 FROM b_features UNION ALL
  SELECT feature_seq, west, 3, east - 0.125e0, north FROM b_features UNION ALL
  SELECT feature_seq, west, 4, west, north FROM b_features UNION ALL
  SELECT feature_seq, west, 5, west, south FROM b_features) v
"""


@query("project_ring", f"""WITH {utm_sql(VERTICES, 'feature_seq, k')}
SELECT feature_seq, k, ROUND(e, 4) AS e, ROUND(n, 4) AS n FROM utm""")
def project_ring(s: Source) -> DataFrame:
    zone = (F.floor((F.col("west") + 180) / 6) + 1).cast("int")
    return features(s).select(
        "feature_seq", F.posexplode(D.project_ring("polygon", zone)).alias("k", "p")
    ).select("feature_seq", "k", F.round("p.x", 4).alias("e"), F.round("p.y", 4).alias("n"))


GRID = """SELECT site_id, 250000e0 + (site_id * 7919) % 500000 AS e, 4500000e0 + (site_id * 104729) % 2000000 AS n,
  CAST(15 + site_id % 4 AS INT) AS zone FROM b_sites"""


def from_utm_sql() -> str:
    scale = num(D.UTM_SCALE * D.KRUEGER_RADIUS)
    across = " ".join(f"- COS({2 * j} * xi) * SINH({2 * j} * eta) * {num(b)}" for j, b in enumerate(D.KRUEGER_BETA, start=1))
    along = " ".join(f"- SIN({2 * j} * xi) * COSH({2 * j} * eta) * {num(b)}" for j, b in enumerate(D.KRUEGER_BETA, start=1))
    lat = " ".join(f"+ SIN({2 * j} * chi) * {num(d)}" for j, d in enumerate(D.KRUEGER_DELTA, start=1))
    return f"""
WITH g AS (SELECT site_id, zone, (e - 500000) / {scale} AS eta, n / {scale} AS xi FROM ({GRID}) x),
s AS (SELECT site_id, zone, eta {across} AS a, xi {along} AS l FROM g),
c AS (SELECT site_id, zone, ATAN2(SINH(a), COS(l)) / {DEG} + (zone * 6 - 183) AS lng, ASIN(SIN(l) / COSH(a)) AS chi FROM s),
o AS (SELECT site_id, zone, lng, (chi {lat}) / {DEG} AS lat FROM c)
SELECT site_id, CASE WHEN lng BETWEEN zone * 6 - 186 - 1e-8 AND zone * 6 - 180 + 1e-8 THEN ROUND(lng, 9) END AS lng,
  CASE WHEN lng BETWEEN zone * 6 - 186 - 1e-8 AND zone * 6 - 180 + 1e-8 THEN ROUND(lat, 9) END AS lat FROM o"""


@query("from_utm", from_utm_sql())
def from_utm(s: Source) -> DataFrame:
    g = D.from_utm("e", "n", "zone")
    return s.sql(GRID).select("site_id", r9(g["lng"]).alias("lng"), r9(g["lat"]).alias("lat"))


# -- figures and sheets -----------------------------------------------------

SPANS = """SELECT site_id, lng, lat, CAST(500 + (site_id * 37) % 20000 AS DOUBLE) AS extent FROM b_sites"""
DLAT = f"(extent / 2 / {GR} * 180 / {num(math.pi)})"
DLNG = f"({DLAT} / COS(lat * {DEG}))"

scalar("figure_bounds", SPANS, KEY,
       lambda: {k: r9(D.figure_bounds("lat", "lng", "extent")[k]) for k in ("west", "south", "east", "north")},
       {"west": rounded(f"lng - {DLNG}", 9), "south": rounded(f"lat - {DLAT}", 9),
        "east": rounded(f"lng + {DLNG}", 9), "north": rounded(f"lat + {DLAT}", 9)})

BOXES = """SELECT site_id, lng, lat, lng - 0.0625e0 - (site_id % 7) / 64e0 AS w, lat - 0.0625e0 AS s,
  lng + 0.0625e0 + (site_id % 5) / 64e0 AS e, lat + 0.0625e0 + (site_id % 11) / 64e0 AS n FROM b_sites"""
GWIDTH = f"({GR} * (e - w) * {DEG} * COS({ilat(f'({my('s')} + {my('n')}) / 2')} * {DEG}))"


def box() -> F.Column:
    return G.bounds("w", "s", "e", "n")


scalar("ground_size", BOXES, KEY,
       lambda: {"width": r6(D.ground_width(box())), "height": r6(D.ground_height(box()))},
       {"width": rounded(GWIDTH), "height": rounded(f"{GR} * (n - s) * {DEG}")})

ASPECT = num(D.SHEET_WIDTH_MM / D.SHEET_HEIGHT_MM)
SHEET_SQL = f"""
b AS ({BOXES}),
m AS (SELECT *, {mx('w')} AS x0, {mx('e')} AS x1, {my('s')} AS y0, {my('n')} AS y1 FROM b),
g AS (SELECT *, GREATEST(y1 - y0, (x1 - x0) / {ASPECT}) AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM m),
sheet AS (SELECT site_id, lng, lat, cx - h * {ASPECT} / 2 AS pw, cy - h / 2 AS ps, cx + h * {ASPECT} / 2 AS pe,
  cy + h / 2 AS pn, CAST(FLOOR(332.4e0 / 25.4e0 * 150 + 0.5) AS INT) AS raster_width,
  CAST(FLOOR(278.4e0 / 25.4e0 * 150 + 0.5) AS INT) AS raster_height FROM g)
"""


def sheet_rows(s: Source) -> DataFrame:
    return s.sql(BOXES).select(
        F.col("site_id").alias("sheet_id"), "lng", "lat", D.sheet_geometry(box(), 150).alias("sheet"))


@query("sheet_geometry", f"""
WITH {SHEET_SQL} SELECT site_id, {rounded(ilng('pw'), 9)} AS west, {rounded(ilat('ps'), 9)} AS south,
  {rounded(ilng('pe'), 9)} AS east, {rounded(ilat('pn'), 9)} AS north, raster_width, raster_height FROM sheet
""")
def sheet_geometry(s: Source) -> DataFrame:
    b = F.col("sheet.bounds")
    return sheet_rows(s).select(
        F.col("sheet_id").alias("site_id"), *[r9(b[k]).alias(k) for k in ("west", "south", "east", "north")],
        "sheet.raster_width", "sheet.raster_height")


@query("fit_saved_view", f"""
WITH {SHEET_SQL} SELECT site_id, {rounded(ilng('pw'), 9)} AS west, {rounded(ilat('pn'), 9)} AS north,
  CAST(CEIL({GR} * ({ilat('pn')} - {ilat('ps')}) * {DEG}) AS BIGINT) AS extent_m FROM sheet
""")
def fit_saved_view(s: Source) -> DataFrame:
    v = D.fit_saved_view(box(), "lat", "lng")
    return s.sql(BOXES).select(
        "site_id", r9(v["bounds"]["west"]).alias("west"), r9(v["bounds"]["north"]).alias("north"),
        v["extent_m"].alias("extent_m"))


@query("map_pixel", f"""
WITH {SHEET_SQL} SELECT site_id, {rounded(f'({mx('lng')} - pw) / (pe - pw) * raster_width')} AS px,
  {rounded(f'(pn - {my('lat')}) / (pn - ps) * raster_height')} AS py FROM sheet
""")
def map_pixel(s: Source) -> DataFrame:
    p = D.map_pixel("lng", "lat", "sheet")
    return sheet_rows(s).select(
        F.col("sheet_id").alias("site_id"), r6(p["x"]).alias("px"), r6(p["y"]).alias("py"))


@query("metric_scale", f"""
WITH b AS ({BOXES}), w AS (SELECT site_id, {GWIDTH} AS gw FROM b),
p AS (SELECT *, gw * 160 / 1963 AS top, POW(10e0, FLOOR(LOG10(gw * 160 / 1963))) AS pow10 FROM w),
d AS (SELECT *, CASE WHEN 10 * pow10 <= top THEN 10 * pow10 WHEN 5 * pow10 <= top THEN 5 * pow10
  WHEN 2 * pow10 <= top THEN 2 * pow10 WHEN pow10 <= top THEN pow10 ELSE pow10 / 2 END AS m FROM p)
SELECT site_id, m AS distance_m, {rounded('m / gw * 1963')} AS pixel_width,
  CASE WHEN m >= 1000 THEN CAST(CAST(m / 1000 AS BIGINT) AS VARCHAR) || ' km' ELSE CAST(CAST(m AS BIGINT) AS VARCHAR) || ' m' END AS label
FROM d
""")
def metric_scale(s: Source) -> DataFrame:
    m = D.metric_scale(box(), 1963)
    return s.sql(BOXES).select("site_id", m["distance_m"].alias("distance_m"),
                               r6(m["pixel_width"]).alias("pixel_width"), m["label"].alias("label"))


WORLD = num(sheets.WORLD)
HALF = num(sheets.WORLD / 2)
TILE_SQL = f"""
{SHEET_SQL}, zooms AS (SELECT CAST(z AS INT) AS z FROM range(0, 20) t(z)),
c AS (SELECT s.*, z, {WORLD} / POW(2e0, z) AS span FROM sheet s, zooms
  WHERE z <= GREATEST(0, LEAST(19, FLOOR(LOG2({num(sheets.WORLD * sheets.FRAME_PIXELS / 256)} / (pe - pw)))))),
n AS (SELECT *, FLOOR((pw + {HALF}) / span) AS tx0, CEIL((pe + {HALF}) / span) - 1 AS tx1,
  FLOOR(({HALF} - pn) / span) AS ty0, CEIL(({HALF} - ps) / span) - 1 AS ty1 FROM c),
best AS (SELECT site_id, MAX(z) AS zoom FROM n WHERE (tx1 - tx0 + 1) * (ty1 - ty0 + 1) <= 36 GROUP BY 1)
"""


def plan_rows(s: Source) -> DataFrame:
    return sheet_rows(s).select("sheet_id", "sheet.projected", "sheet.raster_width", "sheet.raster_height")


@query("tile_zoom", f"WITH {TILE_SQL} SELECT site_id AS sheet_id, zoom FROM best")
def tile_zoom(s: Source) -> DataFrame:
    return sheets.tile_zoom(plan_rows(s)).select("sheet_id", "zoom")


@query("tile_requests", f"""
WITH {TILE_SQL}, t AS (SELECT n.*, b.zoom FROM n JOIN best b ON b.site_id = n.site_id AND b.zoom = n.z),
xs AS (SELECT *, CAST(unnest(range(CAST(tx0 AS BIGINT), CAST(tx1 AS BIGINT) + 1)) AS BIGINT) AS tx FROM t),
xy AS (SELECT *, CAST(unnest(range(CAST(ty0 AS BIGINT), CAST(ty1 AS BIGINT) + 1)) AS BIGINT) AS ty FROM xs)
SELECT site_id AS sheet_id, 'https://tile.example.org/' || zoom || '/' || tx || '/' || ty || '.png' AS url,
  {rounded(f'(tx * span - {HALF} - pw) / (pe - pw) * raster_width + 13e-5', 3)} AS x,
  {rounded(f'(pn - ({HALF} - ty * span)) / (pn - ps) * raster_height + 13e-5', 3)} AS y FROM xy
""")
def tile_requests(s: Source) -> DataFrame:
    found = sheets.tile_requests(plan_rows(s), "https://tile.example.org/{z}/{x}/{y}.png")
    return found.select("sheet_id", "url", F.round(F.col("x") + 13e-5, 3).alias("x"),
                        F.round(F.col("y") + 13e-5, 3).alias("y"))


@query("export_requests", f"""
WITH {SHEET_SQL}, p AS (SELECT *, CASE WHEN site_id % 2 = 0 THEN 800 ELSE 1024 END AS mw,
  CASE WHEN site_id % 9 = 0 THEN 20 ELSE 700 END AS mh FROM sheet),
k AS (SELECT *, CAST(CEIL(raster_width / mw) AS INT) AS nc, CAST(CEIL(raster_height / mh) AS INT) AS nr FROM p),
c AS (SELECT *, unnest(range(0, nc)) AS c FROM k),
q AS (SELECT *, unnest(range(0, nr)) AS r FROM c),
o AS (SELECT *, c * mw AS x, r * mh AS y, LEAST(mw, raster_width - c * mw) AS w, LEAST(mh, raster_height - r * mh) AS h FROM q)
SELECT site_id AS sheet_id, CAST(r * nc + c AS INT) AS n, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h,
  {rounded('pw + (pe - pw) * x / raster_width', 4)} AS west,
  {rounded('pn - (pn - ps) * (y + h) / raster_height', 4)} AS south,
  'https://maps.example.org/MapServer/export?f=image&bboxSR=3857&imageSR=3857&size='
    || w || '%2C' || h || '&format=png32&transparent=true' AS url,
  CASE WHEN nc * nr > 64 THEN 'too-many-pieces' END AS error FROM o
""")
def export_requests(s: Source) -> DataFrame:
    planned = plan_rows(s).withColumn("export", F.struct(
        F.lit("arcgis-export").alias("kind"), F.lit("https://maps.example.org/MapServer/export").alias("url"),
        F.lit(None).cast("string").alias("layer"),
        F.when(F.col("sheet_id") % 2 == 0, 800).otherwise(1024).alias("max_width"),
        F.when(F.col("sheet_id") % 9 == 0, 20).otherwise(700).alias("max_height")))
    found = sheets.export_requests(planned)
    return found.select(
        "sheet_id", "n", "x", "y", "w", "h", F.round("bounds.west", 4).alias("west"),
        F.round("bounds.south", 4).alias("south"),
        F.regexp_replace("url", "&bbox=[^&]*", "").alias("url"), "error")


@query("map_request", f"""
WITH {SHEET_SQL} SELECT site_id AS sheet_id, CAST(1536 AS INT) AS request_width,
  CAST(FLOOR(1536 * raster_height / raster_width + 0.5) AS INT) AS request_height,
  'https://maps.example.org/wms?SERVICE=WMS&REQUEST=GetMap&VERSION=1.1.1&LAYERS=Topo&STYLES=&SRS=EPSG%3A3857&WIDTH=1536&HEIGHT='
  || CAST(FLOOR(1536 * raster_height / raster_width + 0.5) AS INT) || '&FORMAT=image%2Fpng&TRANSPARENT=FALSE&EXCEPTIONS=application%2Fvnd.ogc.se_xml' AS url FROM sheet
""")
def map_request(s: Source) -> DataFrame:
    found = sheets.map_request(plan_rows(s), "https://maps.example.org/wms", "Topo")
    return found.select("sheet_id", "request_width", "request_height",
                        F.regexp_replace("url", "&BBOX=[^&]*", "").alias("url"))


# North edge that makes the crop's projected aspect exact, or a bit off.
FITTED = f"""SELECT site_id, lng - 0.25e0 AS w, lng + 0.25e0 AS e, lat AS s,
  {ilat(f"{my('lat')} + {mx('0.5e0')} * 297 / 420 * (1 + CASE WHEN site_id % 3 = 0 THEN 0.001e0 ELSE 0e0 END)")} AS n FROM b_sites"""

scalar("crop_aspect_ok", FITTED, KEY, lambda: {"ok": D.crop_aspect_ok(box())},
       {"ok": f"(ABS({mx('e - w')} / ({my('n')} - {my('s')}) / (420 / 297e0) - 1) <= 1e-4)"})

scalar("historical_sheet_geometry", FITTED, KEY,
       lambda: {"west": r6(D.historical_sheet_geometry(box(), 300)["projected"]["west"]),
                "raster_width": D.historical_sheet_geometry(box(), 300)["raster_width"],
                "raster_height": D.historical_sheet_geometry(box(), 300)["raster_height"],
                "error": D.historical_sheet_geometry(box(), 300)["error"]},
       {"west": f"CASE WHEN site_id % 3 <> 0 THEN {rounded(mx('w'))} END",
        "raster_width": "CAST(4677 AS INT)", "raster_height": "CAST(3307 AS INT)",
        "error": "CASE WHEN site_id % 3 = 0 THEN 'crop-aspect' END"})

# -- placements -------------------------------------------------------------

PLACED = f"""SELECT site_id, lng, lat, {mx('lng')} + ((site_id * 13) % 700) - 350e0 AS cx,
  {my('lat')} + ((site_id * 17) % 500) - 250e0 AS cy, 900e0 AS gw, 640e0 AS gh, 1800 AS sw, 1280 AS sh,
  ((site_id * 31) % 720) - 360e0 AS deg FROM b_sites"""
TURN = "(deg + 180 - 360 * FLOOR((deg + 180) / 360) - 180)"
COS_, SIN_ = f"COS({TURN} * {DEG})", f"SIN({TURN} * {DEG})"


def placed() -> F.Column:
    return D.placement("cx", "cy", "gw", "gh", "sw", "sh", "deg")


def corner_sql(sx: int, sy: int) -> tuple[str, str]:
    x, y = f"({sx} * gw / 2)", f"({sy} * gh / 2)"
    return f"(cx + {x} * {COS_} + {y} * {SIN_})", f"(cy - {x} * {SIN_} + {y} * {COS_})"


LX = f"(({mx('lng')} - cx) * {COS_} - ({my('lat')} - cy) * {SIN_})"
LY = f"(({mx('lng')} - cx) * {SIN_} + ({my('lat')} - cy) * {COS_})"

scalar("placement_corners", PLACED, KEY,
       lambda: {**{f"{a}{i}": r6(D.placement_corners(placed())[i][a]) for i in range(4) for a in "xy"}},
       {f"{a}{i}": rounded(corner_sql(*sign)[k]) for i, sign in enumerate(((-1, 1), (1, 1), (1, -1), (-1, -1)))
        for k, a in enumerate("xy")})

scalar("canvas_transform", PLACED, KEY,
       lambda: {n: r6(D.canvas_transform(placed())[i]) for i, n in enumerate("abcdef")},
       {"a": rounded(f"{COS_} * gw / sw"), "b": rounded(f"-{SIN_} * gw / sw"), "c": rounded(f"-{SIN_} * gh / sh"),
        "d": rounded(f"-{COS_} * gh / sh"), "e": rounded(corner_sql(-1, 1)[0]), "f": rounded(corner_sql(-1, 1)[1])})

scalar("normalized_rotation", "SELECT site_id, ((site_id * 31) % 1440) / 2e0 - 360e0 AS deg, (site_id % 7) - 3e0 AS qx, (site_id % 5) - 2e0 AS qy FROM b_sites", KEY,
       lambda: {"turned": r6(D.normalized_rotation("deg")),
                "handle": r6(D.rotation_from_point(0.0, 0.0, "qx", "qy"))},
       {"turned": rounded(TURN),
        "handle": f"CASE WHEN qx <> 0 OR qy <> 0 THEN CASE WHEN qx = 0 AND qy < 0 THEN -180e0 ELSE {rounded(f'ATAN2(qx, qy) / {DEG}')} END END"})

scalar("site_in_placement", PLACED, KEY, lambda: {"inside": D.site_in_placement(placed(), "lat", "lng")},
       {"inside": f"(ABS({LX}) <= gw / 2 + 1e-7 AND ABS({LY}) <= gh / 2 + 1e-7)"})

IN_FRAME = " AND ".join(
    f"(ABS(({x} - cx) * {COS_} - ({y} - cy) * {SIN_}) <= gw / 2 + 1e-6 AND ABS(({x} - cx) * {SIN_} + ({y} - cy) * {COS_}) <= gh / 2 + 1e-6)"
    for x in (mx("lng - 0.001e0"), mx("lng + 0.001e0")) for y in (my("lat - 0.001e0"), my("lat + 0.001e0")))
scalar("crop_in_placement", PLACED, KEY,
       lambda: {"inside": D.crop_in_placement(G.bounds(
           F.col("lng") - 0.001, F.col("lat") - 0.001, F.col("lng") + 0.001, F.col("lat") + 0.001), placed())},
       {"inside": f"({IN_FRAME})"})

UX = [f"({COS_} * {sx} - {SIN_} * {sy} * {num(297 / 420)})" for sx in (-1, 1) for sy in (-1, 1)]
UY = [f"({SIN_} * {sx} + {COS_} * {sy} * {num(297 / 420)})" for sx in (-1, 1) for sy in (-1, 1)]
LIMITS = ", ".join(
    f"CASE WHEN {u} > 0 THEN ({half} - {off}) / {u} WHEN {u} < 0 THEN ({half} + {off}) / -{u} ELSE 1e300 END"
    for us, off, half in ((UX, LX, "gw / 2"), (UY, LY, "gh / 2")) for u in us)


@query("crop_for_placement", f"""
WITH p AS ({PLACED}), l AS (SELECT site_id, lng, lat, LEAST({LIMITS}) AS hw FROM p)
SELECT site_id, CASE WHEN hw >= 0.05e0 THEN {rounded(ilng(f"{mx('lng')} - hw"), 9)} END AS west,
  CASE WHEN hw >= 0.05e0 THEN {rounded(ilat(f"{my('lat')} - hw * 297 / 420"), 9)} END AS south,
  CASE WHEN hw >= 0.05e0 THEN {rounded(ilng(f"{mx('lng')} + hw"), 9)} END AS east,
  CASE WHEN hw >= 0.05e0 THEN {rounded(ilat(f"{my('lat')} + hw * 297 / 420"), 9)} END AS north FROM l
""")
def crop_for_placement(s: Source) -> DataFrame:
    c = D.crop_for_placement(placed(), "lat", "lng")
    return s.sql(PLACED).select("site_id", *[r9(c[k]).alias(k) for k in ("west", "south", "east", "north")])


scalar("placement_from_extent", BOXES, KEY,
       lambda: {k: F.round(D.placement_from_extent(box(), 800, 600, 370.0)[k], 4)
                for k in ("center_x", "center_y", "ground_width", "ground_height", "rotation_degrees")},
       {"center_x": rounded(f"({mx('w')} + {mx('e')}) / 2", 4), "center_y": rounded(f"({my('s')} + {my('n')}) / 2", 4),
        "ground_width": rounded(f"{mx('e')} - {mx('w')}", 4), "ground_height": rounded(f"{my('n')} - {my('s')}", 4),
        "rotation_degrees": "10e0"})

BAR = "(CASE WHEN site_id % 9 = 0 THEN NULL ELSE 50e0 / COS({lat} * {deg}) / 100e0 END)".format(lat=ilat("cy"), deg=DEG)
scalar("placement_from_scale_bar", PLACED, KEY,
       lambda: {k: r6(D.placement_from_scale_bar(
           placed(), F.when(F.col("site_id") % 9 == 0, 1.0).otherwise(100.0), 50.0)[k])
           for k in ("ground_width", "ground_height")},
       {"ground_width": rounded(f"sw * {BAR}"), "ground_height": rounded(f"sh * {BAR}")})

GEO = f"""SELECT site_id, {mx('lng')} AS x0, {my('lat')} AS y0, COS((site_id % 360) * {DEG}) AS c,
  SIN((site_id % 360) * {DEG}) AS s, CASE WHEN site_id % 8 = 0 THEN 0.2e0 ELSE 0e0 END AS shear FROM b_sites"""


@query("placement_from_georef", f"""
WITH g AS ({GEO})
SELECT site_id, CASE WHEN shear = 0 THEN {rounded("x0 + c * 399.5e0 * 2 - s * 299.5e0 * 2", 3)} END AS center_x,
  CASE WHEN shear = 0 THEN {rounded("y0 - s * 399.5e0 * 2 - c * 299.5e0 * 2", 3)} END AS center_y,
  CASE WHEN shear = 0 THEN 1600e0 END AS ground_width, CASE WHEN shear = 0 THEN 1200e0 END AS ground_height FROM g
""")
def placement_from_georef(s: Source) -> DataFrame:
    c, sn = F.col("c"), F.col("s")
    coeffs = F.array(c * 2, -sn * 2, -sn * 2 + F.col("shear") * c * 2,
                     -c * 2 - F.col("shear") * sn * 2, F.col("x0"), F.col("y0"))
    p = D.placement_from_georef(F.lit("EPSG:3857"), coeffs, 800, 600)
    keys = ("center_x", "center_y", "ground_width", "ground_height")
    return s.sql(GEO).select("site_id", *[F.round(p[k], 3).alias(k) for k in keys])


# -- world files ------------------------------------------------------------

FRAMES = """SELECT site_id, 500000e0 + (site_id * 7) % 900 + 0.5e0 AS x, 4800000e0 + (site_id * 11) % 800 AS y,
  CASE WHEN site_id % 10 = 0 THEN 0e0 ELSE 0.75e0 END AS k FROM b_sites"""


def frame_world() -> F.Column:
    return D.world_file(G.point("x", "y"), G.point(F.col("x") + F.col("k") * 400, "y"),
                        G.point("x", F.col("y") - F.col("k") * 300), 400, 300)


WORLD_SQL = {"a": "k", "d": "0e0", "b": "0e0", "e": "-k", "c": "x + k / 2", "f": "y - k / 2"}
scalar("world_file", FRAMES, KEY,
       lambda: {n: r6(frame_world()[i]) for i, n in enumerate("adbecf")},
       {n: f"CASE WHEN k > 0 THEN {rounded(sql)} END" for n, sql in WORLD_SQL.items()})

scalar("pixel_to_ground", FRAMES, KEY,
       lambda: {a: r6(D.pixel_to_ground(10.0, 20.0, frame_world())[a]) for a in "xy"},
       {"x": "CASE WHEN k > 0 THEN " + rounded("k * 10 + x + k / 2") + " END",
        "y": "CASE WHEN k > 0 THEN " + rounded("-k * 20 + y - k / 2") + " END"})

scalar("signif", "SELECT site_id, (site_id * 7919e0 + 1) / 7e0 * POW(10e0, CAST(site_id % 9 AS DOUBLE) - 4) AS v FROM b_sites", KEY,
       lambda: {"v9": D.signif("v", 9)},
       {"v9": "CAST(printf('%.8e', v) AS DOUBLE)"})

EXTENTS = """SELECT site_id, lng * 111000e0 AS xmin, lat * 120000e0 AS ymin, lng * 111000e0 + 50000e0 AS xmax,
  lat * 120000e0 + CASE WHEN site_id % 6 = 0 THEN -1e0 ELSE 40000e0 END AS ymax,
  CASE site_id % 4 WHEN 0 THEN 3857 WHEN 1 THEN 102100 WHEN 2 THEN 102113 ELSE 4326 END AS wkid FROM b_sites"""
EXT_OK = "site_id % 6 <> 0 AND site_id % 4 <> 3"
scalar("extent_to_coverage", EXTENTS, KEY,
       lambda: {k: r9(D.extent_to_coverage(F.struct("xmin", "ymin", "xmax", "ymax", "wkid"))[k])
                for k in ("west", "south", "east", "north")},
       {"west": f"CASE WHEN {EXT_OK} THEN {rounded(ilng('xmin'), 9)} END",
        "south": f"CASE WHEN {EXT_OK} THEN {rounded(ilat('ymin'), 9)} END",
        "east": f"CASE WHEN {EXT_OK} THEN {rounded(ilng('xmax'), 9)} END",
        "north": f"CASE WHEN {EXT_OK} THEN {rounded(ilat('ymax'), 9)} END"})

FIT_POINTS = """SELECT site_id * 4 + k AS pid, site_id, k, CASE WHEN k IN (0, 3) THEN w ELSE e END AS lng,
  CASE WHEN k IN (0, 1) THEN n ELSE s END AS lat, CAST(FLOOR((lng + 180) / 6) + 1 AS INT) AS zone
  FROM (SELECT site_id, lng, lng - 0.015625e0 AS w, lng + 0.015625e0 AS e, lat - 0.0078125e0 AS s, lat + 0.0078125e0 AS n FROM b_sites) b,
  (VALUES (0), (1), (2), (3)) t(k)"""
FIT_POINTS = FIT_POINTS.replace("b.lng", "lng")


@query("similarity_fit", f"""
WITH {utm_sql(FIT_POINTS.replace("FLOOR((lng + 180)", "FLOOR((b.lng + 180)"), 'site_id, k')},
c AS (SELECT site_id, AVG(e) AS cx, AVG(n) AS cy, 1600e0 AS w, 1200e0 AS h FROM utm GROUP BY 1),
d AS (SELECT u.site_id, u.k, e - cx AS dx, n - cy AS dy, cx, cy, w, h,
  CASE WHEN u.k IN (0, 3) THEN -w / 2 ELSE w / 2 END AS uu, CASE WHEN u.k IN (0, 1) THEN -h / 2 ELSE h / 2 END AS vv
  FROM utm u JOIN c ON c.site_id = u.site_id),
f AS (SELECT site_id, MAX(cx) AS cx, MAX(cy) AS cy, FLOOR(SUM(uu * dx - vv * dy) / SUM(uu * uu + vv * vv) * 100000 + 0.5) AS cs,
  FLOOR(SUM(vv * dx + uu * dy) / SUM(uu * uu + vv * vv) * 100000 + 0.5) AS rs FROM d GROUP BY 1)
SELECT site_id, ROUND(cs / 100000 * 1600, 3) AS top_x, ROUND(rs / 100000 * 1600, 3) AS top_y FROM f
""")
def similarity_fit(s: Source) -> DataFrame:
    c = F.col
    corners = [(-0.015625, 0.0078125), (0.015625, 0.0078125), (0.015625, -0.0078125), (-0.015625, -0.0078125)]
    zoned = s.sql(ZONED)
    ring = F.transform(F.array(*[G.point(c("lng") + dx, c("lat") + dy) for dx, dy in corners]),
                       lambda p: D.to_utm(p["x"], p["y"], c("zone")))
    controls = F.transform(ring, lambda u: G.point(u["e"], u["n"]))
    fitted = zoned.select("site_id", D.similarity_fit(controls, 1600, 1200).alias("fit"))
    f = c("fit.frame")
    return fitted.select(
        "site_id", F.round(f[1]["x"] - f[0]["x"], 3).alias("top_x"),
        F.round(f[1]["y"] - f[0]["y"], 3).alias("top_y"))


@query("largest_ring", """
SELECT feature_seq, CAST(CASE WHEN feature_seq % 4 = 3 THEN NULL ELSE 6 END AS INT) AS points,
  CASE WHEN feature_seq % 4 <> 3 THEN west END AS x0 FROM b_features
""")
def largest_ring(s: Source) -> DataFrame:
    pair = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    ring = pair(F.col("polygon"))
    small = pair(F.array(G.point(0, 0), G.point(1, 0), G.point(0, 1), G.point(0, 0)))
    text = (
        F.when(F.col("feature_seq") % 4 == 0, F.to_json(F.struct(
            F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))
        .when(F.col("feature_seq") % 4 == 3, F.to_json(F.struct(
            F.lit("Point").alias("type"), F.array(F.col("west"), F.col("south")).alias("coordinates"))))
        .otherwise(F.to_json(F.struct(
            F.lit("MultiPolygon").alias("type"), F.array(F.array(small), F.array(ring)).alias("coordinates")))))
    texts = features(s).select("feature_seq", text.alias("geojson"))
    found = texts.select("feature_seq", sheets.largest_ring("geojson").alias("ring"))
    return found.select(
        "feature_seq", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("points"),
        F.get("ring", F.lit(0))["x"].alias("x0"))
