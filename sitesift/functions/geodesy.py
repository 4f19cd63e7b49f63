"""Projections, sheet layout and image placement as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitesift.functions.geometry import bounds, col, let, point, point_in_convex, valid_bounds

# Radii, limits and the GRS80 ellipsoid of NAD83.
MERCATOR_RADIUS = 6378137.0
GROUND_RADIUS = 6371000.0
MERCATOR_LATITUDE = 85.0511287798066
WORLD_LIMIT = math.pi * MERCATOR_RADIUS
DEG = math.pi / 180
GRS80_A = 6378137.0
GRS80_INVERSE_F = 298.257222101
UTM_SCALE = 0.9996
UTM_ZONE_EDGES = (-96.0, -90.0, -84.0, -78.0, -72.0)
SHEET_WIDTH_MM, SHEET_HEIGHT_MM = 332.4, 278.4
PAGE_WIDTH_MM, PAGE_HEIGHT_MM, HISTORICAL_HEIGHT_MM = 420.0, 297.0, 280.0
MAX_RASTER_PIXELS = 16_000_000
MAX_SOURCE_PIXELS = 32_000_000
CROP_RATIO = 420 / 297
CROP_TOLERANCE = 1e-4


def _mercator_y(lat: Column) -> Column:
    return F.log(F.tan(lat * (DEG / 2) + math.pi / 4)) * MERCATOR_RADIUS


def _inverse_mercator_lat(y: Column) -> Column:
    return (F.atan(F.exp(y / MERCATOR_RADIUS)) * 2 - math.pi / 2) / DEG


def web_mercator(lng, lat, limited: bool = True) -> Column:
    """EPSG:3857 metres; null outside the latitude limit unless ``limited`` is off."""
    lng, lat = col(lng), col(lat)
    projected = point(lng * (MERCATOR_RADIUS * DEG), _mercator_y(lat))
    if not limited:
        return projected
    inside = lng.between(-180, 180) & lat.between(-MERCATOR_LATITUDE, MERCATOR_LATITUDE)
    return F.when(inside, projected)


def inv_web_mercator(x, y, limited: bool = True) -> Column:
    x, y = col(x), col(y)
    geographic = point(x / (MERCATOR_RADIUS * DEG), _inverse_mercator_lat(y))
    if not limited:
        return geographic
    inside = (F.abs(x) <= WORLD_LIMIT) & (F.abs(y) <= WORLD_LIMIT)
    return F.when(inside, geographic)


# -- UTM --------------------------------------------------------------------


def utm_zone(lng, lat) -> Column:
    """STRUCT<zone, epsg, error>; the exact zone edges are ambiguous, hence errors."""
    lng, lat = col(lng), col(lat)
    zone = (F.floor((lng + 180) / 6) + 1).cast("int")
    error = (
        F.when(lng.isNull() | lat.isNull() | F.isnan(lng) | F.isnan(lat), "not-finite")
        .when(lat < 0, "southern-hemisphere")
        .when(lat > 84, "latitude-range")
        .when((lng < -180) | (lng > 180), "longitude-range")
        .when(lng.isin(*UTM_ZONE_EDGES), "zone-boundary")
        .when((lng < -96) | (lng > -72), "unsupported-zone")
    )
    return F.struct(
        F.when(error.isNull(), zone).alias("zone"),
        F.when(error.isNull(), F.concat(F.lit("EPSG:269"), zone.cast("string"))).alias("epsg"),
        error.alias("error"),
    )


def _krueger() -> tuple[float, float, list[float], list[float], list[float]]:
    """Rectifying radius, eccentricity, and to fourth order the forward and inverse coefficients and
    those from conformal to geodetic latitude."""
    f = 1 / GRS80_INVERSE_F
    n = f / (2 - f)
    radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    return radius, math.sqrt(f * (2 - f)), alpha, beta, delta


KRUEGER_RADIUS, GRS80_E, KRUEGER_ALPHA, KRUEGER_BETA, KRUEGER_DELTA = _krueger()


def to_utm(lng, lat, zone) -> Column:
    """STRUCT<e, n, error>: NAD83 / UTM north by the Krueger series."""
    lng, lat, zone = col(lng), col(lat), col(zone)
    sin_lat = F.sin(lat * DEG)
    t = F.sinh(F.atanh(sin_lat) - F.atanh(sin_lat * GRS80_E) * GRS80_E)
    dlng = (lng - (zone * 6 - 183)) * DEG

    def series(v: Column) -> Column:
        xi, eta = v["x"], v["y"]
        east, north = eta, xi
        for j, a in enumerate(KRUEGER_ALPHA, start=1):
            east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
            north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
        scale = UTM_SCALE * KRUEGER_RADIUS
        return point(east * scale + 500000, north * scale)

    def checked(p: Column) -> Column:
        error = (
            F.when((lng <= -96) | (lng >= -72), "longitude-range")
            .when((lat < 0) | (lat > 84), "latitude-range")
            .when(zone.isNull() | ~zone.isin(15, 16, 17, 18), "zone")
            .when((p["x"] < 100_000) | (p["x"] > 900_000), "easting-range")
            .when((p["y"] < 0) | (p["y"] > 10_000_000), "northing-range")
        )
        return F.struct(
            F.when(error.isNull(), p["x"]).alias("e"), F.when(error.isNull(), p["y"]).alias("n"),
            error.alias("error"))

    sphere = let(t, lambda v: point(
        F.atan2(v, F.cos(dlng)), F.atanh(F.sin(dlng) / F.sqrt(v * v + 1))))
    return let(let(sphere, series), checked)


def from_utm(e, n, zone) -> Column:
    """STRUCT<lng, lat, error> by the inverse of the series in ``to_utm``."""
    e, n, zone = col(e), col(n), col(zone)
    scale = UTM_SCALE * KRUEGER_RADIUS
    grid = point((e - 500_000) / scale, n / scale)

    def sphere(g: Column) -> Column:
        eta, xi = g["x"], g["y"]
        across, along = eta, xi
        for j, b in enumerate(KRUEGER_BETA, start=1):
            across = across - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
            along = along - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        return point(across, along)

    def conformal(v: Column) -> Column:
        return point(F.atan2(F.sinh(v["x"]), F.cos(v["y"])), F.asin(F.sin(v["y"]) / F.cosh(v["x"])))

    def place(v: Column) -> Column:
        chi = v["y"]
        lat = chi
        for j, d in enumerate(KRUEGER_DELTA, start=1):
            lat = lat + F.sin(chi * (2 * j)) * d
        return point(v["x"] / DEG + (zone * 6 - 183), lat / DEG)

    def checked(p: Column) -> Column:
        lng, lat = p["x"], p["y"]
        error = (
            F.when((e < 100_000) | (e > 900_000) | (n < 0) | (n > 10_000_000), "range")
            .when((lng < zone * 6 - 186 - 1e-8) | (lng > zone * 6 - 180 + 1e-8)
                  | (lat < 0) | (lat > 84), "outside-zone"))
        return F.struct(
            F.when(error.isNull(), lng).alias("lng"), F.when(error.isNull(), lat).alias("lat"),
            error.alias("error"))

    return let(let(let(let(grid, sphere), conformal), place), checked)


def project_ring(ring, zone) -> Column:
    """Every vertex in UTM; null as soon as one vertex cannot be projected."""
    zone = col(zone)

    def closed(projected: Column) -> Column:
        vertices = F.transform(projected, lambda p: point(p["e"], p["n"]))
        inner = F.slice(vertices, 1, F.greatest(F.size(vertices) - 1, F.lit(0)))
        failed = F.exists(projected, lambda p: p["error"].isNotNull())
        return F.when(
            ~failed & (F.size(vertices) > 0), F.concat(inner, F.slice(vertices, 1, 1)))

    return let(F.transform(col(ring), lambda p: to_utm(p["x"], p["y"], zone)), closed)


# -- sheets -----------------------------------------------------------------


def figure_bounds(lat, lng, extent_m) -> Column:
    """Box of a ground span around a site; null for an unusable site or span."""
    lat, lng, extent = col(lat), col(lng), col(extent_m)
    dlat = extent / 2 / GROUND_RADIUS * 180 / math.pi
    dlng = dlat / F.cos(lat * DEG)
    ok = (F.abs(lat) <= 85) & (F.abs(lng) <= 180) & (extent > 0)
    return F.when(ok, bounds(lng - dlng, lat - dlat, lng + dlng, lat + dlat))


def ground_width(b) -> Column:
    """Metres across, at the Mercator-mid latitude."""
    b = col(b)
    middle = _inverse_mercator_lat((_mercator_y(b["south"]) + _mercator_y(b["north"])) / 2)
    return (b["east"] - b["west"]) * (GROUND_RADIUS * DEG) * F.cos(middle * DEG)


def ground_height(b) -> Column:
    b = col(b)
    return (b["north"] - b["south"]) * (GROUND_RADIUS * DEG)


def metric_scale(b, pixel_width, max_pixel_width=160) -> Column:
    """Largest 1-2-5-10 distance within the pixel share, with its label."""
    px, limit = col(pixel_width).cast("double"), col(max_pixel_width).cast("double")

    def measured(width: Column) -> Column:
        maximum = width * F.least(limit, px) / px
        power = F.pow(F.lit(10.0), F.floor(F.log10(maximum)))
        steps = F.array(power, power * 2, power * 5, power * 10)
        distance = F.coalesce(F.array_max(F.filter(steps, lambda d: d <= maximum)), power / 2)
        return F.struct(width.alias("w"), distance.alias("d"))

    def labelled(v: Column) -> Column:
        distance = v["d"]
        shown = F.when(distance >= 1000, distance / 1000).otherwise(distance)
        number = F.when(shown == F.floor(shown), shown.cast("bigint").cast("string")).otherwise(
            shown.cast("string"))
        unit = F.when(distance >= 1000, F.lit(" km")).otherwise(F.lit(" m"))
        return F.struct(
            v["w"].alias("ground_width"), distance.alias("distance_m"),
            (distance / v["w"] * px).alias("pixel_width"), F.concat(number, unit).alias("label"),
            F.lit(4).alias("segments"), (distance / 4).alias("segment_m"))

    usable = (px > 0) & (limit > 0)
    return let(ground_width(b), lambda width: F.when(
        usable & (width > 0), let(measured(width), labelled)))


def _pixels(mm: float, dpi: Column) -> Column:
    return F.floor(dpi * (mm / 25.4) + 0.5).cast("int")


def sheet_geometry(b, dpi=300) -> Column:
    """Grow a box to the map frame's aspect in Mercator; raster size at ``dpi``.

    ``error`` is set for an unsupported dpi or a sheet past the Mercator limits.
    """
    b, dpi = col(b), col(dpi)
    aspect = SHEET_WIDTH_MM / SHEET_HEIGHT_MM
    # Steps in the order of project_mercator's formula: a side that falls on a tile border must not move by a rounding.
    projected_box = bounds(
        MERCATOR_RADIUS * b["west"] * DEG, _mercator_y(b["south"]),
        MERCATOR_RADIUS * b["east"] * DEG, _mercator_y(b["north"]))
    w, h = _pixels(SHEET_WIDTH_MM, dpi), _pixels(SHEET_HEIGHT_MM, dpi)

    def grow(p: Column) -> Column:
        height = F.greatest(p["north"] - p["south"], (p["east"] - p["west"]) / aspect)
        cx, cy = (p["west"] + p["east"]) / 2, (p["south"] + p["north"]) / 2
        return bounds(cx - height * aspect / 2, cy - height / 2,
                      cx + height * aspect / 2, cy + height / 2)

    def unprojected(p: Column) -> Column:
        return F.struct(p.alias("projected"), bounds(
            p["west"] / (MERCATOR_RADIUS * DEG), _inverse_mercator_lat(p["south"]),
            p["east"] / (MERCATOR_RADIUS * DEG), _inverse_mercator_lat(p["north"])).alias("grown"))

    def checked(v: Column) -> Column:
        grown = v["grown"]
        error = (
            F.when(~dpi.isin(150, 300) | (w.cast("bigint") * h > MAX_RASTER_PIXELS), "dpi")
            .when(~valid_bounds(b), "bounds")
            .when((grown["west"] < -180) | (grown["east"] > 180)
                  | (grown["south"] < -85) | (grown["north"] > 85), "mercator-limit"))
        return F.struct(
            F.when(error.isNull(), grown).alias("bounds"),
            F.when(error.isNull(), v["projected"]).alias("projected"),
            w.alias("raster_width"), h.alias("raster_height"), error.alias("error"))

    return let(let(let(projected_box, grow), unprojected), checked)


def historical_sheet_geometry(b, dpi=300) -> Column:
    """Sheet of an approved crop: the crop's own box, 280 mm high on the page."""
    b, dpi = col(b), col(dpi)
    w = _pixels(HISTORICAL_HEIGHT_MM * PAGE_WIDTH_MM / PAGE_HEIGHT_MM, dpi)
    h = _pixels(HISTORICAL_HEIGHT_MM, dpi)
    projected = bounds(
        b["west"] * (MERCATOR_RADIUS * DEG), _mercator_y(b["south"]),
        b["east"] * (MERCATOR_RADIUS * DEG), _mercator_y(b["north"]),
    )
    error = F.when(~dpi.isin(150, 300), "dpi").when(~crop_aspect_ok(b), "crop-aspect")
    return F.struct(
        F.when(error.isNull(), b).alias("bounds"),
        F.when(error.isNull(), projected).alias("projected"),
        w.alias("raster_width"), h.alias("raster_height"), error.alias("error"),
    )


def fit_saved_view(b, lat, lng) -> Column:
    """Sheet bounds holding a valid view, and its ground height rounded up."""
    fitted = F.when(valid_bounds(b, lat, lng), sheet_geometry(b, 150)["bounds"])
    return let(fitted, lambda v: F.struct(
        v.alias("bounds"), F.ceil(ground_height(v)).cast("bigint").alias("extent_m")))


def map_pixel(lng, lat, sheet) -> Column:
    """Pixel of a location in a sheet from ``sheet_geometry``."""
    sheet = col(sheet)
    p, b = web_mercator(lng, lat, limited=False), sheet["projected"]
    return point(
        (p["x"] - b["west"]) / (b["east"] - b["west"]) * sheet["raster_width"],
        (b["north"] - p["y"]) / (b["north"] - b["south"]) * sheet["raster_height"],
    )


def crop_aspect_ok(b) -> Column:
    """Projected box keeps the page's 420:297 aspect within 100 ppm."""
    b = col(b)
    width = (b["east"] - b["west"]) * (MERCATOR_RADIUS * DEG)
    height = _mercator_y(b["north"]) - _mercator_y(b["south"])
    off = F.abs(width / height / CROP_RATIO - 1)
    return F.when(valid_bounds(b), off <= CROP_TOLERANCE).otherwise(F.lit(False))


# -- scanned surveys --------------------------------------------------------


def metres_per_pixel(scale, dpi) -> Column:
    """Ground metres per scanned pixel; null for a non-positive scale or dpi."""
    scale, dpi = col(scale).cast("double"), col(dpi).cast("double")
    return F.when((scale > 0) & (dpi > 0), F.lit(25.4) * scale / (dpi * 1000))


def to_world(x, y, z, image_height, scale, dpi, origin_e=0.0, origin_n=0.0) -> Column:
    """World STRUCT<x, y, z>; rows grow downwards in the image, northings upwards."""
    k = metres_per_pixel(scale, dpi)
    return F.struct(
        (col(origin_e) + col(x) * k).alias("x"),
        (col(origin_n) + (col(image_height) - col(y)) * k).alias("y"),
        col(z).alias("z"),
    )


# -- placements -------------------------------------------------------------


def normalized_rotation(degrees) -> Column:
    """Angle in [-180, 180)."""
    turned = F.pmod(col(degrees) + 180, F.lit(360.0)) - 180
    return F.when(turned == 0, F.lit(0.0)).otherwise(turned)


def rotation_from_point(cx, cy, qx, qy) -> Column:
    """Rotation that points the top-centre edge at q; null when q is the centre."""
    dx, dy = col(qx) - col(cx), col(qy) - col(cy)
    return F.when((dx != 0) | (dy != 0), normalized_rotation(F.atan2(dx, dy) / DEG))


def placement(cx, cy, ground_w, ground_h, source_w, source_h, rotation=0.0) -> Column:
    return F.struct(
        col(cx).cast("double").alias("center_x"), col(cy).cast("double").alias("center_y"),
        col(ground_w).cast("double").alias("ground_width"),
        col(ground_h).cast("double").alias("ground_height"),
        col(source_w).cast("bigint").alias("source_width"),
        col(source_h).cast("bigint").alias("source_height"),
        normalized_rotation(rotation).alias("rotation_degrees"),
    )


def valid_placement(p) -> Column:
    p = col(p)
    return F.coalesce(
        (F.abs(p["center_x"]) < float("inf")) & (F.abs(p["center_y"]) < float("inf"))
        & (p["ground_width"] > 0) & (p["ground_width"] <= WORLD_LIMIT * 2)
        & (p["ground_height"] > 0) & (p["ground_height"] <= WORLD_LIMIT * 2)
        & (p["source_width"] > 0) & (p["source_height"] > 0)
        & (p["source_width"] * p["source_height"] <= MAX_SOURCE_PIXELS)
        & ~F.isnan(p["rotation_degrees"]),
        F.lit(False),
    )


def placement_corners(p) -> Column:
    """Projected corners in source order NW, NE, SE, SW."""
    p = col(p)
    angle = p["rotation_degrees"] * DEG
    cos, sin = F.cos(angle), F.sin(angle)
    hx, hy = p["ground_width"] / 2, p["ground_height"] / 2

    def corner(sx: int, sy: int) -> Column:
        x, y = hx * sx, hy * sy
        return point(p["center_x"] + x * cos + y * sin, p["center_y"] - x * sin + y * cos)

    return F.array(corner(-1, 1), corner(1, 1), corner(1, -1), corner(-1, -1))


def canvas_transform(p) -> Column:
    """[a, b, c, d, e, f] from source pixel edges to projected metres."""
    p = col(p)
    angle = p["rotation_degrees"] * DEG
    cos, sin = F.cos(angle), F.sin(angle)
    across, down = p["ground_width"] / p["source_width"], p["ground_height"] / p["source_height"]
    first = placement_corners(p)[0]
    linear = [cos * across, -sin * across, -sin * down, -cos * down]
    clean = [F.when(F.abs(v) < 2.220446049250313e-16, F.lit(0.0)).otherwise(v) for v in linear]
    return F.array(*clean, first["x"], first["y"])


def site_in_placement(p, lat, lng) -> Column:
    """Site inside the rotated rectangle, with 1e-7 m of slack."""
    p = col(p)
    site = web_mercator(lng, lat)
    angle = p["rotation_degrees"] * DEG
    cos, sin = F.cos(angle), F.sin(angle)
    dx, dy = site["x"] - p["center_x"], site["y"] - p["center_y"]
    inside = (
        (F.abs(dx * cos - dy * sin) <= p["ground_width"] / 2 + 1e-7)
        & (F.abs(dx * sin + dy * cos) <= p["ground_height"] / 2 + 1e-7)
    )
    in_world = ~F.exists(
        placement_corners(p),
        lambda c: (F.abs(c["x"]) > WORLD_LIMIT) | (F.abs(c["y"]) > WORLD_LIMIT),
    )
    return F.coalesce(valid_placement(p) & in_world & inside, F.lit(False))


def crop_in_placement(b, p) -> Column:
    """All four projected crop corners inside the placed image."""

    def inside(v: Column) -> Column:
        crop, frame = v["crop"], v["frame"]
        ok = F.lit(True)
        for x, y in (("west", "north"), ("east", "north"), ("east", "south"), ("west", "south")):
            ok = ok & let(web_mercator(crop[x], crop[y]),
                          lambda q: point_in_convex(q["x"], q["y"], frame))
        return F.coalesce(ok, F.lit(False))

    return let(F.struct(col(b).alias("crop"), placement_corners(p).alias("frame")), inside)


def placement_from_extent(b, width, height, rotation=0.0) -> Column:
    b = col(b)
    sw, ne = web_mercator(b["west"], b["south"]), web_mercator(b["east"], b["north"])
    built = placement(
        (sw["x"] + ne["x"]) / 2, (sw["y"] + ne["y"]) / 2,
        ne["x"] - sw["x"], ne["y"] - sw["y"], width, height, rotation,
    )
    ordered = (b["west"] < b["east"]) & (b["south"] < b["north"])
    return F.when(ordered & valid_placement(built), built)


def placement_from_scale_bar(p, pixel_length, ground_m) -> Column:
    """Recalibrate a placement from a drawn segment of known ground length."""
    p, pixels, ground = col(p), col(pixel_length), col(ground_m)
    lat = _inverse_mercator_lat(p["center_y"]) * DEG
    k = ground / F.cos(lat) / pixels
    built = placement(
        p["center_x"], p["center_y"], p["source_width"] * k, p["source_height"] * k,
        p["source_width"], p["source_height"], p["rotation_degrees"],
    )
    return F.when((pixels >= 2) & (ground > 0) & valid_placement(built), built)


def _native_to_mercator(crs: Column, x: Column, y: Column) -> Column:
    zone = F.try_to_number(F.regexp_extract(crs, r"^EPSG:269(1[5-8])$", 1), F.lit("99")).cast("int")
    utm = from_utm(x, y, zone)
    in_world = (F.abs(x) <= WORLD_LIMIT) & (F.abs(y) <= WORLD_LIMIT)
    return (
        F.when(crs == "EPSG:3857", F.when(in_world, point(x, y)))
        .when(crs == "EPSG:4326", web_mercator(x, y))
        .when(zone.isNotNull(), web_mercator(utm["lng"], utm["lat"]))
    )


def _distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def placement_from_georef(crs, coeffs, width, height) -> Column:
    """Placement of a pixel-centre affine [a, b, c, d, e, f].

    Null when the image is sheared or distorted by more than 2 %.
    """
    crs, g = col(crs), col(coeffs)
    w, h = col(width).cast("double"), col(height).cast("double")
    half = F.lit(-0.5)
    pixels = F.array(point(half, half), point(w - 0.5, half), point(w - 0.5, h - 0.5),
                     point(half, h - 0.5))
    native = F.transform(pixels, lambda p: point(
        g[0] * p["x"] + g[2] * p["y"] + g[4], g[1] * p["x"] + g[3] * p["y"] + g[5]))
    projected = F.transform(native, lambda p: _native_to_mercator(crs, p["x"], p["y"]))

    def sides(q: Column) -> Column:
        c = [q[i] for i in range(4)]
        return F.struct(
            q.alias("c"), _distance(c[1], c[0]).alias("top"), _distance(c[2], c[3]).alias("bottom"),
            _distance(c[3], c[0]).alias("left"), _distance(c[2], c[1]).alias("right"))

    def build(v: Column) -> Column:
        c = [v["c"][i] for i in range(4)]
        tx, ty = c[1]["x"] - c[0]["x"], c[1]["y"] - c[0]["y"]
        return F.struct(v.alias("v"), placement(
            (c[0]["x"] + c[1]["x"] + c[2]["x"] + c[3]["x"]) / 4,
            (c[0]["y"] + c[1]["y"] + c[2]["y"] + c[3]["y"]) / 4,
            (v["top"] + v["bottom"]) / 2, (v["left"] + v["right"]) / 2, width, height,
            F.atan2(-ty, tx) / DEG).alias("p"))

    def checked(b: Column) -> Column:
        v, p = b["v"], b["p"]
        c = [v["c"][i] for i in range(4)]
        tx, ty = c[1]["x"] - c[0]["x"], c[1]["y"] - c[0]["y"]
        lx, ly = c[3]["x"] - c[0]["x"], c[3]["y"] - c[0]["y"]
        misfit = let(placement_corners(p), lambda fitted: F.greatest(
            *[_distance(fitted[i], c[i]) for i in range(4)]))
        ok = (
            (v["top"] > 0) & (v["bottom"] > 0) & (v["left"] > 0) & (v["right"] > 0)
            & (F.abs((tx * lx + ty * ly) / (v["top"] * v["left"])) <= 0.02)
            & (F.abs(v["top"] - v["bottom"]) / p["ground_width"] <= 0.02)
            & (F.abs(v["left"] - v["right"]) / p["ground_height"] <= 0.02)
            & (misfit <= F.greatest(p["ground_width"], p["ground_height"]) * 0.02)
            & valid_placement(p))
        return F.when(ok, p)

    usable = F.size(g) == 6
    fitted = let(projected, lambda q: F.when(
        ~F.exists(q, lambda p: p.isNull()), let(let(sides(q), build), checked)))
    return F.when(usable, fitted)


def crop_for_placement(p, lat, lng) -> Column:
    """Largest 420:297 box centred on the site inside the rotated image.

    In the image frame the four box corners are fixed multiples of the half
    width, so the limit is the least of corner-by-axis ratios (closed form).
    """
    p = col(p)
    site = web_mercator(lng, lat)
    angle = p["rotation_degrees"] * DEG
    cos, sin = F.cos(angle), F.sin(angle)
    dx, dy = site["x"] - p["center_x"], site["y"] - p["center_y"]
    local_x, local_y = dx * cos - dy * sin, dx * sin + dy * cos
    limits = []
    for sx in (-1.0, 1.0):
        for sy in (-1.0, 1.0):
            ux = cos * sx - sin * (sy / CROP_RATIO)
            uy = sin * sx + cos * (sy / CROP_RATIO)
            for offset, step, half in (
                (local_x, ux, p["ground_width"] / 2), (local_y, uy, p["ground_height"] / 2)):
                limits.append(F.when(step > 0, (half - offset) / step)
                              .when(step < 0, (half + offset) / -step))

    def box(half_width: Column) -> Column:
        half_height = half_width / CROP_RATIO
        sw = inv_web_mercator(site["x"] - half_width, site["y"] - half_height)
        ne = inv_web_mercator(site["x"] + half_width, site["y"] + half_height)
        return F.when(half_width >= 0.05, bounds(sw["x"], sw["y"], ne["x"], ne["y"]))

    return let(F.least(*limits), box)


# -- world files and CAD frames ---------------------------------------------


def signif(x, digits: int = 12) -> Column:
    """Round to significant digits; zero has no sign."""

    def rounded(v: Column) -> Column:
        shift = F.lit(digits - 1) - F.floor(F.log10(F.abs(v)))
        scale = F.pow(F.lit(10.0), F.abs(shift))
        return F.when(shift >= 0, F.round(v * scale) / scale).otherwise(F.round(v / scale) * scale)

    return let(col(x).cast("double"), lambda v: F.when(v == 0, F.lit(0.0)).otherwise(rounded(v)))


def _well_conditioned(k: Column) -> Column:
    """Singular-value ratio of [A, D, B, E] above 1e-12."""

    def ratio(v: Column) -> Column:
        det = F.abs(v[0] * v[3] - v[2] * v[1])
        norm = v[0] * v[0] + v[1] * v[1] + v[2] * v[2] + v[3] * v[3]
        largest = (norm + F.sqrt(F.greatest(norm * norm - det * det * 4, F.lit(0.0)))) / 2
        return det / largest > 1e-12

    scale = F.greatest(F.abs(k[0]), F.abs(k[1]), F.abs(k[2]), F.abs(k[3]))
    scaled = F.array(*[k[i] / scale for i in range(4)])
    return F.coalesce(F.when(scale > 0, let(scaled, ratio)), F.lit(False))


def world_file(ul, ur, ll, width, height) -> Column:
    """[A, D, B, E, C, F] of the first pixel's centre, 12 digits; null if degenerate."""
    ul, ur, ll = col(ul), col(ur), col(ll)
    w, h = col(width).cast("double"), col(height).cast("double")
    linear = F.array(
        (ur["x"] - ul["x"]) / w, (ur["y"] - ul["y"]) / w,
        (ll["x"] - ul["x"]) / h, (ll["y"] - ul["y"]) / h)

    def complete(k: Column) -> Column:
        values = [k[0], k[1], k[2], k[3], ul["x"] + (k[0] + k[2]) / 2, ul["y"] + (k[1] + k[3]) / 2]
        return F.when(_well_conditioned(k), F.transform(F.array(*values), lambda v: signif(v)))

    return F.when((w > 0) & (h > 0), let(linear, complete))


def pixel_to_ground(px, py, coeffs) -> Column:
    """Ground point of a pixel by world-file coefficients."""
    px, py = col(px), col(py)
    return let(col(coeffs), lambda k: F.when(_well_conditioned(k), point(
        k[0] * px + k[2] * py + k[4], k[1] * px + k[3] * py + k[5])))


def similarity_fit(controls, width, height) -> Column:
    """Least-squares similarity of the corners UL, UR, LR, LL of a raster.

    The frame is snapped to 1e-5 m so that its corners stay affine; ``ok`` says
    whether the residual is within max(2 m, 0.15 % of the diagonal).
    """
    grid = 100_000
    w, h = col(width).cast("double"), col(height).cast("double")

    def steps(q: Column) -> Column:
        c = [q[i] for i in range(4)]
        cx = (c[0]["x"] + c[1]["x"] + c[2]["x"] + c[3]["x"]) / 4
        cy = (c[0]["y"] + c[1]["y"] + c[2]["y"] + c[3]["y"]) / 4
        across = down = F.lit(0.0)
        for i, (su, sv) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))):
            u, v = w * (su / 2), h * (sv / 2)
            dx, dy = c[i]["x"] - cx, c[i]["y"] - cy
            across = across + u * dx - v * dy
            down = down + v * dx + u * dy
        total = w * w + h * h
        return F.struct(
            q.alias("c"), cx.alias("cx"), cy.alias("cy"),
            F.floor(across / total * grid + 0.5).cast("double").alias("col"),
            F.floor(down / total * grid + 0.5).cast("double").alias("row"))

    def origin(v: Column) -> Column:
        x = v["cx"] - v["col"] / grid * w / 2 - v["row"] / grid * h / 2
        y = v["cy"] - v["row"] / grid * w / 2 + v["col"] / grid * h / 2
        return F.struct(
            v.alias("v"), F.floor(x * grid + 0.5).cast("double").alias("x"),
            F.floor(y * grid + 0.5).cast("double").alias("y"))

    def framed(o: Column) -> Column:
        c, r = o["v"]["col"], o["v"]["row"]
        corners = [
            (o["x"], o["y"]), (o["x"] + c * w, o["y"] + r * w),
            (o["x"] + c * w + r * h, o["y"] + r * w - c * h), (o["x"] + r * h, o["y"] - c * h)]
        return F.struct(o["v"].alias("v"), F.array(
            *[point(x / grid, y / grid) for x, y in corners]).alias("frame"))

    def judged(g: Column) -> Column:
        c, frame = g["v"]["c"], g["frame"]
        residual = F.greatest(*[_distance(c[i], frame[i]) for i in range(4)])
        angle = F.atan2(frame[1]["y"] - frame[0]["y"], frame[1]["x"] - frame[0]["x"]) / DEG
        turned = F.when(angle < 0, angle + 360).otherwise(angle)
        tolerance = F.greatest(F.lit(2.0), _distance(c[2], c[0]) * 0.0015)
        usable = (w > 0) & (h > 0) & ((g["v"]["col"] != 0) | (g["v"]["row"] != 0))
        return F.when(usable, F.struct(
            frame.alias("frame"), signif(turned).alias("rotation"),
            signif(residual).alias("residual_m"), signif(tolerance).alias("tolerance_m"),
            (residual <= tolerance).alias("ok")))

    return let(let(let(let(col(controls), steps), origin), framed), judged)


def extent_to_coverage(extent) -> Column:
    """Lng/lat box of a Web Mercator extent {xmin, ymin, xmax, ymax, wkid}; else null."""
    x = col(extent)
    ok = (
        x["wkid"].isin(3857, 102100, 102113)
        & (x["xmin"] >= -WORLD_LIMIT) & (x["xmax"] <= WORLD_LIMIT)
        & (x["ymin"] >= -WORLD_LIMIT) & (x["ymax"] <= WORLD_LIMIT)
        & (x["xmin"] < x["xmax"]) & (x["ymin"] < x["ymax"])
    )

    def lat(y: Column) -> Column:
        return F.atan(F.exp(y / MERCATOR_RADIUS)) * (360 / math.pi) - 90

    return F.when(ok, bounds(
        x["xmin"] * (180 / WORLD_LIMIT), lat(x["ymin"]),
        x["xmax"] * (180 / WORLD_LIMIT), lat(x["ymax"])))
