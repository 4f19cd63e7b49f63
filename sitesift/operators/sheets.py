"""Request plans for map sheets: which tiles or export pieces a sheet needs.

The plans are tables; nothing is fetched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geodesy as D
from sitesift.functions import geometry as G

# Tile and piece limits, frame width in millimetres at 96 dpi.
WORLD = 2 * math.pi * D.MERCATOR_RADIUS
MAX_TILES = 36
MAX_PIECES = 64
MAX_NATIVE_ZOOM = 19
FRAME_PIXELS = D.SHEET_WIDTH_MM / 25.4 * 96


def _cover(box: Column, zoom: Column) -> dict[str, Column]:
    span = F.lit(WORLD) / F.pow(F.lit(2.0), zoom)
    return {
        "span": span,
        "x0": F.floor((box["west"] + WORLD / 2) / span),
        "x1": F.ceil((box["east"] + WORLD / 2) / span) - 1,
        "y0": F.floor((F.lit(WORLD / 2) - box["north"]) / span),
        "y1": F.ceil((F.lit(WORLD / 2) - box["south"]) / span) - 1,
    }


def tile_zoom_of(box, max_tiles: int = MAX_TILES, max_zoom: int = MAX_NATIVE_ZOOM) -> Column:
    """Highest zoom, from the screen's own downwards, that covers a projected box
    with at most ``max_tiles`` tiles."""
    box = G.col(box)
    wanted = F.floor(F.log2(F.lit(WORLD * FRAME_PIXELS / 256) / (box["east"] - box["west"])))
    top = F.greatest(F.lit(0), F.least(F.lit(max_zoom), wanted)).cast("int")

    def fits(zoom: Column) -> Column:
        c = _cover(box, zoom)
        return (c["x1"] - c["x0"] + 1) * (c["y1"] - c["y0"] + 1) <= max_tiles

    return F.array_max(F.filter(F.sequence(F.lit(0), top), fits))


def tile_zoom(sheets: DataFrame, max_tiles: int = MAX_TILES, box: str = "projected") -> DataFrame:
    return sheets.withColumn("zoom", tile_zoom_of(box, max_tiles))


def dealt(sheets: DataFrame, sheet_key: str) -> DataFrame:
    """Sheets over all tasks: a small file of them, read by one task, may plan millions of requests."""
    return sheets.repartition(sheet_key)


def tile_requests(
    sheets: DataFrame, template: str, sheet_key: str = "sheet_id", box: str = "projected",
    max_tiles: int = MAX_TILES,
) -> DataFrame:
    """One row per XYZ tile of each sheet (projected, raster_width, raster_height):
    the address and where the tile lands in the sheet's pixels."""
    zoomed = tile_zoom(dealt(sheets, sheet_key), max_tiles, box)
    b = F.col(box)
    c = _cover(b, F.col("zoom"))
    tiles = zoomed.withColumn("_ty", F.explode(F.sequence(c["y0"], c["y1"]))).withColumn(
        "_tx", F.explode(F.sequence(c["x0"], c["x1"])))
    url = F.lit(template)
    for mark, value in (("{z}", "zoom"), ("{x}", "_tx"), ("{y}", "_ty")):
        url = F.replace(url, F.lit(mark), F.col(value).cast("string"))
    across, down = b["east"] - b["west"], b["north"] - b["south"]
    return tiles.select(
        sheet_key, "zoom", F.col("_tx").alias("tile_x"), F.col("_ty").alias("tile_y"),
        url.alias("url"),
        ((F.col("_tx") * c["span"] - WORLD / 2 - b["west"]) / across * F.col("raster_width"))
        .alias("x"),
        ((b["north"] - (F.lit(WORLD / 2) - F.col("_ty") * c["span"])) / down
         * F.col("raster_height")).alias("y"),
        (c["span"] / across * F.col("raster_width")).alias("w"),
        (c["span"] / down * F.col("raster_height")).alias("h"))


def _parameters(pairs: list[tuple[str, Column]]) -> Column:
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in pairs]
    return F.concat_ws("&", *parts)


def map_request(
    sheets: DataFrame, service: str, layer: str, crs: str = "EPSG:3857", version: str = "1.1.1",
    request_width: int = 1536, sheet_key: str = "sheet_id", box: str = "projected",
) -> DataFrame:
    """One WMS GetMap address per sheet."""
    b = F.col(box)
    height = F.floor(F.lit(request_width) * F.col("raster_height") / F.col("raster_width") + 0.5)
    height = height.cast("int")
    bbox = F.concat_ws(",", b["west"], b["south"], b["east"], b["north"])
    query = _parameters([
        ("SERVICE", F.lit("WMS")), ("REQUEST", F.lit("GetMap")), ("VERSION", F.lit(version)),
        ("LAYERS", F.lit(layer)), ("STYLES", F.lit("")), ("SRS", F.lit(crs)), ("BBOX", bbox),
        ("WIDTH", F.lit(request_width)), ("HEIGHT", height), ("FORMAT", F.lit("image/png")),
        ("TRANSPARENT", F.lit("FALSE")),
        ("EXCEPTIONS", F.lit("application/vnd.ogc.se_xml"))])
    return sheets.select(
        sheet_key, F.concat(F.lit(service + "?"), query).alias("url"),
        F.lit(request_width).alias("request_width"), height.alias("request_height"))


def export_requests(
    sheets: DataFrame, sheet_key: str = "sheet_id", box: str = "projected",
    max_pieces: int = MAX_PIECES,
) -> DataFrame:
    """Cut each sheet into the pieces its source may export at once.

    ``sheets``: projected, raster_width, raster_height and export (kind
    arcgis-export / wms-export, url, layer, max_width, max_height). Pieces
    come in rows from the top. All of them are listed; ``error`` tells beside
    them that a sheet needs more than ``max_pieces``.
    """
    ex, b = F.col("export"), F.col(box)
    w, h = F.col("raster_width"), F.col("raster_height")
    columns, rows = F.ceil(w / ex["max_width"]).cast("int"), F.ceil(h / ex["max_height"]).cast("int")
    planned = dealt(sheets, sheet_key).withColumn("pieces", columns.cast("bigint") * rows)
    too_many = F.col("pieces") > max_pieces
    cut = (
        planned.withColumn("_r", F.explode(F.sequence(F.lit(0), rows - 1)))
        .withColumn("_c", F.explode(F.sequence(F.lit(0), columns - 1)))
        .withColumn("x", F.col("_c") * ex["max_width"]).withColumn("y", F.col("_r") * ex["max_height"])
        .withColumn("w", F.least(ex["max_width"], w - F.col("x")))
        .withColumn("h", F.least(ex["max_height"], h - F.col("y"))))
    across, down = b["east"] - b["west"], b["north"] - b["south"]
    west = b["west"] + across * F.col("x") / w
    east = b["west"] + across * (F.col("x") + F.col("w")) / w
    north = b["north"] - down * F.col("y") / h
    south = b["north"] - down * (F.col("y") + F.col("h")) / h
    bbox = F.concat_ws(",", west, south, east, north)
    service = F.regexp_replace(ex["url"], r"/export/?$", "")
    arcgis = F.concat(service, F.lit("/export?"), _parameters([
        ("f", F.lit("image")), ("bbox", bbox), ("bboxSR", F.lit("3857")),
        ("imageSR", F.lit("3857")), ("size", F.concat_ws(",", "w", "h")),
        ("format", F.lit("png32")), ("transparent", F.lit("true"))]),
        F.coalesce(F.concat(F.lit("&layers="), F.url_encode(
            F.concat(F.lit("show:"), ex["layer"]))), F.lit("")))
    wms = F.concat(ex["url"], F.lit("&"), _parameters([
        ("SERVICE", F.lit("WMS")), ("VERSION", F.lit("1.3.0")), ("REQUEST", F.lit("GetMap")),
        ("STYLES", F.lit("")), ("CRS", F.lit("EPSG:3857")), ("BBOX", bbox),
        ("WIDTH", F.col("w")), ("HEIGHT", F.col("h")), ("FORMAT", F.lit("image/png")),
        ("TRANSPARENT", F.lit("FALSE"))]))
    url = F.when(ex["kind"] == "wms-export", wms).when(ex["kind"] == "arcgis-export", arcgis)
    order = F.col("_r") * columns + F.col("_c")
    return cut.select(
        sheet_key, order.cast("int").alias("n"),
        url.alias("url"), "x", "y", "w", "h",
        G.bounds(west, south, east, north).alias("bounds"),
        F.when(too_many, F.lit("too-many-pieces")).alias("error"))


def largest_ring(geojson) -> Column:
    """Closed outer ring with the most vertices of a Polygon or MultiPolygon text.

    Null without a usable ring. Whether it is simple is for ``validate_rings``.
    """
    text = G.col(geojson)
    single = F.from_json(text, "type STRING, coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    multi = F.from_json(text, "type STRING, coordinates ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")
    outer = (
        F.when(single["type"] == "Polygon", F.slice(single["coordinates"], 1, 1))
        .when(multi["type"] == "MultiPolygon", F.transform(
            multi["coordinates"], lambda p: F.get(p, F.lit(0)))))
    rings = F.transform(outer, lambda r: F.transform(r, lambda p: G.point(
        F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    usable = F.filter(rings, lambda r: (F.size(r) >= 4) & ~F.exists(
        r, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])))

    def longest(given: Column) -> Column:
        most = F.array_max(F.transform(given, lambda r: F.size(r)))
        return F.get(F.filter(given, lambda r: F.size(r) == most), F.lit(0))

    return G.let(G.let(usable, longest), G.close_ring)
