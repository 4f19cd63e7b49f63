"""Text documents for drawings and packages.

A document is rows (group, part, seq, line): header, body and trailer parts.
``write_documents`` range-partitions the rows by group and position, so a
group of any size is written by as many tasks as it needs; its document is
its part files in name order.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sitesift.functions import geodesy as D
from sitesift.functions import geometry as G
from sitesift.functions import text as X
from sitesift.operators.surveys import number_points

CSV_HEADER = "Point,Elevation,Easting,Northing,PixelX,PixelY,Description,Status,RawText"


def fixed(value, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", G.col(value).cast("double"))


def document(body: DataFrame, group: str, header: Sequence[str] = (),
             trailer: Sequence[str] = ()) -> DataFrame:
    """``body`` (group, seq, line) between header and trailer lines of each group."""
    rows = body.select(group, F.lit(1).alias("part"), F.col("seq").cast("bigint").alias("seq"), "line")
    groups = body.select(group).distinct()
    for part, lines in ((0, header), (2, trailer)):
        if lines:
            listed = F.array(*[F.lit(line) for line in lines])
            rows = rows.unionByName(groups.select(
                group, F.lit(part).alias("part"), F.posexplode(listed).alias("seq", "line")
            ).withColumn("seq", F.col("seq").cast("bigint")))
    return rows


def write_documents(rows: DataFrame, group: str, path: str, line_end: str = "\n") -> None:
    order = [group, "part", "seq"]
    (
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select(group, F.col("line").alias("value"))
        .write.mode("overwrite").option("lineSep", line_end).partitionBy(group).text(path)
    )


def survey_points(spots: DataFrame, options: dict) -> DataFrame:
    """Selected spots with number, world position and description.

    ``options``: image_height, scale, dpi, origin_e, origin_n, start, description.
    """
    chosen = spots.where(X.spot_selected("include", "value"))
    numbered = number_points(chosen, options.get("start", 1))
    world = D.to_world("x", "y", "value", options["image_height"], options["scale"],
                       options["dpi"], options.get("origin_e", 0.0), options.get("origin_n", 0.0))
    return numbered.withColumn("w", world).withColumn(
        "desc", X.clean_description(F.lit(options.get("description", ""))))


def csv_line() -> Column:
    raw = F.replace(F.coalesce(F.nullif("raw_full", F.lit("")), "raw", F.lit("")), F.lit('"'), F.lit('""'))
    return F.concat_ws(
        ",", "number", fixed("value", 2), fixed("w.x", 4), fixed("w.y", 4), fixed("x", 1),
        fixed("y", 1), "desc", F.coalesce("status", F.lit("REVIEW")),
        F.concat(F.lit('"'), raw, F.lit('"')))


def pnezd_line() -> Column:
    return F.concat_ws(",", "number", fixed("w.y", 4), fixed("w.x", 4), fixed("w.z", 3), "desc")


def landxml_line() -> Column:
    desc = X.xml_escape("desc")
    return F.concat(
        F.lit('    <CgPoint name="'), F.col("number").cast("string"), F.lit('" desc="'), desc,
        F.lit('" code="'), desc, F.lit('">'),
        F.concat_ws(" ", fixed("w.y", 4), fixed("w.x", 4), fixed("w.z", 3)), F.lit("</CgPoint>"))


def pairs(*codes: tuple[int, Column | str | int]) -> Column:
    """DXF group codes and values, one a line, without the last line end."""
    parts: list[Column] = []
    for code, value in codes:
        shown = value if isinstance(value, Column) else F.lit(str(value))
        parts += [F.lit(str(code)), shown.cast("string")]
    return F.concat_ws("\n", *parts)


def dxf_point() -> Column:
    """A POINT with its label as TEXT."""
    e, n, z = F.col("w.x"), F.col("w.y"), F.col("w.z")
    return pairs(
        (0, "POINT"), (8, "SPOT_ELEVATIONS"), (10, fixed(e, 4)), (20, fixed(n, 4)), (30, fixed(z, 3)),
        (0, "TEXT"), (8, "SPOT_LABELS"), (10, fixed(e + 0.5, 4)), (20, fixed(n + 0.5, 4)),
        (30, fixed(z, 3)), (40, "0.9"), (1, F.concat(fixed(z, 2), F.lit(" "), "desc")))


def dxf_block_point(text_height: float = 0.8) -> Column:
    """An INSERT of the POINT block with its three attributes."""
    e, n, z = F.col("w.x"), F.col("w.y"), F.col("w.z")
    head = pairs(
        (0, "INSERT"), (8, "SPOT_ELEVATIONS"), (2, "POINT"), (66, 1), (10, fixed(e, 4)),
        (20, fixed(n, 4)), (30, fixed(z, 3)), (41, 1), (42, 1), (43, 1), (50, 0))
    attributes = [
        pairs((0, "ATTRIB"), (8, "SPOT_ELEVATIONS"), (10, fixed(e + 0.8, 4)), (20, fixed(n + dy, 4)),
              (30, fixed(z, 3)), (40, text_height), (1, value), (2, tag), (70, 0))
        for tag, value, dy in (("ELEV", fixed(z, 3), 0.8), ("POINT", F.col("number"), 0.0),
                               ("DESC", F.col("desc"), -0.8))]
    return F.concat_ws("\n", head, *attributes, pairs((0, "SEQEND"), (8, "SPOT_ELEVATIONS")))


def _block_header(text_height: float = 0.8) -> list[str]:
    """Header, layers and the POINT block definition of a block drawing."""

    def lines(*codes: tuple[int, object]) -> list[str]:
        return [str(v) for code in codes for v in code]

    def layer(name: str, color: int) -> list[str]:
        return lines((0, "LAYER"), (2, name), (70, 0), (62, color), (6, "CONTINUOUS"))

    def attribute(tag: str, prompt: str, dy: float) -> list[str]:
        return lines((0, "ATTDEF"), (8, 0), (10, 0.8), (20, dy), (30, 0), (40, text_height), (1, ""),
                     (3, prompt), (2, tag), (70, 0))

    return [
        *lines((0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, "AC1009"), (0, "ENDSEC")),
        *lines((0, "SECTION"), (2, "TABLES"), (0, "TABLE"), (2, "LAYER"), (70, 2)),
        *layer("0", 7), *layer("SPOT_ELEVATIONS", 2), *lines((0, "ENDTAB"), (0, "ENDSEC")),
        *lines((0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (8, 0), (2, "POINT"), (70, 2), (10, 0),
               (20, 0), (30, 0), (3, "POINT"), (1, "")),
        *attribute("ELEV", "Elevation", 0.8), *attribute("POINT", "Point Number", 0),
        *attribute("DESC", "Description", -0.8),
        *lines((0, "ENDBLK"), (8, 0), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"))]


def _lines(points: DataFrame, line: Column) -> DataFrame:
    return points.select("drawing_id", F.col("number").alias("seq"), line.alias("line"))


def write_spot_csv(spots: DataFrame, options: dict, path: str) -> None:
    body = _lines(survey_points(spots, options), csv_line())
    write_documents(document(body, "drawing_id", [CSV_HEADER]), "drawing_id", path)


def write_pnezd(spots: DataFrame, options: dict, path: str) -> None:
    body = _lines(survey_points(spots, options), pnezd_line())
    write_documents(document(body, "drawing_id"), "drawing_id", path, "\r\n")


def write_landxml(spots: DataFrame, options: dict, path: str, date: str) -> None:
    header = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        '<LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2" version="1.2" '
        f'date="{date}">',
        "  <Units>",
        '    <Metric linearUnit="meter" areaUnit="squareMeter" volumeUnit="cubicMeter" '
        'temperatureUnit="celsius" pressureUnit="milliBars"/>',
        "  </Units>", "  <CgPoints>"]
    body = _lines(survey_points(spots, options), landxml_line())
    write_documents(document(body, "drawing_id", header, ["  </CgPoints>", "</LandXML>"]),
                    "drawing_id", path)


def write_dxf_points(spots: DataFrame, options: dict, path: str, style: str = "plain") -> None:
    line = dxf_point() if style == "plain" else dxf_block_point()
    header = ["0", "SECTION", "2", "ENTITIES"] if style == "plain" else _block_header()
    body = _lines(survey_points(spots, options), line)
    write_documents(document(body, "drawing_id", header, ["0", "ENDSEC", "0", "EOF"]),
                    "drawing_id", path)


# -- polylines --------------------------------------------------------------


def boundary_entity(layer, ring, handle) -> Column:
    """Closed LWPOLYLINE of a boundary ring; ``handle`` is its number in the drawing."""
    closed = G.close_ring(ring)
    vertices = F.transform(closed, lambda p: F.concat_ws(
        "\n", F.lit("10"), X.plain_number(p["x"]), F.lit("20"), X.plain_number(p["y"])))
    head = pairs(
        (0, "LWPOLYLINE"), (5, F.hex(G.col(handle).cast("bigint"))), (100, "AcDbEntity"),
        (8, G.col(layer)), (100, "AcDbPolyline"), (90, F.size(closed)), (70, 1))
    return F.concat_ws("\n", head, F.array_join(vertices, "\n"))


def contour_entity(layer, points, elevation, closed) -> Column:
    """3D polyline at the contour's elevation (0 when unlabelled); a closed
    line repeats its first point."""
    z = fixed(F.coalesce(G.col(elevation), F.lit(0.0)), 3)
    points = G.col(points)
    ring = F.when(G.col(closed) & (F.size(points) > 0), F.concat(
        points, F.slice(points, 1, 1))).otherwise(points)
    vertices = F.transform(ring, lambda p: F.concat_ws(
        "\n", F.lit("0\nVERTEX\n8"), G.col(layer), F.lit("10"), fixed(p["x"], 4), F.lit("20"),
        fixed(p["y"], 4), F.lit("30"), z, F.lit("70\n32")))
    head = pairs((0, "POLYLINE"), (8, G.col(layer)), (66, 1), (10, 0), (20, 0), (30, z), (70, 8))
    entity = F.concat_ws("\n", head, F.array_join(vertices, "\n"), pairs((0, "SEQEND")))
    return F.when(F.size(ring) >= 2, entity)


def write_dxf_polylines(lines: DataFrame, path: str) -> None:
    """``lines``: drawing_id, contour_id, layer, points in world metres, elevation, closed."""
    body = lines.select(
        "drawing_id", F.col("contour_id").alias("seq"),
        contour_entity("layer", "points", "elevation", "closed").alias("line")).where(
        F.col("line").isNotNull())
    write_documents(document(body, "drawing_id", ["0", "SECTION", "2", "ENTITIES"],
                             ["0", "ENDSEC", "0", "EOF"]), "drawing_id", path)


# -- manifests --------------------------------------------------------------


def csv_row(*columns: str | Column) -> Column:
    return F.concat_ws(",", *[
        F.coalesce(X.csv_cell(G.col(c).cast("string")), F.lit("")) for c in columns])


def manifest_rows(files: DataFrame, group: str = "package_id", path: str = "path") -> DataFrame:
    """(group, path, json, csv) of the file rows, keys sorted, cells made safe."""
    columns = [c for c in files.columns if c != group]
    row = files.withColumn("_row", F.struct(*columns))
    kind = row.schema["_row"].dataType
    return row.select(
        group, path, X.stable_json("_row", kind).alias("json"), csv_row(*columns).alias("csv"))


def write_manifest(files: DataFrame, path: str, group: str = "package_id") -> None:
    """JSON lines and CSV of each package's files, in path order, under ``path``."""
    from sitesift.operators.numbering import number_rows

    columns = [c for c in files.columns if c != group]
    rows = number_rows(manifest_rows(files, group), [group], None, [F.col("path")], "seq")
    as_json = rows.select(group, "seq", F.col("json").alias("line"))
    write_documents(document(as_json, group), group, f"{path}/json")
    as_csv = rows.select(group, "seq", F.col("csv").alias("line"))
    write_documents(document(as_csv, group, [",".join(columns)]), group, f"{path}/csv", "\r\n")


def precise(x, digits: int = 12) -> Column:
    """Text of exactly ``digits`` significant digits, without an exponent."""
    v = D.signif(x, digits)

    def text(value: Column) -> Column:
        decimals = F.lit(digits - 1) - F.when(value == 0, 0).otherwise(F.floor(F.log10(F.abs(value))))
        plain = F.abs(value).cast("decimal(38,18)").cast("string")
        whole = F.length(F.substring_index(plain, ".", 1))
        cut = F.substring(plain, F.lit(1), (whole + F.when(
            decimals > 0, decimals + 1).otherwise(0)).cast("int"))
        return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), cut)

    return G.let(v, text)


def world_file_text(coeffs) -> Column:
    return F.concat(F.array_join(F.transform(G.col(coeffs), lambda v: precise(v)), "\n"), F.lit("\n"))


def write_world_files(frames: DataFrame, path: str, group: str = "image_id") -> None:
    """Six coefficients a file; ``frames``: group, coeffs."""
    body = frames.select(group, F.posexplode("coeffs").alias("seq", "_v")).select(
        group, "seq", precise("_v").alias("line"))
    write_documents(document(body, group), group, path)


def source_record_text() -> Column:
    """Licence and attribution record of one item (code, year, verification,
    provider, attribution, license, evidence, image_path)."""
    indented = lambda c: F.replace(F.coalesce(F.col(c), F.lit("not provided")), F.lit("\n"), F.lit("\n    "))
    parts = [F.col("code"), F.concat(F.lit("Acquisition year: "), F.coalesce(
        F.col("year").cast("string"), F.lit("unknown")))]
    for label, name in (
        ("Acquisition year verification", "verification"), ("Provider", "provider"),
        ("Attribution", "attribution"), ("Licence", "license"),
        ("Redistribution evidence", "evidence"), ("Image", "image_path")):
        parts.append(F.concat(F.lit(f"{label}: "), indented(name)))
    return F.concat_ws("\n", *parts)


def write_source_record(items: DataFrame, path: str, group: str = "package_id") -> None:
    body = items.select(group, F.col("pos").alias("seq"), source_record_text().alias("line"))
    write_documents(document(body, group, ["SOURCES AND LICENCES", ""]), group, path)


# -- feature tiles and links ------------------------------------------------


def tile_of(cell: float = 1.0) -> Column:
    return F.concat_ws("_", F.floor(F.col("west") / cell), F.floor(F.col("south") / cell))


def tile_manifest(features: DataFrame, *keys: str) -> DataFrame:
    """True bounds and feature count per tile, from the stored geometry."""
    from sitesift.operators.sites import dataset_bounds

    return dataset_bounds(features, *keys)


def write_feature_tiles(features: DataFrame, path: str, expected: int, cell: float = 1.0) -> DataFrame:
    """Write features (with west, south, east, north) as Parquet by dataset and
    tile, then check what was written and add ``manifest`` and ``status``.

    ``status`` first says incomplete, so that a failing write leaves no old
    promise standing; each write has a version folder of its own; last, ``status``
    names the version, and says complete only when the stored features are as
    many as ``expected``. Range partitioning splits a crowded tile over files.
    """
    spark = features.sparkSession
    version = uuid.uuid4().hex
    publish_status(spark, path, version, expected, 0, False)
    tiled = features.withColumn("tile", tile_of(cell))
    tiled.repartitionByRange("dataset_id", "tile", "feature_seq").write.partitionBy(
        "dataset_id", "tile").parquet(f"{path}/{version}/features")
    stored = spark.read.parquet(f"{path}/{version}/features")
    manifest = tile_manifest(stored.drop("west", "south", "east", "north"), "dataset_id", "tile")
    manifest.write.parquet(f"{path}/{version}/manifest")
    written = spark.read.parquet(f"{path}/{version}/manifest")
    saved = written.agg(F.coalesce(F.sum("feature_count"), F.lit(0)).alias("n")).first()["n"]
    publish_status(spark, path, version, expected, saved, saved == expected)
    return written


def publish_status(spark: SparkSession, path: str, version: str, expected: int, saved: int, complete: bool) -> None:
    """Add a status; the newest counts. Nothing is overwritten, so a reader always finds one."""
    row = spark.createDataFrame(
        [(time.time_ns(), version, expected, saved, complete)], "at BIGINT, version STRING, expected BIGINT, saved BIGINT, complete BOOLEAN")
    row.coalesce(1).write.mode("append").parquet(f"{path}/status")


def newest_status(spark: SparkSession, path: str) -> Row:
    return spark.read.parquet(f"{path}/status").orderBy(F.col("at").desc()).first()


TILE = ("dataset_id", "tile")


def tile_selection(manifest: DataFrame, bounds: dict[str, float] | None) -> DataFrame:
    """Rows of the manifest whose tile meets the viewport."""
    from sitesift.operators.sites import scan_tiles

    return manifest if bounds is None else scan_tiles(manifest, {k: F.lit(v) for k, v in bounds.items()})


def read_feature_tiles(spark: SparkSession, path: str, bounds: dict[str, float] | None = None) -> DataFrame:
    """Features of the published version; with ``bounds`` those of the tiles that meet it whose own box meets it too.

    The manifest chooses the tiles, and the join with it prunes the partitions of the scan, so only the files of chosen
    tiles are read, and only they are verified. Refuses an incomplete cache, and one whose chosen
    tiles differ from the manifest in count or bounds.
    """
    status = newest_status(spark, path)
    if not status["complete"] or status["saved"] != status["expected"]:
        raise ValueError(f"the tile cache is incomplete: {status['saved']} of {status['expected']} features")
    chosen = tile_selection(spark.read.parquet(f"{path}/{status['version']}/manifest"), bounds)
    features = spark.read.parquet(f"{path}/{status['version']}/features")
    stored = features if bounds is None else features.join(chosen.select(*TILE), list(TILE), "left_semi").select(*features.columns)
    here = tile_manifest(stored.drop("west", "south", "east", "north"), *TILE)
    columns = [*TILE, "west", "south", "east", "north", "feature_count"]
    wrong = here.select(columns).exceptAll(chosen.select(columns)).union(
        chosen.select(columns).exceptAll(here.select(columns)))
    if not wrong.isEmpty():
        raise ValueError("stored tiles differ from the manifest")
    return tile_selection(stored, bounds)


# Fixed value: where the mirrored service keeps its polygons.
MIRROR = "/mines/data/google/mrd128/"


def rewrite_href(href, base) -> Column:
    """Relative path into the local mirror for addresses under its polygon
    folder; any other address stays as it is."""
    href, base = G.col(href), G.col(base)
    folder = F.regexp_replace(base, r"[^/]*$", "")
    absolute = (
        F.when(href.rlike(r"(?i)^https?://"), href)
        .when(F.startswith(href, F.lit("/")), F.concat(
            F.regexp_extract(base, r"^(https?://[^/]+)", 1), href))
        .otherwise(F.concat(folder, href)))
    depth = F.size(F.split(F.regexp_extract(base, rf"(?i){MIRROR}(.*)$", 1), "/"))
    relative = F.regexp_extract(absolute, rf"(?i){MIRROR}([^?#]*)", 1)
    local = F.concat(F.repeat(F.lit("../"), depth), F.lit("mrd128-cache/"), relative)
    return F.when(absolute.rlike(rf"(?i){MIRROR}polygons/"), local).otherwise(href)


def rewrite_links(links: DataFrame, href: str = "href", base: str = "base") -> DataFrame:
    return links.withColumn("local_href", rewrite_href(href, base))
