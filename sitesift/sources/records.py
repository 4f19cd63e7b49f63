"""Project, OCR, contour, world and image files as tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.functions import geometry as G
from sitesift.functions import text as X
from sitesift.operators.projects import migrate_projects

PROJECT = (
    "schema_version INT, name STRING, project_no STRING, date STRING, address STRING, "
    "figures MAP<STRING, STRUCT<title: STRING, extent_m: DOUBLE>>, "
    "geology MAP<STRING, STRUCT<name: STRING, source_id: STRING, source_name: STRING>>, "
    "historical ARRAY<STRUCT<id: STRING, year: INT, sequence: INT>>, "
    "selection ARRAY<STRUCT<kind: STRING, key: STRING>>, _corrupt_record STRING")
OCR = "rec_texts ARRAY<STRING>, rec_polys ARRAY<ARRAY<ARRAY<DOUBLE>>>"
CONTOUR_PROJECT = (
    "image_path STRING, image_width INT, image_height INT, scale DOUBLE, dpi DOUBLE, "
    "origin_e DOUBLE, origin_n DOUBLE, features ARRAY<STRUCT<points: ARRAY<ARRAY<DOUBLE>>, "
    "layer: STRING, elevation: DOUBLE, closed: BOOLEAN, source: STRING, confidence: DOUBLE>>, "
    "spots ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, number: INT, desc: STRING>>")


def complete_projects(saved: DataFrame) -> DataFrame:
    """Parsed projects with empty maps and lists filled in, at the current version."""
    nothing = {
        "figures": "map<string,struct<title:string,extent_m:double>>",
        "geology": "map<string,struct<name:string,source_id:string,source_name:string>>"}
    for name, kind in nothing.items():
        saved = saved.withColumn(name, F.coalesce(name, F.create_map().cast(kind)))
    for name, kind in (("historical", "array<struct<id:string,year:int,sequence:int>>"),
                       ("selection", "array<struct<kind:string,key:string>>")):
        saved = saved.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return migrate_projects(saved)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Saved projects, one JSON document a line, brought to the current version.

    A line that is no JSON keeps its text in ``_corrupt_record``.
    """
    return complete_projects(spark.read.schema(PROJECT).json(path))


def parse_projects(docs: DataFrame, key: str) -> DataFrame:
    """``read_projects`` for documents held in a table (key, json)."""
    parsed = docs.select(key, F.from_json("json", PROJECT, {
        "columnNameOfCorruptRecord": "_corrupt_record"}).alias("p"))
    return complete_projects(parsed.select(key, "p.*"))


def ring_points(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def ocr_tokens(docs: DataFrame) -> DataFrame:
    """Tokens (drawing_id, tile_id, pos, text, poly) of OCR replies (column json);
    the two parallel lists are cut to the shorter."""
    parsed = docs.select("drawing_id", "tile_id", F.from_json("json", OCR).alias("r"))
    n = F.least(F.size("r.rec_texts"), F.size("r.rec_polys"))
    zipped = F.arrays_zip(
        F.slice("r.rec_texts", F.lit(1), F.greatest(n, F.lit(0))).alias("text"),
        F.slice("r.rec_polys", F.lit(1), F.greatest(n, F.lit(0))).alias("poly"))
    return parsed.select("drawing_id", "tile_id", F.posexplode(zipped).alias("pos", "t")).select(
        "drawing_id", "tile_id", "pos", "t.text", ring_points(F.col("t.poly")).alias("poly"))


def contour_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contours, spots) of contour projects (drawing_id, json), ids by position."""
    parsed = docs.select("drawing_id", F.from_json("json", CONTOUR_PROJECT).alias("p"))
    lines = parsed.select("drawing_id", F.posexplode("p.features").alias("contour_id", "f")).select(
        "drawing_id", F.col("contour_id").cast("bigint").alias("contour_id"),
        F.coalesce("f.layer", F.lit("CONTOUR")).alias("layer"),
        ring_points(F.col("f.points")).alias("points"), "f.elevation",
        F.coalesce("f.closed", F.lit(False)).alias("closed"),
        F.coalesce("f.source", F.lit("trace")).alias("source"),
        F.coalesce("f.confidence", F.lit(1.0)).alias("confidence"))
    spots = parsed.select("drawing_id", F.posexplode("p.spots").alias("pos", "s")).select(
        "drawing_id", "pos", "s.x", "s.y", "s.z", "s.number",
        F.coalesce("s.desc", F.lit("SPOT_ELEV")).alias("desc"))
    return lines, spots


def parse_world_files(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with coeffs [A, D, B, E, C, F] and ``error`` for anything else
    than six plain decimals (blank lines only at the end)."""
    lines = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    trimmed = F.transform(lines, lambda v: F.trim(v))
    kept = F.split(F.regexp_replace(F.array_join(trimmed, "\n"), r"\n+$", ""), "\n")
    numbers = F.transform(kept, lambda v: F.when(
        v.rlike(X.PLAIN_DECIMAL), v.try_cast("double")))
    bad = (F.size(kept) != 6) | F.exists(numbers, lambda v: v.isNull() | (F.abs(v) == float("inf")))
    return texts.withColumn("coeffs", F.when(~bad, numbers)).withColumn(
        "error", F.when(bad, "six-decimals"))


def read_world_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_world_files(files).drop("text")


# -- images -----------------------------------------------------------------


def sniff(content: Column) -> Column:
    """Media type by signature, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head == "89504E470D0A1A0A", "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.rlike("^(4949|4D4D)(2A00|002A|2B00|002B)"), "image/tiff"))


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 4 <= len(data):
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return None
        marker = data[at]
        at += 1
        if marker in (0x00, 0xD9, 0xDA):
            return None
        if 0xD0 <= marker <= 0xD7:
            continue
        if at + 2 > len(data):
            return None
        length = int.from_bytes(data[at:at + 2], "big")
        if length < 2 or at + length > len(data):
            return None
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and length >= 7:
            return (int.from_bytes(data[at + 5:at + 7], "big"), int.from_bytes(data[at + 3:at + 5], "big"))
        at += length
    return None


def _tiff_size(data: bytes) -> tuple[int, int] | None:
    order = "<" if data[:2] == b"II" else ">"
    if len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return None
    at = struct.unpack_from(order + "I", data, 4)[0]
    if at < 8 or at + 2 > len(data):
        return None
    count = struct.unpack_from(order + "H", data, at)[0]
    if at + 6 + 12 * count > len(data):
        return None
    size: dict[int, int] = {}
    for entry in range(at + 2, at + 2 + 12 * count, 12):
        tag, kind, values = struct.unpack_from(order + "HHI", data, entry)
        if tag in (256, 257) and values == 1 and kind in (3, 4):
            size[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, entry + 8)[0]
    return (size[256], size[257]) if size.get(256) and size.get(257) else None


def image_inventory(files: DataFrame) -> DataFrame:
    """(path, mime, width, height, size, sha256, error) of image files (path, content).

    Types go by signature and must agree with the extension. PNG sizes are read
    by expressions; JPEG and TIFF headers are walked in Arrow batches. Pixels
    are never decoded.
    """
    typed = files.select(
        "path", "content", sniff(F.col("content")).alias("mime"),
        F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    is_png = (F.col("mime") == "image/png") & (F.hex(F.substring("content", 13, 4)) == "49484452")
    ready = typed.select(
        "*", F.when(is_png, number(17)).alias("width"), F.when(is_png, number(21)).alias("height"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {"image/jpeg": _jpeg_size, "image/tiff": _tiff_size}
        for batch in batches:
            sizes = [readers[m](bytes(c)) for m, c in zip(batch["mime"], batch["content"])]
            out = batch[["path", "mime", "size", "sha256"]].copy()
            out["width"] = pd.array([s[0] if s else None for s in sizes], dtype="Int32")
            out["height"] = pd.array([s[1] if s else None for s in sizes], dtype="Int32")
            yield out

    walked = ready.where(F.col("mime").isin("image/jpeg", "image/tiff")).mapInPandas(
        walk, "path STRING, mime STRING, size BIGINT, sha256 STRING, width INT, height INT")
    rest = ready.where(F.col("mime").isNull() | (F.col("mime") == "image/png")).drop("content")
    extension = F.lower(F.regexp_extract("path", r"\.([^.\\/]+)$", 1))
    agrees = (
        ((F.col("mime") == "image/png") & (extension == "png"))
        | ((F.col("mime") == "image/jpeg") & extension.isin("jpg", "jpeg", "jpe"))
        | ((F.col("mime") == "image/tiff") & extension.isin("tif", "tiff")))
    error = (
        F.when(F.col("mime").isNull(), "signature").when((extension != "") & ~agrees, "extension")
        .when(F.col("width").isNull() | F.col("height").isNull()
              | (F.col("width") <= 0) | (F.col("height") <= 0), "header"))
    both = rest.unionByName(walked)
    return both.select("path", "mime", "width", "height", "size", "sha256", error.alias("error"))


def scan_image_inventory(spark: SparkSession, path: str) -> DataFrame:
    return image_inventory(spark.read.format("binaryFile").load(path).select("path", "content"))
