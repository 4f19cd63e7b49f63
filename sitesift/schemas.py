"""DDL of the nested values that the operators exchange."""

POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
RING = f"ARRAY<{POINT}>"
RINGS = f"ARRAY<{RING}>"
BOUNDS = "STRUCT<west: DOUBLE, south: DOUBLE, east: DOUBLE, north: DOUBLE>"

FEATURES = (
    f"dataset_id STRING, feature_seq BIGINT, doc STRING, name STRING, description STRING, "
    f"unit_code STRING, props MAP<STRING, STRING>, color STRING, fill_opacity DOUBLE, "
    f"polygon {RING}, holes {RINGS}"
)

PLACEMENT = (
    "STRUCT<center_x: DOUBLE, center_y: DOUBLE, ground_width: DOUBLE, ground_height: DOUBLE, "
    "source_width: BIGINT, source_height: BIGINT, rotation_degrees: DOUBLE>"
)

PREVIEW = "STRUCT<kind: STRING, url: STRING, layer: STRING, tile_template: STRING>"
EXPORT = "STRUCT<kind: STRING, url: STRING, layer: STRING, max_width: INT, max_height: INT>"

CATALOG = (
    f"id STRING, provider_id STRING, title STRING, year INT, resolution_m DOUBLE, "
    f"coverage {BOUNDS}, preview {PREVIEW}, export {EXPORT}, policy STRING, "
    f"source_url STRING, license_url STRING, attribution STRING"
)

OCR_TOKENS = f"drawing_id BIGINT, tile_id BIGINT, pos INT, text STRING, poly {RING}"

SPOTS = (
    "drawing_id BIGINT, spot_id BIGINT, x DOUBLE, y DOUBLE, value DOUBLE, raw STRING, "
    "raw_full STRING, status STRING, include BOOLEAN, confidence DOUBLE, mark_type STRING"
)

CONTOURS = (
    f"drawing_id BIGINT, contour_id BIGINT, layer STRING, points {RING}, "
    "elevation DOUBLE, closed BOOLEAN, source STRING, confidence DOUBLE"
)
