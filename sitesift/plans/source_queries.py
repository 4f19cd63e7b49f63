"""Queries that read documents which Spark writes out of the base tables."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geodesy as D
from sitesift.functions import geometry as G
from sitesift.operators import links, projects, rules, saved_projects
from sitesift.plans.bindings import Source
from sitesift.plans.catalog_queries import NAMES
from sitesift.plans.geodesy_queries import FRAMES, ilat, ilng, mx, my
from sitesift.plans.registry import query, rounded
from sitesift.plans.site_queries import code_sql, features, legend_values
from sitesift.plans.survey_queries import SPOTS, contours
from sitesift.session import durable
from sitesift.sources import catalogs, kml, records


def joined_text(df: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """Texts of a key in order. Only used where a key has few rows by its making."""
    listed = F.array_sort(F.collect_list(F.struct(seq, text)))
    return df.groupBy(key).agg(F.array_join(F.transform(listed, lambda v: v[text]), "").alias(text))


def _ring_text(ring: Column) -> Column:
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(",", p["x"], p["y"])), " ")


def kml_documents(s: Source, bad: bool = False) -> DataFrame:
    """Some polygons a document, styled in line, by style or by style map.

    Some documents carry prefixes, some polygons lie in nested geometries, a
    style is given twice, and a placemark stands in a comment.
    """
    f = features(s)
    seq = F.col("feature_seq")
    style = (
        F.when(seq % 4 == 0, "<styleUrl>#s1</styleUrl>").when(seq % 4 == 1, "<styleUrl>#m1</styleUrl>")
        .otherwise("<Style><PolyStyle><color>8000ff00</color></PolyStyle></Style>"))
    outer = _ring_text(F.col("polygon"))
    if bad:
        outer = F.when(seq % 10 == 0, F.concat(outer, F.lit(" x,y"))).otherwise(outer)
    holes = F.array_join(F.transform("holes", lambda h: F.concat(
        F.lit("<innerBoundaryIs><LinearRing><coordinates>"), _ring_text(h),
        F.lit("</coordinates></LinearRing></innerBoundaryIs>"))), "")
    mark = F.concat(
        F.lit("<Placemark><name>"), F.col("name"),
        F.lit("</name><description>&lt;b&gt;Unit&lt;/b&gt;  text</description>"), style,
        F.lit('<ExtendedData><Data name="FID"><value>'), seq.cast("string"),
        F.lit("</value></Data></ExtendedData>"),
        F.when(seq % 7 == 3, "<MultiGeometry><MultiGeometry>").otherwise(""),
        F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), outer,
        F.lit("</coordinates></LinearRing></outerBoundaryIs>"), holes, F.lit("</Polygon>"),
        F.when(seq % 7 == 3, "</MultiGeometry></MultiGeometry>").otherwise(""), F.lit("</Placemark>"))
    marks = f.select(F.shiftright("feature_seq", 5).alias("doc"), "feature_seq", mark.alias("kml"))
    head = ('<kml><Document><!-- <Placemark><Polygon></Polygon></Placemark> -->'
            '<Style id="s1"><PolyStyle><color>ff00ff00</color></PolyStyle></Style>'
            '<Style id="s1"><PolyStyle><color>ff0000ff</color></PolyStyle></Style>'
            '<StyleMap id="m1"><Pair><key>normal</key><styleUrl>#s1</styleUrl></Pair></StyleMap>')
    whole = F.concat(F.lit(head), "kml", F.lit("</Document></kml>"))
    return joined_text(marks, "doc", "feature_seq", "kml").select(
        F.col("doc").cast("string").alias("doc"), F.col("doc").alias("doc_seq"),
        F.when(F.col("doc") % 3 == 1, F.regexp_replace(whole, "(</?)(?=[A-Z])", "$1k:")).otherwise(whole).alias("kml"))


@query("read_kml_polygons", f"""
WITH legend AS (SELECT * FROM (VALUES {legend_values()}) AS t(code, color, title, detail)),
c AS (SELECT *, {code_sql("label")} AS code FROM b_features)
SELECT c.feature_seq AS fid, ROW_NUMBER() OVER (ORDER BY c.feature_seq) - 1 AS feature_seq,
  CASE WHEN l.code IS NOT NULL THEN upper(c.code) || ' — ' || l.title ELSE c.label END AS name,
  c.code AS unit_code, CAST(6 AS INT) AS points, CAST(CASE WHEN has_hole THEN 1 ELSE 0 END AS INT) AS holes, west, north,
  CASE WHEN l.code IS NOT NULL THEN l.color WHEN feature_seq % 4 < 2 THEN '#ff0000' ELSE '#00ff00' END AS color,
  CASE WHEN l.code IS NOT NULL THEN 0.6e0 WHEN feature_seq % 4 < 2 THEN 1e0 ELSE ROUND(128 / 255e0, 9) END AS fill_opacity
FROM c LEFT JOIN legend l ON l.code = c.code
""")
def read_kml_polygons(s: Source) -> DataFrame:
    found = kml.kml_features(kml_documents(s))
    return found.select(
        F.col("props")["fid"].cast("bigint").alias("fid"), "feature_seq", "name", "unit_code", F.size("polygon").alias("points"),
        F.size("holes").alias("holes"), G.geometry_bounds("polygon")["west"].alias("west"),
        G.geometry_bounds("polygon")["north"].alias("north"), "color", F.round("fill_opacity", 9).alias("fill_opacity"))


@query("read_bedrock_kml", """
SELECT feature_seq AS fid, CASE WHEN feature_seq % 10 = 0 THEN 'coordinates' END AS error FROM b_features
""")
def read_bedrock_kml(s: Source) -> DataFrame:
    found = kml.kml_features(kml_documents(s, bad=True), "bedrock", "quarantine")
    return found.select(F.col("props")["fid"].cast("bigint").alias("fid"), "error")


@query("read_kmz", "SELECT doc_id AS doc, sha256(text) AS sha256, CAST(NULL AS VARCHAR) AS error FROM documents")
def read_kmz(s: Source) -> DataFrame:
    def pack(batches):
        for part in kml.portions(batches):
            contents = []
            for text in part.column("text"):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("other.kml", "no")
                    archive.writestr("DOC.kml", text.as_py())
                contents.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(contents, pa.binary())], ["doc", "content"])

    packed = s.table("documents").select("doc_id", "text").mapInArrow(pack, "doc BIGINT, content BINARY")
    return kml.kmz_documents(packed).select("doc", F.sha2("kml", 256).alias("sha256"), "error")


@query("read_network_links", """
SELECT CAST(parent_id AS VARCHAR) AS doc, 'Tile ' || doc_id AS name, 'polygons/' || doc_id || '.kml' AS href,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id / 4e0 END AS west, CASE WHEN doc_id % 5 <> 0 THEN doc_id / 4e0 + 1 END AS east
FROM b_links WHERE parent_id IS NOT NULL
""")
def read_network_links(s: Source) -> DataFrame:
    c = F.col
    west = c("doc_id") / 4.0
    box = F.concat(
        F.lit("<Region><LatLonAltBox><north>2</north><south>1</south><east>"), (west + 1).cast("string"),
        F.lit("</east><west>"), F.when(c("doc_id") % 5 == 0, "").otherwise(west.cast("string")),
        F.lit("</west></LatLonAltBox></Region>"))
    link = F.concat(
        F.lit("<NetworkLink><name>Tile "), c("doc_id").cast("string"), F.lit("</name>"), box,
        F.lit("<Link><href> polygons/"), c("doc_id").cast("string"), F.lit(".kml </href></Link></NetworkLink>"))
    rows = s.view("b_links").where("parent_id IS NOT NULL").select("parent_id", "doc_id", link.alias("kml"))
    docs = joined_text(rows, "parent_id", "doc_id", "kml").select(
        c("parent_id").cast("string").alias("doc"), F.concat(F.lit("<kml>"), "kml", F.lit("</kml>")).alias("kml"))
    return kml.network_links(docs).select("doc", "name", "href", "region.west", "region.east")


@query("extract_hrefs", """
SELECT page_id, trim(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages
""")
def extract_hrefs(s: Source) -> DataFrame:
    return kml.extract_hrefs(s.table("pages"), "page_id", "html", 'href="([^"]*)"').select("page_id", "href")


# Each supplier's eight records make one service directory.
SERVICES = f"SELECT n.*, regexp_extract(n.id, ':([0-9]+)-', 1) AS doc, b.west, b.south, b.east, b.north FROM ({NAMES}) n JOIN b_catalog b ON b.id = n.id"


@query("read_arcgis_catalog", f"""
SELECT 'toronto:' || replace(lower(substr(name, 9)), '_', '-') AS id, year, CASE WHEN year % 4 = 1 THEN 0.08e0 END AS resolution_m,
  CASE WHEN copyright_text <> ' City of Toronto ' THEN 'unknown'
    WHEN capabilities LIKE 'Map%' AND formats <> 'PDF' AND size > 0 THEN 'exportable' ELSE 'link-only' END AS policy,
  {rounded('west', 6)} AS west, {rounded('north', 6)} AS north FROM ({SERVICES}) n WHERE year % 4 < 2
""")
def read_arcgis_catalog(s: Source) -> DataFrame:
    found = catalogs.arcgis_catalog(service_documents(s), "toronto")
    return found.select("id", "year", "resolution_m", "policy", F.round("coverage.west", 6).alias("west"),
                        F.round("coverage.north", 6).alias("north"))


def service_documents(s: Source) -> DataFrame:
    c = F.col
    sw, ne = D.web_mercator("west", "south"), D.web_mercator("east", "north")
    meta = F.struct(
        F.struct(sw["x"].alias("xmin"), sw["y"].alias("ymin"), ne["x"].alias("xmax"), ne["y"].alias("ymax"),
                 F.struct(F.lit(102100).alias("wkid"), F.lit(3857).alias("latestWkid")).alias("spatialReference")).alias("fullExtent"),
        c("copyright_text").alias("copyrightText"), "capabilities", c("formats").alias("supportedImageFormatTypes"),
        c("size").alias("maxImageWidth"), c("size").alias("maxImageHeight"))
    # One document per record keeps repeated names of a directory apart.
    return s.sql(SERVICES).select(F.to_json(F.struct(
        F.array(F.struct("name", F.lit("MapServer").alias("type"))).alias("services"),
        F.create_map("name", meta).alias("metadata"))).alias("json"))


@query("read_ottawa_catalog", f"""
SELECT 'ottawa:' || replace(lower(name), '_', '-') AS id, year, {rounded('west', 6)} AS west, 'unknown' AS policy
FROM ({SERVICES}) n WHERE year % 4 = 2
""")
def read_ottawa_catalog(s: Source) -> DataFrame:
    found = catalogs.arcgis_catalog(service_documents(s), "ottawa")
    return found.select("id", "year", F.round("coverage.west", 6).alias("west"), "policy")


ONTARIO_VALUES = ", ".join(
    "(" + ", ".join("'" + v + "'" for v in line.split("|")) + ")"
    for line in catalogs.ONTARIO_COLLECTIONS.strip().splitlines())


@query("read_ontario_catalog", f"""
WITH o AS (SELECT * FROM (VALUES {ONTARIO_VALUES}) t(name, id, year, title))
SELECT o_orderkey AS layer, 'ontario:' || o.id AS id, CAST(o.year AS INT) AS year, o.title FROM orders JOIN o ON o.year = CAST(2010 + o_orderkey % 20 AS VARCHAR)
""")
def read_ontario_catalog(s: Source) -> DataFrame:
    c = F.col
    names = {line.split("|")[2]: line.split("|")[0] for line in catalogs.ONTARIO_COLLECTIONS.strip().splitlines()}
    year = (2010 + c("o_orderkey") % 20).cast("string")
    name = F.coalesce(F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[year], F.lit("Other"))
    extent = F.struct(F.lit(-9000000.0).alias("xmin"), F.lit(5000000.0).alias("ymin"), F.lit(-8000000.0).alias("xmax"),
                      F.lit(6000000.0).alias("ymax"), F.struct(F.lit(3857).alias("wkid")).alias("spatialReference"))
    docs = s.table("orders").select(F.to_json(F.struct(F.array(F.struct(
        c("o_orderkey").alias("id"), name.alias("name"), extent.alias("extent"))).alias("layers"))).alias("json"))
    found = catalogs.arcgis_catalog(docs, "ontario")
    return found.select(F.regexp_extract("source_url", r"(\d+)$", 1).cast("bigint").alias("layer"), "id", "year", "title")


@query("read_wayback_catalog", """
SELECT 'esri-wayback:' || o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE o_orderkey % 4 <> 3
""")
def read_wayback_catalog(s: Source) -> DataFrame:
    c = F.col
    label = F.when(c("o_orderkey") % 4 == 3, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    item = F.struct(label.alias("releaseDateLabel"), c("o_orderkey").alias("releaseNum"), F.lit("https://x").alias("itemURL"))
    docs = s.table("orders").select(
        F.when(c("o_orderkey") % 2 == 0, F.to_json(F.array(item))).otherwise(
            F.to_json(F.create_map(F.lit("a"), item))).alias("json"))
    return catalogs.wayback_catalog(docs).select("id", "year")


@query("read_wms_capabilities", """
SELECT 'L' || s_suppkey AS name, 'Area ' || s_suppkey AS title, CAST(s_suppkey % 30 AS DOUBLE) - 90e0 AS west, CAST(y AS INT) AS year
FROM supplier, (VALUES (1930), (1951)) t(y) WHERE s_suppkey % 6 <> 0
""")
def read_wms_capabilities(s: Source) -> DataFrame:
    c = F.col
    key = c("s_suppkey").cast("string")
    box = F.concat(
        F.lit("<EX_GeographicBoundingBox><westBoundLongitude>"), (c("s_suppkey") % 30 - 90).cast("string"),
        F.lit("</westBoundLongitude><eastBoundLongitude>-10</eastBoundLongitude><southBoundLatitude>40</southBoundLatitude>"
              "<northBoundLatitude>50</northBoundLatitude></EX_GeographicBoundingBox>"))
    times = F.when(c("s_suppkey") % 6 == 0, "1930-13-01T00:00:00Z").otherwise("1930-01-01T00:00:00Z, 1951-06-01T00:00:00Z")
    xml = F.concat(
        F.lit("<WMS_Capabilities><Layer><Title>All</Title><Layer queryable=\"1\"><Name>L"), key, F.lit("</Name><Title>Area "), key,
        F.lit(" / Zone</Title>"), box, F.lit('<Dimension name="time" units="ISO8601">'), times,
        F.lit("</Dimension></Layer><Layer><Name>none</Name></Layer></Layer></WMS_Capabilities>"))
    return catalogs.wms_layers(s.table("supplier").select(xml.alias("xml"))).select(
        "name", "title", "coverage.west", "year")


@query("read_projects", """
SELECT c_custkey AS project_id, CAST(6 AS INT) AS schema_version, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS name,
  CASE WHEN c_custkey % 9 = 0 OR c_custkey % 2 = 1 THEN 100e0 ELSE 175e0 END AS b_extent, CASE WHEN c_custkey % 9 <> 0 THEN 'C' ELSE '' END AS selection,
  (c_custkey % 9 = 0) AS corrupt FROM customer
""")
def read_projects(s: Source) -> DataFrame:
    c = F.col
    figure = F.create_map(F.lit("B"), F.struct(
        F.lit("t").alias("title"), F.when(c("c_custkey") % 2 == 1, 250.0).otherwise(175.0).alias("extent_m")))
    text = F.to_json(F.struct(
        F.lit(2).alias("schema_version"), c("c_name").alias("name"), figure.alias("figures"),
        F.array(F.struct(F.lit("figure").alias("kind"), F.lit("C").alias("key")),
                F.struct(F.lit("historical").alias("kind"), F.lit("gone").alias("key"))).alias("selection")))
    docs = s.table("customer").select(
        c("c_custkey").alias("project_id"), F.when(c("c_custkey") % 9 == 0, "not json").otherwise(text).alias("json"))
    found = records.parse_projects(docs, "project_id")
    return found.select(
        "project_id", "schema_version", "name", c("figures")["B"]["extent_m"].alias("b_extent"),
        F.array_join(F.transform("selection", lambda v: v["key"]), ",").alias("selection"),
        c("_corrupt_record").isNotNull().alias("corrupt"))


@query("read_ocr_documents", f"""
WITH s AS ({SPOTS}), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY drawing_id, x ORDER BY spot_id) - 1 AS pos,
  COUNT(*) OVER (PARTITION BY drawing_id, x) AS n FROM s)
SELECT drawing_id, CAST(x AS BIGINT) AS tile_id, CAST(pos AS INT) AS pos, raw AS text, y AS y0 FROM r
""")
def read_ocr_documents(s: Source) -> DataFrame:
    c = F.col
    box = F.array(*[F.array(c("x") + dx, c("y") + dy) for dx, dy in ((0, 0), (20, 0), (20, 8), (0, 8))])
    spots = s.sql(SPOTS).select("drawing_id", c("x").cast("bigint").alias("tile_id"), "spot_id", "raw", box.alias("box"))
    listed = F.array_sort(F.collect_list(F.struct("spot_id", "raw", "box")))
    docs = spots.groupBy("drawing_id", "tile_id").agg(listed.alias("l")).select(
        "drawing_id", "tile_id", F.to_json(F.struct(
            F.concat(F.transform("l", lambda v: v["raw"]), F.array(F.lit("extra"))).alias("rec_texts"),
            F.transform("l", lambda v: v["box"]).alias("rec_polys"))).alias("json"))
    return records.ocr_tokens(docs).select(
        "drawing_id", "tile_id", "pos", "text", F.get("poly", F.lit(0))["y"].alias("y0"))


@query("read_contour_projects", """
SELECT contour_id AS drawing_id, CAST(0 AS BIGINT) AS contour_id, layer, CAST(3 AS INT) AS points, x3 FROM b_contours
""")
def read_contour_projects(s: Source) -> DataFrame:
    pair = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    docs = contours(s).select(F.col("contour_id").alias("drawing_id"), F.to_json(F.struct(
        F.array(F.struct(pair.alias("points"), "layer")).alias("features"))).alias("json"))
    lines, _ = records.contour_tables(docs)
    return lines.select("drawing_id", "contour_id", "layer", F.size("points").alias("points"),
                        F.get("points", F.lit(2))["x"].alias("x3"))


@query("read_world_files", f"""
SELECT site_id, CASE WHEN site_id % 7 <> 0 THEN x END AS c, CASE WHEN site_id % 7 <> 0 THEN y END AS f,
  CASE WHEN site_id % 7 = 0 THEN 'six-decimals' END AS error FROM ({FRAMES}) w
""")
def read_world_files(s: Source) -> DataFrame:
    c = F.col
    text = F.concat_ws("\r\n", F.lit("0.75"), F.lit(" 0 "), F.lit("0"), F.lit("-7.5e-1"), c("x").cast("string"),
                       F.when(c("site_id") % 7 == 0, "1,5").otherwise(c("y").cast("string")), F.lit(""), F.lit(" "))
    found = records.parse_world_files(s.sql(FRAMES).select("site_id", text.alias("text")))
    return found.select("site_id", F.get("coeffs", F.lit(4)).alias("c"), F.get("coeffs", F.lit(5)).alias("f"), "error")


@query("scan_image_inventory", """
SELECT 'a/' || doc_id AS doc, CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/tiff' END AS mime,
  CASE WHEN doc_id % 4 <> 3 THEN CAST(1 + n_chars % 5000 AS INT) END AS width, CASE WHEN doc_id % 4 <> 3 THEN CAST(300 AS INT) END AS height,
  CASE WHEN doc_id % 4 = 3 THEN 'signature' WHEN doc_id % 5 = 0 AND doc_id % 4 <> 0 THEN 'extension' END AS error FROM documents
""")
def scan_image_inventory(s: Source) -> DataFrame:
    c = F.col
    w = (1 + c("n_chars") % 5000).cast("int")
    w4, w2 = F.lpad(F.hex(w), 8, "0"), F.lpad(F.hex(w), 4, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), w4, F.lit("0000012C"))
    jpeg = F.concat(F.lit("FFD8FFE000040000FFC0000B08012C"), w2, F.lit("010111000000FFD9"))
    tiff = F.concat(F.lit("4D4D002A00000008000201000004000000010"), F.substring(w4, 2, 7), F.lit("0101000300000001012C000000000000"))
    raw = F.unhex(F.when(c("doc_id") % 4 == 0, png).when(c("doc_id") % 4 == 1, jpeg).when(c("doc_id") % 4 == 2, tiff).otherwise("00"))
    ext = F.when((c("doc_id") % 5 == 0) | (c("doc_id") % 4 == 0), ".png").when(c("doc_id") % 4 == 1, ".jpg").otherwise(".tif")
    files = s.table("documents").select(F.concat(F.lit("a/"), c("doc_id").cast("string"), ext).alias("path"), raw.alias("content"))
    found = records.image_inventory(files)
    return found.select(F.regexp_replace("path", r"\.\w+$", "").alias("doc"), "mime", "width", "height", "error")


# Documents of one cache, linked by every form of address: relative, rooted, through dot segments, the publisher's own; some lead
# outside, some to documents that are not there, some are no polygon documents. Two viewports walk from the one root.
CACHE = "https://maps.example.test/site/mrd128-cache/"
WALKED = """SELECT doc_id, parent_id, doc_id % 11 = 7 AS outside, doc_id % 13 = 5 AS gone, doc_id % 17 = 3 AS text_file,
  doc_id % 3 = 0 AS far_east FROM b_links"""


@query("linked_documents", f"""
WITH RECURSIVE l AS ({WALKED}), roots AS (SELECT * FROM (VALUES (1, TRUE), (2, FALSE)) AS t(root_id, east)),
walk AS (SELECT CAST(r.root_id AS BIGINT) AS root_id, r.east, l.doc_id, 0 AS depth, CAST(NULL AS VARCHAR) AS problem FROM l, roots r WHERE l.parent_id IS NULL
  UNION ALL SELECT w.root_id, w.east, l.doc_id, w.depth + 1, CASE WHEN l.outside THEN 'outside' WHEN l.gone THEN 'missing' END
  FROM walk w JOIN l ON l.parent_id = w.doc_id WHERE w.problem IS NULL AND NOT l.text_file AND (w.east OR NOT l.far_east))
SELECT root_id, CASE WHEN problem = 'outside' THEN 'https://other.example.test/mrd128-cache/polygons/' || doc_id || '/doc.kml'
    ELSE '{CACHE}polygons/' || doc_id || '/doc.kml' END AS doc, CAST(depth AS INT) AS depth, problem,
  MAX(CASE WHEN problem IS NULL THEN depth END) OVER r <= 3 AND COUNT(*) FILTER (problem IS NULL) OVER r <= 600 AS within_limits
FROM walk WINDOW r AS (PARTITION BY root_id)
""")
def linked_documents(s: Source) -> DataFrame:
    c = F.col
    number = c("doc_id").cast("string")
    file = F.when(c("text_file"), F.lit("/doc.txt")).otherwise("/doc.kml")
    href = F.when(c("outside"), F.concat(F.lit("//Other.example.test:443/mrd128-cache/polygons/"), number, file)).when(
        c("text_file"), F.concat(F.lit("../"), number, file)).otherwise(F.element_at(F.array(
            F.concat(F.lit("../"), number, F.lit("/doc.kml")),
            F.concat(F.lit("/site/mrd128-cache/polygons/"), number, F.lit("/doc.kml")),
            F.concat(F.lit("a/./%2e%2E/../x/../"), number, F.lit("/doc.kml")),
            F.concat(F.lit("http://www.geologyontario.mndm.gov.on.ca/mines/data/google/mrd128/polygons/"), number, F.lit("/doc.kml"))),
            (c("doc_id") % 4 + 1).cast("int")))
    region = F.when(c("far_east"), F.lit("<Region><LatLonAltBox><north>9</north><south>1</south><east>9</east><west>6</west></LatLonAltBox></Region>")).otherwise("")
    link = F.concat(F.lit("<NetworkLink><name>t</name>"), region, F.lit("<Link><href> "), href, F.lit("\n</href></Link></NetworkLink>"))
    rows = s.sql(WALKED)
    children = joined_text(rows.where("parent_id IS NOT NULL").select("parent_id", "doc_id", link.alias("kml")), "parent_id", "doc_id", "kml")
    docs = rows.where("NOT (outside OR gone)").select(c("doc_id").alias("parent_id")).join(children, "parent_id", "left").select(
        F.concat(F.lit(f"{CACHE}polygons/"), c("parent_id").cast("string"), F.lit("/doc.kml")).alias("doc"),
        F.concat(F.lit("<kml>"), F.coalesce("kml", F.lit("")), F.lit("</kml>")).alias("kml"))
    views = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("root_id"), F.lit(e).alias("east")) for i, e in ((1, 9.0), (2, 5.0))]))
    roots = rows.where("parent_id IS NULL").select(F.concat(F.lit(f"{CACHE}polygons/"), number, F.lit("/doc.kml")).alias("doc"),
        views.alias("v")).select("v.root_id", "doc", G.bounds(F.lit(0.0), F.lit(0.0), F.col("v.east"), F.lit(9.0)).alias("view"))
    found = links.document_links(kml.network_links(docs), CACHE)
    return links.linked_documents(found, docs, roots, "view", max_depth=3)


# Whole saved projects, written as text: every known field, fields that no version knows, old versions and wrong records.
_ID = "00000000-0000-4000-8000-"
SAVED_DOCS = f"""SELECT c_custkey AS project_id, CASE WHEN c_custkey % 17 = 0 THEN '[1, 2' ELSE concat(
  '{{"schemaVersion":', CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE CAST(c_custkey % 5 AS STRING) END, ',"id":"p', c_custkey, '","name":',
  CASE WHEN c_custkey % 13 = 0 THEN '7' ELSE concat('"', c_name, '"') END, ',"projectNo":"P-1","date":"2024-02-29","address":"Main St","company":"Old Co",',
  '"location":', CASE WHEN c_custkey % 7 = 0 THEN 'null' WHEN c_custkey % 11 = 0 THEN '{{"lat":95,"lng":-80.25}}' ELSE '{{"lat":43.5,"lng":-80.25}}' END,
  ',"siteBoundary":[[-80.5,43.25],[-80,43.25],[-80,43.75],[-80.5,43.25]],"annotations":[{{"id":"n1","figureCode":"B","text":"Former tank","position":{{"lat":43.5,"lng":-80}},',
  '"target":', CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '{{"lat":44,"lng":-81}}' END, ',"mask":', CASE WHEN c_custkey % 19 = 0 THEN 'false' ELSE 'true' END, '}}],',
  '"historical":[{{"id":"{_ID}', lpad(CAST(c_custkey AS STRING), 12, '0'), '","year":1972,"sequence":', c_custkey % 4, ',"title":"Flight","mode":"official","providerId":"toronto",',
  '"sourceUrl":"https://maps.example.org/a","licenseUrl":"https://maps.example.org/l","attribution":"City","policy":"exportable","resolutionMeters":0.5,',
  '"bounds":{{"north":43.75,"south":43.25,"east":-80,"west":-80.5}},"placement":null,"assetId":null,"officialExport":{{"kind":"arcgis-export","url":"https://maps.example.org/e",',
  '"layer":"0","maxWidth":4096,"maxHeight":', 1000 + c_custkey % 9, ',"resultId":"toronto:x","coverage":{{"north":44,"south":43,"east":-79,"west":-81}},"preview":null}},',
  '"createdAt":"2024-05-01T10:00:00Z","updatedAt":"2024-05-01T11:00:00Z"}},{{"id":"old","year":1950,"name":"scan.png","size":', c_custkey + 1, ',"dataUrl":"data:image/png;base64,AA=="}}],',
  '"historicalSequenceCounters":{{"1972":2,"', CASE WHEN c_custkey % 23 = 0 THEN '2150' ELSE '1980' END, '":', c_custkey % 6, '}},"dpi":', 150 + c_custkey % 2 * 150, ',',
  '"geology":{{"surficial":null,"bedrock":{{"name":"', CASE WHEN c_custkey % 2 = 0 THEN 'mine.KMZ' ELSE 'table' END, '","count":', c_custkey, '}}}},',
  '"figures":{{"B":{{"title":"Plan","extentMeters":250,"status":"Done","bounds":{{"north":43.75,"south":', CASE WHEN c_custkey % 29 = 0 THEN '43.6' ELSE '43.25' END,
  ',"east":-80,"west":-80.5}},"grid":[', c_custkey % 10, ']}}}},"companyProfileSnapshot":{{"companyName":"Example Ltd","address":"Main St","phone":"1","email":"a@example.org",',
  '"website":"example.org","logoAssetId":"logo","logoMime":"image/png","logoWidth":', c_custkey % 8, ',"logoHeight":10,"logoPlacement":{{"align":"left","scale":1}}}},',
  '"exportPreferences":{{"codes":["E"],"selection":[{{"kind":"historical","id":"old"}},{{"kind":"figure","code":"D"}},{{"kind":"figure","code":"Z"}},',
  '{{"kind":"figure","code":"A","more":1}},4,{{"kind":"historical","id":"{_ID}', lpad(CAST(c_custkey AS STRING), 12, '0'), '"}},{{"kind":"figure","code":"B"}}]}},',
  '"createdAt":"2024-01-01T00:00:00Z","updatedAt":"2024-01-02T00:00:00Z","reviewer":{{"name":"R', c_custkey % 3, '"}}}}') END AS json FROM customer"""
_OLD = "(c_custkey % 5 IN (0, 1, 2))"


def saved_docs(s: Source) -> DataFrame:
    """The documents, written by many tasks: their keys fit one small file."""
    s.table("customer").select("c_custkey", "c_name").repartition("c_custkey").createOrReplaceTempView("saved_keys")
    return s.sql(SAVED_DOCS.replace("FROM customer", "FROM saved_keys"))


@query("restore_projects", f"""
WITH p AS (SELECT *, c_custkey % 17 <> 0 AS ok FROM customer)
SELECT c_custkey AS project_id, CAST(6 AS INT) AS schema_version, CASE WHEN ok THEN 'p' || c_custkey END AS id,
  CASE WHEN ok AND c_custkey % 13 <> 0 THEN c_name ELSE '' END AS name, CASE WHEN ok THEN 'P-1|2024-02-29|Main St|Old Co' ELSE '|||' END AS texts,
  CASE WHEN ok AND c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 11 = 0 THEN 95e0 ELSE 43.5e0 END END AS lat, CASE WHEN ok THEN -80e0 END AS corner_x,
  CASE WHEN ok THEN 'n1|B|Former tank|' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '44.0' END || '|' || (c_custkey % 19 <> 0) END AS note,
  CASE WHEN ok THEN c_custkey % 4 END AS sequence, CASE WHEN ok THEN 'official|toronto|City|0.5|43.75|arcgis-export|' || (1000 + c_custkey % 9) || '|-81.0|2024-05-01T11:00:00Z' END AS item,
  CASE WHEN ok THEN 'scan.png|' || (c_custkey + 1) || '|data:image/png;base64,AA==' END AS legacy,
  CASE WHEN ok THEN '1972:' || greatest(2, c_custkey % 4) || ',' || CASE WHEN c_custkey % 23 = 0 THEN 2150 ELSE 1980 END || ':' || c_custkey % 6 ELSE '' END AS counters,
  CASE WHEN ok THEN 'Plan|Done|43.75|' || c_custkey % 10 ELSE 'CURRENT AERIAL / SITE PLAN|Not Started||' END AS figure_b,
  CASE WHEN ok AND NOT {_OLD} THEN 250e0 ELSE 100e0 END AS b_extent, 20000e0 AS e_extent, CAST(CASE WHEN ok THEN 150 + c_custkey % 2 * 150 ELSE 300 END AS INT) AS dpi,
  CASE WHEN ok THEN CASE WHEN c_custkey % 2 = 0 THEN 'mine.KMZ|custom|Custom import: mine.KMZ|unknown|false|' ELSE 'table|||||' END || c_custkey ELSE '' END AS bedrock,
  CASE WHEN ok THEN 'Example Ltd|' || CAST(c_custkey % 8 AS DOUBLE) || '|left|1.0' ELSE '|||' END AS company,
  CASE WHEN ok THEN 'B,D,old,{_ID}' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') ELSE '' END AS selection,
  CASE WHEN ok THEN '2024-01-01T00:00:00Z|2024-01-02T00:00:00Z' ELSE '|' END AS stamps, CASE WHEN ok THEN 'R' || c_custkey % 3 END AS reviewer,
  concat_ws(',', CASE WHEN NOT ok THEN 'document' END, CASE WHEN ok AND c_custkey % 13 = 0 THEN 'text-fields' END,
    CASE WHEN ok AND c_custkey % 7 <> 0 AND c_custkey % 11 = 0 THEN 'location' END, CASE WHEN ok AND c_custkey % 23 = 0 THEN 'counters' END,
    CASE WHEN ok AND ((c_custkey % 29 = 0 AND c_custkey % 7 <> 0) OR (c_custkey % 7 <> 0 AND c_custkey % 11 = 0)) THEN 'figure-bounds' END) AS violations,
  TRUE AS comes_back FROM p
""")
def restore_projects(s: Source) -> DataFrame:
    # Records stay beside their texts from reading to writing again, so nothing is joined.
    found = saved_projects.restore_projects(saved_docs(s))
    first = F.struct(*[c for c in found.columns if c != "project_id"]).alias("first")
    again = saved_projects.restore_projects(saved_projects.project_json(found, keep=[first]).withColumnRenamed("json", "text"), json="text", keep=["first", "text"])
    rows = saved_projects.project_json(again, keep=["first", "text"]).select("project_id", "first.*", "text", F.col("json").alias("again"))
    parts = lambda *columns: F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    note, item, old = F.try_element_at("annotations", F.lit(1)), F.try_element_at("historical", F.lit(1)), F.try_element_at("historical", F.lit(2))
    b, e, rock, firm = F.col("figures")["B"], F.col("figures")["E"], F.col("geology")["bedrock"], F.col("company_profile")
    counters = F.transform(F.array_sort(F.map_entries("historical_counters")), lambda c: F.concat_ws(":", c["key"], c["value"]))
    return rows.select(
        "project_id", "schema_version", "id", "name", parts(F.col("project_no"), F.col("date"), F.col("address"), F.col("company")).alias("texts"),
        F.col("location.lat").alias("lat"), F.try_element_at(F.try_element_at("site_boundary", F.lit(2)), F.lit(1)).alias("corner_x"),
        F.when(note.isNotNull(), parts(note["id"], note["figureCode"], note["text"], note["target"]["lat"], note["mask"])).alias("note"),
        item["sequence"].alias("sequence"),
        F.when(item.isNotNull(), parts(item["mode"], item["providerId"], item["attribution"], item["resolutionMeters"], item["bounds"]["north"], item["officialExport"]["kind"],
                                       item["officialExport"]["maxHeight"], item["officialExport"]["coverage"]["west"], item["updatedAt"])).alias("item"),
        F.when(old.isNotNull(), parts(old["name"], old["size"], old["dataUrl"])).alias("legacy"), F.array_join(counters, ",").alias("counters"),
        parts(b["title"], b["status"], b["bounds"]["north"], F.try_variant_get(b["extra"]["grid"], "$[0]", "int")).alias("figure_b"),
        b["extent_m"].alias("b_extent"), e["extent_m"].alias("e_extent"), "dpi",
        F.when(rock.isNotNull(), parts(rock["name"], rock["source"]["id"], rock["source"]["name"], rock["source"]["acquisitionYearVerification"],
                                       rock["source"]["permissionConfirmed"], F.try_variant_get(rock["extra"]["count"], "$", "bigint"))).otherwise("").alias("bedrock"),
        parts(firm["companyName"], firm["logoWidth"], firm["logoPlacement"]["align"], firm["logoPlacement"]["scale"]).alias("company"),
        F.array_join(F.transform("selection", lambda v: v["key"]), ",").alias("selection"), parts(F.col("created_at"), F.col("updated_at")).alias("stamps"),
        F.try_variant_get(F.col("extra")["reviewer"], "$.name", "string").alias("reviewer"),
        F.array_join("violations", ",").alias("violations"), (F.col("text") == F.col("again")).alias("comes_back"))


@query("saved_project_rules", f"""
WITH p AS (SELECT c_custkey AS project_id, c_name, c_custkey % 17 <> 0 AS ok, c_custkey AS k FROM customer),
v1 AS (SELECT project_id, 'V1 ' || unnest(list_filter([
    CASE WHEN NOT ok OR k % 13 = 0 THEN 'project-name' END, CASE WHEN NOT ok THEN 'project-number' END, CASE WHEN NOT ok THEN 'project-date' END,
    CASE WHEN NOT ok THEN 'address' END, CASE WHEN NOT ok OR k % 7 = 0 OR k % 11 = 0 THEN 'location' END,
    CASE WHEN ok AND k % 8 = 0 THEN 'company-logo-record' END, CASE WHEN NOT ok OR k % 7 = 0 OR k % 11 = 0 THEN 'site-boundary' END], lambda x: x IS NOT NULL)) AS rule FROM p),
firm AS (SELECT project_id, 'V1 ' || unnest(['company-name', 'company-address', 'company-phone', 'company-email', 'company-website', 'company-logo', 'company-logo-placement']) AS rule
  FROM p WHERE NOT ok),
v6 AS (SELECT project_id, 'V6 ' || unnest(list_filter([CASE WHEN k % 4 = 0 THEN 'sequence' END,
    CASE WHEN k % 7 <> 0 AND k % 11 = 0 THEN 'bounds' END], lambda x: x IS NOT NULL)) AS rule FROM p WHERE ok),
v7 AS (SELECT project_id, 'V7 mask' AS rule FROM p WHERE ok AND k % 19 = 0),
a6 AS (SELECT project_id, 'A6 1972 ' || greatest(2, k % 4) AS rule FROM p WHERE ok)
SELECT * FROM v1 UNION ALL SELECT * FROM firm UNION ALL SELECT * FROM v6 UNION ALL SELECT * FROM v7 UNION ALL SELECT * FROM a6
""")
def saved_project_rules(s: Source) -> DataFrame:
    # Parsing is the work, so it is done once for all rules, on the columns they read.
    found = durable(saved_projects.restore_projects(saved_docs(s)).select(
        "project_id", *saved_projects.TEXTS, "location", "company_profile", "site_boundary", "geology", "annotations", "historical", "historical_counters"))
    broken = lambda df, rule: df.select("project_id", F.explode("violations").alias("rule")).withColumn("rule", F.concat(F.lit(f"{rule} "), "rule"))
    sheets = saved_projects.print_rows(found).where("figure = 'B'")
    items = saved_projects.item_rows(found)
    counted = projects.sequence_counters(items, saved_projects.counter_rows(found)).where("year = 1972")
    return broken(rules.print_requirements(sheets), "V1").union(broken(rules.validate_historical(items, 2026), "V6")).union(
        broken(rules.validate_annotations(saved_projects.note_rows(found)), "V7")).union(
        counted.select("project_id", F.concat(F.lit("A6 1972 "), F.col("counter").cast("string"))))
