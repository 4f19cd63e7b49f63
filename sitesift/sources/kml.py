"""KML and KMZ documents as tables of polygons and links.

A document is one row (doc_seq, doc, kml). Its Placemark, Style, StyleMap and
NetworkLink elements are cut out as text, dealt out by (doc, pos), and parsed by
``from_xml``, so the parsing spreads over the elements and not only over the files.
Comments do not count, and tags may carry a namespace prefix.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.functions import geometry as G
from sitesift.functions import text as X
from sitesift.operators import legends, links
from sitesift.operators.numbering import number_rows

# Defaults of an unstyled unit.
DEFAULT_NAME = "Geology unit"
DEFAULT_COLOR, DEFAULT_OPACITY, OFFICIAL_OPACITY = "#5fa8d3", 0.5, 0.6

_RING = "STRUCT<LinearRing: STRUCT<coordinates: STRING>>"
_POLYGON = (f"STRUCT<outerBoundaryIs: ARRAY<{_RING}>, "
            "innerBoundaryIs: ARRAY<STRUCT<LinearRing: ARRAY<STRUCT<coordinates: STRING>>>>>")
POLYGON = _POLYGON[len("STRUCT<"):-1].replace("outerBoundaryIs: ", "outerBoundaryIs ").replace(
    "innerBoundaryIs: ", "innerBoundaryIs ")
PLACEMARK = (
    "name STRING, description STRING, styleUrl STRING, "
    "Style STRUCT<PolyStyle: STRUCT<color: STRING>>, "
    "ExtendedData STRUCT<Data: ARRAY<STRUCT<_name: STRING, value: STRING>>, SchemaData: "
    "STRUCT<SimpleData: ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>>>")
#: Archives unpacked between two batches that go out.
DOCUMENTS = 64
STYLE = "_id STRING, PolyStyle STRUCT<color: STRING>"
STYLE_MAP = "_id STRING, Pair ARRAY<STRUCT<key: STRING, styleUrl: STRING>>"
_BOX = "STRUCT<LatLonAltBox: STRUCT<north: STRING, south: STRING, east: STRING, west: STRING>>"
NETWORK_LINK = (f"name STRING, Region {_BOX}, Link STRUCT<href: STRING>, Url STRUCT<href: STRING>")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """KML files as (doc, kml)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc"), F.col("value").alias("kml"))


def _main_kml(content: bytes, strict: bool) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [i for i in archive.infolist() if i.filename.lower().endswith(".kml") and not i.is_dir()]
        if not names or (strict and len(names) != 1):
            raise ValueError("one KML document is needed")
        main = next((i for i in names if i.filename.lower() == "doc.kml"), names[0])
        return archive.read(main).decode("utf-8")


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, so that no more documents than these are held in other forms beside their batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, DOCUMENTS):
            yield batch.slice(start, DOCUMENTS)


def kmz_documents(files: DataFrame, strict: bool = False) -> DataFrame:
    """(doc, kml, error) of KMZ archives (doc, content): doc.kml in any case,
    else the first KML; ``strict`` wants exactly one.

    Unzipping is per file, in tasks; DOCUMENTS files are held in other forms at once.
    """

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            texts, errors = [], []
            for content in part.column("content"):
                try:
                    texts.append(_main_kml(content.as_py(), strict))
                    errors.append(None)
                except Exception as error:
                    texts.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["doc", "kml", "error"])

    kind = dict(files.dtypes)["doc"]
    return files.select("doc", "content").mapInArrow(
        unzip, f"doc {kind}, kml STRING, error STRING")


def read_kmz(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``kmz_documents`` of files, of any size."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content")
    return kmz_documents(files, strict)


def blocks_of(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.lit(0))


def plain_tags(text: Column) -> Column:
    """The text without comments and without namespace prefixes of its tags."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, r"(</?)[A-Za-z_][\w.-]*:(?=[A-Za-z_])", "$1")


def elements(docs: DataFrame, tag: str, schema: str) -> DataFrame:
    """(doc, pos, block, e): the ``tag`` elements of each document in order, parsed."""
    blocks = blocks_of(plain_tags(F.col("kml")), tag)
    dealt = docs.select("doc", F.posexplode(blocks).alias("pos", "block")).repartition("doc", "pos")
    return dealt.select("doc", "pos", "block", F.from_xml("block", schema).alias("e"))


def style_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shared styles (doc, style_id, color, opacity) and style maps (doc, style_id, target).

    Of several with one id in a document the last stands.
    """
    color = X.kml_color("e.PolyStyle.color")
    styles = elements(docs, "Style", STYLE).where("e._id IS NOT NULL").select(
        "doc", "pos", F.col("e._id").alias("style_id"), color.alias("_c")).where(
        F.col("_c").isNotNull()).groupBy("doc", "style_id").agg(
        F.max_by("_c", "pos").alias("_c")).select("doc", "style_id", "_c.*")
    normal = F.filter("e.Pair", lambda p: F.trim(p["key"]) == "normal")
    target = F.regexp_replace(F.trim(F.get(normal, F.lit(0))["styleUrl"]), "^#", "")
    maps = elements(docs, "StyleMap", STYLE_MAP).where("e._id IS NOT NULL").groupBy(
        "doc", F.col("e._id").alias("style_id")).agg(F.max_by(target, "pos").alias("target"))
    return styles, maps


def ring_of(coordinates: Column) -> Column:
    """Closed ring of a coordinate text; unusable tuples go, below three points nothing stays."""
    tuples = F.transform(F.split(F.trim(coordinates), r"\s+"), lambda t: F.split(t, ","))
    points = F.transform(tuples, lambda v: G.point(
        F.get(v, F.lit(0)).try_cast("double"), F.get(v, F.lit(1)).try_cast("double")))
    usable = F.filter(points, lambda p: G.valid_location(p["y"], p["x"]))
    none = F.array().cast("array<struct<x:double,y:double>>")
    return G.let(usable, lambda r: F.when(
        G.distinct_vertices(r) >= 3, G.close_ring(r)).otherwise(none))


def _bad_tuples(coordinates: Column) -> Column:
    """A tuple without two or three numbers, or no tuple at all."""
    tuples = F.transform(F.split(F.trim(coordinates), r"\s+"), lambda t: F.split(t, ","))
    return F.coalesce(F.exists(tuples, lambda v: ~F.size(v).between(2, 3) | F.exists(
        v, lambda n: n.try_cast("double").isNull())), F.lit(True))


def _properties() -> Column:
    none = F.array().cast("array<struct<k:string,v:string>>")
    plain = F.transform("e.ExtendedData.Data", lambda d: F.struct(
        F.lower(d["_name"]).alias("k"), F.trim(d["value"]).alias("v")))
    simple = F.transform("e.ExtendedData.SchemaData.SimpleData", lambda d: F.struct(
        F.lower(d["_name"]).alias("k"), F.trim(d["_VALUE"]).alias("v")))
    return G.let(
        F.concat(F.coalesce(plain, none), F.coalesce(simple, none)),
        # The last entry of a repeated key stands.
        lambda all_: F.map_from_entries(F.filter(all_, lambda d, i: d["k"].isNotNull() & ~F.exists(
            F.slice(all_, i + 2, F.size(all_)), lambda later: later["k"] == d["k"]))))


def _polygons(docs: DataFrame) -> DataFrame:
    marks = elements(docs, "Placemark", PLACEMARK)
    # Every polygon inside the placemark, however its geometries are nested.
    props = marks.select("doc", "pos", "e", _properties().alias("props"),
                         blocks_of(F.col("block"), "Polygon").alias("_all"))
    # The generator stays in a select of its own: next to it, struct fields lose
    # their names.
    parts = props.select("doc", "pos", "props", "e", F.posexplode("_all").alias("part", "_text")).select(
        "doc", "pos", "props", "e", "part", F.from_xml("_text", POLYGON).alias("p"))
    return parts.select(
        "doc", "pos", "props", "part", "p",
        F.coalesce(F.nullif(F.trim("e.name"), F.lit("")), F.lit(DEFAULT_NAME)).alias("name"),
        X.strip_html(F.coalesce("e.description", F.lit(""))).alias("description"),
        X.kml_color("e.Style.PolyStyle.color").alias("_inline"),
        F.regexp_replace(F.trim("e.styleUrl"), "^#", "").alias("style_id"))


def kml_features(docs: DataFrame, kind: str = "surficial", mode: str = "failfast") -> DataFrame:
    """One row per polygon, in source order (``feature_seq``), with official
    legend texts where the unit is known; ``docs`` has doc, kml and optionally
    doc_seq. The numbers run without a gap over all documents, in the order
    of doc_seq, doc, placemark and polygon.

    A polygon with an unusable hole fails the job, or with ``mode="quarantine"``
    is left in with its ``error``. For ``kind="bedrock"`` every tuple and ring
    must be valid.
    """
    if "doc_seq" not in docs.columns:
        docs = docs.withColumn("doc_seq", F.lit(0).cast("bigint"))
    outer_texts = F.transform("p.outerBoundaryIs", lambda r: r["LinearRing"]["coordinates"])
    inner_texts = F.flatten(F.transform(
        F.coalesce("p.innerBoundaryIs", F.array().cast(
            "array<struct<LinearRing:array<struct<coordinates:string>>>>")),
        lambda r: F.transform(r["LinearRing"], lambda x: x["coordinates"])))
    shaped = _polygons(docs).withColumn("_outers", outer_texts).withColumn("_inners", inner_texts)
    shaped = shaped.withColumn("polygon", ring_of(F.get("_outers", F.lit(0)))).withColumn(
        "holes", F.transform("_inners", ring_of))
    bad = F.when(F.exists("holes", lambda h: F.size(h) == 0), "invalid-hole")
    if kind == "bedrock":
        zero = lambda ring: F.coalesce(G.ring_area(ring) == 0, F.lit(True))
        bad = (
            F.when(F.coalesce(F.size("_outers"), F.lit(0)) != 1, "outer-count")
            .when(F.exists(F.concat("_outers", "_inners"), _bad_tuples), "coordinates")
            .when(F.size("polygon") == 0, "outer-ring").when(zero(F.col("polygon")), "zero-area")
            .when(F.exists("holes", zero), "zero-area-hole").otherwise(bad))
    else:
        shaped = shaped.where(F.size("polygon") > 0)
    shaped = shaped.withColumn("error", bad).drop("_outers", "_inners", "p")
    if mode == "failfast":
        shaped = shaped.withColumn("error", F.when(
            F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("KML polygon: "), "error"))))
    given = [F.nullif(F.try_element_at("props", F.lit(k)), F.lit(""))
             for k in ("unit_code", "unit", "sgu", "map_unit")]
    own = F.coalesce(given[0], given[1])
    if kind == "surficial":
        code = X.surficial_code(F.coalesce(*given, "name"))
        legend = legends.surficial_legend(docs.sparkSession)
    else:
        code = X.bedrock_code(F.coalesce(own, F.col("name")))
        legend = legends.bedrock_legend(docs.sparkSession)
    coded = legends.legend_lookup(
        shaped.withColumn("code", code).withColumn("_own", own)
        .withColumnRenamed("name", "_name").withColumnRenamed("description", "_description"),
        legend.withColumnRenamed("color", "_legend_color"))
    styles, maps = style_tables(docs)
    resolved = links.resolve_styles(styles, maps).select(
        "doc", "style_id", F.col("color").alias("_style_color"), F.col("opacity").alias("_style_opacity"))
    styled = coded.join(resolved, ["doc", "style_id"], "left").join(
        docs.select("doc", "doc_seq"), "doc")
    official = F.col("title").isNotNull()
    place = [F.col(c) for c in ("doc_seq", "doc", "pos", "part")]
    numbered = number_rows(styled, [], None, place, "_nth")
    return numbered.select(
        (F.col("_nth") - 1).alias("feature_seq"), "doc",
        F.when(official, F.concat(F.upper("code"), F.lit(" — "), "title")).otherwise(F.col("_name"))
        .alias("name"),
        F.when(official, legends.unit_description("material", "detail"))
        .otherwise(F.col("_description")).alias("description"),
        F.coalesce("code", "_own").alias("unit_code"), "props",
        F.coalesce("_legend_color", F.col("_inline.color"), "_style_color", F.lit(DEFAULT_COLOR))
        .alias("color"),
        F.when(official, OFFICIAL_OPACITY).otherwise(F.coalesce(
            F.col("_inline.opacity"), "_style_opacity", F.lit(DEFAULT_OPACITY))).alias("fill_opacity"),
        "polygon", "holes", "error")


def read_kml_polygons(spark: SparkSession, path: str, kind: str = "surficial",
                      mode: str = "failfast") -> DataFrame:
    return kml_features(read_documents(spark, path), kind, mode)


def read_bedrock_kml(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    return read_kml_polygons(spark, path, "bedrock", mode)


def network_links(docs: DataFrame) -> DataFrame:
    """(doc, pos, name, href, region) of every NetworkLink with an address.

    ``region`` is null unless all four sides are finite numbers.
    """
    box = F.col("e.Region.LatLonAltBox")
    sides = {k: F.trim(box[k]).try_cast("double") for k in ("west", "south", "east", "north")}
    whole = sides["west"].isNotNull()
    for side in sides.values():
        whole = whole & side.isNotNull() & (F.abs(side) < float("inf"))
    href = F.trim(F.coalesce("e.Link.href", "e.Url.href", F.lit("")))
    return elements(docs, "NetworkLink", NETWORK_LINK).select(
        "doc", "pos", F.trim(F.coalesce("e.name", F.lit(""))).alias("name"), href.alias("href"),
        F.when(whole, G.bounds(**sides)).alias("region")).where("href <> ''")


def read_network_links(spark: SparkSession, path: str) -> DataFrame:
    return network_links(read_documents(spark, path))


def extract_hrefs(texts: DataFrame, key: str, text: str,
                  pattern: str = r"(?i)<href>\s*([^<]+?)\s*</href>") -> DataFrame:
    """(key, pos, href) of every address in a text."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    return texts.select(key, F.posexplode(found).alias("pos", "href")).withColumn(
        "href", F.trim("href"))
