"""Harvested service descriptions as imagery catalog rows (``schemas.CATALOG``).

Each source takes a table of documents that were fetched elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geodesy as D
from sitesift.functions import geometry as G
from sitesift.functions import text as X

# Addresses, licences and collections of the public providers.
TORONTO_ROOT = "https://gis.toronto.ca/arcgis/rest/services/basemap/"
OTTAWA_ROOT = "https://maps.ottawa.ca/arcgis/rest/services/"
ONTARIO_SOURCE = ("https://ws.lioservices.lrc.gov.on.ca/arcgis2/rest/services/LIO_Imagery/"
                  "Ontario_Imagery_Web_Map_Service_Source/MapServer")
LICENSES = {
    "toronto": "https://open.toronto.ca/open-data-licence/",
    "ottawa": "https://ottawa.ca/en/city-hall/open-transparent-and-accountable-government/"
              "open-data/open-data-licence-version-20",
    "ontario": "https://www.ontario.ca/page/open-government-licence-ontario",
    "napl": "https://open.canada.ca/en/open-government-licence-canada",
    "esri-wayback": "https://www.arcgis.com/home/item.html?id=10df2279f9684e4a9f6a7f08febac2a9",
}
ATTRIBUTIONS = {
    "toronto": "City of Toronto", "ottawa": "City of Ottawa", "ontario": "Government of Ontario",
    "napl": "Natural Resources Canada — National Air Photo Library",
    "esri-wayback": "Esri World Imagery Wayback",
}
# layer name|id|year|title
ONTARIO_COLLECTIONS = """\
South_Western_Ontario_Orthophotography_SWOOP_2025_Aerial|swoop-2025|2025|South Western Ontario Orthophotography 2025
Digital Raster Acquisition Project East 2024 (Aerial)|drape-2024|2024|Digital Raster Acquisition Project East 2024
South Central Ontario Orthophotography 2023 (Aerial)|scoop-2023|2023|South Central Ontario Orthophotography 2023
North Western Ontario Orthophotography Project 2022 (Aerial)|nwoop-2022|2022|North Western Ontario Orthophotography Project 2022
Central Ontario Orthophotography Project 2021 (Aerial)|coop-2021|2021|Central Ontario Orthophotography Project 2021
Northwestern Ontario Orthophotography Project 2017 (Aerial)|nwoop-2017|2017|Northwestern Ontario Orthophotography Project 2017
Central Ontario Orthophotography Project 2016 (Aerial)|coop-2016|2016|Central Ontario Orthophotography Project 2016
Algonquin Orthophotography 2015 (Aerial)|algonquin-2015|2015|Algonquin Orthophotography 2015
Digital Raster Acquisition Project East 2014 (Aerial)|drape-2014|2014|Digital Raster Acquisition Project East 2014
"""
NAPL_CAPABILITIES = ("https://datacube.services.geo.ca/web/aerial.xml"
                     "?request=GetCapabilities&service=WMS&version=1.3.0")
NAPL_SERVICE = "https://datacube.services.geo.ca/ows/aerial"
WAYBACK_APP = "https://livingatlas.arcgis.com/wayback/"
MAX_EXPORT = 4096

_EXTENT = ("STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE, "
           "spatialReference: STRUCT<wkid: INT, latestWkid: INT>>")
_SERVICE = (f"STRUCT<fullExtent: {_EXTENT}, copyrightText: STRING, capabilities: STRING, "
            "supportedImageFormatTypes: STRING, maxImageWidth: INT, maxImageHeight: INT>")
DIRECTORY = (f"services ARRAY<STRUCT<name: STRING, type: STRING>>, metadata MAP<STRING, {_SERVICE}>, "
             f"layers ARRAY<STRUCT<id: INT, name: STRING, extent: {_EXTENT}, fullExtent: {_EXTENT}>>")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _coverage(extent: Column) -> Column:
    flat = F.struct(
        extent["xmin"].alias("xmin"), extent["ymin"].alias("ymin"), extent["xmax"].alias("xmax"),
        extent["ymax"].alias("ymax"), F.coalesce(
            extent["spatialReference"]["latestWkid"], extent["spatialReference"]["wkid"]).alias("wkid"))
    return D.extent_to_coverage(flat)


def _preview(kind: Column, url: Column, template: Column | None = None) -> Column:
    return F.struct(
        kind.alias("kind"), url.alias("url"), _null("string").alias("layer"),
        (_null("string") if template is None else template).alias("tile_template"))


def _export(kind: str, url: Column, width: Column, height: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), url.alias("url"), _null("string").alias("layer"),
        width.cast("int").alias("max_width"), height.cast("int").alias("max_height"))


def _rows(df: DataFrame, provider: str, **columns: Column) -> DataFrame:
    order = ("id", "provider_id", "title", "year", "resolution_m", "coverage", "preview", "export",
             "policy", "source_url", "license_url", "attribution")
    fixed = {
        "provider_id": F.lit(provider), "license_url": F.lit(LICENSES[provider]),
        "attribution": F.lit(ATTRIBUTIONS[provider]), "resolution_m": _null("double"),
        "export": _null("struct<kind:string,url:string,layer:string,max_width:int,max_height:int>")}
    made = {**fixed, **columns}
    return df.select(*[made[c].alias(c) for c in order])


def arcgis_catalog(docs: DataFrame, provider: str) -> DataFrame:
    """Rows of a map-service directory (column json) by the provider's naming rule.

    Services whose footprint is missing or not Web Mercator are left out.
    """
    parsed = docs.select(F.from_json("json", DIRECTORY).alias("d"))
    if provider == "ontario":
        listed = [line.split("|") for line in ONTARIO_COLLECTIONS.strip().splitlines()]
        open_layers = docs.sparkSession.createDataFrame(
            [(n, i, int(y), t) for n, i, y, t in listed],
            "name STRING, id STRING, year INT, title STRING")
        layers = parsed.select(F.explode("d.layers").alias("l")).select(
            "l.name", F.col("l.id").alias("layer_id"),
            _coverage(F.coalesce("l.extent", "l.fullExtent")).alias("coverage"))
        found = layers.where("coverage IS NOT NULL AND layer_id IS NOT NULL").join(open_layers, "name")
        url = F.concat(F.lit(ONTARIO_SOURCE + "/"), F.col("layer_id").cast("string"))
        return _rows(
            found, provider, id=F.concat(F.lit("ontario:"), "id"), title=F.col("title"),
            year=F.col("year"), coverage=F.col("coverage"), source_url=url,
            preview=_preview(F.lit("official-link"), url), policy=F.lit("link-only"))
    services = parsed.select("d.metadata", F.explode("d.services").alias("s")).where(
        "s.type = 'MapServer'").select(
        F.col("s.name").alias("name"), F.try_element_at("metadata", F.col("s.name")).alias("m"),
        X.service_name_year("s.name", provider).alias("n")).where("n IS NOT NULL")
    placed = services.withColumn("coverage", _coverage(F.col("m.fullExtent"))).where(
        "coverage IS NOT NULL")
    leaf = F.regexp_replace("name", "^basemap/", "")
    identity = F.replace(F.lower(leaf), F.lit("_"), F.lit("-"))
    if provider == "ottawa":
        url = F.concat(F.lit(OTTAWA_ROOT), "name", F.lit("/MapServer"))
        return _rows(
            placed, provider, id=F.concat(F.lit("ottawa:"), identity), year=F.col("n.year"),
            title=F.concat(F.lit("City of Ottawa aerial imagery "), F.col("n.year").cast("string")),
            coverage=F.col("coverage"), preview=_preview(F.lit("official-link"), url),
            policy=F.lit("unknown"), source_url=url)
    url = F.concat(F.lit(TORONTO_ROOT), leaf, F.lit("/MapServer"))
    policy = X.export_policy("m.copyrightText", "m.capabilities", "m.supportedImageFormatTypes",
                             "m.maxImageWidth", "m.maxImageHeight")
    open_ = F.col("_policy") == "exportable"
    template = F.concat(url, F.lit("/tile/{z}/{y}/{x}"))
    export = _export("arcgis-export", F.concat(url, F.lit("/export")),
                     F.least("m.maxImageWidth", F.lit(MAX_EXPORT)),
                     F.least("m.maxImageHeight", F.lit(MAX_EXPORT)))
    return _rows(
        placed.withColumn("_policy", policy), provider, id=F.concat(F.lit("toronto:"), identity),
        title=F.concat(F.lit("City of Toronto aerial imagery "), F.col("n.year").cast("string")),
        year=F.col("n.year"), resolution_m=F.col("n.resolution_m"), coverage=F.col("coverage"),
        preview=_preview(F.when(open_, "arcgis-map-service").otherwise("official-link"), url,
                         F.when(open_, template)),
        export=F.when(open_, export), policy=F.col("_policy"), source_url=url)


_RELEASE = "STRUCT<releaseDateLabel: STRING, itemTitle: STRING, releaseNum: STRING, itemURL: STRING>"


def wayback_catalog(docs: DataFrame) -> DataFrame:
    """Release rows of a configuration (column json) that is an object or an array."""
    listed = F.when(
        F.ltrim("json").startswith("["), F.from_json("json", f"ARRAY<{_RELEASE}>")).otherwise(
        F.map_values(F.from_json("json", f"MAP<STRING, {_RELEASE}>")))
    items = docs.select(F.explode(listed).alias("i")).select("i.*")
    label = F.coalesce(F.nullif("releaseDateLabel", F.lit("")), "itemTitle")
    year = F.nullif(F.regexp_extract(label, r"((?:19|20)\d{2})-\d{2}-\d{2}", 1), F.lit(""))
    usable = items.withColumn("year", year.cast("int")).where(
        F.col("year").isNotNull() & F.col("releaseNum").rlike(r"^\d+$") & F.col("itemURL").isNotNull())
    app = F.lit(WAYBACK_APP)
    return _rows(
        usable, "esri-wayback", id=F.concat(F.lit("esri-wayback:"), "releaseNum"),
        title=F.concat(F.lit("Esri World Imagery Wayback "), F.coalesce("releaseDateLabel", F.lit(""))),
        year=F.col("year"), coverage=G.bounds(-180.0, -85.0, 180.0, 85.0),
        preview=_preview(F.lit("wayback-timeline"), app), policy=F.lit("link-only"), source_url=app)


_LAYER = ("Name STRING, Title STRING, EX_GeographicBoundingBox STRUCT<westBoundLongitude: DOUBLE, "
          "eastBoundLongitude: DOUBLE, southBoundLatitude: DOUBLE, northBoundLatitude: DOUBLE>, "
          "Dimension ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>")


def wms_layers(docs: DataFrame) -> DataFrame:
    """(name, title, coverage, iso, year): leaf layers by published time (column xml).

    Layers without a name, box or only readable times are dropped.
    """
    # A leaf's text reaches its own end tag before another layer starts.
    starts = F.split("xml", r"<Layer(?=[\s>])")
    leaves = F.filter(starts, lambda t: t.contains("</Layer>"))
    texts = docs.select(F.explode(leaves).alias("t")).select(F.from_xml(F.concat(
        F.lit("<Layer"), F.substring_index("t", "</Layer>", 1), F.lit("</Layer>")), _LAYER).alias("l"))
    box = F.col("l.EX_GeographicBoundingBox")
    coverage = G.bounds(box["westBoundLongitude"], box["southBoundLatitude"],
                        box["eastBoundLongitude"], box["northBoundLatitude"])
    time = F.get(F.filter("l.Dimension", lambda d: d["_name"] == "time"), F.lit(0))["_VALUE"]
    times = F.filter(F.transform(F.split(time, ","), lambda v: F.trim(v)), lambda v: v != "")
    read = texts.select(
        F.trim("l.Name").alias("name"),
        F.trim(F.substring_index(F.coalesce(F.trim("l.Title"), F.trim("l.Name")), " / ", 1)).alias("title"),
        coverage.alias("coverage"), times.alias("times"))
    whole = read.where(
        X.has_text("name") & G.valid_coverage("coverage") & (F.size("times") > 0)
        & ~F.exists("times", lambda v: F.try_to_timestamp(v).isNull()))
    return whole.select("name", "title", "coverage", F.explode("times").alias("iso")).withColumn(
        "year", F.year(F.to_utc_timestamp(F.try_to_timestamp("iso"), F.current_timezone())))


def napl_catalog(docs: DataFrame) -> DataFrame:
    layers = wms_layers(docs)
    url = F.concat(F.lit(NAPL_SERVICE + "?LAYERS="), F.url_encode("name"), F.lit("&TIME="),
                   F.url_encode("iso"))
    year = F.col("year").cast("string")
    return _rows(
        layers, "napl", id=F.concat(F.lit("napl:"), "name", F.lit("-"), year),
        title=F.concat(F.lit("NAPL "), "title", F.lit(" aerial imagery "), year), year=F.col("year"),
        coverage=F.col("coverage"), preview=_preview(F.lit("wms-export"), url),
        export=_export("wms-export", url, F.lit(MAX_EXPORT), F.lit(MAX_EXPORT)),
        policy=F.lit("exportable"), source_url=F.lit(NAPL_CAPABILITIES))
