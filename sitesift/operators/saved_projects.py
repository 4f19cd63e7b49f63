"""Saved project documents as whole records.

A document is JSON text. It is parsed once as VARIANT; known fields become typed columns, and what a record does not know is carried
beside them as maps of VARIANT (``extra`` of the project, of each figure and of each geology layer), so nothing is lost on
read and ``project_json`` writes everything back. Wrong records are reported in ``violations``, never dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.functions import geometry as G
from sitesift.operators.catalog import violations
from sitesift.operators.projects import FIGURES, SCHEMA_VERSION

# Field names of the saved format.
TEXTS = {"name": "name", "project_no": "projectNo", "date": "date", "address": "address"}
KNOWN = ("id", "name", "projectNo", "date", "address", "company", "location", "siteBoundary", "buildingBoundary", "annotations",
         "historical", "historicalSequenceCounters", "geology", "dpi", "companyProfileSnapshot", "exportPreferences", "figures",
         "createdAt", "updatedAt", "schemaVersion")
LAYER_SOURCES = {"A": "osm", "B": "esri-imagery", "C": "toporama", "D": "osm", "E": "osm"}
GEOLOGY = ("surficial", "bedrock")
DPI = 300
MAX_NOTES, MAX_SEQUENCE = 500, 1_000_000

PLACE = "struct<lat:double,lng:double>"
SIDES = "struct<north:double,south:double,east:double,west:double>"
NOTE = f"struct<id:string,figureCode:string,text:string,position:{PLACE},target:{PLACE},mask:boolean>"
PREVIEW = "struct<kind:string,url:string,layer:string,tileTemplate:string>"
EXPORT = (f"struct<kind:string,url:string,layer:string,maxWidth:bigint,maxHeight:bigint,resultId:string,coverage:{SIDES},"
          f"preview:{PREVIEW}>")
PLACEMENT = "struct<center:array<double>,groundWidth:double,groundHeight:double,sourceWidth:double,sourceHeight:double,rotationDegrees:double>"
ITEM = (f"struct<id:string,year:int,sequence:bigint,title:string,mode:string,providerId:string,sourceUrl:string,licenseUrl:string,"
        f"attribution:string,policy:string,resolutionMeters:double,bounds:{SIDES},placement:{PLACEMENT},assetId:string,"
        f"officialExport:{EXPORT},createdAt:string,updatedAt:string,name:string,size:bigint,dataUrl:string>")
SOURCE = ("struct<id:string,name:string,credits:string,sourceUrl:string,license:string,redistributionEvidence:string,"
          "acquisitionYear:int,acquisitionYearVerification:string,permissionConfirmed:boolean>")
COMPANY = ("struct<schemaVersion:int,id:string,companyName:string,address:string,phone:string,email:string,website:string,"
           "preparedBy:string,reviewedBy:string,logoAssetId:string,logoMime:string,logoWidth:double,logoHeight:double,"
           "logoPlacement:struct<align:string,scale:double>,updatedAt:string>")


def _at(value, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _kind(value, path: str) -> Column:
    """Type of what is at ``path``: OBJECT..., ARRAY..., STRING, BIGINT, VOID (a JSON null), or SQL null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _others(value, *known: str) -> Column:
    """The fields of an object that are not ``known``, as a map."""
    return F.map_filter(F.coalesce(_at(value, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")),
                        lambda k, _: ~k.isin(*known))


def _figures(saved: Column, old: Column) -> Column:
    """Map of the five figures, each with its title, span, status, bounds and other fields."""
    out = []
    for code, (title, extent) in FIGURES.items():
        own = _at(saved, f"$.figures.{code}", "variant")
        span = F.coalesce(_at(own, "$.extentMeters", "double"), F.lit(extent))
        if code == "B":
            span = F.when(old & (span == 250), F.lit(100.0)).otherwise(span)
        out += [F.lit(code), F.struct(
            F.coalesce(_at(own, "$.title", "string"), F.lit(title)).alias("title"), span.alias("extent_m"),
            F.coalesce(_at(own, "$.status", "string"), F.lit("Not Started")).alias("status"),
            _at(own, "$.bounds", SIDES).alias("bounds"),
            _others(own, "title", "extentMeters", "status", "bounds").alias("extra"))]
    return F.create_map(*out)


def _geology(saved: Column) -> Column:
    """Map of the two layers: null, or name, source and other fields. A bare file name becomes a custom source, and a
    custom source has all its fields, the missing ones as unknown."""
    out = []
    for kind in GEOLOGY:
        own = _at(saved, f"$.geology.{kind}", "variant")
        name, source = _at(own, "$.name", "string"), _at(own, "$.source", SOURCE)
        bare = source.isNull() & name.rlike(r"(?i)\.km[zl]$")
        custom = bare | F.coalesce(source["id"] == "custom", F.lit(False))
        default = lambda field, value: F.when(custom, F.coalesce(source[field], F.lit(value))).otherwise(source[field]).alias(field)
        filled = F.struct(
            F.when(bare, "custom").otherwise(source["id"]).alias("id"),
            F.when(bare, F.concat(F.lit("Custom import: "), name)).otherwise(source["name"]).alias("name"),
            default("credits", ""), source["sourceUrl"].alias("sourceUrl"), default("license", ""), default("redistributionEvidence", ""),
            source["acquisitionYear"].alias("acquisitionYear"), default("acquisitionYearVerification", "unknown"),
            default("permissionConfirmed", False))
        out += [F.lit(kind), F.when(_kind(own, "$").startswith("OBJECT"), F.struct(
            name.alias("name"), F.when(bare | source.isNotNull(), filled).alias("source"), _others(own, "name", "source").alias("extra")))]
    return F.create_map(*out)


def _entry(e: Column, kind: str, field: str) -> Column:
    """The value of a selection entry of exactly (kind, ``field``), else null."""
    fields = F.map_keys(_at(e, "$", "map<string,variant>"))
    ok = (F.size(fields) == 2) & (_at(e, "$.kind", "string") == kind) & (_kind(e, f"$.{field}") == "STRING")
    return F.when(ok, _at(e, f"$.{field}", "string"))


def _selection(saved: Column, items: Column) -> Column:
    """Chosen figures in their order, then chosen dated items by year, sequence and id; unknown and malformed entries go."""
    entries = _at(saved, "$.exportPreferences.selection", "array<variant>")
    codes = _at(saved, "$.exportPreferences.codes", "array<string>")
    figures = F.coalesce(F.transform(entries, lambda e: _entry(e, "figure", "code")), codes, F.array().cast("array<string>"))
    ids = F.coalesce(F.transform(entries, lambda e: _entry(e, "historical", "id")), F.array().cast("array<string>"))
    shown = F.filter(F.array(*[F.lit(c) for c in FIGURES]), lambda c: F.array_contains(figures, c))
    dated = F.array_sort(F.transform(
        F.filter(items, lambda h: F.array_contains(ids, h["id"])), lambda h: F.struct(h["year"], h["sequence"], h["id"].alias("id"))))
    return F.concat(
        F.transform(shown, lambda c: F.struct(F.lit("figure").alias("kind"), c.alias("key"))),
        F.transform(dated, lambda h: F.struct(F.lit("historical").alias("kind"), h["id"].alias("key"))))


def _counters(saved: Column, items: Column) -> Column:
    """Year to counter: the saved one or the largest sequence of the year's items, whichever is larger."""
    kept = F.coalesce(_at(saved, "$.historicalSequenceCounters", "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))
    used = F.filter(F.transform(items, lambda h: F.struct(h["year"].cast("string").alias("year"), h["sequence"].alias("n"))),
                    lambda u: u["year"].isNotNull() & u["n"].isNotNull())
    years = F.array_sort(F.array_union(F.map_keys(kept), F.transform(used, lambda u: u["year"])))
    most = lambda y: F.aggregate(
        used, F.coalesce(F.try_element_at(kept, y), F.lit(0).cast("bigint")), lambda n, u: F.when(u["year"] == y, F.greatest(n, u["n"])).otherwise(n))
    return F.map_from_arrays(years, F.transform(years, most))


def restore_projects(docs: DataFrame, key: str = "project_id", json: str = "json", keep: Sequence[str] = ()) -> DataFrame:
    """(key, schema_version, id, name, ..., extra, violations) of saved documents, brought to the current version.

    A text that is no JSON object, or null, gives a row of defaults with the violation ``document``. A field of the wrong type reads
    as absent and is reported. Repeated keys stay as they are: every document is a row. Columns of ``docs`` named in ``keep`` come along.
    """
    v = F.col("_v")
    read = docs.select(F.col(key), *keep, F.try_parse_json(F.col(json)).alias("_v"))
    nothing = F.array().cast(f"array<{ITEM}>")
    version = _at(v, "$.schemaVersion", "int")
    old = version.isNull() | (version < 3)
    text = lambda field: F.coalesce(F.when(_kind(v, f"$.{field}") == "STRING", _at(v, f"$.{field}", "string")), F.lit(""))
    ring = lambda field: F.coalesce(_at(v, f"$.{field}", "array<array<double>>"), F.array().cast("array<array<double>>"))
    wrong_text = F.lit(False)
    for field in TEXTS.values():
        wrong_text = wrong_text | (F.coalesce(_kind(v, f"$.{field}"), F.lit("STRING")) != "STRING")
    parsed = read.select(
        key, *keep, "_v", version.alias("saved_version"), F.lit(SCHEMA_VERSION).alias("schema_version"), _at(v, "$.id", "string").alias("id"),
        *[text(field).alias(name) for name, field in TEXTS.items()], text("company").alias("company"), _at(v, "$.location", PLACE).alias("location"),
        ring("siteBoundary").alias("site_boundary"), ring("buildingBoundary").alias("building_boundary"),
        F.coalesce(_at(v, "$.annotations", f"array<{NOTE}>"), F.array().cast(f"array<{NOTE}>")).alias("annotations"),
        F.coalesce(_at(v, "$.historical", f"array<{ITEM}>"), nothing).alias("historical"),
        _figures(v, old).alias("figures"), _geology(v).alias("geology"), F.coalesce(_at(v, "$.dpi", "int"), F.lit(DPI)).alias("dpi"),
        _at(v, "$.companyProfileSnapshot", COMPANY).alias("company_profile"), _at(v, "$.createdAt", "string").alias("created_at"),
        _at(v, "$.updatedAt", "string").alias("updated_at"), _others(v, *KNOWN).alias("extra"), wrong_text.alias("_texts"))
    lat, lng = F.col("location.lat"), F.col("location.lng")
    placed = F.coalesce(_kind(v, "$.location"), F.lit("VOID")) != "VOID"
    spans = F.exists(F.map_values("figures"), lambda f: ~F.coalesce((f["extent_m"] > 0) & (f["extent_m"] < float("inf")), F.lit(False)))
    crops = F.exists(F.map_values("figures"), lambda f: f["bounds"].isNotNull() & ~F.coalesce(_view_ok(f["bounds"], lat, lng), F.lit(False)))
    bad_list = lambda path: F.coalesce(~_kind(v, path).startswith("ARRAY"), F.lit(False))
    odd_years = F.exists(F.map_keys(F.coalesce(_at(v, "$.historicalSequenceCounters", "map<string,variant>"), F.create_map().cast("map<string,variant>"))),
                         lambda y: ~y.rlike(r"^(18|19|20)\d{2}$"))
    counts = F.exists(F.map_values("historical_counters"), lambda n: ~F.coalesce(n.between(0, MAX_SEQUENCE), F.lit(False)))
    return parsed.withColumn("selection", _selection(v, F.col("historical"))).withColumn("historical_counters", _counters(v, F.col("historical"))).withColumn(
        "violations", violations([
            (~F.coalesce(_kind(v, "$").startswith("OBJECT"), F.lit(False)), "document"),
            (F.coalesce(_kind(v, "$"), F.lit("")).startswith("OBJECT") & ~F.coalesce(_kind(v, "$.figures").startswith("OBJECT"), F.lit(False)), "figures"),
            (F.col("_texts"), "text-fields"),
            (placed & ~F.coalesce(G.valid_location(lat, lng), F.lit(False)), "location"),
            (bad_list("$.siteBoundary"), "site-boundary"), (bad_list("$.buildingBoundary"), "building-boundary"),
            (bad_list("$.annotations") | (F.size("annotations") > MAX_NOTES), "annotations"),
            (bad_list("$.historical"), "historical"),
            (odd_years | counts, "counters"), (spans, "figure-settings"), (crops, "figure-bounds"),
        ])).drop("_v", "_texts")


def _view_ok(b: Column, lat: Column, lng: Column) -> Column:
    """A saved view within the Mercator band, around the site where there is one."""
    sides = (b["north"] > b["south"]) & (b["east"] > b["west"]) & (b["south"] >= -85) & (b["north"] <= 85) & (b["west"] >= -180) & (b["east"] <= 180)
    return sides & (lat.isNull() | (lat.between(b["south"], b["north"]) & lng.between(b["west"], b["east"])))


def read_saved_projects(spark: SparkSession, path: str) -> DataFrame:
    """``restore_projects`` of files, one document a file, named by its address."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("project_id"), F.col("value").alias("json"))
    return restore_projects(files)


def project_json(restored: DataFrame, key: str = "project_id", keep: Sequence[str | Column] = ()) -> DataFrame:
    """(key, json): the records in the saved format, fields of ``extra`` included; nulls are left out. ``keep`` adds columns beside them."""
    figures = F.transform_values("figures", lambda _, f: _merged(
        F.struct(f["title"].alias("title"), f["extent_m"].alias("extentMeters"), f["status"].alias("status"), f["bounds"].alias("bounds")), f["extra"]))
    geology = F.transform_values("geology", lambda _, g: F.when(g.isNotNull(), _merged(F.struct(g["name"].alias("name"), g["source"].alias("source")), g["extra"])))
    chosen = F.transform("selection", lambda s: F.when(s["kind"] == "figure", F.create_map(F.lit("kind"), s["kind"], F.lit("code"), s["key"])).otherwise(
        F.create_map(F.lit("kind"), s["kind"], F.lit("id"), s["key"])))
    codes = F.transform(F.filter("selection", lambda s: s["kind"] == "figure"), lambda s: s["key"])
    sources = F.create_map(*[F.lit(x) for pair in LAYER_SOURCES.items() for x in pair])
    body = F.struct(
        F.col("schema_version").alias("schemaVersion"), "id", *[F.col(n).alias(f) for n, f in TEXTS.items()], "company", "location",
        F.col("site_boundary").alias("siteBoundary"), F.col("building_boundary").alias("buildingBoundary"), "annotations", "historical",
        F.col("historical_counters").alias("historicalSequenceCounters"), F.transform_values(figures, lambda _, j: F.parse_json(j)).alias("figures"),
        F.transform_values(geology, lambda _, j: F.parse_json(j)).alias("geology"), "dpi", F.col("company_profile").alias("companyProfileSnapshot"),
        F.struct(codes.alias("codes"), chosen.alias("selection"), sources.alias("sources")).alias("exportPreferences"),
        F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"))
    return restored.select(key, *keep, _merged(body, F.col("extra")).alias("json"))


def _merged(known: Column, extra: Column) -> Column:
    """JSON of an object whose fields are those of both."""
    own, more = F.to_json(known), F.to_json(extra)
    return F.when(more == "{}", own).when(own == "{}", more).otherwise(F.concat(F.substr(own, F.lit(1), F.length(own) - 1), F.lit(","), F.substr(more, F.lit(2))))


def print_rows(restored: DataFrame, key: str = "project_id") -> DataFrame:
    """The columns of ``rules.print_rules``, one row a figure; site_unit is null until it is joined."""
    company = F.col("company_profile")
    site = G.valid_location("lat", "lng")
    layer = F.when(F.col("figure") == "D", F.col("geology")["surficial"]).when(F.col("figure") == "E", F.col("geology")["bedrock"])
    names = {"company_name": "companyName", "company_address": "address", "phone": "phone", "email": "email", "website": "website",
             "logo_asset_id": "logoAssetId", "logo_mime": "logoMime", "logo_width": "logoWidth", "logo_height": "logoHeight"}
    rows = restored.select(key, "name", "project_no", "date", "address", F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"),
                           *[company[f].alias(n) for n, f in names.items()], company["logoPlacement"]["scale"].alias("logo_scale"),
                           (F.size("site_boundary") >= 4).alias("boundary_ok"), "geology", F.explode(F.array(*[F.lit(c) for c in FIGURES])).alias("figure"))
    return rows.withColumn("boundary_ok", F.col("boundary_ok") & F.coalesce(site, F.lit(False))).withColumn(
        "layer_loaded", layer["source"].isNotNull()).withColumn("site_unit", F.lit(None).cast("string")).drop("geology")


def note_rows(restored: DataFrame, key: str = "project_id") -> DataFrame:
    """(project_id, annotations) as ``rules.validate_annotations`` takes them."""
    return restored.select(F.col(key).alias("project_id"), F.transform("annotations", lambda a: F.struct(
        a["id"].alias("id"), a["figureCode"].alias("figure"), a["text"].alias("text"), a["position"]["lat"].alias("lat"), a["position"]["lng"].alias("lng"),
        a["target"]["lat"].alias("target_lat"), a["target"]["lng"].alias("target_lng"), a["mask"].alias("mask"))).alias("annotations"))


def item_rows(restored: DataFrame, key: str = "project_id") -> DataFrame:
    """Dated items that are no legacy ones, with the columns of ``rules.validate_historical``."""
    h = F.col("h")
    rows = restored.select(F.col(key).alias("project_id"), "location", F.posexplode("historical").alias("pos", "h")).where(h["dataUrl"].isNull())
    box = lambda b: F.when(b.isNotNull(), G.bounds(b["west"], b["south"], b["east"], b["north"]))
    return rows.select(
        "project_id", "pos", "h.id", "h.year", "h.sequence", "h.title", "h.mode", "h.attribution", "h.policy", h["resolutionMeters"].alias("resolution_m"),
        box(h["bounds"]).alias("bounds"), F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"), h["createdAt"].alias("created_at"),
        h["updatedAt"].alias("updated_at"), h["providerId"].alias("provider_id"), h["assetId"].alias("asset_id"), h["sourceUrl"].alias("source_url"),
        h["licenseUrl"].alias("license_url"), box(h["officialExport"]["coverage"]).alias("source_coverage"))


def counter_rows(restored: DataFrame, key: str = "project_id") -> DataFrame:
    """(project_id, year, counter)."""
    return restored.select(F.col(key).alias("project_id"), F.explode("historical_counters").alias("year", "counter")).withColumn("year", F.col("year").cast("int"))
