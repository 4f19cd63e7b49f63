"""Record rules as report columns: every broken rule of a row, not the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geodesy as D
from sitesift.functions import geometry as G
from sitesift.functions import text as X
from sitesift.operators.catalog import violations

COMPANY_TEXTS = ("company_name", "company_address", "phone", "email", "website")
COMPANY_CODES = ("company-name", "company-address", "company-phone", "company-email",
                 "company-website")
# Rule codes that block a sheet; the others only warn.
BLOCKING = ("figure", "site-boundary", "surficial-layer", "surficial-unit", "bedrock-layer",
            "bedrock-unit")
FIGURE_CODES = ("A", "B", "C", "D", "E")
STATUSES = ("unknown", "unverified", "verified")


def company_rules() -> list[tuple[Column, str]]:
    """Rules over company_name, company_address, phone, email, website,
    logo_asset_id, logo_mime, logo_width, logo_height and logo_scale."""
    c = F.col
    missing = [(~X.has_text(f), code) for f, code in zip(COMPANY_TEXTS, COMPANY_CODES)]
    contact = F.concat_ws(" | ", *COMPANY_TEXTS[1:])
    long_contact = F.length(contact) > 500
    for f in COMPANY_TEXTS[1:]:
        long_contact = long_contact | F.coalesce(F.length(f) > 220, F.lit(False))
    named = X.has_text("logo_asset_id")
    sized = F.coalesce((c("logo_width") > 0) & (c("logo_height") > 0), F.lit(False))
    typed = F.coalesce(c("logo_mime").isin("image/png", "image/jpeg"), F.lit(False))
    any_logo = named | X.has_text("logo_mime") | F.coalesce(c("logo_width") > 0, F.lit(False)) | \
        F.coalesce(c("logo_height") > 0, F.lit(False))
    return [
        *missing,
        (~named, "company-logo"),
        (any_logo & ~(named & typed & sized), "company-logo-record"),
        (~F.coalesce(c("logo_scale").between(0.5, 1.5), F.lit(False)), "company-logo-placement"),
        (F.length("company_name") > 160, "company-name-fit"),
        (long_contact, "company-contact-fit"),
    ]


def validate_company(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("violations", violations(company_rules()))


def print_rules(figure) -> list[tuple[Column, str]]:
    """Rules of one figure over name, project_no, date, address, lat, lng, the
    company columns, boundary_ok, layer_loaded and site_unit."""
    figure, c = G.col(figure), F.col
    loaded = F.coalesce(c("layer_loaded"), F.lit(False))
    return [
        (~X.has_text("name"), "project-name"),
        (~X.has_text("project_no"), "project-number"),
        (~X.valid_date("date"), "project-date"),
        (~X.has_text("address"), "address"),
        (~G.valid_location("lat", "lng"), "location"),
        (~F.coalesce(figure.isin(*FIGURE_CODES), F.lit(False)), "figure"),
        *company_rules(),
        ((figure == "B") & ~F.coalesce(c("boundary_ok"), F.lit(False)), "site-boundary"),
        ((figure == "D") & ~loaded, "surficial-layer"),
        ((figure == "D") & ~X.has_text("site_unit"), "surficial-unit"),
        ((figure == "E") & ~loaded, "bedrock-layer"),
        ((figure == "E") & ~X.has_text("site_unit"), "bedrock-unit"),
    ]


def print_requirements(projects: DataFrame, figure="figure") -> DataFrame:
    return projects.withColumn("violations", violations(print_rules(figure)))


def sheet_readiness(projects: DataFrame, datasets: DataFrame, units: DataFrame) -> DataFrame:
    """(project_id, figure, ready, reasons, warnings) for the five figures.

    ``projects`` has the columns of ``print_rules`` but for layer_loaded and
    site_unit, and bounds. ``datasets``: project_id, kind, source_name,
    coverage. ``units``: project_id, kind, site_unit.
    """
    kind = F.when(F.col("figure") == "D", "surficial").when(F.col("figure") == "E", "bedrock")
    rows = projects.withColumn(
        "figure", F.explode(F.array(*[F.lit(f) for f in FIGURE_CODES]))).withColumn("kind", kind)
    joined = rows.join(datasets, ["project_id", "kind"], "left").join(
        units, ["project_id", "kind"], "left")
    labelled = X.has_text("source_name")
    covers = G.bbox_contains("coverage", "bounds")
    known = F.col("source_name").isNotNull()
    judged = joined.withColumn("layer_loaded", labelled & covers).withColumn(
        "_found", violations(print_rules("figure")))
    own = violations([
        (~G.valid_bounds("bounds", "lat", "lng"), "sheet-bounds"),
        (known & ~labelled, "unlabelled-source"), (known & ~covers, "sheet-not-covered")])
    blocking = F.array(*[F.lit(b) for b in BLOCKING])
    reasons = F.concat(own, F.array_intersect("_found", blocking))
    return judged.select(
        "project_id", "figure", (F.size(reasons) == 0).alias("ready"), reasons.alias("reasons"),
        F.array_except("_found", blocking).alias("warnings"))


def historical_readiness(
    items: DataFrame, providers: DataFrame,
    export_kinds: tuple[str, ...] = ("arcgis-export", "wms-export"),
) -> DataFrame:
    """Approved items (mode, policy, bounds, site lat/lng, urls, export
    snapshot ...) with ``reasons`` against the current provider registry."""
    c = F.col
    now = providers.select("provider_id", *[c(f).alias(f"_p_{f}") for f in (
        "policy", "license_url", "coverage", "allowed_origins", "allowed_roots")])
    joined = items.join(now, "provider_id", "left")
    official = c("mode") == "official"
    known = official & c("_p_policy").isNotNull()

    def outside(url) -> Column:
        return ~X.url_allowed(url, "_p_allowed_origins", "_p_allowed_roots")

    ex = c("export")
    covered = G.bbox_contains("_p_coverage", "bounds", null_ok=False) & G.bounds_hold_point(
        "_p_coverage", "lat", "lng")
    reasons = violations([
        (~G.valid_bounds("bounds", "lat", "lng"), "crop-bounds"),
        (~D.crop_aspect_ok("bounds"), "crop-aspect"),
        (~c("policy").eqNullSafe("exportable"), "item-policy"),
        (official & c("_p_policy").isNull(), "provider-unknown"),
        (known & (c("_p_policy") != "exportable"), "provider-policy"),
        (known & ~covered, "provider-coverage"),
        (known & ~c("license_url").eqNullSafe(c("_p_license_url")), "licence-changed"),
        (known & outside("source_url"), "source-url"),
        (known & outside(ex["url"]), "export-url"),
        (known & ~F.coalesce(ex["kind"].isin(*export_kinds) & (ex["max_width"] >= 256)
                             & (ex["max_height"] >= 256), F.lit(False)), "export-unusable"),
        (known & (c("result_id").isNull() | c("source_coverage").isNull()), "identity-missing"),
        (known & c("source_coverage").isNotNull() & ~G.bbox_contains(
            "source_coverage", "bounds", null_ok=False), "crop-outside-source"),
        ((c("mode") == "manual") & (c("asset_id").isNull() | c("placement").isNull()),
         "asset-missing"),
        (~c("mode").isin("official", "manual"), "mode"),
    ])
    return joined.withColumn("reasons", reasons).withColumn(
        "ready", F.size("reasons") == 0).select(*items.columns, "ready", "reasons")


def validate_historical(items: DataFrame, max_year: int) -> DataFrame:
    """The approved item's contract, with uniqueness of ids and of (year, sequence)
    per project. Repeats are counted before the join, never in a window."""
    c = F.col
    ids = items.groupBy("project_id", "id").agg(F.count(F.lit(1)).alias("_ids"))
    places = items.groupBy("project_id", "year", "sequence").agg(F.count(F.lit(1)).alias("_places"))
    joined = items.join(ids, ["project_id", "id"], "left").join(
        places, ["project_id", "year", "sequence"], "left")
    official, manual = c("mode") == "official", c("mode") == "manual"
    created, updated = X.parsed_timestamp("created_at"), X.parsed_timestamp("updated_at")
    safe = lambda url: X.url_allowed(url)
    return joined.withColumn("violations", violations([
        (~F.coalesce(c("id").rlike(X.UUID), F.lit(False)), "id"),
        (~X.valid_year("year", max_year), "year"),
        (~F.coalesce(c("sequence").between(1, 1_000_000), F.lit(False)), "sequence"),
        (~X.bounded_text("title", 240), "title"),
        (~F.coalesce(official | manual, F.lit(False)), "mode"),
        (~X.bounded_text("attribution", 1000), "attribution"),
        (~c("policy").eqNullSafe("exportable"), "policy"),
        (c("resolution_m") <= 0, "resolution"),
        (~F.when(c("lat").isNull() & c("lng").isNull(), G.valid_bounds("bounds"))  # a project without a site yet
          .otherwise(G.valid_bounds("bounds", "lat", "lng")), "bounds"),
        (created.isNull(), "created-at"), (updated.isNull(), "updated-at"),
        (updated < created, "updated-before-created"),
        (official & ~F.coalesce(c("provider_id").rlike(X.PROVIDER_ID), F.lit(False)), "provider"),
        (official & c("asset_id").isNotNull(), "official-with-asset"),
        (official & ~safe("source_url"), "source-url"),
        (official & ~safe("license_url"), "licence-url"),
        (manual & c("provider_id").isNotNull(), "manual-with-provider"),
        (manual & ~F.coalesce(c("asset_id").rlike(X.UUID), F.lit(False)), "asset"),
        (manual & c("source_url").isNotNull() & ~safe("source_url"), "source-url"),
        (official & c("source_coverage").isNotNull() & ~G.bbox_contains(
            "source_coverage", "bounds", null_ok=False), "crop-outside-source"),
        (c("_ids") > 1, "id-repeated"), (c("_places") > 1, "sequence-repeated"),
    ])).drop("_ids", "_places")


def validate_annotations(projects: DataFrame) -> DataFrame:
    """Annotations (id, figure, text, lat, lng, target_lat, target_lng, mask) of
    each project, exploded, with ``violations``."""
    c = F.col
    rows = projects.select(
        "project_id", F.size("annotations").alias("_n"),
        F.posexplode("annotations").alias("pos", "a")).select("project_id", "_n", "pos", "a.*")
    repeats = rows.groupBy("project_id", "id").agg(F.count(F.lit(1)).alias("_ids"))
    joined = rows.join(repeats, ["project_id", "id"], "left")
    target = c("target_lat").isNotNull() | c("target_lng").isNotNull()
    return joined.withColumn("violations", violations([
        (c("_n") > 500, "too-many"),
        (~F.coalesce(c("id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), F.lit(False)), "id"),
        (c("_ids") > 1, "id-repeated"),
        (~F.coalesce(c("figure").isin(*FIGURE_CODES), F.lit(False)), "figure"),
        (~X.bounded_text("text", 300), "text"),
        (~G.valid_location("lat", "lng"), "position"),
        (target & ~G.valid_location("target_lat", "target_lng"), "target"),
        (~F.coalesce(c("mask"), F.lit(False)), "mask"),
    ])).drop("_n", "_ids")


def validate_provenance(sources: DataFrame, max_year: int) -> DataFrame:
    """Custom geology sources (name, credits, license, evidence, source_url,
    year, verification, permission) with ``violations``."""
    c = F.col
    limits = (("name", 200), ("credits", 500), ("license", 1000), ("evidence", 1000))
    texts = [(~X.bounded_text(f, n), f) for f, n in limits]
    url = c("source_url")
    public = url.rlike(r"(?i)^https?://[^/?#@\s]+(?:[/?#]\S*)?$") & (F.length(url) <= 2048)
    return sources.withColumn("violations", violations([
        *texts,
        (X.has_text("source_url") & ~public, "source-url"),
        (c("year").isNotNull() & ~X.valid_year("year", max_year), "year"),
        (~F.coalesce(c("verification").isin(*STATUSES), F.lit(False)), "verification"),
        (c("year").isNull() & (c("verification") != "unknown"), "unknown-year-verified"),
        (c("year").isNotNull() & (c("verification") == "unknown"), "known-year-unverified"),
        (~F.coalesce(c("permission"), F.lit(False)), "permission"),
    ]))
