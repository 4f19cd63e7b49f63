"""File inventories, packages and their manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geodesy as D
from sitesift.functions import geometry as G
from sitesift.functions import text as X
from sitesift.operators.catalog import violations
from sitesift.operators.numbering import id_block, number_rows
from sitesift.session import durable

# Package limits in bytes and pixels, and media types by extension.
PACKAGE_LIMITS = {
    "image_bytes": 16_000_000, "image_pixels": 16_000_000, "raster_bytes": 128_000_000,
    "pixels": 160_000_000, "pdf_bytes": 64_000_000, "text_bytes": 8_000_000,
    "uncompressed_bytes": 256_000_000, "archive_bytes": 257_000_000,
    "working_bytes": 768_000_000, "entry_overhead": 1024, "end_overhead": 1024,
}
MEDIA_TYPES = {
    "dxf": "application/dxf", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
    "tif": "image/tiff", "pgw": "text/plain", "jgw": "text/plain", "tfw": "text/plain",
    "txt": "text/plain", "scr": "text/plain", "csv": "text/csv", "json": "application/json",
}
WORLD_EXTENSIONS = {"image/png": "pgw", "image/jpeg": "jgw", "image/tiff": "tfw"}
IMAGE_EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/tiff": "tif"}
MAX_LAYERS = 20
MAX_FILE_BYTES = 512 * 1024 * 1024
MAX_IMAGE_PIXELS = 100_000_000


def hash_inventory(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(path, sha256, bytes) of each file's content."""
    return files.select(
        path, F.sha2(content, 256).alias("sha256"),
        F.octet_length(content).cast("bigint").alias("bytes"))


def duplicate_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def reconcile_manifest(files: DataFrame, references: DataFrame) -> DataFrame:
    """(path_key, status): missing, unreferenced, duplicate, mismatch or ok.

    Both sides (path, bytes, sha256) are reduced to one row per case-folded
    path before the full outer join, so repeated paths do not multiply.
    """
    key = F.lower("path").alias("path_key")
    have = files.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("bytes").alias("_bytes"),
        F.min("sha256").alias("_sha"))
    want = references.groupBy(key).agg(
        F.min("bytes").alias("_wmin"), F.max("bytes").alias("_wmax"),
        F.min("sha256").alias("_smin"), F.max("sha256").alias("_smax"))
    joined = have.join(want, "path_key", "full_outer")
    same = (
        (F.col("_wmin") == F.col("_bytes")) & (F.col("_wmax") == F.col("_bytes"))
        & (F.col("_smin") == F.col("_sha")) & (F.col("_smax") == F.col("_sha")))
    status = (
        F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
        .when(F.col("_smin").isNull(), "unreferenced").when(same, "ok").otherwise("mismatch"))
    return joined.select("path_key", status.alias("status"))


def unreferenced_assets(assets: DataFrame, references: DataFrame, key: str = "asset_id") -> DataFrame:
    return assets.join(references.select(key), key, "left_anti")


def reference_lists(references: DataFrame) -> DataFrame:
    """One row per (asset, reference), in order, with the asset's totals.

    ``references``: asset_id, kind, owner_id, reference_id, width, height.
    ``conflict`` marks assets whose references disagree on kind or size. The
    list stays rows: an asset used by many records is not gathered anywhere.
    """
    totals = references.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_references"),
        (F.min("kind") != F.max("kind")).alias("_kinds"),
        ((F.min("width") != F.max("width")) | (F.min("height") != F.max("height"))).alias("_sizes"))
    numbered = number_rows(references, ["asset_id"], None, [F.col("reference_id")], "pos")
    return numbered.join(totals, "asset_id").select(
        "asset_id", "kind", "owner_id", "reference_id", "pos", "n_references",
        (F.col("_kinds") | F.col("_sizes")).alias("conflict"))


def aggregate_provenance(sources: DataFrame, *keys: str) -> DataFrame:
    """Names joined by " + ", the other texts by " | ", in layer order.

    ``sources``: keys, ord, name, attribution, license, evidence. Every item
    gets its whole text; ``error`` tells beside it that an item has more than
    the 20 layers that its contract allows.
    """
    fields = ("name", "attribution", "license", "evidence")
    listed = sources.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("ord", *fields))).alias("_layers"))

    def joined(field: str, separator: str) -> Column:
        return F.array_join(F.transform("_layers", lambda v: v[field]), separator)

    return listed.select(
        *keys, joined("name", " + ").alias("provider"),
        *[joined(f, " | ").alias(f) for f in fields[1:]],
        F.when(F.size("_layers") > MAX_LAYERS, F.lit("too-many-layers")).alias("error"))


def package_budget(
    rasters: DataFrame, packages: DataFrame, limits: dict[str, int] = PACKAGE_LIMITS,
) -> DataFrame:
    """Worst-case totals per package and every limit they overrun.

    ``rasters``: package_id, width, height. ``packages``: package_id,
    logo_bytes, logo_pixels, entry_count, pdf_bytes, text_bytes.
    """
    pixels = F.col("width").cast("bigint") * F.col("height")
    sums = rasters.groupBy("package_id").agg(
        F.count(F.lit(1)).alias("_rasters"), F.sum(pixels).alias("_pixels"),
        F.max(pixels).alias("_largest"))
    c = F.col
    joined = packages.join(sums, "package_id", "left").fillna(0, ["_rasters", "_pixels", "_largest"])
    sized = (
        joined.withColumn("total_pixels", c("_pixels") + c("logo_pixels"))
        .withColumn("raster_bytes", c("logo_bytes") + c("_rasters") * limits["image_bytes"])
        .withColumn("uncompressed_bytes", c("raster_bytes") + c("pdf_bytes") + c("text_bytes"))
        .withColumn("archive_bytes", c("uncompressed_bytes")
                    + c("entry_count") * limits["entry_overhead"] + limits["end_overhead"])
        .withColumn("working_bytes", c("total_pixels") * 4 + c("raster_bytes") + c("pdf_bytes")
                    + c("uncompressed_bytes") + c("archive_bytes")))
    over = violations([
        (c("_largest") > limits["image_pixels"], "image-pixels"),
        (c("total_pixels") > limits["pixels"], "pixels"),
        *[(c(n) > limits[n], n.replace("_", "-")) for n in (
            "raster_bytes", "pdf_bytes", "text_bytes", "uncompressed_bytes", "archive_bytes",
            "working_bytes")]])
    return sized.withColumn("overruns", over).drop("_rasters", "_pixels", "_largest")


def cache_complete(counts: DataFrame) -> DataFrame:
    """``complete`` per manifest status row (expected, listed, saved, failed, pending).

    With an expected count everything must be saved and listed; without one at
    least two documents must be. Nothing may have failed or be pending.
    """
    quiet = (F.col("failed") == 0) & (F.col("pending") == 0)
    whole = F.when(F.col("expected").isNull(), F.col("saved") >= 2).otherwise(
        (F.col("expected") >= 1) & (F.col("saved") == F.col("expected"))
        & (F.col("listed") == F.col("saved")))
    return counts.withColumn("complete", F.coalesce(quiet & whole, F.lit(False)))


def sort_manifest(files: DataFrame, path: str = "path") -> DataFrame:
    """Files in code-point order of their paths (a range-partitioned sort)."""
    return files.orderBy(path)


#: A stem that reads like a numbered name: the stem before the number, and the number.
NUMBERED_STEM = "^(.+)-([2-9]|[1-9][0-9]{1,17})$"


def _used_numbers(rows: DataFrame, key: str) -> DataFrame:
    """(_g, _base, _taken, _m, _first, _stem_key, _island, _end): numbers of a stem whose names are stems of their own.

    ``_first`` is the id that begins such a stem and ``_taken`` its extension. Consecutive numbers form an island that ends at ``_end``.
    """
    firsts = rows.where("_at = 1").select("_g", "_key", F.col(key).alias("_first"), F.col("_ext").alias("_taken"))
    used = firsts.select(
        "_g", F.regexp_extract("_key", NUMBERED_STEM, 1).alias("_base"), "_taken",
        F.regexp_extract("_key", NUMBERED_STEM, 2).try_cast("bigint").alias("_m"), "_first", F.col("_key").alias("_stem_key"))
    known = durable(used.where("_base <> ''").join(firsts.select("_g", F.col("_key").alias("_base")), ["_g", "_base"], "left_semi"))
    keys = ["_g", "_base", "_taken"]
    placed = number_rows(known, keys, [id_block("_m")], [F.col("_m")], "_nth").withColumn("_island", F.col("_m") - F.col("_nth")).drop("_nth")
    ends = placed.groupBy(*keys, "_island").agg(F.max("_m").alias("_end"))
    return durable(placed.join(ends, [*keys, "_island"]))


def _pass_over(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """``rows`` with their final ``_n``; each round takes every stem over the next island that one of its rows meets."""
    taken = used.select("_g", F.col("_base").alias("_key"), F.col("_m").alias("_n"), F.col("_taken").alias("_ext"), "_first", "_island", "_end")
    while True:
        met = rows.join(taken, ["_g", "_key", "_n", "_ext"]).where(F.col("_first") < F.col(key))
        hit = F.struct("_at", F.col("_n").alias("_from"), F.col(key).alias("_id"), "_ext", "_island", "_end")
        lost = durable(met.groupBy("_g", "_key").agg(F.min_by(hit, "_at").alias("_hit")).select("_g", "_key", "_hit.*"))
        if lost.isEmpty():
            return rows
        # Inside the island a number is free as well while the id that begins its name is a later one.
        later = lost.join(taken, ["_g", "_key", "_ext", "_island"]).where("_n > _from AND _first > _id").groupBy("_g", "_key").agg(F.min("_n").alias("_free"))
        step = lost.join(later, ["_g", "_key"], "left").select(
            "_g", "_key", F.col("_at").alias("_since"), (F.coalesce("_free", F.col("_end") + 1) - F.col("_from")).alias("_more"))
        moved = rows.join(step, ["_g", "_key"], "left")
        rows = durable(moved.withColumn("_n", F.col("_n") + F.when(F.col("_at") >= F.col("_since"), F.col("_more")).otherwise(0)).select(*rows.columns))


def allocate_filenames(
    items: DataFrame, group: str = "package_id", key: str = "id", label: str = "label",
    mime: str = "mime", blocks: Sequence[Column] | None = None,
) -> DataFrame:
    """(group, id, path, world_path): slugs, numbered from the second of a stem on, in the order of the ids.

    A generated name may meet a natural one; the lower id keeps it. The used numbers of a stem are known beforehand, as
    the stems that read like its numbered names; consecutive ones are islands. A row that meets an island goes
    to the next free number, with all later rows of its stem, so the rounds follow the islands met and not the rows. A stem that reads
    like a numbered name is settled after the stem before its number, which may have taken its own first name.
    A null group is a group; ids are unique in a group and not null.
    """
    extension = F.create_map(*[F.lit(v) for kv in IMAGE_EXTENSIONS.items() for v in kv])[F.col(mime)]
    world = F.create_map(*[F.lit(v) for kv in WORLD_EXTENSIONS.items() for v in kv])[F.col(mime)]
    named = items.select(
        group, key, X.slug(F.col(label)).alias("_stem"), extension.alias("_ext"), world.alias("_world"))
    keyed = named.withColumn("_key", F.lower("_stem"))
    if blocks is None and dict(items.dtypes)[key] != "string":
        blocks = [id_block(key)]
    numbered = number_rows(keyed, [group, "_key"], blocks, [F.col(key)], "_at")
    rows = durable(numbered.withColumn("_g", F.struct(group)).withColumn("_n", F.col("_at")))
    used = _used_numbers(rows, key)
    open_stems = durable(used.select("_g", F.col("_stem_key").alias("_key"), "_base", "_m", "_taken", "_first"))
    done = _pass_over(rows.join(open_stems, ["_g", "_key"], "left_anti").select(*rows.columns), used, key)
    while not open_stems.isEmpty():
        waiting = open_stems.select("_g", F.col("_key").alias("_base"))
        ready = durable(open_stems.join(waiting, ["_g", "_base"], "left_anti"))
        owners = done.select("_g", F.col("_key").alias("_base"), F.col("_n").alias("_m"), F.col("_ext").alias("_taken"), F.col(key).alias("_owner"))
        late = ready.join(owners, ["_g", "_base", "_m", "_taken"]).where("_owner < _first").select("_g", "_key", F.lit(1).alias("_late"))
        mine = rows.join(ready.select("_g", "_key"), ["_g", "_key"], "left_semi").join(late, ["_g", "_key"], "left")
        begun = durable(mine.withColumn("_n", F.col("_at") + F.coalesce("_late", F.lit(0))).select(*rows.columns))
        done = done.unionByName(_pass_over(begun, used, key))
        open_stems = durable(open_stems.join(ready.select("_g", "_key"), ["_g", "_key"], "left_anti"))

    def path(extra: str) -> Column:
        return F.concat(F.lit("images/"), F.col("_stem"), F.when(
            F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(F.lit("")),
            F.lit("."), F.col(extra))

    return done.select(group, key, path("_ext").alias("path"), path("_world").alias("world_path"))


def validate_files(files: DataFrame) -> DataFrame:
    """File rows (path, mime, sha256, bytes, pixel_width, pixel_height,
    world_file_path) with ``violations``."""
    c = F.col
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    types = F.create_map(*[F.lit(v) for kv in MEDIA_TYPES.items() for v in kv])
    worlds = F.create_map(*[F.lit(v) for kv in WORLD_EXTENSIONS.items() for v in kv])
    image = c("mime").isin(*WORLD_EXTENSIONS)
    logo = F.startswith("path", F.lit("company/"))
    stem = F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")
    expected = F.concat(stem, F.lit("."), worlds[c("mime")])
    pixels = c("pixel_width").cast("bigint") * c("pixel_height")
    return files.withColumn("violations", violations([
        (~X.archive_path_ok("path"), "path"),
        (~F.coalesce(types[ext] == c("mime"), F.lit(False)), "media-type"),
        (~F.coalesce(c("sha256").rlike(X.SHA256), F.lit(False)), "sha256"),
        (~F.coalesce(c("bytes").between(1, MAX_FILE_BYTES), F.lit(False)), "bytes"),
        (image & ~F.coalesce((c("pixel_width") > 0) & (c("pixel_height") > 0)
                             & (pixels <= MAX_IMAGE_PIXELS), F.lit(False)), "pixels"),
        (image & logo & c("world_file_path").isNotNull(), "logo-world-file"),
        (image & ~logo & ~c("world_file_path").eqNullSafe(expected), "world-file"),
        (~image & (c("pixel_width").isNotNull() | c("pixel_height").isNotNull()
                   | c("world_file_path").isNotNull()), "not-an-image"),
    ]))


def _side(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def validate_items(items: DataFrame, files: DataFrame) -> DataFrame:
    """Drawing items (code, year, verification, image_path, corners, rotation,
    residual_m, tolerance_m, controls) against their image rows, with
    ``violations``. ``corners`` run UL, UR, LR, LL in UTM metres."""
    c = F.col
    sizes = files.select(
        c("path").alias("image_path"), c("pixel_width").alias("_w"), c("pixel_height").alias("_h"),
        c("mime").alias("_mime"))
    joined = items.join(sizes, "image_path", "left")
    q = [c("corners")[i] for i in range(4)]
    across_x, across_y = q[1]["x"] - q[0]["x"], q[1]["y"] - q[0]["y"]
    down_x, down_y = q[3]["x"] - q[0]["x"], q[3]["y"] - q[0]["y"]
    across, down = F.hypot(across_x, across_y), F.hypot(down_x, down_y)
    scale = F.greatest(across, down)
    det = across_x * down_y - across_y * down_x
    largest = F.greatest(F.lit(1.0), *[F.abs(p[a]) for p in q for a in "xy"])
    off = largest * (2.220446049250313e-16 * 128)
    affine = (
        (F.abs(q[2]["x"] - (q[1]["x"] + q[3]["x"] - q[0]["x"])) <= off)
        & (F.abs(q[2]["y"] - (q[1]["y"] + q[3]["y"] - q[0]["y"])) <= off))
    in_range = ~F.exists("corners", lambda p: ~(
        p["x"].between(100_000, 900_000) & p["y"].between(0, 10_000_000)))
    column_scale, row_scale = across / c("_w"), down / c("_h")
    angle = F.atan2(across_y, across_x) / D.DEG
    turn = F.abs(D.signif(F.when(angle < 0, angle + 360).otherwise(angle)) - c("rotation"))
    apart = F.greatest(*[_side(c("controls")[i], q[i]) for i in range(4)])
    year_ok = F.when(c("year").isNull(), c("verification") == "unknown").otherwise(
        c("verification").isin("verified", "unverified"))
    coded = F.regexp_extract("code", r"^H-(\d{4})-[1-9]\d{0,6}$", 1)
    figure = c("code").isin("A", "B", "C", "D", "E")
    stem = F.concat(F.when(figure, F.lit("images/Figure-")).otherwise(F.lit("images/")), c("code"))
    return joined.withColumn("violations", violations([
        (~figure & (coded == ""), "code"),
        (~F.coalesce(year_ok, F.lit(False)), "verification"),
        ((coded != "") & ~c("year").eqNullSafe(F.try_to_number(coded, F.lit("9999")).cast("int")),
         "year-differs-from-code"),
        (c("_mime").isNull(), "image-missing"),
        (~F.startswith("image_path", F.concat(stem, F.lit("."))), "image-path"),
        (~in_range, "corner-range"),
        (~F.coalesce(det < scale * scale * -1e-12, F.lit(False)), "corner-order"),
        (~affine, "not-affine"),
        (F.abs(across_x * down_x + across_y * down_y) > across * down * 1e-10, "not-perpendicular"),
        (F.abs(column_scale - row_scale) > F.greatest(column_scale, row_scale) * 1e-10,
         "pixel-scale"),
        (F.least(turn, F.lit(360.0) - turn) > 1e-8, "rotation"),
        (c("residual_m") > c("tolerance_m"), "residual-over-tolerance"),
        (c("controls").isNotNull() & (F.abs(D.signif(apart) - c("residual_m"))
                                      > F.greatest(F.lit(1e-8), apart * 1e-10)), "residual"),
    ])).drop("_w", "_h", "_mime")
